"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

Each sentence gets a probability from a logistic model of the words it holds, and the
document's is the noisy-or of its sentences'. The model is trained from the labels of
documents alone, and so learns which sentences offend.

Words are chosen by how far their document frequencies in toxic and other documents
lie apart, counted over all training documents; the weights are found by gradient
steps over bags of the chosen words. These steps take at most SAMPLE documents of each
label, those whose ids hash lowest, weighted by how many of that label there are.

Null text counts as empty and has no sentence; its score is the model's for such a
text. Rows come out as often as they go in; null ids are kept. Of repeated labels the
highest counts, null labels are ignored. Without labels of both kinds every score is 0.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_of_id, discard, map_slices, materialise, table

#: Documents of each label at most in the gradient steps.
SAMPLE = 4_000
#: Words of the model at most, and documents that must hold one.
WORDS, LEAST_DOCS = 4_000, 5
STEPS, RATE, DECAY = 600, 0.1, 1e-5
#: How far, in standard deviations, a word's share of toxic documents must lie above that of all.
APART = 4.0
THRESHOLD = 0.5
#: Labels that come to their documents by broadcast (some 20 bytes each); beyond that, documents are shuffled.
BROADCAST_LABELS = 2_000_000

_ENDS = re.compile(r"[.!?\n]+")
_KEPT = set(".!?\n")
_BLANK = {c: " " for c in range(0x250) if not chr(c).isalnum() and chr(c) not in _KEPT}


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any, in lower case, without punctuation."""
    return [w for s in _ENDS.split(text.lower().translate(_BLANK)) if (w := s.split())]


def sentence_spans(text: str) -> list[tuple[int, int]]:
    """Code points (start, end) of the sentences that `sentences` returns. Lower case keeps places for all but a few letters."""
    plain = "".join(c if len(c.lower()) != 1 else c.lower() for c in text).translate(_BLANK)
    out, at = [], 0
    for m in [*_ENDS.finditer(plain), None]:
        end = m.start() if m else len(plain)
        if plain[at:end].split():
            out.append((at, end))
        at = m.end() if m else end
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def sentence_scores(self, text: str) -> np.ndarray:
        get = self.weights.get
        z = [self.bias + sum(get(w, 0.0) for w in set(s)) for s in sentences(text)]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -60, 60)))

    def score(self, text: str) -> tuple[float, int]:
        """The document's score and the number of sentences at THRESHOLD or above."""
        known = self.weights
        bags = sentences(text)
        hits = [sum(map(known.__getitem__, set(h))) for s in bags if (h := [w for w in s if w in known])]
        plain = len(bags) - len(hits)
        z = [self.bias + h for h in hits]
        clean = plain * _softplus(self.bias) + sum(map(_softplus, z))
        return -math.expm1(-clean), sum(x >= _LOGIT for x in z) + plain * (self.bias >= _LOGIT)


_LOGIT = math.log(THRESHOLD / (1 - THRESHOLD))
NO_MODEL = Model({}, -60.0)


def _softplus(z: float) -> float:
    return max(z, 0.0) + math.log1p(math.exp(-abs(z)))


def _picked(labels: DataFrame) -> DataFrame:
    """(doc_id, y) of the labels for training: those with crc32 of the id mod 5 other than 0."""
    picked = labels.filter("toxic is not null and doc_id is not null").filter(crc32_of_id() % 5 != 0)
    return picked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))


def _labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids.select("doc_id", "y"), "doc_id")


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, text, y) of the documents of the gradient steps; how many labels for training there are of each kind."""
    picked = _picked(labels).withColumn("h", F.xxhash64("doc_id"))
    ids = None
    for y in (0, 1):  # a bounded number each, by a sort that keeps no more than that in a task
        few = picked.filter(F.col("y") == y).orderBy("h", "doc_id").limit(sample)
        ids = few if ids is None else ids.unionByName(few)
    n = {r["y"]: r["n"] for r in picked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return _labelled(docs, F.broadcast(ids)), n


def _words_of(rows: DataFrame) -> DataFrame:
    """(word, pos, neg): in how many toxic and other documents each word occurs; n of both under the empty word."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            pos: dict[str, int] = {}
            all_: dict[str, int] = {}
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for w in {"", *(w for s in sentences(text) for w in s)}:
                    all_[w] = all_.get(w, 0) + 1
                    if y:
                        pos[w] = pos.get(w, 0) + 1
            return pa.RecordBatch.from_arrays([pa.array(list(all_), pa.string()), pa.array([pos.get(w, 0) for w in all_], pa.int64()), pa.array(list(all_.values()), pa.int64())], ["word", "pos", "n"])

        return f

    counted = map_slices(rows.select("text", "y"), make, "word string, pos long, n long")
    return counted.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows, n = training_rows(docs, labels, sample)
    picked = _picked(labels)
    words = materialise(_words_of(_labelled(docs, F.broadcast(picked) if sum(n.values()) <= BROADCAST_LABELS else picked)))
    total = words.filter("word = ''").first()
    if total is None or not 0 < total["pos"] < total["n"]:
        discard(words)
        return NO_MODEL
    rate = total["pos"] / total["n"]
    z: Column = (F.col("pos") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = words.filter(f"word <> '' and n >= {LEAST_DOCS}").filter(z > APART).orderBy(z.desc(), "word").limit(WORDS)
    vocab = {r["word"]: i for i, r in enumerate(best.collect())}
    discard(words)

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            hits, plain = [], []
            for text in b.column(0).to_pylist():
                found = [sorted({vocab[w] for w in s if w in vocab}) for s in sentences(text)]
                hits.append([h for h in found if h])
                plain.append(len(found) - len(hits[-1]))
            return pa.RecordBatch.from_arrays([b.column(1), pa.array(plain, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32())))], ["y", "plain", "hits"])

        return f

    # A row of each training document, with the chosen words of its sentences only.
    bags = map_slices(rows.select("text", "y"), make, "y int, plain long, hits array<array<int>>").toArrow()
    y = bags["y"].to_numpy().astype(float)
    weight = np.where(y > 0, n[1] / (y > 0).sum(), n[0] / (y == 0).sum())
    weights, bias = _fit(y, weight / weight.mean(), bags["plain"].to_numpy().astype(float), bags["hits"].to_pylist(), len(vocab))
    return Model({w: float(weights[i]) for w, i in vocab.items()}, bias)


def _fit(y: np.ndarray, weight: np.ndarray, plain: np.ndarray, hits: list, size: int) -> tuple[np.ndarray, float]:
    """Gradient steps (Adam) on the log-likelihood of the documents' labels under the noisy-or."""
    order = sorted(range(len(y)), key=lambda i: (y[i], plain[i], hits[i]))  # the same model however rows arrive
    y, weight, plain, hits = y[order], weight[order], plain[order], [hits[i] for i in order]
    doc = np.array([d for d, h in enumerate(hits) for _ in h], np.int64)
    sent = np.array([k for k, s in enumerate(s for h in hits for s in h) for _ in s], np.int64)
    word = np.array([w for h in hits for s in h for w in s], np.int64)
    theta = np.zeros(size + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, STEPS + 1):
        z = theta[-1] + np.bincount(sent, theta[word], minlength=len(doc))
        b = theta[-1]
        clean = np.bincount(doc, np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, b)
        # d/d clean of y log(1 - exp(-clean)) - (1 - y) clean
        pull = weight * (np.where(y > 0, 1 / np.expm1(np.clip(clean, 1e-9, 60)), 0.0) - (1 - y))
        by_sentence = pull[doc] / (1 + np.exp(-z))
        grad = np.concatenate((np.bincount(word, by_sentence[sent], minlength=size), [by_sentence.sum() + (pull * plain).sum() / (1 + np.exp(-b))])) / len(y)
        grad[:-1] -= DECAY * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta += RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, predicted int, n_offending long: sentences at THRESHOLD or above) for each row."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [model.score(x) for x in b.column(1).to_pylist()]
            s = [x for x, _ in got]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32()), pa.array([n for _, n in got], pa.int64())], ["id", "score", "predicted", "n_offending"])

        return f

    return map_slices(rows, make, f"id {key}, score double, predicted int, n_offending long").withColumnRenamed("id", id_col)


def locate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, sentence_score): the sentences at THRESHOLD or above, in code points."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [(i, a, e, float(s)) for i, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for (a, e), s in zip(sentence_spans(x), model.sentence_scores(x)) if s >= THRESHOLD]
            cols = list(zip(*out)) or [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.int64(), pa.float64()))], ["id", "start", "end", "sentence_score"])

        return f

    return map_slices(rows, make, f"id {key}, start long, end long, sentence_score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic; no shuffle."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots are hard to map

    def make():
        return lambda b: b.filter(pa.array([model.score(x or "")[0] < THRESHOLD for x in b.column(at).to_pylist()], pa.bool_()))

    return map_slices(plain, make, plain.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), "score", "predicted", "n_offending")
