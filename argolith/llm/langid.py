"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (n = 1 to 4, over letters
and single spaces) that both hold, divided by the root of the product of the numbers
each holds: the blended-spectrum presence kernel, on hashed n-grams. Kernel ridge
regression, one language against the rest, is fitted on Nystroem landmarks. As the
kernel is linear in the presence vector, landmarks and coefficients fold into one
matrix, and a batch of texts is scored by one matrix product.

Learning takes at most PER_LANG rows of each language, and SAMPLE in all (but one of
each language at least), those whose ids hash lowest; landmarks are LANDMARKS of each
of them, MARKS in all. Rows are chosen by a bound on the hash that follows from the
number of a language's rows, so few meet in one task. Every language that has a row
is learned; the model has a column for each. Whole texts are read both in learning
and in prediction.

Null text or text without a letter gets ``und`` and score 0; so does every text when
nothing could be learned. Rows come out as often as they go in; null ids are kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_of_id, map_slices, table

PER_LANG, SAMPLE = 400, 25_600
LANDMARKS, MARKS = 100, 6_400
ORDERS = 4
#: Hashed n-grams.
DIM = 1 << 15
RIDGE = 1e-2
#: Sharpness of the score.
SCALE = 6.0
UNKNOWN = "und"
#: Characters handled at once.
_AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def presence(text: str, dim: int = DIM) -> np.ndarray | None:
    """Which hashed n-grams the text holds; None if it has no letter."""
    held = np.zeros(dim, bool)
    any_letter = False
    for at in range(0, max(len(text), 1), _AT_ONCE):
        part = text[max(at - ORDERS, 0) : at + _AT_ONCE]
        code = np.frombuffer(part.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        letter = _letters()[code.astype(np.int64)]
        if not letter.any():
            continue
        any_letter = True
        code = np.where(letter, code, np.uint64(32))
        code = np.concatenate(([np.uint64(32)], code[letter | np.concatenate(([True], letter[:-1]))], [np.uint64(32)]))
        gram = np.zeros(len(code), np.uint64)
        for n in range(1, ORDERS + 1):
            gram = gram[: len(code) - n + 1] * np.uint64(0x100000001B3) + code[n - 1 :] + np.uint64(n)
            held[(gram * _MIX) >> np.uint64(64 - dim.bit_length() + 1)] = True
    return held if any_letter else None


def training_rows(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE) -> DataFrame:
    """(lang, text, h) of the rows to learn from: crc32 of the id mod 4 other than 2, lang not null, a bounded number."""
    open_ = docs.select("doc_id", "lang", "text").filter("lang is not null and text is not null and doc_id is not null").filter(crc32_of_id() % 4 != 2)
    counts = {r["lang"]: r["count"] for r in open_.groupBy("lang").count().collect()}  # a row for each language
    each = max(1, min(per_lang, sample // max(len(counts), 1)))
    # Of hashes that lie in [0, 1), twice as many rows as are wanted are expected under the bound.
    bound = docs.sparkSession.createDataFrame([(k, min(1.0, (2 * each + 50) / n)) for k, n in counts.items()], "lang string, bound double")
    h = F.xxhash64("doc_id")
    some = open_.join(F.broadcast(bound), "lang").filter(h.cast("double") / 2.0**64 + 0.5 <= F.col("bound")).select("lang", "doc_id").distinct()
    order = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= each).select("lang", "doc_id")
    # At most sample ids, or one for each language; of rows that repeat one and its language, one is taken.
    return open_.join(F.broadcast(ids), ["lang", "doc_id"]).withColumn("h", h).groupBy("lang", "doc_id", "h").agg(F.max("text").alias("text")).select("lang", "text", "h")


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: One column for each language: a text's scores are its presence vector times this, over the root of its size.
    matrix: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        held = [presence(x) if x else None for x in texts]
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        rows = [i for i, h in enumerate(held) if h is not None]
        if rows and self.langs:
            x = np.stack([held[i] for i in rows]).astype(np.float32)
            s = (x @ self.matrix) / np.sqrt(x.sum(1, keepdims=True))
            e = np.exp(SCALE * (s - s.max(1, keepdims=True)))
            for i, k, p in zip(rows, s.argmax(1), (e / e.sum(1, keepdims=True)).max(1)):
                out[i], score[i] = self.langs[k], round(float(p), 6)
        return out, score


def fit(lang: list[str], held: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    langs = tuple(sorted(set(lang)))
    landmarks = max(1, min(landmarks, MARKS // len(langs)))
    x = held.astype(np.float32)
    x /= np.sqrt(x.sum(1, keepdims=True))
    place = {y: k for k, y in enumerate(langs)}
    of = np.array([place[y] for y in lang])
    marks = np.concatenate([np.flatnonzero(of == k)[:landmarks] for k in range(len(langs))])
    m = x[marks]
    to_marks, among = (x @ m.T).astype(float), (m @ m.T).astype(float)
    target = np.where(of[:, None] == np.arange(len(langs)), 1.0, -1.0)
    # Every language weighs the same, whatever its number of rows.
    weight = (len(of) / len(langs) / np.bincount(of, minlength=len(langs)))[of][:, None]
    a = to_marks.T @ (weight * to_marks) + ridge * len(of) * among + 1e-6 * np.eye(len(marks))
    alpha = np.linalg.solve(a, to_marks.T @ (weight * target))
    return Model(langs, (m.T @ alpha).astype(np.float32))


def train(docs: DataFrame) -> Model:
    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            held = [presence(x) for x in b.column(1).to_pylist()]
            bits = [None if h is None else np.packbits(h).tobytes() for h in held]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary()), b.column(2)], ["lang", "bits", "h"])

        return f

    # A bounded number of rows of DIM / 8 bytes.
    rows = sorted(map_slices(training_rows(docs), make, "lang string, bits binary, h long").filter("bits is not null").collect(), key=lambda r: (r["h"], r["bits"]))
    if not rows:
        return Model((), np.zeros((DIM, 0), np.float32))
    return fit([r["lang"] for r in rows], np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in rows]))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred string, score double) for each row."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = b.column(1).to_pylist()
            got = [model.predict(texts[k : k + 128]) for k in range(0, len(texts), 128)]
            langs, scores = [x for a, _ in got for x in a], np.concatenate([s for _, s in got] or [np.zeros(0)])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

        return f

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {key}, lang_pred string, score double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs)).select("doc_id", (crc32_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")
