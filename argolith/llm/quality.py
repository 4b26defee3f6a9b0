"""Quality from weak labels: heuristic labellers vote, expectation-maximisation weighs them, a linear scorer learns.

LABELLERS look at a text from different sides and vote good (1), bad (0) or abstain.
How often each pattern of votes occurs is counted over all documents; there are at
most 3 ** len(LABELLERS) patterns, whatever the input. Expectation-maximisation over
these counts estimates each labeller's accuracies and the posterior of each pattern.
The posteriors of at most SAMPLE documents, those whose ids hash lowest among each
side, train a logistic scorer on hashed features of the text; it scores everything.

Null text counts as empty; all labellers abstain on it and it scores 0. Rows come out
as often as they go in; null ids are kept; no column but the text is looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, materialise, table

#: Documents that train the scorer, at most, of each side.
SAMPLE = 2_000
DIM = 1 << 12
ROUNDS, STEPS, RATE, DECAY = 60, 300, 0.05, 1e-4
THRESHOLD = 0.5
ABSTAIN = 2
#: Shares of words are taken of so many at least, so that single words weigh little.
FEW_WORDS = 40
#: Longer words count as several, of so many characters each: text without spaces is seen whole.
PIECE = 32

_SYMBOL = re.compile(r"[^\w\s.,;:'\"()!?-]")
_RUN = re.compile(r"[^\w\s]{2,}")


def _vote(x: float, good: float, bad: float) -> int:
    """Good up to `good`, bad from `bad` on, nothing in between."""
    return 1 if x <= good else 0 if x >= bad else ABSTAIN


@dataclass(frozen=True)
class _View:
    text: str
    words: list[str]
    lines: list[str]


def _symbols(v: _View) -> int:
    return _vote(len(_SYMBOL.findall(v.text)) / len(v.text), 0.01, 0.06)


def _capitals(v: _View) -> int:
    upper, lower = sum(map(str.isupper, v.words)), sum(map(str.islower, v.words))
    return _vote(upper / max(upper + lower, 1), 0.3, 0.6)


def _repeats(v: _View) -> int:
    if len(v.words) < 20:
        return ABSTAIN
    return _vote(sum(a == b for a, b in zip(v.words, v.words[1:])) / len(v.words), 0.05, 0.2)


def _bare(v: _View) -> int:
    """Words without a letter or digit."""
    return _vote(sum(not w[0].isalnum() and not any(map(str.isalnum, w)) for w in v.words) / len(v.words), 0.05, 0.2)


def _runs(v: _View) -> int:
    return _vote(len(_RUN.findall(v.text)) / len(v.words), 0.03, 0.25)


def _lengths(v: _View) -> int:
    mean = len(v.text) / len(v.words)
    return 0 if not 2 <= mean <= 30 else 1 if 3 <= mean <= 15 else ABSTAIN


def _variety(v: _View) -> int:
    """Distinct words against what their number lets expect."""
    if len(v.words) < 50:
        return ABSTAIN
    return _vote(-len(set(v.words)) / len(v.words) ** 0.8, -0.8, -0.4)


def _same_lines(v: _View) -> int:
    if len(v.lines) < 4:
        return ABSTAIN
    return _vote(1 - len(set(v.lines)) / len(v.lines), 0.2, 0.5)


LABELLERS = (_symbols, _capitals, _repeats, _bare, _runs, _lengths, _variety, _same_lines)


def votes(text: str) -> tuple[int, ...]:
    words = text.split()
    if not words:
        return (ABSTAIN,) * len(LABELLERS)
    v = _View(text, words, [x for x in text.split("\n") if x.strip()])
    return tuple(f(v) for f in LABELLERS)


def pattern(vote: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(vote))


def unpattern(code: int) -> tuple[int, ...]:
    return tuple(code // 3**i % 3 for i in range(len(LABELLERS)))


def posteriors(counts: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """The probability of `good` for each pattern, by expectation-maximisation over the patterns' counts."""
    codes = sorted(counts)
    if not codes:
        return {}
    v = np.array([unpattern(c) for c in codes])
    n = np.array([counts[c] for c in codes], float)
    good, bad, cast = v == 1, v == 0, v != ABSTAIN
    # To begin with, a labeller finds one bad text in three, and hardly ever faults a good one.
    p, prior = np.array([[0.3], [0.97]]) * np.ones(len(LABELLERS)), 0.8
    for _ in range(rounds):
        like = [np.log(prior) + (good * np.log(p[1]) + bad * np.log(1 - p[1])).sum(1), np.log(1 - prior) + (bad * np.log(p[0]) + good * np.log(1 - p[0])).sum(1)]
        post = 1 / (1 + np.exp(np.clip(like[1] - like[0], -60, 60)))
        for side, (weight, right) in enumerate(((n * (1 - post), bad), (n * post, good))):
            # Some votes of each kind to begin with; a labeller that faults good texts more often is not believed.
            p[side] = np.clip((np.array([0.6, 1.94])[side] + weight @ right) / (2 + weight @ cast), 0.8 if side else 0.02, 0.999)
        prior = np.clip((n @ post) / n.sum(), 0.05, 0.98)
    return dict(zip(codes, post.tolist()))


def _hash(x: str) -> int:
    h = 2166136261
    for c in x.encode():
        h = (h ^ c) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % DIM


#: Words whose hashed shape a worker remembers.
_known: dict[str, int] = {}


def _shape(word: str) -> str:
    """A word's look: kinds of characters with repetition left out, and the punctuation that it has."""
    out = []
    for c in word:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def features(text: str) -> np.ndarray:
    """Hashed shapes of words, their lengths and whether a word repeats the one before it: shares of all words, as roots. Long words count in pieces."""
    words = text.split()
    pieces = [w[at : at + PIECE] for w in words for at in range(0, len(w), PIECE)]
    seen: Counter = Counter(pieces)
    out = np.zeros(DIM, np.float32)
    if len(_known) > 200_000:
        _known.clear()
    for w, n in seen.items():
        if (h := _known.get(w)) is None:
            h = _known[w] = _hash("s" + _shape(w))
        out[h] += n
        out[len(w)] += n
    out[41] += sum(a == b for a, b in zip(words, words[1:]))
    return np.sqrt(out / max(len(pieces), FEW_WORDS))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        if not text.strip():
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(features(text) @ self.weights + self.bias, -60, 60))))


def voted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, votes long: the pattern of votes) for each row."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([pattern(votes(x or "")) for x in b.column(1).to_pylist()], pa.int64())], ["id", "votes"])

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {key}, votes long")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    cast = materialise(voted(docs, id_col, text_col))
    counts = {r["votes"]: r["count"] for r in cast.groupBy("votes").count().collect()}
    post = posteriors(counts)
    if not post:
        return Model(np.zeros(DIM), 0.0)
    silent = pattern((ABSTAIN,) * len(LABELLERS))
    few = None
    for side in (True, False):
        of = [c for c, p in post.items() if (p >= 0.5) == side and c != silent]
        rows = cast.filter(F.col("votes").isin(of)).filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(sample)
        few = rows if few is None else few.unionByName(rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few.dropDuplicates(["id"])), "id").select("text", "votes")

    def make():
        return lambda b: pa.RecordBatch.from_arrays([b.column(1), pa.array([features(x or "").tobytes() for x in b.column(0).to_pylist()], pa.binary())], ["votes", "x"])

    # At most 2 * sample rows of 4 * DIM bytes.
    got = sorted(map_slices(rows, make, "votes long, x binary").collect(), key=lambda r: (r["votes"], r["x"]))
    if not got:
        return Model(np.zeros(DIM), 0.0)
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in got])
    good = sum(n for c, n in counts.items() if post[c] >= 0.5) / sum(counts.values())
    return _fit(x, np.array([post[r["votes"]] for r in got]), good)


def _fit(x: np.ndarray, y: np.ndarray, good: float) -> Model:
    """Logistic regression on soft labels, each side weighing as much as its share of all documents."""
    share = np.clip((y >= 0.5).mean(), 0.01, 0.99)
    weight = np.where(y >= 0.5, good / share, (1 - good) / (1 - share))
    theta, m, v = np.zeros(DIM + 1), np.zeros(DIM + 1), np.zeros(DIM + 1)
    for t in range(1, STEPS + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ theta[:-1] + theta[-1], -60, 60)))
        e = weight * (p - y) / len(y)
        grad = np.concatenate((e @ x + DECAY * theta[:-1], [e.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(theta[:-1], float(theta[-1]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score double, keep boolean, votes string) for each row."""
    key = docs.schema[id_col].dataType.simpleString()

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in b.column(1).to_pylist()]
            s = [round(model.score(x), 6) for x in texts]
            shown = ["".join("01-"[v] for v in votes(x)) for x in texts]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([x >= THRESHOLD for x in s], pa.bool_()), pa.array(shown, pa.string())], ["id", "score", "keep", "votes"])

        return f

    return map_slices(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {key}, score double, keep boolean, votes string").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs)).select("doc_id", "score", "keep", "votes")
