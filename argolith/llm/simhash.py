"""Near copies by SimHash: 64-bit fingerprints that differ in few bits are linked.

A fingerprint has 8 bytes. Two that differ in at most 4 bits differ in at most 4 of
them, so they share at least 4 bytes at equal positions. The inverted index has a
posting list for the values of 3 positions at once; its 20 sets of positions are
chosen so that any 4 shared positions hold one of the sets. Within a posting list the
shared positional bytes of each pair are tallied, pairs with fewer than 4 are dropped,
and the others are verified on their bits. A task reports only links that join what
it had not joined yet, so copies are never expanded into all pairs; posting lists of
more than HOT_LIST fingerprints are dealt over several tasks, each holding two blocks.

Rows with equal fingerprints form one class before anything is compared. Null text
counts as empty; a text without words has fingerprint zero and is linked like any
other. Null ids are kept and never become a component's id unless it has no other.
Repeated rows come out as often as they go in; columns other than id and text are
ignored, whatever their names, and kept by `keep_first`. Empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, map_slices, materialise, parts_for, ship, table
from .graph import components

WIDTH = 4
SEED = 42
MAX_BITS = 4
HOT_LIST = 50_000
#: Entries of the index that a task gathers, about.
PART_ENTRIES = 1_000_000
_BYTES = 8
_MIN_SHARED = _BYTES - MAX_BITS
_AT_ONCE = 1 << 16


def _covering() -> list[tuple[int, int, int]]:
    """Sets of 3 positions such that any 4 positions hold one (Turan's construction): with positions dealt into
    3 groups, the sets within a group, and those with two positions in a group and the third in the next."""
    group = [p % 3 for p in range(_BYTES)]
    sets = []
    for t in combinations(range(_BYTES), 3):
        of = sorted(group[p] for p in t)
        pairs = [g for g in range(3) if of.count(g) == 2]
        if of.count(of[0]) == 3 or pairs and of.count((pairs[0] + 1) % 3) == 1:
            sets.append(t)
    return sets


POSITIONS = _covering()


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    """The fingerprint as an unsigned 64-bit integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(words) - k + 1
    starts, ends = starts[:n].tolist(), ends[k - 1 :].tolist()
    for at in range(0, n, _AT_ONCE):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + _AT_ONCE], ends[at : at + _AT_ONCE])), ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp long: the fingerprint's bits) for each row."""
    ship(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(x, width) for x in b.column(1).to_pylist()], np.uint64)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

        return f

    return map_slices(rows, make, f"id {key}, fp long")


class _Joined:
    """What has been joined so far: labels of n things, equal for things of one component."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def _root(self, x: int) -> int:
        label = self.label
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Joins a[i] and b[i]; returns the pairs that were needed for it."""
        apart = self.label[a] != self.label[b]
        out = []
        for x, y in zip(a[apart].tolist(), b[apart].tolist()):
            p, q = self._root(x), self._root(y)
            if p != q:
                self.label[max(p, q)] = min(p, q)
                out.append((x, y))
        while out and (self.label != (flat := self.label[self.label])).any():
            self.label = flat
        return out


def near(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which pairs share the guaranteed number of positional bytes and differ in at most max_bits bits."""
    x = a ^ b
    ok = (x.view(np.uint8).reshape(-1, _BYTES) == 0).sum(1) >= _MIN_SHARED
    ok[ok] = np.bitwise_count(x[ok]) <= max_bits
    return ok


def link(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join whatever near fingerprints of equal key join."""
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    known, index = np.unique(fp, return_inverse=True)
    joined, out = _Joined(len(known)), []
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    ends = np.repeat(np.concatenate((starts[1:], [len(key)])), np.diff(np.concatenate((starts, [len(key)]))))
    at, lag = np.arange(len(key)), 1
    while len(at := at[at + lag < ends[at]]):
        for k in range(0, len(at), 1 << 20):
            a = at[k : k + (1 << 20)]
            ok = near(fp[a], fp[a + lag])
            out += joined.add(index[a[ok]], index[a[ok] + lag])
        lag += 1
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return known[pairs[:, 0]], known[pairs[:, 1]]


def links(classes: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """(u, v): links between the distinct fingerprints `fp` that leave their components as all links would."""
    parts = max(parts_for(classes.sparkSession), -(-classes.count() * len(POSITIONS) // PART_ENTRIES))

    def byte(p: int):
        return F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255))

    keys = F.array(*[F.lit(t << 24).cast("long") + byte(i) * 65536 + byte(j) * 256 + byte(k) for t, (i, j, k) in enumerate(POSITIONS)])
    index = classes.select("fp", F.explode(keys).alias("key"))
    hot = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_list)
    blocks = F.ceil(F.col("n") / hot_list).cast("int")
    # A long list is cut into blocks; a fingerprint goes to the cells of its block with each block, itself included.
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    cells = F.when(
        F.col("n").isNotNull(),
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own)),
    ).otherwise(F.array(F.lit(0)))
    dealt = index.join(hot, "key", "left").withColumn("blocks", blocks).select("fp", "key", F.explode(cells).alias("cell"))
    dealt = dealt.select("fp", F.xxhash64("key", "cell").alias("cell_key")).repartition(parts, "cell_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(1).to_numpy(), b.column(0).to_numpy()) for b in batches]
        if got:
            key, fp = (np.concatenate(x) for x in zip(*got))
            u, v = link(key, fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, fp long, component_id: the smallest id reachable over links) for each row."""
    marked = materialise(fingerprints(docs, id_col, text_col, width))
    classes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = classes.join(components(links(classes)).select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    roots = roots.withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component holds a smaller id; of rows that repeat an id all stay or go. Rows with null id stay."""
    return without_copies(docs, near_copies(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text"), id_col)


def without_copies(docs: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """docs without the rows whose id is greater than its component's; found: (id, component_id)."""
    (gone,) = aside(docs, "gone")
    rows = found.filter(F.col("id") > F.col("component_id")).select(F.col("id").alias(gone)).distinct()
    return docs.join(rows, docs[f"`{id_col}`"] == rows[gone], "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
