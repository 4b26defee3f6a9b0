"""Near copies by SimHash, checked on whole sets: documents whose sets of 5-word shingles are 0.8 alike or more (Jaccard) are linked.

Each set has WORDS fingerprints of 64 bits: bit b of one is 1 if bit b is set in over half
the hashes of the set, mixed in WORDS ways. Of two sets that are 0.8 alike a bit differs
with probability 0.152 at most (0.188 for sets of 4 and 5 shingles), so one fingerprint
guarantees nothing, but several together miss little. The inverted index has a posting
list for the values of two byte positions of a fingerprint; the 12 pairs of positions are
chosen so that any 3 shared positions hold one. Sets of at most SHORT shingles take all 28.
Within a posting list, pairs of sets whose sizes allow it and that differ in at most
MAX_BITS of two fingerprints are candidates. Of pairs exactly 0.8 alike 6 in 100,000 are
missed so, by calculation (of sets of 4 and 5 shingles 2 in 10,000); of closer ones less.
Each candidate is verified on the whole sets, so no other pair is linked.

Documents with equal sets form one class before anything is compared. Under the keys of
the first FIRST_WORDS fingerprints each class is compared with the next one only; then,
under all keys, with all classes of other components. Posting lists of more than HOT_LIST
classes, as estimated from a sample, are dealt over several tasks, each holding two blocks;
the estimate changes the dealing, not the pairs that meet. Only sets of candidates are
shuffled. Null text counts as empty; all texts without words are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, materialise, parts_for, ship
from .graph import components
from .simhash import HOT_LIST, PART_ENTRIES, SEED, without_copies

WIDTH = 5
ALIKE = 0.8
WORDS, FIRST_WORDS = 14, 2
#: Bits in which two pairs of fingerprints (128 bits) may differ.
MAX_BITS = 36
#: Pairs of byte positions, first those within 2 groups of 4, which are all that longer sets take.
POSITIONS = sorted(((i, j) for j in range(8) for i in range(j)), key=lambda t: (t[1] - t[0]) % 2)
GROUPED, SHORT = 12, 16
#: Entries by which a posting list of the greatest length that is not dealt is known, about.
SAMPLE = 200
#: Digests of sets that go to all tasks at most.
BROADCAST = 1_000_000
#: Hashes whose bits are summed up at once, in bytes; pairs that are compared at once.
_AT_ONCE, _PAIRS = 255, 1 << 18

_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, (3, WORDS), np.uint64) | np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of a text with fewer words, of all its words; none without words."""
    words = text.encode().lower().split()
    k = min(WIDTH, len(words))
    return np.array(sorted({xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in range(len(words) - k + 1)} if k else ()), np.uint64)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), SEED)


def fingerprints(s: np.ndarray) -> np.ndarray:
    """The WORDS fingerprints of a set."""
    counts = np.zeros(WORDS * 64, np.int64)
    for at in range(0, len(s), _AT_ONCE):
        h = (s[at : at + _AT_ONCE, None] ^ _MIX[0]) * _MIX[1]
        h = (h ^ (h >> np.uint64(32))) * _MIX[2]
        h ^= h >> np.uint64(29)
        counts += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(s), bitorder="little").view(np.uint64)


def index_keys(words: np.ndarray, pairs: int) -> np.ndarray:
    """The keys of each fingerprint under the first pairs of positions, for rows of fingerprints: rows x fingerprints x pairs."""
    at = np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape, 8).astype(np.int64)
    i, j = np.array(POSITIONS[:pairs]).T
    which = np.arange(words.shape[1])[:, None] * len(POSITIONS) + np.arange(pairs)
    return (which << 16) | (at[..., i] << 8) | at[..., j]


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def _marked(rows: DataFrame) -> DataFrame:
    """(id, fp long: the set's digest, n int: its size, words: its fingerprints) for each row."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x) for x in b.column(1).to_pylist()]
            fps = np.array([_digest(s) for s in sets], np.uint64).view(np.int64)
            words = [fingerprints(s).tobytes() if len(s) else b"" for s in sets]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), pa.array([len(s) for s in sets], pa.int32()), pa.array(words, pa.binary())], ["id", "fp", "n", "words"])

        return f

    return map_slices(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, fp long, n int, words binary")


def _entries(classes: DataFrame, words: int) -> DataFrame:
    """(fp, root, n, a, b, key): an entry for each key of the first fingerprints; a, b: the key's fingerprint and the next one; root: 0 where it is fp, which packs better."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            got = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint64).reshape(-1, WORDS)
            fp, root, n = (b.column(k).to_numpy() for k in range(3))
            cols = [fp, np.where(root == fp, 0, root), n]
            short = n <= SHORT
            flat = []
            for some, pairs in ((short, len(POSITIONS)), (~short, GROUPED)):
                key = index_keys(got[some, :words], pairs)
                each = (*(x[some][:, None, None] for x in cols), *(np.roll(got[some], -k, 1)[:, :words, None].view(np.int64) for k in (0, 1)), key)
                flat.append([np.broadcast_to(x, key.shape).reshape(-1) for x in each])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*flat)], ["fp", "root", "n", "a", "b", "key"])

        return f

    return map_slices(classes.select("fp", "root", "n", "words"), make, "fp long, root long, n int, a long, b long, key long")


def _index(classes: DataFrame, words: int, hot_list: int) -> DataFrame:
    """The entries; those that meet are in one partition."""
    many = classes.count()
    parts = max(parts_for(classes.sparkSession), -(-many * words * GROUPED // PART_ENTRIES))
    index = _entries(classes, words)
    # No key has more entries than there are classes.
    if many > hot_list:
        # Nearly every key has few entries, so to count them all would shuffle as many rows as there are entries.
        # Digests are spread evenly: one class in so many tells the lengths of long lists.
        every = max(1, hot_list // SAMPLE)
        some = _entries(classes.filter(F.pmod("fp", F.lit(every)) == 0), words)
        hot = some.groupBy("key").agg((F.count(F.lit(1)) * every).alias("many")).filter(F.col("many") > hot_list)
        blocks = F.ceil(F.col("many") / hot_list).cast("int")
        # A long list is cut into blocks; a class goes to the cells of its block with each block, itself included.
        own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        cells = F.when(
            F.col("many").isNotNull(),
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, own) * F.col("blocks") + F.greatest(o, own)),
        ).otherwise(F.array(F.lit(0)))
        index = index.join(F.broadcast(hot), "key", "left").withColumn("blocks", blocks).withColumn("cell", F.explode(cells))
        index = index.select("fp", "root", "n", "a", "b", F.when(F.col("many").isNull(), F.col("key")).otherwise(F.xxhash64("key", "cell")).alias("key"))
    return index.repartition(parts, "key")


def close(a: np.ndarray, b: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of entries x, y are candidates."""
    ok = np.minimum(n[x], n[y]) >= ALIKE * np.maximum(n[x], n[y]) - 1e-9
    ok[ok] = np.bitwise_count(a[x[ok]] ^ a[y[ok]]).astype(np.int64) + np.bitwise_count(b[x[ok]] ^ b[y[ok]]) <= MAX_BITS
    return ok


def meet(key: np.ndarray, root: np.ndarray, fp: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, next_only: bool) -> np.ndarray:
    """Candidates (u, v), u < v, of equal key and different roots; next_only: of each entry with the next one."""
    order = np.lexsort((fp, n, key) if next_only else (fp, root, key))
    key, root, fp, n, a, b = (x[order] for x in (key, root, fp, n, a, b))
    at = np.arange(len(key))

    def ends(new: np.ndarray) -> np.ndarray:
        starts = np.flatnonzero(np.concatenate(([True], new)))
        stops = np.concatenate((starts[1:], [len(key)]))
        return np.repeat(stops, stops - starts)

    new_key = key[1:] != key[:-1]
    end, other = ends(new_key), at + 1
    if not next_only:
        # Entries of a root are adjacent; an entry is compared with all after them.
        other = ends(new_key | (root[1:] != root[:-1]))
    out = [np.zeros((0, 2), np.int64)]
    while len(at := at[other[at] < end[at]]):
        # Few entries that are left look at many others at once.
        step = 1 if next_only else max(1, min(_PAIRS // len(at), int((end[at] - other[at]).max())))
        for k in range(0, len(at), _PAIRS):
            x = np.repeat(at[k : k + _PAIRS], step)
            y = other[x] + np.tile(np.arange(step), len(x) // step)
            x, y = x[y < end[x]], y[y < end[x]]
            ok = close(a, b, n, x, y)
            x, y = fp[x[ok]], fp[y[ok]]
            out.append(np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0))
        if next_only:
            break
        other[at] += step
    out = np.unique(np.concatenate(out), axis=0)
    return out[out[:, 0] < out[:, 1]]


def candidates(classes: DataFrame, words: int, next_only: bool, hot_list: int = HOT_LIST) -> DataFrame:
    """(u, v): pairs of classes (fp, root, n, words) of different roots that are to be verified."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b.column(k).to_numpy() for k in range(6)] for b in batches]
        if got:
            fp, root, n, a, b, key = (np.concatenate(x) for x in zip(*got))
            # Bits of signed numbers would be those of their absolute values.
            a, b = a.view(np.uint64), b.view(np.uint64)
            pairs = meet(key, np.where(root == 0, fp, root), fp, n, a, b, next_only)
            for at in range(0, len(pairs), 1 << 16):
                u, v = np.ascontiguousarray(pairs[at : at + (1 << 16)].T)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return _index(classes, words, hot_list).mapInArrow(run, "u long, v long")


def _sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(fp, s binary): the sets whose digests are wanted."""

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(x) for x in b.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.array([_digest(s) for s in sets], np.uint64).view(np.int64)), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "s"])

        return f

    sets = map_slices(rows.select("text"), make, "fp long, s binary")
    if wanted.count() <= BROADCAST:
        # Spark alone may shuffle all sets, which are larger than the texts.
        return sets.join(F.broadcast(wanted), "fp", "left_semi").dropDuplicates(["fp"])
    # Copies go before the shuffle, whose partitions the join takes as they are.
    return sets.dropDuplicates(["fp"]).join(wanted, "fp", "left_semi")


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are ALIKE."""
    pairs = materialise(pairs.distinct())
    sets = materialise(_sets(rows, pairs.select(F.explode(F.array("u", "v")).alias("fp")).distinct()))
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("s").alias("b")), "v")

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            sides = ([np.frombuffer(x, np.uint64) for x in b.column(k).to_pylist()] for k in (2, 3))
            return b.select([0, 1]).filter(pa.array([jaccard(x, y) >= ALIKE for x, y in zip(*sides)], pa.bool_()))

        return f

    links = materialise(map_slices(both.select("u", "v", "a", "b"), make, "u long, v long"))
    discard(pairs, sets)
    return links


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long: digest of the shingle set, component_id: the smallest id reachable over links) for each row."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    marked = materialise(_marked(rows))
    classes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least"), F.first("n").alias("n"), F.first("words").alias("words")))
    some = classes.filter("n > 0")
    links = _verified(rows, candidates(some.withColumn("root", F.col("fp")), FIRST_WORDS, True))
    # What is left: pairs under one key in different components.
    root = components(links).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = materialise(some.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    links = links.unionByName(_verified(rows, candidates(rooted, WORDS, False)))
    roots = classes.select("fp", "least").join(components(links).select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left")
    roots = roots.withColumn("root", F.coalesce("root", "fp"))
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    of = roots.join(least, "root").select("fp", "component_id")
    return marked.select("id", "fp").join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose component holds a smaller id; of rows that repeat an id all stay or go. Rows with null id stay."""
    return without_copies(docs, near_copies(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text"), id_col)
