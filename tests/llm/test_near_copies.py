"""The near-copy stage against plain versions of its fingerprints, its index and its links."""

import itertools
import random

import corpus_pipeline
import numpy as np
import pytest

from argolith.llm import shingle_dedup as near


def test_fingerprints_are_majorities_and_positions_cover():
    r = np.random.default_rng(3)
    for n in (1, 4, 255, 256, 700):
        s = np.sort(r.integers(0, 1 << 64, n, np.uint64))
        h = (s[:, None] ^ near._MIX[0]) * near._MIX[1]
        h = (h ^ (h >> np.uint64(32))) * near._MIX[2]
        h ^= h >> np.uint64(29)
        want = [sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in col) > n) for col in h.T.tolist()]
        assert near.fingerprints(s).tolist() == want
    assert len(set(near.POSITIONS)) == 28
    assert all(any(set(t) <= set(q) for t in near.POSITIONS[: near.GROUPED]) for q in itertools.combinations(range(8), 3))


@pytest.mark.parametrize("hot_list", [near.HOT_LIST, 8])
def test_candidates_are_all_close_sets_that_share_a_key(spark, hot_list):
    r = np.random.default_rng(5)
    base = [r.integers(0, 1 << 64, n, np.uint64) for n in (5, 40, 300)]
    sets = [np.unique(np.concatenate((b[k % 3 :], r.integers(0, 1 << 64, k % 4, np.uint64)))) for b in base for k in range(12)]
    rows = [(k + 1, k // 3 * 3 + 1, len(s), near.fingerprints(s)) for k, s in enumerate(sets)]
    df = spark.createDataFrame([(f, root, n, bytearray(w.tobytes())) for f, root, n, w in rows], "fp long, root long, n int, words binary")
    want = set()
    for (f, p, n, w), (g, q, m, x) in itertools.combinations(rows, 2):
        pairs = len(near.POSITIONS) if max(n, m) <= near.SHORT else near.GROUPED
        apart = np.bitwise_count(w ^ x).astype(int)
        met = (near.index_keys(w[None], pairs) == near.index_keys(x[None], pairs))[0].any(1)
        if p != q and min(n, m) >= near.ALIKE * max(n, m) and (met & (apart + np.roll(apart, -1) <= near.MAX_BITS)).any():
            want.add((f, g))
    assert len(want) > 20 and {tuple(x) for x in near.candidates(df, near.WORDS, False, hot_list).collect()} == want


def test_stage_links_short_and_long_sets_just_alike(spark):
    """Pairs that are exactly 0.8 alike, of 4 and 5 shingles and of 16 and 20."""
    r = random.Random(6)
    rows = []
    for g in range(60):
        words = [f"w{r.randrange(100_000)}" for _ in range(9 if g % 2 else 24)]
        rows += [(2 * g, " ".join(words[: 8 if g % 2 else 20])), (2 * g + 1, " ".join(words))]
    got = {x.doc_id for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert got == {2 * g for g in range(60)}


def _shuffled(spark, make):
    """The rows that stages write to shuffles while make() runs."""
    jvm = spark.sparkContext._gateway.jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)

    def rows():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, none, None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in map(stages.apply, range(stages.size()))}

    before = rows()
    make()
    return sum(n for k, n in rows().items() if k not in before)


def _classes(spark, sets):
    rows = [(near._digest(s) - (1 << 63), len(s), bytearray(near.fingerprints(s).tobytes())) for s in sets]
    return spark.createDataFrame([(f, f, n, w) for f, n, w in rows], "fp long, root long, n int, words binary")


def test_long_lists_are_told_without_a_shuffle_of_all_entries(spark):
    r = np.random.default_rng(8)
    df = _classes(spark, [np.unique(r.integers(0, 1 << 64, 20, np.uint64)) for _ in range(3000)])
    entries = 3000 * 2 * near.GROUPED
    assert entries <= _shuffled(spark, lambda: near.candidates(df, 2, True, 2000).collect()) < 1.3 * entries


def test_estimated_lists_let_the_same_pairs_meet(spark, monkeypatch):
    """Lists of 60 to 120 against limits of 10 and 40, of which one class in 5 and in 20 tells."""
    r = np.random.default_rng(9)
    base = [np.unique(r.integers(0, 1 << 64, n, np.uint64)) for n in (60, 200)]
    sets = [np.delete(b, r.choice(len(b), 1 + k % 4, False)) for b in base for k in range(60)]
    df = _classes(spark, sets)
    want = {tuple(x) for x in near.candidates(df, near.WORDS, False).collect()}
    monkeypatch.setattr(near, "SAMPLE", 2)
    assert len(want) > 1000
    for hot_list in (10, 40):
        assert {tuple(x) for x in near.candidates(df, near.WORDS, False, hot_list).collect()} == want


@pytest.mark.parametrize("most", [near.BROADCAST, 0])
def test_sets_nobody_asked_for_and_copies_are_not_shuffled(spark, monkeypatch, most):
    """Not even where Spark would join by shuffles. Beyond the limit sets are, but of copies in a task one."""
    monkeypatch.setattr(near, "BROADCAST", most)
    texts = [" ".join(f"w{j}x{k}" for j in range(9)) for k in range(5)]
    rows = spark.createDataFrame([(t,) for t in texts * 200], "text string").coalesce(4)
    digests = np.array([near._digest(near.shingles(t)) for t in texts[:2]], np.uint64).view(np.int64).tolist()
    wanted = spark.createDataFrame([(d,) for d in digests], "fp long").coalesce(1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = []
        moved = _shuffled(spark, lambda: got.extend(near._sets(rows, wanted).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {x.fp: bytes(x.s) for x in got} == {d: near.shingles(t).tobytes() for d, t in zip(digests, texts)} and len(got) == 2
    assert moved <= 4 * 5 + 10
