"""Queries of the engine look at all rows, not at the first of them."""

import numpy as np

from argolith.queries import QUERIES
from argolith.queries.spark import made

SF = "/root/testdata/sf0.001"


def test_dense_topk_looks_at_all_vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    assert rows[-1].vec_id >= 300
    v = np.array([r.embedding for r in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sims, want = v @ v.T, set()
    for i, a in enumerate(rows):
        others = [j for j, b in enumerate(rows) if b.label == a.label and j != i and sims[i, j] >= 0.15]
        want |= {(a.vec_id, rows[j].vec_id) for j in sorted(others, key=lambda j: (-sims[i, j], j))[:3]}
    assert {(r.target_idx, r.source_idx) for r in QUERIES["dense_cosine_topk"](spark, SF).collect()} == want


def test_every_chosen_pair_is_voted_on(spark):
    pairs = {(f"{r.thread_id}_{r.target_idx // 10}", r.target_idx, r.pac_pos) for r in made(spark, SF).pacs.select("thread_id", "target_idx", "pac_pos").collect()}
    assert max(t for _, t, _ in pairs) >= 20
    for name in ("majority_vote", "self_consistency_merge"):
        got = [(r.batch_id, r.target_idx, r.source_idx) for r in QUERIES[name](spark, SF).collect()]
        assert set(got) == pairs and len(got) == len(pairs)
    for name in ("parse_relations", "disputed_pairs", "tiebreak_audit"):
        got = {(r.batch_id, r.target_idx, r.source_idx) for r in QUERIES[name](spark, SF).collect()}
        assert got <= pairs and any(t >= 20 for _, t, _ in got)
