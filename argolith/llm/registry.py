"""The queries of this subpackage, and SQL with the same rows where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, exact_dedup, langid, line_dedup, packing, pii, quality, simhash, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_bpe": bpe.query,
    "op3_topk": topk.query,
    "op4_pii": pii.query,
    "op5_exact_dedup": exact_dedup.query,
    "op6_langid": langid.query,
    "op7_quality": quality.query,
    "op8_packing": packing.query,
    "op9_toxicity": toxicity.query,
    "op10_simhash": simhash.query,
    "pipeline": corpus_pipeline.run,
}

SQL = {
    "op3_topk": topk.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
}
