"""What has to hold where tables are large: work that grows no faster than they do, and the same rows."""

from dataclasses import replace

import numpy as np
import pytest

from argolith.config import ENGLISH
from argolith.operators import candidates
from argolith.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block", [7, 8192])
def test_dense_cells_choose_what_the_table_of_pairs_does(spark, block):
    r = np.random.default_rng(3)
    v = r.normal(size=(90, 6))
    v[10:40] = v[10]
    v[40:44] = 2 * v[10]
    v[50] = 0
    v[51, 2] = np.nan
    posts = [("a", ""), ("b", "a"), ("c", "a"), ("d", "d"), (None, "")]
    rows = [(f"t{i % 2}", i, *posts[i % 7 if i % 7 < 4 else i % 2], i % 23 == 5, v[i].tolist() if i % 31 else None) for i in range(90)]
    rows += [("t0", 90, *posts[4], False, [1.0] * 6), ("t0", 91, *posts[0], False, [1.0, None]), ("t0", 92, *posts[0], False, [1.0, 2.0]), ("t0", 93, *posts[1], False, [1.0, 2.5])]
    idx = spark.createDataFrame(rows, "thread_id string, global_idx int, post_id string, parent_id string, is_central_prop boolean, vec array<double>")
    for k, threshold in ((3, 0.15), (5, 0.01)):
        profile = replace(ENGLISH, k=k, threshold=threshold)
        cols = ("thread_id", "target_idx", "source_idx", "pac_scope", "sim", "pac_pos")
        want, got = (sorted(map(repr, candidates.top_semantic(p, profile).select(*cols).collect())) for p in (candidates.candidates(idx, dense=True), candidates.nearest(idx, profile, block)))
        assert got == want and any("INTER" in x for x in want) and any("nan" in x for x in want)


def test_dense_topk_makes_no_row_of_each_pair(spark):
    plan = QUERIES["dense_cosine_topk"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with(" not in plan and "CoGroupsInArrow" in plan


def test_a_transcript_of_many_turns(spark, tmp_path):
    from time import monotonic

    from argolith.sources import transcripts

    heads = ("ANNA D'ARCO (FDI). ", "MARIO ROSSI, Ministro dell'interno. ", "PRESIDENTE. ", "UGO RE' (PD). ")
    rows = [(f"x{k}", "(Misure)\n" + "\n".join(heads[i % 4] + f"Parole del turno {i}. " + "parola " * 60 for i in range(n))) for k, n in enumerate((8, 600))]
    records = spark.createDataFrame(rows, "id string, full_interro_text string").selectExpr("*", *[f"cast(null as string) as {c}" for c in ("type", "legislature", "branch", "presenter", "date_presented", "date_modified", "seduta", "pol_topic", "block")])
    began = monotonic()
    got = {r.conv_id: [p.text[:60] for p in r.conversation] for r in transcripts.convert(records).collect()}
    assert got["x0"] == got["x1"] and len(got["x0"]) == 3 and "turno 3." in got["x0"][2]
    assert monotonic() - began < 40


def test_links_of_components_by_terms(spark):
    from time import monotonic

    from pyspark.sql import functions as F

    from argolith.operators import graph

    r = np.random.default_rng(5)
    counts = r.integers(0, 3, (80, 6)) * (r.random((80, 6)) < 0.3)
    rank = [1 + int(x) for x in np.minimum(r.integers(0, 12, 80), 9)]
    cols = "thread_id string, global_idx int"
    comps = spark.createDataFrame([(f"t{i % 2}", i, rank[i]) for i in range(80)], f"{cols}, rank int")
    dense = spark.createDataFrame([(f"t{i % 2}", i, counts[i].tolist()) for i in range(80)], f"{cols}, vec array<int>")
    sparse = spark.createDataFrame([(f"t{i % 2}", i, {f"w{k}": int(n) for k, n in enumerate(counts[i]) if n}) for i in range(80)], f"{cols}, vec map<string,int>")
    want, got = (sorted(map(tuple, graph.repair(n, comps, d).collect())) for n, d in ((dense, True), (sparse, False)))
    assert got == want and len(got) >= 12
    n = 20_000
    many = spark.range(n).select(F.lit("t").alias("thread_id"), F.col("id").cast("int").alias("global_idx"), F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct(F.concat(k.cast("string"), F.lit("_"), (F.hash("id", k) % 300).cast("string")), F.lit(1)))).alias("vec"))
    began = monotonic()
    assert len(graph.repair(many, many.select("thread_id", "global_idx", (F.col("global_idx") + 1).alias("rank"))).collect()) == n - 1
    assert monotonic() - began < 25
