"""Step 4: bipolar argument graphs from relations: nodes, canonical edges, components, repair.

Graphs are per thread; tables carry a column mode: `repair` keeps every component and
links them, `no_repair` keeps the root's component only.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.operators.candidates import length, similarity


def canonical_edges(relations: DataFrame) -> DataFrame:
    """One edge per pair of EDUs, from the earlier to the later: a relation that already ran that way wins, then an attack."""
    r = relations.filter("relation <> 'neutral' and source_idx <> target_idx")
    lo, hi = F.least("source_idx", "target_idx"), F.greatest("source_idx", "target_idx")
    rank = F.struct((F.col("source_idx") < F.col("target_idx")).alias("flow"), (F.col("relation") == "attack").alias("attack"))
    e = r.groupBy("thread_id", lo.alias("source_idx"), hi.alias("target_idx")).agg(F.max(rank)["attack"].alias("attack"))
    return e.select("thread_id", "source_idx", "target_idx", F.when(F.col("attack"), "attack").otherwise("support").alias("relation"), F.lit(False).alias("synthetic"))


def nodes(index: DataFrame, edges: DataFrame) -> DataFrame:
    """EDUs that an edge touches, and the first with the central proposition's text."""
    ends = edges.select("thread_id", F.col("source_idx").alias("global_idx")).unionByName(edges.select("thread_id", F.col("target_idx").alias("global_idx")))
    used = ends.unionByName(central(index)).distinct()
    return index.join(used, ["thread_id", "global_idx"], "left_semi").select("thread_id", "global_idx", F.concat(F.lit("edu_"), F.col("global_idx").cast("string")).alias("id"), "post_id", "parent_id", "speaker_id", "text", "is_central_prop")


def central(index: DataFrame) -> DataFrame:
    return index.filter("is_central_prop").groupBy("thread_id").agg(F.min("global_idx").alias("global_idx"))


def roots(nodes_: DataFrame) -> DataFrame:
    """The first node with the central proposition's text, else the first node."""
    best = F.min(F.struct((~F.col("is_central_prop")).alias("other"), "global_idx"))["global_idx"]
    return nodes_.groupBy("thread_id").agg(best.alias("root_idx"))


def degrees(nodes_: DataFrame, edges: DataFrame, *by: str) -> DataFrame:
    """Adds in_degree and out_degree."""
    on = [*(by or ("thread_id",)), "global_idx"]
    out = edges.groupBy(*on[:-1], F.col("source_idx").alias("global_idx")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_ = edges.groupBy(*on[:-1], F.col("target_idx").alias("global_idx")).agg(F.count(F.lit(1)).alias("in_degree"))
    x = nodes_.join(in_, on, "left").join(out, on, "left")
    zero = F.lit(0).cast("long")
    return x.withColumn("in_degree", F.coalesce("in_degree", zero)).withColumn("out_degree", F.coalesce("out_degree", zero))


def components(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """(thread_id, global_idx, component: its smallest index, size, rank: by size, then by smallest index)."""
    n = nodes_.select("thread_id", F.col("global_idx").alias("a"), F.col("global_idx").alias("b"))
    e = n.unionByName(edges.select("thread_id", F.col("source_idx").alias("a"), F.col("target_idx").alias("b")))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            p, q = root(a), root(b)
            parent[max(p, q)] = min(p, q)
        idx = sorted(parent)
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[0], "global_idx": idx, "component": [root(x) for x in idx]})

    c = e.groupBy("thread_id").applyInPandas(join, "thread_id string, global_idx int, component int")
    c = c.withColumn("size", F.count(F.lit(1)).over(W.partitionBy("thread_id", "component")))
    return c.withColumn("rank", F.dense_rank().over(W.partitionBy("thread_id").orderBy(F.desc("size"), "component")))


def repair(nodes_: DataFrame, comps: DataFrame, dense: bool = False) -> DataFrame:
    """Links each component to those of a lower rank, by its most similar pair with any of them: support unless that similarity is negative.

    nodes_ has a column vec. All lower ranks are connected by then, so every link is found by itself: for term counts
    within each thread, by the nodes that hold a term; for dense vectors by a self-join.
    """
    several = comps.filter("rank > 1").select("thread_id").distinct()
    x = nodes_.join(comps.select("thread_id", "global_idx", "rank"), ["thread_id", "global_idx"]).join(several, "thread_id", "left_semi")
    if not dense:
        x = x.select("thread_id", "global_idx", "rank", F.map_keys("vec").alias("terms"), F.transform(F.map_values("vec"), lambda n: n.cast("double")).alias("counts"))
        return x.groupBy("thread_id").applyInArrow(_linked, "thread_id string, source_idx int, target_idx int, relation string, synthetic boolean")
    x = x.select("thread_id", "global_idx", "rank", "vec", length(F.col("vec"), dense).alias("len"))
    a = x.select("thread_id", F.col("global_idx").alias("a"), F.col("rank").alias("ra"), F.col("vec").alias("va"), F.col("len").alias("la"))
    b = x.select("thread_id", F.col("global_idx").alias("b"), F.col("rank").alias("rb"), F.col("vec").alias("vb"), F.col("len").alias("lb"))
    p = a.join(b, "thread_id").filter("ra > rb").withColumn("sim", similarity(F.col("va"), F.col("vb"), dense, F.col("la"), F.col("lb")))
    best = p.groupBy("thread_id", "ra").agg(F.min(F.struct((-F.col("sim")).alias("less"), "b", "a")).alias("m"))
    src, tgt = F.least("m.a", "m.b"), F.greatest("m.a", "m.b")
    return best.select("thread_id", src.alias("source_idx"), tgt.alias("target_idx"), F.when(F.col("m.less") <= 0, "support").otherwise("attack").alias("relation"), F.lit(True).alias("synthetic"))


def _linked(rows: pa.Table) -> pa.Table:
    """The links of one thread's components; of equally similar pairs the one with the smallest index of a lower rank, then of its own."""
    rows = rows.sort_by("global_idx").combine_chunks()
    idx, rank = rows["global_idx"].to_numpy(), rows["rank"].to_numpy()
    terms, counts = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
    ends = np.concatenate(([0], np.cumsum(np.diff(terms.offsets.to_numpy()))))
    coded = terms.flatten().dictionary_encode()
    term, count = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts.flatten().to_numpy(zero_copy_only=False)
    node = np.repeat(np.arange(len(idx)), np.diff(ends))
    size = np.sqrt(np.bincount(node, count * count, minlength=len(idx)))
    by_term = np.argsort(term, kind="stable")
    holders, held = node[by_term], count[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(coded.dictionary) + 1))
    best: dict[int, tuple[float, int, int]] = {}
    for a in np.flatnonzero(rank > 1).tolist():
        dots = np.zeros(len(idx))
        for t, n in zip(term[ends[a] : ends[a + 1]].tolist(), count[ends[a] : ends[a + 1]].tolist()):
            at = slice(starts[t], starts[t + 1])
            dots[holders[at]] += n * held[at]
        d = size[a] * size
        sim = np.divide(dots, d, out=np.zeros(len(idx)), where=d > 0)
        sim[rank >= rank[a]] = -1
        b = int(sim.argmax())
        link = -float(sim[b]), int(idx[b]), int(idx[a])
        r = int(rank[a])
        best[r] = min(best.get(r, link), link)
    ends_of = [(min(a, b), max(a, b)) for _, b, a in best.values()]
    many = len(ends_of)
    return pa.table({
        "thread_id": pa.array([rows["thread_id"][0].as_py()] * many, pa.string()), "source_idx": pa.array([x for x, _ in ends_of], pa.int32()), "target_idx": pa.array([y for _, y in ends_of], pa.int32()),
        "relation": pa.array(["support"] * many, pa.string()), "synthetic": pa.array([True] * many, pa.bool_()),  # counts are never negative, nor is their similarity
    })


def root_component(nodes_: DataFrame, comps: DataFrame) -> DataFrame:
    """Nodes of the root's component."""
    root = roots(nodes_).join(comps, "thread_id").filter("root_idx = global_idx").select("thread_id", "component")
    keep = comps.join(root, ["thread_id", "component"], "left_semi").select("thread_id", "global_idx")
    return nodes_.join(keep, ["thread_id", "global_idx"], "left_semi")


def large_enough(nodes_: DataFrame, profile: Profile) -> DataFrame:
    """Threads of more than min_units nodes."""
    return nodes_.groupBy("thread_id").agg(F.count(F.lit(1)).alias("units")).filter(F.col("units") > profile.min_units)


def assemble(index: DataFrame, n: DataFrame, e: DataFrame, comps: DataFrame, profile: Profile, dense: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of both modes, from nodes, canonical edges and components before repair; index has a column vec."""
    with_vec = n.join(index.select("thread_id", "global_idx", "vec"), ["thread_id", "global_idx"])
    root = roots(n)
    full = n.withColumn("mode", F.lit("repair"))
    main = root_component(n, comps)
    small = main.join(large_enough(main, profile), "thread_id", "left_semi").withColumn("mode", F.lit("no_repair"))
    all_nodes = full.unionByName(small).join(root, "thread_id").withColumn("is_root", F.col("global_idx") == F.col("root_idx")).drop("root_idx")
    own = e.join(small.select("thread_id", F.col("global_idx").alias("source_idx")), ["thread_id", "source_idx"], "left_semi")
    all_edges = e.unionByName(repair(with_vec, comps, dense)).withColumn("mode", F.lit("repair")).unionByName(own.withColumn("mode", F.lit("no_repair")))
    return degrees(all_nodes, all_edges, "thread_id", "mode"), all_edges


def summary(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts, root and speakers of each graph."""
    on = ["thread_id", "mode"]
    n = nodes_.groupBy(*on).agg(F.count(F.lit(1)).alias("total_nodes"), F.max(F.when(F.col("is_root"), F.col("id"))).alias("root_id"), F.max(F.when(F.col("is_root"), F.col("text"))).alias("root_text"))
    s = nodes_.groupBy(*on, "speaker_id").agg(F.count(F.lit(1)).alias("n")).groupBy(*on).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("speaker_id", "n")))).alias("speaker_breakdown"))
    e = edges.groupBy(*on).agg(F.count(F.lit(1)).alias("total_edges"), *[F.sum((F.col("relation") == r).cast("long")).alias(f"{r}_edges") for r in ("support", "attack")], F.sum(F.col("synthetic").cast("long")).alias("synthetic_edges"))
    counts = ["total_edges", "support_edges", "attack_edges", "synthetic_edges"]
    return n.join(s, on).join(e, on, "left").select(*on, "total_nodes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], "root_id", "root_text", "speaker_breakdown")


def dot(nodes_: DataFrame, edges: DataFrame) -> DataFrame:
    """Each graph in the DOT language."""
    on = ["thread_id", "mode"]
    label = F.regexp_replace(F.concat(F.lit("["), F.coalesce("speaker_id", F.lit("")), F.lit("] "), F.left(F.col("text"), F.lit(35)), F.when(F.length("text") > 35, "…").otherwise("")), '"', "'")
    shape = F.when(F.col("is_root"), "doublecircle").otherwise("ellipse")
    n = nodes_.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("global_idx", F.concat(F.lit('  "'), F.col("id"), F.lit('" [label="'), label, F.lit('", shape='), shape, F.lit("];")).alias("l")))).alias("n"))
    colour = F.when(F.col("relation") == "support", "green4").otherwise("red3")
    line = F.concat(F.lit('  "edu_'), F.col("source_idx").cast("string"), F.lit('" -> "edu_'), F.col("target_idx").cast("string"), F.lit('" [color='), colour, F.when(F.col("synthetic"), ", style=dashed").otherwise(""), F.lit("];"))
    e = edges.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct("source_idx", "target_idx", line.alias("l")))).alias("e"))
    parts = F.concat(F.array(F.lit("digraph bas {")), F.transform("n", lambda x: x["l"]), F.coalesce(F.transform("e", lambda x: x["l"]), F.array().cast("array<string>")), F.array(F.lit("}")))
    return n.join(e, on, "left").select(*on, F.array_join(parts, "\n").alias("dot"))
