"""Step 5: initial strengths of nodes: uniform (s1), structural (s2), content (s3), hybrid (s4).

Everything is per graph (thread_id, mode). Strengths are rounded to 6 places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.functions.text import entropy
from argolith.operators.candidates import length, similarity

ON = ["thread_id", "mode"]


def _graph():
    return W.partitionBy(*ON)


def close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def normalise(c: str) -> Column:
    """To 0..1 within each graph; 1 where all are alike."""
    lo, hi = F.min(c).over(_graph()), F.max(c).over(_graph())
    return F.when(close(lo, hi), 1.0).otherwise((F.col(c) - lo) / (hi - lo))


def uniform(nodes: DataFrame) -> DataFrame:
    return nodes.select(*ON, "global_idx", F.lit(1.0).alias("s1"))


def _links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (as a = b) and edges of each graph in one table."""
    n = nodes.select(*ON, F.col("global_idx").alias("a"), F.col("global_idx").alias("b"))
    return n.unionByName(edges.select(*ON, F.col("source_idx").alias("a"), F.col("target_idx").alias("b")))


def pagerank_of(n: int, src: np.ndarray, tgt: np.ndarray, alpha: float, rounds: int = 100, tol: float = 1e-6) -> np.ndarray | None:
    """Power iteration with uniform start and teleport; what dangling nodes hold is spread over all. None if it does not settle."""
    out = np.bincount(src, minlength=n).astype(float)
    x = np.full(n, 1 / n)
    for _ in range(rounds):
        share = np.divide(x, out, out=np.zeros(n), where=out > 0)
        new = alpha * (np.bincount(tgt, share[src], minlength=n) + x[out == 0].sum() / n) + (1 - alpha) / n
        if np.abs(new - x).sum() < n * tol:
            return new
        x = new
    return None


def _ranked(pdf: pd.DataFrame, alpha: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(indices, sources, targets, PageRanks) of one graph of links."""
    idx = np.unique(pdf["a"].to_numpy())
    e = pdf[pdf["a"] != pdf["b"]]
    src, tgt = np.searchsorted(idx, e["a"]), np.searchsorted(idx, e["b"])
    rank = pagerank_of(len(idx), src, tgt, alpha)
    if rank is None:  # by degrees, then
        rank = (np.bincount(src, minlength=len(idx)) + np.bincount(tgt, minlength=len(idx))) / max(len(idx) - 1, 1)
    return idx, src, tgt, rank


def pagerank(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    alpha = profile.damping

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        idx, _, _, rank = _ranked(pdf, alpha)
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[0], "mode": pdf["mode"].iloc[0], "global_idx": idx, "pagerank": rank})

    return _links(nodes, edges).groupBy(*ON).applyInPandas(run, "thread_id string, mode string, global_idx int, pagerank double")


def ancestors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(global_idx, ancestor, depth): nodes from which a node can be reached, and in how many steps at least."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        into: dict[int, list[int]] = {}
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            into.setdefault(b, [])
            if a != b:
                into[b].append(a)
        out = []
        for x in into:
            seen, layer, depth = {x}, [x], 0
            while layer:
                depth += 1
                layer = sorted({p for y in layer for p in into.get(y, ())} - seen)
                seen.update(layer)
                out += [(x, p, depth) for p in layer]
        cols = list(zip(*out)) or [[], [], []]
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[0], "mode": pdf["mode"].iloc[0], "global_idx": cols[0], "ancestor": cols[1], "depth": cols[2]})

    return _links(nodes, edges).groupBy(*ON).applyInPandas(run, "thread_id string, mode string, global_idx int, ancestor int, depth int")


def root_of(nodes: DataFrame) -> DataFrame:
    return nodes.filter("is_root").select(*ON, F.col("global_idx").alias("root_idx"), F.col("speaker_id").alias("root_speaker"), F.col("text").alias("root_text"))


def structural(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """s2: PageRanks of a node's ancestors, more for the root's speaker and for near ones; the root gets 1.

    Ancestors are walked within a graph and summed up at once; the closure is never a table.
    """
    alpha, op_bonus, depth_bonus = profile.damping, profile.op_bonus, profile.depth_bonus
    who = nodes.join(root_of(nodes).select(*ON, "root_speaker"), ON)
    own = F.when(F.col("speaker_id") == F.col("root_speaker"), 1 + op_bonus).otherwise(1.0)
    n = who.select(*ON, F.col("global_idx").alias("a"), F.col("global_idx").alias("b"), own.alias("own"))
    links = n.unionByName(edges.select(*ON, F.col("source_idx").alias("a"), F.col("target_idx").alias("b"), F.lit(0.0).alias("own")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        idx, src, tgt, rank = _ranked(pdf, alpha)
        order = pdf[pdf["a"] == pdf["b"]].sort_values("a")
        weight = rank * order["own"].to_numpy()
        into: list[list[int]] = [[] for _ in idx]
        for x, y in zip(src.tolist(), tgt.tolist()):
            into[y].append(x)
        raw = np.zeros(len(idx))
        for x in range(len(idx)):
            seen, layer, depth = {x}, [x], 0
            while layer:
                depth += 1
                layer = sorted({p for y in layer for p in into[y]} - seen)
                seen.update(layer)
                raw[x] += weight[layer].sum() * (1 + depth_bonus / depth)
        return pd.DataFrame({"thread_id": pdf["thread_id"].iloc[0], "mode": pdf["mode"].iloc[0], "global_idx": idx, "raw": raw})

    raw = links.groupBy(*ON).applyInPandas(run, "thread_id string, mode string, global_idx int, raw double")
    y = nodes.select(*ON, "global_idx", "is_root").join(raw, [*ON, "global_idx"])
    return y.withColumn("s2", F.round(F.when(F.col("is_root"), 1.0).otherwise(normalise("raw")), 6)).select(*ON, "global_idx", "s2")


def explicitness(nodes: DataFrame) -> DataFrame:
    """Adds entropy of the words and explicitness: 1 less its share of the graph's largest entropy."""
    n = nodes.withColumn("entropy", entropy(F.col("text")))
    top = F.max("entropy").over(_graph())
    return n.withColumn("explicitness", F.when(top <= 0, 1.0).otherwise(1 - F.col("entropy") / top))


def expansion(explicit: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """For nodes that are not explicit: the most explicit node, explicit itself, among those that support it (depth 1), else those it supports (2), else those attacked by what it attacks (3)."""
    s = edges.filter("relation = 'support'").select(*ON, "source_idx", "target_idx")
    a = edges.filter("relation = 'attack'").select(*ON, "source_idx", "target_idx")
    one = s.select(*ON, F.col("target_idx").alias("global_idx"), F.col("source_idx").alias("other"), F.lit(1).alias("depth"))
    two = s.select(*ON, F.col("source_idx").alias("global_idx"), F.col("target_idx").alias("other"), F.lit(2).alias("depth"))
    hop = a.select(*ON, F.col("source_idx").alias("mid"), F.col("target_idx").alias("other"))
    three = a.select(*ON, F.col("source_idx").alias("global_idx"), F.col("target_idx").alias("mid")).join(hop, [*ON, "mid"]).select(*ON, "global_idx", "other", F.lit(3).alias("depth"))
    x = one.unionByName(two).unionByName(three).filter("global_idx <> other")
    e = explicit.select(*ON, "global_idx", "explicitness")
    weak = e.filter(F.col("explicitness") < profile.explicit_at).select(*ON, "global_idx")
    good = e.filter(F.col("explicitness") >= profile.explicit_at).select(*ON, F.col("global_idx").alias("other"), F.col("explicitness").alias("other_explicitness"))
    x = x.join(weak, [*ON, "global_idx"]).join(good, [*ON, "other"])
    best = x.groupBy(*ON, "global_idx").agg(F.min(F.struct("depth", (-F.round("other_explicitness", 9)).alias("less"), "other")).alias("b"))
    return best.select(*ON, "global_idx", F.col("b.other").alias("other"), F.col("b.depth").alias("depth"))


def contextual(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """Adds cvec: the unit vector of a node, moved towards its expansion's where it is not explicit. nodes has a column vec (term counts)."""

    def unit(c: Column) -> Column:
        size = F.sqrt(F.aggregate(F.map_values(c), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
        return F.transform_values(c, lambda _, v: F.when(size > 0, v.cast("double") / size).otherwise(0.0))

    n = explicitness(nodes).withColumn("u", unit(F.col("vec")))
    x = expansion(n, edges, profile)
    other = n.select(*ON, F.col("global_idx").alias("other"), F.col("u").alias("ou"))
    y = n.join(x.join(other, [*ON, "other"]), [*ON, "global_idx"], "left")
    part = F.pow(F.lit(profile.context_decay), F.col("depth"))
    moved = F.map_zip_with("u", "ou", lambda _, a, b: F.coalesce(a, F.lit(0.0)) + part * F.coalesce(b, F.lit(0.0)))
    return y.withColumn("cvec", F.when(F.col("ou").isNull(), F.col("u")).otherwise(unit(moved))).drop("u", "ou", "other", "depth")


def _product(x: Column, y: Column) -> Column:
    return F.aggregate(F.array_sort(F.array_intersect(F.map_keys(x), F.map_keys(y))), F.lit(0.0), lambda s, w: s + x[w] * y[w])


def content(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """s3: similarity to the nodes it points to (best and mean) and to the root's text; the root gets 1. nodes has a column vec."""
    c = contextual(nodes, edges, profile)
    a = c.select(*ON, F.col("global_idx").alias("source_idx"), F.col("cvec").alias("va"))
    b = c.select(*ON, F.col("global_idx").alias("target_idx"), F.col("cvec").alias("vb"))
    pairs = edges.join(a, [*ON, "source_idx"]).join(b, [*ON, "target_idx"]).withColumn("sim", _product(F.col("va"), F.col("vb")))  # of unit vectors
    g = profile.local_mean
    local = pairs.groupBy(*ON, F.col("source_idx").alias("global_idx")).agg(((1 - g) * F.max("sim") + g * F.avg("sim")).alias("local"))
    n = nodes.withColumn("len", length(F.col("vec"), False))
    root = n.filter("is_root").select(*ON, F.col("vec").alias("root_vec"), F.col("len").alias("root_len"))
    x = n.join(root, ON).withColumn("topic", similarity(F.col("vec"), F.col("root_vec"), False, F.col("len"), F.col("root_len"))).join(local, [*ON, "global_idx"], "left")
    w = profile.local_share
    x = x.withColumn("raw", w * F.coalesce("local", F.lit(0.0)) + (1 - w) * F.col("topic"))
    return x.withColumn("s3", F.round(F.when(F.col("is_root"), 1.0).otherwise(normalise("raw")), 6)).select(*ON, "global_idx", "s3")


def hybrid(s2: DataFrame, s3: DataFrame, profile: Profile, additive: bool = False) -> DataFrame:
    """s4: s3 amplified by s2, or their sum; the root as any other node."""
    x = s2.join(s3, [*ON, "global_idx"])
    raw = F.col("s3") + F.col("s2") if additive else F.col("s3") * (1 + profile.amplify * F.col("s2"))
    return x.withColumn("raw", raw).withColumn("s4", F.round(normalise("raw"), 6)).select(*ON, "global_idx", "s4")


def reverse_root(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those that leave a root turned around, where none enters it."""
    turn = nodes.filter("is_root and in_degree = 0 and out_degree > 0").select(*ON, F.col("global_idx").alias("root_idx"))
    x = edges.join(turn, ON, "left")
    flip = F.coalesce(F.col("source_idx") == F.col("root_idx"), F.lit(False))
    src, tgt = F.when(flip, F.col("target_idx")).otherwise(F.col("source_idx")), F.when(flip, F.col("source_idx")).otherwise(F.col("target_idx"))
    return x.select(*ON, src.alias("source_idx"), tgt.alias("target_idx"), "relation", "synthetic")


def initialise(nodes: DataFrame, edges: DataFrame, profile: Profile) -> DataFrame:
    """(thread_id, mode, global_idx, strategy, initial_strength) of all four strategies."""
    s2, s3 = structural(nodes, edges, profile), content(nodes, edges, profile)
    x = uniform(nodes).join(s2, [*ON, "global_idx"]).join(s3, [*ON, "global_idx"]).join(hybrid(s2, s3, profile), [*ON, "global_idx"])
    return x.unpivot([*ON, "global_idx"], ["s1", "s2", "s3", "s4"], "strategy", "initial_strength")
