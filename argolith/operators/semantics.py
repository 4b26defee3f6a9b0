"""Step 6: influence spreads over a graph until strengths settle."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile

ON = ["thread_id", "mode"]


def weights(edges: DataFrame, profile: Profile, normalised: bool = True, boost: bool = False) -> DataFrame:
    """Adds weight: 1, less for synthetic edges; of a target's edges of one kind the weights add up to 1. Boosting attacks has an effect only without that."""
    w = F.when(F.col("synthetic"), profile.synthetic_weight).otherwise(1.0)
    if boost:
        w = w * F.when(F.col("relation") == "attack", profile.attack_boost).otherwise(1.0)
    e = edges.withColumn("weight", w)
    if normalised:
        e = e.withColumn("weight", F.col("weight") / F.sum("weight").over(W.partitionBy(*ON, "target_idx", "relation")))
    return e


def step(state: DataFrame, edges: DataFrame, profile: Profile, keys: list[str]) -> DataFrame:
    """One round as joins, for graphs that no task should hold: state (*keys, global_idx, b, s), edges with weights."""
    src = state.select(*keys, F.col("global_idx").alias("source_idx"), F.col("s").alias("src"))
    x = edges.join(src, [*[k for k in keys if k in edges.columns], "source_idx"])
    e = F.exp(F.col("src") / profile.tau_agg)

    def pull(r: str):
        on = F.col("relation") == r
        return F.sum(F.when(on, e * F.col("weight") * F.col("src"))) / F.sum(F.when(on, e))

    agg = x.groupBy(*keys, F.col("target_idx").alias("global_idx")).agg(F.coalesce(pull("support"), F.lit(0.0)).alias("p"), F.coalesce(pull("attack"), F.lit(0.0)).alias("q"))
    y = state.join(agg, [*keys, "global_idx"], "left")
    u = profile.beta * F.col("b") + F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0))
    new = (1 - profile.lam) * F.col("s") + profile.lam / (1 + F.exp(-u / profile.tau))
    return y.select(*keys, "global_idx", "b", new.alias("s"))


def settle(b: np.ndarray, src: np.ndarray, tgt: np.ndarray, attack: np.ndarray, w: np.ndarray, profile: Profile, trajectory: bool = False) -> tuple[np.ndarray, int, bool, float, list[np.ndarray]]:
    """(strengths, rounds, settled, last change, strengths after each round if they are asked for) over a sparse list of edges."""
    s, n, path = b.copy(), len(b), [b.copy()]
    delta, done, t = float("inf"), False, 0
    kinds = [(src[k], tgt[k], w[k]) for k in (~attack, attack)]
    while t < profile.max_iter and not done:
        t += 1
        pull = []
        for a, c, x in kinds:
            e = np.exp(s[a] / profile.tau_agg)
            top, under = np.bincount(c, e * x * s[a], minlength=n), np.bincount(c, e, minlength=n)
            pull.append(np.divide(top, under, out=np.zeros(n), where=under > 0))
        u = (profile.beta * b + pull[0] - pull[1]) / profile.tau
        new = (1 - profile.lam) * s + profile.lam / (1 + np.exp(-u))
        delta = float(np.abs(new - s).max(initial=0.0))
        s, done = new, delta < profile.eps
        if trajectory:
            path.append(s)
    return s, t, done, delta, path


_OUT = "thread_id string, mode string, strategy string, global_idx int, initial_strength double, acceptability double, iterations int, converged boolean, delta_final double, trajectory array<double>"


def propagate(strengths: DataFrame, edges: DataFrame, profile: Profile, trajectory: bool = False) -> DataFrame:
    """Final strengths of each strategy; edges (with weights) are those after the root's reversal."""
    if profile.max_iter < 1:
        raise ValueError("max_iter must be at least 1")
    # A graph's edges come once, whatever the number of strategies.
    n = strengths.select(*ON, "strategy", F.col("global_idx").alias("a"), F.lit(None).cast("int").alias("c"), F.col("initial_strength").alias("x"), F.lit(None).cast("string").alias("relation"))
    e = edges.select(*ON, F.lit(None).cast("string").alias("strategy"), F.col("source_idx").alias("a"), F.col("target_idx").alias("c"), F.col("weight").alias("x"), "relation")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links, out = pdf[pdf["c"].notna()], []
        for strategy, nodes in pdf[pdf["c"].isna()].sort_values("a").groupby("strategy"):
            idx = nodes["a"].to_numpy()
            own = links[links["a"].isin(idx) & links["c"].isin(idx)]
            src, tgt = np.searchsorted(idx, own["a"].to_numpy()), np.searchsorted(idx, own["c"].to_numpy().astype(idx.dtype))
            s, t, done, delta, path = settle(nodes["x"].to_numpy(), src, tgt, (own["relation"] == "attack").to_numpy(), own["x"].to_numpy(), profile, trajectory)
            x = {k: pdf[k].iloc[0] for k in ON} | {"strategy": strategy, "global_idx": idx, "initial_strength": nodes["x"].to_numpy(), "acceptability": np.round(s, 6), "iterations": t, "converged": done, "delta_final": delta}
            x["trajectory"] = list(np.round(np.stack(path, 1), 6)) if trajectory else None
            out.append(pd.DataFrame(x))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in _OUT.split(", ")])

    return n.unionByName(e).groupBy(*ON).applyInPandas(run, _OUT)


def strategies(strengths: DataFrame) -> DataFrame:
    """The strategies that there are strengths of, with how many graphs have them."""
    return strengths.select(*ON, "strategy").distinct().groupBy("strategy").agg(F.count(F.lit(1)).alias("graphs"))


def meta(settled: DataFrame) -> DataFrame:
    return settled.groupBy(*ON, "strategy").agg(F.max("iterations").alias("iterations"), F.bool_and("converged").alias("converged"), F.max("delta_final").alias("delta_final"))


def root_shift(settled: DataFrame, nodes: DataFrame) -> DataFrame:
    """What became of each root: initial, final, and their difference, rounded."""
    root = nodes.filter("is_root").select(*ON, "global_idx", F.col("id").alias("root_id"), F.col("text").alias("root_text"))
    x = settled.join(root, [*ON, "global_idx"])
    delta = F.round(F.col("acceptability") - F.col("initial_strength"), 6)
    return x.select(*ON, "strategy", "root_id", "root_text", F.col("initial_strength").alias("initial"), F.col("acceptability").alias("final"), delta.alias("delta"), F.abs(delta).alias("abs_delta"))
