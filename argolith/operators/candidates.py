"""Step 2: candidate pairs of EDUs, scoped by the reply tree and ranked by similarity.

A target's sources come from its own post (INTRA) or from direct replies to it that
come later (INTER). Both scopes are equi-joins, so no pair outside them is ever formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, GroupedData
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.functions.text import term_counts
from argolith.functions.vectors import dot, norm, sparse_dot
from argolith.session import ship

#: Vectors of a side of a cell, and numbers in them where vectors are long.
BLOCK, BLOCK_NUMBERS = 8_192, 1 << 22
#: Numbers of a matrix of products.
_PRODUCTS = 1 << 21
#: How far products of unit vectors may be off.
_OFF = 1e-9


def _target():
    return W.partitionBy("thread_id", "target_idx")


def reply_children(posts: DataFrame) -> DataFrame:
    """(thread_id, parent_id, post_id) of direct replies."""
    return posts.filter("parent_id <> '' and post_id <> ''").select("thread_id", "parent_id", "post_id").distinct()


def lexical(edus: DataFrame, text: str = "text") -> DataFrame:
    """Adds vec: how often each word occurs. An encoder without a model."""
    return edus.withColumn("vec", term_counts(F.col(text)))


def length(vec: Column, dense: bool) -> Column:
    return norm(vec) if dense else F.sqrt(F.aggregate(F.map_values(vec), F.lit(0.0), lambda s, n: s + n.cast("double") * n.cast("double")))


def similarity(a: Column, b: Column, dense: bool, len_a: Column | None = None, len_b: Column | None = None) -> Column:
    """Cosine, 0 where either is empty; lengths may be given, so that they are taken once for each vector."""
    d = (length(a, dense) if len_a is None else len_a) * (length(b, dense) if len_b is None else len_b)
    product = dot(a, b) if dense else sparse_dot(a, b)
    return F.when(d > 0, product / d).otherwise(0.0)


def candidates(index: DataFrame, dense: bool = False) -> DataFrame:
    """(thread_id, target_idx, source_idx, pac_scope, sim): scored pairs of index (thread_id, global_idx, post_id, parent_id, is_central_prop, vec); texts come after the choice."""
    x = index.withColumn("len", length(F.col("vec"), dense))
    t = x.select("thread_id", F.col("global_idx").alias("target_idx"), F.col("post_id").alias("target_post"), F.col("vec").alias("target_vec"), F.col("len").alias("target_len"))
    s = x.filter(~F.col("is_central_prop")).select(
        "thread_id", F.col("global_idx").alias("source_idx"), F.col("post_id").alias("source_post"), F.col("parent_id").alias("source_parent"), F.col("vec").alias("source_vec"), F.col("len").alias("source_len"),
    )
    same = (t["thread_id"] == s["thread_id"]) & (t["target_post"] == s["source_post"])
    intra = t.join(s, same & (t["target_idx"] != s["source_idx"])).drop(s["thread_id"]).withColumn("pac_scope", F.lit("INTRA"))
    reply = (t["thread_id"] == s["thread_id"]) & (t["target_post"] == s["source_parent"]) & (s["source_post"] != s["source_parent"])
    inter = t.join(s, reply & (s["source_idx"] > t["target_idx"])).drop(s["thread_id"]).withColumn("pac_scope", F.lit("INTER"))
    sim = similarity(F.col("target_vec"), F.col("source_vec"), dense, F.col("target_len"), F.col("source_len"))
    return intra.unionByName(inter).select("thread_id", "target_idx", "source_idx", "pac_scope", sim.alias("sim"))


def nearest(index: DataFrame, profile: Profile, block: int = BLOCK) -> DataFrame:
    """The pairs of `candidates` with dense vectors that `top_semantic` can choose from, without a table of all pairs.

    Vectors of a post meet in cells of block times block at most, whose products are matrices; a cell returns the k
    best sources of each of its targets. The threshold is above 0, so that vectors that are null, zero or hold a null take no part.
    """
    if profile.threshold <= 0:
        raise ValueError("the threshold must be above 0")
    ship(index.sparkSession)
    x = index.filter(F.coalesce(F.forall("vec", lambda v: v.isNotNull()), F.lit(False)))
    x = x.select("thread_id", F.col("global_idx").alias("idx"), F.col("post_id").alias("post"), F.col("parent_id").alias("parent"), "is_central_prop", F.col("vec").cast("array<double>").alias("vec"))
    key = ["thread_id", "post", "pac_scope"]
    t = x.select("thread_id", "post", F.explode(F.array(F.lit("INTRA"), F.lit("INTER"))).alias("pac_scope"), "idx", "vec")
    s = x.filter(~F.col("is_central_prop"))
    inter = s.filter("post <> parent").select("thread_id", F.col("parent").alias("post"), F.lit("INTER").alias("pac_scope"), "idx", "vec")
    s = s.select("thread_id", "post", F.lit("INTRA").alias("pac_scope"), "idx", "vec").unionByName(inter)
    many = lambda df, n: df.groupBy(*key).agg(F.count(F.lit(1)).alias(n), F.max(F.size("vec")).alias(f"{n}_dim"))
    rows = F.greatest(F.least(F.lit(block), F.floor(F.lit(BLOCK_NUMBERS) / F.greatest("nt_dim", "ns_dim", F.lit(1)))), F.lit(1))
    cells = many(t, "nt").join(many(s, "ns"), key).select(*key, F.ceil(F.col("nt") / rows).cast("int").alias("nt"), F.ceil(F.col("ns") / rows).cast("int").alias("ns"))

    on = [*key, "t", "s"]

    def dealt(df: DataFrame, own: str, other: str) -> GroupedData:
        at = F.pmod(F.xxhash64("idx"), F.col(f"n{own}")).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(f"n{other}") - 1))
        x = df.join(cells, key).select(*key, at.alias(own), copies.alias(other), "idx", "vec")
        return x.select(*[F.col(c).alias(f"{own}_{c}") for c in (*on, "idx", "vec")]).groupBy(*[f"{own}_{c}" for c in on])

    k, threshold = profile.k, profile.threshold

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            scope, others = left["t_pac_scope"][0].as_py(), dict(_by_size(right, "s_"))
            for dim, (ids, vectors) in _by_size(left, "t_"):
                if dim in others:
                    got += _best(ids, vectors, *others[dim], k, threshold, scope == "INTER")
        targets, sources, sims = map(np.concatenate, zip(*got))
        names = {n: pa.array([left[f"t_{n}"][0].as_py()] * len(targets), pa.string()) if len(targets) else pa.array([], pa.string()) for n in ("thread_id", "pac_scope")}
        return pa.table({"thread_id": names["thread_id"], "target_idx": pa.array(targets, pa.int64()), "source_idx": pa.array(sources, pa.int64()), "pac_scope": names["pac_scope"], "sim": pa.array(sims, pa.float64())})

    best = dealt(t, "t", "s").cogroup(dealt(s, "s", "t")).applyInArrow(cell, "thread_id string, target_idx long, source_idx long, pac_scope string, sim double")
    kind = index.schema["global_idx"].dataType
    return best.withColumns({n: F.col(n).cast(kind) for n in ("target_idx", "source_idx")})


def _by_size(rows: pa.Table, side: str) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """(size, (ids, matrix)) of the vectors of each size."""
    ids, vec = rows[f"{side}idx"].to_numpy().astype(np.int64), rows[f"{side}vec"].combine_chunks()
    sizes = np.diff(vec.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        yield dim, (ids[at], vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim))


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, added up in the order of places, so that equal vectors have equal sums wherever they stand."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _best(target_ids: np.ndarray, t: np.ndarray, source_ids: np.ndarray, s: np.ndarray, k: int, threshold: float, later: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(target, source, similarity) of each target's k best sources at the threshold or above, ties to smaller ids; later: only those of larger ids.

    Equal sources count as one until the best are known. Matrix products tell which can be among the best, sums in a fixed order decide.
    """
    s = np.ascontiguousarray(s)
    rows = s.view(np.dtype((np.void, s.itemsize * s.shape[1])))[:, 0] if s.shape[1] else np.zeros(len(s))
    _, at, kind = np.unique(rows, return_index=True, return_inverse=True)
    u = s[at]
    order = np.lexsort((source_ids, kind))
    member, of = source_ids[order], kind[order]
    start, end = np.searchsorted(of, np.arange(len(u)), "left"), np.searchsorted(of, np.arange(len(u)), "right")
    alone = {int(member[a]): c for c, (a, b) in enumerate(zip(start.tolist(), end.tolist())) if b - a == 1}
    with np.errstate(all="ignore"):
        size_t, size_u = np.sqrt(_summed(t, t)), np.sqrt(_summed(u, u))
        unit_t, unit_u = (v / np.where(n == 0, 1, n)[:, None] for v, n in ((t, size_t), (u, size_u)))
        step = max(_PRODUCTS // len(u), 1)
        for a in range(0, len(t), step):
            ids = target_ids[a : a + step]
            m = unit_t[a : a + step] @ unit_u.T
            m[np.isnan(m)] = np.inf
            if later:
                m[member[end - 1][None, :] <= ids[:, None]] = -np.inf
            else:
                own = [(i, alone[x]) for i, x in enumerate(ids.tolist()) if x in alone]
                if own:
                    m[tuple(np.array(own).T)] = -np.inf
            kth = np.partition(m, len(u) - k, axis=1)[:, len(u) - k] if len(u) > k else np.full(len(ids), -np.inf)
            i, c = np.nonzero(m >= (np.maximum(kth, threshold) - _OFF)[:, None])
            d = size_t[a + i] * size_u[c]
            sim = np.where((d > 0) | np.isnan(d), _summed(t[a + i], u[c]) / d, 0.0)
            ok = (sim >= threshold) | np.isnan(sim)
            i, c, sim = i[ok], c[ok], sim[ok]
            first = start[c]
            if later:
                for n, (x, y) in enumerate(zip(c.tolist(), ids[i].tolist())):
                    first[n] += np.searchsorted(member[start[x] : end[x]], y, "right")
            n = np.minimum(end[c] - first, k + 1)
            i, sim, first = np.repeat(i, n), np.repeat(sim, n), np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            found = member[first]
            ok = found != ids[i]
            i, sim, found = i[ok], sim[ok], found[ok]
            order = np.lexsort((found, -np.where(np.isnan(sim), np.inf, sim), i))
            i, sim, found = i[order], sim[order], found[order]
            ok = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
            yield ids[i[ok]], found[ok], sim[ok]


def best_similarity(index: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Each target's best similarity (0 without a candidate), and whether it is implicit: below the threshold."""
    best = pairs.groupBy("thread_id", "target_idx").agg(F.max("sim").alias("best"))
    t = index.select("thread_id", F.col("global_idx").alias("target_idx"))
    out = t.join(best, ["thread_id", "target_idx"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    return out.withColumn("implicit", F.col("best") < threshold)


def with_best(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("best", F.max("sim").over(_target()))


def implicit(pairs: DataFrame, profile: Profile) -> DataFrame:
    """For implicit targets: the last implicit_window sources before them in their post, and as many after as are left over."""
    w = profile.implicit_window
    p = with_best(pairs).filter((F.col("best") < profile.threshold) & (F.col("pac_scope") == "INTRA"))
    before = F.col("source_idx") < F.col("target_idx")
    p = p.withColumn("__before", before).withColumn("__n_before", F.sum(before.cast("int")).over(_target()))
    side = W.partitionBy("thread_id", "target_idx", "__before")
    p = p.withColumn("__back", F.row_number().over(side.orderBy(F.desc("source_idx")))).withColumn("__on", F.row_number().over(side.orderBy("source_idx")))
    p = p.filter(F.when(F.col("__before"), F.col("__back") <= w).otherwise(F.col("__on") <= F.greatest(w - F.col("__n_before"), F.lit(0))))
    pos = F.row_number().over(_target().orderBy("source_idx")) - 1
    return p.withColumn("pac_pos", pos).withColumn("selection_type", F.lit("IMPLICIT")).drop("__before", "__n_before", "__back", "__on", "best")


def top_semantic(pairs: DataFrame, profile: Profile) -> DataFrame:
    """For other targets: the k most similar sources of each scope at the threshold or above, INTRA first."""
    p = pairs.filter(F.col("sim") >= profile.threshold)
    w = W.partitionBy("thread_id", "target_idx", "pac_scope").orderBy(F.desc("sim"), "source_idx")
    p = p.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= profile.k)
    pos = F.row_number().over(_target().orderBy(F.desc("pac_scope"), "__k")) - 1
    return p.withColumn("pac_pos", pos).withColumn("selection_type", F.lit("SEMANTIC")).drop("__k")


def select(pairs: DataFrame, index: DataFrame, profile: Profile) -> DataFrame:
    """All chosen pairs, in order (pac_pos), similarities rounded, with what the index says of the source."""
    both = implicit(pairs, profile).unionByName(top_semantic(pairs, profile)).withColumn("cosine_sim", F.round("sim", 4)).drop("sim")
    source = index.select(
        "thread_id", F.col("global_idx").alias("source_idx"), F.col("post_id").alias("source_post_id"), F.col("speaker_id").alias("source_speaker_id"),
        F.col("local_idx").alias("source_local_idx"), F.col("text").alias("source_text"),
    )
    return both.join(source, ["thread_id", "source_idx"])


def summary(index: DataFrame, pacs: DataFrame) -> DataFrame:
    """Totals, mean, least and most pairs of a target, by thread."""
    n = pacs.groupBy("thread_id", F.col("target_idx").alias("global_idx")).agg(F.count(F.lit(1)).alias("n"))
    e = index.select("thread_id", "global_idx").join(n, ["thread_id", "global_idx"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return e.groupBy("thread_id").agg(F.count(F.lit(1)).alias("total_edus"), F.sum("n").alias("total_pacs"), F.round(F.sum("n") / F.count(F.lit(1)), 2).alias("avg_pacs"), F.min("n").alias("min_pacs"), F.max("n").alias("max_pacs"))


def percentiles(pacs: DataFrame, at=(0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Similarities at the lower nearest rank, by scope; with the share of implicit ones. Values are counted, not gathered."""
    c = pacs.groupBy("pac_scope", "cosine_sim").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("selection_type") == "IMPLICIT").cast("long")).alias("imp"))
    # One row for each of at most 20,001 rounded similarities.
    c = c.withColumn("upto", F.sum("n").over(W.partitionBy("pac_scope").orderBy("cosine_sim")))
    total = c.groupBy("pac_scope").agg(F.sum("n").alias("total"), F.sum("imp").alias("imp_total"))
    x = c.join(F.broadcast(total), "pac_scope")
    ranks = [F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("total") - 1)), F.col("cosine_sim"))).alias(f"p{round(q * 100)}") for q in at]
    return x.groupBy("pac_scope").agg(F.first("total").alias("n"), F.round(F.first("imp_total") / F.first("total"), 4).alias("implicit_share"), *ranks)
