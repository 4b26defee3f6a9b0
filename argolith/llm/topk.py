"""Exact search for the largest inner products by buckets of length.

Candidates are sorted into buckets of length, which hold about BUCKET vectors each;
vectors of equal length are spread over the buckets that share it. Each query first
takes its products with the SEEDS longest vectors, whose k-th is a threshold to begin
with: for a query q with threshold s, a vector of length l must have a cosine of
s / (|q| l) at least. Taken with the longest vector of a bucket this is the query's
local threshold there. Where it is above 1 the query is not sent to the bucket.

In a bucket, candidates stand in order of length, in blocks, and thresholds rise as
better scores are found. If a block's local threshold is high, the coordinates on
which the query is largest prune it: a vector of that cosine has to lie in a narrow
range on each. If it is low, only length prunes: the block is cut where vectors get
too short. What is left is verified by exact products of integers. The best of all
buckets are merged for each query.

A cell holds one bucket and at most about CELL_QUERIES queries, so that candidates are
copied once for each so many queries that their bucket matters to, and queries once
for each bucket that matters to them.

Vectors that are null, empty or hold null or non-finite components take no part, on
either side, nor do rows without an id. Vectors of different dimension are not
compared. Components are floor(1024 * x); where they are so large that products could
be inexact in doubles, they are formed in integers of any size, without pruning, and a
score beyond a long is not reported. A candidate is any row with another id than the
query's; equal rows each count. Empty tables give an empty result; columns other than
id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, ship, table

SCALE = 1024
#: Vectors of a bucket, and queries that meet one in a cell.
BUCKET, CELL_QUERIES = 32_768, 8_192
#: Vectors that give queries a threshold to begin with.
SEEDS = 1_024
#: Vectors of a block within a bucket.
BLOCK = 1_024
#: From this local threshold on, coordinates prune.
BY_COORDINATE = 0.8
FOCUS = 4
_EXACT = float(1 << 53)


def top(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, kth: np.ndarray | None = None, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of each query's k best candidates of at least its threshold kth, ties to smaller ids. q, c: whole numbers as doubles."""
    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] >= _EXACT:
        return _top_of_any_size(q_ids, q, c_ids, c, k)
    norm_q, norm_c = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    order = np.lexsort((c_ids, -norm_c))
    c, c_ids, norm_c = c[order], c_ids[order], norm_c[order]
    unit_c = c / np.where(norm_c > 0, norm_c, 1)[:, None]
    unit_q = q / np.where(norm_q > 0, norm_q, 1)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1, kind="stable")[:, :FOCUS]
    best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
    kth = np.full(len(q), -np.inf) if kth is None else kth.copy()

    def take(i: int, score, ids) -> None:
        keep = ids != q_ids[i]
        s, d = np.concatenate((best[i][0], score[keep])), np.concatenate((best[i][1], ids[keep]))
        o = np.lexsort((d, -s))[:k]
        best[i] = (s[o], d[o])
        if len(o) == k:
            kth[i] = max(kth[i], s[o[-1]])

    for a in range(0, len(c), block):
        b = min(a + block, len(c))
        local = local_threshold(kth, norm_q, norm_c[a])
        by_length = np.flatnonzero(local < BY_COORDINATE)
        for at in range(0, len(by_length), 256):
            some = by_length[at : at + 256]
            # The block is cut where vectors are too short for every query at hand; rounding is allowed for.
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(kth[some] > 0, kth[some] / np.where(norm_q[some] > 0, norm_q[some], 1) * (1 - 1e-9), -1.0).min()
            end = a + int(np.searchsorted(-norm_c[a:b], -least, "right"))
            scores = q[some] @ c[a:end].T
            for i, row in zip(some.tolist(), scores):
                ok = np.flatnonzero(row >= kth[i])
                if len(ok):
                    take(i, row[ok], c_ids[a:end][ok])
        for i in np.flatnonzero((local >= BY_COORDINATE) & (local <= 1 + 1e-9)).tolist():
            t = min(local[i], 1.0)
            ok = np.arange(a, b)
            for f in focus[i]:
                x = unit_q[i, f]
                slack = np.sqrt(max(1 - t * t, 0) * max(1 - x * x, 0)) + 1e-9
                # The angle to the focus axis differs by at most the angle that t allows.
                low = x * t - slack if x > -t else -1.0
                high = x * t + slack if x < t else 1.0
                y = unit_c[ok, f]
                ok = ok[(y >= low - 1e-9) & (y <= high + 1e-9)]
            if len(ok):
                score = c[ok] @ q[i]
                fine = score >= kth[i]
                take(i, score[fine], c_ids[ok[fine]])
    return np.repeat(q_ids, [len(s) for s, _ in best]), np.concatenate([d for _, d in best] or [np.zeros(0, np.int64)]), np.concatenate([s for s, _ in best] or [np.zeros(0)]).astype(np.int64)


def local_threshold(kth: np.ndarray, norm_q: np.ndarray, longest) -> np.ndarray:
    """The cosine that a vector must have where the longest has a length; without bound where scores of 0 or less are wanted or may be."""
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(kth > 0, kth / (norm_q * longest), -np.inf)
    return np.where(np.isnan(local), -np.inf, local)


def _top_of_any_size(q_ids, q, c_ids, c, k):
    out = []
    whole = [[int(x) for x in row] for row in c.tolist()]
    for i, row in zip(q_ids.tolist(), q.tolist()):
        row = [int(x) for x in row]
        scores = sorted((-sum(x * y for x, y in zip(row, v)), d) for v, d in zip(whole, c_ids.tolist()) if d != i)
        out += [(i, d, -s) for s, d in scores if -(1 << 63) <= -s < 1 << 63][:k]
    return tuple(np.array(x, np.int64) for x in (zip(*out) if out else ((), (), ())))


_VECTORS = "id long, vec array<double>, dim int, norm double"


def _whole(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec, dim, norm) of the vectors that take part, as whole numbers."""
    x = F.col(f"`{vec_col}`")
    good = (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = df.filter(F.col(f"`{id_col}`").isNotNull()).filter(F.coalesce(good, F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("id"), x.cast("array<double>").alias("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column(1)
            flat, ends = np.floor(SCALE * v.flatten().to_numpy(zero_copy_only=False)), v.offsets.to_numpy() - v.offsets[0].as_py()
            norm = np.sqrt(np.add.reduceat(flat * flat, ends[:-1])) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(np.diff(ends).astype(np.int32)), pa.array(norm)], ["id", "vec", "dim", "norm"])

    return rows.mapInArrow(run, _VECTORS)


def _matrix(v: pa.ListArray, dim: int) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _seeded(queries: DataFrame, seeds: list, k: int) -> DataFrame:
    """Adds kth: the k-th best score among the seeds of the query's dimension, or null."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in seeds}:
        own = [r for r in seeds if r["dim"] == dim]
        by_dim[dim] = np.array([r["id"] for r in own], np.int64), np.array([r["vec"] for r in own])
    shared = queries.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, kth = b.column(0).to_numpy(), b.column(2).to_numpy(), np.full(b.num_rows, -np.inf)
            for dim, (seed_ids, c) in shared.value.items():
                at = np.flatnonzero(dims == dim)
                for lo in range(0, len(at), 1024):
                    some = at[lo : lo + 1024]
                    q = _matrix(b.column(1).take(pa.array(some)), dim)
                    if float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dim >= _EXACT:
                        continue
                    scores = np.where(seed_ids[None, :] != ids[some][:, None], q @ c.T, -np.inf)
                    if scores.shape[1] >= k:
                        kth[some] = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(kth)], [*b.schema.names, "kth"])

    return queries.mapInArrow(run, f"{_VECTORS}, kth double")


def search(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", bucket: int = BUCKET, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best candidates."""
    spark = ship(queries.sparkSession)
    c = materialise(_whole(candidates, id_col, vec_col))
    n = c.count()
    # Bounds of length between buckets, longest first: as many as there are buckets.
    several = -(-n // bucket) or 1
    cuts = np.array(sorted(c.approxQuantile("norm", [i / several for i in range(1, several)], 0.1 / several), reverse=True) if several > 1 else [], float)
    q = materialise(_seeded(_whole(queries, id_col, vec_col), c.orderBy(F.desc("norm"), "id").limit(SEEDS).collect(), k))
    n_q = q.count()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, norm = b.column(0).to_numpy(), b.column(3).to_numpy()
            # Lengths that are cuts themselves belong to all buckets between; these share their vectors.
            lo, hi = np.searchsorted(-cuts, -norm, "left"), np.searchsorted(-cuts, -norm, "right")
            mixed = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = lo + (mixed % (hi - lo + 1).astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], [*b.schema.names, "bucket"])

    c = materialise(c.mapInArrow(dealt, f"{_VECTORS}, bucket int"))
    longest = {(r["dim"], r["bucket"]): r["longest"] for r in c.groupBy("dim", "bucket").agg(F.max("norm").alias("longest")).collect()}  # a number for each bucket
    shared = spark.sparkContext.broadcast({d: (np.array([x for e, x in sorted(longest) if e == d], np.int32), np.array([longest[d, x] for e, x in sorted(longest) if e == d])) for d in {d for d, _ in longest}})
    blocks = -(-n_q // cell_queries) or 1

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int32), np.zeros(0)
        for b in batches:
            to = []
            for dim, norm, kth in zip(b.column(2).to_pylist(), b.column(3).to_numpy(), b.column(4).to_numpy()):
                which, far = shared.value.get(dim, none)
                to.append(which[(kth <= 0) | (norm * far * (1 + 1e-9) >= kth)])
            mixed = (b.column(0).to_numpy().view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.int32())), pa.array((mixed % np.uint64(blocks)).astype(np.int32))], [*b.schema.names, "buckets", "qb"])

    q = materialise(q.mapInArrow(sent, f"{_VECTORS}, kth double, buckets array<int>, qb int").withColumn("bucket", F.explode("buckets")).drop("buckets", "norm"))
    meet = q.select(*[F.col(x).alias(f"q_{x}") for x in ("dim", "bucket", "qb")]).distinct()
    c = c.join(meet, (c["dim"] == meet["q_dim"]) & (c["bucket"] == meet["q_bucket"])).select("id", "vec", "dim", "bucket", F.col("q_qb").alias("qb"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            got = [np.zeros(0, np.int64)] * 3
        else:
            dim = left["dim"][0].as_py()
            (a, x), (b, y) = ((t["id"].to_numpy(), _matrix(t["vec"].combine_chunks(), dim)) for t in (left, right))
            got = top(a, x, b, y, k, left["kth"].to_numpy())
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, got))))

    on = ("dim", "bucket", "qb")
    best = q.groupBy(*on).cogroup(c.groupBy(*on)).applyInArrow(cell, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors.filter("vec_id % 100 = 0"), vectors)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.c, v.c)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.c) = len(v.c)
  WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""
