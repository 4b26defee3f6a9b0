"""Connected components of links between 64-bit keys, by alternating large and small stars.

Each round is two joins and leaves a table in the shared folder. Nothing is gathered
in one task or in the driver: a key with very many links is summed up before the
shuffle, and the join with its sum is one that Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _state(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _with_least(links: DataFrame) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (u, v): every key that has a link but the smallest of its component, with that smallest key."""
    links = materialise(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        old, links = links, materialise(small.select("x.u", "x.v").filter("u <> v").distinct())
        discard(old)
        before, state = state, _state(links)
        if before == state:
            break
    return links
