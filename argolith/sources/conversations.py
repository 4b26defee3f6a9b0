"""The test table `conversations` as posts and threads.

A thread is a conv_id; each post replies to the one before it; the speaker is the role.
The table has no titles and no labels: the title is the first 8 words of the first
turn, and threads of even number count as persuaded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.functions.text import tokens


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    thread = F.col("conv_id").cast("string")
    pid = F.concat_ws("_", "conv_id", "turn")
    before = F.lag(pid).over(W.partitionBy("conv_id").orderBy("turn"))
    return t.select(thread.alias("thread_id"), F.col("turn").cast("int").alias("turn_pos"), pid.alias("post_id"), F.coalesce(before, F.lit("")).alias("parent_id"), F.col("role").alias("speaker_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("deleted"))


def threads(posts: DataFrame) -> DataFrame:
    first = posts.groupBy("thread_id").agg(F.min(F.struct("turn_pos", "text"))["text"].alias("text"))
    return first.select("thread_id", F.array_join(F.slice(tokens(F.col("text")), 1, 8), " ").alias("title"), (F.col("thread_id").cast("long") % 2 == 0).alias("is_delta"))
