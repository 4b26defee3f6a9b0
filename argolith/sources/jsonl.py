"""Conversation records as JSON lines: reading, writing, slicing, sharding and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN = "struct<post_id string, parent_id string, parent_post_id string, speaker_id string, timestamp string, text string, deleted boolean, role string, speaker_name string, affiliation string>"
CONVERSATION = f"thread_id string, conv_id string, id string, title string, is_delta boolean, delta_ts string, turn_count int, sentence_count int, conversation array<{TURN}>, metadata map<string,string>"
SENTINEL = "__eval__"


def read(spark: SparkSession, path: str, schema: str = CONVERSATION) -> DataFrame:
    """Records of a file or folder; blank and malformed lines are left out."""
    raw = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return raw.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def malformed(spark: SparkSession, path: str) -> DataFrame:
    """The lines that hold no JSON object: for the log."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.filter(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{"))


def count_lines(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).filter(F.trim("value") != "").count()


def write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def key() -> F.Column:
    return F.coalesce(F.col("thread_id"), F.col("conv_id"))


def latest_by_thread(df: DataFrame, position: str) -> DataFrame:
    """One row per thread_id, or conv_id where that is null, or row where both are: the last one."""
    k = F.coalesce("thread_id", "conv_id", F.concat(F.lit("row_"), F.col(position).cast("string")))
    w = W.partitionBy("__key").orderBy(F.desc(position))
    return df.withColumn("__key", k).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__key")


def unfinished(records: DataFrame, done: DataFrame, marker: str) -> DataFrame:
    """Records whose thread has no row in done with a marker: what a run that resumes has to do."""
    ids = done.filter(F.col("thread_id").isNotNull() & (F.col("thread_id") != "") & F.col(marker).isNotNull()).select("thread_id").distinct()
    return records.join(ids, "thread_id", "left_anti")


def without(records: DataFrame, ids: DataFrame) -> DataFrame:
    """Records whose thread_id, or id where that is null, is not listed; records without either stay."""
    listed = ids.select(F.col("id").alias("__id")).filter("__id is not null").distinct()
    return records.join(listed, F.coalesce(records["thread_id"], records["id"]) == listed["__id"], "left_anti")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds line: 1, 2, ... in the given order, counted in ranges so that no task holds all rows."""
    spark_parts = F.spark_partition_id()
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", spark_parts)
    ranged = ranged.withColumn("__k", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    # One row per partition.
    offsets = counts.withColumn("__o", F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    return ranged.join(F.broadcast(offsets), "__p").withColumn("line", F.col("__k") + F.col("__o")).drop("__p", "__k", "__o")


def line_range(df: DataFrame, first: int, last: int, *order: str) -> DataFrame:
    """Lines first to last, counted from 1, both included."""
    return numbered(df, *order).filter(F.col("line").between(first, last))


def shards(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Adds shard: line i (from 0) goes to shard i mod n."""
    return numbered(df, *order).withColumn("shard", ((F.col("line") - 1) % n).cast("int")).drop("line")


def sample(spark: SparkSession) -> DataFrame:
    """Two small conversations for trying things out; replies name what they reply to."""
    rows = [
        ("s1", "Trains should be free", [("a", "", "ann", "Trains should be free for all. They reduce traffic in every city, because fewer people drive."), ("b", "a", "bob", "Free trains cost the public money. However they reduce traffic, which is good.")]),
        ("s2", "Homework does not help", [("a", "", "eva", "Homework does not help young pupils. It takes the time that they need for play."), ("b", "a", "max", "Homework teaches pupils to plan their time, so it does help.")]),
    ]
    data = [(t, t, title, [(p, q, q, s, None, x, False, None, None, None) for p, q, s, x in turns]) for t, title, turns in rows]
    return spark.createDataFrame(data, f"thread_id string, conv_id string, title string, conversation array<{TURN}>")


def posts(records: DataFrame) -> DataFrame:
    """The turns of conversation records, one row each; parent_post_id stands in for a missing parent_id."""
    x = records.select("thread_id", F.posexplode("conversation").alias("turn_pos", "t"))
    parent = F.coalesce(F.when(F.col("t.parent_id") != "", F.col("t.parent_id")), F.col("t.parent_post_id"), F.lit(""))
    return x.select("thread_id", "turn_pos", "t.post_id", parent.alias("parent_id"), "t.speaker_id", F.coalesce("t.text", F.lit("")).alias("text"), F.coalesce("t.deleted", F.lit(False)).alias("deleted"))


def threads(records: DataFrame) -> DataFrame:
    return records.select("thread_id", "title", "is_delta")
