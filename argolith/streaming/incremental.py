"""Conversation files that arrive in a folder, each thread processed once.

A conversation is one line and complete, so neither windows nor watermarks are needed:
a micro-batch goes through the same transformations as a whole table. What was done
is remembered by the checkpoint (files) and by the result (threads), so a run that
stops resumes where it was.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from argolith.session import exists
from argolith.sources import jsonl


def run(spark: SparkSession, source: str, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], available_now: bool = True) -> StreamingQuery:
    """Applies transform to new conversations of the folder source and appends its rows (with thread_id) to sink as Parquet."""
    records = spark.readStream.schema(jsonl.CONVERSATION).json(source).filter(F.col("thread_id").isNotNull())

    def batch(df: DataFrame, batch_id: int) -> None:
        fresh = df.dropDuplicates(["thread_id"])
        if exists(spark, f"{sink}/_SUCCESS"):
            done = spark.read.parquet(sink).filter(F.col("batch_id") != batch_id)
            fresh = fresh.join(done.select("thread_id").distinct(), "thread_id", "left_anti")
        # A batch that runs again replaces its own partition.
        out = transform(fresh).withColumn("batch_id", F.lit(batch_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(sink)

    w = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
