"""Steps from JSON lines to JSON lines: conversations that a step has not done yet are done and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argolith.config import ENGLISH, Profile
from argolith.plans import records
from argolith.plans.pipeline import Run
from argolith.session import exists
from argolith.sources import jsonl

#: What each step writes, from a run over conversations.
STEPS = {"edus": records.with_edus, "pairs": records.with_pairs, "relations": records.with_relations, "graphs": records.graphs, "settled": records.settled}


def pending(spark: SparkSession, conversations: DataFrame, target: str, ids: DataFrame | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Conversations that target does not hold: those between two lines if given, without those listed in ids."""
    x = conversations.filter(F.col("thread_id").isNotNull())
    if first is not None or last is not None:
        x = jsonl.line_range(x, first or 1, last or (1 << 62), "thread_id").drop("line")
    if ids is not None:
        x = jsonl.without(x, ids)
    if exists(spark, target):
        done = spark.read.json(target, schema="thread_id string").withColumn("done", F.lit(1))
        x = jsonl.unfinished(x, done, "done")
    return x


def run(spark: SparkSession, step: str, source: str, target: str, profile: Profile = ENGLISH, **options) -> int:
    """Does one step for conversations of the JSON lines in source that target does not hold, and appends its records; how many there are. options: of Run."""
    todo = options.pop("keep_source", lambda df: df)(pending(spark, jsonl.read(spark, source), target))
    r = Run(jsonl.posts(todo), jsonl.threads(todo), profile, **options)
    out = r.keep(STEPS[step](r))
    jsonl.write(out, target, "append")
    return out.count()


def evaluate(r: Run, thresholds: list[float], target: str, metrics: str) -> None:
    """The last step: predictions with the sentinel as JSON lines, metrics as JSON."""
    jsonl.write(records.predictions(r.shifts, r.threads, thresholds), target)
    records.metrics_json(r.shifts, r.threads, thresholds).coalesce(1).write.mode("overwrite").text(metrics)
