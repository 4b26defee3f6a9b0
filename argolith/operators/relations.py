"""Step 3: what relation each source has to its target, from a provider's replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.functions.text import strip

REPLY = "struct<batch: array<struct<target_idx: int, relations: array<struct<source_idx: int, relation: string, confidence: string>>>>>"
LABELS = ("support", "attack", "neutral")


def context(index: DataFrame, width: int = 2) -> DataFrame:
    """Up to width EDUs on each side in the same post."""
    w = W.partitionBy("thread_id", "post_id").orderBy("local_idx")
    return index.withColumn("before", F.collect_list("text").over(w.rowsBetween(-width, -1))).withColumn("after", F.collect_list("text").over(w.rowsBetween(1, width)))


def batches(index: DataFrame, size: int = 10) -> DataFrame:
    """Batches of EDUs of a thread, in order, with or without candidates."""
    return index.withColumn("batch", F.floor(F.col("global_idx") / size).cast("int")).withColumn("batch_pos", (F.col("global_idx") % size).cast("int"))


def gate(relation: Column, confidence: Column, profile: Profile) -> Column:
    """Labels that are not sure enough become neutral."""
    weak = (relation == "support") & (confidence <= profile.support_gate) | (relation == "attack") & (confidence <= profile.attack_gate)
    return F.when(weak, "neutral").otherwise(relation)


def _entries() -> Column:
    """The entries of a reply in the column raw; null if it cannot be read."""
    body = strip(F.regexp_replace("raw", r"(?m)^\s*```[a-zA-Z]*\s*$", ""))

    def read(c: Column) -> Column:
        ok = F.try_parse_json(c).isNotNull()
        as_object = F.when(F.ltrim(c).startswith("["), F.concat(F.lit('{"batch":'), c, F.lit("}"))).otherwise(c)
        return F.when(ok, F.from_json(as_object, REPLY)["batch"])

    block = F.regexp_extract(body, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.coalesce(read(body), F.when(block != "", read(block)))


def readable(replies: DataFrame) -> DataFrame:
    """Replies that can be read, whatever targets they name."""
    return replies.filter(_entries().isNotNull())


def parse(replies: DataFrame, expected: DataFrame, profile: Profile, keys: tuple[str, ...] = ("batch_id", "call_no")) -> DataFrame:
    """Labels of expected (batch_id, target_idx, source_idx) in replies (*keys, raw).

    A reply is an object with `batch` or a list, maybe fenced or within other text. An unknown label is
    neutral, a missing confidence 1, one that is no number makes the label neutral; a source the reply leaves out is neutral; of entries for one
    pair the last counts. A target that it leaves out has no row; nor has a reply that cannot be read.
    """
    entries = _entries()
    t = replies.select(*keys, F.posexplode(entries).alias("pos", "t")).filter("t.target_idx is not null")
    t = t.join(expected.select("batch_id", "target_idx").distinct().withColumnRenamed("target_idx", "want"), "batch_id").filter("t.target_idx = want")
    last = W.partitionBy(*keys, "want").orderBy(F.desc("pos"))
    t = t.withColumn("n", F.row_number().over(last)).filter("n = 1").select(*keys, F.col("want").alias("target_idx"), "t.relations")
    r = t.select(*keys, "target_idx", F.posexplode("relations").alias("pos", "r"))
    raw = strip(F.lower("r.relation"))
    known = F.when(raw.isin(*LABELS), raw).otherwise("neutral")
    number = F.expr("try_cast(r.confidence as double)")
    conf = F.when(F.col("r.confidence").isNull(), F.lit(1.0)).otherwise(number)
    label = F.when(conf.isNull(), "neutral").otherwise(gate(known, conf, profile))
    r = r.select(*keys, "target_idx", F.col("r.source_idx").alias("source_idx"), label.alias("relation"), "pos")
    r = r.groupBy(*keys, "target_idx", "source_idx").agg(F.max(F.struct("pos", "relation"))["relation"].alias("relation"))
    grid = t.select(*keys, "target_idx").join(expected, ["batch_id", "target_idx"])
    return grid.join(r, [*keys, "target_idx", "source_idx"], "left").withColumn("relation", F.coalesce("relation", F.lit("neutral")))


def disputed(one: DataFrame, two: DataFrame) -> DataFrame:
    """Pairs that both calls label, differently."""
    on = ["batch_id", "target_idx", "source_idx"]
    return one.withColumnRenamed("relation", "call1").join(two.withColumnRenamed("relation", "call2"), on).filter("call1 <> call2").select(*on, "call1", "call2")


def merge(one: DataFrame, two: DataFrame, tiebreak: DataFrame, expected: DataFrame) -> DataFrame:
    """Self-consistency: what the first readable call says, but for disputed pairs what the tie-break says where it does.

    Returns relation and method for each expected pair: agreed, single, tiebreak, call1 (the tie-break leaves the pair out), third (no call could be read), missing (nobody
    labels the target: neutral).
    """
    on = ["batch_id", "target_idx", "source_idx"]
    a, b, c = (d.select(*on, F.col("relation").alias(n)) for d, n in ((one, "r1"), (two, "r2"), (tiebreak, "r3")))
    have1, have2 = (d.select("batch_id").distinct().withColumn(n, F.lit(True)) for d, n in ((one, "h1"), (two, "h2")))
    x = expected.join(a, on, "left").join(b, on, "left").join(c, on, "left").join(have1, "batch_id", "left").join(have2, "batch_id", "left")
    h1, h2 = F.col("h1").isNotNull(), F.col("h2").isNotNull()
    differ = F.col("r1").isNotNull() & F.col("r2").isNotNull() & (F.col("r1") != F.col("r2"))
    relation = F.when(~h1 & ~h2, F.col("r3")).when(~h1, F.col("r2")).when(differ, F.coalesce("r3", "r1")).otherwise(F.col("r1"))
    method = F.when(relation.isNull(), "missing").when(~h1 & ~h2, "third").when(~h1 | ~h2, "single").when(differ & F.col("r3").isNotNull(), "tiebreak").when(differ, "call1").otherwise("agreed")
    return x.select(*on, F.coalesce(relation, F.lit("neutral")).alias("relation"), method.alias("method"), "r1", "r2", "r3")


def audit(merged: DataFrame) -> DataFrame:
    """How disputed pairs were resolved."""
    return merged.filter(F.col("method").isin("tiebreak", "call1")).select("batch_id", "target_idx", "source_idx", "method", F.col("r1").alias("call1"), F.col("r2").alias("call2"), F.col("relation").alias("resolved"))


def majority(votes: DataFrame) -> DataFrame:
    """(batch_id, target_idx, source_idx, call_no, relation) -> the most frequent relation, the first seen of equals."""
    on = ["batch_id", "target_idx", "source_idx"]
    n = votes.groupBy(*on, "relation").agg(F.count(F.lit(1)).alias("n"), F.min("call_no").alias("first"))
    return n.groupBy(*on).agg(F.max(F.struct("n", (-F.col("first")).alias("less"), "relation")).alias("b")).select(*on, F.col("b.relation").alias("relation"), F.col("b.n").alias("votes"))


def argumentative(relations: DataFrame) -> DataFrame:
    """Targets with their counts of labels, and whether any is not neutral."""
    n = [F.sum((F.col("relation") == r).cast("long")).alias(r) for r in LABELS]
    return relations.groupBy("thread_id", "target_idx").agg(*n).withColumn("target_is_argumentative", F.col("support") + F.col("attack") > 0)


def summary(index: DataFrame, relations: DataFrame) -> DataFrame:
    """Counts of EDUs, argumentative ones, skipped ones (no candidates) and labels, by thread."""
    a = argumentative(relations).withColumnRenamed("target_idx", "global_idx")
    x = index.select("thread_id", "global_idx").join(a, ["thread_id", "global_idx"], "left")
    zero = F.lit(0).cast("long")
    return x.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("total_edus"),
        F.sum(F.coalesce(F.col("target_is_argumentative"), F.lit(False)).cast("long")).alias("argumentative_edus"),
        F.sum(F.col("support").isNull().cast("long")).alias("skipped_edus"),
        *[F.sum(F.coalesce(r, zero)).alias(f"{r}_relations") for r in LABELS],
    )


def review_candidates(index: DataFrame, relations: DataFrame) -> DataFrame:
    """The first EDU with the central proposition's text, where all its labels are neutral."""
    first = index.filter("is_central_prop").groupBy("thread_id").agg(F.min("global_idx").alias("target_idx"))
    a = argumentative(relations).filter("not target_is_argumentative")
    return first.join(a.select("thread_id", "target_idx", "neutral"), ["thread_id", "target_idx"])


def apply_review(relations: DataFrame, review: DataFrame) -> DataFrame:
    """relations with those of review (thread_id, target_idx, source_idx, relation) in place, for targets of which it has any that is not neutral."""
    useful = review.filter("relation <> 'neutral'").select("thread_id", "target_idx").distinct().withColumn("cp_review_applied", F.lit(True))
    r = review.withColumnRenamed("relation", "__new").select("thread_id", "target_idx", "source_idx", "__new")
    x = relations.join(useful, ["thread_id", "target_idx"], "left").join(r, ["thread_id", "target_idx", "source_idx"], "left")
    applied = F.coalesce("cp_review_applied", F.lit(False))
    return x.withColumn("relation", F.when(applied, F.coalesce("__new", "relation")).otherwise(F.col("relation"))).withColumn("cp_review_applied", applied).drop("__new")
