"""Step 3 with a model: batches are asked about twice, disputes and failures a third time, and what is left out again in halves.

All threads take each round together. A round is a table of items, one row for each
target (batch_id, pos, text, before, after, sources); its prompts go to a client, whose
replies are a table again, so that a run that resumes asks nothing twice. Rounds follow
ROUNDS times at most: targets that replies leave out are asked about again in two
halves of their batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.operators import relations
from argolith.providers import Client

ROUNDS = 3
#: The calls of a round: system prompt and temperature.
CALLS = {1: ("relations", 0.1), 2: ("relations", 0.2), 3: ("tiebreak", 0.0)}
WHY = {
    "disagreement": "Two readings of these units disagree. Give your verdict as JSON at once, without explanation.",
    "failed": "No answer so far could be read. Give your verdict as JSON at once, without explanation.",
}
_PAIR = ["batch_id", "target_idx", "source_idx"]


def items(index: DataFrame, pacs: DataFrame, profile: Profile) -> DataFrame:
    """(thread_id, global_idx, batch_id, pos, text, before, after, sources) of every unit; sources in the order of pac_pos."""
    chosen = pacs.groupBy("thread_id", F.col("target_idx").alias("global_idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pac_pos", "source_text"))), lambda s: s["source_text"]).alias("sources"))
    x = relations.batches(relations.context(index, profile.context), profile.batch).join(chosen, ["thread_id", "global_idx"], "left")
    none = F.array().cast("array<string>")
    return x.select("thread_id", "global_idx", F.concat_ws("_", "thread_id", F.col("batch").cast("string")).alias("batch_id"), F.col("batch_pos").alias("pos"), "text", "before", "after", F.coalesce("sources", none).alias("sources"))


def _numbered(lines: Column) -> Column:
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, lambda x, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] "), x)), "\n")).otherwise("  (none)")


def prompts(items_: DataFrame, why: Column | None = None) -> DataFrame:
    """(batch_id, prompt): targets of a batch by place, each with its context and its numbered sources; why: what a third call is told first."""
    text = F.concat(
        F.lit("Target ["), F.col("pos").cast("string"), F.lit("]\n"), F.col("text"), F.lit("\nBefore it:\n"), _numbered(F.col("before")),
        F.lit("\nAfter it:\n"), _numbered(F.col("after")), F.lit("\nSources:\n"), _numbered(F.col("sources")),
    )
    g = items_.withColumn("__p", text).groupBy("batch_id", *(["why"] if why is not None else [])).agg(F.sort_array(F.collect_list(F.struct("pos", "__p"))).alias("ps"))
    body = F.array_join(F.transform("ps", lambda p: p["__p"]), "\n\n---\n\n")
    return g.select("batch_id", (F.concat(why, F.lit("\n\n"), body) if why is not None else body).alias("prompt"))


def _asked(client: Client, p: DataFrame, calls: tuple[int, ...], system: str | None) -> DataFrame:
    """Replies (batch_id, call_no, raw) to prompts."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("call_no"), F.lit(system if system and k < 3 else CALLS[k][0]).alias("system"), F.lit(CALLS[k][1]).alias("temperature")) for k in calls]))
    return client.ask(p.withColumn("c", each).select("batch_id", "c.call_no", "c.system", "c.temperature", "prompt"))


def settle(round_: DataFrame, client: Client, profile: Profile, keep: Callable, system: str | None = None, last: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: ((batch_id, target_idx, source_idx, relation, method) of the targets that are settled, items to ask about again, the audit of disputes).

    method: agreed, single (one reply could be read), third (none of two could), tiebreak, call1 (the tie-break leaves the target out),
    left_out (a target that the first reply leaves out where replies disagree on others: neutral), gave_up (neutral).
    """
    on = ["batch_id", "target_idx"]
    expected = keep(round_.select("batch_id", F.col("pos").alias("target_idx"), F.posexplode("sources").alias("source_idx", "__s")).drop("__s"))
    ask = round_.join(expected.select("batch_id").distinct(), "batch_id", "left_semi")
    replies = keep(_asked(client, prompts(ask), (1, 2), system))
    read = keep(relations.parse(replies, expected, profile))
    ok = relations.readable(replies)
    valid = replies.select("batch_id").distinct().join(ok.groupBy("batch_id").agg(F.bool_or(F.col("call_no") == 1).alias("v1"), F.bool_or(F.col("call_no") == 2).alias("v2")), "batch_id", "left")
    valid = keep(valid.select("batch_id", F.coalesce("v1", F.lit(False)).alias("v1"), F.coalesce("v2", F.lit(False)).alias("v2")))
    one, two = (read.filter(F.col("call_no") == k).select(*_PAIR, F.col("relation").alias(f"r{k}")) for k in (1, 2))
    both = keep(one.join(two, _PAIR, "full"))
    differ = both.filter("r1 <> r2")
    disputed = differ.select(*on).distinct()
    # Third calls: over the disputed targets, numbered anew, or over all of a batch of which nothing could be read.
    again = W.partitionBy("batch_id").orderBy("pos")
    some = ask.withColumn("target_idx", F.col("pos")).join(disputed, on, "left_semi").withColumn("why", F.lit(WHY["disagreement"]))
    failed = valid.filter("not v1 and not v2").select("batch_id")
    all_ = ask.withColumn("target_idx", F.col("pos")).join(failed, "batch_id", "left_semi").withColumn("why", F.lit(WHY["failed"]))
    third = keep(some.unionByName(all_).withColumn("pos", F.row_number().over(again) - 1))
    numbered = third.select("batch_id", "target_idx", F.col("pos").alias("new"))
    third_expected = expected.join(numbered, on).select("batch_id", F.col("new").alias("target_idx"), "source_idx")
    third_replies = keep(_asked(client, prompts(third, F.col("why")), (3,), system))
    r3 = relations.parse(third_replies, third_expected, profile).select("batch_id", F.col("target_idx").alias("new"), "source_idx", F.col("relation").alias("r3"))
    r3 = r3.join(numbered, ["batch_id", "new"]).drop("new")
    any_dispute = disputed.select("batch_id").distinct().withColumn("in_dispute", F.lit(True))
    x = expected.join(both, _PAIR, "left").join(r3, _PAIR, "left").join(valid, "batch_id", "left").join(any_dispute, "batch_id", "left")
    v1, v2, r1, r2, t = F.col("v1"), F.col("v2"), F.col("r1"), F.col("r2"), F.col("r3")
    dispute = v1 & v2 & F.col("in_dispute").isNotNull()
    label = F.when(~v1 & ~v2, t).when(v1 & ~v2, r1).when(v2 & ~v1, r2).when(dispute & r1.isNull(), "neutral").when(dispute & r2.isNotNull() & (r1 != r2), F.coalesce(t, r1)).otherwise(r1)
    how = F.when(~v1 & ~v2, "third").when(~v1 | ~v2, "single").when(dispute & r1.isNull(), "left_out").when(dispute & r2.isNotNull() & (r1 != r2), F.when(t.isNotNull(), "tiebreak").otherwise("call1")).otherwise("agreed")
    x = keep(x.select(*_PAIR, label.alias("relation"), how.alias("method"), "r1", "r2"))
    audit = x.filter(F.col("method").isin("tiebreak", "call1")).select(*_PAIR, "method", F.col("r1").alias("call1"), F.col("r2").alias("call2"), F.col("relation").alias("resolved"))
    # A batch of one target is not asked about again.
    single = round_.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("batch_id", F.lit(True).alias("alone"))
    x = x.join(single, "batch_id", "left")
    open_ = F.col("relation").isNull() & F.col("alone").isNull() & F.lit(not last)
    done = x.filter(~open_).select(*_PAIR, F.coalesce("relation", F.lit("neutral")).alias("relation"), F.when(F.col("relation").isNull(), "gave_up").otherwise(F.col("method")).alias("method"))
    missing = x.filter(open_).select("batch_id", F.col("target_idx").alias("pos")).distinct()
    half = W.partitionBy("batch_id").orderBy("pos")
    n, k = F.count(F.lit(1)).over(W.partitionBy("batch_id")), F.row_number().over(half)
    left = round_.join(missing, ["batch_id", "pos"]).withColumn("__first", k <= F.greatest(F.floor(n / 2), F.lit(1)))
    left = left.withColumn("old_batch", F.col("batch_id")).withColumn("old_pos", F.col("pos")).withColumn("batch_id", F.concat("batch_id", F.when(F.col("__first"), "a").otherwise("b"))).drop("__first")
    return done, left.withColumn("pos", F.row_number().over(W.partitionBy("batch_id").orderBy("pos")) - 1), audit


def label(index: DataFrame, pacs: DataFrame, client: Client, profile: Profile, keep: Callable, system: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pacs with relation and method, the audit of disputes)."""
    round_ = keep(items(index, pacs, profile))
    place = round_.select("batch_id", F.col("pos").alias("target_idx"), "thread_id", "global_idx")
    found, audits = None, None
    for k in range(ROUNDS):
        done, left, audit = settle(round_, client, profile, keep, system, k + 1 == ROUNDS)
        named = done.join(place, ["batch_id", "target_idx"]).select("thread_id", F.col("global_idx").alias("target_idx"), F.col("source_idx").alias("pac_pos"), "relation", "method")
        told = audit.join(place, ["batch_id", "target_idx"]).select("thread_id", F.col("global_idx").alias("target_idx"), F.col("source_idx").alias("pac_pos"), "method", "call1", "call2", "resolved")
        found, audits = (named, told) if found is None else (found.unionByName(named), audits.unionByName(told))
        round_ = keep(left.drop("old_batch", "old_pos"))
        if round_.isEmpty():
            break
        place = round_.select("batch_id", F.col("pos").alias("target_idx"), "thread_id", "global_idx")
    return pacs.join(found, ["thread_id", "target_idx", "pac_pos"], "left").withColumn("relation", F.coalesce("relation", F.lit("neutral"))).withColumn("method", F.coalesce("method", F.lit("gave_up"))), audits


def review(index: DataFrame, labelled: DataFrame, client: Client, profile: Profile, keep: Callable) -> DataFrame:
    """labelled with the central proposition's relations asked about again, under the review's prompt, where all of them are neutral."""
    which = relations.review_candidates(index, labelled).select("thread_id", "target_idx")
    pacs = labelled.join(which, ["thread_id", "target_idx"], "left_semi").drop("relation", "method")
    only = index.join(which.withColumnRenamed("target_idx", "global_idx"), ["thread_id", "global_idx"], "left_semi")
    # Each is a batch of its own, with the context that it has among its neighbours.
    around = relations.context(index, profile.context).join(only.select("thread_id", "global_idx"), ["thread_id", "global_idx"], "left_semi")
    chosen = pacs.groupBy("thread_id", F.col("target_idx").alias("global_idx")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pac_pos", "source_text"))), lambda s: s["source_text"]).alias("sources"))
    round_ = keep(around.join(chosen, ["thread_id", "global_idx"]).select("thread_id", "global_idx", F.concat("thread_id", F.lit("_cp")).alias("batch_id"), F.lit(0).alias("pos"), "text", "before", "after", "sources"))
    done, _, _ = settle(round_, client, profile, keep, "cp_review", True)
    place = round_.select("batch_id", "thread_id", F.col("global_idx").alias("cp"))
    got = done.join(place, "batch_id").select("thread_id", F.col("cp").alias("target_idx"), F.col("source_idx").alias("pac_pos"), "relation")
    got = pacs.select("thread_id", "target_idx", "pac_pos", "source_idx").join(got, ["thread_id", "target_idx", "pac_pos"]).drop("pac_pos")
    return relations.apply_review(labelled, got)
