"""Step 1: posts to elementary discourse units (EDUs)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import Profile
from argolith.functions.text import clean_turn, fallback_segments, overlap, strip, word_count
from argolith.providers import Client

SEGMENTS = "struct<edus: array<string>>"


def clean(posts: DataFrame, profile: Profile) -> DataFrame:
    """Posts that are not deleted, with clean text."""
    return posts.filter(~F.coalesce("deleted", F.lit(False))).withColumn("text", clean_turn(F.col("text"), profile))


def batches(turns: DataFrame, max_chars: int) -> DataFrame:
    """Turns in order, greedily into batches of at most max_chars characters; empty turns are left out, longer ones stand alone."""
    state = F.struct(F.array().cast("array<int>").alias("b"), F.lit(0).alias("n"), F.lit(0).alias("c"))

    def step(s, t):
        size = F.length(t["text"])
        new = (s["c"] > 0) & (s["c"] + size > max_chars)
        n = F.when(new, s["n"] + 1).otherwise(s["n"])
        return F.struct(F.array_append(s["b"], n).alias("b"), n.alias("n"), F.when(new, size).otherwise(s["c"] + size).alias("c"))

    g = turns.filter("text <> ''").groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("turn_pos", "post_id", "speaker_id", "text"))).alias("t"))
    g = g.withColumn("b", F.aggregate("t", state, step, lambda s: s["b"]))
    x = g.select("thread_id", F.explode(F.arrays_zip("t", "b")).alias("z"))
    return x.select("thread_id", F.col("z.t.turn_pos").alias("turn_pos"), F.col("z.t.post_id").alias("post_id"), F.col("z.t.speaker_id").alias("speaker_id"), F.col("z.b").alias("batch"), F.col("z.t.text").alias("text"))


def prompts(batched: DataFrame) -> DataFrame:
    """The texts of each batch, joined by blanks."""
    g = batched.groupBy("thread_id", "batch").agg(F.sort_array(F.collect_list(F.struct("turn_pos", "text"))).alias("t"))
    return g.select("thread_id", "batch", F.array_join(F.transform("t", lambda x: x["text"]), " ").alias("prompt"))


def parse_reply(raw: F.Column, text: F.Column, profile: Profile) -> F.Column:
    """EDUs of a model's reply: an object's edus, or a list; else those of the first {...} in it; else the text is split."""
    body = strip(F.regexp_replace(raw, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))

    def strings(json: F.Column) -> F.Column:
        v = F.try_parse_json(json)
        items = F.coalesce(F.try_variant_get(v, "$.edus", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"))
        return F.filter(F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "STRING", strip(F.try_variant_get(x, "$", "string")))), lambda s: s.isNotNull() & (s != ""))

    block = F.regexp_extract(body, r"(?s)\{.*\}", 0)
    return F.coalesce(strings(body), F.when(block != "", strings(block)), fallback_segments(text, profile))


def split_turns(turns: DataFrame, profile: Profile) -> DataFrame:
    """Raw EDUs of each turn, by punctuation and connectives: what the engine does without a model."""
    return turns.select("thread_id", "turn_pos", "post_id", "parent_id", "speaker_id", F.posexplode(fallback_segments(F.col("text"), profile)).alias("pos", "edu"))


def attribute(edus: DataFrame, batched: DataFrame) -> DataFrame:
    """EDUs of a batch (thread_id, batch, pos, edu) to turns: the first that holds the text, else the one that shares most words, else the first."""
    x = edus.join(batched.select("thread_id", "batch", "turn_pos", "post_id", F.col("text").alias("turn_text")), ["thread_id", "batch"])
    held = F.contains(F.lower("turn_text"), F.lower("edu"))
    shared = F.when(held, 0).otherwise(overlap(F.col("edu"), F.col("turn_text")))
    w = W.partitionBy("thread_id", "batch", "pos").orderBy(F.desc(held), F.desc(shared), "turn_pos")
    return x.withColumn("n", F.row_number().over(w)).filter("n = 1").select("thread_id", "batch", "pos", "turn_pos", "post_id", "edu")


def dedup(edus: DataFrame) -> DataFrame:
    """Of EDUs of a turn that differ in case only, the first stays."""
    w = W.partitionBy("thread_id", "turn_pos", F.lower(strip(F.col("edu")))).orderBy("pos")
    return edus.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def filter_short(edus: DataFrame, profile: Profile) -> DataFrame:
    """EDUs that are no deletion marker and have more than min_words words, trimmed."""
    e = edus.withColumn("edu", strip(F.col("edu")))
    return e.filter((F.col("edu") != "") & ~F.col("edu").rlike(profile.deleted_regex) & (word_count(F.col("edu")) > profile.min_words))


def model_turns(turns: DataFrame, profile: Profile, client: Client, keep=lambda df: df) -> DataFrame:
    """Raw EDUs of each turn, as a model cuts batches of turns; a batch without a reply that can be read is split by punctuation."""
    b = keep(batches(turns, profile.batch_chars))
    asked = prompts(b).withColumns({"call_no": F.lit(1), "system": F.lit("segmentation"), "temperature": F.lit(0.1), "batch_id": F.concat_ws("_", "thread_id", F.col("batch").cast("string"))})
    replies = keep(client.ask(asked).select("thread_id", "batch", "raw"))
    cut = prompts(b).join(replies, ["thread_id", "batch"], "left").select("thread_id", "batch", F.posexplode(parse_reply(F.coalesce("raw", F.lit("")), F.col("prompt"), profile)).alias("pos", "edu"))
    placed = attribute(cut, b).withColumn("pos", F.col("batch") * 1_000_000 + F.col("pos")).drop("post_id", "batch")
    return placed.join(turns.select("thread_id", "turn_pos", "post_id", "parent_id", "speaker_id"), ["thread_id", "turn_pos"])


def edus(turns: DataFrame, profile: Profile, client: Client | None = None, keep=lambda df: df) -> DataFrame:
    """EDUs with their place in the turn: cut by a model if there is one, else split; without repeats, without short ones."""
    raw = split_turns(turns, profile) if client is None else model_turns(turns, profile, client, keep)
    e = filter_short(dedup(raw), profile)
    local = F.row_number().over(W.partitionBy("thread_id", "turn_pos").orderBy("pos")) - 1
    return e.select("thread_id", "turn_pos", "post_id", "parent_id", "speaker_id", local.alias("local_idx"), F.col("edu").alias("text"))


def summary(turns: DataFrame, edus_: DataFrame) -> DataFrame:
    """Turns (also those without EDUs) and EDUs of each thread."""
    t = turns.groupBy("thread_id").agg(F.count(F.lit(1)).alias("total_turns"))
    e = edus_.groupBy("thread_id").agg(F.count(F.lit(1)).alias("total_edus"))
    return t.join(e, "thread_id", "left").select("thread_id", "total_turns", F.coalesce("total_edus", F.lit(0).cast("long")).alias("total_edus"))


def central_proposition(turns: DataFrame, edus_: DataFrame, threads: DataFrame) -> DataFrame:
    """The EDU of the opening turn that shares most words with the title, the first of equals; null without EDUs there."""
    first = turns.groupBy("thread_id").agg(F.min("turn_pos").alias("turn_pos"))
    op = edus_.join(first, ["thread_id", "turn_pos"]).join(threads.select("thread_id", "title"), "thread_id")
    best = op.groupBy("thread_id").agg(F.max(F.struct(overlap(F.col("text"), F.col("title")).alias("shared"), (-F.col("local_idx")).alias("less"), "text")).alias("b"))
    return threads.select("thread_id").join(best, "thread_id", "left").select("thread_id", F.col("b.text").alias("central_proposition"), F.when(F.col("b").isNotNull(), "overlap").alias("method"))


def _chosen(raw: F.Column) -> F.Column:
    """The number a reply names; null if it names none."""
    body = strip(F.regexp_replace(raw, "```(?:json)?", ""))
    json = F.try_parse_json(body)
    said = F.coalesce(F.try_variant_get(json, "$.central_proposition_idx", "int"), F.expr("cast(null as int)"))
    text = F.try_variant_get(json, "$.central_proposition_idx", "string")
    whole = F.when(text.rlike("^-?[0-9]{1,9}$"), F.coalesce(said, text.try_cast("int")))
    found = F.regexp_extract(body, r'"central_proposition_idx"\s*:\s*(\d{1,9})', 1)
    return F.when(json.isNotNull(), whole).otherwise(F.when(found != "", found.cast("int")))


def model_central(turns: DataFrame, edus_: DataFrame, threads: DataFrame, client: Client, keep=lambda df: df) -> DataFrame:
    """The EDU of the opening turn that a model names by its number; without a number that fits, the one by overlap."""
    first = turns.groupBy("thread_id").agg(F.min("turn_pos").alias("turn_pos"))
    own = edus_.join(first, ["thread_id", "turn_pos"]).groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("local_idx", "text"))), lambda e: e["text"]).alias("units"))
    x = keep(own.join(threads.select("thread_id", "title"), "thread_id"))
    lines = F.array_join(F.transform("units", lambda u, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), u)), "\n")
    prompt = F.concat(F.lit("Title: "), F.coalesce("title", F.lit("")), F.lit("\n\nUnits of the opening post:\n"), lines, F.lit("\n\nWhich number is the central proposition?"))
    asked = x.select("thread_id", F.concat("thread_id", F.lit("_central")).alias("batch_id"), F.lit(1).alias("call_no"), F.lit("central_proposition").alias("system"), F.lit(0.3).alias("temperature"), prompt.alias("prompt"))
    said = client.ask(asked).select("thread_id", _chosen(F.col("raw")).alias("n"))
    named = x.join(said, "thread_id").select("thread_id", F.when(F.col("n").between(0, F.size("units") - 1), F.get("units", F.col("n"))).alias("named"))
    out = central_proposition(turns, edus_, threads).join(keep(named), "thread_id", "left")
    return out.select("thread_id", F.coalesce("named", "central_proposition").alias("central_proposition"), F.when(F.col("named").isNotNull(), "model").otherwise(F.col("method")).alias("method"))


def index(edus_: DataFrame, central: DataFrame) -> DataFrame:
    """Adds the place in the thread, and whether the text is the central proposition's."""
    w = W.partitionBy("thread_id").orderBy("turn_pos", "local_idx")
    e = edus_.withColumn("global_idx", F.row_number().over(w) - 1).join(central.select("thread_id", "central_proposition"), "thread_id", "left")
    is_cp = F.coalesce(strip(F.col("text")) == strip(F.col("central_proposition")), F.lit(False))
    return e.withColumn("is_central_prop", is_cp).drop("central_proposition")
