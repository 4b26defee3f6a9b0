"""The operators on the test tables.

Conversations run through the whole pipeline with the word-count encoder and the cue
rule. Predictions stand on documents and their labels: a document is a thread, four
figures of it stand for strategies' shifts, its label for the truth.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from argolith.config import ENGLISH
from argolith.functions.text import entropy
from argolith.operators import candidates, graph, predict, reasoning, relations, report, segment, semantics, strengths
from argolith.plans import records
from argolith.plans.pipeline import Run
from argolith.providers import Cue, Recorded, Scripted
from argolith.session import shared_folder
from argolith.sources import conversations, jsonl, pdf, transcripts

#: Word counts are less alike than learned vectors: the threshold is lower than the default. A prompt holds the least there is, so that threads have several.
PROFILE = replace(ENGLISH, threshold=0.20, ctx_window=0)
CUES = ("was", "not", "but", "with")
THRESHOLDS = [0.1, 0.2, 0.3, 0.4]
THRESHOLDS_OF_RECORDS = [0.1, 0.3]
BATCH_CHARS = PROFILE.batch_chars
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    QUERIES[f.__name__] = f
    return f


def made(spark: SparkSession, sf_dir: str) -> Run:
    posts = conversations.posts(spark, sf_dir)
    return Run(posts, conversations.threads(posts), PROFILE, Cue(CUES, 0.25))


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


# Sources and job control.


@query
def jsonl_scan(spark, sf_dir):
    """Conversation records as JSON lines, blank and broken ones among them, read back."""
    posts = conversations.posts(spark, sf_dir)
    turns = posts.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("turn_pos", "post_id", "parent_id", "speaker_id", "text"))).alias("conversation"))
    lines = turns.select(F.to_json(F.struct("thread_id", "conversation")).alias("value"))
    noise = spark.createDataFrame([("",), ("{bad",)], "value string")
    raw = lines.unionByName(noise).select(F.from_json("value", f"{jsonl.CONVERSATION}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value").filter("value <> '' and r._corrupt_record is null")
    return raw.select("r.thread_id", F.size("r.conversation").cast("long").alias("turns"))


def _records(spark, sf_dir) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").cast("string").alias("thread_id"), F.concat(F.lit("d"), "doc_id").alias("id"), "n_chars", "doc_id")


@query
def resume_anti_join(spark, sf_dir):
    done = _records(spark, sf_dir).select("thread_id", F.when(F.col("doc_id") % 3 == 0, F.col("n_chars")).alias("total_edus"))
    return jsonl.unfinished(_records(spark, sf_dir), done, "total_edus").select("thread_id")


@query
def prefilter_anti_join(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("string").alias("id"))
    rows = _records(spark, sf_dir).withColumn("thread_id", F.when(F.col("doc_id") % 5 != 0, F.col("thread_id"))).withColumn("id", F.when(F.col("doc_id") % 7 != 0, F.col("doc_id").cast("string")))
    return jsonl.without(rows, bench).select("doc_id", "thread_id", "id")


@query
def range_slice(spark, sf_dir):
    return _long(jsonl.line_range(_records(spark, sf_dir), 11, 60, "doc_id").select("line", "thread_id"), "line")


@query
def round_robin_shard(spark, sf_dir):
    return _long(jsonl.shards(_records(spark, sf_dir), 2, "doc_id").groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids")), "shard")


@query
def index_by_thread(spark, sf_dir):
    """The last row of each thread, under either of its names, or by itself where both are missing."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    name, at = F.col("conv_id").cast("string"), F.col("conv_id") * 1000 + F.col("turn")
    rows = t.select(F.when(F.col("conv_id") % 3 != 0, name).alias("thread_id"), F.when(F.col("conv_id") % 5 != 0, name).alias("conv_id"), at.alias("line"), "role")
    return jsonl.latest_by_thread(rows, "line")


@query
def load_predictions(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = labels.select(F.col("doc_id").cast("string").alias("thread_id"), (F.col("doc_id") % 10 == 9).alias("__eval__"), F.when(F.col("doc_id") % 4 != 0, F.col("quality") == 1).alias("ground_truth"), (F.col("toxic") == 1).alias("is_delta"))
    return predict.load_predictions(rows)[0].select("thread_id", "ground_truth")


@query
def count_lines(spark, sf_dir):
    """Records written as JSON lines, and counted in the files."""
    path = f"{shared_folder(spark)}/argolith-lines-{uuid.uuid4().hex}"
    jsonl.write(_records(spark, sf_dir), path)
    return spark.createDataFrame([(jsonl.count_lines(spark, path),)], "lines long")


@query
def load_ground_truth(spark, sf_dir):
    """Labels of which every third comes twice, the second time the other way round."""
    l = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("thread_id"), F.col("doc_id").alias("line"), (F.col("quality") == 1).alias("is_delta"))
    again = l.filter("line % 3 = 0").select("thread_id", (F.col("line") + 1_000_000_000).alias("line"), (~F.col("is_delta")).alias("is_delta"))
    return predict.load_truth(l.unionByName(again))


@query
def inject_ground_truth(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("thread_id"), (F.col("quality") == 1).alias("label"))
    rows = _records(spark, sf_dir).select("thread_id", F.when(F.col("doc_id") % 3 == 0, True).alias("ground_truth"))
    return predict.inject(rows, labels).select("thread_id", "ground_truth")


@query
def transcript_turns(spark, sf_dir):
    """Conversations written as question-time transcripts, read back: the posts of those with a question, a response and a counter-reply."""
    t = conversations.posts(spark, sf_dir).withColumn("said", F.regexp_replace(F.lower("text"), r"\. ", ".\n  "))
    who = F.element_at(F.array(*map(F.lit, ("ANNA D'ARCO (M5S-X)", "MARIO ROSSI, Ministro dell’interno", "PRESIDENTE", "UGO DE RÉ (PD)"))), (F.when(F.col("turn_pos") == 0, 0).otherwise(F.col("turn_pos") % 4) + 1).cast("int"))
    g = t.groupBy("thread_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn_pos", F.concat(who, F.lit(". "), F.col("said")).alias("l")))), lambda x: x["l"]).alias("ls"))
    text = F.concat(F.lit("(Misure  sul\nﬁume – n. 3-"), "thread_id", F.lit(")\n"), F.array_join("ls", "\n"))
    blank = {c: F.lit(None).cast("string") for c in ("type", "legislature", "branch", "presenter", "date_presented", "seduta", "block")}
    records = g.select(F.col("thread_id").alias("id"), text.alias("full_interro_text")).withColumns(blank | {"pol_topic": F.lit("topic"), "date_modified": F.lit("2024-01-01")})
    x = transcripts.convert(records).select("thread_id", "title", "turn_count", "sentence_count", F.explode("conversation").alias("p"))
    return _long(x.select("thread_id", "title", "turn_count", "sentence_count", "p.post_id", "p.parent_id", "p.speaker_id", "p.role", "p.speaker_name", "p.affiliation", F.md5("p.text").alias("digest")), "turn_count", "sentence_count")


# Step 1.


@query
def clean_turns(spark, sf_dir):
    return segment.clean(conversations.posts(spark, sf_dir), PROFILE).select("thread_id", "turn_pos", "text")


@query
def clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("thread_id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("deleted"))
    return segment.clean(docs, PROFILE).select("thread_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query
def turn_batches(spark, sf_dir):
    return _long(segment.batches(made(spark, sf_dir).turns, BATCH_CHARS).select("thread_id", "turn_pos", "batch"), "batch")


@query
def batch_prompts(spark, sf_dir):
    return _long(segment.prompts(segment.batches(made(spark, sf_dir).turns, BATCH_CHARS)), "batch")


def _replies(spark, sf_dir) -> DataFrame:
    """Model replies of several shapes, made from the turns."""
    t = made(spark, sf_dir).turns
    whole = F.to_json(F.struct(F.array("text", F.lit(" second unit of it ")).alias("edus")))
    raw = F.when(F.col("turn_pos") % 4 == 0, whole).when(F.col("turn_pos") % 4 == 1, F.concat(F.lit("Here: "), whole, F.lit(" done"))).when(F.col("turn_pos") % 4 == 2, F.to_json(F.array("text"))).otherwise(F.lit("no json"))
    return t.withColumn("raw", raw)


@query
def parse_edu_json(spark, sf_dir):
    x = _replies(spark, sf_dir)
    return x.select("thread_id", "turn_pos", F.posexplode(segment.parse_reply(F.col("raw"), F.col("text"), PROFILE)).alias("pos", "edu"))


@query
def fallback_edus(spark, sf_dir):
    return _long(segment.split_turns(made(spark, sf_dir).turns, PROFILE).select("thread_id", "turn_pos", "pos", "edu"), "pos")


@query
def document_edus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    posts = docs.select(F.col("doc_id").alias("thread_id"), F.lit(0).alias("turn_pos"), F.lit("").alias("post_id"), F.lit("").alias("parent_id"), F.lit("").alias("speaker_id"), F.coalesce("text", F.lit("")).alias("text"))
    e = segment.split_turns(posts, PROFILE)
    return e.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("edu").cast("long")).alias("chars"), F.max("edu").alias("last"))


@query
def edu_attribution(spark, sf_dir):
    b = segment.batches(made(spark, sf_dir).turns, BATCH_CHARS)
    from argolith.functions.text import fallback_segments

    e = segment.prompts(b).select("thread_id", "batch", F.posexplode(fallback_segments(F.col("prompt"), PROFILE)).alias("pos", "edu"))
    return _long(segment.attribute(e, b).select("thread_id", "batch", "pos", "turn_pos"), "batch", "pos")


@query
def edu_dedup(spark, sf_dir):
    e = segment.split_turns(made(spark, sf_dir).turns, PROFILE)
    twice = e.unionByName(e.withColumn("edu", F.translate("edu", "abcdefghij", "ABCDEFGHIJ")).withColumn("pos", F.col("pos") + 1000))
    return _long(segment.dedup(twice).select("thread_id", "turn_pos", "pos", "edu"), "pos")


@query
def edu_filter(spark, sf_dir):
    return _long(segment.filter_short(segment.split_turns(made(spark, sf_dir).turns, PROFILE), replace(PROFILE, min_words=4)).select("thread_id", "turn_pos", "pos", "edu"), "pos")


@query
def edu_summary(spark, sf_dir):
    r = made(spark, sf_dir)
    return segment.summary(r.turns, r.edus)


@query
def central_prop_overlap(spark, sf_dir):
    return made(spark, sf_dir).central


@query
def edu_index(spark, sf_dir):
    return _long(made(spark, sf_dir).index.select("thread_id", "global_idx", "turn_pos", "local_idx", "is_central_prop", "text"), "global_idx", "local_idx")


def _by_model(spark, sf_dir, reply) -> Run:
    posts = conversations.posts(spark, sf_dir)
    return Run(posts, conversations.threads(posts), PROFILE, Cue(CUES, 0.25), Scripted(reply))


@query
def model_edus(spark, sf_dir):
    """EDUs of a model that cuts at full stops and now and then says nothing that can be read."""
    reply = lambda: F.when(F.length("prompt") % 3 == 0, "I cannot").otherwise(F.to_json(F.struct(F.split("prompt", r"\. ").alias("edus"))))
    return _long(_by_model(spark, sf_dir, reply).edus.select("thread_id", "turn_pos", "local_idx", "text"), "local_idx")


@query
def model_central(spark, sf_dir):
    """Central propositions by the number that a model names, which is too large now and then."""
    r, number = made(spark, sf_dir), F.col("thread_id").cast("int") % 5
    said = F.when(number == 3, F.concat(F.lit('```json\n{"central_proposition_idx": "'), number, F.lit('"}\n```'))).otherwise(F.to_json(F.struct((number - F.when(number == 4, 5).otherwise(0)).alias("central_proposition_idx"))))
    return segment.model_central(r.turns, r.edus, r.threads, Scripted(lambda: said), r.keep)


# Step 2.


@query
def reply_children(spark, sf_dir):
    return candidates.reply_children(conversations.posts(spark, sf_dir))


@query
def pac_candidates(spark, sf_dir):
    return _long(made(spark, sf_dir).pairs.select("thread_id", "target_idx", "source_idx", "pac_scope"), "target_idx", "source_idx")


@query
def pairwise_cosine(spark, sf_dir):
    return _long(made(spark, sf_dir).pairs.select("thread_id", "target_idx", "source_idx", F.round("sim", 6).alias("sim")), "target_idx", "source_idx")


@query
def dense_cosine_topk(spark, sf_dir):
    """Dense vectors: a label is a post, its vectors the units; the 3 most similar at 0.15 or above."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    idx = e.select(F.lit("t").alias("thread_id"), F.col("vec_id").cast("int").alias("global_idx"), F.col("label").cast("string").alias("post_id"), F.lit("").alias("parent_id"), F.col("vec_id").cast("int").alias("local_idx"), F.lit("").alias("speaker_id"), F.lit("").alias("text"), F.lit(False).alias("is_central_prop"), F.col("embedding").alias("vec"))
    profile = replace(PROFILE, threshold=0.15, k=3)
    p = candidates.top_semantic(candidates.nearest(idx, profile), profile)
    return _long(p.select("target_idx", "source_idx", F.round("sim", 5).alias("sim"), "pac_pos"), "target_idx", "source_idx", "pac_pos")


@query
def implicit_targets(spark, sf_dir):
    r = made(spark, sf_dir)
    return _long(candidates.best_similarity(r.index, r.pairs, PROFILE.threshold).select("thread_id", "target_idx", F.round("best", 6).alias("best"), "implicit"), "target_idx")


@query
def pac_implicit(spark, sf_dir):
    return _long(candidates.implicit(made(spark, sf_dir).pairs, PROFILE).select("thread_id", "target_idx", "source_idx", "pac_pos"), "target_idx", "source_idx", "pac_pos")


@query
def pac_topk(spark, sf_dir):
    return _long(candidates.top_semantic(made(spark, sf_dir).pairs, PROFILE).select("thread_id", "target_idx", "source_idx", "pac_scope", "pac_pos", F.round("sim", 6).alias("sim")), "target_idx", "source_idx", "pac_pos")


@query
def pac_summary(spark, sf_dir):
    r = made(spark, sf_dir)
    return candidates.summary(r.index, r.pacs)


@query
def pac_sim_percentiles(spark, sf_dir):
    return candidates.percentiles(made(spark, sf_dir).pacs)


# Step 3.


@query
def context_window(spark, sf_dir):
    x = relations.context(made(spark, sf_dir).index)
    return _long(x.select("thread_id", "global_idx", F.array_join("before", " | ").alias("before"), F.array_join("after", " | ").alias("after")), "global_idx")


@query
def edu_batches(spark, sf_dir):
    return _long(relations.batches(made(spark, sf_dir).index).select("thread_id", "global_idx", "batch", "batch_pos"), "global_idx", "batch", "batch_pos")


@query
def prompt_text(spark, sf_dir):
    r = made(spark, sf_dir)
    return reasoning.prompts(reasoning.items(r.index, r.pacs, PROFILE))


def _votes(spark, sf_dir, calls: int = 2) -> tuple[DataFrame, DataFrame]:
    """Expected pairs, and labels of several calls that differ now and then."""
    p = made(spark, sf_dir).pacs
    expected = p.select(F.concat_ws("_", "thread_id", F.floor(F.col("target_idx") / 10).cast("string")).alias("batch_id"), "target_idx", F.col("pac_pos").alias("source_idx"))
    v = expected.withColumn("call_no", F.explode(F.sequence(F.lit(1), F.lit(calls))))
    h = F.col("target_idx") * 7 + F.col("source_idx") * 3 + F.when((F.col("target_idx") + F.col("source_idx")) % 5 == 0, F.col("call_no")).otherwise(0)
    return expected, v.withColumn("relation", F.element_at(F.array(*map(F.lit, relations.LABELS)), (h % 3 + 1).cast("int")))


@query
def confidence_gate(spark, sf_dir):
    p = made(spark, sf_dir).relations
    return _long(p.select("thread_id", "target_idx", "source_idx", relations.gate(F.col("relation"), F.col("cosine_sim"), PROFILE).alias("relation")), "target_idx", "source_idx")


@query
def parse_relations(spark, sf_dir):
    """Replies made from votes: some fenced, some bare lists, some broken, some without a confidence."""
    expected, v = _votes(spark, sf_dir, 1)
    said = v.filter("source_idx <> 3").withColumn("confidence", F.when(F.col("source_idx") % 3 != 2, (F.lit(40) + (F.col("source_idx") % 3) * 10) / 100))
    t = said.groupBy("batch_id", "target_idx").agg(F.sort_array(F.collect_list(F.struct("source_idx", F.upper("relation").alias("relation"), "confidence"))).alias("relations"))
    b = t.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("target_idx", "relations"))).alias("batch"))
    k = F.length("batch_id") % 4
    raw = F.when(k == 0, F.to_json(F.struct("batch"))).when(k == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct("batch")), F.lit("\n```"))).when(k == 2, F.to_json("batch")).otherwise(F.concat(F.lit("So: "), F.to_json(F.struct("batch"))))
    replies = b.select("batch_id", F.lit(1).alias("call_no"), raw.alias("raw"))
    return _long(relations.parse(replies, expected, PROFILE).select("batch_id", "target_idx", "source_idx", "relation"), "target_idx", "source_idx")


@query
def disputed_pairs(spark, sf_dir):
    _, v = _votes(spark, sf_dir)
    one, two = (v.filter(F.col("call_no") == k).drop("call_no") for k in (1, 2))
    return _long(relations.disputed(one, two), "target_idx", "source_idx")


@query
def self_consistency_merge(spark, sf_dir):
    expected, v = _votes(spark, sf_dir, 3)
    # Batches of which a call, or both, could not be read; a tie-break that leaves some targets out.
    k = F.length("batch_id") % 4
    one = v.filter("call_no = 1").filter(k != 1).filter("target_idx % 6 <> 5")
    two = v.filter("call_no = 2").filter(k != 2)
    tie = v.filter("call_no = 3 and target_idx % 4 <> 3")
    m = relations.merge(one.drop("call_no"), two.drop("call_no"), tie.drop("call_no"), expected)
    return _long(m.select("batch_id", "target_idx", "source_idx", "relation", "method"), "target_idx", "source_idx")


@query
def tiebreak_audit(spark, sf_dir):
    expected, v = _votes(spark, sf_dir, 3)
    m = relations.merge(*(v.filter(F.col("call_no") == k).drop("call_no") for k in (1, 2, 3)), expected)
    return _long(relations.audit(m), "target_idx", "source_idx")


@query
def majority_vote(spark, sf_dir):
    return _long(relations.majority(_votes(spark, sf_dir, 3)[1]), "target_idx", "source_idx")


@query
def tiebreak_prompt(spark, sf_dir):
    """What is asked about targets on which two calls differ."""
    r = made(spark, sf_dir)
    one, two = (_votes(spark, sf_dir)[1].filter(F.col("call_no") == k) for k in (1, 2))
    targets = relations.disputed(one, two).select("batch_id", F.col("target_idx").alias("global_idx")).distinct()
    x = reasoning.items(r.index, r.pacs, PROFILE).join(targets, ["batch_id", "global_idx"]).withColumn("why", F.lit(reasoning.WHY["disagreement"]))
    return reasoning.prompts(x.withColumn("pos", F.row_number().over(W.partitionBy("batch_id").orderBy("pos")) - 1), F.col("why"))


def _replies_of_batches(spark, sf_dir) -> DataFrame:
    """What a model said on each batch: calls that leave targets out, cannot be read or differ; third calls that find attacks everywhere, or nothing."""
    _, v = _votes(spark, sf_dir)
    number = F.substring_index("batch_id", "_", -1).cast("int")
    place = (F.col("target_idx") % 10).cast("int")
    said = v.filter((F.col("call_no") == 2) | (place % 6 != 5))
    t = said.groupBy("batch_id", "call_no", place.alias("target_idx")).agg(F.sort_array(F.collect_list(F.struct("source_idx", "relation"))).alias("relations"))
    b = t.groupBy("batch_id", "call_no").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("target_idx", "relations"))).alias("batch"))).alias("raw"))
    bad = (number % 5 == 4) | (F.col("call_no") == 1) & (number % 4 == 1) | (F.col("call_no") == 2) & (number % 4 == 2)
    everywhere = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda p: F.struct(p.alias("target_idx"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda s: F.struct(s.alias("source_idx"), F.lit("attack").alias("relation"))).alias("relations")))
    third = b.select("batch_id").distinct().withColumn("call_no", F.lit(3)).withColumn("raw", F.when(number % 2 == 0, F.to_json(F.struct(everywhere.alias("batch")))))
    return b.withColumn("raw", F.when(bad, "{bad").otherwise(F.col("raw"))).unionByName(third)


@query
def model_relations(spark, sf_dir):
    """The whole of a run's labelling by recorded replies: two calls, third calls, halves."""
    r = made(spark, sf_dir)
    found, _ = reasoning.label(r.index, r.keep(r.pacs), Recorded(r.keep(_replies_of_batches(spark, sf_dir))), PROFILE, r.keep)
    return _long(found.select("thread_id", "target_idx", "source_idx", "relation", "method"), "target_idx", "source_idx")


@query
def cp_review_applied(spark, sf_dir):
    """Neutral central propositions, asked about again: every second thread's first source is found to attack."""
    r = made(spark, sf_dir)
    first = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("target_idx"), F.array(F.struct(F.lit(0).alias("source_idx"), F.lit("attack").alias("relation"))).alias("relations"))).alias("batch")))
    calm = r.keep(r.relations.join(r.index.filter("is_central_prop").select("thread_id", F.col("global_idx").alias("target_idx"), F.lit(True).alias("cp")), ["thread_id", "target_idx"], "left").withColumn("relation", F.when(F.col("cp"), "neutral").otherwise(F.col("relation"))).drop("cp"))
    even = F.substring_index("batch_id", "_", 1).cast("int") % 2 == 0
    out = reasoning.review(r.index, calm, Scripted(lambda: F.when(even & (F.col("call_no") < 3), first)), PROFILE, r.keep)
    return _long(out.select("thread_id", "target_idx", "source_idx", "relation", "cp_review_applied"), "target_idx", "source_idx")


@query
def argumentative_edus(spark, sf_dir):
    return _long(relations.argumentative(made(spark, sf_dir).relations), "target_idx")


@query
def reasoning_summary(spark, sf_dir):
    r = made(spark, sf_dir)
    return relations.summary(r.index, r.relations)


@query
def cp_review_candidates(spark, sf_dir):
    r = made(spark, sf_dir)
    return _long(relations.review_candidates(r.index, r.relations), "target_idx")


# Step 4.


@query
def canonical_edges(spark, sf_dir):
    return _long(graph.canonical_edges(made(spark, sf_dir).relations).select("thread_id", "source_idx", "target_idx", "relation"), "source_idx", "target_idx")


@query
def bas_nodes(spark, sf_dir):
    return _long(made(spark, sf_dir).canonical[0].select("thread_id", "global_idx", "id", "speaker_id", "is_central_prop"), "global_idx")


@query
def degrees(spark, sf_dir):
    n, e, _ = made(spark, sf_dir).canonical
    return _long(graph.degrees(n, e).select("thread_id", "global_idx", "in_degree", "out_degree"), "global_idx")


@query
def root_node(spark, sf_dir):
    return _long(graph.roots(made(spark, sf_dir).canonical[0]), "root_idx")


@query
def components(spark, sf_dir):
    return _long(made(spark, sf_dir).canonical[2], "global_idx", "component", "rank")


@query
def repair_edges(spark, sf_dir):
    e = made(spark, sf_dir).graph[1].filter("synthetic")
    return _long(e.select("thread_id", "source_idx", "target_idx", "relation"), "source_idx", "target_idx")


@query
def central_subgraph(spark, sf_dir):
    n, _, comps = made(spark, sf_dir).canonical
    return _long(graph.root_component(n, comps).select("thread_id", "global_idx"), "global_idx")


@query
def min_units_filter(spark, sf_dir):
    n, _, comps = made(spark, sf_dir).canonical
    return graph.large_enough(graph.root_component(n, comps), PROFILE)


@query
def bas_edges(spark, sf_dir):
    return _long(made(spark, sf_dir).graph[1].select("thread_id", "mode", "source_idx", "target_idx", "relation", "synthetic"), "source_idx", "target_idx")


@query
def bas_summary(spark, sf_dir):
    s = graph.summary(*made(spark, sf_dir).graph)
    speakers = F.array_join(F.transform(F.map_entries("speaker_breakdown"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return s.withColumn("speaker_breakdown", speakers)


@query
def dot_export(spark, sf_dir):
    return graph.dot(*made(spark, sf_dir).graph)


# Step 5.


@query
def token_entropy(spark, sf_dir):
    return _long(made(spark, sf_dir).index.select("thread_id", "global_idx", F.round(entropy(F.col("text")), 6).alias("entropy")), "global_idx")


@query
def explicitness(spark, sf_dir):
    x = strengths.explicitness(made(spark, sf_dir).graph[0])
    return _long(x.select("thread_id", "mode", "global_idx", F.round("explicitness", 6).alias("explicitness")), "global_idx")


@query
def minmax_norm(spark, sf_dir):
    n = made(spark, sf_dir).graph[0].withColumn("raw", (F.col("in_degree") * 2 + F.col("out_degree")).cast("double"))
    return _long(n.select("thread_id", "mode", "global_idx", F.round(strengths.normalise("raw"), 6).alias("x")), "global_idx")


@query
def strength_ui(spark, sf_dir):
    return _long(strengths.uniform(made(spark, sf_dir).graph[0]), "global_idx")


@query
def pagerank(spark, sf_dir):
    x = strengths.pagerank(*made(spark, sf_dir).graph, PROFILE)
    return _long(x.withColumn("pagerank", F.round("pagerank", 6)), "global_idx")


@query
def ancestor_depths(spark, sf_dir):
    return _long(strengths.ancestors(*made(spark, sf_dir).graph), "global_idx", "ancestor", "depth")


@query
def strength_sei(spark, sf_dir):
    return _long(strengths.structural(*made(spark, sf_dir).graph, PROFILE), "global_idx")


@query
def expansion_node(spark, sf_dir):
    r = made(spark, sf_dir)
    return _long(strengths.expansion(strengths.explicitness(r.graph[0]), r.graph[1], PROFILE), "global_idx", "other", "depth")


@query
def context_embed(spark, sf_dir):
    r = made(spark, sf_dir)
    x = strengths.contextual(r.nodes_with_vectors, r.graph[1], PROFILE)
    return _long(x.select("thread_id", "mode", "global_idx", F.explode("cvec").alias("term", "w")), "global_idx").withColumn("w", F.round("w", 6))


@query
def strength_csi(spark, sf_dir):
    r = made(spark, sf_dir)
    return _long(strengths.content(r.nodes_with_vectors, r.graph[1], PROFILE), "global_idx")


@query
def strength_hi(spark, sf_dir):
    x = made(spark, sf_dir).strengths.filter("strategy = 's4'")
    return _long(x.select("thread_id", "mode", "global_idx", F.col("initial_strength").alias("s4")), "global_idx")


@query
def root_reversal(spark, sf_dir):
    return _long(made(spark, sf_dir).final_edges.select("thread_id", "mode", "source_idx", "target_idx", "relation", "synthetic"), "source_idx", "target_idx")


# Step 6.


def _weighted(r: Run) -> DataFrame:
    return semantics.weights(r.final_edges, PROFILE)


@query
def edge_weights(spark, sf_dir):
    e = _weighted(made(spark, sf_dir))
    return _long(e.select("thread_id", "mode", "source_idx", "target_idx", "relation", F.round("weight", 6).alias("weight")), "source_idx", "target_idx")


def _rounds(r: Run, n: int) -> DataFrame:
    # Strengths to begin with: more for later units, so that rounds differ.
    start = (F.lit(1.0) / (1 + F.col("global_idx") % 3)).cast("double")
    state = r.graph[0].select("thread_id", "mode", "global_idx", start.alias("b"), start.alias("s"))
    for _ in range(n):
        state = semantics.step(state, _weighted(r), PROFILE, ["thread_id", "mode"])
    return _long(state.select("thread_id", "mode", "global_idx", F.round("s", 6).alias("s")), "global_idx")


@query
def softmax_agg(spark, sf_dir):
    return _rounds(made(spark, sf_dir), 1)


@query
def gradual_t5(spark, sf_dir):
    return _rounds(made(spark, sf_dir), 5)


@query
def gradual_fixpoint(spark, sf_dir):
    return _long(made(spark, sf_dir).settled.select("thread_id", "mode", "strategy", "global_idx", "initial_strength", "acceptability"), "global_idx")


@query
def detect_strategies(spark, sf_dir):
    return semantics.strategies(made(spark, sf_dir).strengths)


@query
def semantics_meta(spark, sf_dir):
    return _long(semantics.meta(made(spark, sf_dir).settled).withColumn("delta_final", F.round("delta_final", 9)), "iterations")


@query
def root_shift(spark, sf_dir):
    return made(spark, sf_dir).shifts


# Step 7 and evaluation, on documents.


def _shifts(spark, sf_dir) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_chars", F.coalesce("n_chars", F.lit(0)))
    x = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(4)))).withColumn("m", F.explode(F.array(F.lit(0), F.lit(1))))
    initial = F.round(F.col("doc_id") % 11 / 10.0, 6)
    final = F.round((F.col("n_chars") * F.col("k") + F.col("m") * 31) % 997 / 997.0, 6)
    mode = F.when(F.col("m") == 0, "repair").otherwise("no_repair")
    y = x.select(F.col("doc_id").cast("string").alias("thread_id"), mode.alias("mode"), F.concat(F.lit("s"), F.col("k")).alias("strategy"), initial.alias("initial"), final.alias("final"))
    return y.withColumn("delta", F.round(F.col("final") - F.col("initial"), 6)).withColumn("abs_delta", F.abs("delta"))


def _labels(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("string").alias("thread_id"), (F.col("quality") == 1).alias("is_delta"))


@query
def root_deltas(spark, sf_dir):
    return _shifts(spark, sf_dir)


@query
def predict_threshold(spark, sf_dir):
    return predict.label(predict.predict(_shifts(spark, sf_dir), [0.3]), _labels(spark, sf_dir)).select("thread_id", "mode", "strategy", "predicted", "ground_truth", "correct")


@query
def threshold_sweep(spark, sf_dir):
    p = predict.predict(_shifts(spark, sf_dir), [k / 10 for k in range(1, 10)])
    return p.groupBy("mode", "strategy", "threshold").agg(F.sum(F.col("predicted").cast("long")).alias("positives"))


@query
def ensemble_vote(spark, sf_dir):
    return predict.vote(predict.predict(_shifts(spark, sf_dir), THRESHOLDS)).select("thread_id", "mode", "threshold", "votes_persuasive", "votes_total", "predicted")


@query
def binary_metrics(spark, sf_dir):
    x = predict.label(predict.predict(_shifts(spark, sf_dir), [0.3]), _labels(spark, sf_dir))
    return predict.binary_metrics(x, "mode", "strategy")


@query
def dataset_metrics(spark, sf_dir):
    x = predict.label(predict.with_ensemble(predict.predict(_shifts(spark, sf_dir), THRESHOLDS)), _labels(spark, sf_dir))
    return predict.binary_metrics(x, "mode", "threshold", "strategy")


@query
def tune_threshold(spark, sf_dir):
    return predict.tune(_shifts(spark, sf_dir), _labels(spark, sf_dir))


@query
def accuracy(spark, sf_dir):
    return binary_metrics(spark, sf_dir).select("mode", "strategy", "accuracy")


@query
def f1(spark, sf_dir):
    return binary_metrics(spark, sf_dir).select("mode", "strategy", "f1")


@query
def auc_roc(spark, sf_dir):
    x = _shifts(spark, sf_dir).join(_labels(spark, sf_dir).withColumnRenamed("is_delta", "ground_truth"), "thread_id")
    return predict.auc(x, "mode", "strategy")


@query
def evaluate(spark, sf_dir):
    return predict.evaluate(_shifts(spark, sf_dir), _labels(spark, sf_dir), THRESHOLDS)


@query
def metric_pivot(spark, sf_dir):
    return predict.pivot(evaluate(spark, sf_dir), "f1", ["s1", "s2", "s3", "s4", predict.ENSEMBLE])


@query
def mode_comparison(spark, sf_dir):
    return predict.compare(evaluate(spark, sf_dir))


@query
def prediction_records(spark, sf_dir):
    """Nested predictions as they are written, the sentinel's row left out."""
    x = records.predictions(_shifts(spark, sf_dir).withColumns({"root_id": F.lit("edu_0"), "root_text": F.lit(None).cast("string")}), _labels(spark, sf_dir), THRESHOLDS_OF_RECORDS).filter(F.col(jsonl.SENTINEL).isNull())
    t = x.select("thread_id", "mode", "ground_truth", F.explode("thresholds").alias("threshold", "t"))
    return t.select("thread_id", "mode", "ground_truth", "threshold", F.col("t.ensemble.predicted").alias("ensemble"), F.col("t.ensemble.correct").alias("correct"), F.col("t.predictions")["s2"]["predicted"].alias("s2"), F.col("t.predictions")["s2"]["delta"].alias("s2_delta"))


@query
def metrics_json(spark, sf_dir):
    """The metrics as written, read back."""
    x = records.metrics_json(_shifts(spark, sf_dir), _labels(spark, sf_dir), THRESHOLDS)
    one = "map<string,map<string,struct<n:bigint,accuracy:double,f1:double,auc:double>>>"
    j = x.select(F.from_json("value", f"repair {one}, no_repair {one}").alias("j"))
    both = j.select(F.explode(F.create_map(F.lit("repair"), "j.repair", F.lit("no_repair"), "j.no_repair")).alias("mode", "m"))
    t = both.select("mode", F.explode("m").alias("threshold", "s")).select("mode", F.col("threshold").cast("double").alias("threshold"), F.explode("s").alias("strategy", "v"))
    return t.select("mode", "threshold", "strategy", "v.n", "v.accuracy", "v.f1", "v.auc")


@query
def step_records(spark, sf_dir):
    """Records of the third step, taken apart again."""
    r = made(spark, sf_dir)
    x = r.keep(records.with_relations(r))
    n = records.relations_of(x).groupBy("thread_id").agg(F.count(F.lit(1)).alias("pairs"), F.sum((F.col("relation") == "attack").cast("long")).alias("attacks"), F.sum("pac_pos").alias("places"))
    u = records.edus_of(x).groupBy("thread_id").agg(F.count(F.lit(1)).alias("units"), F.sum(F.length("text").cast("long")).alias("chars"))
    zero = F.lit(0).cast("long")
    y = x.select("thread_id", F.size("conversation").cast("long").alias("turns"), F.col("reasoning_summary.skipped_edus").alias("skipped")).join(n, "thread_id", "left").join(u, "thread_id", "left")
    return y.select("thread_id", "turns", "skipped", *[F.coalesce(c, zero).alias(c) for c in ("pairs", "attacks", "places", "units", "chars")])


# Reports.


@query
def graph_stats(spark, sf_dir):
    r = made(spark, sf_dir)
    return report.graph_stats(r.graph[0], r.final_edges)


@query
def key_arguments(spark, sf_dir):
    r = made(spark, sf_dir)
    return _long(report.key_arguments(r.graph[0], r.final_edges).select("thread_id", "mode", "relation", "place", "level", "source_idx"), "place", "level", "source_idx")


def _verdicts(r: Run) -> DataFrame:
    return r.graph[0].select("thread_id", "mode").distinct().join(r.threads, "thread_id").select("thread_id", "mode", (F.col("thread_id").cast("long") % 3 == 0).alias("predicted"), F.when(F.col("thread_id").cast("long") % 5 != 0, F.col("is_delta")).alias("ground_truth"))


@query
def failure_reason(spark, sf_dir):
    r = made(spark, sf_dir)
    return report.failure_reason(report.graph_stats(r.graph[0], r.final_edges), _verdicts(r))


@query
def report_join(spark, sf_dir):
    r = made(spark, sf_dir)
    return report.joined(_verdicts(r).filter("predicted"), r.graph[0])


@query
def report_md(spark, sf_dir):
    r = made(spark, sf_dir)
    votes = predict.vote(predict.predict(r.shifts, [0.1, 0.3, 0.5]))
    first = predict.label(votes.filter("threshold = 0.1"), r.threads).select("thread_id", "mode", "predicted", "ground_truth")
    return report.pages(r.graph[0], r.final_edges, r.shifts, votes, first)


@query
def report_pdf(spark, sf_dir):
    """The pages as PDF files: how many there are of each mode, and that each begins and ends as one."""
    x = pdf.rendered(report_md(spark, sf_dir))
    ok = x.select("mode", (F.substring("pdf", 1, 5).cast("string") == "%PDF-").alias("begins"), F.right(F.regexp_replace(F.decode(F.expr("substring(pdf, -6)"), "US-ASCII"), "\n", ""), F.lit(5)).alias("ends"))
    return ok.groupBy("mode").agg(F.count(F.lit(1)).alias("files"), F.bool_and("begins").alias("begins"), F.max("ends").alias("ends"))
