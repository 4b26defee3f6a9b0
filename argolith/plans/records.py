"""Nested records of each step, one row for each conversation or graph, as they are written as JSON lines; and the way back to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argolith.operators import candidates, graph, predict, relations, segment
from argolith.plans.pipeline import Run
from argolith.sources.jsonl import SENTINEL

ON = ["thread_id", "mode"]


def _gathered(df: DataFrame, by: list[str], order: list[str], name: str, *cols: str) -> DataFrame:
    """One array of structs for each group, in order. A group is a turn, a unit or a graph of one conversation."""
    rest = [c for c in cols if c not in order]

    def compare(a: Column, b: Column) -> Column:
        x, y = (F.struct(*[s[c].alias(c) for c in order]) for s in (a, b))
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    x = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, *rest)), compare).alias(name))
    return x.withColumn(name, F.transform(name, lambda s: F.struct(*[s[c].alias(c) for c in cols])))


def _turns(run: Run, units: DataFrame, *cols: str) -> DataFrame:
    """Conversations with the units of each turn; turns without units have none."""
    e = _gathered(units, ["thread_id", "turn_pos"], ["local_idx"], "edus", *cols)
    t = run.turns.join(e, ["thread_id", "turn_pos"], "left")
    t = t.withColumn("edus", F.when(F.col("edus").isNull(), F.slice(F.array(F.col("edus")[0]), 1, 0)).otherwise(F.col("edus"))).withColumn("edu_count", F.size("edus"))
    x = _gathered(t, ["thread_id"], ["turn_pos"], "conversation", "post_id", "parent_id", "speaker_id", "text", "edus", "edu_count")
    named = run.threads.select("thread_id", "title", "is_delta").join(run.central.select("thread_id", "central_proposition"), "thread_id", "left")
    counts = segment.summary(run.turns, run.edus)
    summary = F.struct(F.col("total_turns"), F.col("total_edus")).alias("edu_summary")
    return x.join(named, "thread_id").join(counts, "thread_id").select("thread_id", "title", "is_delta", "central_proposition", summary, "conversation")


def with_edus(run: Run) -> DataFrame:
    """Step 1: conversations with their units."""
    return _turns(run, run.edus, "text", "speaker_id")


def _with_pairs(run: Run, pairs: DataFrame, *more: str) -> DataFrame:
    cols = ("source_idx", "source_post_id", "source_speaker_id", "source_local_idx", "source_text", "cosine_sim", "selection_type", "pac_scope", *more)
    p = _gathered(pairs, ["thread_id", "target_idx"], ["pac_pos"], "pacs", *cols).withColumnRenamed("target_idx", "global_idx")
    return run.index.join(p, ["thread_id", "global_idx"], "left").withColumn("pac_count", F.coalesce(F.size("pacs"), F.lit(0)))


def with_pairs(run: Run) -> DataFrame:
    """Step 2: conversations with the chosen pairs of each unit."""
    units = _with_pairs(run, run.pacs)
    s = candidates.summary(run.index, run.pacs)
    summary = F.struct(*[c for c in s.columns if c != "thread_id"]).alias("pac_summary")
    return _turns(run, units, "global_idx", "text", "speaker_id", "pac_count", "pacs").join(s.select("thread_id", summary), "thread_id", "left")


def with_relations(run: Run) -> DataFrame:
    """Step 3: conversations with the relation of each pair."""
    a = relations.argumentative(run.relations)
    kinds = F.create_map(*[x for r in relations.LABELS for x in (F.lit(r), F.col(r))]).alias("relation_summary")
    units = _with_pairs(run, run.relations, "relation").join(a.select("thread_id", F.col("target_idx").alias("global_idx"), "target_is_argumentative", kinds), ["thread_id", "global_idx"], "left")
    units = units.withColumn("reasoning_skipped", F.col("pac_count") == 0).withColumn("target_is_argumentative", F.coalesce("target_is_argumentative", F.lit(False)))
    s = relations.summary(run.index, run.relations)
    summary = F.struct(*[c for c in s.columns if c != "thread_id"]).alias("reasoning_summary")
    cols = ("global_idx", "text", "speaker_id", "is_central_prop", "pac_count", "pacs", "target_is_argumentative", "relation_summary", "reasoning_skipped")
    return _turns(run, units, *cols).join(s.select("thread_id", summary), "thread_id", "left")


def relations_of(records: DataFrame) -> DataFrame:
    """The table of relations from records of step 3."""
    t = records.select("thread_id", F.explode("conversation").alias("t")).select("thread_id", F.explode("t.edus").alias("e"))
    p = t.select("thread_id", F.col("e.global_idx").alias("target_idx"), F.posexplode("e.pacs").alias("pac_pos", "p"))
    return p.select("thread_id", "target_idx", "pac_pos", "p.*")


def edus_of(records: DataFrame) -> DataFrame:
    """The table of units from records of step 1, 2 or 3."""
    t = records.select("thread_id", F.posexplode("conversation").alias("turn_pos", "t"))
    e = t.select("thread_id", "turn_pos", "t.post_id", "t.parent_id", F.posexplode("t.edus").alias("local_idx", "e"))
    return e.select("thread_id", "turn_pos", "post_id", "parent_id", F.col("e.speaker_id").alias("speaker_id"), "local_idx", F.col("e.text").alias("text"))


def graphs(run: Run) -> DataFrame:
    """Step 4: a graph of each mode."""
    nodes, edges = run.graph
    n = _gathered(nodes, ON, ["global_idx"], "nodes", "id", "global_idx", "post_id", "parent_id", "speaker_id", "text", "is_root", "in_degree", "out_degree")
    e = _gathered(edges, ON, ["source_idx", "target_idx"], "edges", "source_idx", "target_idx", "relation", "synthetic")
    s = graph.summary(nodes, edges)
    summary = F.struct(*[c for c in s.columns if c not in ON]).alias("summary")
    return n.join(e, ON, "left").join(s.select(*ON, summary), ON).join(run.threads.select("thread_id", "is_delta"), "thread_id", "left")


def settled(run: Run) -> DataFrame:
    """Steps 5 and 6: graphs with the strengths of each strategy, and how they settled."""
    x = run.settled.groupBy(*ON, "global_idx").agg(F.map_from_entries(F.collect_list(F.struct("strategy", F.struct("initial_strength", "acceptability").alias("v")))).alias("strengths"))
    n = _gathered(run.graph[0].join(x, [*ON, "global_idx"]), ON, ["global_idx"], "nodes", "id", "global_idx", "speaker_id", "text", "is_root", "strengths")
    e = _gathered(run.final_edges, ON, ["source_idx", "target_idx"], "edges", "source_idx", "target_idx", "relation", "synthetic")
    m = run.settled.groupBy(*ON, "strategy").agg(F.struct(F.max("iterations").alias("iterations"), F.bool_and("converged").alias("converged"), F.max("delta_final").alias("delta_final")).alias("v"))
    m = m.groupBy(*ON).agg(F.map_from_entries(F.collect_list(F.struct("strategy", "v"))).alias("semantics_meta"))
    return n.join(e, ON, "left").join(m, ON)


def _keyed(x: DataFrame, by: list[str], key: str, value: Column, name: str) -> DataFrame:
    return x.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string").alias(key), value.alias("v")))).alias(name))


def predictions(shifts: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """Step 7: a record of each root, its predictions and vote under each threshold; and a last one, marked by the sentinel, with the metrics."""
    p = predict.label(predict.predict(shifts, thresholds), labels)
    one = F.struct("initial", "final", "delta", "abs_delta", "predicted", "threshold", "correct")
    each = _keyed(p, [*ON, "root_id", "root_text", "ground_truth", "threshold"], "strategy", one, "predictions")
    v = predict.label(predict.vote(predict.predict(shifts, thresholds)), labels).select(*ON, "threshold", F.struct("votes_persuasive", "votes_total", "predicted", "correct").alias("ensemble"))
    x = each.join(v, [*ON, "threshold"])
    rows = _keyed(x, [*ON, "root_id", "root_text", "ground_truth"], "threshold", F.struct("predictions", "ensemble"), "thresholds").withColumn("is_delta", F.col("ground_truth"))
    last = metrics(shifts, labels, thresholds).groupBy().agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("mode", "metrics")))).alias(SENTINEL))
    return rows.unionByName(last, allowMissingColumns=True)


def metrics(shifts: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """(mode, metrics): metrics by threshold, then by strategy."""
    m = predict.evaluate(shifts, labels, thresholds)
    s = _keyed(m, ["mode", "threshold"], "strategy", F.struct("n", "accuracy", "f1", "auc"), "s")
    return _keyed(s, ["mode"], "threshold", F.col("s"), "metrics")


def metrics_json(shifts: DataFrame, labels: DataFrame, thresholds: list[float]) -> DataFrame:
    """One value: the metrics of both modes and their comparison, as JSON."""
    m = predict.evaluate(shifts, labels, thresholds)
    c = _keyed(predict.compare(m).groupBy("threshold").agg(F.map_from_entries(F.collect_list(F.struct("strategy", F.struct(F.col("repair").alias("repair_f1"), F.col("no_repair").alias("no_repair_f1")).alias("v")))).alias("s")).withColumn("k", F.lit(1)), ["k"], "threshold", F.col("s"), "comparison")
    both = metrics(shifts, labels, thresholds).groupBy().agg(*[F.first(F.when(F.col("mode") == k, F.col("metrics")), True).alias(k) for k in ("repair", "no_repair")])
    return both.crossJoin(F.broadcast(c.drop("k"))).select(F.to_json(F.struct("repair", "no_repair", "comparison")).alias("value"))  # one row each
