"""The engine on small cases with known results, and some queries against their SQL."""

import json
from dataclasses import replace

import duckdb
import numpy as np
import pytest

from argolith.config import ENGLISH, ITALIAN, load, merge
from argolith.functions.text import clean_turn, entropy, fallback_segments, strip, tokens
from argolith.operators import candidates, graph, predict, relations
from argolith.operators.semantics import settle
from argolith.operators.strengths import pagerank_of
from argolith.plans import steps
from argolith.plans.pipeline import Run
from argolith.providers import Cue, TableEncoder, chat, server
from argolith.queries import QUERIES, SQL
from argolith.session import materialise
from argolith.sources import jsonl, pdf, transcripts
from argolith.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, expr_of, text):
    return spark.createDataFrame([(text,)], "t string").select(expr_of("t").alias("x")).first().x


def test_text(spark):
    from pyspark.sql import functions as F

    c = F.col
    assert one(spark, lambda t: strip(c(t)), "\t x  ") == "x"
    assert one(spark, lambda t: tokens(c(t)), " A  b\n") == ["a", "b"] and one(spark, lambda t: tokens(c(t)), " ") == []
    assert one(spark, lambda t: fallback_segments(c(t), ENGLISH), "First one here. Second one here; third one here, because it is so, Because not") == ["First one here.", "Second one here", "third one here", "because it is so, Because not"]
    assert one(spark, lambda t: clean_turn(c(t), ENGLISH), "Hello, users of CMV! hi\nbody\n\n\n\ntail\n\n/u/DeltaBot x\nmore") == "body\n\ntail"
    assert one(spark, lambda t: entropy(c(t)), "a b a b") == pytest.approx(1.0) and one(spark, lambda t: entropy(c(t)), "") == 0


def test_profiles(tmp_path):
    assert ENGLISH.batch_chars == 17_616 and ITALIAN.batch_chars == 12_948
    p = tmp_path / "p.json"
    p.write_text('{"edu": {"min_edu_words": 4}, "pac": {"threshold": 0.3}, "x": {"y": 1}}')
    got = load(str(p))
    assert got.min_words == 4 and got.threshold == 0.3 and got.extras == {"x": {"y": 1}}
    assert merge({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}
    with pytest.raises(ValueError):
        load(str(tmp_path / "none.json"))


@pytest.mark.parametrize(
    ("b", "edges", "rounds", "want"),
    [
        ([1], [], 19, [0.582571]),
        ([1, 1], [(0, 1, "s", 1.0)], 22, [0.582570, 0.906806]),
        ([1, 1], [(0, 1, "a", 1.0)], 22, [0.582570, 0.166787]),
        ([1, 1, 1], [(0, 2, "s", 0.5), (1, 2, "s", 0.5)], 22, [0.582570, 0.582570, 0.786556]),
        ([1, 1, 1], [(0, 2, "s", 1.0), (1, 2, "a", 1.0)], 19, [0.582571] * 3),
        ([0], [], 19, [0.499999]),
    ],
)
def test_golden_fixpoints(b, edges, rounds, want):
    src, tgt, kind, w = (np.array(x) for x in (zip(*edges) if edges else ([], [], [], [])))
    s, t, done, _, _ = settle(np.array(b, float), src.astype(int), tgt.astype(int), kind == "a", w.astype(float), ENGLISH)
    assert done and t == rounds and s == pytest.approx(want, abs=5e-6)


def test_pagerank_sums_to_one():
    x = pagerank_of(3, np.array([0, 1]), np.array([1, 2]), 0.85)
    assert x.sum() == pytest.approx(1) and x[2] > x[1] > x[0]


def test_scopes_and_windows(spark):
    rows = [("t", i, p, q, i, "a", f"w{i}", False) for i, (p, q) in enumerate([("r", ""), ("r", ""), ("A", "r"), ("B", "A"), ("C", "r")])]
    idx = candidates.lexical(spark.createDataFrame(rows, "thread_id string, global_idx int, post_id string, parent_id string, local_idx int, speaker_id string, text string, is_central_prop boolean"))
    got = {(r.target_idx, r.source_idx, r.pac_scope) for r in candidates.candidates(idx).collect()}
    assert got == {(0, 1, "INTRA"), (1, 0, "INTRA"), (0, 2, "INTER"), (0, 4, "INTER"), (1, 2, "INTER"), (1, 4, "INTER"), (2, 3, "INTER")}
    many = [("t", i, "r", "", i, "a", f"w{i}", False) for i in range(24)]
    idx = candidates.lexical(spark.createDataFrame(many, idx.drop("vec").schema))
    p = candidates.implicit(candidates.candidates(idx), replace(ENGLISH, implicit_window=10))
    by = {t: sorted(r.source_idx for r in p.filter(f"target_idx = {t}").collect()) for t in (3, 12)}
    assert by == {3: [0, 1, 2, *range(4, 11)], 12: list(range(2, 12))}


def test_gate_and_parse(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("support", 0.45), ("support", 0.46), ("attack", 0.35), ("attack", 0.36)], "r string, c double")
    assert [r.x for r in df.select(relations.gate(F.col("r"), F.col("c"), ENGLISH).alias("x")).collect()] == ["neutral", "support", "neutral", "attack"]
    expected = spark.createDataFrame([("b", 0, 0), ("b", 0, 1), ("b", 1, 0)], "batch_id string, target_idx int, source_idx int")
    raw = 'x {"batch":[{"target_idx":0,"relations":[{"source_idx":0,"relation":" Attack "},{"source_idx":1,"relation":"odd"}]},{"target_idx":9,"relations":[]},{"target_idx":1,"relations":[{"source_idx":0,"relation":"support","confidence":"high"}]}]} y'
    replies = spark.createDataFrame([("b", 1, raw), ("b", 2, "{bad")], "batch_id string, call_no int, raw string")
    got = {(r.call_no, r.target_idx, r.source_idx): r.relation for r in relations.parse(replies, expected, ENGLISH).collect()}
    assert got == {(1, 0, 0): "attack", (1, 0, 1): "neutral", (1, 1, 0): "neutral"}


def test_canonical_edges(spark):
    rows = [("t", 1, 2, "support"), ("t", 2, 1, "attack"), ("u", 1, 2, "attack"), ("u", 2, 1, "support"), ("v", 2, 1, "support"), ("v", 2, 1, "attack")]
    e = graph.canonical_edges(spark.createDataFrame(rows, "thread_id string, source_idx int, target_idx int, relation string")).collect()
    assert {(r.thread_id, r.source_idx, r.target_idx, r.relation) for r in e} == {("t", 1, 2, "support"), ("u", 1, 2, "attack"), ("v", 1, 2, "attack")}


def test_repair_sign(spark):
    n = spark.createDataFrame([("t", 0, [1.0, 0.0]), ("t", 1, [1.0, 0.1]), ("t", 2, [-1.0, 0.0])], "thread_id string, global_idx int, vec array<float>")
    e = spark.createDataFrame([("t", 0, 1)], "thread_id string, source_idx int, target_idx int")
    got = graph.repair(n, graph.components(n, e), dense=True).collect()
    assert [(r.source_idx, r.target_idx, r.relation, r.synthetic) for r in got] == [(1, 2, "attack", True)]


def test_metrics(spark):
    x = spark.createDataFrame([(True, False), (False, True)], "predicted boolean, ground_truth boolean")
    m = predict.binary_metrics(x).first()
    assert (m.accuracy, m.f1, m.mcc) == (0, 0, -1)
    s = "abs_delta double, ground_truth boolean"
    assert predict.auc(spark.createDataFrame([(1.0, True), (1.0, False)], s)).first().auc == 0.5
    assert predict.auc(spark.createDataFrame([(2.0, True), (1.0, False)], s)).first().auc == 1
    assert predict.auc(spark.createDataFrame([(2.0, True)], s)).first().auc is None
    v = [("t", "m", 0.1, "s", 1.0, k < 2) for k in range(4)] + [("u", "m", 0.1, "s", 1.0, k < 1) for k in range(3)]
    votes = predict.vote(spark.createDataFrame(v, "thread_id string, mode string, threshold double, strategy string, abs_delta double, predicted boolean"))
    assert {r.thread_id: r.predicted for r in votes.collect()} == {"t": True, "u": False}


def test_jsonl_and_streaming(spark, tmp_path):
    src = tmp_path / "in"
    jsonl.write(jsonl.sample(spark), str(src))
    (src / "more.json").write_text('\n{bad\n{"thread_id": "s3", "conversation": []}\n')
    records = jsonl.read(spark, str(src))
    assert sorted(r.thread_id for r in records.collect()) == ["s1", "s2", "s3"]
    done = spark.createDataFrame([("s1", 3), ("s2", None)], "thread_id string, total int")
    assert sorted(r.thread_id for r in jsonl.unfinished(records, done, "total").collect()) == ["s2", "s3"]
    for _ in range(2):
        incremental.run(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), lambda df: df.select("thread_id")).awaitTermination(60)
    assert sorted(r.thread_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["s1", "s2", "s3"]


def test_transcripts(spark, tmp_path):
    text = "(Misure sul\n ﬁume – n. 3-00545)\nPRESIDENTE. Ha facoltà.\nANNA D'ARCO (FDI). Chiedo\n  al Ministro.\nMARIO ROSSI, Ministro dell'interno. Rispondo ora. Cafe\u0301.\nPRESIDENTE. Prego.\nUGO RE' (PD). Non sono soddisfatta! Grazie."
    rows = [{"id": "x", "full_interro_text": text, "date_modified": "2024", "type": "t"}, {"id": "y", "full_interro_text": "nothing"}, {"id": "z"}, {"full_interro_text": text}, {"id": "w", "full_interro_text": text.replace("MARIO ROSSI, Ministro dell'interno", "MARIO ROSSI (M5S)")}]
    (tmp_path / "acts.json").write_text(json.dumps(rows))
    (got,) = transcripts.read(spark, str(tmp_path)).collect()
    posts = got.conversation
    assert (got.thread_id, got.conv_id, got.title, got.turn_count, got.is_delta) == ("x_1", "x", "Misure sul fiume", 3, None)
    assert [(p.post_id, p.parent_id, p.speaker_id, p.role, p.timestamp) for p in posts] == [("x_t1", "", "Speaker 1", "question", "2024"), ("x_t2", "x_t1", "Speaker 2", "response", "2024"), ("x_t3", "x_t2", "Speaker 1", "counter-reply", "2024")]
    assert [(p.speaker_name, p.affiliation) for p in posts] == [("Anna D'Arco", "FDI"), ("Mario Rossi", "Ministro dell'interno"), ("Ugo Re'", "PD")]
    assert posts[0].text == "[Speaker 1 - Question]: Chiedo al Ministro." and posts[1].text.endswith("Rispondo ora. Café.") and got.sentence_count == 5
    assert got.metadata["source"] == "acts.json" and got.metadata["language"] == "it" and got.metadata["type"] == "t" and got.metadata["seduta"] is None


def test_model_rounds_against_a_loop(spark):
    """Two calls, third calls and halves, with replies that depend on the batch: the same as asking one batch after the other."""
    from pyspark.sql import functions as F

    from argolith.operators import reasoning
    from argolith.providers import ask_all

    def reply(batch_id, call_no, prompt):
        h = sum(map(ord, batch_id)) + 3 * call_no
        if h % 7 == 0:
            return "{bad"
        targets = []
        for part in prompt.split("Target [")[1:]:
            pos = int(part.split("]")[0])
            lines = part.split("Sources:\n")[1].split("\n\n---")[0].split("\n")
            sources = [int(x.split("[")[1].split("]")[0]) for x in lines if x.startswith("  [")]
            if (h + pos) % 4:
                targets.append({"target_idx": pos, "relations": [{"source_idx": s, "relation": ["support", "attack", "neutral"][(h * (s % 2) + pos + s) % 3]} for s in sources]})
        return json.dumps({"batch": targets})

    class Loop:
        def ask(self, prompts):
            return ask_all(prompts, reply, 2, ("batch_id", "call_no", "prompt")).drop("system", "temperature", "prompt")

    rows = [(f"t{t}", i, i % 3, f"text {i}", [], [], [f"s{k}" for k in range((i * 7 + t) % 4)]) for t in range(12) for i in range(10)]
    index = spark.createDataFrame([(t, i, "p", "", i, "a", x, False) for t, i, _, x, *_ in rows], "thread_id string, global_idx int, post_id string, parent_id string, local_idx int, speaker_id string, text string, is_central_prop boolean")
    pacs = spark.createDataFrame([(t, i, k, k, s) for t, i, _, _, _, _, ss in rows for k, s in enumerate(ss)], "thread_id string, target_idx int, source_idx int, pac_pos int, source_text string")
    found, _ = reasoning.label(index, pacs, Loop(), ENGLISH, materialise)
    got = {(r.thread_id, r.target_idx, r.source_idx): r.relation for r in found.collect()}

    def parsed(batch_id, call_no, items):
        text = "".join(f"Target [{p}]\nSources:\n" + "\n".join(f"  [{k}] {s}" for k, s in enumerate(ss)) + "\n\n---" for p, ss in enumerate(items))
        raw = reply(batch_id, call_no, text)
        if raw == "{bad":
            return None
        by = {e["target_idx"]: [r["relation"] for r in e["relations"]] for e in json.loads(raw)["batch"]}
        return [by.get(p) for p in range(len(items))]

    def asked(batch_id, items, depth):
        if not any(items):
            return [[] for _ in items]
        a, b = parsed(batch_id, 1, items), parsed(batch_id, 2, items)
        if a is None and b is None:
            a = parsed(batch_id, 3, items)
            out = a
        elif a is None or b is None:
            out = a or b
        else:
            differ = [(p, s) for p in range(len(items)) if a[p] and b[p] for s in range(len(items[p])) if a[p][s] != b[p][s]]
            out = a
            if differ:
                which = sorted({p for p, _ in differ})
                c = parsed(batch_id, 3, [items[p] for p in which])
                out = [list(x) if x is not None else ["neutral"] * len(items[p]) for p, x in enumerate(a)]
                for p, s in differ:
                    if c is not None and c[which.index(p)] is not None:
                        out[p][s] = c[which.index(p)][s]
        missing = [p for p in range(len(items)) if (out is None or out[p] is None) and items[p]]
        out = [x if x is not None else ["neutral"] * len(items[p]) for p, x in enumerate(out or [None] * len(items))]
        if missing and depth < 2 and len(items) > 1:
            mid = max(1, len(missing) // 2)
            for half, name in ((missing[:mid], "a"), (missing[mid:], "b")):
                for p, x in zip(half, asked(batch_id + name, [items[p] for p in half], depth + 1)):
                    out[p] = x
        return out

    want = {}
    for t in range(12):
        items = [ss for u, *_, ss in rows if u == f"t{t}"]
        for i, x in enumerate(asked(f"t{t}_0", items, 0)):
            want |= {(f"t{t}", i, k): r for k, r in enumerate(x)}
    assert got == want


def test_steps_resume(spark, tmp_path):
    src = tmp_path / "in"
    jsonl.write(jsonl.sample(spark).filter("thread_id = 's1'"), str(src))
    quick = replace(ENGLISH, threshold=0.1)
    assert steps.run(spark, "relations", str(src), str(tmp_path / "out"), quick) == 1
    jsonl.write(jsonl.sample(spark), str(src))
    assert steps.run(spark, "relations", str(src), str(tmp_path / "out"), quick) == 1
    assert steps.run(spark, "relations", str(src), str(tmp_path / "out"), quick) == 0
    assert sorted(r.thread_id for r in spark.read.json(str(tmp_path / "out")).collect()) == ["s1", "s2"]
    assert steps.run(spark, "settled", str(src), str(tmp_path / "settled"), quick) == spark.read.json(str(tmp_path / "settled")).count() >= 2
    from pyspark.sql import functions as F

    records = jsonl.sample(spark).withColumn("is_delta", F.lit(True))
    r = Run(jsonl.posts(records), jsonl.threads(records), quick, Cue())
    steps.evaluate(r, [0.1, 0.3], str(tmp_path / "predictions"), str(tmp_path / "metrics"))
    lines = [json.loads(x.value) for x in spark.read.text(str(tmp_path / "predictions")).collect()]
    assert sum("__eval__" in x for x in lines) == 1 and {x["thread_id"] for x in lines if "__eval__" not in x} == {"s1", "s2"}
    (m,) = spark.read.text(str(tmp_path / "metrics")).collect()
    assert set(json.loads(m.value)) <= {"repair", "no_repair", "comparison"}


def test_pdf(spark, tmp_path):
    text = "A page (with brackets) \\ é\n" + "long " * 100 + "\n" * 70 + "end"
    doc = pdf.document(text)
    assert doc.startswith(b"%PDF-1.4") and doc.endswith(b"%%EOF\n") and doc.count(b"/Type /Page ") == 2 and b"\\(with brackets\\)" in doc
    table = int(doc.rsplit(b"startxref\n", 1)[1].split()[0])
    assert doc[table:].startswith(b"xref")
    df = pdf.rendered(spark.createDataFrame([("a", text)], "thread_id string, page string"))
    assert pdf.save(df, str(tmp_path), "thread_id") == 1 and (tmp_path / "a.pdf").read_bytes() == doc


def test_server_speaks_by_profile(spark):
    sent = []

    def post(body):
        sent.append(json.loads(body))
        return '{"message": {"content": "ok"}}'

    quick = replace(ENGLISH, extras={"prompts": {"segmentation": "cut"}, "reasoning": {"system": "judge"}})
    s = server("u", quick, "m", post=post)
    assert s.systems == {"segmentation": "cut", "relations": "judge", "tiebreak": "", "cp_review": ""}
    assert chat("u", "m", s.systems["relations"], {"temperature": 0.1}, post=post, think=False)("p") == "ok"
    assert sent[0]["messages"][0]["content"] == "judge" and sent[0]["think"] is False


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from argolith.session import shared_folder

    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: SimpleNamespace(get=lambda _: None), master="spark://host:7077")
    with pytest.raises(ValueError):
        shared_folder(SimpleNamespace(sparkContext=sc))


def test_chat_tries_again_after_a_timeout():
    calls = []

    def post(body):
        calls.append(body)
        if len(calls) == 1:
            raise TimeoutError
        return '{"message": {"content": "<think>x</think> ok"}}'

    assert chat("u", "m", "s", {}, post=post)("p") == "ok" and len(calls) == 2


def test_pipeline_on_the_sample(spark):
    from pyspark.sql import functions as F

    records = jsonl.sample(spark).withColumn("is_delta", F.lit(True))
    r = Run(jsonl.posts(records), jsonl.threads(records), replace(ENGLISH, threshold=0.1), Cue())
    assert {x.thread_id for x in r.shifts.collect()} == {"s1", "s2"}


def test_run_with_dense_vectors(spark):
    """One-hot vectors of words, scaled, give the strengths that word counts give."""
    from pyspark.sql import functions as F

    records = jsonl.sample(spark).withColumn("is_delta", F.lit(True))
    quick = replace(ENGLISH, threshold=0.1)
    plain = Run(jsonl.posts(records), jsonl.threads(records), quick, Cue())
    units = plain.index.collect()
    words = sorted({w for u in units for w in u.vec})
    vectors = spark.createDataFrame([(u.thread_id, u.global_idx, [float(u.vec.get(w, 0)) for w in words]) for u in units], "thread_id string, global_idx int, vec array<float>")
    dense = Run(jsonl.posts(records), jsonl.threads(records), quick, Cue(), encoder=TableEncoder(vectors))
    a, b = ({(r.thread_id, r["mode"], r.global_idx, r.strategy): r.initial_strength for r in x.strengths.collect()} for x in (plain, dense))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=2e-6) for k in a)


@pytest.mark.parametrize("name", ["fallback_edus", "pac_topk", "canonical_edges", "evaluate", "turn_batches"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "documents", "labels", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(repr([dict(zip(names, r))[c] for c in cols]) for r in cur.fetchall())
    assert sorted(repr([r[c] for c in cols]) for r in df.collect()) == want
