"""Line dedup against comparing every line with every earlier one."""

import random
import tracemalloc

import numpy as np
import pytest

from argolith.llm import line_dedup
from argolith.llm.line_dedup import dedup, removed_lines

DOCS = "doc_id long, text string, source string, line long, __x string"


def brute(rows, t=0.8):
    lines = [(d, n, frozenset(x.replace("\r", " ").replace("\t", " ").split(" ")) - {""}, k) for k, (d, text) in enumerate(rows) if d is not None and text is not None for n, x in enumerate(text.split("\n"))]
    out = set()
    for d, n, s, k in lines:
        if s and any((e, m) < (d, n) and r and len(s & r) >= t * len(s | r) - 1e-9 for e, m, r, _ in lines):
            out.add((k, n))
    return out


def kept(rows):
    gone = brute(rows)
    return sorted((d if d is not None else -1, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (k, n) not in gone)) for k, (d, t) in enumerate(rows))


def made(seed, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    pool = [" ".join(r.choices(words, k=r.choice([1, 2, 4, 5, 6, 9, 12, 30, 70, 90]))) for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(r.randint(0, 5)):
            x = r.choice(pool).split(" ")
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                x[r.randrange(len(x))] = r.choice(words)
            lines.append(r.choice([" ", "  ", "\t"]).join(x))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = made(seed)
    df = spark.createDataFrame([(d, t, "s", 7, "x") for d, t in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in dedup(df).collect()) == kept(rows)


@pytest.mark.parametrize("hot, enough", [(8, 1), (3, 2), (50_000, 1)])
def test_hot_words_and_few_candidates(spark, monkeypatch, hot, enough):
    monkeypatch.setattr(line_dedup, "HOT_WORD", hot)
    monkeypatch.setattr(line_dedup, "ENOUGH", enough)
    monkeypatch.setattr(line_dedup, "KEEP", 1)
    monkeypatch.setattr(line_dedup, "COMPACT", 2_000)
    rows = made(3)
    df = spark.createDataFrame([(d, t, "s", 7, "x") for d, t in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in dedup(df).collect()) == kept(rows)


@pytest.mark.parametrize("enough", [1, 256])
def test_close_but_unlike_lines_stay(spark, monkeypatch, enough):
    """Lines with many candidates that fail: their matches are found by comparing with all, or with the marked ones."""
    monkeypatch.setattr(line_dedup, "ENOUGH", enough)
    monkeypatch.setattr(line_dedup, "KEEP", 1)
    seen = []
    whole = line_dedup.find_all
    monkeypatch.setattr(line_dedup, "find_all", lambda *a: seen.append(1) or whole(*a))
    r = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(120):
        x = list(base)
        for at in r.sample(range(100), 11):
            x[at] = f"v{r.randrange(60)}"
        rows.append((i, " ".join(x)))
    df = spark.createDataFrame([(d, t, "s", 7, "x") for d, t in rows], DOCS)
    assert sorted((r.doc_id, r.text) for r in dedup(df).collect()) == kept(rows)
    assert seen


def test_edges(spark):
    long = " ".join(f"v{i}" for i in range(3000))
    rows = [(3, "a b c\n\na b c"), (1, "c b a"), (None, "a b c"), (4, None), (5, ""), (6, "\n\n"), (7, long), (8, long + " extra"), (9, "é ü\r\né ü"), (9, "é ü\r\né ü"), (9, "c b a\nanother text"), (2, "p q r s t"), (9, "p q r s t"), (9, "p q r s t\nx")]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    got = dedup(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got.collect()) == [(d, t or "") for d, t in kept(rows)]


def test_names_that_clash_and_ids_that_are_strings(spark):
    names = ["doc", "crc", "lines", "bits", "bucket", "id", "cell", "gone", "x.y"]
    rows = [(f"d{i}", t, *names) for i, t in enumerate(["one two three\nfour", "three two one", None, "five"])]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = {r.doc_id: r for r in dedup(df).collect()}
    assert dedup(df).columns == df.columns and all(tuple(r)[2:] == tuple(names) for r in got.values())
    assert sorted(got) == ["d0", "d1", "d2", "d3"] and got["d2"].text is None and got["d3"].text == "five"
    assert {got["d0"].text, got["d1"].text} in ({"four", "three two one"}, {"one two three\nfour", ""})


def test_many_lines_of_one_template_stay_small():
    """20,000 lines that differ in one word: no list of all pairs is held."""
    n, size = 20_000, 40
    e = np.zeros(n, line_dedup._entry(64))
    e["sig"], e["doc"], e["n"] = np.arange(n), np.arange(n), size
    e["bits"][:, 0] = np.uint64(1) << (np.arange(n) % 64).astype(np.uint64)
    tracemalloc.start()
    y, x, seen, marked = line_dedup.closest(e, 1, 0.8, 16, line_dedup.KEEP)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(set(y.tolist())) == n - 1 and (x < y).all() and (seen[y > 16] >= 16).all() and len(marked) and peak < 50e6


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert dedup(df).collect() == []
    assert removed_lines(df).collect() == []
