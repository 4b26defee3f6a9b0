"""Personal data in texts with many matches: context across blocks, time in proportion."""

import random
import re
import time

from pyspark.sql import functions as F

from argolith.llm import pii


def test_context_across_blocks(spark):
    """Scores of addresses in texts of several blocks, against a plain search of what lies before each match."""
    r = random.Random(4)
    between = [" ", "", ",", " host ", " the address is ", " näher: 𝔘 ", "x" * 39, " server" + "é" * 33, " server" + "é" * 34, "ip " * 30]
    texts = ["".join(f"{r.choice(between)} {r.randrange(300)}.{r.randrange(256)}.0.{r.randrange(9)}" for _ in range(n)) for n in (0, 1, 63, 64, 65, 128, 129, 400)]
    assert pii.BLOCK >= pii.CONTEXT_CHARS
    kind = next(k for k in pii.KINDS if k.name == "ip")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in pii.find(df).collect():
        text, want = texts[row.doc_id], []
        for m in re.finditer(kind.pattern, text):
            if all(int(x) < 256 for x in m[0].split(".")):
                lifted = re.search(kind.context, text[max(0, m.start() - pii.CONTEXT_CHARS) : m.start()], re.A)
                want.append((*m.span(), round(kind.score + 0.3 * bool(lifted), 6)))
        assert [(s.start, s.end, round(s.score, 6)) for s in row.pii if s.kind == "ip"] == want


def test_time_grows_with_matches(spark):
    """Twelve times the matches take less than six times as long, as planning takes its time too."""

    def seconds(n):
        text = " ".join(f"{k % 256}.{k // 256 % 256}.1.{k % 7}" for k in range(n))
        # A table, as rows of a plan would be worked on by the driver.
        df = spark.createDataFrame([(1, text)], "doc_id long, text string").cache()
        df.count()
        took = []
        for _ in range(2):
            began = time.time()
            assert df.select(F.size(pii.spans_of(F.col("text"))).alias("n")).first().n == n
            took.append(time.time() - began)
        df.unpersist()
        return min(took)

    few, many = seconds(10_000), seconds(120_000)
    assert many < 6 * few, (few, many)
