"""Operators on rows and parts of rows that they once left out."""

import itertools
import random

import corpus_pipeline

from argolith.llm import quality, toxicity


def shingle_set(text):
    w = (text or "").lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def test_near_dedup_stage_takes_shingles_alike(spark):
    r = random.Random(4)
    rows = []
    for g in range(30):
        base = [f"w{r.randrange(10_000)}" for _ in range(300)]
        rows.append((g * 10, " ".join(base)))
        for k in range(1, 4):  # from 0.97 to under 0.8 alike
            copy = list(base)
            for at in r.sample(range(300), 2 * k + g % 3):
                copy[at] = f"z{r.randrange(10_000)}"
            rows.append((g * 10 + k, " ".join(copy)))
    rows += [(400, None), (401, " "), (402, "one two"), (403, "One  two"), (None, "one two"), (404, "one two three")]
    sets = [shingle_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for _ in range(4):
        for a, b in itertools.combinations(range(len(rows)), 2):
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    ids = [i for i, _ in rows]
    want = {min(i for j, i in enumerate(ids) if label[j] == label[k] and i is not None) for k in range(len(rows))} | {None}
    got = [x.doc_id for x in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert set(got) == want and len(got) == len(want)


def test_toxicity_counts_words_over_all_training_rows(spark):
    # Of 400 toxic documents 20 hold a rare word; of the 40 that the gradient steps take, hardly one.
    rows = [(i, f"Plain words here. Some {'vile ' if i % 4 == 0 else ''}{'grim ' if i % 80 == 0 else ''}text {i % 7}.") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    assert {"vile", "grim"} <= set(toxicity.train(docs, labels, sample=40).weights)


def test_quality_sees_text_without_spaces_whole():
    clean = "天地玄黄宇宙洪荒" * 40
    junk = clean[:40] + "#@$%~^&*" * 35
    assert len(clean) == len(junk) and (quality.features(clean) != quality.features(junk)).any()
