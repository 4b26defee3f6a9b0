"""Models against plain versions of their formulas, held-out labels, and operators on odd tables."""

import math
import random
import re
import time

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest

from argolith.llm import bpe, exact_dedup, langid, line_dedup, packing, pii, quality, shingle_dedup, simhash, toxicity

SF = "/root/testdata/sf0.001"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASHING = ["id", "row", "fp", "chars", "sha", "cell", "bucket", "bits", "crc", "lines", "gone", "pii", "stretches", "votes", "keep_id", "component_id", "x.y"]
TEXTS = [None, "", " \n", "one line\nanother line of text", "one line\nanother line of text", "mail a@b.cc now", "wordy " * 3000, "a\x00b", "émigré — 中文"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with null ids, repeated rows, odd texts, and columns whose names operators use."""
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (4, TEXTS[4]), (3, "one line\nanother line of text")]
    return spark.createDataFrame([(i, t, *CLASHING) for i, t in rows], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING))


KEEP_COLUMNS = {
    "line_dedup": line_dedup.dedup,
    "simhash": simhash.keep_first,
    "shingles": shingle_dedup.keep_first,
    "pii": pii.mask,
    "toxicity": lambda d: toxicity.keep_clean(d, toxicity.Model({"wordy": 0.5}, -3.0)),
}
ONE_ROW_EACH = {
    "bpe": lambda d: bpe.encode(d, MULTI),
    "exact": exact_dedup.classes,
    "simhash": simhash.near_copies,
    "pii": pii.find,
    "langid": lambda d: langid.predict(d, langid.Model(("en", "fr"), np.zeros((langid.DIM, 2), np.float32))),
    "quality": lambda d: quality.score(d, quality.Model(np.zeros(quality.DIM), 0.0)),
    "toxicity": lambda d: toxicity.score(d, toxicity.NO_MODEL),
}


@pytest.mark.parametrize("name", KEEP_COLUMNS)
def test_columns_stay_whatever_their_names(odd, name):
    got = KEEP_COLUMNS[name](odd)
    assert got.columns == odd.columns
    rows = got.collect()
    assert rows and all(tuple(r)[2:] == tuple(CLASHING) for r in rows) and any(r.doc_id is None for r in rows)
    none = KEEP_COLUMNS[name](odd.filter("false"))
    assert none.columns == odd.columns and none.collect() == []


@pytest.mark.parametrize("name", ONE_ROW_EACH)
def test_a_row_for_every_row(odd, name):
    rows = ONE_ROW_EACH[name](odd).collect()
    want = sorted(-1 if r.doc_id is None else r.doc_id for r in odd.collect())
    assert sorted(-1 if r[0] is None else r[0] for r in rows) == want
    assert ONE_ROW_EACH[name](odd.filter("false")).collect() == []


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd, WORDS).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in odd.collect()} and packing.pack(odd.filter("false"), WORDS).collect() == []


def test_stages_on_odd_tables(spark, odd):
    docs = odd.drop("x.y")
    for rows in (docs, docs.filter("false"), docs.filter("text is null")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            got = out.collect()
            if name != "packing":
                assert out.columns == rows.columns
                assert {r.doc_id for r in got} <= {r.doc_id for r in rows.collect()}
    kept = [r for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()]
    assert len(kept) == docs.count()


def test_near_copies_that_the_stage_finds(spark):
    """Recall of pairs at 0.8 or more, among documents that differ in a few words."""
    r = random.Random(8)
    rows, sets = [], []
    for g in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.choice([60, 200, 500]))]
        for k in range(3):
            copy = list(base)
            for at in r.sample(range(len(base)), k * len(base) // 60):
                copy[at] = f"z{r.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
            sets.append({tuple(copy[i : i + 5]) for i in range(len(copy) - 4)})
    alike = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    of = {x.id: x.component_id for x in shingle_dedup.near_copies(spark.createDataFrame(rows, "id long, text string"), "id").collect()}
    assert len(alike) > 40 and np.mean([of[i] == of[j] for i, j in alike]) == 1
    assert all(of[i] // 3 == i // 3 for i in of)


def test_held_out_toxicity_is_found_and_nothing_else(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in toxicity.query(spark, sf).collect() if r.held_out and truth.get(r.doc_id) is not None]
    found, called, real = sum(p and t for p, t in held), sum(p for p, _ in held), sum(t for _, t in held)
    assert real >= 50 and found / real > 0.7 and found / called > 0.95


def test_noisy_or_by_definition():
    m = toxicity.Model({"bad": 3.0, "awful": 2.0}, -4.0)
    text = "Good words here. Bad and awful words. Awful! Bad bad bad; end"
    p = [1 / (1 + math.exp(-(-4 + 3 * ("bad" in s) + 2 * ("awful" in s)))) for s in [set(re.findall(r"\w+", x)) for x in text.lower().split(".") for x in re.split("[!?]", x)] if s]
    assert m.score(text)[0] == pytest.approx(1 - math.prod(1 - x for x in p))
    assert list(m.sentence_scores(text)) == pytest.approx(p)


def test_noisy_or_is_fitted_to_its_likelihood():
    """No step in any direction makes the labels clearly likelier than the fitted model does."""
    r = random.Random(1)
    bags = [[[0] * (r.random() < 0.5) + [1] * (r.random() < 0.2) for _ in range(3)] for _ in range(60)]
    hits = [[s for s in b if s] for b in bags]
    y = np.array([float(any(1 in s for s in b)) if r.random() < 0.9 else 1.0 for b in bags])
    plain = np.array([3.0 - len(h) for h in hits])
    w, bias = toxicity._fit(y, np.ones(60), plain, hits, 2)

    def loss(v):
        out = 0.0
        for k, h in enumerate(hits):
            clean = plain[k] * math.log1p(math.exp(v[2])) + sum(math.log1p(math.exp(v[2] + sum(v[x] for x in s))) for s in h)
            out -= y[k] * math.log(max(-math.expm1(-clean), 1e-300)) - (1 - y[k]) * clean
        return out / 60

    best = loss([*w, bias])
    assert all(loss([w[0] + a, w[1] + b, bias + c]) > best - 0.02 for a in (-0.3, 0, 0.3) for b in (-0.3, 0, 0.3) for c in (-0.3, 0, 0.3))


def test_expectation_maximisation_over_documents():
    """Counts of patterns give what a loop over documents gives."""
    r = random.Random(3)
    n = len(quality.LABELLERS)
    docs = [tuple((1 if good else 0) if r.random() < 0.7 else r.choice((0, 1, quality.ABSTAIN)) for _ in range(n)) for good in (r.random() < 0.8 for _ in range(300))]
    counts = {}
    for v in docs:
        counts[quality.pattern(v)] = counts.get(quality.pattern(v), 0) + 1
    got = quality.posteriors(counts, rounds=5)
    acc, prior = [[0.3] * n, [0.97] * n], 0.8
    for _ in range(5):
        post = []
        for v in docs:
            like = [1 - prior, prior]
            for i, x in enumerate(v):
                if x != quality.ABSTAIN:
                    like = [like[0] * (acc[0][i] if x == 0 else 1 - acc[0][i]), like[1] * (acc[1][i] if x == 1 else 1 - acc[1][i])]
            post.append(like[1] / sum(like))
        for side in (0, 1):
            for i in range(n):
                w = [p if side else 1 - p for p in post]
                right = sum(a for a, v in zip(w, docs) if v[i] == side) + (1.94 if side else 0.6)
                cast = sum(a for a, v in zip(w, docs) if v[i] != quality.ABSTAIN) + 2
                acc[side][i] = min(max(right / cast, 0.8 if side else 0.02), 0.999)
        prior = min(max(sum(post) / len(post), 0.05), 0.98)
    assert all(got[quality.pattern(v)] == pytest.approx(p, abs=1e-9) for v, p in zip(docs, post))


def test_kernel_ridge_regression_by_kernels():
    """Scores by the folded matrix are those of kernels with the landmarks."""
    texts = {"en": ["the cat sat on the mat", "a dog and the house", "this is the way"], "fr": ["le chat est sur la table", "un chien et la maison", "voici le chemin"]}
    lang = [k for k, v in texts.items() for _ in v]
    held = np.stack([langid.presence(x) for v in texts.values() for x in v])
    m = langid.fit(lang, held, landmarks=2, ridge=0.1)
    sets = [set(np.flatnonzero(h).tolist()) for h in held]

    def kernel(a, b):
        return len(a & b) / math.sqrt(len(a) * len(b))

    marks = [0, 1, 3, 4]
    k_nm = np.array([[kernel(a, sets[j]) for j in marks] for a in sets])
    k_mm = np.array([[kernel(sets[i], sets[j]) for j in marks] for i in marks])
    target = np.array([[1.0 if x == y else -1.0 for y in ("en", "fr")] for x in lang])
    alpha = np.linalg.solve(k_nm.T @ k_nm + 0.1 * 6 * k_mm + 1e-6 * np.eye(4), k_nm.T @ target)
    new = langid.presence("the dog sat on a table")
    want = np.array([kernel(set(np.flatnonzero(new).tolist()), sets[j]) for j in marks]) @ alpha
    assert (new.astype(np.float32) @ m.matrix) / math.sqrt(new.sum()) == pytest.approx(want, abs=1e-3)


def test_many_languages_are_learned(spark):
    rows = [(k, chr(0x4E00 + 40 * lang) * 5 + f" {chr(0x4E01 + 40 * lang)}", f"l{lang:03}") for k, lang in enumerate([i % 90 for i in range(900)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.langs) == 90
    assert np.mean([r.lang_pred == f"l{r.doc_id % 90:03}" for r in langid.predict(docs, model).collect()]) == 1
    assert langid.training_rows(docs, per_lang=3).count() <= 270 and langid.training_rows(docs, sample=180).count() <= 180


def test_personal_data_beyond_the_base_kinds(spark):
    """Further kinds against a plain version, and masks that overlap, over made texts of many matches."""
    r = random.Random(12)
    bits = ["my ssn ", "123-45-6789", " token ", "abcdefghij0123456789abcdefXY", " iban ", "GB82WEST12345698765432", "GB82WEST12345698765433", " pay ", "4111 1111 1111 1111", "+1 234 555 7713", " mail ", "a@b.cc", " ", "\n", "x" * 60, " 10.0.0.1 "]
    texts = ["".join(r.choices(bits, k=r.choice([3, 20, 300]))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: [(s.kind, s.start, s.end) for s in x.pii] for x in pii.find(df).collect()}
    masked = {x.doc_id: x.text for x in pii.mask(df).collect()}

    def mod97(x):
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    for i, t in enumerate(texts):
        want = []
        for kind in pii.KINDS[4:]:
            for m in re.finditer(kind.pattern, t):
                if (kind.name != "iban" or mod97(m[0]) == 1) and kind.score + 0.3 * bool(re.search(kind.context, t[max(0, m.start() - 40) : m.start()])) >= 0.5:
                    want.append((kind.name, *m.span()))
        assert [s for s in got[i] if s[0] in ("iban", "ssn", "secret")] == want
        out, at, spans = "", 0, sorted((s, -e, k) for k, s, e in got[i])
        while spans:
            s, e, k = spans.pop(0)
            e = -e
            while spans and spans[0][0] < e:
                e = max(e, -spans.pop(0)[1])
            out, at = out + t[at:s] + f"[{k.upper()}]", e
        assert masked[i] == out + t[at:]


def test_a_megabyte_of_addresses(spark):
    text = " ".join(f"{k % 256}.{k // 256 % 256}.1.{k % 7}" for k in range(80_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.find(df).collect()
    took = time.time() - began
    assert len(text) > 800_000 and len(row.pii) == 80_000 and took < 20
    assert [(s.start, s.end) for s in row.pii[-3:]] == [m.span() for m in list(re.finditer(r"\S+", text))[-3:]]


def test_little_padding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(2)
    rows = packing.pack(docs, WORDS).groupBy("sequence_id").sum("length").collect()
    pads = [(-x["sum(length)"]) % 2048 if x["sum(length)"] & (x["sum(length)"] - 1) else 0 for x in rows]
    assert sum(pads) <= 2 * 2048 and sum(x > 0 for x in pads) <= 2
