"""The other operators against brute force, round trips and held-out labels."""

import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from argolith.llm import bpe, exact_dedup, langid, packing, pii, quality, simhash, topk, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, row string, votes string"
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "\n\t ", "one", "Hello  world, it's 3 o'clock — naïve café !", "中文 текст   x\x1c\x85y", "a" * 70_000, "word " * 20_000,
    "mail a.b+c@d-e.fr, b@x or c@d.e.f@g.hh then +1 (234) 555-7713 and +12 3", "ip 1.2.3.4 1.2.3.4.5 256.1.1.1 001.02.3.255 9.9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 0000000000000000",
    "iban GB82WEST12345698765432 and GB82WEST12345698765433", "your ssn is 123-45-6789", "1 2 3 " * 5_000, "<|endoftext|> ISTANBUL İ ß",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (4, "one")]
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def whole(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def ranks():
    import base64

    with open(MULTI, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_bpe_is_the_library(docs, empty):
    own = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(), special_tokens={})
    want = sorted((i or -1, np.asarray(own.encode_ordinary(t), "<u4").tobytes()) for i, t in whole(docs))
    for size, overlap in ((bpe.CHUNK_CHARS, bpe.OVERLAP_CHARS), (7, 12), (50, 4)):
        some = docs if size > 1000 else docs.filter("length(text) < 1000 or text is null")
        out = bpe.decode(bpe.encode(some, MULTI, chunk_chars=size, overlap_chars=overlap), MULTI).collect()
        got = sorted((r.doc_id or -1, bytes(r.ids)) for r in out)
        assert got == [w for w in want if size > 1000 or w in got] and len(got) == some.count()
        assert sorted(bytes(r.decoded) for r in out) == sorted(t.encode() for _, t in whole(some))
    assert bpe.encode(empty, MULTI).collect() == []


def test_stitching_of_any_text():
    c = bpe.codec(MULTI)
    r = random.Random(0)
    for _ in range(2000):
        t = "".join(r.choices(" \t\nab'sreé1,.中 ", k=r.randint(0, 40)))
        assert bpe.stitch(c, bpe.cut(t, r.choice([3, 5, 9]), r.choice([1, 8, 12]))) == c.encode(t)


def test_packing_is_a_partition_of_the_ids(docs, empty):
    lib = Tokenizer.from_file(WORDS)
    rows = packing.pack(docs, WORDS).collect()
    want = sorted((i or -1, np.asarray(lib.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()) for i, t in whole(docs))
    by_doc = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.length * 4 == len(r.piece_ids) > 0
        by_doc.setdefault(r.doc_id, []).append(r)
    got = []
    for i, ps in by_doc.items():
        if i == 4:  # a repeated row
            got += [(4, bytes(p.piece_ids)) for p in ps]
            continue
        assert [p.start for p in ps] == [0, *np.cumsum([p.length for p in ps])[:-1]]
        got.append((i or -1, b"".join(bytes(p.piece_ids) for p in ps)))
    if 0 in by_doc:
        got = [(-1 if i == 0 else i, x) for i, x in got]
    assert sorted(got) == sorted((-1 if i == 0 else i, x) for i, x in want)
    sums = {}
    for s, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        sums[s] = at
    assert max(sums.values()) <= 2048
    padded = [2048 - n for n in sums.values() if n & (n - 1)]
    assert len(padded) <= packing.pack(docs, WORDS).rdd.getNumPartitions()
    assert packing.pack(empty, WORDS).collect() == []


def test_words_encode_as_the_library_does():
    lib, own = Tokenizer.from_file(WORDS), packing.WordTokenizer(WORDS)
    r = random.Random(6)
    texts = ["hello <|endoftext|> there", "<|startoftext|>x", "<|ENDOFTEXT|> <| endoftext |>", "it's I'M he'll 'sx !'s 12½³ naïve—x", "a\xa0b\u3000c İ ß", *(t for t in TEXTS if t)]
    texts += ["".join(r.choices("ab'smtreLL 12½.,!?-_é\n\t<|>", k=r.randint(1, 60))) for _ in range(2000)]
    want = [np.asarray(lib.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode_all(pa.array(texts)) == want and [own.encode(t) for t in texts[:50]] == want[:50]
    assert lib.encode(texts[0], add_special_tokens=False).ids[1] == 49407


def luhn(d):
    return sum((int(c) * 2 - 9 * (int(c) > 4)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_spans_are_exact(spark, docs, empty):
    r = random.Random(5)
    made = ["".join(r.choices("a1.@+- 45()é😀" if k % 2 else "12.@4 -", k=60)) for k in range(400)]
    real = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(made + real)), "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    texts = sorted((a or -1, b or "") for a, b in whole(df))
    got = pii.find(df).collect()
    names = {"email", "ip", "card", "phone"}
    assert sorted((x.doc_id or -1, [(s.kind, s.start, s.end) for s in x.pii if s.kind in names]) for x in got) == sorted((i, base_spans(t)) for i, t in texts)
    assert pii.find(empty).collect() == []


def test_pii_checksums_context_and_masking(spark):
    texts = ["iban GB82WEST12345698765432 or GB82WEST12345698765433", "your ssn is 123-45-6789", "order 123-45-6789", "call +1 (234) 555-7713 or a@b.cc, 4111 1111 1111 1111", None, "plain"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    masked = [r.text for r in pii.mask(df).orderBy("doc_id").collect()]
    assert masked == ["iban [IBAN] or GB82WEST12345698765433", "your ssn is [SSN]", "order 123-45-6789", "call [PHONE] or [EMAIL], [CARD]", None, "plain"]


def test_exact_dedup(spark, empty):
    rows = [(1, "a b"), (2, "ab\n "), (3, "ab"), (4, None), (5, " "), (6, "x"), (7, "a b"), (None, "ab   "), (9, "ab\n ")]
    got = {r.doc_id: r for r in exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].keep_id for i in (1, 2, 3, 9)] == [None] * 4 and got[None].kept and got[1].group_size == 5
    assert got[4].keep_id == 5 and got[5].kept and not got[4].kept
    assert got[6].kept and got[6].group_size == 1 and got[7].group_size == 1
    assert got[6].text_sha256 == hashlib.sha256(b"x").hexdigest()
    # A filter that is full finds nothing out, and changes nothing.
    tiny = {r.doc_id: r for r in exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), filter_bits=2).collect()}
    assert tiny == got
    assert exact_dedup.classes(empty).collect() == []


def test_exact_dedup_of_heavy_groups_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LEAST_HEAVY", 5)
    monkeypatch.setattr(exact_dedup, "HEAVY_GROUPS", 10)
    r = random.Random(11)
    rows = [(i, r.choice(["a", "a ", " a", "b", "c c", f"d{i % 40}", f"e{i}", None])) for i in range(400)]
    df = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, row int, chars int, sha string")
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").replace(" ", ""), []).append((-len(t or ""), i))
    want = sorted((i, min(groups[key])[1], len(groups[key]), min(groups[key])[1] == i, hashlib.sha256(key.encode()).hexdigest()) for key, g in groups.items() for _, i in g)
    assert sorted(map(tuple, exact_dedup.classes(df).collect())) == want


def near_components(rows):
    fps = [(i, simhash.fingerprint(t or "")) for i, t in rows]
    label = list(range(len(fps)))
    for _ in fps:
        for a, b in itertools.combinations(range(len(fps)), 2):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= 4:
                label[a] = label[b] = min(label[a], label[b])
    out = []
    for k, (i, f) in enumerate(fps):
        ids = [fps[j][0] for j in range(len(fps)) if label[j] == label[k] and fps[j][0] is not None]
        out.append((i or -1, f, min(ids, default=None)))
    return sorted(out)


def test_fingerprint_by_definition():
    t = "The  quick\tBrown fox jumps over the lazy dog the quick brown fox"
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 4]), 42) for k in range(len(w) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(t) == want and simhash.fingerprint(" \n") == 0


def test_simhash_components(spark, docs, empty):
    r = random.Random(2)
    base = [" ".join(r.choices("abcdefghijklmnop", k=200)) for _ in range(4)]
    rows = [(100 + k, " ".join(w if r.random() > 0.004 else "zz" for w in r.choice(base).split())) for k in range(60)] + [(i, t) for i, t in enumerate(TEXTS[:7])] + [(None, "null id")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_copies(df).collect()
    assert sorted((x.doc_id or -1, x.fp % (1 << 64), x.component_id) for x in got) == near_components(rows)
    stay = {x.doc_id for x in simhash.keep_first(df).collect()}
    assert stay == {c for _, _, c in near_components(rows) if c is not None} | {None}
    assert simhash.near_copies(empty).collect() == []


def test_links_with_hot_lists_and_covering(spark):
    assert all(any(set(t) <= set(q) for t in simhash.POSITIONS) for q in itertools.combinations(range(8), 4))
    r = random.Random(3)
    fps = list({r.getrandbits(64) ^ 0 for _ in range(5)})
    fps = list({f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for f in fps for _ in range(40)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")

    def joined(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in fps}

    want = joined((a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4)
    for hot in (simhash.HOT_LIST, 4):
        assert joined((x.u % (1 << 64), x.v % (1 << 64)) for x in simhash.links(df, hot).collect()) == want


@pytest.mark.parametrize("scale", [1.0, 30.0])
def test_topk(spark, scale):
    r = np.random.default_rng(1)
    centres = r.normal(size=(5, 16))
    v = [(centres[k % 5] + r.normal(size=16) * (0.01 if k % 3 else 1)) * (scale ** (k % 4)) for k in range(500)]
    rows = [(k, [float(np.float32(x)) for x in y]) for k, y in enumerate(v)] + [(1000, None), (1100, [float("nan")] * 16), (1200, [None] * 16), (1300, [1.0] * 3), (1301, [2.0] * 3), (1400, []), (1500, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole_ = {k: [int(np.floor(1024 * x)) for x in y] for k, y in rows if y and None not in y and np.isfinite(y).all()}
    want = []
    for q in (k for k in whole_ if k % 100 == 0):
        s = sorted((-sum(a * b for a, b in zip(whole_[q], y)), k) for k, y in whole_.items() if k != q and len(y) == len(whole_[q]))[:10]
        want += [(q, n + 1, k, -x) for n, (x, k) in enumerate(s)]
    for size, queries in ((topk.BUCKET, topk.CELL_QUERIES), (64, 3)):
        got = topk.search(df.filter("vec_id % 100 = 0"), df, bucket=size, cell_queries=queries).collect()
        assert sorted(tuple(x) for x in got) == sorted(want)


def test_topk_sends_queries_only_where_they_can_matter(spark, monkeypatch):
    r = np.random.default_rng(4)
    v = [r.normal(size=8) * (100 if k % 10 == 0 else 1) for k in range(1000)]
    df = spark.createDataFrame([(k, [float(x) for x in y]) for k, y in enumerate(v)], "vec_id long, embedding array<double>")
    met, whole = [], topk.top
    monkeypatch.setattr(topk, "SEEDS", 50)
    c = topk._whole(df, "vec_id", "embedding")
    q = topk._seeded(c, c.orderBy(topk.F.desc("norm")).limit(50).collect(), 10).collect()
    ints = np.array([np.floor(1024 * x) for x in v])
    longest_of_short = max(np.sqrt((ints[k] ** 2).sum()) for k in range(1000) if k % 10)
    for x in q[:100]:
        scores = np.sort(np.delete(ints @ np.array(x.vec), x.id))[::-1]
        assert x.kth <= scores[9]
        met.append(x.kth > x.norm * longest_of_short)
    assert np.mean(met) > 0.9 and whole is topk.top


def test_language_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = langid.query(spark, sf).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    model = langid.train(spark.read.parquet(f"{sf}/documents.parquet"))
    for r in langid.predict(docs, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(map(str.isalpha, TEXTS[r.doc_id] or ""))) if r.doc_id is not None else True
    assert langid.train(docs.withColumn("lang", docs.id).filter("false")).langs == ()
    assert langid.predict(empty, model).collect() == []


def test_toxicity_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in toxicity.query(spark, sf).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    word = max(model.weights, key=model.weights.get)
    text = f"Of the and. The {word} {word}! And of."
    one = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = toxicity.locate(one, toxicity.Model({word: 20.0}, -9.0)).collect()
    assert [text[s.start : s.end].strip() for s in spans] == [f"The {word} {word}"]
    assert [r.doc_id for r in toxicity.keep_clean(one, toxicity.Model({word: 20.0}, -9.0)).collect()] == [2]
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, model).collect()) and toxicity.score(empty, model).collect() == []
    assert toxicity.train(d, labels.filter("false")) == toxicity.NO_MODEL


def test_quality_finds_junk(spark, docs, empty):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in quality.query(spark, sf).collect() if truth.get(r.doc_id) is not None]
    assert np.mean([r.keep for r in got if truth[r.doc_id]]) > 0.97
    assert np.mean([r.keep for r in got if not truth[r.doc_id]]) < 0.1
    model = quality.Model(np.zeros(quality.DIM), 0.0)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect()) and quality.score(empty, model).collect() == []
    assert not quality.train(empty).weights.any()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = spark.read.parquet(f"{SF}/documents.parquet")
    kept = d
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        if name != "packing":
            assert out.columns == d.columns
            assert {r.doc_id for r in out.collect()} <= {r.doc_id for r in kept.collect()}
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
    assert kept.groupBy().sum("length").first()[0] > 0
    assert corpus_pipeline.run(spark, SF).count() == kept.count()


def test_root_of_the_package_does_not_need_this_one():
    root = Path(__file__).parents[2] / "argolith"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "argolith.llm" not in p.read_text()
