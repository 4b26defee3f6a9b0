"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts their score.

Everything is built from Spark's own functions. Matches of one kind are the leftmost
non-overlapping ones; their places come from the lengths of the parts between them.
Spans are code points of the whole text, end exclusive.

Base kinds: email, ip (parts up to 255), card (Luhn), phone. Further kinds: iban
(mod-97), ssn and secret, which start from a lower score and are reported only where
a nearby context word lifts them to THRESHOLD. Base spans are always reported.

Null text counts as empty: no spans. Repeated rows come out as often as they go in,
null ids are kept, other columns are ignored by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, table

#: Code points before a span that are searched for context words.
CONTEXT_CHARS = 40
#: Matches that are placed one after the other; the work is in proportion to matches times BLOCK. At least
#: CONTEXT_CHARS, so that what a block matched and what lies between holds the context of the next one.
BLOCK = 64
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without a match of this has no span; it is cheap to look for.
    hint: str
    score: float
    context: str
    base: bool = True


# Look-behinds and possessive quantifiers leave the matches as they are and keep the time linear: a run of
# characters is tried once, from its start or, by \G, from the end of the match before.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, r"(?i)mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, r"(?i)\bip\b|address|host|server"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++", "", 0.8, r"(?i)card|credit|visa|pay"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, r"(?i)phone|call|tel|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", "", 0.6, r"(?i)iban|bank|account|konto", False),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", 0.3, r"(?i)ssn|social|security|insurance", False),
    Kind("secret", r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]{0,63}[0-9])[A-Za-z0-9_-]{24,64}(?![A-Za-z0-9_-])", "", 0.3, r"(?i)token|secret|password|passwd|api.?key", False),
)
_SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def _valid(kind: str, m: Column) -> Column | None:
    """The checksum or range test of a match."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return m.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "phone":
        return F.length(digits).between(8, 15)
    if kind == "card":
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), luhn(digits) == 0)
    if kind == "iban":
        return mod97(m) == 1
    return None


def luhn(digits: Column) -> Column:
    """The Luhn sum mod 10 of a string of digits."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = (F.ascii(digits.substr(i, F.lit(1))) - 48) * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x) % 10


def mod97(iban: Column) -> Column:
    """The remainder of an account number by ISO 7064: the first four characters moved to the end, A to Z as 10 to 35."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def step(a: Column, i: Column) -> Column:
        code = F.ascii(moved.substr(i, F.lit(1)))
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step)


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _blocks(xs: Column) -> Column:
    """An array cut into arrays of BLOCK."""
    at = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
    return F.when(F.size(xs) > 0, F.transform(at, lambda i: F.slice(xs, i * BLOCK + 1, F.lit(BLOCK)))).otherwise(F.slice(F.array(xs), 1, 0))


def _before(xs: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What the numbers before each come to, from 0 on."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(xs, start, lambda a, x: F.struct(add(a["at"], x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def _spans(text: Column, kind: Kind) -> Column:
    # Matches with what lies before each; lengths add up to places. As arrays that grow cost their size at each
    # step, matches are handled in blocks. A substring of the text would cost its distance from the start, so
    # the context of a block comes from the block before.
    def placed(block: Column, before: Column) -> Column:
        start = F.struct(before["at"].alias("at"), before["tail"].alias("tail"), F.array().cast("array<struct<m:string,start:int,end:int,near:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            frm = a["at"] + F.length(x["b"])
            to = frm + F.length(x["m"])
            near = F.right(F.concat(a["tail"], x["b"]), F.lit(CONTEXT_CHARS))
            span = F.struct(x["m"].alias("m"), frm.alias("start"), to.alias("end"), near.alias("near"))
            return F.struct(to.alias("at"), F.right(F.concat(near, x["m"]), F.lit(CONTEXT_CHARS)).alias("tail"), F.array_append(a["out"], span).alias("out"))

        return F.aggregate(block, start, step, lambda a: a["out"])

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda a, x: a + F.length(x["b"]) + F.length(x["m"]))

    def tail(block: Column) -> Column:
        return F.right(F.concat_ws("", F.transform(block, lambda x: F.concat(x["b"], x["m"]))), F.lit(CONTEXT_CHARS))

    def before(blocks: Column) -> Column:
        tails = F.slice(F.concat(F.array(F.lit("")), F.transform(blocks, tail)), 1, F.size(blocks))
        starts = _before(F.transform(blocks, length), lambda a, x: a + x)
        return F.zip_with(starts, tails, lambda at, tail: F.struct(at.alias("at"), tail.alias("tail")))

    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.split(text, kind.pattern, -1)
    pairs = _let(found, lambda f: F.zip_with(f, F.slice(between, 1, F.size(f)), lambda m, b: F.struct(m.alias("m"), b.alias("b"))))
    spans = _let(pairs, lambda p: _let(_blocks(p), lambda bs: F.flatten(F.zip_with(bs, before(bs), placed))))
    if _valid(kind.name, F.lit("")) is not None:
        spans = F.filter(spans, lambda s: F.coalesce(_valid(kind.name, s["m"]), F.lit(False)))

    def scored(s: Column) -> Column:
        score = F.when(s["near"].rlike(kind.context), F.least(F.lit(1.0), F.lit(kind.score + 0.3))).otherwise(F.lit(kind.score))
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    out = F.transform(spans, scored)
    if not kind.base:
        out = F.filter(out, lambda s: s["score"] >= THRESHOLD)
    has = F.contains(text, F.lit(kind.hint)) if kind.hint else F.lit(True)
    return F.when(has & text.rlike(kind.pattern), out).otherwise(F.array()).cast(_SPANS)


def spans_of(text: Column) -> Column:
    """All spans: array of (kind, start, end, score), by kind as listed in KINDS, then start."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_spans(text, k) for k in KINDS])


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pii: array of spans with scores) for each row."""
    return docs.select(F.col(f"`{id_col}`"), spans_of(F.col(f"`{text_col}`")).alias("pii"))


def merged(spans: Column) -> Column:
    """Stretches (start, end, kind) that spans cover, in order; of overlapping spans, the one that starts first (then the longest) names theirs."""

    def ahead(block: Column, to: Column) -> Column:
        start = F.struct(to.alias("to"), F.array().cast("array<struct<start:int,end:int,kind:string,before:int>>").alias("out"))

        def step(a: Column, s: Column) -> Column:
            end = -s["less"]
            own = F.struct(s["start"].alias("start"), end.alias("end"), s["kind"].alias("kind"), a["to"].alias("before"))
            return F.struct(F.greatest(a["to"], end).alias("to"), F.array_append(a["out"], own).alias("out"))

        return F.aggregate(block, start, step, lambda a: a["out"])

    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"))))

    def joined_up(seen: Column) -> Column:
        last = F.array_max(F.transform(seen, lambda s: s["end"]))

        def ends(fresh: Column) -> Column:
            to = F.concat(F.slice(F.transform(fresh, lambda s: s["before"]), 2, F.size(fresh)), F.array(last))
            return F.zip_with(fresh, to, lambda s, e: F.struct(s["start"].alias("start"), e.alias("end"), s["kind"].alias("kind")))

        # A span that starts where all before it have ended opens a stretch; what they reached is the end of the one before.
        return _let(F.filter(seen, lambda s: s["start"] >= s["before"]), ends)

    def far(block: Column) -> Column:
        return F.array_max(F.transform(block, lambda s: -s["less"]))

    seen = _let(_blocks_of(order), lambda bs: F.flatten(F.zip_with(bs, _before(F.transform(bs, far), lambda a, x: F.greatest(a, x)), ahead)))
    return _let(seen, joined_up)


def _blocks_of(xs: Column) -> Column:
    return _let(xs, _blocks)


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each stretch of spans replaced by its kind in brackets."""
    found, stretches = aside(docs, "pii", "stretches")
    text, many = F.col(f"`{text_col}`"), F.col(stretches)

    def cut(block: Column, i: Column) -> Column:
        frm = F.when(i == 0, F.lit(0)).otherwise(F.element_at(many, F.greatest(i * BLOCK, F.lit(1)))["end"])

        def pieces(part: Column) -> Column:
            def piece(s: Column, k: Column) -> Column:
                before = F.when(k == 0, frm).otherwise(F.element_at(block, F.greatest(k, F.lit(1)))["end"])
                return F.concat(part.substr(before - frm + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

            return F.concat_ws("", F.transform(block, piece))

        return _let(text.substr(frm + 1, F.element_at(block, -1)["end"] - frm), pieces)

    tail = text.substr(F.element_at(many, -1)["end"] + 1, F.length(text))
    masked = F.concat(F.concat_ws("", F.transform(_blocks(many), cut)), tail)
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*own, spans_of(text).alias(found)).select(*own, F.when(F.size(found) > 0, merged(F.col(found))).alias(stretches))
    return out.withColumn(text_col, F.when(many.isNull(), text).otherwise(masked)).select(*own)


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    only = F.filter("pii", lambda s: s["kind"].isin(base))
    return found.select("doc_id", *map(count, base), F.sha2(joined(only).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
