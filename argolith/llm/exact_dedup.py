"""Exact dedup by two passes with a Bloom filter, built from Spark's own functions.

Texts are equal when they are identical after deleting white space ([ \\t-\\r]).
The first pass counts, for cells of a filter of BITS_PER_ROW bits a row, how many rows
fall into each. A task sends the cells it has hit and how often, some bytes a row and
never a text or a digest: of a filter much larger than a task's rows that is less than
the task's bitmap would be. Cells hit once hold no copy. The second pass looks every
row up in the bitmaps of the cells that were hit again, which have MAX_BITS / 8 bytes
at most: rows found there, and only they, are grouped by the digest of their text; all
others pass straight through. Beyond MAX_BITS more rows are found by chance; results
stay the same.

The groups' sums are formed before rows meet. Groups of more than one row in
HEAVY_GROUPS, of which there are fewer than HEAVY_GROUPS, come to their rows by
broadcast; the rows of other groups, each a small share, are joined with theirs.

Of equal texts the row with the most code points stays, then the one with the
smallest id. Null text counts as empty, and so equals texts of white space alone.
A null id loses to any other. Rows that repeat an id as well are one group each row
of which is reported; the first of them in no particular order is kept. An empty
table gives an empty result; columns other than id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, ship, table

BITS_PER_ROW = 16
#: Bits of the filter: 64 MB of bitmaps at most, whatever the input.
MIN_BITS, MAX_BITS = 1 << 20, 1 << 29
#: Groups of more than one row in so many are heavy, if they have LEAST_HEAVY rows.
HEAVY_GROUPS, LEAST_HEAVY = 10_000, 200
_WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _WHITE, "")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """(id, keep_id, group_size long, kept boolean, text_sha256 string) for each row."""
    ship(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    light = materialise(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.length(F.coalesce(text, F.lit(""))).alias("chars"),
            F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("sha"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    n = light.count()
    bits = filter_bits or min(max(MIN_BITS, 1 << (n * BITS_PER_ROW).bit_length()), MAX_BITS)
    cell = F.pmod(F.conv(F.substring(F.hex("sha"), 1, 15), 16, 10).cast("long"), F.lit(bits))
    number, place = (lambda c, f=f: F.call_function(f, c) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    # First pass. A bitmap of 32768 cells for each number of bucket, of those that two rows or more fall into.
    again = light.select(cell.alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = again.groupBy(number(F.col("cell")).alias("bucket")).agg(F.call_function("bitmap_construct_agg", place(F.col("cell"))).alias("bits"))
    # Second pass. The bitmaps have at most MAX_BITS / 8 bytes.
    probe = light.withColumn("cell", cell).withColumn("bucket", number(F.col("cell")))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bitmap_bit_position(cell) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_ = F.coalesce(F.call_function("getbit", byte, (place(F.col("cell")) % 8).cast("int")) == 1, F.lit(False))
    marked = probe.join(F.broadcast(found), "bucket", "left").select("id", "chars", "sha", "row", set_.alias("again"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    once = marked.filter(~F.col("again")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    some = materialise(marked.filter("again").drop("again"))
    best = materialise(
        some.groupBy("sha").agg(
            F.min(F.struct((-F.col("chars")).alias("less"), F.col("id").isNull().alias("none"), "id", "row")).alias("best"),
            F.count(F.lit(1)).cast("long").alias("group_size"),
        )
    )
    heavy = F.col("group_size") > max(LEAST_HEAVY, n // HEAVY_GROUPS)
    with_heavy = some.join(F.broadcast(best.filter(heavy)), "sha", "left")
    with_light = with_heavy.filter("best is null").select(*some.columns).join(best.filter(~heavy), "sha")
    result = ("id", F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), sha)
    many = with_heavy.filter("best is not null").select(*result).unionByName(with_light.select(*result))
    return once.unionByName(many).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         row_number() OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS k
  FROM t)
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM w
"""
