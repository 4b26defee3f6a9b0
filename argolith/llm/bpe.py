"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks that overlap. Each chunk is split into pre-tokens on its
own and its pieces are encoded; neighbouring chunks are stitched at the first
boundary that both report in their overlap, since the splitting from a common
boundary on is the same. Pieces do not depend on each other, so their ids are kept
as the chunk produced them. Texts of one chunk need no stitching and no shuffle;
chunks of longer texts are dealt over all tasks, so that one huge text does not
hold one of them up, and only they are shuffled.

Null text counts as empty (no ids). A row comes out for every row that goes in,
repeated rows included; other columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_slices, table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 1_024
#: Pieces remembered by a worker.
CACHE_PIECES = 400_000
#: A boundary this close to the end of a chunk may still move with the text that follows.
_LOOK_AHEAD = 8
# \s of the encoder's regular expressions is the White_Space property.
_SPACE = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


class _Pieces(dict):
    """Piece of text -> its ids as little-endian unsigned 32-bit integers; forgets all when full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = np.asarray(self.encode(piece), "<u4").tobytes()
        if len(self) >= CACHE_PIECES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Codec:
    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        own = tiktoken.Encoding("argolith", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = _Pieces(own.encode_ordinary)
        self.vocab = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.vocab[rank] = token
        explicit = pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]").replace(r"\S", f"[^{_SPACE}]")
        self.split = regex.compile(explicit).findall

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocab.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def chunk(self, start: int, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Boundaries within the whole text after each piece, bytes of ids up to each boundary, the ids."""
        pieces = self.split(text)
        ids = [self.pieces[p] for p in pieces]
        ends = start + np.cumsum(np.fromiter(map(len, pieces), np.int32, len(pieces)), dtype=np.int32)
        return ends, np.cumsum(np.fromiter(map(len, ids), np.int32, len(ids)), dtype=np.int32), b"".join(ids)


def stitch(codec: Codec, chunks: list[tuple[int, str]], encoded=None) -> bytes:
    """Ids of the text whose overlapping chunks are given as (start, text), in order of start."""
    encoded = encoded or [codec.chunk(start, text) for start, text in chunks]
    out: list[bytes] = []
    frm = 0  # a true boundary of the whole text: all before it is in out
    for k, (start, text) in enumerate(chunks):
        ends, upto, ids = encoded[k]
        stop = start + len(text)
        if k + 1 == len(chunks) and frm >= stop:
            break
        starts = np.concatenate(([start], ends))  # boundaries at which a piece of this chunk starts
        bytes_at = np.concatenate(([0], upto))
        at = np.searchsorted(starts, frm)
        if at == len(starts) or starts[at] != frm:
            # No common boundary in the overlap: split again from the last true boundary on.
            text = _between(chunks, frm, stop)
            ends, upto, ids = codec.chunk(frm, text)
            starts, bytes_at, at = np.concatenate(([frm], ends)), np.concatenate(([0], upto)), 0
        if k + 1 == len(chunks):
            out.append(ids[bytes_at[at] :])
            break
        sure = starts[at : np.searchsorted(starts, stop - _LOOK_AHEAD, "right")]
        if not len(sure):
            continue
        following = np.concatenate(([chunks[k + 1][0]], encoded[k + 1][0]))
        both = np.intersect1d(sure[sure >= chunks[k + 1][0]], following)
        to = both[0] if len(both) else sure[-1]
        out.append(ids[bytes_at[at] : bytes_at[np.searchsorted(starts, to)]])
        frm = int(to)
    return b"".join(out)


def _between(chunks: list[tuple[int, str]], a: int, b: int) -> str:
    got = ""
    for start, text in chunks:
        if (at := a + len(got)) < b and start <= at < start + len(text):
            got += text[at - start : b - start]
    return got


def cut(text: str, size: int, overlap: int) -> list[tuple[int, str]]:
    return [(a, text[a : a + size + overlap]) for a in range(0, max(len(text), 1), size)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit integers, n_tokens long) for each row."""
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    short = rows.filter(F.length("text") <= chunk_chars)
    long = rows.filter(F.length("text") > chunk_chars)

    def whole():
        c = codec(ranks_path)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [c.encode(x) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

        return f

    out = map_slices(short, whole, f"id {key}, ids binary, n_tokens long")

    # A long text's chunks, under a key of its row: ids may repeat.
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(chunk_chars))
    chunks = (
        long.withColumn("row", F.monotonically_increasing_id())
        .select("id", "row", "text", F.explode(starts).alias("start"))
        .select("id", "row", "start", F.col("text").substr(F.col("start") + 1, F.lit(chunk_chars + overlap_chars)).alias("text"))
        .repartition("row", "start")
    )

    def each():
        c = codec(ranks_path)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [c.chunk(start, text) for start, text in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            cols = [pa.array([x.tobytes() if isinstance(x, np.ndarray) else x for x in col], pa.binary()) for col in zip(*got)]
            return pa.RecordBatch.from_arrays([*b.columns, *cols], ["id", "row", "start", "text", "ends", "upto", "ids"])

        return f

    parts = map_slices(chunks, each, f"id {key}, row long, start int, text string, ends binary, upto binary, ids binary")

    def join(t: pa.Table) -> pa.Table:
        c = codec(ranks_path)
        t = t.sort_by("start")
        pieces = list(zip(t["start"].to_pylist(), t["text"].to_pylist()))
        encoded = [(np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), ids) for a, b, ids in zip(t["ends"].to_pylist(), t["upto"].to_pylist(), t["ids"].to_pylist())]
        ids = stitch(c, pieces, encoded)
        return pa.table({"id": t["id"].slice(0, 1).combine_chunks(), "ids": pa.array([ids], pa.binary()), "n_tokens": pa.array([len(ids) // 4], pa.int64())})

    out = out.unionByName(parts.groupBy("row").applyInArrow(join, f"id {key}, ids binary, n_tokens long"))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds decoded (binary): the concatenated bytes of the ids."""
    names = [*encoded.columns, "decoded"]
    at = encoded.columns.index(ids_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema) + ", decoded binary"

    def make():
        c = codec(ranks_path)
        return lambda b: pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else c.decode(x) for x in b.column(at).to_pylist()], pa.binary())], names)

    return map_slices(encoded, make, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out = decode(encode(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
