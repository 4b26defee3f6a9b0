"""Hierarchical packing of documents into sequences of several context sizes.

Every document is encoded, ends with an end token, and gives up its full windows
first. What is left is routed to the smallest context size (tier) that holds it.
A tier packs its pieces into sequences of exactly its size where it can; gaps of
the longest windows are filled from the shorter tiers, cutting the last piece to
fit. Sequences join step groups of nearly equal size in tokens.

The work is done in one pass over each partition, without a shuffle: a task keeps
at most a few thousand waiting pieces, and leaves at most one sequence that is
padded. Sequence ids hold the number of the partition, so a task that runs again
gives the same ones.

Null text counts as empty: such a document is its end token alone. Repeated rows
are packed as often as they occur; null ids are kept; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship, sliced_by_size, table

TIERS = (2048, 1024, 512, 256)
END_ID = 1
#: Tokens that may wait in a task before they are packed.
WAITING_TOKENS = 1_000_000
#: Sequences of a step group, and of the tokens each group should hold.
STEP_SEQUENCES = 8
#: Characters of a slice of documents, so that each distinct word of many is looked up once.
SLICE_CHARS = 4_000_000
#: Words, and parts of words, that a worker remembers; of words, those that a slice holds more than once.
CACHE_WORDS = 400_000

#: Bytes of a text that make it one for the library: 1 surely, 2 with what follows.
_BYTES = np.zeros(256, np.uint8)
_BYTES[0x1C:0x20] = 1
_BYTES[0xCA:] = 1
_BYTES[[0xC2, 0xC4, 0xC9, 0xE2]] = 2
#: How the byte-level step writes bytes: printable ones as themselves, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_WRITTEN = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}


def _strings(words: pa.Array) -> list[str]:
    """The strings of an array that has no nulls, cut out of one."""
    size = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    whole = bytes(memoryview(words.buffers()[2] or b"")[ends[0] : ends[-1]]).decode()
    to = np.cumsum(size, dtype=np.int64)
    return [whole[a:b] for a, b in zip((to - size).tolist(), to.tolist())]


class WordTokenizer:
    """Same ids as the tokenizer file, remembering those of each word between white space.

    White space ends every token, so words are encoded apart from each other, and each distinct word
    of a slice once; a new word is split as the tokenizer's own pattern splits it, and the ids of its
    parts, which the tokenizer's model gives, are remembered too. That is done for texts in Latin
    script and common punctuation, which composition leaves alone; any other text, and any that holds
    a special token's string, goes to the library whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        spec = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        (pattern,) = (x["pattern"]["Regex"] for x in spec["pretokenizers"] if x["type"] == "Split")
        self.split = regex.compile(pattern).findall
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {"": b""}
        self.parts: dict[str, bytes] = {}

    def _part(self, part: str) -> bytes:
        written = part if part.isascii() else part.encode().decode("latin-1").translate(_WRITTEN)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(written)])

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of words."""
        if len(self.parts) > CACHE_WORDS:
            self.parts.clear()
        known, made, split = self.parts, self._part, self.split

        def of(part: str) -> bytes:
            if (x := known.get(part)) is None:
                x = known[part] = made(part)
            return x

        out = []
        for w in words:
            w = w.lower()
            # A word of letters, maybe with one mark after it, is what most are.
            if w.isalpha():
                out.append(of(w))
            elif w[-1] in ".,;:!?" and w[:-1].isalpha():
                out.append(of(w[:-1]) + of(w[-1]))
            else:
                out.append(b"".join(map(of, split(w))))
        return out

    def _alone(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Indices of the texts for the library."""
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: ends[-1]]
        at = np.flatnonzero(_BYTES[data[ends[0] :]]) + ends[0]
        kind, one, two = data[at], data[np.minimum(at + 1, len(data) - 1)], data[np.minimum(at + 2, len(data) - 1)]
        fine = (kind == 0xC2) & (one != 0x85) & (one != 0xA0) | (kind == 0xC4) & (one != 0xB0) | (kind == 0xC9) & (one < 0x90)
        fine |= (kind == 0xE2) & ((one == 0x80) & (two >= 0x90) & (two <= 0xA7) | (one == 0x82) & (two == 0xAC))
        found = [np.searchsorted(ends, at[~fine], "right") - 1]
        found += [np.flatnonzero(pc.match_substring(texts, x).to_numpy(zero_copy_only=False)) for x in self.special]
        return np.unique(np.concatenate(found))

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        odd = self.odd(texts)
        alone = list(zip(odd.tolist(), texts.take(pa.array(odd)).to_pylist()))
        if alone:
            mask = np.zeros(len(texts), bool)
            mask[odd] = True
            texts = pc.if_else(pa.array(mask), "", texts)
        words = pc.ascii_split_whitespace(texts)
        distinct = words.flatten().dictionary_encode()
        here = _strings(distinct.dictionary)
        if len(self.words) > CACHE_WORDS:
            self.words = {"": b""}
        ids = list(map(self.words.get, here))
        new = [i for i, x in enumerate(ids) if x is None]
        code = distinct.indices.to_numpy(zero_copy_only=False)
        words_ = [here[i] for i in new]
        often = (np.bincount(code, minlength=len(here))[new] > 1).tolist()
        for i, w, x, keep in zip(new, words_, self._learn(words_), often):
            ids[i] = x
            if keep:
                self.words[w] = x
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        start = np.cumsum(size) - size
        per_word = size[code]
        upto = np.concatenate(([0], np.cumsum(per_word)))
        kind = np.int32 if upto[-1] < 1 << 31 else np.int64
        at = np.repeat((start[code] - upto[:-1]).astype(kind), per_word)
        at += np.arange(len(at), dtype=kind)
        flat = np.frombuffer(b"".join(ids), "<u4")[at]
        ends = upto[words.offsets.to_numpy() - words.offsets[0].as_py()]
        out = [flat[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        for i, text in alone:
            out[i] = self._alone(text)
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class _Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int) -> None:
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[_Piece, _Piece]:
        return _Piece(self.doc, self.start, self.ids[: 4 * n], self.total), _Piece(self.doc, self.start + n, self.ids[4 * n :], self.total)


class Packer:
    """Packs pieces that come one after the other; emits finished sequences."""

    def __init__(self, tiers: tuple[int, ...] = TIERS) -> None:
        self.tiers = tuple(sorted(tiers, reverse=True))
        self.waiting: dict[int, list[_Piece]] = {t: [] for t in self.tiers}
        self.held = 0
        self.done: list[tuple[int, list[_Piece]]] = []

    def add(self, doc, ids: bytes) -> None:
        piece, window = _Piece(doc, 0, ids, len(ids) // 4), self.tiers[0]
        while len(piece) >= window:
            head, piece = piece.split(window)
            self.done.append((window, [head]))
        if len(piece):
            self._route(piece)

    def _route(self, piece: _Piece) -> None:
        tier = min(t for t in self.tiers if t >= len(piece))
        self.waiting[tier].append(piece)
        self.held += len(piece)

    def _take(self, want: int, below: int) -> _Piece | None:
        """A piece of at most want tokens from the tiers under `below`, longest tier first; cut if none fits whole."""
        for tier in self.tiers:
            if tier < below and (queue := self.waiting[tier]):
                piece = queue.pop()
                self.held -= len(piece)
                if len(piece) > want:
                    piece, rest = piece.split(want)
                    self._route(rest)
                return piece
        return None

    def pack(self, last: bool = False) -> None:
        """Packs what waits; what does not fill a sequence goes on waiting unless this is the last call."""
        for tier in self.tiers:
            queue = self.waiting[tier]
            while queue:
                first = queue.pop()
                self.held -= len(first)
                row, room = [first], tier - len(first)
                # Gaps are filled from shorter tiers, then by cutting a piece of this one.
                while room and (piece := self._take(room, tier) or self._take(room, tier + 1)):
                    row.append(piece)
                    room -= len(piece)
                if room:
                    for piece in row:
                        self._route(piece)
                    break
                self.done.append((tier, row))
        if last:
            rest = [p for t in self.tiers for p in self.waiting[t]]
            self.waiting = {t: [] for t in self.tiers}
            while rest:
                # Whole tiers first, as they need no padding; then the remainder as one padded sequence.
                have = sum(map(len, rest))
                size = max((t for t in self.tiers if t <= have), default=self.tiers[0])
                row, room = [], size
                while rest and room:
                    piece = rest.pop()
                    if len(piece) > room:
                        piece, left = piece.split(room)
                        rest.append(left)
                    row.append(piece)
                    room -= len(piece)
                self.done.append((size, row))

    def finished(self) -> list[tuple[int, list[_Piece]]]:
        out, self.done = self.done, []
        return out


_NAMES = ["start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "piece_ids"]
_TYPES = "start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, piece_ids binary"


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", step_sequences: int = STEP_SEQUENCES) -> DataFrame:
    """One row per piece: id, its place in its document and in its sequence, its ids (little-endian unsigned 32-bit).

    step_group: groups of sequences whose sums of tokens are nearly equal (a group takes longer windows and
    shorter ones in turn, each sequence going to the open group with the fewest tokens).
    """
    ship(docs.sparkSession)
    key = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, packer = tokenizer(tokenizer_path), Packer(tiers)
        base, made = TaskContext.get().partitionId() << 33, 0
        window, open_groups, groups = max(tiers), [0, 0], 0
        names = [base, base + 1]

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal made, groups
            out = packer.finished()
            for at in range(0, len(out), 1024):
                cols: list[list] = [[] for _ in range(9)]
                for tier, row in out[at : at + 1024]:
                    g = open_groups.index(min(open_groups))
                    open_groups[g] += sum(map(len, row))
                    group = names[g]
                    if open_groups[g] >= step_sequences * window:
                        groups += 1
                        open_groups[g], names[g] = 0, base + 1 + groups
                    offset = 0
                    for p in row:
                        for col, v in zip(cols, (p.doc, p.start, len(p), p.total, base + made, offset, tier, group, p.ids)):
                            col.append(v)
                        offset += len(p)
                    made += 1
                types = [id_type, *[pa.int64()] * 5, pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], ["id", *_NAMES])

        for part in sliced_by_size(batches, 1, SLICE_CHARS):
            id_type = part.schema.field(0).type
            for doc, ids in zip(part.column(0).to_pylist(), t.encode_all(part.column(1))):
                packer.add(doc, ids + end)
            if packer.held > WAITING_TOKENS:
                packer.pack()
            if len(packer.done) > 4096:
                yield from emit()
        packer.pack(last=True)
        if packer.done:
            yield from emit()

    return rows.mapInArrow(run, f"id {key}, {_TYPES}").withColumnRenamed("id", id_col)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("piece_ids")).drop("piece_ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return piece_digests(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group")
