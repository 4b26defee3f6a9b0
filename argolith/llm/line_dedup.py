"""Line dedup: an exact set-similarity join of lines; of lines that match, the later ones are removed.

A line is the set of its words (split at ASCII white space). Lines match when the
Jaccard similarity of their sets is SIMILARITY or more; a line is removed when it
matches a line that comes earlier in the order of (doc_id, line number).

1. Words are counted over all documents, in COUNTERS hashed counters, of which the
   logarithm is kept: the order by rarity. Any order of words that all lines agree on
   keeps the join exact.
2. Lines with equal sets (128 bits of signature) form a class led by its earliest
   line; the others go. A line emits the prefix of its words in that order: two sets
   of the needed similarity share a word in their prefixes. A word of more than
   HOT_WORD occurrences is emitted together with each other word of a prefix that is
   longer by one: matching sets share two words of those. Lines that meet pass the
   length and the positional filter and a comparison of parity bits of their words,
   whose number of differences is at most the sets' difference. All of these keep
   every match.
3. A line needs one earlier match only, so where lines meet each reports the KEEP
   closest of the first ENOUGH candidates it finds; the others it saw are marked. What
   was reported is verified on the lines' texts. Lines that find no match so, though
   there were more candidates, are compared with all lines that they meet, on whole
   sets of words (64-bit hashes): with the marked ones, or with all of the texts where
   ENOUGH were seen.

Data of these steps move in packed blocks, so that shuffling costs no work for each
row; the number of parts follows from the number of words. Copies of a class are
merged in each slice, and again in a part whenever COMPACT bytes have come together,
so a line that a third of all documents share is a few rows. Words and pairs of words
that still have more than HOT_WORD lines are dealt over the pairs of blocks of lines.

Null text counts as empty and stays null. Lines without words never match and stay.
Rows whose id is null take no part and stay as they are. Rows that repeat an id are
told apart by a 64-bit hash of their text; lines of equal id and number do not remove
each other. Ids that are not integers are ordered by their 64-bit hash. All columns
are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argolith.session import ship

from .common import aside, materialise, parts_for, sliced_by_size, table

SIMILARITY = 0.8
COUNTERS = 1 << 22
#: Characters of a slice of documents.
SLICE_CHARS = 2_000_000
#: Bytes of words that are hashed all at once.
LONG_WORD = 64
#: Lines that share a word and are compared in one task.
HOT_WORD = 50_000
#: Candidates after which a line stops looking for others at a word, and how many of them it reports.
ENOUGH, KEEP = 4_096, 2
#: Bytes of a part that are expected, and after which copies in it are merged.
PART, COMPACT = 32_000_000, 64_000_000
#: Bits of the filters for lines and words that are looked for again: some for each of them, 32 MB at most.
BITS_EACH, MIN_BITS, MAX_BITS = 16, 1 << 18, 1 << 28
#: Largest number of words and number of parity bits, by class of length.
CLASSES = ((64, 64), (160, 128), (352, 256), (768, 512), (1 << 31, 1024))
#: Lines of so many words at most have their hot words paired.
PAIRED = 352
_CHUNKS = 16
_AT_ONCE = 1 << 15
_LOW = (1 << 40) - 1
#: Steps of the logarithm of a count.
_STEPS = 5
_AT = np.dtype([("doc", "<i8"), ("line", "<u4")])
_LINE = np.dtype([*_AT.descr, ("crc", "<u8")])
_COUNT = np.dtype([("at", "<u4"), ("n", "<i8")])
_SIGNED = np.dtype([("s1", "<u8"), ("s2", "<u8"), *_LINE.descr])
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_HOT = np.uint64(1 << 32)


def _entry(bits: int) -> np.dtype:
    """A key of a line's prefix. The part it is in goes with the word; sig: half of the signature of the class."""
    size = "<u2" if bits < CLASSES[-1][1] else "<u4"
    return np.dtype([("word", "<u4"), ("sig", "<u8"), *_AT.descr, ("n", size), ("pos", size), ("bits", "<u8", (bits // 64,))])


def packed(rows: np.ndarray) -> bytes:
    """Column after column, each in as few bytes a number as its largest takes."""
    head, body = [len(rows).to_bytes(8, "little")], []
    for f in rows.dtype.names:
        x = rows[f]
        kind = np.min_scalar_type(int(x.max())) if len(x) and int(x.min()) >= 0 else x.dtype
        head.append(kind.str.encode().ljust(4))
        body.append(x.astype(kind).tobytes())
    return b"".join(head + body)


def unpacked(block: bytes, kind: np.dtype) -> np.ndarray:
    n, at = int.from_bytes(block[:8], "little"), 8 + 4 * len(kind.names)
    out = np.empty(n, kind)
    for k, f in enumerate(kind.names):
        x = np.frombuffer(block, block[8 + 4 * k : 12 + 4 * k].decode().strip(), offset=at, count=out[f].size)
        out[f] = x.reshape(out[f].shape)
        at += x.nbytes
    return out


def deal(rows: np.ndarray, to: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    """(part, packed rows) for each part that gets rows."""
    order = np.argsort(to, kind="stable")
    rows, ends = rows[order], np.cumsum(np.bincount(to, minlength=parts))
    for p, (a, b) in enumerate(zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist())):
        if b > a:
            yield p, packed(rows[a:b])


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(ids, texts) of slices of documents."""
    for part in sliced_by_size(batches, 1, SLICE_CHARS):
        yield part.column(0).to_numpy(zero_copy_only=False), part.column(1)


def hash_of(words: pa.Array) -> np.ndarray:
    """FNV-1a of each word, mixed; byte by byte over all words at once, but for long ones."""
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    start = np.frombuffer(words.buffers()[1], np.int64 if pa.types.is_large_string(words.type) else np.int32)[words.offset :][: len(words)].astype(np.int64)
    order = np.argsort(-size, kind="stable")
    start, length = start[order], size[order]
    h = np.full(len(words), 0xCBF29CE484222325, np.uint64)
    for k in range(min(int(length.max(initial=0)), LONG_WORD)):
        n = int(np.searchsorted(-length, -k, "left"))
        h[:n] = (h[:n] ^ data[start[:n] + k]) * np.uint64(0x100000001B3)
    for i in range(int(np.searchsorted(-length, -LONG_WORD, "left"))):
        h[i] = xxhash.xxh64_intdigest(words[int(order[i])].as_py())
    out = np.empty(len(words), np.uint64)
    out[order] = _mixed(_mixed(h, 0xFF51AFD7ED558CCD), 0xC4CEB9FE1A85EC53)
    return out


def _mixed(h: np.ndarray, by: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def _counter(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(COUNTERS - 1)).astype(np.int64)


def level(count) -> np.ndarray:
    """0 for words that occur once, else a logarithm of the count."""
    count = np.asarray(count, np.float64)
    return np.where(count > 1, 1 + np.floor(_STEPS * np.log2(np.maximum(count, 1)) + 1e-9), 0).astype(np.uint8)


def _at_most(levels: np.ndarray) -> np.ndarray:
    """The largest count of a level."""
    return np.ceil(2.0 ** (levels.astype(np.float64) / _STEPS)).astype(np.int64)


class Lines:
    """The lines of a slice that have words, each as its distinct words in the order of rarity."""

    def __init__(self, place: np.ndarray, flat: pa.Array, levels: np.ndarray) -> None:
        words = pc.ascii_split_whitespace(flat)
        d = words.flatten().dictionary_encode()
        known, code = hash_of(d.dictionary), d.indices.to_numpy(zero_copy_only=False)
        blank = pc.equal(d.dictionary, "").to_numpy(zero_copy_only=False)
        rarity = levels[_counter(known)]
        order = np.lexsort((known, rarity))
        dense = np.empty(len(order), np.int64)
        dense[order] = np.arange(len(order))
        per_line = np.diff(words.offsets.to_numpy())
        key = (np.repeat(np.arange(len(per_line), dtype=np.int64), per_line) << 32) | dense[code]
        key = key[~blank[code]]
        key.sort()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
        line, word = key >> 32, order[key & 0xFFFFFFFF]
        self.hash, self.level = known[word], rarity[word]
        new = np.ones(len(line), bool)
        new[1:] = line[1:] != line[:-1]
        self.start = np.flatnonzero(new)
        self.n = np.diff(np.concatenate((self.start, [len(line)])))
        self.of = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(len(line)) - np.repeat(self.start, self.n)
        self.own = np.zeros(len(per_line), bool)
        self.own[line[self.start]] = True
        self.place = place[line[self.start]]

    def __len__(self) -> int:
        return len(self.n)

    def signatures(self) -> tuple[np.ndarray, np.ndarray]:
        if not len(self):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.add.reduceat(_mixed(self.hash, by), self.start) for by in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))

    def parities(self, some: np.ndarray, bits: int) -> np.ndarray:
        """For each of some lines, parities of the numbers of words that fall on each bit."""
        row = np.full(len(self), -1)
        row[some] = np.arange(len(some))
        at = row[self.of]
        h, at = self.hash[at >= 0], at[at >= 0]
        bit = (h >> np.uint64(7)).astype(np.int64) % bits
        if bits == 64:
            return np.bitwise_xor.reduceat(np.uint64(1) << bit.astype(np.uint64), np.flatnonzero(np.diff(at, prepend=-1))).reshape(-1, 1)
        flips = np.bincount(at * bits + bit, minlength=len(some) * bits)
        return np.packbits((flips & 1).astype(np.uint8).reshape(-1, bits), axis=1, bitorder="little").view("<u8")

    def keys(self, some: np.ndarray, sig: np.ndarray, kind: int, t: float, hot_word: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, key, position) of all keys under which some lines (a mask) meet others in a class of length."""
        short = prefix(self.n, t)
        hot_level = int(level(hot_word)) + 1
        mine = np.flatnonzero(some[self.of] & (self.pos < short[self.of]) & (self.level > 0))
        hot = self.level[mine] >= hot_level
        salt = _salt(kind)
        line, key, pos, size = ([x] for x in (self.of[mine[~hot]], word_key(self.hash[mine[~hot]], kind), self.pos[mine[~hot]], np.zeros(int((~hot).sum()), np.int64)))
        i = mine[hot]
        if len(i) and CLASSES[kind][0] <= PAIRED:
            # Each other word of the prefix that is longer by one; a pair of two such words once.
            long = np.minimum(short + 1, self.n)[self.of[i]]
            i = np.repeat(i, long)
            j = np.arange(len(i)) - np.repeat(np.cumsum(long) - long, long) + self.start[self.of[i]]
            twice = (self.level[j] >= hot_level) & (self.pos[j] < short[self.of[j]]) & (j < i)
            ok = (j != i) & (self.level[j] > 0) & ~twice
            i, j = i[ok], j[ok]
            line.append(self.of[i])
            key.append(_mixed(_mixed(self.hash[i] + self.hash[j] + salt, 0xFF51AFD7ED558CCD), 0xD6E8FEB86659FD93) | _HOT)
            pos.append(np.minimum(self.pos[i], self.pos[j]))
            size.append(np.minimum(_at_most(self.level[i]), _at_most(self.level[j])))
        elif len(i):
            line.append(self.of[i])
            key.append(word_key(self.hash[i], kind) | _HOT)
            pos.append(self.pos[i])
            size.append(_at_most(self.level[i]))
        line, key, pos, size = map(np.concatenate, (line, key, pos, size))
        blocks = -(-size // hot_word)
        if not (blocks > 1).any():
            return line, key, pos
        # Still hot: a line goes to the cells of its block with each block.
        blocks = np.maximum(blocks, 1)
        at = np.repeat(np.arange(len(line)), blocks)
        g = blocks[at].astype(np.uint64)
        other = (np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)).astype(np.uint64)
        own = _mixed(sig[line[at]], 0xC4CEB9FE1A85EC53) % g
        cell = np.minimum(own, other) * g + np.maximum(own, other)
        return line[at], np.where(g > 1, _mixed(key[at] + (cell + np.uint64(1)) * _GOLD, 0xFF51AFD7ED558CCD) | _HOT, key[at]), pos[at]


def _salt(kind: int) -> np.uint64:
    return np.uint64((kind + 1) * int(_GOLD) % (1 << 64))


def word_key(h: np.ndarray, kind: int) -> np.ndarray:
    """The key of a word that is not hot in a class of length; keys that have to do with hot words have the bit _HOT."""
    return _mixed(h + _salt(kind), 0xD6E8FEB86659FD93) & ~_HOT


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(document, number in it, text) of each line."""
    lines = pc.split_pattern(texts, "\n")
    per_doc = np.diff(lines.offsets.to_numpy())
    number = np.arange(int(per_doc.sum())) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    return np.repeat(np.arange(len(per_doc)), per_doc), number, lines.flatten()


def _lines_of(ids: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(places, texts) of all lines."""
    doc, number, flat = _split(texts)
    place = np.zeros(len(doc), _LINE)
    place["doc"], place["line"] = ids[doc], number
    place["crc"] = np.array([xxhash.xxh64_intdigest(x, 42) for x in texts.cast(pa.binary()).to_pylist()], np.uint64)[doc]
    return place, flat


def _cell(place: np.ndarray) -> np.ndarray:
    """The bit that a line falls on in the largest filter; smaller ones take the lower part of its number."""
    return (_mixed(_mixed(place["doc"].astype(np.int64).view(np.uint64) * _GOLD + place["line"], 0xFF51AFD7ED558CCD), 0xC4CEB9FE1A85EC53) & np.uint64(MAX_BITS - 1)).astype(np.int64)


def _word_cell(word: np.ndarray, part) -> np.ndarray:
    return (_mixed((word.astype(np.uint64) << np.uint64(32)) + np.asarray(part, np.uint64), 0xFF51AFD7ED558CCD) & np.uint64(MAX_BITS - 1)).astype(np.int64)


def _in(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    cell = cell & (8 * len(bits) - 1)
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8) & 1).astype(bool)


def prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def count_words(rows: DataFrame) -> tuple[np.ndarray, int]:
    """The levels of the hashed counters, and the number of words, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for _, texts in slices(batches):
            d = pc.ascii_split_whitespace(texts).flatten().dictionary_encode()
            np.add.at(total, _counter(hash_of(d.dictionary)), np.bincount(d.indices.to_numpy(zero_copy_only=False), minlength=len(d.dictionary)))
        size = COUNTERS // _CHUNKS
        for k in range(_CHUNKS):
            at = np.flatnonzero(total[k * size : (k + 1) * size])
            if len(at):
                block = np.zeros(len(at), _COUNT)
                block["at"], block["n"] = at, total[k * size + at]
                yield _record(["chunk", "block"], [pa.array([k], pa.int32()), pa.array([packed(block)])])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, block in zip(*(c.to_pylist() for c in b.columns)):
                some = unpacked(block, _COUNT)
                total.setdefault(k, np.zeros(COUNTERS // _CHUNKS, np.int64))[some["at"]] += some["n"]
        yield _record(["chunk", "levels", "n"], [pa.array(list(total), pa.int32()), pa.array([level(c).tobytes() for c in total.values()], pa.binary()), pa.array([int(c.sum()) for c in total.values()], pa.int64())])

    levels, n = np.zeros(COUNTERS, np.uint8).reshape(_CHUNKS, -1), 0
    for r in rows.mapInArrow(count, "chunk int, block binary").repartition(_CHUNKS, "chunk").mapInArrow(add, "chunk int, levels binary, n long").collect():  # a byte for each counter
        levels[r["chunk"]] = np.frombuffer(r["levels"], np.uint8)
        n += r["n"]
    return levels.reshape(-1), n


def _record(names: list[str], cols: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, names)


def _classes(n: np.ndarray, t: float) -> Iterator[tuple[int, np.ndarray]]:
    """(class of length, mask of the lines in it): a pair is compared in the class of its longer line."""
    lo = 0
    for kind, (hi, _) in enumerate(CLASSES):
        some = (n <= hi) & (n >= math.ceil(t * (lo + 1) - 1e-9)) & (np.floor(n / t + 1e-9) > n)
        if some.any():
            yield kind, some
        lo = hi


def _blocks(lines: Lines, parts: int, t: float, hot_word: int) -> Iterator[tuple[int, int, bytes]]:
    """(part, kind, packed rows): kind -2 lines that go, -1 classes, else a class of length."""
    s1, s2 = lines.signatures()
    signed = np.zeros(len(lines), _SIGNED)
    signed["s1"], signed["s2"] = s1, s2
    for f in _LINE.names:
        signed[f] = lines.place[f]
    lead, gone = _leaders(signed)
    if len(gone):
        yield int(gone[0]) % parts, -2, packed(lines.place[gone])
    for p, block in deal(signed[lead], (s1[lead] % np.uint64(parts)).astype(np.int64), parts):
        yield p, -1, block
    mine = np.zeros(len(lines), bool)
    mine[lead] = True
    for kind, some in _classes(lines.n, t):
        of, key, pos = lines.keys(some & mine, s1, kind, t, hot_word)
        if not len(of):
            continue
        some, bits = np.unique(of), CLASSES[kind][1]
        row = np.zeros(len(lines), np.int64)
        row[some] = np.arange(len(some))
        e = np.zeros(len(of), _entry(bits))
        e["word"], e["sig"], e["n"], e["pos"], e["bits"] = key >> np.uint64(32), s1[of], lines.n[of], pos, lines.parities(some, bits)[row[of]]
        for f in _AT.names:
            e[f] = lines.place[f][of]
        for p, block in deal(e, (key % np.uint64(parts)).astype(np.int64), parts):
            yield p, kind, block


def _leaders(signed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first line of each class, with those of equal id and number in other rows; indices of the lines after it."""
    order = np.lexsort((signed["crc"], signed["line"], signed["doc"], signed["s2"], signed["s1"]))
    s = signed[order]
    new = np.ones(len(s), bool)
    new[1:] = (s["s1"][1:] != s["s1"][:-1]) | (s["s2"][1:] != s["s2"][:-1])
    lead = s[np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))]
    same = (s["doc"] == lead["doc"]) & (s["line"] == lead["line"])
    other = new.copy()
    other[1:] |= s["crc"][1:] != s["crc"][:-1]
    return order[same & other], order[~same]


def _merged(e: np.ndarray) -> np.ndarray:
    """Indices of the first line of each class at a word, by word, then by number of words."""
    # Sixteen bits of the signature bring copies together; should others get between them, copies stay, which does no harm.
    order = np.argsort((e["word"].astype(np.uint64) << np.uint64(32)) | (np.minimum(e["n"], 65535).astype(np.uint64) << np.uint64(16)) | (e["sig"] >> np.uint64(48)), kind="stable")
    word, sig, n = e["word"][order], e["sig"][order], e["n"][order]
    new = np.ones(len(order), bool)
    new[1:] = (word[1:] != word[:-1]) | (sig[1:] != sig[:-1]) | (n[1:] != n[:-1])
    if new.all():
        return order
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    at, of = order[many], run[many]
    at = at[np.lexsort((e["line"][at], e["doc"][at], of))]
    of = np.sort(of)
    out = order[new]
    out[of[np.flatnonzero(np.diff(of, prepend=-1))]] = at[np.flatnonzero(np.diff(of, prepend=-1))]
    return out


def closest(e: np.ndarray, shortest: int, t: float, enough: int, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, seen, marked): at each word, for each line the closest of the candidates found and how many there were; candidates that were not the closest. As indices into e, which is in the order of _merged."""
    word, sizes = e["word"], np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(e) else sizes
    sizes = np.diff(np.concatenate((new, [len(e)])))
    own = np.flatnonzero(np.repeat(sizes > 1, sizes))
    sizes = sizes[sizes > 1]
    end = np.repeat(np.cumsum(sizes), sizes)
    begin = end - np.repeat(sizes, sizes)
    n, pos, doc, line = (e[f][own].astype(np.int64) for f in ("n", "pos", "doc", "line"))
    bits = np.ascontiguousarray(e["bits"][own])
    best, seen = np.full((keep, len(own)), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)

    none, marked = np.iinfo(np.int64).max, np.zeros(len(own), bool)

    def insert(b: np.ndarray, got: np.ndarray) -> None:
        """Each b at most once."""
        for k in range(keep):
            best[k, b], got = np.minimum(best[k, b], got), np.maximum(best[k, b], got)
        marked[got[got < none] & _LOW] = True

    for way in (-1, 1):
        y, lag = np.arange(len(own)), 1
        while len(y):
            # Few lines that are left look at many others at once.
            step = max(1, _AT_ONCE // len(y))
            b = np.repeat(y, step)
            a = b + way * np.tile(np.arange(lag, lag + step), len(y))
            ok = a >= begin[b] if way < 0 else a < end[b]
            a = np.where(ok, a, b)
            ok &= n[a] >= t * n[b] - 1e-9 if way < 0 else n[b] >= t * n[a] - 1e-9
            on = ok[step - 1 :: step]
            ok &= (doc[a] < doc[b]) | (doc[a] == doc[b]) & (line[a] < line[b])
            a, b = a[ok], b[ok]
            need = np.ceil(t / (1 + t) * (n[a] + n[b]) - 1e-9).astype(np.int64)
            ok = (np.maximum(n[a], n[b]) >= shortest) & (np.minimum(pos[a], pos[b]) + np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need)
            a, b, need = a[ok], b[ok], need[ok]
            apart = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
            ok = apart <= n[a] + n[b] - 2 * need
            b, got = b[ok], (apart[ok] << 40) | a[ok]
            if step == 1:
                seen[b] += 1
                insert(b, got)
            elif len(b):
                order = np.lexsort((got, b))
                b, got = b[order], got[order]
                first = np.flatnonzero(np.diff(b, prepend=-1))
                many = np.diff(np.concatenate((first, [len(b)])))
                seen[b[first]] += many
                place = np.arange(len(b)) - np.repeat(first, many)
                for k in range(keep):
                    insert(b[place == k], got[place == k])
                marked[got[place >= keep] & _LOW] = True
            y = y[on & (seen[y] < enough)]
            lag += step
    k, y = np.nonzero(np.arange(keep)[:, None] < seen)
    got = best[k, y]
    return own[y], own[got & _LOW], seen[y], own[marked]


_KEY, _Y = ("doc", "crc", "line"), ("doc", "line", "sig")
_X = tuple(f"x_{k}" for k in _Y)
_PAIR = (*_Y, *_X)
_FOUND = "doc long, line long, sig long, x_doc long, x_line long, x_sig long, crc long, seen int, cell int, x_cell int"
_FOUND_NAMES = [c.split()[0] for c in _FOUND.split(", ")]
_FOUND_TYPES = [pa.int64()] * 7 + [pa.int32()] * 3


def _found(n: int, **cols: np.ndarray) -> pa.RecordBatch:
    return _record(_FOUND_NAMES, [pa.array(np.ascontiguousarray(cols[c]).astype(np.int64) if k == pa.int64() else cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(_FOUND_NAMES, _FOUND_TYPES)])


def _equal(place: np.ndarray) -> pa.RecordBatch:
    return _found(len(place), doc=place["doc"], line=place["line"], crc=place["crc"])


def _near(e: np.ndarray, y: np.ndarray, x: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
    """A pair that meets at several words of a part is told once, with the most candidates that its line has seen."""
    order = np.lexsort((-seen, e["sig"][x], e["sig"][y]))
    y, x, seen = y[order], x[order], seen[order]
    new = np.ones(len(y), bool)
    new[1:] = (e["sig"][y][1:] != e["sig"][y][:-1]) | (e["sig"][x][1:] != e["sig"][x][:-1])
    later, earlier, seen = e[y[new]], e[x[new]], seen[new]
    return _found(
        len(later), doc=later["doc"], line=later["line"], sig=later["sig"].view(np.int64), x_doc=earlier["doc"], x_line=earlier["line"], x_sig=earlier["sig"].view(np.int64),
        seen=seen.astype(np.int32), cell=_cell(later).astype(np.int32), x_cell=_cell(earlier).astype(np.int32),
    )


def find(rows: DataFrame, levels, parts: int, t: float) -> DataFrame:
    """Lines that equal an earlier one (x null), and for leaders of classes the closest candidates x; cell, x_cell: bits of a filter for the lines; x_cell alone: of marked lines."""
    hot_word, enough, keep, compact = HOT_WORD, ENOUGH, KEEP, COMPACT

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            out = list(_blocks(Lines(*_lines_of(ids, texts), levels.value), parts, t, hot_word))
            if out:
                yield _record(["part", "kind", "block"], [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary()))])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple[int, int], list[np.ndarray]] = {}
        size: dict[tuple[int, int], int] = {}

        def merge(at: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            """Merges the copies of what has come together."""
            e = np.concatenate(got.pop(at))
            if at[1] == -1:
                lead, gone = _leaders(e)
                if len(gone):
                    yield _equal(e[gone])
            else:
                lead = _merged(e)
            got[at], size[at] = [e[lead]], 0

        for b in batches:
            for part, kind, block in zip(*(c.to_pylist() for c in b.columns)):
                if kind == -2:
                    yield _equal(unpacked(block, _LINE))
                    continue
                at = (part, kind)
                got.setdefault(at, []).append(unpacked(block, _SIGNED if kind == -1 else _entry(CLASSES[kind][1])))
                size[at] = size.get(at, 0) + got[at][-1].nbytes
                if size[at] > compact:
                    yield from merge(at)
        for at in sorted(got):
            yield from merge(at)
            (e,), kind = got.pop(at), at[1]
            if kind >= 0:
                y, x, seen, marked = closest(e, (CLASSES[kind - 1][0] if kind else 0) + 1, t, enough, keep)
                if len(y):
                    yield _near(e, y, x, seen)
                if len(marked):
                    cells = np.unique(_cell(e[marked])).astype(np.int32)
                    yield _found(len(cells), x_cell=cells)

    return rows.mapInArrow(emit, "part int, kind int, block binary").repartitionById(parts, "part").mapInArrow(compare, _FOUND)


def _size(n: int) -> int:
    return min(max(MIN_BITS, 1 << (n * BITS_EACH).bit_length()), MAX_BITS)


def _filter(cells: DataFrame):
    """A broadcast filter of the bits in the column cell, sized by their number."""
    size = _size(cells.count())
    # Spark numbers the bits of a bitmap from 1.
    cells = cells.select((F.col("cell").cast("long").bitwiseAND(F.lit(size - 1)) + 1).alias("cell"))
    bits = cells.groupBy(F.call_function("bitmap_bucket_number", F.col("cell")).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", F.col("cell"))).alias("bits"))
    wanted = np.zeros(size // 8, np.uint8)
    for r in bits.collect():
        at = (r["bucket"] - 1) * 4096
        wanted[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)[: len(wanted) - at]
    return cells.sparkSession.sparkContext.broadcast(wanted)


def _bodies(rows: DataFrame, wanted) -> DataFrame:
    """(doc, line, sig, crc, body): the texts of the wanted lines and, as their filter is a hashed one, some others."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in slices(batches):
            place, flat = _lines_of(ids, texts)
            some = np.flatnonzero(_in(wanted.value, _cell(place)))
            lines = Lines(place[some], body := flat.take(pa.array(some)), np.zeros(COUNTERS, np.uint8))
            if len(lines):
                body = body.filter(pa.array(lines.own))
                p = lines.place
                yield _record([*_Y, "crc", "body"], [*(pa.array(x.astype(np.int64)) for x in (p["doc"], p["line"], lines.signatures()[0].view(np.int64), np.ascontiguousarray(p["crc"]).view(np.int64))), body])

    return rows.mapInArrow(emit, "doc long, line long, sig long, crc long, body string").dropDuplicates([*_Y, "crc"])


def alike(a: str, b: str, t: float) -> bool:
    """Whether the similarity of two lines is t or more."""
    p, q = set(a.encode().split()), set(b.encode().split())
    both = len(p & q)
    return both >= t * (len(p) + len(q) - both) - 1e-9


def _verified(pairs: DataFrame, bodies: DataFrame, t: float) -> DataFrame:
    """The pairs whose similarity is t or more."""
    one = bodies.groupBy(*_Y).agg(F.first("body").alias("body"))
    x = one.select(*(F.col(k).alias(f"x_{k}") for k in _Y), F.col("body").alias("x_body"))
    both = pairs.join(x, list(_X)).join(one, list(_Y)).select(*_PAIR, "x_body", "body")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(p, q, t) for p, q in zip(b.column(6).to_pylist(), b.column(7).to_pylist())]
            yield b.select(range(6)).filter(pa.array(ok, pa.bool_()))

    return both.mapInArrow(verify, ", ".join(f"{c} long" for c in _PAIR))


_BODY = np.dtype([("word", "<u4"), ("sig", "<u8"), *_AT.descr, ("open", "<u1"), ("n", "<u4")])


class Gathered:
    """Lines that come together in a part, and their words. Copies are merged whenever `compact` bytes have come; what they came in is then let go."""

    def __init__(self, compact: int) -> None:
        self.compact, self.size, self.e, self.words = compact, 0, [], []

    def add(self, e: np.ndarray, words: np.ndarray) -> None:
        self.e.append(e)
        self.words.append(words)
        self.size += e.nbytes + words.nbytes
        if self.size > self.compact:
            self.merge()

    def merge(self) -> None:
        e, words = np.concatenate(self.e), np.concatenate(self.words)
        self.e, self.words = [], []
        lead, n = _merged(e), e["n"].astype(np.int64)
        start, n = (np.cumsum(n) - n)[lead], n[lead]
        end = np.cumsum(n)
        out = np.empty(int(n.sum()), np.uint64)
        for k in range(0, len(lead), _AT_ONCE):
            some = slice(k, k + _AT_ONCE)
            first = int(end[k] - n[k])
            at = np.repeat(start[some] - (end[some] - n[some]), n[some])
            out[first : first + len(at)] = words[at + np.arange(first, first + len(at))]
        self.e, self.words, self.size, self.start = [e[lead]], [out], 0, end - n

    def __getitem__(self, k: int) -> np.ndarray:
        """The words of a line, after a merge."""
        return self.words[0][self.start[k] : self.start[k] + int(self.e[0]["n"][k])]


def first_match(e: np.ndarray, words: list[np.ndarray] | Gathered, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(later, earlier): at each word, for each open line the first line that it matches, as indices into e; words: of each line, its hashes."""
    ys, xs = [], []
    order = np.lexsort((e["line"], e["doc"], e["word"]))
    for group in np.split(order, np.flatnonzero(np.diff(e["word"][order])) + 1):
        g = e[group]
        if len(g) < 2 or not g["open"].any():
            continue
        n = g["n"].astype(np.int64)
        of = np.repeat(np.arange(len(g)), n)
        _, code = np.unique(np.concatenate([words[k] for k in group]), return_inverse=True)
        by_word = np.argsort(code, kind="stable")
        posting, first = of[by_word], np.concatenate(([0], np.cumsum(np.bincount(code))))
        start = np.cumsum(n) - n
        for y in np.flatnonzero(g["open"]).tolist():
            own = code[start[y] : start[y] + n[y]]
            size = first[own + 1] - first[own]
            at = np.repeat(first[own] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
            both = np.bincount(posting[at], minlength=len(g))[:y]
            earlier = (g["doc"][:y] != g["doc"][y]) | (g["line"][:y] != g["line"][y])
            hit = np.flatnonzero(earlier & (both >= t * (n[:y] + n[y] - both) - 1e-9))
            if len(hit):
                ys.append(group[y])
                xs.append(group[hit[0]])
    return np.array(ys, np.int64), np.array(xs, np.int64)


def _open_words(bodies: DataFrame, levels, parts: int, t: float) -> DataFrame:
    """(cell, hot): the bits of a filter for all words under which these lines meet others; whether one has to do with hot words."""
    hot_word = HOT_WORD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = Lines(np.zeros(b.num_rows, _LINE), b.column(0), levels.value)
            sig = lines.signatures()[0]
            for kind, some in _classes(lines.n, t):
                _, key, _ = lines.keys(some, sig, kind, t, hot_word)
                cell = _word_cell(key >> np.uint64(32), (key % np.uint64(parts)).astype(np.int64))
                yield _record(["cell", "hot"], [pa.array(cell.astype(np.int32)), pa.array((key & _HOT) > 0)])

    return bodies.select("body").mapInArrow(run, "cell int, hot boolean").distinct()


def _having(flat: pa.Array, levels: np.ndarray, parts: int, hot_word: int, open_words: np.ndarray) -> np.ndarray:
    """Indices of the lines that hold a word which, not being hot, has one of the keys looked for."""
    words = pc.ascii_split_whitespace(flat)
    d = words.flatten().dictionary_encode()
    known = hash_of(d.dictionary)
    wanted = np.zeros(len(known), bool)
    for kind in range(len(CLASSES)):
        key = word_key(known, kind)
        wanted |= _in(open_words, _word_cell(key >> np.uint64(32), (key % np.uint64(parts)).astype(np.int64)))
    wanted &= levels[_counter(known)] <= level(hot_word)
    per_line = np.diff(words.offsets.to_numpy())
    return np.unique(np.repeat(np.arange(len(per_line)), per_line)[wanted[d.indices.to_numpy(zero_copy_only=False)]])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(places, texts) of lines, from rows of (id, text) or (doc, crc, line, body)."""
    for b in batches:
        if b.num_columns == 2:
            yield from (_lines_of(ids, texts) for ids, texts in slices([b]))
        else:
            place = np.zeros(b.num_rows, _LINE)
            place["doc"], place["crc"], place["line"] = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy()
            yield place, b.column(3)


def find_all(rows: DataFrame, levels, parts: int, t: float, open_lines, open_words, hot: bool) -> DataFrame:
    """Pairs (later, earlier) that match, for lines in one filter, at the words in another (hot ones among them or not); compared on whole sets of words."""
    hot_word, compact = HOT_WORD, COMPACT

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for place, flat in _placed(batches):
            if not hot:
                some = _having(flat, levels.value, parts, hot_word, open_words.value)
                place, flat = place[some], flat.take(pa.array(some))
            lines = Lines(place, flat, levels.value)
            s1, s2 = lines.signatures()
            signed = np.zeros(len(lines), _SIGNED)
            signed["s1"], signed["s2"] = s1, s2
            for f in _LINE.names:
                signed[f] = lines.place[f]
            mine = np.zeros(len(lines), bool)
            mine[_leaders(signed)[0]] = True
            wanted = _in(open_lines.value, _cell(lines.place))
            for kind, some in _classes(lines.n, t):
                of, key, _ = lines.keys(some & mine, s1, kind, t, hot_word)
                word, part = key >> np.uint64(32), (key % np.uint64(parts)).astype(np.int64)
                ok = _in(open_words.value, _word_cell(word, part))
                of, word, part = of[ok], word[ok], part[ok]
                for p in np.unique(part).tolist():
                    k = np.flatnonzero(part == p)
                    e = np.zeros(len(k), _BODY)
                    e["word"], e["sig"], e["open"], e["n"] = word[k], s1[of[k]], wanted[of[k]], lines.n[of[k]]
                    for f in _AT.names:
                        e[f] = lines.place[f][of[k]]
                    bodies = np.concatenate([lines.hash[a : a + n] for a, n in zip(lines.start[of[k]].tolist(), lines.n[of[k]].tolist())])
                    yield _record(["part", "block", "words"], [pa.array([p], pa.int32()), pa.array([packed(e)], pa.binary()), pa.array([bodies.tobytes()], pa.binary())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, Gathered] = {}
        for b in batches:
            for part, block, flat in zip(*b.columns):
                got.setdefault(part.as_py(), Gathered(compact)).add(unpacked(block.as_py(), _BODY), np.frombuffer(flat.as_py(), np.uint64))
        for part in sorted(got):
            words = got.pop(part)
            words.merge()
            (e,) = words.e
            y, x = first_match(e, words, t)
            yield _record(list(_PAIR), [pa.array(e[f][at].astype(np.int64) if f != "sig" else e[f][at].view(np.int64)) for at in (y, x) for f in _Y])

    return rows.mapInArrow(emit, "part int, block binary, words binary").repartitionById(parts, "part").mapInArrow(compare, ", ".join(f"{c} long" for c in _PAIR))


def _order(docs: DataFrame, id_col: str) -> Column:
    """The id as a long: itself, or a hash of an id that is no integer."""
    whole = isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    return F.col(f"`{id_col}`").cast("long") if whole else F.when(F.col(f"`{id_col}`").isNotNull(), F.xxhash64(F.col(f"`{id_col}`")))


def removed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc, crc, line, x_doc, x_line): the lines that go; x is an earlier line that matches, null where an equal one exists. doc: the id as a long; crc: XXH64 of the text."""
    t = similarity
    spark = ship(docs.sparkSession)
    rows = docs.select(_order(docs, id_col).alias("id"), F.col(f"`{text_col}`").alias("text")).filter("id is not null and text is not null")
    counted, n_words = count_words(rows)
    levels = spark.sparkContext.broadcast(counted)
    # About a fifth of the words are in prefixes, at some 50 bytes each.
    parts = max(parts_for(spark), -(-n_words * 10 // PART))
    found = materialise(find(rows, levels, parts, t))
    pairs = materialise(found.filter("x_doc is not null").groupBy(*_PAIR).agg(F.max("seen").alias("seen"), F.max("cell").alias("cell"), F.max("x_cell").alias("x_cell")))
    wanted = pairs.select(F.explode(F.array("cell", "x_cell")).alias("cell")).unionByName(found.filter("doc is null").select(F.col("x_cell").alias("cell")))
    bodies = materialise(_bodies(rows, _filter(wanted)))
    # Leaders of classes are compared, so a line that equals an earlier one is never on the later side of a pair.
    matched = materialise(_verified(pairs.select(*_PAIR), bodies, t))
    left = materialise(pairs.filter(F.col("seen") >= min(KEEP + 1, ENOUGH)).select(*_Y, "cell", "seen").join(matched.select(*_Y), list(_Y), "left_anti").groupBy(*_Y, "cell").agg(F.max("seen").alias("seen")))
    most = left.agg(F.max("seen")).first()[0]
    if most is not None:
        words = materialise(_open_words(bodies.join(left.select(*_Y), list(_Y), "left_semi"), levels, parts, t))
        hot = bool(words.agg(F.max("hot")).first()[0])
        # Lines that have stopped looking have marked some only.
        where = rows if most >= ENOUGH else bodies.select("doc", "crc", "line", "body")
        matched = matched.unionByName(materialise(find_all(where, levels, parts, t, _filter(left), _filter(words), hot)))
    first = matched.groupBy(*_Y).agg(F.min(F.struct("x_doc", "x_line")).alias("x"))
    out = bodies.select(*_KEY, "sig").join(first, list(_Y)).select(*_KEY, F.col("x.x_doc").alias("x_doc"), F.col("x.x_line").alias("x_line"))
    none = F.lit(None).cast("long")
    return out.unionByName(found.filter("x_doc is null and doc is not null").select(*_KEY, none.alias("x_doc"), none.alias("x_line")))


def without(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs and the numbers of the lines that went, with those lines removed from the text; gone: (doc, crc, line). The last column holds the numbers."""
    names = docs.columns
    c_bits, c_bucket, c_id, c_text, c_lines = aside(docs, "bits", "bucket", "id", "crc", "lines")
    gone = materialise(gone.groupBy("doc", "crc").agg(F.sort_array(F.collect_set("line")).alias("gone")))
    gone = gone.select(F.col("doc").alias(c_id), F.col("crc").alias(c_text), F.col("gone").alias(c_lines))
    keyed = docs.withColumn(c_id, _order(docs, id_col)).withColumn(c_text, F.xxhash64(F.col(f"`{text_col}`")))
    number, bit = (lambda c, f=f: F.call_function(f, c) for f in ("bitmap_bucket_number", "bitmap_bit_position"))
    cell = F.pmod(F.xxhash64(F.col(c_id), F.col(c_text)), F.lit(_size(gone.count()))) + 1
    # Documents that surely lose no line pass by the shuffle; the filter has MAX_BITS / 8 bytes at most.
    bits = gone.select(cell.alias("c")).groupBy(number(F.col("c")).alias(c_bucket)).agg(F.call_function("bitmap_construct_agg", bit(F.col("c"))).alias(c_bits))
    probed = keyed.withColumn(c_bucket, number(cell)).join(F.broadcast(bits), c_bucket, "left")
    byte = F.conv(F.hex(F.substring(F.col(c_bits), (bit(cell) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.call_function("getbit", byte, (bit(cell) % 8).cast("int")) == 1, F.lit(False))
    own = [F.col(f"`{n}`") for n in names]
    as_is = probed.filter(~maybe).select(*own, F.lit(None).cast("array<bigint>").alias(c_lines))
    joined = probed.filter(maybe).drop(c_bits, c_bucket).join(gone, [c_id, c_text], "left")
    text = F.col(f"`{text_col}`")
    kept = F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains(F.col(c_lines), i.cast("long")))
    cut = F.when(F.col(c_lines).isNull(), text).otherwise(F.array_join(kept, "\n"))
    return as_is.unionByName(joined.withColumn(text_col, cut).select(*own, F.col(c_lines)))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with the later ones of matching lines removed from the text."""
    out = without(docs, removed_lines(docs, id_col, text_col, similarity), id_col, text_col)
    return out.drop(out.columns[-1])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    out = without(docs.withColumn("n_lines", n_lines), removed_lines(docs), "doc_id", "text")
    lines = F.col(out.columns[-1])
    return out.select("doc_id", "n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(lines.cast("array<string>"), ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))
