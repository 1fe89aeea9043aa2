"""Token-id output, compressed by Re-Pair.

Documents are put in order of their id and cut into shards (a range of ids)
and blocks (about ``block_tokens`` ids).  A block is one row of a Parquet table
in the shared folder, and is read by itself:

====================  =====================================================
shard, block          place in the order
n_docs, n_tokens      totals
doc_ids               int64 little-endian, ascending
lengths               uint32: ids of each document
starts                uint32: the first symbol of each document
rules                 uint32 pairs; pair i stands for symbol FIRST_RULE + i
expansions            uint32: ids that each rule stands for
symbols               zstd of uint16, or of uint32 if a symbol needs it
====================  =====================================================

Symbols below FIRST_RULE are ids.  No rule spans two documents, so ``starts``
leads to any document, and within it ``expansions`` to any id, without
decoding what stands before.

Re-Pair: frequent pairs of neighbours are replaced by a new symbol, again and
again, until no pair of a block occurs ``least`` times.  A round replaces all
such pairs that don't overlap more frequent ones, so the most frequent pair is
always replaced wherever it stands.

Nulls and empty texts have the end id only.  Null ids come first.  Repeated
rows are written each.  A text of any length is one row, in one block.  No
documents give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import U64, Slice, freed, rows, text_slices
from .storage import discard, materialize

FIRST_RULE = 1 << 16
END_ID = 2
BLOCK_TOKENS = 1 << 20
#: Occurrences in a block that a pair needs to be replaced: a rule takes 12 bytes.
LEAST = 256
#: White space, so that under a byte-level tokenizer it stands alone between a part and the next one's space.
MARK = "\x0b"
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
#: First bytes of characters that aren't white: ASCII from 21 to 7E, and two bytes from U+00C0 on.
_DARK = np.zeros(256, bool)
_DARK[0x21:0x7F] = _DARK[0xC3:0xE0] = True
PUNCTUATION = bytes(c for c in range(0x21, 0x7F) if not _ALNUM[c])


def _may_be_white(data: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Whether the character that ends in byte i is white space, a control character, or may be."""
    at = lambda k: data[np.maximum(i - k, 0)]
    b0, b1, b2 = at(0), at(1), at(2)
    two = (b1 == 0xC2) & ((b0 == 0x85) | (b0 == 0xA0))
    general = (b2 == 0xE2) & (((b1 == 0x80) & ((b0 <= 0x8A) | (b0 == 0xA8) | (b0 == 0xA9) | (b0 == 0xAF))) | (b1 == 0x81))
    return (b0 <= 0x20) | (b0 == 0x7F) | two | general | ((b2 == 0xE1) & (b1 == 0x9A)) | ((b2 == 0xE3) & (b1 == 0x80))


def part_starts(s: Slice, stops: np.ndarray) -> np.ndarray:
    """Where the parts of a slice's texts begin: always at ends of what a byte-level tokenizer takes as one piece.

    Such a piece ends before a space after a character that isn't white, and
    before a single space after white space if more than white space follows;
    between a letter or digit and punctuation (``stops``, by byte); before the
    first white space; and after a line feed between two characters that
    aren't white.
    """
    data, n = s.data, len(s.data)
    if not n:
        return np.zeros(0, np.int64)
    inner = np.ones(n, bool)  # not the first byte of a text
    firsts = s.offs[:-1]
    inner[firsts[firsts < n]] = False
    final = np.zeros(n, bool)  # the last byte of a text
    lasts = s.offs[1:] - 1
    final[lasts[lasts >= 0]] = True
    white = np.flatnonzero(((data == 0x20) | (data == 0x0A)) & inner)
    dark = ~_may_be_white(data, white - 1)
    more = _DARK[data[np.minimum(white + 1, n - 1)]] & ~final[white]
    line = data[white] == 0x0A
    before = white[dark | (~line & more)]
    after = white[line & dark & more] + 1
    stop = np.flatnonzero(stops[data] & inner)
    last, lead = data[stop - 1], data[np.maximum(stop - 2, 0)]
    # Two bytes from U+00C0 to U+00FF are letters, but for two signs.
    stop = stop[_ALNUM[last] | ((lead == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]
    start = ~inner
    start[before] = start[after] = start[stop] = True
    return np.flatnonzero(start)


class _Grown:
    """An array that grows by doubling."""

    def __init__(self, kind):
        self.held, self.n = np.zeros(1 << 10, kind), 0

    def __len__(self) -> int:
        return self.n

    @property
    def view(self) -> np.ndarray:
        return self.held[: self.n]

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            held = np.zeros(2 * (self.n + len(more)), self.held.dtype)
            held[: self.n] = self.view
            self.held = held
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


_SLOT_BITS = 22


class Encoder:
    """Ids of texts by a tokenizer file.

    A byte-level tokenizer's pieces end where :func:`part_starts` says, so a
    text is the sum of its parts, and a part is tokenised once as long as it
    is remembered.  Parts are found by a hash and confirmed byte by byte.
    Texts under other tokenizers are tokenised whole.  What is remembered is
    held in arrays of ``MAX_BYTES`` at most, besides one slice's parts.
    """

    MAX_BYTES = 128 << 20

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens", [])
        cut = lambda t: t["lstrip"] or t["rstrip"] or t.get("single_word") or any(c.isspace() for c in t["content"])
        self.by_parts = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(map(cut, added))
        # Never inside a special token.
        self.stops = np.zeros(256, bool)
        self.stops[[c for c in PUNCTUATION if not any(chr(c) in t["content"] for t in added)]] = True
        self.mark = (self._batch([MARK]) or [[]])[0]
        self.by_parts = self.by_parts and len(self.mark) == 1
        self.mark = self.mark[0] if self.by_parts else -1
        self._forget()

    def _forget(self) -> None:
        #: The hash of each part; a part's number is in one of two slots that its hash names, unless others took both.
        self.keys, self.slots = _Grown(U64), np.full(1 << _SLOT_BITS, -1, np.int32)
        self.raw, self.raw_end, self.ids, self.ids_end = _Grown(np.uint8), _Grown(np.int64), _Grown(np.uint32), _Grown(np.int64)
        self.raw_end.extend(np.zeros(1, np.int64))
        self.ids_end.extend(np.zeros(1, np.int64))

    def _tokenise(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts, joined, and how many each has.

        Parts without white space at their ends, but for one leading space, are
        tokenised many at once, with a mark after each that can't join its
        neighbours; others by themselves.
        """
        plain = np.fromiter((not x[-1:].isspace() and not x[x[:1] == " " :][:1].isspace() and MARK not in x and x not in ("", " ") for x in parts), bool, len(parts))
        sizes = np.zeros(len(parts), np.int64)
        many = [x for x, p in zip(parts, plain, strict=True) if p]
        each = [x for x, p in zip(parts, plain, strict=True) if not p]
        texts = [(MARK.join(many[i : i + 256]) + MARK) for i in range(0, len(many), 256)]
        marked = np.concatenate([np.zeros(0, np.uint32), *[np.array(e, np.uint32) for e in self._batch(texts)]])
        marks = np.flatnonzero(marked == self.mark)
        if len(marks) != len(many):
            raise ValueError("the tokenizer joins the mark with its neighbours")
        sizes[plain] = np.diff(np.concatenate([[-1], marks])) - 1
        alone = self._batch(each)
        sizes[~plain] = [len(x) for x in alone]
        ids = np.zeros(int(sizes.sum()), np.uint32)
        of_plain = np.repeat(plain, sizes)
        ids[of_plain] = np.delete(marked, marks)
        ids[~of_plain] = np.fromiter((i for e in alone for i in e), np.uint32)
        return ids, sizes

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self, s: Slice, h: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Tokenise these parts, all distinct hashes, and remember them."""
        raw = s.data.tobytes()
        parts = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        got, sizes = self._tokenise([x.decode() for x in parts])
        n = len(self.raw_end) - 1
        self.raw.extend(np.frombuffer(b"".join(parts), np.uint8))
        self.raw_end.extend(self.raw_end.view[-1] + np.cumsum(b - a))
        self.ids.extend(got)
        self.ids_end.extend(self.ids_end.view[-1] + np.cumsum(sizes))
        self.keys.extend(h)
        left = np.arange(n, n + len(h), dtype=np.int32)
        for at in self._places(h):
            own = at[left - n]
            free = self.slots[own] < 0
            self.slots[own[free]] = left[free]
            left = left[self.slots[own] != left]

    @staticmethod
    def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> U64(64 - _SLOT_BITS)).astype(np.int64), (h & U64((1 << _SLOT_BITS) - 1)).astype(np.int64)

    def _known(self, h: np.ndarray) -> np.ndarray:
        """The number of the part of each hash, or -1."""
        keys, out = self.keys.view, np.full(len(h), -1, np.int32)
        if not len(keys):
            return out
        left = np.arange(len(h))
        for at in self._places(h):
            n = self.slots[at[left]]
            found = (n >= 0) & (keys[n] == h[left])
            out[left[found]] = n[found]
            left = left[~found]
        return out

    def encode(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice's texts, and how many each text has."""
        if not self.by_parts:
            raw = s.data.tobytes()
            got = self._batch([raw[x:y].decode() for x, y in zip(s.offs[:-1].tolist(), s.offs[1:].tolist(), strict=True)])
            return np.fromiter((i for e in got for i in e), np.uint32), np.array([len(e) for e in got], np.int64)
        a = part_starts(s, self.stops)
        if not len(a):
            return np.zeros(0, np.uint32), np.zeros(s.n_docs, np.int64)
        b = np.append(a[1:], len(s.data))
        h = s.word_hashes(a, b, False)
        n = self._known(h)
        new = np.flatnonzero(n < 0)
        if len(new):
            u, first, back = np.unique(h[new], return_index=True, return_inverse=True)
            n[new] = len(self.keys) + back
            self._learn(s, u, a[new[first]], b[new[first]])
        raw_end, ids_end = self.raw_end.view, self.ids_end.view
        long = raw_end[n + 1] - raw_end[n]
        # The parts found must spell the texts; where two parts have one hash, those are tokenised by themselves.
        if not np.array_equal(long, b - a) or not np.array_equal(_gather(self.raw.view, raw_end[n], long), s.data):
            return self._encode_each(s, a, b, n)
        size = ids_end[n + 1] - ids_end[n]
        return _gather(self.ids.view, ids_end[n], size), self._per_text(s, a, size)

    @staticmethod
    def _per_text(s: Slice, a: np.ndarray, size: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(a, s.offs)])

    def _encode_each(self, s: Slice, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, got = s.data.tobytes(), []
        known, raw_end, ids, ids_end = self.raw.view, self.raw_end.view, self.ids.view, self.ids_end.view
        for x, y, k in zip(a.tolist(), b.tolist(), n.tolist(), strict=True):
            same = known[raw_end[k] : raw_end[k + 1]].tobytes() == raw[x:y]
            got.append(ids[ids_end[k] : ids_end[k + 1]] if same else self._tokenise([raw[x:y].decode()])[0])
        return np.concatenate(got), self._per_text(s, a, np.array([len(x) for x in got], np.int64))

    def bound(self) -> None:
        """Forget all parts once their arrays take more than ``MAX_BYTES``."""
        if self.slots.nbytes + sum(x.held.nbytes for x in (self.keys, self.raw, self.raw_end, self.ids, self.ids_end)) > self.MAX_BYTES:
            self._forget()


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One a worker, so that later tasks know the parts of earlier ones."""
    return Encoder(path)


def _gather(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[first[i] : first[i] + size[i]] for all i, joined."""
    total = int(size.sum())
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.arange(total, dtype=kind)
    at += np.repeat((first - np.concatenate([[0], np.cumsum(size)[:-1]])).astype(kind), size)
    return flat[at]


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, the first symbol of each document, rules (one pair a row), and how many ids each rule stands for."""
    seq = ids.astype(np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(lengths)[lengths > 0] - 1] = True
    rules: list[np.ndarray] = []
    sizes = np.zeros(0, np.int64)
    live = None
    while len(seq) > 1:
        at, pair, n = _frequent(seq, last, least, live)
        if not len(at):
            break
        # Of overlapping pairs the more frequent is replaced (the most frequent one always), the others wait for the next round.
        rank = np.full(len(seq) + 1, -1, np.int64)
        rank[at] = n[pair] * (len(n) + 1) + len(n) - pair
        won = (rank[at] > rank[at - 1]) & (rank[at] > rank[at + 1])
        enough = np.bincount(pair[won], minlength=len(n)) >= least
        won &= enough[pair]
        lost = at[~won]
        at, pair = at[won], pair[won]
        number = np.cumsum(enough) - 1
        _, lead = np.unique(pair, return_index=True)
        made = np.stack([seq[at[lead]], seq[at[lead] + 1]], 1)
        count = lambda x: np.where(x >= FIRST_RULE, sizes[np.maximum(x.astype(np.int64) - FIRST_RULE, 0)] if len(sizes) else 1, 1)
        fresh = count(made[:, 0]) + count(made[:, 1])
        seq[at] = (FIRST_RULE + len(sizes) + number[pair]).astype(np.uint32)
        last[at] = last[at + 1]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        # Only pairs with a new symbol, and those that waited, can be frequent now.
        again = np.zeros(len(seq), bool)
        again[at] = again[lost] = True
        again, seq, last = again[keep], seq[keep], last[keep]
        again[:-1] |= seq[1:] >= FIRST_RULE + len(sizes)
        live = again[:-1]
        rules.append(made)
        sizes = np.concatenate([sizes, fresh])
    ends = np.flatnonzero(last) + 1
    starts = np.zeros(len(lengths), np.int64)
    full = np.flatnonzero(lengths > 0)
    starts[full] = np.concatenate([[0], ends[:-1]]) if len(ends) else []
    return seq, starts.astype(np.uint32), np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), sizes


def _frequent(seq: np.ndarray, last: np.ndarray, least: int, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places ``live`` (all), those of pairs that occur ``least`` times without overlap, which pair each is, and how often each pair occurs."""
    ok = ~last[:-1]
    # In a run of one symbol, every second pair counts.
    same = np.flatnonzero((seq[:-1] == seq[1:]) & ok)
    if len(same):
        fresh = np.ones(len(same), bool)
        fresh[1:] = same[1:] != same[:-1] + 1
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(same)), 0))
        ok[same[(np.arange(len(same)) - begin) % 2 == 1]] = False
    # A cell of hashes with fewer than ``least`` entries has no such pair; twice, so that few others are left.
    # Which pairs of a run count may change with any of its ends.
    at = live
    if live is not None:
        live[same] = True
        at = np.flatnonzero(live & ok)
    for one, two in ((0x9E3779B1, 0x85EBCA6B), (0xC2B2AE35, 0x27D4EB2F)):
        a, b = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
        cell = ((a * np.uint32(one)) ^ (b * np.uint32(two))) >> np.uint32(32 - _CELL_BITS)
        if at is None:
            at = np.flatnonzero(ok)
            cell = cell[ok] if len(at) < len(ok) else cell
        hot = np.bincount(cell, minlength=1 << _CELL_BITS) >= least
        keep = hot[cell]
        at, cell = at[keep], cell[keep]
    # By cell, as few bits sort fast; then, where a cell holds several pairs, by pair.
    slot = (np.cumsum(hot) - 1)[cell]
    order = np.argsort(slot.astype(np.uint16) if hot.sum() <= 1 << 16 else slot, kind="stable")
    at, slot = at[order], slot[order]
    k = seq[at].astype(U64) << U64(32) | seq[at + 1].astype(U64)
    edge = np.append(np.flatnonzero(np.append(True, slot[1:] != slot[:-1])), len(k)) if len(k) else np.zeros(1, np.int64)
    mixed = np.repeat(k[edge[:-1]], np.diff(edge)) != k
    if mixed.any():
        i = np.flatnonzero(np.isin(slot, np.unique(slot[mixed])))
        by = i[np.lexsort((k[i], slot[i]))]
        at[i], k[i] = at[by], k[by]
    edge = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)) if len(k) else np.zeros(1, np.int64)
    n = np.diff(edge)
    often = n >= least
    keep = np.repeat(often, n)
    return at[keep], np.repeat(np.cumsum(often) - 1, n)[keep], n[often]


_CELL_BITS = 18


def expand(rules: np.ndarray, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids that each rule stands for: joined, the first of each, and how many. A rule holds only rules before it."""
    n = len(rules)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(0, np.int64)
    inner = rules.astype(np.int64) - FIRST_RULE
    depth = np.zeros(n, np.int64)
    while True:  # as often as rules are nested
        below = np.where(inner >= 0, depth[np.maximum(inner, 0)] + 1, 0).max(axis=1)
        if np.array_equal(below, depth):
            break
        depth = below
    size = np.ones(n, np.int64) if size is None else size.astype(np.int64)
    levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)]
    part = lambda i, side: np.where(inner[i, side] >= 0, size[np.maximum(inner[i, side], 0)], 1)
    for i in levels:
        size[i] = part(i, 0) + part(i, 1)
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = np.zeros(int(first[-1]), np.uint32)
    for i in levels:
        to = first[i]
        for side in (0, 1):
            m = part(i, side)
            rule = inner[i, side] >= 0
            flat[to[~rule]] = rules[i[~rule], side]
            if rule.any():
                flat[_places(to[rule], m[rule])] = _gather(flat, first[inner[i[rule], side]], m[rule])
            to = to + m
    return flat, first, size


def _places(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.arange(int(size.sum())) + np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64), size)


def decode(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    flat, first, size = expand(rules)
    n = len(flat)
    is_rule = symbols >= FIRST_RULE
    r = np.where(is_rule, symbols - np.uint32(FIRST_RULE), 0).astype(np.int64)
    count = np.where(is_rule, size[r], 1) if len(size) else np.ones(len(symbols), np.int64)
    begin = np.where(is_rule, first[r], n + np.arange(len(symbols)))
    return _gather(np.concatenate([flat, symbols]), begin, count)


FILE = "shard int, block int, n_docs long, n_tokens long, doc_ids binary, lengths binary, starts binary, rules binary, expansions binary, wide boolean, symbols binary"
_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *[(x, pa.binary()) for x in ("doc_ids", "lengths", "starts", "rules", "expansions")], ("wide", pa.bool_()), ("symbols", pa.binary())])


def pack(shard: int, block: int, doc_ids: list[int | None], ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> pa.RecordBatch:
    symbols, starts, rules, size = compress(ids, lengths, least)
    # Ids are below 50,257 in the usual vocabularies, so rules fit in what uint16 has left.
    top = int(ids.max(initial=0)) + 1
    wide = top + len(rules) > 1 << 16
    if not wide:
        shift = np.uint32(FIRST_RULE - ((1 << 16) - len(rules)))
        symbols = np.where(symbols >= FIRST_RULE, symbols - shift, symbols)
    raw = symbols.astype("<u4" if wide else "<u2").tobytes()
    known = np.array([np.iinfo(np.int64).min if x is None else x for x in doc_ids], "<i8")
    values = [shard, block, len(doc_ids), len(ids), known.tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), size.astype("<u4").tobytes(), wide, zstandard.ZstdCompressor(1).compress(raw)]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)


def unpack(rules: bytes, wide: bool, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(rules, "<u4").reshape(-1, 2)
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(symbols), "<u4" if wide else "<u2").astype(np.uint32)
    if not wide:
        low = (1 << 16) - len(pairs)
        got = np.where(got >= low, got + np.uint32(FIRST_RULE - low), got)
    return got, pairs


def one_document(rules: bytes, wide: bool, symbols: bytes, starts: bytes, i: int) -> np.ndarray:
    """The ids of the block's document i, from its own symbols only."""
    got, pairs = unpack(rules, wide, symbols)
    s = np.frombuffer(starts, "<u4")
    return decode(got[s[i] : s[i + 1] if i + 1 < len(s) else len(got)], pairs)


def encoded(docs: DataFrame, tokenizer: str, end_id: int = END_ID, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, unnamed (the text, where doc_id is null), ids: little-endian, the end id included, in two bytes each where the vocabulary allows it (see :func:`id_type`)."""
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = id_type(enc.tokenizer, end_id)
        for batch in batches:
            own, column = rows(batch, ["doc_id", "text"])
            for s in text_slices(column):
                got, n = enc.encode(s)
                raw = np.insert(got.astype(kind), np.cumsum(n), end_id)
                mine = own.slice(s.lo, s.n_docs)
                unnamed = pc.if_else(mine.is_null(), column.slice(s.lo, s.n_docs), None) if mine.null_count else pa.nulls(s.n_docs, pa.string())
                yield pa.RecordBatch.from_arrays([mine, unnamed, _cells(raw, n + 1)], names=["doc_id", "unnamed", "ids"])
                enc.bound()

    return body.mapInArrow(freed(encode), "doc_id long, unnamed string, ids binary")


def id_type(tokenizer, end_id: int) -> str:
    return "<u2" if max(tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _cells(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum(ids.itemsize * n)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offs.tobytes()), pa.py_buffer(ids.tobytes())]).cast(pa.binary())


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Writes the files; returns the table read from them, and its path.

    Ids are written first, so texts are tokenised once and only ids are put in
    order.  Rows without a doc_id are in order of their texts, rows that share
    one in order of their ids' bytes.
    """
    spark = docs.sparkSession
    ids, path = materialize(encoded(docs, tokenizer, end_id, doc_id, text), "token-ids")
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "unnamed", "ids")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held = TaskContext.get().partitionId(), 0, 0
        kind = np.dtype(id_type(encoder(tokenizer).tokenizer, end_id))
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        for batch in batches:
            own, column = rows(batch, ["doc_id", "ids"])
            for s in text_slices(column):
                names += own.slice(s.lo, s.n_docs).to_pylist()
                parts.append(s.data.view(kind).astype("<u4"))
                lengths.append(np.diff(s.offs) // kind.itemsize)
                held += len(parts[-1])
                if held >= block_tokens:
                    yield pack(shard, block, names, np.concatenate(parts), np.concatenate(lengths), least)
                    block, held, names, parts, lengths = block + 1, 0, [], [], []
        if names:
            yield pack(shard, block, names, np.concatenate(parts), np.concatenate(lengths), least)

    files, at = materialize(ordered.mapInArrow(freed(blocks), FILE), "tokens", "none")
    discard(spark, path)
    return files, at


def read(files: DataFrame) -> DataFrame:
    """From the files, of each document: doc_id, start, n_tokens, ids_crc32."""
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # One row a shard: the only order over all of them.
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    sizes = files.select("shard", "block", "n_tokens")
    within = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)).alias("in_shard")).join(before, "shard")
    starts = starts.select("shard", "block", (F.col("shard_start") + F.col("in_shard")).alias("block_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.select(["shard", "block", "doc_ids", "lengths", "rules", "wide", "symbols"]).to_pylist():
                ids = decode(*unpack(r["rules"], r["wide"], r["symbols"])).astype("<u4")
                n = np.frombuffer(r["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(n)
                view = memoryview(ids.tobytes())
                crc = [zlib.crc32(view[4 * int(e - k) : 4 * int(e)]) for e, k in zip(ends, n, strict=True)]
                own = np.frombuffer(r["doc_ids"], "<i8")
                null = own == np.iinfo(np.int64).min
                m = len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(m, r["shard"], np.int32)), pa.array(np.full(m, r["block"], np.int32)), pa.array(own, mask=null), pa.array(ends - n), pa.array(n), pa.array(crc, pa.int64())],
                    names=["shard", "block", "doc_id", "in_block", "n_tokens", "ids_crc32"],
                )

    got = files.mapInArrow(freed(documents), "shard int, block int, doc_id long, in_block long, n_tokens long, ids_crc32 long")
    return got.join(starts, ["shard", "block"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")
