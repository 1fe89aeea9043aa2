"""Removal of byte strings that an earlier document has (sparse suffix arrays).

A byte is removed if a string of ``length`` (50) bytes over it also starts in a
document with a smaller doc_id.  Matches never cross documents and are judged
on the input.

Suffixes are sampled so that no match is lost: of the k-byte strings inside a
window of 50 bytes, the one with the smallest hash is its anchor, so windows
that are equal have equal anchors.  Neighbouring windows with the same anchor
form a run; equal runs are settled as a whole, and only where runs with the
same anchor differ are their windows compared one by one.

Sorted arrays of anchors are held in a logarithmic family of levels.  Batches
come in order of doc_id; a batch is sorted, merge-scanned against the levels
that exist (all older), and becomes a level of its own; levels of like size
merge, geometrically.  Order matters to a depth of 50 bytes only, so suffixes
are ordered by the hash of what a run or window holds, not byte by byte.

Documents are stored once in blocks of about 2 MB in the shared folder; every
later stage reads blocks, works on one at a time, and gets one small reply for
each.  Before anything is sent, a block keeps only the smallest doc_id of
equal runs, so a passage or text that fills a third of the corpus is sent once
a block.  An anchor that has many different runs in one block is not compared
as runs at all.

Nulls count as empty.  Null doc_ids are after all others.  Rows with the same
doc_id never remove anything from each other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, Slice, byte_codes, freed, mix, powers, rows, text_slices
from .storage import materialize, release

LENGTH = 50
ANCHOR = 20
MANY = 8
NO_ID = np.iinfo(np.int64).max
BATCH = 1 << 16


class Levels:
    """A logarithmic family of sorted arrays: key to the smallest doc_id."""

    def __init__(self) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> np.ndarray:
        """The smallest doc_id known of each key, or NO_ID."""
        out = np.full(len(keys), NO_ID)
        for k, d in self.levels:
            at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
            np.minimum(out, np.where(k[at] == keys, d[at], NO_ID), out=out)
        return out

    def add(self, keys: np.ndarray, docs: np.ndarray) -> None:
        level = _smallest(keys, docs)
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            k, d = self.levels.pop()
            level = _smallest(np.concatenate([k, level[0]]), np.concatenate([d, level[1]]))
        if len(level[0]):
            self.levels.append(level)


def _smallest(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    return keys[first], docs[first]


def smaller(keys: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Of each entry, the smallest doc_id with its key (its own at most), by batches in order of doc_id."""
    out = np.empty(len(keys), np.int64)
    order = np.argsort(docs, kind="stable")
    family = Levels()
    for lo in range(0, len(order), BATCH):
        i = order[lo : lo + BATCH]
        older = family.scan(keys[i])
        family.add(keys[i], docs[i])
        k, d = _smallest(keys[i], docs[i])
        out[i] = np.minimum(older, d[np.searchsorted(k, keys[i])])
    return out


class Runs:
    """The runs of a block: first and last window, anchor and content hashes, document; and which stand for the others."""

    def __init__(self, s: Slice, ids: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR):
        self.slice, self.ids, self.length = s, ids, length
        n = len(s.data)
        self.sums = s.prefix_sums(False)
        self.inverse = powers(n)[1]
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.doc = empty
        self.key = self.content = np.zeros(0, U64)
        if n >= length:
            h = mix((self.sums[anchor:] - self.sums[: n - anchor + 1]) * self.inverse[: n - anchor + 1])
            width, span = length - anchor + 1, 1
            while span * 2 <= width:
                h = np.minimum(h[:-span], h[span:])
                span *= 2
            if width > span:
                h = np.minimum(h[: len(h) - (width - span)], h[width - span :])
            inside = np.zeros(len(h) + 1, np.int8)
            lo, hi = s.offs[:-1], s.offs[1:] - length + 1
            ok = hi > lo
            valid = np.zeros(len(h), bool)
            np.add.at(inside, lo[ok], 1)
            np.add.at(inside, hi[ok], -1)
            valid = np.cumsum(inside[:-1], dtype=np.int8) > 0
            new = valid.copy()
            new[1:] &= (h[1:] != h[:-1]) | ~valid[:-1]
            starts = s.offs[:-1]
            starts = starts[starts < len(h)]
            new[starts] = valid[starts]
            self.first = np.flatnonzero(new)
            stop = np.flatnonzero(valid[:-1] & (new[1:] | ~valid[1:])) if len(h) > 1 else empty
            self.last = np.append(stop, len(h) - 1) if valid[-1] else stop
            self.key = h[self.first]
            self.content = mix((self.sums[self.last + length] - self.sums[self.first]) * self.inverse[self.first]) | U64(1)
            self.doc = np.searchsorted(s.offs, self.first, "right") - 1
        self.pair = mix(self.key ^ (self.content << U64(1)))
        self.own = ids[self.doc]
        # One run stands for equal ones: that of the smallest doc_id.
        order = np.lexsort((self.own, self.content, self.key))
        head = np.ones(len(order), bool)
        head[1:] = (self.key[order][1:] != self.key[order][:-1]) | (self.content[order][1:] != self.content[order][:-1])
        self.kept = order[head]
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(head) - 1
        k = self.key[self.kept]
        edge = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k)) if len(k) else np.zeros(1, np.int64)
        per_key = np.repeat(np.diff(edge), np.diff(edge))
        #: Of kept runs: whether their anchor has too many runs here to compare them as runs.
        self.many = per_key > MANY

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows of these runs: first byte, hash, doc_id."""
        n = self.last[runs] - self.first[runs] + 1
        at = np.arange(int(n.sum()), dtype=np.int64)
        at += np.repeat(self.first[runs] - np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), n)
        h = mix((self.sums[at + self.length] - self.sums[at]) * self.inverse[at])
        return at, h, np.repeat(self.own[runs], n)


BLOCK = "block long, ids binary, offs binary, data binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 24
    press = zstandard.ZstdCompressor(1)
    for batch in batches:
        ids, column = rows(batch, ["doc_id", "text"])
        null = ids.is_null().to_numpy(zero_copy_only=False)
        known = np.where(null, NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
        for s in text_slices(column, 2 << 20):
            values = [block, known[s.lo : s.hi].astype("<i8").tobytes(), s.offs.astype("<i8").tobytes(), press.compress(s.data.tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["block", "ids", "offs", "data"])
            block += 1


def _runs(ids: bytes, offs: bytes, data: bytes, length: int, anchor: int) -> Runs:
    o = np.frombuffer(offs, "<i8")
    raw = zstandard.ZstdDecompressor().decompress(data) if o[-1] else b""
    return Runs(Slice(0, len(o) - 1, np.frombuffer(raw, np.uint8), o), np.frombuffer(ids, "<i8"), length, anchor)


def _dealt(key: np.ndarray, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, and where each part begins in it."""
    part = ((key >> U64(32)) % U64(n_parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n_parts + 1))


def _short(column: np.ndarray) -> bytes:
    """48 bits of each hash."""
    return column.astype("<u8").view("<u2").reshape(-1, 4)[:, :3].tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 4), "<u2")
    out[:, :3] = np.frombuffer(raw, "<u2").reshape(-1, 3)
    return out.view("<u8").ravel()


def _steps(column: np.ndarray) -> bytes:
    """Numbers that mostly ascend: differences, pressed."""
    return zstandard.ZstdCompressor(1).compress(np.diff(column, prepend=column.dtype.type(0)).astype("<i8").tobytes())


def _added(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<i8"))


def _sent(block: int, names: list[str], columns: list[tuple[np.ndarray, object]], key: np.ndarray, n_parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each part that a block has entries of; columns with what writes them as bytes."""
    order, edge = _dealt(key, n_parts)
    full = np.flatnonzero(np.diff(edge))
    if len(full):
        cells = [[write(c[order[edge[p] : edge[p + 1]]]) for p in full] for c, write in columns]
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(np.full(len(full), block)), *[pa.array(c, pa.binary()) for c in cells]], names=["part", "block", *names])


def _column(table: pa.Table, name: str, read) -> np.ndarray:
    return np.concatenate([read(x) for x in table[name].to_pylist()])


def _replies(blocks: np.ndarray, chosen: np.ndarray, names: list[str], columns: list[np.ndarray]) -> pa.Table:
    """One row for each block that has chosen entries."""
    i = np.flatnonzero(chosen)
    i = i[np.argsort(blocks[i], kind="stable")]
    b = blocks[i]
    edge = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
    cells = [[c[i[x:y]].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)] for c in columns]
    return pa.table([pa.array(b[edge[:-1]], pa.int64()), *[pa.array(c, pa.binary()) for c in cells]], names=["block", *names])


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed spans as bytes of int64 pairs."""
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    blocks, _ = materialize(body.mapInArrow(freed(_blocks), BLOCK), "repeats-blocks", "none")
    # The parts of the key space follow the data: what four blocks send is one part's, about.
    n_parts = max(8, blocks.count() // 4)

    def send_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x = _runs(r["ids"], r["offs"], r["data"], length, anchor)
                # In order of place, so that places and doc_ids ascend; an anchor with many runs is only named, under content 0.
                k = np.sort(x.kept[~x.many])
                lots = x.kept[x.many]
                _, lead = np.unique(x.key[lots], return_index=True)
                i = np.concatenate([k, lots[lead]])
                content = np.concatenate([x.content[k], np.zeros(len(lead), U64)])
                at = np.concatenate([k, np.full(len(lead), -1)])
                yield from _sent(r["block"], ["key", "content", "own", "at"], [(x.key[i], _short), (content, _short), (x.own[i], _steps), (at, _steps)], x.key[i], n_parts)

    def compare_runs(table: pa.Table) -> pa.Table:
        key, content = _column(table, "key", _long), _column(table, "content", _long)
        own, at = _column(table, "own", _added), _column(table, "at", _added)
        block = np.repeat(table["block"].to_numpy(), [len(x) // 6 for x in table["key"].to_pylist()])
        # Runs are equal if anchor and content are, 96 bits together; they are numbered in that order.
        order = np.lexsort((own, content, key))
        k, c, o = key[order], content[order], own[order]
        number = np.zeros(len(k), U64)
        number[order] = np.cumsum(np.append(False, (k[1:] != k[:-1]) | (c[1:] != c[:-1])))[: len(k)].astype(U64)
        low = smaller(number, own)
        # Anchors with different runs in different documents: windows of the runs' first documents are compared.
        edge = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])), len(k))
        differ = np.zeros(len(k), np.int64)
        differ[1:] = (k[1:] == k[:-1]) & ((c[1:] != c[:-1]) | ((c[1:] == 0) & (o[1:] != o[:-1])))
        many = np.add.reduceat(differ, edge[:-1]) > 0
        apart = np.maximum.reduceat(o, edge[:-1]) > np.minimum.reduceat(o, edge[:-1])
        contested = np.zeros(len(k), bool)
        contested[order] = np.repeat(many & apart, np.diff(edge))
        covered = (low < own) & (at >= 0)
        one = _replies(block, covered, ["at", "low"], [at.astype("<i4"), low])
        two = _replies(block, contested & (low == own) & (at >= 0), ["at", "low"], [at.astype("<i4"), low])
        return pa.concat_tables([one.append_column("kind", pa.array(np.zeros(len(one), np.int32))), two.append_column("kind", pa.array(np.ones(len(two), np.int32)))])

    reply = "block long, at binary, low binary, kind int"
    runs = "part long, block long, key binary, content binary, own binary, at binary"
    settled, _ = materialize(blocks.mapInArrow(freed(send_runs), runs).groupBy("part").applyInArrow(compare_runs, reply), "repeats-runs", "none")
    release(spark)

    def to_compare(x: Runs, table: pa.Table) -> np.ndarray:
        """The runs whose windows are compared one by one."""
        ask = np.concatenate([np.frombuffer(a, "<i4") for a, kind in zip(table["at"].to_pylist(), table["kind"].to_pylist(), strict=True) if kind == 1] or [np.zeros(0, np.int32)])
        return np.concatenate([ask, x.kept[x.many]])

    def send_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            x = _runs(r["ids"], r["offs"], r["data"], length, anchor)
            _, h, own = x.windows(to_compare(x, right))
            h, own = _smallest(h, own)
            i = np.argsort(own, kind="stable")
            out += _sent(r["block"], ["key", "own"], [(h[i], np.ndarray.tobytes), (own[i], _steps)], h[i], n_parts)
        return pa.Table.from_batches(out, pa.schema([("part", pa.int64()), ("block", pa.int64()), ("key", pa.binary()), ("own", pa.binary())]))

    def compare_windows(table: pa.Table) -> pa.Table:
        key, own = _column(table, "key", lambda x: np.frombuffer(x, "<u8")), _column(table, "own", _added)
        block = np.repeat(table["block"].to_numpy(), [len(x) // 8 for x in table["key"].to_pylist()])
        low = smaller(key, own)
        found = _replies(block, low < own, ["at", "low"], [key, low])
        return found.append_column("kind", pa.array(np.full(len(found), 2, np.int32)))

    sent = "part long, block long, key binary, own binary"
    windows, _ = materialize(blocks.groupBy("block").cogroup(settled.groupBy("block")).applyInArrow(send_windows, sent).groupBy("part").applyInArrow(compare_windows, reply), "repeats-windows", "none")
    release(spark)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            x = _runs(r["ids"], r["offs"], r["data"], length, anchor)
            out.append(_removed(x, right, to_compare(x, right)))
        return pa.concat_tables(out) if out else pa.Table.from_pylist([], _OUT)

    return blocks.groupBy("block").cogroup(settled.unionByName(windows).groupBy("block")).applyInArrow(finish, OUT)


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary"
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.binary())])


def _removed(x: Runs, replies: pa.Table, compared: np.ndarray) -> pa.Table:
    s = x.slice
    change = np.zeros(len(s.data) + 1, np.int32)
    # Runs: the smallest doc_id of equal runs, here or elsewhere, is smaller than the run's own.
    low = x.own[x.kept].copy()
    keys, lows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for at, got, kind in zip(replies["at"].to_pylist(), replies["low"].to_pylist(), replies["kind"].to_pylist(), strict=True):
        if kind == 0:
            low[x.group[np.frombuffer(at, "<i4")]] = np.frombuffer(got, "<i8")
        elif kind == 2:
            keys.append(np.frombuffer(at, "<u8"))
            lows.append(np.frombuffer(got, "<i8"))
    run = np.flatnonzero(low[x.group] < x.own)
    np.add.at(change, x.first[run], 1)
    np.add.at(change, x.last[run] + x.length, -1)
    # Windows: all runs equal to a compared one are looked up, and windows of this block among themselves.
    if len(compared):
        of = np.zeros(len(x.kept), bool)
        of[x.group[compared]] = True
        at, h, own = x.windows(np.flatnonzero(of[x.group]))
        k, d = _smallest(np.concatenate([h, *keys]), np.concatenate([own, *lows]))
        i = np.flatnonzero(d[np.searchsorted(k, h)] < own)
        np.add.at(change, at[i], 1)
        np.add.at(change, at[i] + x.length, -1)
    gone = np.cumsum(change[:-1]) > 0
    n_docs = len(s.offs) - 1
    lo, hi = s.offs[:-1], s.offs[1:]
    before = gone.copy()
    before[1:] &= ~gone[:-1]
    heads = lo[lo < len(gone)]
    before[heads] = gone[heads]
    total = np.concatenate([[0], np.cumsum(gone)])
    spans = np.concatenate([[0], np.cumsum(before)])
    raw, digests, kept = s.data, [], []
    for d in range(n_docs):
        a, b = int(lo[d]), int(hi[d])
        piece, g = raw[a:b], gone[a:b]
        edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8))) if total[b] > total[a] else np.zeros(0, np.int64)
        kept.append(edge.astype("<i8").tobytes())
        digests.append(hashlib.sha256(piece[~g].tobytes() if len(edge) else piece.tobytes()).hexdigest())
    ids = pa.array(x.ids, mask=x.ids == NO_ID)
    return pa.table([ids, pa.array(hi - lo), pa.array(total[hi] - total[lo]), pa.array(spans[hi] - spans[lo]), pa.array(digests), pa.array(kept, pa.binary())], schema=_OUT)


def cut(text: bytes, spans: bytes) -> bytes:
    """``text`` without the spans."""
    edge, out, at = np.frombuffer(spans, "<i8").tolist(), [], 0
    for lo, hi in zip(edge[::2], edge[1::2], strict=True):
        out.append(text[at:lo])
        at = hi
    return b"".join([*out, text[at:]])
