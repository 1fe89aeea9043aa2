"""Benchmark decontamination with a generalised suffix automaton.

All test items go into one automaton over word numbers; a separator that no
text holds keeps matches inside an item.  Training words are streamed through
it: at each word the state gives the longest stretch of words, ending there,
that some item holds.  Where the length reaches a window (13 words, or a whole
shorter item), those words are hit.

Most stretches can't reach a window, and the automaton isn't stepped there: a
bitmap over k-word hashes of the items (k = 3, or the shortest window if less)
leaves only runs long enough to hold one.  The bitmap has false positives and
no false negatives; the automaton decides, on the words themselves.

Items are split into groups of at most ``max_words`` words, one automaton a
group and one broadcast each, so that memory is bounded however many items
there are; hits of several groups are united by a number of the row.

Nulls and empty texts have no words: such a document has 0 hits and isn't
contaminated, such an item has no window.  Item ids that repeat count once.
Items without an id count as one item together, which has no name in
items_sha256.  Repeated documents are judged each by itself.  A text is never
cut: one longer than a slice is a slice of its own.  No documents give no
rows, no items no hits.  Extra columns are ignored.
"""

from __future__ import annotations


from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U64, Slice, freed, rows, text_slices
from .storage import keep_batches_small, materialize

WINDOW = 13
_BITS = 22


class SuffixAutomaton:
    """Generalised over items of word numbers. ``items[s]`` has the items that hold the longest string of state s."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        self.items.append(set())
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, word, q)
        cur, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return cur

    def _split(self, p: int, word: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def own(self, item: int, words: list[int]) -> None:
        """Once all items are added: note the item at each state that spells a part of it."""
        s = 0
        for w in words:
            s = self.next[s][w]
            p = s
            while p > 0 and item not in self.items[p]:
                self.items[p].add(item)
                p = self.link[p]

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0


class Matcher:
    """The automaton of a group of items, and the bitmap that says where to step it."""

    def __init__(self, items: list[tuple[object, str | None]], window: int = WINDOW):
        self.window = window
        texts = pa.array([t for _, t in items], pa.string())
        self.numbers: dict[bytes, int] = {}
        self.ids = [i for i, _ in items]
        spelled: list[list[int]] = []
        for s in text_slices(texts):
            a, b, wo = s.words("alnum")
            low = _lower(s.data).tobytes()
            for d in range(s.n_docs):
                spelled.append([self.numbers.setdefault(low[x:y], len(self.numbers)) for x, y in zip(a[wo[d] : wo[d + 1]].tolist(), b[wo[d] : wo[d + 1]].tolist(), strict=True)])
        self.automaton = SuffixAutomaton()
        for w in spelled:
            self.automaton.add(w)
        for i, w in enumerate(spelled):
            self.automaton.own(i, w)
        #: Whole items shorter than a window, by their words.
        self.short: dict[tuple[int, ...], list[int]] = {}
        for i, w in enumerate(spelled):
            if 0 < len(w) < window:
                self.short.setdefault(tuple(w), []).append(i)
        self.short_lengths = sorted({len(w) for w in self.short})
        self.least = min([len(w) for w in spelled if 0 < len(w) < window], default=window)
        self.k = min(3, self.least)
        self.bitmap = np.zeros(1 << _BITS, bool)
        for s in text_slices(texts):
            self.bitmap[self._grams(s)[0]] = True

    def _grams(self, s: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b, wo = s.words("alnum")
        h = s.word_hashes(a, b, True)
        g = h.copy()
        for j in range(1, self.k):
            g[:-j] += h[j:] * U64(2 * j + 1) if len(h) > j else U64(0)
        return (g >> U64(64 - _BITS)).astype(np.int64), a, b, wo

    def match(self, s: Slice) -> Iterator[tuple[int, int, list[tuple[int, int]], set[int]]]:
        """For each document of the slice: its index, words, hit spans of words (apart, ascending), and the indices of items."""
        g, a, b, wo = self._grams(s)
        n = len(a)
        maybe = self.bitmap[g] if n else np.zeros(0, bool)
        if n:  # no gram spans two documents
            for j in range(1, self.k):
                last = wo[1:] - j
                maybe[last[last >= wo[:-1]]] = False
        edge = np.flatnonzero(np.diff(np.concatenate([[False], maybe, [False]])))
        runs = edge.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] + self.k - 1 >= self.least]
        found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
        docs = np.searchsorted(wo, runs[:, 0], "right") - 1
        for d, (lo, hi) in zip(docs.tolist(), runs.tolist(), strict=True):
            hi = min(hi + self.k - 1, int(wo[d + 1]))
            low = _lower(s.data[a[lo] : b[hi - 1]]).tobytes()
            base = int(a[lo])
            words = [self.numbers.get(low[x - base : y - base], -1) for x, y in zip(a[lo:hi].tolist(), b[lo:hi].tolist(), strict=True)]
            spans, items = found.setdefault(d, ([], set()))
            self._run(words, lo - int(wo[d]), spans, items)
        for d in range(s.n_docs):
            spans, items = found.get(d, ([], set()))
            yield d, int(wo[d + 1] - wo[d]), spans, items

    def _run(self, words: list[int], at: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        auto, state, length = self.automaton, 0, 0
        for i, w in enumerate(words):
            state, length = auto.step(state, length, w)
            reach = 0
            if length >= self.window:
                p = state
                while auto.length[auto.link[p]] >= self.window:
                    p = auto.link[p]
                items |= auto.items[p]
                reach = self.window
            for m in self.short_lengths:
                if m > length:
                    break
                if got := self.short.get(tuple(words[i + 1 - m : i + 1])):
                    items.update(got)
                    reach = max(reach, m)
            if reach:
                lo, hi = at + i + 1 - reach, at + i + 1
                while spans and lo <= spans[-1][1]:
                    lo = min(lo, spans.pop()[0])
                spans.append((lo, hi))


def _lower(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def names_of(ids: Iterable[object]) -> list[str | None]:
    """Distinct ids as strings, in order; null, the items without an id, comes last."""
    distinct = set(ids)
    named = sorted({str(i) for i in distinct if i is not None})
    return [*named, None] if None in distinct else named


SCHEMA = "row long, doc_id long, n_words long, spans array<struct<lo:long,hi:long>>, items array<string>"


def _groups(items: DataFrame, item_id: str, text: str, max_words: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in groups of at most about max_words words; one group at a time is on the driver."""
    group, size = [], 0
    for r in items.select(F.col(item_id), F.col(text)).orderBy(item_id, text).toLocalIterator():
        group.append((r[0], r[1]))
        size += 1 + len(r[1] or "") // 4
        if size >= max_words:
            yield group
            group, size = [], 0
    if group:
        yield group


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = 200_000, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Of each document: words, hit spans (in words) and items with a window in it.

    With several groups the documents are written once, with a number each.
    """
    spark = docs.sparkSession
    body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    groups = [spark.sparkContext.broadcast(Matcher(g, window)) for g in _groups(items, item_id, item_text, max_words)]
    if len(groups) > 1:
        body, _ = materialize(body.withColumn("row", F.monotonically_increasing_id()), "decontaminate-rows")
    else:
        body = body.withColumn("row", F.lit(0).cast("long"))
    parts = []
    for cast in groups:

        def scan(batches, cast=cast, every=not parts):
            m = cast.value
            for batch in batches:
                row, ids, column = rows(batch, ["row", "doc_id", "text"])
                for s in text_slices(column):
                    # Of a further group, only documents with hits.
                    got = [x for x in m.match(s) if every or x[3]]
                    at = pa.array([s.lo + x[0] for x in got], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [
                            row.take(at),
                            ids.take(at),
                            pa.array([x[1] for x in got], pa.int64()),
                            pa.array([[{"lo": lo, "hi": hi} for lo, hi in x[2]] for x in got], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))),
                            pa.array([names_of(m.ids[i] for i in x[3]) for x in got], pa.list_(pa.string())),
                        ],
                        names=["row", "doc_id", "n_words", "spans", "items"],
                    )

        parts.append(body.mapInArrow(freed(scan), SCHEMA))
    if not parts:
        words = F.regexp_count(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        return body.select("doc_id", words.cast("long").alias("n_words"), F.expr("cast(array() as array<struct<lo:long,hi:long>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    if len(parts) == 1:
        return parts[0].drop("row")
    return _united(parts)


def _united(parts: list[DataFrame]) -> DataFrame:
    """Hits of several groups, by row."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = F.expr(
        """aggregate(s, cast(array() as array<struct<lo:long,hi:long>>), (a, x) ->
             if(size(a) > 0 and x.lo <= a[size(a) - 1].hi,
                concat(slice(a, 1, size(a) - 1), array(named_struct('lo', a[size(a) - 1].lo, 'hi', greatest(a[size(a) - 1].hi, x.hi)))),
                concat(a, array(x))))"""
    )
    return out.select("doc_id", "n_words", merged.alias("spans"), "items")


def judged(found: DataFrame, percent: int = 5) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated: hit words make up ``percent`` or more of the document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["hi"] - x["lo"])
    return found.withColumn("n_hit", n_hit).select(
        "*",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * percent)).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = 200_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that aren't contaminated, whole rows; judged against each group of items in turn.

    With several groups a document's hits are united by a number of the row.
    """
    spark = docs.sparkSession
    groups = [spark.sparkContext.broadcast(Matcher(g, window)) for g in _groups(items, item_id, item_text, max_words)]
    keep_batches_small(spark)
    place = docs.columns.index(text)
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = body.schema["row"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            row = batch.column(0)
            for s in text_slices(row.field(place)):
                n_words = np.zeros(s.n_docs, np.int64)
                spans: list[list[tuple[int, int]]] = [[] for _ in range(s.n_docs)]
                for g in groups:
                    for d, n, found, _ in g.value.match(s):
                        n_words[d] = n
                        spans[d] += found
                hit = np.array([covered(x) for x in spans], np.int64)
                keep = (hit == 0) | (20 * hit < n_words)
                yield pa.RecordBatch.from_arrays([row.slice(s.lo, s.n_docs).filter(pa.array(keep))], names=["row"])

    return body.mapInArrow(freed(judge), f"row {kind}").select("row.*")


def without_spans(docs: DataFrame, items: DataFrame, least: int = 1, window: int = WINDOW, max_words: int = 200_000, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with spans of ``least`` hit words or more cut out of their texts; all rows stay.

    Spans of all groups of items are united before they are measured.  Nulls
    stay null.
    """
    spark = docs.sparkSession
    groups = [spark.sparkContext.broadcast(Matcher(g, window)) for g in _groups(items, item_id, item_text, max_words)]
    body = docs.select(F.col(text).alias("text"), F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("rest"))
    kind = body.schema["rest"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, rest = rows(batch, ["text", "rest"])
            for s in text_slices(column):
                spans: list[list[tuple[int, int]]] = [[] for _ in range(s.n_docs)]
                for g in groups:
                    for d, _, found, _ in g.value.match(s):
                        spans[d] += found
                out = column.slice(s.lo, s.n_docs).to_pylist()
                for d in range(s.n_docs):
                    if own := [x for x in united(spans[d]) if x[1] - x[0] >= least]:
                        out[d] = removed_spans(out[d], own)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), rest.slice(s.lo, s.n_docs)], names=["text", "rest"])

    got = body.mapInArrow(freed(cut), f"text string, rest {kind}")
    return got.select(*[F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for lo, hi in sorted(spans):
        total += max(0, hi - max(lo, end))
        end = max(end, hi)
    return total


def removed_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without its hit words, from the start of each span's first word to the end of its last."""
    s = next(text_slices(pa.array([text])), None)
    if s is None:
        return text
    a, b, _ = s.words("alnum")
    raw, out, at = s.data.tobytes(), [], 0
    for lo, hi in spans:
        out.append(raw[at : int(a[lo])])
        at = int(b[hi - 1])
    return b"".join([*out, raw[at:]]).decode()


