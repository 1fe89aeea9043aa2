"""Exact Jaccard join of documents by distinct five-word shingles.

The distance 1 - J is a metric, so a pivot p tells about a pair without
comparing it: d(x, y) is at least |d(x, p) - d(y, p)| and at most their sum.
But nearly all documents are at distance 1 from nearly all others, and no
pivot separates those.  So the space is cut into regions first, by shingles: a
pair with J >= t shares one of the first n - ceil(t * n) + 1 shingles of both
(in one global order, common shingles last), and the documents that have such
a shingle there are a region.  Within regions:

* The member with the smallest seeded hash is the pivot; all members are
  compared to it (a star, not all pairs), and linked if near.
* Members at distance up to 1 - t (the ball) are connected through the pivot.
  Members beyond twice that can't link to the ball.  So what is left is what
  is outside the ball, and, if some of it is in the window between the two
  radii, those of the ball that the triangle inequality leaves within reach.
* What is left of all regions with the same pivot is that pivot's cell: a
  document is repeated in the cells of its pivots, not in all its regions.

A cell of up to ``MEMBERS`` members and ``SHINGLES`` shingles is joined in one
task.  A larger one is divided into Voronoi regions: some members, by hash, are
pivots, and all are compared to them.  A member's home is its nearest pivot,
or, if that is as far as 1 - r (r = 1 - t), the rest.  If d(x, y) <= r and
y's home is q, then d(x, q) <= d(y, q) + r <= d(y, p) + r <= d(x, p) + 2r for
x's nearest pivot p, and d(x, q) < 1; so each member is repeated in all regions
with d(x, q) <= d(x, p) + 2r and d(x, q) < 1, and any two that link meet in the
home of one of them, or in the rest.  Regions that are still large are divided
again.  A cell whose regions, but for those that are all connected by then,
hold its members more than ``REPEATS`` times, or that is large after ``ROUNDS``
rounds, is joined in blocks: any two members meet in one of its pairs of
blocks.

Only connections count, so pairs known to be connected aren't compared.  Every
link between two components is found; no region, partner or candidate is
capped.

Equal sets are one class from the start (their documents are linked), known by
a 64-bit fingerprint; shingles are 64-bit hashes.  A document with fewer than
five words has one shingle, all its words; one without words has none and is
linked with nothing.  Null texts have no words.  A null doc_id is larger than
all others.  Repeated rows are members of one class; a class is read again from
the rows of one doc_id and one text, so many rows without an id, or with one
id, don't multiply.  A text is never cut: one longer than a slice is a slice of
its own.  No rows give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .kernel import U64, Slice, freed, mix, rows, shingle_hashes, text_slices
from .storage import discard, keep_batches_small, materialize, release

WORDS = 5
PERCENT = 75
#: A cell of up to so many members and shingles is finished in one task.
MEMBERS, SHINGLES = 4096, 1 << 22
#: Pivots of a larger cell, about; results don't change with these four.
PIVOTS, REPEATS, ROUNDS, SALTS = 16, 2, 8, 32
#: Tokens of a part of the shingle space, about.
PART_TOKENS = 1 << 20
#: Common shingles kept in order; more of them only make regions larger, results don't change.
MAX_COMMON = 1 << 17
NO_ID = (1 << 63) - 1


class Sets:
    """Sorted distinct shingle hashes of each document of a slice."""

    def __init__(self, s: Slice, k: int = WORDS):
        a, b, wo = s.words("space")
        h = s.word_hashes(a, b, True)
        sh, _, first = shingle_hashes(h, wo, k)
        n_words = np.diff(wo)
        short = np.flatnonzero((n_words > 0) & (n_words < k))
        doc = np.repeat(np.arange(s.n_docs), np.diff(first))
        if len(short):
            own = np.zeros(len(short), U64)
            for j in range(k - 1):
                has = n_words[short] > j
                own[has] += h[wo[:-1][short[has]] + j] * U64(2 * j + 3)
            own = mix(own + n_words[short].astype(U64))
            sh, doc = np.concatenate([sh, own]), np.concatenate([doc, short])
        order = np.lexsort((sh, doc))
        sh, doc = sh[order], doc[order]
        keep = np.ones(len(sh), bool)
        keep[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
        self.hashes, self.doc = sh[keep], doc[keep]
        self.n = np.bincount(self.doc, minlength=s.n_docs).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        sums = []
        for salt in (0x9FB21C651E98DF25, 0xD1342543DE82EF95):
            c = np.zeros(len(self.hashes) + 1, U64)
            np.cumsum(mix(self.hashes * U64(salt)), out=c[1:])
            sums.append(c[self.first[1:]] - c[self.first[:-1]])
        self.cls = mix(mix(sums[0]) + sums[1] + self.n.astype(U64)).view(np.int64)


def prefix_length(n: np.ndarray, percent: int, level: int = 1) -> np.ndarray:
    return np.minimum(n, n - (n * percent + 99) // 100 + level)


def prefix(sets: Sets, common: np.ndarray, rank: np.ndarray, percent: int, level: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each document, its first shingles in the global order: rarest first, then by hash."""
    late = np.zeros(len(sets.hashes), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, sets.hashes), len(common) - 1)
        late = np.where(common[at] == sets.hashes, rank[at], 0)
    order = np.lexsort((sets.hashes, late, sets.doc))
    place = np.arange(len(order)) - sets.first[sets.doc]
    keep = place < prefix_length(sets.n, percent, level)[sets.doc]
    return sets.hashes[order][keep], sets.doc[keep]


def n_bits(n: int) -> int:
    """Bits of the signature of n shingles: a power of two, four a shingle or more."""
    return max(256, 1 << (4 * n - 1).bit_length())


def signature(hashes: np.ndarray) -> bytes:
    """Bit h mod n_bits for each shingle h.

    A bit that only one of two signatures has means a shingle that only one
    set has.  Of signatures of different lengths, the longer is folded.
    """
    bits = np.zeros(n_bits(len(hashes)), bool)
    bits[(hashes & U64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def folded(sign: np.ndarray, size: int) -> np.ndarray:
    """Signatures (one a row, as uint64) of ``size`` words."""
    while sign.shape[-1] > size:
        half = sign.shape[-1] // 2
        sign = sign[..., :half] | sign[..., half:]
    return sign


def least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference."""
    a, b = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys, column = rows(batch, ["doc_id", "key", "text"])
        for s in text_slices(column):
            x = Sets(s)
            u, n = np.unique(x.hashes, return_counts=True)
            often = np.flatnonzero(n >= 4)
            often = often[np.argsort(-n[often], kind="stable")[:4096]]
            note = np.stack([u[often].view(np.int64), n[often]], 1).astype("<i8").tobytes()
            own = ids.slice(s.lo, s.n_docs).fill_null(NO_ID)
            notes = pa.array([note if d == 0 and len(often) else None for d in range(s.n_docs)], pa.binary())
            _, lead = np.unique(x.cls, return_index=True)
            signs: list[bytes | None] = [None] * s.n_docs
            for d in lead.tolist():
                signs[d] = signature(x.hashes[x.first[d] : x.first[d + 1]])
            yield pa.RecordBatch.from_arrays([own, keys.slice(s.lo, s.n_docs), pa.array(x.n), pa.array(x.cls), notes, pa.array(signs, pa.binary())], names=["doc_id", "key", "n", "cls", "common", "sign"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for note in batch.column(0).to_pylist():
            x = np.frombuffer(note, "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["shingle", "n"])


def _packed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _share(table: pa.Table) -> pa.Table:
    """Of the part's shingles, those of two classes or more."""
    token, cls, n = (_packed(table[c], k) for c, k in (("token", "<u8"), ("cls", "<i8"), ("n", "<i4")))
    order = np.lexsort((cls, token))
    token, cls, n = token[order], cls[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
    token, cls, n = token[new], cls[new], n[new]
    edge = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(token)) if len(token) else np.zeros(1, np.int64)
    keep = np.repeat(np.diff(edge) > 1, np.diff(edge))
    return pa.table({"region": token[keep].view(np.int64), "cls": cls[keep], "n": n[keep].astype(np.int64)})


def connected(edges: DataFrame) -> DataFrame:
    """Rows a, root of the undirected edges (a, b): root is the smallest id of a's component.

    What an a is linked to is first joined by the least of it, so that members
    linked to several pivots leave one edge each and few between pivots; then
    large and small stars alternate.  Each round is written, none is held.
    """
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    edges = edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.toDF("a", "b"))
    spark = edges.sparkSession
    now, path = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(low.select("a", F.col("m").alias("b")))
        before = path
        now, path = materialize(small.distinct(), "components")
        discard(spark, before)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(got) == mark:
            return now.select("a", F.col("b").alias("root"))
        mark = tuple(got)


def _near(n: np.ndarray, sign: list[np.ndarray], root: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """Members of a cell, sorted by size, each with the later ones that sizes, signatures and components don't rule out.

    ``root`` may change between steps.
    """
    width = np.array([len(x) for x in sign])
    for w in np.unique(width).tolist():
        # Sizes that may link differ by less than two, and signatures by one fold.
        at = np.flatnonzero((width == w) | (width == 2 * w))
        block = np.stack([folded(sign[i], w) for i in at.tolist()])
        for row, i in enumerate(at.tolist()):
            if width[i] != w:
                break
            hi = int(np.searchsorted(n[at], n[i] * 100 // percent, "right"))
            j = np.arange(row + 1, hi)
            j = j[root[at[j]] != root[i]]
            apart = np.bitwise_count(block[j] ^ block[row]).sum(axis=1)
            yield i, at[j[apart * (100 + percent) <= (n[at[j]] + n[i]) * (100 - percent)]]


def _cell(percent: int):
    """Of a cell, the members that may link to another component."""

    def find(table: pa.Table) -> pa.Table:
        n, root = table["n"].to_numpy(), table["root"].to_numpy()
        order = np.argsort(n, kind="stable")
        raw = table["sign"].to_pylist()
        some = np.zeros(len(n), bool)
        for i, j in _near(n[order], [np.frombuffer(raw[k], "<u8") for k in order.tolist()], root[order], percent):
            if len(j):
                some[order[i]] = some[order[j]] = True
        return table.select(["p", "cls", "n", "root"]).filter(pa.array(some))

    return find


def _cell_links(percent: int):
    """Links that connect those members: sets decide, and what is connected isn't compared again."""

    def join(table: pa.Table) -> pa.Table:
        order = np.argsort(table["n"].to_numpy(), kind="stable")
        n, cls = table["n"].to_numpy()[order], table["cls"].to_numpy()[order]
        sets = [np.frombuffer(table["hashes"][int(k)].as_buffer(), "<u8") for k in order]
        _, root = np.unique(table["root"].to_numpy()[order], return_inverse=True)
        a, b = [], []
        for i, j in _near(n, [np.frombuffer(signature(x), "<u8") for x in sets], root, percent):
            for k in j.tolist():
                if root[k] == root[i]:
                    continue
                x, y = sets[i], sets[k]
                same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if same * 100 >= (len(x) + len(y) - same) * percent:
                    a.append(cls[k])
                    b.append(cls[i])
                    root[root == root[k]] = root[i]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return join


class Join:
    def __init__(self, docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text"):
        if not 50 <= percent <= 100:
            # Signatures of sets fold once at most, so sizes may differ by a factor of two.
            raise ValueError("percent must be 50 to 100")
        self.spark, self.percent = docs.sparkSession, percent
        self.body = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("key"))

    def run(self) -> tuple[DataFrame, DataFrame]:
        """Members (doc_id, n, cls) and, of each class that links to another, its root class."""
        measured, path = materialize(self.body.mapInArrow(freed(_measure), "doc_id long, key long, n long, cls long, common binary, sign binary"), "jaccard-measured")
        notes = measured.where("common is not null").select("common").mapInArrow(freed(_common), "shingle long, n long")
        often = notes.groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(MAX_COMMON).collect()
        hashes = np.array([r["shingle"] for r in often], np.int64).view(U64)
        rank = np.array([r["n"] for r in often], np.int64)
        order = np.argsort(hashes)
        self.order = self.spark.sparkContext.broadcast((hashes[order], rank[order]))
        members, _ = materialize(measured.select("doc_id", "n", "cls"), "jaccard-members")
        first = measured.where("n > 0").groupBy("cls").agg(F.min(F.struct("doc_id", "key")).alias("at"), F.first("n").alias("n"), F.first("sign", True).alias("sign"))
        self.classes, _ = materialize(first.select("cls", "at.doc_id", "at.key", "n", "sign"), "jaccard-classes")
        # Whether a row, by doc_id and text, occurs more than once.
        self.repeated = not measured.where("n > 0").groupBy("doc_id", "key").count().where("count > 1").isEmpty()
        discard(self.spark, path)
        # A set sends n - ceil(t * n) + 1 tokens; the parts follow the data.
        tokens = self.classes.agg(F.sum(F.col("n") * (100 - self.percent) / 100 + 1)).first()[0] or 0
        self.n_parts = max(64, int(tokens // PART_TOKENS))
        regions, path = materialize(self._regions(), "jaccard-regions")
        release(self.spark)
        roots = self._joined(regions)
        discard(self.spark, path)
        return members, roots

    def _regions(self) -> DataFrame:
        order, percent, n_parts = self.order, self.percent, self.n_parts

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common, rank = order.value
            for batch in batches:
                (column,) = rows(batch, ["text"])
                for s in text_slices(column):
                    x = Sets(s)
                    token, doc = prefix(x, common, rank, percent)
                    # Of equal sets in the slice, one is sent.
                    _, lead = np.unique(x.cls, return_index=True)
                    one = np.zeros(s.n_docs, bool)
                    one[lead] = True
                    token, doc = token[one[doc]], doc[one[doc]]
                    part = ((token >> U64(32)) % U64(n_parts)).astype(np.int64)
                    by = np.argsort(part, kind="stable")
                    edge = np.searchsorted(part[by], np.arange(n_parts + 1))
                    full = np.flatnonzero(np.diff(edge))
                    columns = [token[by], x.cls[doc][by], x.n[doc][by].astype(np.int32)]
                    cells = [pa.array([c[edge[p] : edge[p + 1]].tobytes() for p in full], pa.binary()) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), *cells], names=["part", "token", "cls", "n"])

        sent = self.body.select("text").mapInArrow(freed(send), "part long, token binary, cls binary, n binary")
        return sent.groupBy("part").applyInArrow(_share, "region long, cls long, n long")

    def _sets(self, need: DataFrame) -> tuple[DataFrame, str]:
        """The shingles of one document of each class in ``need``, and where they are written."""
        need = self.classes.select("cls", "doc_id", "key").join(need.select("cls").distinct(), "cls")
        texts = self.body.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(need, ["doc_id", "key"])

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cls, column = rows(batch, ["cls", "text"])
                want = cls.to_numpy()
                for s in text_slices(column):
                    x = Sets(s)
                    mine = np.flatnonzero(x.cls == want[s.lo : s.hi])
                    cells = [x.hashes[x.first[d] : x.first[d + 1]].tobytes() for d in mine]
                    yield pa.RecordBatch.from_arrays([pa.array(x.cls[mine]), pa.array(cells, pa.binary())], names=["cls", "hashes"])

        found = texts.select("cls", "text").mapInArrow(freed(sets), "cls long, hashes binary")
        return materialize(found.dropDuplicates(["cls"]) if self.repeated else found, "jaccard-sets", "none")

    def _bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs (lo, hi, n, pn) with ``apart``, a lower bound of their symmetric difference."""
        side = self.classes.select("cls", "sign")
        both = pairs.join(side.toDF("hi", "y"), "hi").join(side.toDF("lo", "x"), "lo")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                apart = [least_apart(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows(batch, ["lo", "hi", "n", "pn"]), pa.array(apart, pa.int64())], names=["lo", "hi", "n", "pn", "apart"])

        return both.select("lo", "hi", "n", "pn", "x", "y").mapInArrow(freed(compare), "lo long, hi long, n long, pn long, apart long")

    def _compared(self, pairs: DataFrame) -> tuple[DataFrame, str]:
        """Exact sizes of intersection and union of pairs (lo, hi), and where they are written.

        A class in very many pairs is a pivot; its set is sent to as many
        tasks as its pairs need, dealt by salt.
        """
        sets, path = self._sets(pairs.select(F.explode(F.array("lo", "hi")).alias("cls")))
        release(self.spark)
        often = pairs.groupBy("lo").agg(F.ceil(F.count("*") / 512).cast("int").alias("salts"))
        pairs = pairs.join(often, "lo").withColumn("salt", F.pmod(F.xxhash64("hi"), F.col("salts")).cast("int"))
        spread = often.join(sets.toDF("lo", "x"), "lo")
        spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("lo", "salt", "x")
        both = pairs.select("lo", "hi", "salt").join(sets.toDF("hi", "y"), "hi").join(spread, ["lo", "salt"]).select("lo", "hi", "x", "y")

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                shared, whole = [], []
                for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                    a, b = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                    if len(a) > len(b):
                        a, b = b, a
                    same = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
                    shared.append(same)
                    whole.append(len(a) + len(b) - same)
                yield pa.RecordBatch.from_arrays([batch.column("lo"), batch.column("hi"), pa.array(shared, pa.int64()), pa.array(whole, pa.int64())], names=["lo", "hi", "shared", "whole"])

        verified, at = materialize(both.mapInArrow(freed(compare), "lo long, hi long, shared long, whole long"), "jaccard-verified")
        discard(self.spark, path)
        return verified, at

    def _sizes_allow(self, n: str, m: str) -> Column:
        return F.least(n, m) * 100 >= F.greatest(n, m) * self.percent

    def _linked(self, verified: DataFrame) -> DataFrame:
        return verified.where(F.col("shared") * 100 >= F.col("whole") * self.percent).select(F.col("hi").alias("a"), F.col("lo").alias("b"))

    def _joined(self, regions: DataFrame) -> DataFrame:
        radius, slack = 1 - self.percent / 100, 1e-12
        least = F.min(F.struct(F.xxhash64("cls").alias("h"), F.col("cls").alias("p"), F.col("n").alias("pn"))).alias("pivot")
        pivots = regions.groupBy("region").agg(least).select("region", "pivot.p", "pivot.pn")
        stars = regions.join(pivots, "region").where("cls != p").withColumn("near", self._sizes_allow("n", "pn"))
        # The pivot is the side that may be salted.
        pairs = stars.where("near").select(F.col("p").alias("lo"), F.col("cls").alias("hi"), "n", "pn").distinct()
        bounded, at_bounded = materialize(self._bounded(pairs), "jaccard-bounded")
        maybe = F.col("apart") * (100 + self.percent) <= (F.col("n") + F.col("pn")) * (100 - self.percent)
        verified, at_verified = self._compared(bounded.where(maybe).select("lo", "hi"))
        roots = connected(self._linked(verified))
        # Where sizes or signatures rule a pair out, it is at least so far apart.
        total = F.col("n") + F.col("pn")
        far = bounded.select(F.col("lo").alias("p"), F.col("hi").alias("cls"), (1 - (total - F.col("apart")) / (total + F.col("apart"))).alias("far"))
        got = verified.select(F.col("lo").alias("p"), F.col("hi").alias("cls"), (1 - F.col("shared") / F.col("whole")).alias("exact"))
        known = stars.join(far.join(got, ["p", "cls"], "left"), ["p", "cls"], "left").join(roots.withColumnRenamed("a", "cls"), "cls", "left")
        known = known.select("region", "p", "cls", "n", F.coalesce("root", "cls").alias("root"), "exact", F.coalesce("exact", "far", 1 - F.least("n", "pn") / F.greatest("n", "pn")).alias("d"))
        known, at_known = materialize(known, "jaccard-known")
        discard(self.spark, at_bounded, at_verified)
        inside = F.coalesce(F.col("exact") <= radius + slack, F.lit(False))
        open_ = known.groupBy("region").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.min(F.when(~inside, F.col("d"))).alias("edge")).where("r1 != r2 and edge is not null").select("region", "edge")
        # Outside the ball, and those of the ball that the boundary window's members may reach.
        reached = (F.col("edge") <= 2 * radius + slack) & (F.col("d") >= F.col("edge") - radius - slack)
        cells, at_cells = materialize(known.join(open_, "region").where(~inside | reached).select(F.col("p").alias("cell"), "p", "cls", "n").distinct(), "jaccard-cells")
        discard(self.spark, at_known)
        release(self.spark)
        roots = self._divided(cells, roots)
        discard(self.spark, at_cells)
        return roots

    def _salted(self, rows: DataFrame, few: DataFrame, key: str) -> DataFrame:
        """``rows`` joined with the one row of its key in ``few``; the rows of a key are dealt over ``SALTS`` tasks."""
        few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.withColumn("__salt", F.pmod(F.xxhash64("cls"), F.lit(SALTS)).cast("int")).join(few, [key, "__salt"]).drop("__salt")

    def _divided(self, cells: DataFrame, roots: DataFrame) -> DataFrame:
        """The roots, once the members (cell, p, cls, n) of each cell p are joined, large cells by Voronoi regions; ``cell`` is what p is a region of."""
        whole = None
        for turn in range(ROUNDS + 1):
            rooted = cells.join(roots.withColumnRenamed("a", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
            sizes = rooted.groupBy("cell", "p").agg(F.count("*").alias("members"), F.sum("n").alias("shingles"), F.min("root").alias("r1"), F.max("root").alias("r2"))
            sizes, at_sizes = materialize(sizes.where("r1 != r2").drop("r1", "r2"), "jaccard-sizes")
            joined, at_whole = [], []
            if whole is not None:
                # Cells whose open regions hold many members several times are joined whole.
                many = sizes.groupBy("cell").agg(F.sum("members").alias("held")).join(whole.select("p", "members", "shingles").distinct().withColumnRenamed("p", "cell"), "cell").where(F.col("held") > REPEATS * F.col("members"))
                many, path = materialize(many, "jaccard-whole")
                at_whole.append(path)
                again = many.select(F.col("cell").alias("p"), F.lit(1).alias("again"))
                joined.append(self._blocks(self._salted(whole, again, "p"), roots))
                sizes = sizes.join(many.select("cell"), "cell", "left_anti")
            small = (F.col("members") <= MEMBERS) & (F.col("shingles") <= SHINGLES)
            joined.append(rooted.join(sizes.where(small).select("p"), "p").select("p", "cls", "n", "root"))
            left = self._salted(cells.select("p", "cls", "n"), sizes.where(~small).drop("cell"), "p")
            if turn == ROUNDS:
                joined.append(self._blocks(left, roots))
            roots = self._within(functools.reduce(DataFrame.unionByName, joined), roots)
            left, at_left = materialize(left, "jaccard-left")
            discard(self.spark, at_sizes, *at_whole)
            if turn == ROUNDS or left.isEmpty():
                return roots
            whole = left
            cells, links = self._homes(left, turn)
            roots = connected(links.unionByName(roots.select("a", F.col("root").alias("b"))))
            release(self.spark)
        return roots

    def _homes(self, left: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """Members (cell, p, cls, n) of the Voronoi regions of cells (p, cls, n, members, shingles), and links to pivots."""
        percent, radius, slack = self.percent, 1 - self.percent / 100, 1e-9
        deals = F.ceil(F.col("shingles") / SHINGLES).cast("int")
        dealt = left.select("p", "cls", "n", "members", deals.alias("deals"), F.pmod(F.xxhash64("cls", F.lit(1)), deals).cast("int").alias("deal"), F.pmod(F.xxhash64("p", "cls", F.lit(turn)), F.lit(1 << 30)).alias("h"))
        dealt, at_dealt = materialize(dealt, "jaccard-dealt")
        first = dealt.groupBy("p").agg(F.min(F.struct("h", "cls")).alias("x"), F.first("deals").alias("deals")).select("p", F.col("x.cls").alias("cls"), "deals")
        some = dealt.where(F.col("h") * F.col("members") < PIVOTS * (1 << 30)).select("p", "cls", "deals").unionByName(first).distinct()
        sets, at_sets = self._sets(dealt)
        pivots = some.join(sets, "cls").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).select("p", "deal", "cls", "hashes").toDF("of", "dealt", "cls", "hashes")
        members = dealt.select("p", "deal", "cls", "n").join(sets, "cls").select("p", "deal", "cls", "n", "hashes").toDF("p", "deal", "cls", "n", "hashes")

        def assign(own: pa.Table, of: pa.Table) -> pa.Table:
            cls, n, q = own["cls"].to_numpy(), own["n"].to_numpy(), of["cls"].to_numpy()
            joined = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in own["hashes"]] or [np.zeros(0, U64)])
            if not len(cls):
                return pa.table({c: pa.array([], k) for c, k in (("p", pa.int64()), ("q", pa.int64()), ("rest", pa.bool_()), ("cls", pa.int64()), ("n", pa.int64()), ("link", pa.bool_()))})
            first = np.concatenate([[0], np.cumsum(n)[:-1]])
            d, link = np.ones((len(q), len(cls))), np.zeros((len(q), len(cls)), bool)
            for k, x in enumerate(of["hashes"]):
                y = np.frombuffer(x.as_buffer(), "<u8")
                same = np.add.reduceat((y[np.minimum(np.searchsorted(y, joined), len(y) - 1)] == joined).astype(np.int64), first)
                whole = n + len(y) - same
                d[k], link[k] = 1 - same / whole, same * 100 >= whole * percent
            low = d.min(axis=0)
            inside = (d <= low + 2 * radius + slack) & (d < 1)
            k, i = np.nonzero(inside)
            far = np.flatnonzero(low >= 1 - radius - slack)
            p = np.full(len(k) + len(far), own["p"][0].as_py())
            nothing = np.zeros(len(far), bool)
            return pa.table({"p": p, "q": np.concatenate([q[k], cls[far]]), "rest": np.concatenate([np.zeros(len(k), bool), ~nothing]), "cls": np.concatenate([cls[i], cls[far]]), "n": np.concatenate([n[i], n[far]]), "link": np.concatenate([link[k, i], nothing])})

        found = members.groupBy("p", "deal").cogroup(pivots.groupBy("of", "dealt")).applyInArrow(assign, "p long, q long, rest boolean, cls long, n long, link boolean")
        found, _ = materialize(found, "jaccard-homes")
        discard(self.spark, at_dealt, at_sets)
        region = F.when(F.col("rest"), F.xxhash64("p", F.lit("rest"))).otherwise(F.xxhash64("p", "q"))
        homes = found.select(F.col("p").alias("cell"), region.alias("p"), "cls", "n")
        return homes, found.where("link and cls != q").select(F.col("cls").alias("a"), F.col("q").alias("b"))

    def _within(self, cells: DataFrame, roots: DataFrame) -> DataFrame:
        """The roots, once the members of each cell p are joined."""
        some = cells.join(self.classes.select("cls", "sign"), "cls").groupBy("p").applyInArrow(_cell(self.percent), "p long, cls long, n long, root long")
        some, at_some = materialize(some, "jaccard-cells")
        if some.isEmpty():
            discard(self.spark, at_some)
            return roots
        sets, path = self._sets(some)
        found = some.join(sets, "cls").groupBy("p").applyInArrow(_cell_links(self.percent), "a long, b long")
        found, _ = materialize(found, "jaccard-links")
        discard(self.spark, path, at_some)
        return connected(found.unionByName(roots.select("a", F.col("root").alias("b"))))

    def _blocks(self, parts: DataFrame, roots: DataFrame) -> DataFrame:
        """Cells of a size for one task: each two blocks of a cell (p, cls, n, members, shingles) are one."""
        blocks = F.ceil(F.greatest(F.col("members") / MEMBERS, F.col("shingles") / SHINGLES) * 2).cast("int")
        own = F.pmod(F.xxhash64("cls", F.lit(2)), blocks).cast("int")
        dealt = parts.select("p", "cls", "n", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
        dealt = dealt.join(roots.withColumnRenamed("a", "cls"), "cls", "left")
        return dealt.select(F.xxhash64("p", F.least("own", "other"), F.greatest("own", "other")).alias("p"), "cls", "n", F.coalesce("root", "cls").alias("root"))


def _rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows cls, root and the least doc_id of each class with words."""
    classes = members.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    return classes.join(roots.withColumnRenamed("a", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))


def components(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows doc_id, n_shingles, component_id for each document."""
    members, roots = Join(docs, percent, doc_id, text).run()
    rooted = _rooted(members, roots)
    low = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(low, "root").select("cls", "component_id")
    # Nothing links documents without words; each is alone.
    key = F.when(F.col("n") > 0, F.col("cls"))
    out = members.withColumn("cls", key).join(of_class, "cls", "left")
    no_id = lambda c: F.when(c != NO_ID, c)
    return out.select(no_id(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), no_id(F.coalesce("component_id", "doc_id")).alias("component_id"))


def kept_one(docs: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without all but one row of each component: one of the smallest doc_id. Rows without words are linked with none, and stay."""
    members, roots = Join(docs, percent, doc_id, text).run()
    one = _rooted(members, roots).groupBy("root").agg(F.min(F.struct("least", "cls")).alias("one")).select(F.col("one.least").alias("__id"), F.col("one.cls").alias("__cls"))
    rows_of = members.groupBy(F.col("doc_id").alias("__id"), F.col("cls").alias("__cls")).agg((F.count("*") > 1).alias("__many"))
    keep, _ = materialize(one.join(rows_of, ["__id", "__cls"]), "jaccard-kept")
    keep_batches_small(docs.sparkSession)
    place = docs.columns.index(text)
    key = F.coalesce(F.col(f"row.`{doc_id}`").cast("long"), F.lit(NO_ID))
    body = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = body.schema["row"].dataType.simpleString()

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            for s in text_slices(row.field(place)):
                x = Sets(s)
                yield pa.RecordBatch.from_arrays([row.slice(s.lo, s.n_docs), pa.array(x.n), pa.array(x.cls)], names=["row", "n", "cls"])

    classed = lambda rows: rows.mapInArrow(freed(classes), f"row {kind}, n long, cls long").withColumn("id", key)
    mine = (F.col("id") == F.col("__id")) & (F.col("cls") == F.col("__cls"))
    out = classed(body).join(keep.where("not __many"), mine, "left").where("n = 0 or __id is not null").select("row.*")
    many = keep.where("__many")
    if many.isEmpty():
        return out
    # Rows of one doc_id and class: the first by text stays.
    again = classed(body.join(many.select("__id").distinct(), key == F.col("__id"), "left_semi")).join(many, mine).where("n > 0")
    again = again.withColumn("k", F.row_number().over(Window.partitionBy("id", "cls").orderBy(f"row.`{text}`"))).where("k = 1")
    return out.unionByName(again.select("row.*"))
