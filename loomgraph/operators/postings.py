"""A lexical index that is kept: postings in blocks, searched by upper bounds, updated by difference.

Documents are numbered where they are read, 2^``SEGMENT_BITS`` numbers in a row are
a segment, in order of doc_id, and the postings of a term in a segment are a block: document numbers as gaps, term
frequencies, document lengths, and the highest score that the block gives
before the term's weight.  A search

1. reads of the blocks of the queries' terms only the head (term, segment,
   number of postings, bound);
2. adds the bounds by (query, segment): no document of the segment scores more;
3. scores the ``FIRST`` best segments of each query whole; the k-th score there
   is a score that a result must reach;
4. scores the other segments whose bound reaches it.

So results equal those of a scan.  Bounds were made with the average length of
their time; if that has grown, scores have by at most the same factor.

An update numbers new and changed documents anew, writes the segments that lost
one, and leaves all other buckets of the kept tables alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, texts
from ..sources.tables import discarded, written
from ..sources.versions import BUCKET, Versions, bucket_of
from .retrieval import B, EPSILON, K1, Weights, numbered, rounded, stated

#: log2 of the documents of a segment.
SEGMENT_BITS = 7
#: Segments of each query that are scored first.
FIRST = 8
#: Numbers of segments that are sent to all tasks, so that only blocks of these are shuffled; for more, all blocks of the queries' terms are.
SEGMENTS_SENT = 1 << 20
#: Buckets of the kept tables.
BUCKETS = 64
#: ``monotonically_increasing_id`` counts inside a partition in so many bits.
INNER_BITS = 33


def _part(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))


BLOCK = "term string, segment long, n int, best double, avgdl double, gaps array<int>, tfs array<int>, dls array<int>"


def _table(terms: pa.Array, segments: np.ndarray, n: np.ndarray, at: np.ndarray, tf: np.ndarray, dl: np.ndarray, avgdl: float) -> pa.RecordBatch:
    """Blocks of n postings each, in order of their places; none is empty."""
    ends = np.cumsum(n)
    starts = ends - n
    gaps = np.diff(at, prepend=0)
    gaps[starts] = at[starts]
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (gaps, tf, dl)]
    best = np.maximum.reduceat(_part(tf, dl, avgdl), starts) if len(n) else np.zeros(0)
    return pa.RecordBatch.from_arrays([terms, pa.array(segments), pa.array(n.astype(np.int32)), pa.array(best), pa.array(np.full(len(n), avgdl)), *lists], names=["term", "segment", "n", "best", "avgdl", "gaps", "tfs", "dls"])


def _postings(lists: pa.ListArray, at: np.ndarray, wide: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment's documents, their tokens and places: terms, postings of each, place and tf of each posting; dl by place."""
    flat = lists.flatten().dictionary_encode()
    dl = np.zeros(wide, np.int64)
    dl[at] = lists.value_lengths().to_numpy()
    key, tf = np.unique(flat.indices.to_numpy().astype(np.int64) * wide + np.repeat(at, dl[at]), return_counts=True)
    term, place = key // wide, key % wide
    return flat.dictionary, np.bincount(term, minlength=len(flat.dictionary)), place, tf, dl


def _encoded(numbered: DataFrame, avgdl: float) -> DataFrame:
    """Blocks of documents that have their numbers (ord, t): a segment is a group of 2^SEGMENT_BITS documents at most."""
    wide = 1 << SEGMENT_BITS

    def run(group: pa.Table) -> pa.Table:
        terms, n, place, tf, dl = _postings(group["t"].combine_chunks(), group["at"].to_numpy(), wide)
        return pa.Table.from_batches([_table(terms, np.full(len(n), group["segment"][0].as_py()), n, place, tf, dl[place], avgdl)])

    segment = F.shiftright("ord", SEGMENT_BITS)
    rows = numbered.select(segment.alias("segment"), (F.col("ord") - F.shiftleft(segment, SEGMENT_BITS)).cast("long").alias("at"), "t")
    return rows.groupBy("segment").applyInArrow(run, BLOCK)


#: A segment in a row: what its documents' table needs, by place, then its terms, postings of each, and place and tf of each posting.
PACKED = "segment long, doc_ids array<{}>, hashes array<string>, dls array<int>, terms array<string>, n array<smallint>, places array<smallint>, tfs array<int>"
#: Segments in a file of such rows: Spark decodes thousands of rows of a file at once.
PACKED_ROWS = 32
#: Segments whose blocks a task sorts and writes, more or less: a bucket of more is dealt to several.
SORTED_SEGMENTS = 64


def _packed(docs: DataFrame, base: int) -> DataFrame:
    """Rows of PACKED of documents (doc_id, text), written once; numbers begin at partition ``base``.

    Documents are numbered where they are read, and in order of doc_id inside a
    segment only; so neither texts nor tokens are sorted, shuffled or written.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ord_ = F.monotonically_increasing_id() + F.lit(base << INNER_BITS)
    tokens = docs.select("doc_id", ids.content_hash(text).alias("hash"), ord_.alias("ord"), texts.lexical_tokens(text).alias("t"))
    bits = SEGMENT_BITS

    def packed(part: pa.Table) -> pa.RecordBatch:
        part = part.take(pc.sort_indices(part["doc_id"], null_placement="at_start")).combine_chunks()
        of = {c: part[c].combine_chunks() for c in ("doc_id", "hash", "t")}
        terms, n, place, tf, dl = _postings(of["t"], np.arange(len(part)), 1 << bits)
        whole = lambda x, kind=None: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if kind is None else pa.array(x, kind))
        segment = pa.array([part["ord"][0].as_py() >> bits], pa.int64())
        lists = [whole(of["doc_id"]), whole(of["hash"]), whole(dl[: len(part)], pa.int32()), whole(terms), whole(n, pa.int16()), whole(place, pa.int16()), whole(tf, pa.int32())]
        return pa.RecordBatch.from_arrays([segment, *lists], names=["segment", "doc_ids", "hashes", "dls", "terms", "n", "places", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if left is None else pa.concat_tables([left, rows])
            starts = np.flatnonzero(np.diff(rows["ord"].to_numpy() >> bits, prepend=-1))
            for start, end in zip(starts, starts[1:], strict=False):
                yield packed(rows.slice(start, end - start))
            # The next batch may go on with the last segment.
            left = rows.slice(starts[-1]) if len(starts) else None
        if left is not None:
            yield packed(left)

    rows = tokens.mapInArrow(run, PACKED.format(tokens.schema["doc_id"].dataType.simpleString()))
    return written(rows, "packed", maxRecordsPerFile=PACKED_ROWS, compression="zstd")


def _documents(packed: DataFrame) -> DataFrame:
    """Rows doc_id, hash, ord, dl."""
    one = packed.select("segment", F.posexplode(F.arrays_zip("doc_ids", "hashes", "dls")).alias("at", "d"))
    ord_ = F.shiftleft("segment", SEGMENT_BITS) + F.col("at")
    return one.select(F.col("d.doc_ids").alias("doc_id"), F.col("d.hashes").alias("hash"), ord_.alias("ord"), F.col("d.dls").alias("dl"))


def _counts(packed: DataFrame) -> DataFrame:
    """Rows term, n: documents of a segment with the term."""
    return packed.select(F.explode(F.arrays_zip("terms", "n")).alias("x")).select(F.col("x.terms").alias("term"), "x.n")


def _dealt(packed: DataFrame, avgdl: float) -> DataFrame:
    """Blocks of packed segments, with their bucket; a task has segments of one bucket, or few whole buckets.

    Segments are dealt while they are packed, their terms as lines of one
    string (a token holds no white space).
    """
    n_segments = packed.count()
    parts = -(-n_segments // (BUCKETS * SORTED_SEGMENTS)) or 1
    flat = lambda batch, name: batch.column(name).flatten()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (batch.slice(i, 1) for i in range(len(batch))):
                n, at, tf, dl = (flat(row, c).to_numpy().astype(np.int64) for c in ("n", "places", "tfs", "dls"))
                terms = pc.split_pattern(row.column("terms"), "\n").flatten()
                made = _table(terms, np.full(len(n), row.column("segment")[0].as_py()), n, at, tf, dl[at], avgdl)
                yield made.append_column(BUCKET, pa.array(np.full(len(n), row.column(BUCKET)[0].as_py(), np.int32)))

    bucket, part = bucket_of(BUCKETS, "segment"), F.pmod(F.hash("segment"), F.lit(parts))
    rows = packed.where(F.size("terms") > 0).select(bucket.alias(BUCKET), (bucket + part * BUCKETS).alias("to"), "segment", "dls", F.array_join("terms", "\n").alias("terms"), "n", "places", "tfs")
    return rows.repartitionById(min(BUCKETS * parts, n_segments or 1), "to").drop("to").mapInArrow(run, f"{BLOCK}, {BUCKET} int")


def _places(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of blocks: the block, place and tf of each posting."""
    gaps, tfs = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (batch.column(c) for c in ("gaps", "tfs")))
    n, gap = gaps.value_lengths().to_numpy(), gaps.flatten().to_numpy().astype(np.int64)
    total = np.cumsum(gap)
    starts = np.cumsum(n) - n
    before = total[starts] - gap[starts] if len(n) else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(n)), n), total - np.repeat(before, n), tfs.flatten().to_numpy().astype(np.int64)


def _without(blocks: DataFrame, avgdl: float) -> DataFrame:
    """Blocks without the places of their column ``lost``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (block, at, tf), dl = _places(batch), batch.column("dls").flatten().to_numpy().astype(np.int64)
            lost = batch.column("lost")
            gone = np.zeros((len(lost), 1 << SEGMENT_BITS), bool)
            gone[np.repeat(np.arange(len(lost)), lost.value_lengths().to_numpy()), lost.flatten().to_numpy()] = True
            left = ~gone[block, at]
            n = np.bincount(block[left], minlength=len(lost))
            some = pa.array(n > 0)
            yield _table(batch.column("term").filter(some), batch.column("segment").filter(some).to_numpy(), n[n > 0], at[left], tf[left], dl[left], avgdl)

    return blocks.select("term", "segment", "gaps", "tfs", "dls", "lost").mapInArrow(run, BLOCK)


class Postings:
    """An index in a folder: tables ``docs``, ``blocks`` and ``totals`` of one version."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.kept = Versions(spark, folder)
        self.manifest = self.kept.manifest(version)
        if "blocks" not in self.manifest["tables"]:
            raise FileNotFoundError(f"no index in {folder}")

    def table(self, name: str) -> DataFrame:
        return self.kept.read(name, manifest=self.manifest)

    # --- writing -------------------------------------------------------------------

    @classmethod
    def build(cls, folder: str, docs: DataFrame) -> Postings:
        """Of documents (doc_id, text); a text that is null is empty."""
        spark = docs.sparkSession
        packed = _packed(docs, 0)
        rows = _documents(packed)
        avgdl = rows.agg(F.avg("dl")).first()[0] or 1.0
        cls._commit(Versions(spark, folder), None, (rows, None), (_dealt(packed, avgdl), None), _counts(packed), rows)
        discarded(packed)
        return cls(spark, folder)

    @staticmethod
    def _commit(kept: Versions, base: dict | None, docs: tuple, blocks: tuple, every: DataFrame, rows: DataFrame) -> None:
        """Blocks are dealt by bucket; ``every`` and ``rows`` are all terms of blocks and all documents then; totals come from these."""
        n = rows.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
        df = every.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(n))
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        totals = n.crossJoin(df.agg(F.avg(raw).alias("mean_raw"))).withColumn(BUCKET, F.lit(0))
        kept.commit(
            {
                "docs": (docs[0].withColumn(BUCKET, bucket_of(BUCKETS, "doc_id")), docs[1], BUCKETS, ["doc_id"]),
                "blocks": (*blocks, BUCKETS, ["term", "segment"]),
                "totals": (totals, None, 1, []),
            },
            base,
            dealt=("blocks",),
        )

    def updated(self, docs: DataFrame) -> Postings:
        """The index of ``docs``; only buckets with changed documents, or with segments that lost one, are written."""
        spark, old = docs.sparkSession, self.table("docs")
        new = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
        both = old.select("doc_id", "ord", F.col("hash").alias("was")).join(new.select("doc_id", ids.content_hash(F.col("text")).alias("is")), "doc_id", "full")
        moved = written(both.where(~F.col("was").eqNullSafe(F.col("is"))).select("doc_id", "ord", F.col("is").isNotNull().alias("here")), "moved")
        if moved.isEmpty():
            return self
        base = (old.agg(F.max("ord")).first()[0] or 0) >> INNER_BITS
        fresh = _packed(new.join(moved.where("here").select("doc_id"), "doc_id", "left_semi"), base + 1)
        rows = written(old.join(moved.select("doc_id"), "doc_id", "left_anti").unionByName(_documents(fresh)), "docs")
        avgdl = rows.agg(F.avg("dl")).first()[0] or 1.0
        at = F.col("ord") - F.shiftleft(F.shiftright("ord", SEGMENT_BITS), SEGMENT_BITS)
        lost = moved.where("ord is not null").groupBy(F.shiftright("ord", SEGMENT_BITS).alias("segment")).agg(F.collect_list(at.cast("int")).alias("lost"))
        lost = written(lost, "lost")
        hurt = lost.select("segment")
        blocks = self.table("blocks")
        cut = written(_without(blocks.join(lost, "segment"), avgdl), "blocks")
        whole = blocks.join(hurt, "segment", "left_anti")
        some = lambda df, key: sorted(r[0] for r in df.select(bucket_of(BUCKETS, key)).distinct().collect())
        at_blocks, at_docs = some(hurt.unionByName(fresh.select("segment")), "segment"), some(moved, "doc_id")
        left = whole.where(bucket_of(BUCKETS, "segment").isin(at_blocks)).unionByName(cut).withColumn(BUCKET, bucket_of(BUCKETS, "segment"))
        # New documents have segments of their own.
        rewritten = left.repartition(BUCKET).unionByName(_dealt(fresh, avgdl))
        every = whole.select("term", "n").unionByName(cut.select("term", "n")).unionByName(_counts(fresh))
        self._commit(self.kept, self.manifest, (rows.where(bucket_of(BUCKETS, "doc_id").isin(at_docs)), at_docs), (rewritten, at_blocks), every, rows)
        for x in (fresh, rows, cut):
            discarded(x)
        return Postings(spark, self.kept.folder)

    # --- searching -----------------------------------------------------------------

    def _scored(self, wanted: DataFrame, given: Weights, terms: DataFrame, avgdl: float, k: int, digits: int) -> DataFrame:
        """Rows q, ord, score over 0 and from ``bar`` on: the k best of each query in each of its segments (q, segment, bar).

        A segment's documents have their numbers in order of doc_id; so of those
        that tie in it, the first are the first by doc_id.
        """
        blocks = self.table("blocks").select("term", "segment", "gaps", "tfs").join(F.broadcast(terms), "term", "left_semi")
        # A segment's lengths come once, by place, in a row without a term, instead of one with each posting.
        segment = F.shiftright("ord", SEGMENT_BITS)
        place = (F.col("ord") - F.shiftleft(segment, SEGMENT_BITS)).cast("int")
        lengths = self.table("docs").select(segment.alias("segment"), F.struct(place.alias("at"), "dl").alias("d"))
        segments = wanted.select("segment").distinct()
        segments = F.broadcast(segments) if segments.count() <= SEGMENTS_SENT else segments
        in_wanted = lambda df: df.join(segments, "segment", "left_semi")
        lengths = in_wanted(lengths).groupBy("segment").agg(F.collect_list("d").alias("d"))
        lengths = lengths.select(F.lit(None).cast("string").alias("term"), "segment", F.col("d.at").alias("gaps"), F.col("d.dl").alias("tfs"))
        both = in_wanted(blocks).select("term", "segment", "gaps", "tfs").unionByName(lengths)
        n, words = given.n, given.words

        def run(block: pa.Table, asked: pa.Table) -> pa.Table:
            of_all = block.filter(pc.is_null(block["term"]))
            dls = np.zeros(1 << SEGMENT_BITS, np.int64)
            dls[of_all["gaps"].combine_chunks().flatten().to_numpy()] = of_all["tfs"].combine_chunks().flatten().to_numpy()
            block = block.filter(pc.is_valid(block["term"]))
            of, at, tf = _places(block)
            term = pc.index_in(block["term"].combine_chunks(), value_set=pa.array(words, pa.string())).fill_null(-1).to_numpy().astype(np.int64)[of]
            at, tf, term = (x[term >= 0] for x in (at, tf, term))
            cell, value = given.cells(at, term, _part(tf, dls[at], avgdl))
            score = rounded(np.bincount(cell, value, n << SEGMENT_BITS), digits).reshape(-1, n)
            bar = np.full(n, np.inf)
            bar[asked["q"].to_numpy()] = asked["bar"].to_numpy()
            place, q = np.nonzero((score > 0) & (score >= bar))
            order = np.lexsort((place, -score[place, q], q))
            place, q = place[order], q[order]
            first = np.arange(len(q)) - np.searchsorted(q, q) < k
            place, q = place[first], q[first]
            start = (block["segment"][0].as_py() << SEGMENT_BITS) if len(block) else 0
            return pa.table({"q": q.astype(np.int32), "ord": place + start, "score": score[place, q]})

        return both.groupBy("segment").cogroup(wanted.select("q", "segment", "bar").groupBy("segment")).applyInArrow(run, "q int, ord long, score double")

    def search(self, queries: DataFrame, k: int = 10, digits: int = 9, first: int = FIRST, reads: list | None = None) -> DataFrame:
        """Rows query_id, doc_id, score, rank: the k best of each query (query_id, text), scores over 0, ties by doc_id.

        ``reads`` gets (blocks whose postings were read, blocks of the queries' terms, all blocks).
        """
        totals = self.table("totals").first()
        if not totals.n_docs:
            kinds = [x.dataType.simpleString() for x in (queries.schema["query_id"], self.table("docs").schema["doc_id"])]
            return queries.sparkSession.createDataFrame([], "query_id {}, doc_id {}, score double, rank int".format(*kinds))
        asked = stated(queries).select("query_id", F.explode(texts.lexical_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
        asked = written(asked, "asked")
        heads = self.table("blocks").select("term", "segment", "n", "best", "avgdl").join(F.broadcast(asked.select("term").distinct()), "term", "left_semi")
        heads = written(heads, "heads")
        df = heads.groupBy("term").agg(F.sum("n").alias("df"))
        raw = F.log(totals.n_docs - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        idf = F.when(raw < 0, F.lit((totals.mean_raw or 0.0) * EPSILON)).otherwise(raw)
        weighted = written(asked.join(df, "term").select("query_id", "term", (F.col("qf") * idf).alias("weight")), "weights")
        grown = F.greatest(F.lit(1.0), F.lit(float(totals.avgdl or 1.0)) / F.col("avgdl"))
        most = F.sum(F.greatest(F.col("weight"), F.lit(0.0)) * F.col("best") * grown)
        bounds = heads.join(F.broadcast(weighted), "term").groupBy("query_id", "segment").agg(most.alias("most")).where("most > 0")
        turn = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("most"), "segment"))
        bounds = written(bounds.withColumn("turn", turn), "bounds")
        avgdl, slack = float(totals.avgdl or 1.0), 10.0**-digits
        named = numbered(asked)
        given = Weights(weighted.join(F.broadcast(named), "query_id").select("term", "q", F.col("weight").alias("w")), named.count())
        terms = asked.select("term").distinct()
        scored = lambda wanted: self._scored(wanted.join(F.broadcast(named), "query_id"), given, terms, avgdl, k, digits).join(F.broadcast(named), "q").select("query_id", "ord", "score")
        one = written(scored(bounds.where(F.col("turn") <= first).select("query_id", "segment", F.lit(0.0).alias("bar"))), "scored")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"))
        bar = one.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", F.col("score").alias("bar"))
        rest = bounds.where(F.col("turn") > first).join(F.broadcast(bar), "query_id", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
        rest = written(rest.where(F.col("most") + slack >= F.col("bar")).select("query_id", "segment", "bar"), "rest")
        if reads is not None:
            seen = bounds.where(F.col("turn") <= first).select("query_id", "segment").unionByName(rest.drop("bar")).join(weighted, "query_id")
            n = heads.join(seen.select("term", "segment").distinct(), ["term", "segment"], "left_semi").count()
            reads += [n, heads.count(), self.table("blocks").count()]
        both = one.unionByName(scored(rest))
        # All that tie with the k-th get their names; then ties are by name.
        near = both.withColumn("n", F.rank().over(order)).where(F.col("n") <= k).drop("n")
        found = near.join(self.table("docs").select("ord", "doc_id"), "ord")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "rank")
