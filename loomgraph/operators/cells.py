"""A vector store that is kept: cells around centres, dropped by the triangle inequality.

Vectors are normalised and belong to the nearest of up to ``MOST_CENTRES``
centres; a cell knows how near and how far its vectors are from its centre.  A
vector at distance r from a centre c is at least |d(q, c) - r| from a query q,
so its cosine is at most 1 - that^2 / 2.  A search scores the nearest cells with
k vectors, and then every cell whose bound reaches the k-th score: results equal
those of a scan, and a cell that can't reach it isn't read.

Centres are the vectors of the smallest hashes of their ids: a sample of a
bounded size that every vector may be in.  An upsert or delete writes only
buckets with cells that it touches; centres stay as they were built.  Null
vectors are not kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import written
from ..sources.versions import BUCKET, Versions, bucket_of
from .retrieval import SLICE_CELLS, Best, asked_vectors, dot, l2_normalized, numbered, rounded, stated, vector_blocks

#: Centres are broadcast; at most so many.
MOST_CENTRES = 1024
BUCKETS = 64
SLACK = 1e-7


def _assigned(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Adds the nearest centre and its distance to rows vec_id, v (normalised)."""
    rows = centres.orderBy("cell").limit(MOST_CENTRES).collect()
    names = np.array([r.cell for r in rows], np.int32)
    c = np.array([r.c for r in rows], np.float64)
    square = (c * c).sum(axis=1)
    key = vectors.schema["vec_id"].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            v = np.array(frame["v"].tolist(), np.float64).reshape(len(frame), c.shape[1])
            d = np.sqrt(np.maximum((v * v).sum(axis=1)[:, None] + square[None, :] - 2 * v @ c.T, 0))
            near = d.argmin(axis=1)
            yield frame.assign(cell=names[near], r=d[np.arange(len(near)), near])

    return vectors.select("vec_id", "v").mapInPandas(run, f"vec_id {key}, v array<double>, cell int, r double")


class Cells:
    """A store in a folder: tables ``vectors`` and ``centres`` of one version."""

    def __init__(self, spark: SparkSession, folder: str, version: int | None = None):
        self.kept = Versions(spark, folder)
        self.manifest = self.kept.manifest(version)
        if "centres" not in self.manifest["tables"]:
            raise FileNotFoundError(f"no vectors in {folder}")

    def table(self, name: str) -> DataFrame:
        return self.kept.read(name, manifest=self.manifest)

    @staticmethod
    def _unit(vectors: DataFrame) -> DataFrame:
        return vectors.where("v is not null").select("vec_id", l2_normalized(F.col("v")).alias("v"))

    @staticmethod
    def _commit(kept: Versions, base: dict | None, rows: DataFrame, replaced: list[int] | None, every: DataFrame, centres: DataFrame) -> None:
        size = every.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        known = centres.select("cell", "c").join(size, "cell", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(BUCKET, F.lit(0))
        kept.commit({"vectors": (rows.withColumn(BUCKET, bucket_of(BUCKETS, "cell")), replaced, BUCKETS, ["cell"]), "centres": (known, None, 1, ["cell"])}, base)

    @classmethod
    def build(cls, folder: str, vectors: DataFrame, centres: int | None = None) -> Cells:
        """Of rows vec_id, v; about the square root of their number are centres, unless ``centres`` says how many."""
        spark, unit = vectors.sparkSession, cls._unit(vectors)
        n = min(centres or math.isqrt(max(unit.count(), 1)) + 1, MOST_CENTRES)
        some = unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(n).select(F.col("v").alias("c"))
        cell = F.row_number().over(Window.orderBy(F.xxhash64("c"))) - 1  # n rows at most
        chosen = written(some.dropDuplicates(["c"]).select(cell.alias("cell"), "c"), "centres")
        if chosen.isEmpty():
            chosen = spark.createDataFrame([], "cell int, c array<double>")
            rows = spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, v array<double>, cell int, r double")
        else:
            rows = written(_assigned(unit, chosen), "vectors")
        cls._commit(Versions(spark, folder), None, rows, None, rows, chosen)
        return cls(spark, folder)

    def upserted(self, vectors: DataFrame, deleted: DataFrame | None = None) -> Cells:
        """With vectors (vec_id, v) added or replaced, and vec_ids of ``deleted`` gone; a null vector is a deletion."""
        spark, old, centres = vectors.sparkSession, self.table("vectors"), self.table("centres")
        if centres.isEmpty():
            return Cells.build(self.kept.folder, vectors)
        fresh = written(_assigned(self._unit(vectors), centres), "vectors")
        gone = vectors.select("vec_id")
        if deleted is not None:
            gone = gone.unionByName(deleted.select("vec_id"))
        lost = written(old.join(gone, "vec_id", "left_semi").select("cell").distinct(), "lost")
        at = sorted(r[0] for r in lost.unionByName(fresh.select("cell")).select(bucket_of(BUCKETS, "cell")).distinct().collect())
        if not at:
            return self
        every = old.join(gone, "vec_id", "left_anti").unionByName(fresh)
        self._commit(self.kept, self.manifest, every.where(bucket_of(BUCKETS, "cell").isin(at)), at, every, centres)
        return Cells(spark, self.kept.folder)

    def _scored(self, wanted: DataFrame, named: DataFrame, asked: np.ndarray, k: int, digits: int) -> DataFrame:
        """Rows query_id, vec_id, score: each task's k best of each query in cells (query_id, cell); only buckets with such cells are read."""
        wanted = written(wanted.join(F.broadcast(named), "query_id"), "wanted")
        at = [r[0] for r in wanted.select(bucket_of(BUCKETS, "cell")).distinct().collect()]
        rows = self.kept.read("vectors", manifest=self.manifest, buckets=at).select("vec_id", "v", "cell")
        # One row a cell, so MOST_CENTRES at most, of the query set's numbers.
        by_cell, n = wanted.groupBy("cell").agg(F.collect_list("q").alias("qs")).collect(), named.count()
        names = np.array(sorted(r.cell for r in by_cell), np.int64)
        met = np.zeros((len(names) + 1, n), bool)
        for r in by_cell:
            met[np.searchsorted(names, r.cell), r.qs] = True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(n, k)
            for batch in batches:
                cell = batch.column(2).to_numpy().astype(np.int64)
                own = np.searchsorted(names, cell)
                own[(own == len(names)) | (np.append(names, -1)[own] != cell)] = len(names)
                for start in range(0, len(batch), max(1, SLICE_CELLS // n)):
                    part = batch.slice(start, max(1, SLICE_CELLS // n))
                    may = met[own[start : start + len(part)]]
                    some = np.flatnonzero(may.any(axis=0))
                    score = rounded(vector_blocks(part.column(1), len(asked)) @ asked[:, some], digits)
                    row, q = np.nonzero(may[:, some] & (score >= best.bar[some]))
                    best.add(part.column(0), row, some[q], score[row, q])
            yield from (pa.RecordBatch.from_arrays([b.column("q"), b.column("id"), b.column("score")], names=["q", "id", "score"]) for b in best.batches())

        found = rows.mapInArrow(run, f"q int, id {rows.schema['vec_id'].dataType.simpleString()}, score double")
        return found.join(F.broadcast(named), "q").select("query_id", F.col("id").alias("vec_id"), "score")

    def search(self, queries: DataFrame, k: int = 10, digits: int = 9, reads: list | None = None) -> DataFrame:
        """Rows query_id, vec_id, score, rank: the k of the highest cosine for each query (query_id, query), ties by vec_id.

        ``reads`` gets (cells read, summed over queries; cells times queries).
        """
        asked = written(stated(queries).where("query is not null").select("query_id", l2_normalized(F.col("query")).alias("q")), "asked")
        named = numbered(asked)
        vectors = asked_vectors(asked, named)
        d = F.sqrt(F.greatest(dot(F.col("q"), F.col("q")) + dot(F.col("c"), F.col("c")) - 2 * dot(F.col("q"), F.col("c")), F.lit(0.0)))
        cells = self.table("centres").where("n > 0").crossJoin(F.broadcast(asked)).withColumn("d", d)
        off = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.lit(0.0))
        by = Window.partitionBy("query_id").orderBy("d", "cell")
        before = F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1))
        met = written(cells.select("query_id", "cell", (1 - off * off / 2).alias("most"), F.coalesce(before, F.lit(0)).alias("before")), "cells")
        one = written(self._scored(met.where(F.col("before") < k).select("query_id", "cell"), named, vectors, k, digits), "scored")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        bar = one.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select("query_id", F.col("score").alias("bar"))
        rest = met.where(F.col("before") >= k).join(bar, "query_id", "left").where(F.col("most") + SLACK + 10.0**-digits >= F.coalesce("bar", F.lit(-2.0)))
        rest = written(rest.select("query_id", "cell"), "rest")
        if reads is not None:
            reads += [met.where(F.col("before") < k).count() + rest.count(), met.count()]
        both = one.unionByName(self._scored(rest, named, vectors, k, digits))
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
