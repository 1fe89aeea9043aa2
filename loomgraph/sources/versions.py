"""Versioned tables in one folder.

A table is cut into buckets, each a folder of Parquet files that is never
written again.  A version is a manifest: for each table its schema and the
folder of each bucket.  A commit writes the buckets that differ, then adds one
manifest by a rename; all tables of a commit change at once, and what reads an
older version goes on with its folders until :meth:`Versions.vacuum`.  Of two
commits from the same version the second one fails and leaves nothing that is
read.

:meth:`Versions.sync` finds the buckets that differ: rows are compared by key
and by the hash of their canonical JSON, so unchanged buckets aren't touched.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

BUCKET, HASH = "__bucket", "row_hash"
#: Buckets of a table unless it says otherwise; a bucket is the least that a commit writes.
BUCKETS = 64


class Conflict(RuntimeError):
    """Somebody else committed the next version first."""


def canonical_hash(columns: Iterable[str]) -> Column:
    """Of a row as JSON with its columns in order of name; nulls are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def bucket_of(n: int, *keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    # --- manifests ---------------------------------------------------------------

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def latest(self) -> int:
        """The newest version, 0 if there is none."""
        return max((int(n[2:-5]) for n in self._names(f"{self.folder}/versions") if n.startswith("v-") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        v = self.latest() if version is None else version
        if not v:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/v-{v:09d}.json", wholetext=True).first().value)

    def _swap(self, made: dict) -> int:
        """Adds a manifest; a rename that doesn't replace makes it visible all at once."""
        final = f"{self.folder}/versions/v-{made['version']:09d}.json"
        draft = f"{self.folder}/versions/.draft-{uuid.uuid4().hex}"
        out = self._fs.create(self._path(draft))
        out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            # Its own context: a default one would look at another file system.
            files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(files.makeQualified(self._path(draft)), files.makeQualified(self._path(final)), options)
        except Exception as problem:
            self._fs.delete(self._path(draft), False)
            if self._fs.exists(self._path(final)):
                raise Conflict(f"version {made['version']} is there already") from problem
            raise
        return made["version"]

    # --- tables --------------------------------------------------------------------

    def read(self, name: str, version: int | None = None, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame | None:
        """The table, or only some of its buckets; None if that version doesn't have it."""
        table = (manifest or self.manifest(version))["tables"].get(name)
        if table is None:
            return None
        schema = T.StructType.fromJson(table["schema"])
        some = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.folder}/{p}" for b, p in sorted(table["folders"].items()) if some is None or b in some]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _write(self, name: str, rows: DataFrame, sort: Iterable[str], dealt: bool) -> dict[str, str]:
        """Writes rows with their bucket; folders by bucket."""
        at = f"data/{name}-{uuid.uuid4().hex}"
        # Buckets come whole to a task, one after another; how many tasks there are is the session's choice.
        rows = rows if dealt else rows.repartition(BUCKET)
        rows.sortWithinPartitions(BUCKET, *sort).write.partitionBy(BUCKET).parquet(f"{self.folder}/{at}")
        found = [x for x in self._names(f"{self.folder}/{at}") if x.startswith(f"{BUCKET}=")]
        return {x.split("=")[1]: f"{at}/{x}" for x in found}

    def commit(self, changed: dict[str, tuple[DataFrame, Iterable[int] | None, int, Iterable[str]]], base: dict | None = None, dealt: Iterable[str] = ()) -> int:
        """A new version. changed: by table its rows with ``__bucket``, the buckets that these rows replace (None: all), the number of buckets, and what to sort by. dealt: tables whose tasks have whole buckets already."""
        before = base or self.manifest()
        made = {"version": before["version"] + 1, "tables": dict(before["tables"])}
        for name, (rows, replaced, n, sort) in changed.items():
            old = {} if replaced is None else before["tables"].get(name, {}).get("folders", {})
            gone = None if replaced is None else {str(b) for b in replaced}
            folders = {b: p for b, p in old.items() if b not in (gone or ())} | self._write(name, rows, sort, name in dealt)
            made["tables"][name] = {"schema": rows.drop(BUCKET).schema.jsonValue(), "folders": folders, "buckets": n}
        return self._swap(made)

    def sync(self, tables: dict[str, tuple[DataFrame, list[str]]], buckets: int = BUCKETS) -> dict[str, dict[str, int]]:
        """Makes tables what is given, all in one version; counts of rows written, deleted, unchanged by table.

        tables: rows and key columns by name.  Of rows with one key the one of
        the greatest hash is kept.  Nothing is committed if nothing differs.
        """
        base = self.manifest()
        counts, changed = {}, {}
        for name, (new, key) in tables.items():
            known = base["tables"].get(name)
            n = known["buckets"] if known else buckets
            new = new.withColumn(HASH, canonical_hash(new.columns))
            one = Window.partitionBy(*key).orderBy(F.desc(HASH))
            new = new.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n").withColumn(BUCKET, bucket_of(n, *key))
            old = self.read(name, manifest=base)
            if old is None or old.drop(HASH).dtypes != new.drop(HASH, BUCKET).dtypes:
                counts[name] = {"written": new.count(), "deleted": old.count() if old is not None else 0, "unchanged": 0}
                changed[name] = (new, None, n, key)
                continue
            same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
            on = same[0]
            for s in same[1:]:
                on = on & s
            a = old.select(*key, HASH).withColumn("__a", F.lit(1)).alias("a")
            b = new.select(*key, HASH, BUCKET).withColumn("__b", F.lit(1)).alias("b")
            status = F.when(F.col("__b").isNull(), "deleted").when(F.col("__a").isNull() | (F.col(f"a.{HASH}") != F.col(f"b.{HASH}")), "written").otherwise("unchanged")
            where = F.coalesce(F.col(f"b.{BUCKET}"), F.pmod(F.xxhash64(*[F.col(f"a.{k}") for k in key]), F.lit(n)).cast("int"))
            seen = a.join(b, on, "full").select(status.alias("status"), where.alias("bucket")).groupBy("bucket", "status").count().collect()
            counts[name] = {s: sum(r["count"] for r in seen if r.status == s) for s in ("written", "deleted", "unchanged")}
            moved = sorted({r.bucket for r in seen if r.status != "unchanged"})
            if moved:
                changed[name] = (new.where(F.col(BUCKET).isin(moved)), moved, n, key)
        if changed:
            self.commit(changed, base)
        return counts

    def vacuum(self, keep: int = 2) -> int:
        """Deletes versions but the last ``keep``, and data that none of these read; how many folders went."""
        last = self.latest()
        kept = [self.manifest(v) for v in range(max(1, last - keep + 1), last + 1)]
        used = {p.split("/")[1] for m in kept for t in m["tables"].values() for p in t["folders"].values()}
        gone = [n for n in self._names(f"{self.folder}/data") if n not in used]
        for v in range(1, last - keep + 1):
            self._fs.delete(self._path(f"{self.folder}/versions/v-{v:09d}.json"), False)
        for n in gone:
            self._fs.delete(self._path(f"{self.folder}/data/{n}"), True)
        return len(gone)
