"""Change detection, differential writing and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_FILES, MOST_SHARE = 32, 0.35


def compared(old: DataFrame, new: DataFrame, key: str = "file_path", value: str = "content_hash") -> DataFrame:
    """Rows key, status: added, changed, unchanged or deleted."""
    both = old.select(key, F.col(value).alias("__old")).join(new.select(key, F.col(value).alias("__new")), key, "full")
    status = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return both.select(key, status.alias("status"))


def structural(changed: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds ``structural``: false only where both structure hashes are known and equal."""
    a, b = old.select("file_path", F.col("structure_hash").alias("__a")), new.select("file_path", F.col("structure_hash").alias("__b"))
    both = changed.join(a, "file_path", "left").join(b, "file_path", "left")
    return both.withColumn("structural", ~F.coalesce(F.col("__a") == F.col("__b"), F.lit(False))).drop("__a", "__b")


def structure_hash(definitions: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Rows file_path, structure_hash of sorted signatures, calls and imports; lines don't count."""
    sign = F.concat_ws("|", "kind", F.coalesce("parent_name", F.lit("")), "name", F.array_join(F.transform("bases", lambda b: F.concat(b["relation"], F.lit(":"), b["name"])), ","))
    parts = definitions.select("file_path", F.lit(0).alias("part"), sign.alias("x")).unionByName(calls.select("file_path", F.lit(1).alias("part"), F.concat_ws("|", "caller", F.coalesce("receiver", F.lit("")), "callee").alias("x"))).unionByName(imports.select("file_path", F.lit(2).alias("part"), F.col("target").alias("x")))
    own = parts.groupBy("file_path").agg(F.array_sort(F.collect_set(F.struct("part", "x"))).alias("s"))
    return own.select("file_path", F.sha2(F.array_join(F.transform("s", lambda e: F.concat_ws("\x1f", e["part"].cast("string"), e["x"])), "\x00"), 256).alias("structure_hash"))


def update_mode(counts: dict[str, int], forced: bool = False, known: bool = True) -> str:
    """cached if nothing changed, merge if little did, full otherwise. counts: rows by status."""
    moved = sum(counts.get(s, 0) for s in ("added", "changed", "deleted"))
    total = moved + counts.get("unchanged", 0)
    if forced or not known:
        return "full"
    if not moved:
        return "cached"
    return "merge" if moved <= MOST_FILES and moved <= MOST_SHARE * max(total, 1) else "full"


def differential(old: DataFrame, new: DataFrame, key: str, row_hash: str = "row_hash") -> tuple[DataFrame, DataFrame]:
    """The new table, rows that didn't change taken from the old one; and counts written, deleted, unchanged."""
    both = old.select(key, F.col(row_hash).alias("__old")).join(new.select(key, F.col(row_hash).alias("__new")), key, "full")
    same = F.coalesce(F.col("__old") == F.col("__new"), F.lit(False))
    counts = both.agg(F.count(F.when(F.col("__new").isNotNull() & ~same, 1)).alias("written"), F.count(F.when(F.col("__new").isNull(), 1)).alias("deleted"), F.count(F.when(same, 1)).alias("unchanged"))
    unchanged = both.where(same).select(key)
    return old.join(unchanged, key, "left_semi").unionByName(new.join(unchanged, key, "left_anti")), counts


def upserted_run(old: DataFrame, new: DataFrame) -> DataFrame:
    """Runs by run_id; a run that was there keeps its created_at."""
    first = old.select("run_id", F.col("created_at").alias("__first"))
    updated = new.join(first, "run_id", "left").withColumn("created_at", F.coalesce("__first", "created_at")).drop("__first")
    return old.join(new.select("run_id"), "run_id", "left_anti").unionByName(updated.select(*old.columns))


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("created_at"), "run_id").limit(limit)


def deleted(table: DataFrame, gone: DataFrame, key: str = "file_path") -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")
