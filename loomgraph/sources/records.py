"""Small records: question sets, run history, run state, tree summaries, repositories."""

from __future__ import annotations

import hashlib
import json
import subprocess
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.changes import recent_runs, upserted_run
from .tables import load

QA = "id string, repo_url string, repo_path string, question string, question_type string, gold_spans array<string>, relevant_citations array<string>, notes string"
RUN = "run_id string, repo_id string, question string, intent string, result string, review_passed boolean, low_confidence boolean, status string, warnings string, node_timings string, created_at timestamp"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines question set; blank and # lines are skipped, spans are texts path:start-end or objects."""
    lines = spark.read.text(path).where("trim(value) != '' and not startswith(trim(value), '#')")
    spans = "array<struct<file_path:string,start_line:int,end_line:int>>"
    objects = F.from_json(F.get_json_object("value", "$.gold_spans"), spans)
    q = lines.select(F.from_json("value", QA).alias("q"), objects.alias("o")).select("q.*", "o")
    parsed = lambda c: F.transform(c, lambda s: F.struct(F.regexp_extract(s, r"^(.+):(\d+)-(\d+)$", 1).alias("file_path"), F.regexp_extract(s, r"^(.+):(\d+)-(\d+)$", 2).try_cast("int").alias("start_line"), F.regexp_extract(s, r"^(.+):(\d+)-(\d+)$", 3).try_cast("int").alias("end_line")))
    good = F.filter("o", lambda s: s["file_path"].isNotNull())
    texts = parsed(F.coalesce("gold_spans", "relevant_citations"))
    return q.withColumn("spans", F.when(F.size(good) > 0, good).otherwise(F.filter(texts, lambda s: s["file_path"] != ""))).drop("o", "gold_spans", "relevant_citations")


class RunStore:
    """Runs as a Parquet table; a save replaces the run and keeps when it was made."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _pointer(self) -> str:
        return f"{self.path}/current"

    def all(self) -> DataFrame:
        now = load(self.spark, self._pointer(), "version long")
        if now is None:
            return self.spark.createDataFrame([], RUN)
        return self.spark.read.schema(RUN).parquet(f"{self.path}/v{now.agg(F.max('version')).first()[0]}")

    def save(self, runs: DataFrame) -> None:
        merged = upserted_run(self.all(), runs.select(*[c.split()[0] for c in RUN.split(", ")]))
        version = time.time_ns()
        merged.write.parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(self._pointer())

    def get(self, run_id: str) -> dict | None:
        r = self.all().where(F.col("run_id") == run_id).first()
        return r.asDict() if r else None

    def list_recent(self, limit: int = 20) -> list[dict]:
        return [r.asDict() for r in recent_runs(self.all(), limit).collect()]


class RunState:
    """Key to value in this process, each for a while."""

    def __init__(self, ttl: float = 3600.0):
        self.ttl, self._kept = ttl, {}

    def set(self, key: str, value: object, ttl: float | None = None) -> None:
        self._kept[key] = (time.monotonic() + (ttl or self.ttl), json.dumps(value))

    def get(self, key: str) -> object | None:
        until, value = self._kept.get(key, (0.0, "null"))
        return json.loads(value) if until > time.monotonic() else None

    def delete(self, key: str) -> None:
        self._kept.pop(key, None)


def checkout(source: str, workspace: str) -> dict[str, str]:
    """A local folder as it is, or a clone of an address; ``commit`` is empty outside git."""
    plain = source.strip().replace("\\", "/").rstrip("/").removesuffix(".git")
    repo = hashlib.sha256(plain.encode()).hexdigest()[:16]
    folder = Path(source)
    if source.startswith(("http://", "https://", "git@", "ssh://")):
        folder = Path(workspace) / repo
        if folder.exists():
            subprocess.run(["git", "-C", str(folder), "pull", "--ff-only"], check=False, capture_output=True)
        else:
            subprocess.run(["git", "clone", "--", source, str(folder)], check=True, capture_output=True)
    if not folder.is_dir():
        raise FileNotFoundError(source)
    got = subprocess.run(["git", "-C", str(folder), "rev-parse", "HEAD"], check=False, capture_output=True, text=True)
    return {"repo_id": repo, "local_path": str(folder), "commit": got.stdout.strip() if got.returncode == 0 else ""}


def tree_summary(files: DataFrame, most: int = 48) -> str:
    """Folders by two levels, with how many files each has."""
    two = F.array_join(F.slice(F.split("file_path", "/"), 1, 2), "/")
    rows = files.groupBy(two.alias("at")).agg(F.count("*").alias("n")).orderBy("at").limit(most).collect()
    return "\n".join(f"{r['at']} ({r['n']})" if r["n"] > 1 else r["at"] for r in rows)
