"""Retrieval and graph quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def overlaps(a: str, b: str) -> Column:
    """Whether spans overlap, ends included; a and b are aliases of rows with file_path, start_line, end_line."""
    return (F.col(f"{a}.file_path") == F.col(f"{b}.file_path")) & (F.col(f"{a}.start_line") <= F.col(f"{b}.end_line")) & (F.col(f"{b}.start_line") <= F.col(f"{a}.end_line"))


def at_k(predictions: DataFrame, gold: DataFrame, questions: DataFrame, match: Column | None = None, k: int = 5) -> DataFrame:
    """Rows query_id, recall, precision, mrr for each question; 0 where it has no gold or no prediction.

    predictions: query_id, rank and an item; gold: query_id and an item; ``match``
    compares rows aliased p and g (the same doc_id if none is given).
    """
    match = F.col("p.doc_id") == F.col("g.doc_id") if match is None else match
    top = predictions.where(F.col("rank") <= k)
    numbered = gold.withColumn("gold_no", F.monotonically_increasing_id()) if "gold_no" not in gold.columns else gold
    pairs = top.alias("p").join(numbered.alias("g"), (F.col("p.query_id") == F.col("g.query_id")) & match).select("p.query_id", "p.rank", "g.gold_no")
    hit = pairs.groupBy("query_id").agg(F.countDistinct("gold_no").alias("found"), F.countDistinct("rank").alias("good"), F.min("rank").alias("first"))
    shown = top.groupBy("query_id").agg(F.count("*").alias("shown"))
    wanted = numbered.groupBy("query_id").agg(F.count("*").alias("wanted"))
    all_ = questions.select("query_id").join(wanted, "query_id", "left").join(shown, "query_id", "left").join(hit, "query_id", "left")
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return all_.select("query_id", part("found", "wanted").alias("recall"), F.when(F.col("wanted").isNull(), 0.0).otherwise(part("good", "shown")).alias("precision"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def macro(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    return metrics.groupBy(*(by or [])).agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("recall", "precision", "mrr")], F.count("*").alias("n"))


def ref_matches(predicted: Column, gold: Column) -> Column:
    """A gold ref may leave directories out."""
    plain = lambda c: F.trim(F.replace(c, F.lit("\\"), F.lit("/")))
    return (plain(gold) != "") & F.contains(plain(predicted), plain(gold))


def set_recall(predicted: Column, gold: Column) -> Column:
    """Part of an array of gold refs that some predicted ref matches."""
    found = F.size(F.filter(gold, lambda g: F.exists(predicted, lambda p: ref_matches(p, g))))
    return F.when(F.size(gold) == 0, 0.0).otherwise(found / F.size(gold))


def set_precision(predicted: Column, gold: Column) -> Column:
    good = F.size(F.filter(predicted, lambda p: F.exists(gold, lambda g: ref_matches(p, g))))
    return F.when((F.size(gold) == 0) | (F.size(predicted) == 0), 0.0).otherwise(good / F.size(predicted))


def ordered_coverage(predicted: Column, gold: Column) -> Column:
    """Gold refs met in order by predicted ones, up to the first that isn't."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("hit"), F.lit(True).alias("go"))

    def step(a: Column, g: Column) -> Column:
        left = F.slice(predicted, a["at"] + 1, F.size(predicted))
        place = F.array_position(F.transform(left, lambda p: ref_matches(p, g)), True).cast("int")
        ok = a["go"] & (place > 0)
        return F.struct(F.when(ok, a["at"] + place).otherwise(a["at"]).alias("at"), F.when(ok, a["hit"] + 1).otherwise(a["hit"]).alias("hit"), ok.alias("go"))

    return F.when(F.size(gold) == 0, 1.0).otherwise(F.aggregate(gold, start, step, lambda a: a["hit"] / F.size(gold)))


def latency(samples: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95 and p99 by linear interpolation."""
    return samples.groupBy(by).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)])


def edge_recall(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: gold, hit, recall."""
    n = gold.agg(F.count("*").alias("gold"))
    hit = gold.join(found.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("hit"))
    return n.crossJoin(hit).withColumn("recall", F.when(F.col("gold") == 0, 0.0).otherwise(F.col("hit") / F.col("gold")))


def label_summary(labels: DataFrame, columns: list[str]) -> DataFrame:
    return labels.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])


def containing(docs: DataFrame, questions: DataFrame, head: int = 5) -> DataFrame:
    """Rows query_id, doc_id: documents whose text contains the question's.

    Pairs are found by an equal join on the ``head`` words after the question's
    first, which stand between spaces wherever the question does, and then
    verified; questions of fewer words are searched for in every text.
    """
    words = F.split("text", " ")
    asked = questions.select("query_id", F.col("text").alias("asked"), words.alias("w"))
    long = F.size("w") >= head + 2
    keyed = asked.where(long).select("query_id", "asked", F.xxhash64(F.slice("w", 2, head)).alias("key"))
    at = F.sequence(F.lit(1), F.size("w") - head + 1)
    windows = docs.select("doc_id", words.alias("w")).where(F.size("w") >= head)
    # Only ids go with the windows; texts are read again for what was found.
    found = windows.select("doc_id", F.explode(F.array_distinct(F.transform(at, lambda i: F.xxhash64(F.slice("w", i, head))))).alias("key"))
    found = written(found.join(F.broadcast(keyed.select("query_id", "key")), "key").select("query_id", "doc_id").distinct(), "containing")
    asked_of = F.broadcast(asked.select("query_id", "asked"))
    one = docs.select("doc_id", "text").join(found, "doc_id").join(asked_of, "query_id").where(F.contains("text", F.col("asked"))).select("query_id", "doc_id").distinct()
    short = asked.where(~long)
    two = docs.select("doc_id", "text").join(F.broadcast(short), F.contains(F.col("text"), F.col("asked"))).select("query_id", "doc_id").distinct()
    return one.unionByName(two)
