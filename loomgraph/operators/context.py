"""Choosing context under a token budget, and reviewing findings against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, paths, texts

WEIGHTS = {"entry": 0.20, "graph": 0.30, "relevance": 0.40, "tier": 0.10}
SHARES = {"code": 0.70, "graph": 0.15, "history": 0.10}


def min_max(value: Column, over: Window) -> Column:
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.when(hi - lo < 1e-12, 0.0).otherwise((value - lo) / (hi - lo))


def tier(source: Column, reason: Column) -> Column:
    near = F.contains(F.lower(reason), F.lit("called_by:")) | F.lower(reason).startswith("calls:")
    return F.when(source != "graph_expand", 1.0).when(F.coalesce(near, F.lit(False)), 0.55).otherwise(0.35)


def priorities(candidates: DataFrame, by: str = "query_id") -> DataFrame:
    """Adds priority; candidates have file_path, file_refs, symbol_refs, relevance, source, reason."""
    own = Window.partitionBy(by)
    graph = 0.5 * min_max(F.col("file_refs").cast("double"), own) + 0.5 * min_max(F.col("symbol_refs").cast("double"), own)
    entry = F.when(paths.is_entry(F.col("file_path")), 1.0).otherwise(0.0)
    t = tier(F.col("source"), F.col("reason"))
    w = WEIGHTS
    # What the graph brought in has no relevance of its own.
    raw = F.when(F.col("source") == "graph_expand", 0.0).otherwise(F.col("relevance"))
    total = w["entry"] * entry + w["graph"] * graph + w["relevance"] * min_max(raw, own) + w["tier"] * t
    return candidates.withColumn("tier", t).withColumn("priority", total)


def within_budget(scored: DataFrame, budget: int, by: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """The candidates that are kept: the lowest go until the rest fits the code share; one stays at least."""
    order = Window.partitionBy(by).orderBy(F.desc("priority"), F.desc("tier"), "tokens", item)
    running = F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = (running <= int(budget * SHARES["code"])) | (F.row_number().over(order) == 1)
    return scored.withColumn("__keep", kept).where("__keep").drop("__keep")


def prefix_within(lines: DataFrame, limit: int, by: str, order: str, text: str) -> DataFrame:
    """Lines up to the first that doesn't fit."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("__sum", F.sum(texts.n_tokens(F.col(text))).over(w)).where(F.col("__sum") <= limit).drop("__sum")


def latest(history: DataFrame, n: int, by: str, order: str) -> DataFrame:
    return history.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("__n") <= n).drop("__n")


def _shrunk(length: Column, limit: int) -> Column:
    """What is left of so many characters, cut to 0.85 of them until they are ``limit`` tokens or 32 characters at most."""
    over = lambda n: (n > 4 * limit) & (n > 32)
    # After 160 cuts nothing that Spark's strings can hold is over 32 characters.
    cut = F.aggregate(F.sequence(F.lit(1), F.lit(160)), length, lambda n, _: F.when(over(n), F.floor(n * F.lit(0.85))).otherwise(n))
    return F.when(over(length), cut).otherwise(length)


def history_text(history: DataFrame, window: int, limit: int, by: str, order: str, text: str) -> DataFrame:
    """Rows ``by``, text, tokens: the latest ``window`` texts, newest first, with an empty line between, shrunk to ``limit`` tokens.

    Blank and null texts are no history; a group of only such texts has no
    row.  Of equal ``order``, the smaller text is taken as the newer.  A text
    is cut to the limit before it is shuffled, only its length goes on whole;
    so a group's state is at most ``window`` texts of that size.  The window is
    a row number under a bound, which Spark applies before the shuffle too.
    """
    most, window = max(4 * limit, 32), max(window, 1)
    own = history.where(F.col(text).rlike(r"(?U)\S")).select(by, F.col(order).alias("__order"), F.substring(text, 1, most).alias("__text"), F.length(text).cast("long").alias("__length"))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("__order").desc(), "__text", "__length"))
    kept = own.withColumn("__n", place).where(F.col("__n") <= window)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__n", "__text"))), lambda x: x["__text"]), "\n\n")
    whole = kept.groupBy(by).agg(joined.alias("__joined"), (F.sum("__length") + 2 * (F.count("*") - 1)).alias("__whole"))
    shown = F.substring("__joined", F.lit(1), _shrunk(F.col("__whole"), limit).cast("int")) if limit > 0 else F.lit("")
    return whole.select(by, shown.alias("text")).withColumn("tokens", texts.n_tokens(F.col("text")))


def findings_text(findings: DataFrame, by: str, turn: str) -> DataFrame:
    """Rows ``by``, ``turn``, text: a round's findings as lines under its heading, in order of finding_id.

    findings: finding_id, claim, citations, confidence, tier.  What is unknown
    is a question mark.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    cites = F.coalesce(F.when(F.size("citations") > 0, F.array_join("citations", ", ")), F.lit("no-cite"))
    line = F.concat(F.lit("- ("), told("confidence"), F.lit("/"), told("tier"), F.lit(") "), F.coalesce("claim", F.lit("")), F.lit(" ["), cites, F.lit("]"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col("finding_id"), line.alias("line")))), lambda x: x["line"])
    head = F.concat(F.lit("[round "), F.col(turn).cast("string"), F.lit("]\n"))
    return findings.groupBy(by, turn).agg(lines.alias("__lines")).select(by, turn, F.concat(head, F.array_join("__lines", "\n")).alias("text"))


def review(findings: DataFrame, allowed: DataFrame, plan: DataFrame) -> DataFrame:
    """Issues: rows type, finding_id, citation, severity.

    findings: finding_id, claim, citations, symbols, step; allowed: citation,
    content, expanded; plan: step, question, a handful of rows.
    """
    issue = lambda df, kind, severity="high", cite=None: df.select(F.lit(kind).alias("type"), "finding_id", (F.lit(None).cast("string") if cite is None else F.col(cite)).alias("citation"), F.lit(severity).alias("severity"))
    missing = issue(findings.where(F.size("citations") == 0), "missing_citation")
    cites = findings.select("finding_id", F.explode("citations").alias("citation"))
    malformed = issue(cites.where(~ids.is_citation(F.col("citation"))), "malformed_citation", cite="citation")
    good = cites.where(ids.is_citation(F.col("citation"))).join(allowed, "citation", "left")
    unknown = issue(good.where("content is null"), "citation_not_in_retrieve", cite="citation")
    expanded = issue(good.where("expanded"), "expanded_citation", "low", "citation")
    code = good.where("content is not null").groupBy("finding_id").agg(F.array_join(F.collect_list("content"), "\n").alias("code"))
    symbols = findings.select("finding_id", F.explode("symbols").alias("symbol")).join(code, "finding_id")
    ungrounded = issue(symbols.where(~texts.has_symbol(F.col("symbol"), F.col("code"))).withColumn("citation", F.col("symbol")), "ungrounded_symbol", cite="citation")
    words = F.filter(F.regexp_extract_all(F.lower("question"), F.lit(r"[\w一-鿿]+"), F.lit(0)), lambda w: F.length(w) > 1)
    asked = plan.select(F.col("step").alias("__step"), words.alias("__words"))
    hit = F.size(F.filter("__words", lambda w: F.contains(F.lower("claim"), w)))
    enough = (F.size("__words") > 0) & (hit >= F.greatest(F.lit(1), F.floor(F.size("__words") / 2)))
    met = findings.select("step", "claim").join(F.broadcast(asked), (F.col("step") == F.col("__step")) | enough).select("__step").distinct()
    incomplete = issue(asked.join(met, "__step", "left_anti").select(F.lit(None).cast(findings.schema["finding_id"].dataType).alias("finding_id")), "incomplete_plan")
    out = missing
    for x in (malformed, unknown, expanded, ungrounded, incomplete):
        out = out.unionByName(x)
    return out


def verdict(issues: DataFrame) -> DataFrame:
    """One row: n_high, n_low, passed."""
    return issues.agg(F.count(F.when(F.col("severity") == "high", 1)).alias("n_high"), F.count(F.when(F.col("severity") == "low", 1)).alias("n_low")).withColumn("passed", F.col("n_high") == 0)
