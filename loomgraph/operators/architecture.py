"""Modules, their dependencies, patterns and findings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..sources.tables import written

# Directory names that say what a module is.
LAYER_NAMES = (
    "controller", "controllers", "service", "services", "repository", "repositories", "repo", "repos", "dao", "mapper", "mappers",
    "api", "apis", "web", "rest", "handlers", "handler", "routes", "endpoint", "endpoints", "persistence", "infra",
    "infrastructure", "gateway", "middleware", "filter", "filters",
)
TECHNICAL_NAMES = (
    "util", "utils", "common", "shared", "config", "configuration", "configs", "helper", "helpers", "constant", "constants",
    "exception", "exceptions", "error", "errors", "dto", "vos", "vo", "bean", "beans", "model", "models", "entity", "entities",
    "misc", "internal", "support",
)
LABELS = (("controller", "http_api"), ("service", "application_service"), ("repository", "persistence"), ("mq", "messaging"), ("cache", "caching"))


def modules(nodes: DataFrame, topics: DataFrame | None = None) -> DataFrame:
    """Rows module, n_files, roles (map role to count), module_type, boundary, responsibility.

    nodes: kind, file_path, role. topics: topic, alias.
    """
    keyed = nodes.withColumn("module", paths.cluster_key(F.col("file_path"))).where("module is not null")
    files = keyed.groupBy("module").agg(F.countDistinct("file_path").alias("n_files"))
    mix = keyed.where("kind != 'file'").groupBy("module", "role").agg(F.count("*").alias("n"))
    roles = mix.groupBy("module").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("roles"),
        F.max_by("role", F.struct("n", "role")).alias("dominant"),
        F.countDistinct(F.when(F.col("role").isin("controller", "service", "repository"), F.col("role"))).alias("n_layers"),
        F.min("role").alias("r1"),
        F.max("role").alias("r2"),
    )
    out = files.join(roles, "module", "left").withColumn("leaf", F.lower(F.element_at(F.split("module", "/"), -1)))
    if topics is not None:
        hit = out.select("module", "leaf").join(topics, F.contains(F.col("leaf"), F.col("alias"))).groupBy("module").agg(F.min("topic").alias("topic"))
        out = out.join(hit, "module", "left")
    else:
        out = out.withColumn("topic", F.lit(None).cast("string"))
    layered = F.exists(F.split(F.lower("module"), "/"), lambda s: s.isin(*LAYER_NAMES))
    technical, topic = F.col("leaf").isin(*TECHNICAL_NAMES), F.col("topic").isNotNull()
    mixed, only_repo = F.coalesce(F.col("n_layers"), F.lit(0)) >= 2, (F.col("r1") == "repository") & (F.col("r2") == "repository")
    kind = F.when(layered, "layer").when(technical, "technical").when(topic | mixed | only_repo, "feature").otherwise("unknown")
    sure = F.when(layered | technical, "medium").when(topic & mixed, "high").when(topic | mixed, "medium").otherwise("low")
    label = F.coalesce("topic", *[F.when(F.col("dominant") == r, F.lit(x)) for r, x in LABELS], F.when(F.col("leaf").isin(*LAYER_NAMES), F.concat(F.lit("layer:"), "leaf")), F.when(technical, F.concat(F.lit("technical:"), "leaf")), F.concat(F.lit("module:"), "leaf"))
    return out.select("module", "n_files", "roles", kind.alias("module_type"), sure.alias("boundary"), label.alias("responsibility"))


def module_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Rows source, target, n of edges between modules, own included. edges: source, target (files), and n if they are counted; files: file_path, module.

    Edges are counted by their files before these meet a module, and the counts
    are written, so that edges are read once however often the rows are.
    """
    a = files.select(F.col("file_path").alias("source"), F.col("module").alias("m1"))
    b = files.select(F.col("file_path").alias("target"), F.col("module").alias("m2"))
    counted = edges.groupBy("source", "target").agg((F.sum("n") if "n" in edges.columns else F.count("*")).alias("n"))
    return written(counted.join(a, "source").join(b, "target").groupBy(F.col("m1").alias("source"), F.col("m2").alias("target")).agg(F.sum("n").alias("n")), "module-edges")


def cohesion(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Rows module, internal, external, cohesion: the part of a module's edges that stay in it; 1 without any."""
    ends = pairs.select(F.explode(F.array_distinct(F.array("source", "target"))).alias("module"), "n", (F.col("source") == F.col("target")).alias("own"))
    sums = ends.groupBy("module").agg(F.sum(F.when(F.col("own"), F.col("n")).otherwise(0)).alias("internal"), F.sum(F.when(F.col("own"), 0).otherwise(F.col("n"))).alias("external"))
    out = names.select("module").join(sums, "module", "left").fillna(0, ["internal", "external"])
    total = F.col("internal") + F.col("external")
    return out.withColumn("cohesion", F.when(total == 0, 1.0).otherwise(F.col("internal") / total))


def coupling(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Rows module, fan_in, fan_out, coupling: distinct other modules by direction."""
    cross = pairs.where("source != target").select("source", "target").distinct()
    out = cross.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("fan_out"))
    into = cross.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("fan_in"))
    both = names.select("module").join(into, "module", "left").join(out, "module", "left").fillna(0, ["fan_in", "fan_out"])
    return both.select("module", "fan_in", "fan_out", (F.col("fan_in") + F.col("fan_out")).cast("double").alias("coupling"))


def totals(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """One row: module_count, cross_edges, directed_pairs, density, max_fan_in, max_fan_out."""
    per = coupling(pairs, names).agg(F.count("*").alias("module_count"), F.max("fan_in").alias("max_fan_in"), F.max("fan_out").alias("max_fan_out"))
    cross = pairs.where("source != target").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("cross_edges"), F.countDistinct("source", "target").alias("directed_pairs"))
    possible = F.when(F.col("module_count") > 1, F.col("module_count") * (F.col("module_count") - 1)).otherwise(1)
    return per.crossJoin(cross).select("module_count", "cross_edges", "directed_pairs", (F.col("directed_pairs") / possible).alias("density"), "max_fan_in", "max_fan_out")


def coupling_findings(per_module: DataFrame, high_fan_out: int = 5, high_coupling: int = 8) -> DataFrame:
    """Rows module, finding: high_fan_out, high_coupling, hub (much used, uses little)."""
    found = F.array(
        F.when(F.col("fan_out") >= high_fan_out, F.lit("high_fan_out")),
        F.when(F.col("coupling") >= high_coupling, F.lit("high_coupling")),
        F.when((F.col("fan_in") >= 5) & (F.col("fan_out") <= 1), F.lit("hub")),
    )
    return per_module.select("module", F.explode(F.array_compact(found)).alias("finding"))


def cycle_findings(found: DataFrame, most: int = 10) -> DataFrame:
    return found.select(F.array_join("path", " -> ").alias("cycle"), F.size("path").alias("length")).orderBy("length", "cycle").limit(most)


def role_counts(nodes: DataFrame) -> DataFrame:
    return nodes.where("kind != 'file'").groupBy("role").agg(F.count("*").alias("n"))


def layer_edges(edges: DataFrame, nodes: DataFrame, layer) -> DataFrame:
    """One row: call edges that go down and up the layers."""
    ranked = nodes.select(F.col("qualified_name").alias("ref"), layer(F.col("role")).alias("rank"))
    both = edges.where("edge_type = 'call'").join(ranked.toDF("source", "r1"), "source").join(ranked.toDF("target", "r2"), "target")
    return both.agg(F.count(F.when(F.col("r2") > F.col("r1"), 1)).alias("downward"), F.count(F.when(F.col("r2") < F.col("r1"), 1)).alias("upward"))


# Path parts and names that patterns show themselves by.
MODEL_PATHS = ("/model", "/models", "/entity", "/entities", "/dto")
VIEW_PATHS = ("/view", "/views", "/templates", "/thymeleaf")
DOMAIN_PATHS = ("/domain/", "/application/", "/usecase", "/port/", "/ports/")
ADAPTER_PATHS = ("/adapter", "/adapters", "/infra/", "/infrastructure/", "/persistence/")
MESSAGE_PATHS = ("/messaging", "/kafka", "/rabbit", "/events", "/consumer")
MESSAGE_NAMES = ("listener", "consumer", "producer", "publisher", "onmessage")


def pattern_signals(nodes: DataFrame) -> DataFrame:
    """One row: nodes of each role, and whether paths and names have what patterns look for; one aggregate over all nodes."""
    path = F.lower(F.coalesce("file_path", F.lit("")))
    holds = lambda c, parts: functools.reduce(lambda a, b: a | b, [F.contains(c, F.lit(x)) for x in parts])
    symbol = F.col("kind") != "file"
    flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
    return nodes.agg(
        *[F.count(F.when(symbol & (F.col("role") == r), 1)).alias(r) for r in ("controller", "service", "repository", "mq")],
        *[flag(holds(path, v)).alias(k) for k, v in (("model", MODEL_PATHS), ("view", VIEW_PATHS), ("domainish", DOMAIN_PATHS), ("adapterish", ADAPTER_PATHS), ("messaging", MESSAGE_PATHS), ("domain", ("domain/",)), ("adapter", ("adapter",)))],
        F.count(F.when(symbol & holds(F.lower("name"), MESSAGE_NAMES), 1)).alias("hints"),
    )


def pattern_scores(signals: DataFrame, layers: DataFrame, layer_modules: DataFrame, mq_infra: int = 0) -> DataFrame:
    """Rows pattern, score (0 to 1), from one row each of signals, layer edges (downward, upward) and layer modules (n).

    ``mq_infra`` counts message queues that the repository's profile names.
    Message names add 0.05 each until the score is 0.9.
    """
    row = signals.crossJoin(layers).crossJoin(layer_modules.select(F.col("n").alias("layer_modules")))
    has = lambda r: (F.col(r) > 0).cast("int")
    trio = has("controller") * has("service") * has("repository")
    calls = F.col("downward") + F.col("upward")
    layered = 0.2 * (has("controller") + has("service") + has("repository")) + 0.15 * trio + F.when(calls > 0, 0.25 * F.col("downward") / F.greatest(calls, F.lit(1))).otherwise(0.0) - F.when(F.col("upward") > F.col("downward"), 0.1).otherwise(0.0) + F.when(F.col("layer_modules") >= 2, 0.1).otherwise(0.0)
    mvc = 0.35 * has("controller") + 0.25 * has("repository") + 0.15 * F.col("model") + 0.15 * has("service") + 0.15 * F.col("view") - 0.1 * F.col("domain") * F.col("adapter")
    hexagonal = 0.35 * F.col("domainish") + 0.35 * F.col("adapterish") + 0.2 * F.col("domainish") * F.col("adapterish") - 0.15 * has("controller") * has("service") * (1 - F.col("domainish"))
    base = 0.4 * has("mq") + 0.25 * F.col("messaging") + 0.25 * mq_infra
    # One name at least is added, even to a score of 0.9.
    added = F.least(F.col("hints"), F.greatest(F.lit(1), F.ceil((0.9 - base) / 0.05 - 1e-9)))
    event = base + 0.05 * added
    clip = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    each = F.array(*[F.struct(F.lit(k).alias("pattern"), clip(v).cast("double").alias("score")) for k, v in (("layered", layered), ("mvc", mvc), ("hexagonal", hexagonal), ("event_driven", event))])
    return row.select(F.explode(each).alias("p")).select("p.pattern", "p.score")


def ranked_patterns(scores: DataFrame, least: float = 0.45) -> DataFrame:
    """Adds rank and primary: the best one, if it reaches ``least``. There are four rows."""
    ranked = scores.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "pattern")))
    return ranked.withColumn("primary", (F.col("rank") == 1) & (F.col("score") >= least))


def language_counts(files: DataFrame) -> DataFrame:
    return files.where("language is not null").groupBy("language").agg(F.countDistinct("file_path").alias("n"))


def with_evidence(findings: DataFrame, evidence: str = "evidence") -> DataFrame:
    """A finding must point at something."""
    return findings.where(F.size(evidence) > 0)
