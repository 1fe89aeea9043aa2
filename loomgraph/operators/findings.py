"""Findings about an architecture, each with the evidence that it rests on.

A finding without evidence isn't one: :func:`supported` leaves it out.  Lists of
evidence are cut to a stated number by rank, never collected whole.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, paths, roles
from .architecture import MESSAGE_NAMES

EVIDENCE = "struct<kind:string,file_path:string,start_line:int,end_line:int,node_id:string,edge_id:string,note:string>"
COLUMNS = ("finding_id", "category", "title", "detail", "evidence", "confidence", "reason")
#: Evidence of a finding, and of its parts.
MOST, OF_MODULE, OF_LAYERS = 8, 6, 5
#: Roles that speak for a pattern.
PATTERN_ROLES = {"layered": ("controller", "service", "repository"), "mvc": ("controller", "repository"), "hexagonal": ("service", "repository"), "event_driven": ("mq",)}


def evidence(kind: Column | str, file_path: Column | None = None, start: Column | None = None, end: Column | None = None, node: Column | None = None, edge: Column | None = None, note: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None)
    parts = zip(("kind", "file_path", "start_line", "end_line", "node_id", "edge_id", "note"), (kind, file_path, start, end, node, edge, note), strict=True)
    return F.struct(*[(none if v is None else v).alias(k) for k, v in parts]).cast(EVIDENCE)


def _listed(rows: DataFrame, key: list[str], order: list[str], most: int, into: str) -> DataFrame:
    """Of rows (key, order, evidence) the first ``most`` of each key as a list."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    some = rows.withColumn("__n", turn).where(F.col("__n") <= most)
    lists = some.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("__n", "evidence"))).alias("__l"))
    return lists.select(*key, F.transform("__l", lambda x: x["evidence"]).alias(into))


def supported(found: DataFrame) -> DataFrame:
    return found.where(F.size("evidence") > 0)


def layer_samples(edges: DataFrame, nodes: DataFrame, most: int = OF_LAYERS) -> DataFrame:
    """The first call edges that go down or up the layers between known roles: rows pos, evidence."""
    known = nodes.where(F.col("role") != roles.UNKNOWN).select(F.col("qualified_name").alias("ref"), "role", roles.layer(F.col("role")).alias("rank"))
    both = edges.where("edge_type = 'call'").join(known.toDF("source", "a", "r1"), "source").join(known.toDF("target", "b", "r2"), "target").where("r1 != r2")
    way = F.when(F.col("r2") > F.col("r1"), "downward ").otherwise("upward ")
    edge = ids.edge_id(F.lit("call"), ids.symbol_node(F.col("source")), ids.symbol_node(F.col("target")))
    some = both.orderBy("source", "target").limit(most)
    return some.select(F.row_number().over(Window.orderBy("source", "target")).alias("pos"), evidence("edge", ids.ref_file(F.col("source")), F.col("line"), F.col("line"), edge=edge, note=F.concat(way, "a", F.lit("->"), "b")).alias("evidence"))


def _of_nodes(nodes: DataFrame, note: Column) -> DataFrame:
    kind = F.when(F.col("kind") == "file", "file").otherwise("symbol")
    return nodes.where("file_path is not null").select("role", "id", evidence(kind, F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("id"), note=note).alias("evidence"))


def boundary_findings(modules: DataFrame, nodes: DataFrame) -> DataFrame:
    """One for each module with a type, or with a boundary that is more than a guess; its first files are the evidence."""
    own = nodes.where("kind = 'file'").withColumn("module", paths.cluster_key(F.col("file_path"))).where("module is not null")
    own = own.select("module", "file_path", evidence("file", F.col("file_path"), node=F.col("id"), note=F.concat(F.lit("in "), "module")).alias("evidence"))
    clear = modules.where("module_type != 'unknown' or boundary != 'low'")
    out = clear.join(_listed(own, ["module"], ["file_path"], OF_MODULE, "evidence"), "module")
    detail = F.concat_ws("", F.lit("typed as "), "module_type", F.lit(", boundary "), "boundary", F.lit(", "), "responsibility")
    return supported(out.select(F.concat(F.lit("mod-"), "module").alias("finding_id"), F.lit("module_boundary").alias("category"), F.concat(F.lit("Region "), "module").alias("title"), detail.alias("detail"), "evidence", F.col("boundary").alias("confidence"), F.lit("module_discovery").alias("reason")))


def pattern_findings(ranked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The primary pattern, if there is one, with calls between layers, a node of each role that speaks for it, and names of messages; else the first file, and less confidence."""
    patterns = F.create_map(*[x for k, v in PATTERN_ROLES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    best = ranked.where("primary").select("pattern", "score", F.try_element_at(patterns, F.col("pattern")).alias("wanted"))
    of_role = _listed(_of_nodes(nodes.where("role != 'unknown'"), F.concat(F.lit("role:"), "role")), ["role"], ["id"], 1, "found")
    by_role = best.select("pattern", F.posexplode("wanted").alias("pos", "role")).join(of_role, "role").select("pattern", F.lit(1).alias("part"), "pos", F.explode("found").alias("evidence"))
    calls = best.where("pattern = 'layered'").select("pattern").crossJoin(layer_samples(edges, nodes)).select("pattern", F.lit(0).alias("part"), "pos", "evidence")
    says = functools.reduce(lambda a, b: a | b, [F.contains(F.lower("name"), F.lit(x)) for x in MESSAGE_NAMES])
    named = nodes.where((F.col("kind") != "file") & F.col("file_path").isNotNull() & says).orderBy("id").limit(MOST)
    named = _of_nodes(named, F.lit("message name")).select(F.lit(2).alias("part"), F.row_number().over(Window.orderBy("id")).alias("pos"), "evidence")
    named = best.where("pattern = 'event_driven'").select("pattern").crossJoin(named).select("pattern", "part", "pos", "evidence")
    any_file = nodes.where("file_path is not null").orderBy("file_path").limit(1).select(F.lit(9).alias("part"), F.lit(0).alias("pos"), evidence("file", F.col("file_path"), note=F.lit("fallback")).alias("evidence"))
    last = best.select("pattern").crossJoin(any_file).select("pattern", "part", "pos", "evidence")
    every = calls.unionByName(by_role).unionByName(named)
    every = every.unionByName(last.join(every.select("pattern").distinct(), "pattern", "left_anti"))
    out = best.join(_listed(every, ["pattern"], ["part", "pos"], MOST, "evidence"), "pattern")
    bare = F.col("evidence")[0]["note"] == "fallback"
    sure = F.when(bare, "low").otherwise(F.when(F.col("score") >= 0.75, "high").when(F.col("score") >= 0.45, "medium").otherwise("low"))
    return supported(out.select(F.concat(F.lit("pattern-"), "pattern").alias("finding_id"), F.lit("pattern").alias("category"), F.concat(F.lit("Pattern "), "pattern").alias("title"), F.concat(F.lit("score "), F.round("score", 2).cast("string")).alias("detail"), "evidence", sure.alias("confidence"), F.lit("pattern_detection").alias("reason")))


def profile_findings(frameworks: DataFrame, infrastructure: DataFrame, languages: DataFrame, nodes: DataFrame) -> DataFrame:
    """One for each framework and infrastructure (name, kind, file_path) that a file names; if none does, one of the languages (language, n)."""
    slug = F.regexp_replace(F.lower("name"), r"[^a-z0-9]+", "-")
    made = lambda df, kind: df.where("file_path is not null").select(F.concat(F.lit(f"{kind}-"), slug).alias("finding_id"), F.lit("profile").alias("category"), F.concat(F.lit("Framework " if kind == "fw" else "Infrastructure "), "name").alias("title"), F.coalesce(F.col("kind"), F.lit(kind)).alias("detail"), F.array(evidence("file", F.col("file_path"), note=F.lit("manifest"))).alias("evidence"), F.lit("high").alias("confidence"), F.lit("repository_profile").alias("reason"))
    named = made(frameworks, "fw").unionByName(made(infrastructure, "infra"))
    told = languages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("language", "n"))), lambda x: F.concat(x["language"], F.lit(" "), x["n"].cast("string"))), ", ").alias("detail"))
    first = nodes.where("file_path is not null and language is not null").orderBy("file_path").limit(1).select(F.array(evidence("file", F.col("file_path"), note=F.lit("language"))).alias("evidence"))
    only = told.crossJoin(first).select(F.lit("profile-languages").alias("finding_id"), F.lit("profile").alias("category"), F.lit("Languages").alias("title"), "detail", "evidence", F.lit("medium").alias("confidence"), F.lit("repository_profile").alias("reason"))
    none = named.agg(F.count("*").alias("__named"))
    return named.unionByName(only.crossJoin(none).where("__named = 0").drop("__named"))
