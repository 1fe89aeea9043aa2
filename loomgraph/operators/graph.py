"""Dependency graphs: lookups, reach, paths, cycles and updates.

Edges are rows (source, target, edge_type, confidence, strategy, line,
relation, ordinal); call edges go from caller to callee, inherit edges from
child to parent, import edges from file to file.  Recursion is a bounded loop
of joins; each round is written where the session keeps checkpoints.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, roles
from ..sources.tables import written

KINDS = ("file", "class", "function", "method")
TYPES = ("import", "call", "inherit")
# Callees that no flow follows.
NOISE = (
    "tostring", "hashcode", "equals", "getclass", "clone", "finalize", "notify", "notifyall", "wait", "logger", "log", "debug", "info",
    "warn", "error", "print", "println",
)


def related(edges: DataFrame, seeds: DataFrame, kind: str, way: str) -> DataFrame:
    """Distinct ``ref`` for each ``seed``: way "in" gives sources (callers, importers, subtypes), "out" targets."""
    near, far = ("target", "source") if way == "in" else ("source", "target")
    own = edges.where(F.col("edge_type") == kind)
    return own.join(seeds.select("seed"), F.col(near) == F.col("seed")).select("seed", F.col(far).alias("ref")).distinct()


def neighbors(edges: DataFrame, node: str, way: str = "both", kind: str | None = None) -> DataFrame:
    hit = {"out": F.col("source") == node, "in": F.col("target") == node}
    cond = hit[way] if way != "both" else hit["out"] | hit["in"]
    own = edges.where(cond & (F.col("edge_type") == kind)) if kind else edges.where(cond)
    return own.withColumn("id", ids.edge_id(F.col("edge_type"), F.col("source"), F.col("target"))).dropDuplicates(["id"])


def deduplicated(edges: DataFrame) -> DataFrame:
    """The first edge of each kind, source, target and relation; without an ordinal comes before all.

    An aggregate: no edge is sorted or kept but the first, and columns that nobody reads aren't carried.
    """
    key = ["edge_type", "source", "target", "relation"]
    at = F.coalesce("ordinal", F.lit(-(1 << 63)))
    rest = [F.min_by(c, at).alias(c) for c in edges.columns if c not in key]
    return edges.groupBy(*key).agg(*rest).select(*edges.columns)


def resolve_names(names: DataFrame, refs: DataFrame) -> DataFrame:
    """Refs that a name may mean: the whole ref, or its symbol or member. Rows name, ref."""
    keys = refs.select("ref", F.explode(F.array_distinct(F.array("ref", ids.ref_symbol(F.col("ref")), ids.ref_short(F.col("ref"))))).alias("name"))
    return names.join(keys, "name").select("name", "ref").distinct()


def fan_in(edges: DataFrame) -> DataFrame:
    return edges.where("edge_type = 'call'").groupBy(F.col("target").alias("ref")).agg(F.count("*").alias("fan_in"))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 2, way: str = "affected", limit: int = 50) -> DataFrame:
    """Breadth first from each seed: affected follows callers, then subtypes; depends_on callees, then supertypes.

    Rows seed, ref, relation, hops: the first visit counts, seeds are left out,
    and a seed has ``limit`` at most, by hops, relation and name.  Depth is 1 to
    8, limit 1 to 200.
    """
    depth, limit = max(1, min(depth, 8)), max(1, min(limit, 200))
    near, far = ("target", "source") if way == "affected" else ("source", "target")
    call, sub = ("caller", F.lit("subtype")) if way == "affected" else ("callee", F.coalesce("relation", F.lit("extends")))
    steps = edges.where("edge_type in ('call', 'inherit')").select(F.col(near).alias("at"), F.col(far).alias("ref"), F.when(F.col("edge_type") == "call", call).otherwise(sub).alias("relation"), F.when(F.col("edge_type") == "call", 0).otherwise(1).alias("turn"))
    seen = seeds.select("seed", F.col("seed").alias("ref"), F.lit(None).cast("string").alias("relation"), F.lit(0).alias("hops"), F.lit(0).alias("turn"))
    frontier = seen
    for hop in range(1, depth + 1):
        found = frontier.select("seed", F.col("ref").alias("at")).join(steps, "at").groupBy("seed", "ref").agg(F.min(F.struct("turn", "relation")).alias("first"))
        fresh = found.join(seen.select("seed", "ref"), ["seed", "ref"], "left_anti").select("seed", "ref", "first.relation", F.lit(hop).alias("hops"), "first.turn")
        frontier = written(fresh, f"impact-{hop}")
        seen = seen.unionByName(frontier)
        if hop < depth and frontier.isEmpty():
            break
    order = Window.partitionBy("seed").orderBy("hops", "turn", "ref")
    return seen.where("hops > 0").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("seed", "ref", "relation", "hops")


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int = 2, least: float | None = None) -> DataFrame:
    """Callers, callees, supertypes and children within ``depth``; supertypes are reported, not followed.

    Rows seed, ref, relation, hops: the fewest hops of each.  Call edges under
    ``least`` confidence are dropped (the best edge of a pair counts).
    """
    pair = edges.where("edge_type = 'call'").groupBy("source", "target").agg(F.max(F.coalesce("confidence", F.lit(1.0))).alias("c"))
    calls = pair if least is None else pair.where(F.col("c") >= least)
    kin = edges.where("edge_type = 'inherit'").groupBy("source", "target").agg(F.min_by(F.coalesce("relation", F.lit("extends")), "ordinal").alias("relation"))
    step = lambda df, at, ref, rel, go: df.select(F.col(at).alias("at"), F.col(ref).alias("ref"), rel.alias("relation"), F.lit(go).alias("go"))
    steps = step(calls, "target", "source", F.lit("caller"), True).unionByName(step(calls, "source", "target", F.lit("callee"), True))
    steps = steps.unionByName(step(kin, "source", "target", F.col("relation"), False)).unionByName(step(kin, "target", "source", F.lit("child"), True))
    frontier = seeds.select("seed", F.col("seed").alias("at")).distinct()
    hits = None
    for hop in range(1, max(1, depth) + 1):
        found = written(frontier.join(steps, "at").select("seed", "ref", "relation", "go", F.lit(hop).alias("hops")).distinct(), f"blast-{hop}")
        hits = found if hits is None else hits.unionByName(found)
        frontier = found.where("go").select("seed", F.col("ref").alias("at")).distinct()
    return hits.groupBy("seed", "ref", "relation").agg(F.min("hops").alias("hops"))


def call_chain(edges: DataFrame, seeds: DataFrame, depth: int = 4) -> DataFrame:
    """From each seed, the first callee by name, and so on; ends before a repeat. Rows seed, path (two refs or more)."""
    first = edges.where("edge_type = 'call'").groupBy("source").agg(F.min("target").alias("next"))
    chain = seeds.select("seed", F.array("seed").alias("path"), F.lit(True).alias("open"))
    for _ in range(depth - 1):
        grown = chain.join(first, F.element_at("path", -1) == F.col("source"), "left")
        go = F.col("open") & F.col("next").isNotNull() & ~F.coalesce(F.array_contains("path", F.col("next")), F.lit(False))
        chain = grown.select("seed", F.when(go, F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"), go.alias("open"))
    return chain.where(F.size("path") >= 2).select("seed", "path")


def knowledge_nodes(files: DataFrame, definitions: DataFrame, edges: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """File nodes, symbol nodes, and shadow nodes for refs that edges name and nothing defines.

    ``ends`` (distinct ``ref``) stands for the edges where their ends are known already.
    """
    f = files.select(ids.file_node(F.col("file_path")).alias("id"), F.lit("file").alias("kind"), F.element_at(F.split("file_path", "/"), -1).alias("name"), F.col("file_path").alias("qualified_name"), "file_path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), "language", F.lit(None).cast("string").alias("parent_id"))
    ref = ids.make_ref(F.col("file_path"), F.col("name"), F.col("parent_name"))
    parent = F.when(F.col("parent_name").isNotNull(), ids.symbol_node(ids.make_ref(F.col("file_path"), F.col("parent_name"), F.lit(None).cast("string")))).otherwise(ids.file_node(F.col("file_path")))
    s = definitions.select(ids.symbol_node(ref).alias("id"), "kind", "name", ref.alias("qualified_name"), "file_path", "start_line", "end_line", "language", parent.alias("parent_id")).dropDuplicates(["id"])
    if ends is None:
        ends = edges.where("edge_type != 'import'").select(F.explode(F.array("source", "target")).alias("ref")).distinct()
    shadow = ends.select(ids.symbol_node(F.col("ref")).alias("id"), F.when(F.contains(ids.ref_symbol(F.col("ref")), F.lit(".")), "method").otherwise("function").alias("kind"), ids.ref_short(F.col("ref")).alias("name"), F.col("ref").alias("qualified_name"), ids.ref_file(F.col("ref")).alias("file_path"))
    shadow = shadow.join(s.select("id"), "id", "left_anti")
    return f.unionByName(s).unionByName(shadow, allowMissingColumns=True)


def with_line_evidence(edges: DataFrame) -> DataFrame:
    """Adds ``evidence``: the place of the line that made the edge, in the file that the edge starts from; empty without a line."""
    at = F.array(F.struct(ids.ref_file(F.col("source")).alias("file_path"), F.col("line").alias("start_line"), F.col("line").alias("end_line")))
    return edges.withColumn("evidence", F.when(F.col("line").isNotNull(), at).otherwise(F.slice(at, 1, 0)))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts by kind of node and edge, kinds without any too. Rows what, kind, n."""
    spark = nodes.sparkSession
    kinds = spark.createDataFrame([("node", k) for k in KINDS] + [("edge", k) for k in TYPES], "what string, kind string")
    n = nodes.groupBy(F.lit("node").alias("what"), "kind").agg(F.count("*").alias("n"))
    e = edges.groupBy(F.lit("edge").alias("what"), F.col("edge_type").alias("kind")).agg(F.count("*").alias("n"))
    return kinds.join(n.unionByName(e), ["what", "kind"], "left").select("what", "kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("source", "target")).alias("ref")).distinct()
    return ends.join(nodes.select(F.col("qualified_name").alias("ref")), "ref", "left_anti")


def topic_score(name: Column, blob: Column, terms: list[str]) -> Column:
    """1 for a name that is a term, 0.85 if it has one, 0.5 if the path has one."""
    if not terms:
        return F.lit(0.0)
    parts = [F.when(F.lower(name) == t, 1.0).when(F.contains(F.lower(name), F.lit(t)), 0.85).when(F.contains(F.lower(blob), F.lit(t)), 0.5).otherwise(0.0) for t in terms]
    return F.greatest(*parts, F.lit(0.0))


def step_score(bucket: Column, before: Column, after: Column, topic: Column, same_file: Column) -> Column:
    edge = F.when(bucket == "high", 0.25).when(bucket == "medium", 0.1).otherwise(-0.15)
    a, b = roles.layer(before), roles.layer(after)
    layer = F.when(b > a, 0.35).when((b == a) & (after != roles.UNKNOWN), 0.05).when(b < a, -0.2).otherwise(0.0)
    return 0.35 + edge + layer + 0.3 * topic + F.when(F.coalesce(same_file, F.lit(False)), 0.05).otherwise(0.0)


def path_bonus(role_path: Column, topics: Column) -> Column:
    has = lambda r: F.array_contains(role_path, r)
    n = F.size(role_path)
    kinds = F.when(has("controller") & has("service"), 0.4).otherwise(0.0) + F.when(has("service") & has("repository"), 0.4).otherwise(0.0) + F.when(has("controller") & has("repository"), 0.2).otherwise(0.0)
    return kinds + 0.15 * F.least(F.size(F.filter(topics, lambda t: t >= 0.5)), F.lit(3)) + F.when(n.between(3, 5), 0.15).when(n > 6, -0.2).otherwise(0.0)


#: Refs up to which rows are chosen by hashes of the refs, sent to all tasks; of more, both sides are shuffled.
REFS_SENT = 1 << 20


def _of(df: DataFrame, column: str, refs: DataFrame, most: int | None = None) -> DataFrame:
    """The rows of ``df`` whose ``column`` is one of ``refs`` (rows ``ref`` of a written table), for an exact join to follow.

    Up to ``most`` refs, a count that is checked, rows are chosen where they are
    read, before they are made distinct or shuffled; equal hashes may let others pass.
    """
    if refs.count() > (REFS_SENT if most is None else most):
        return df.join(refs, F.col(column) == F.col("ref"), "left_semi")
    return df.join(F.broadcast(refs.select(F.xxhash64("ref").alias("__h"))), F.xxhash64(column) == F.col("__h"), "left_semi")


def beam_search(nodes: DataFrame | Callable[[DataFrame], DataFrame], edges: DataFrame, entries: DataFrame, terms: list[str], depth: int = 5, width: int = 4, branching: int = 8, most: int = 3) -> DataFrame:
    """Scored call paths from each entry (rows ``entry``); nodes have id, name, qualified_name, file_path, role.

    ``nodes`` is a table, or a function that gives the nodes of distinct refs
    (rows ``ref``, written) where a table of all would be large.  Each round
    takes the calls that leave its paths' ends, and the nodes that they name,
    and keeps ``width`` paths an entry.  Paths end where nothing follows, at
    sinks from three nodes on, and at the depth.  Rows entry, path, score,
    roles, rank.
    """
    blob = F.concat_ws(" ", "name", "qualified_name", "file_path")

    def scored(some: DataFrame, name: str) -> DataFrame:
        return written(some.select("id", "role", "name", topic_score(F.col("name"), blob, terms).alias("topic")), name)

    # Each round reads a table of nodes; roles and topics are found once.
    every = scored(nodes, "beam-nodes") if isinstance(nodes, DataFrame) else None
    calls = edges.where("edge_type = 'call'").select("source", "target", "confidence")
    bucket, same = ids.confidence_bucket(F.coalesce("confidence", F.lit(1.0))), ids.node_file(F.col("source")) == ids.node_file(F.col("target"))
    starts = written(entries.select("entry"), "beam-entries")
    beam, ended = None, None
    by_path = Window.partitionBy("entry", "path").orderBy(F.desc("step"), "callee")
    by_entry = Window.partitionBy("entry").orderBy(F.desc("score"), F.size("path"), F.element_at("path", -1), "path")
    for d in range(depth):
        ends = starts.select(F.col("entry").alias("ref")) if beam is None else beam.select(F.element_at("path", -1).alias("ref"))
        # Columns are made of the calls that are left; made before, they would keep the choice from the reading.
        near = written(_of(calls, "source", ends).select("source", F.col("target").alias("callee"), bucket.alias("bucket"), same.alias("same")), f"beam-calls-{d}")
        refs = written(near.select(F.explode(F.array("source", "callee")).alias("ref")).distinct(), f"beam-refs-{d}")
        info = scored(nodes(refs), f"beam-nodes-{d}") if every is None else _of(every, "id", refs)
        if beam is None:
            # A path of one node is never given, so an entry that calls nothing may be left out.
            beam = starts.join(info, F.col("entry") == F.col("id")).select("entry", F.array("entry").alias("path"), (0.5 + 0.2 * F.col("topic")).alias("score"), F.array("role").alias("roles"), F.array("topic").alias("topics"))
        near = near.join(info.toDF("callee", "role", "name", "topic"), "callee").where(~F.lower("name").isin(*NOISE)).drop("name")
        last = F.element_at("roles", -1)
        step = step_score(F.col("bucket"), last, F.col("role"), F.col("topic"), F.col("same"))
        grown = beam.join(near, F.element_at("path", -1) == F.col("source"), "left").withColumn("step", F.when(F.col("callee").isNotNull(), step))
        grown = grown.withColumn("n", F.row_number().over(by_path)).where(F.col("n") <= branching)
        go = F.col("step") > 0
        go = F.coalesce(go, F.lit(False)) & ~F.coalesce(F.array_contains("path", F.col("callee")), F.lit(False))
        flagged = written(grown.withColumn("go", go).withColumn("any", F.max("go").over(Window.partitionBy("entry", "path"))), f"beam-{d}")
        stuck = flagged.where(~F.col("any") & (F.size("path") > 1)).dropDuplicates(["entry", "path"]).select("entry", "path", "score", "roles", "topics")
        new = flagged.where("go").select("entry", F.concat("path", F.array("callee")).alias("path"), (F.col("score") + F.col("step")).alias("score"), F.concat("roles", F.array("role")).alias("roles"), F.concat("topics", F.array("topic")).alias("topics"))
        sunk = new.where(roles.is_sink(F.element_at("roles", -1)) & (F.size("path") >= 3))
        done = stuck.unionByName(sunk)
        ended = done if ended is None else ended.unionByName(done)
        beam = written(new.withColumn("n", F.row_number().over(by_entry)).where(F.col("n") <= width).drop("n"), f"beam-paths-{d}")
    ended = ended.unionByName(beam.where(F.size("path") > 1)).dropDuplicates(["entry", "path"])
    ranked = ended.withColumn("score", F.col("score") + path_bonus(F.col("roles"), F.col("topics")))
    return ranked.withColumn("rank", F.row_number().over(by_entry)).where(F.col("rank") <= most).select("entry", "path", "score", "roles", "rank")


def path_confidence(buckets: Column, missing_lines: Column, role_path: Column) -> Column:
    """low, medium or high from the path's edges, and whether its layers go down somewhere."""
    ranks = F.transform(role_path, roles.layer)
    down = F.exists(F.transform(ranks, lambda x, i: F.exists(F.slice(ranks, i + 2, F.size(ranks)), lambda y: y > x)), lambda z: z)
    low = (F.size(role_path) < 2) | (missing_lines > 0) | F.exists(buckets, lambda b: b == "low")
    return F.when(low, "low").when(F.forall(buckets, lambda b: b == "high") & down, "high").otherwise("medium")


#: Distinct edges up to which components are found in one task, in time linear in them.
EDGES_OF_A_TASK = 1 << 20


def _components(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strongly connected components by two walks: nodes in the order in which they end, then backwards from the last."""
    edges = [(a, b) for f in frames for a, b in zip(f["source"], f["target"], strict=True)]
    ahead, behind = defaultdict(list), defaultdict(list)
    for a, b in edges:
        ahead[a].append(b)
        behind[b].append(a)
    seen, ended = set(), []
    for start in ahead:
        todo = [(start, iter(ahead[start]))] if start not in seen else []
        seen.add(start)
        while todo:
            node, rest = todo[-1]
            new = next((x for x in rest if x not in seen), None)
            if new is None:
                ended.append(todo.pop()[0])
            else:
                seen.add(new)
                todo.append((new, iter(ahead.get(new, ()))))
    taken, out = set(), []
    for start in reversed(ended):
        if start in taken:
            continue
        taken.add(start)
        own, todo = [start], [start]
        while todo:
            for x in behind.get(todo.pop(), ()):
                if x not in taken:
                    taken.add(x)
                    own.append(x)
                    todo.append(x)
        if len(own) > 1:
            out += [(x, min(own)) for x in own]
    yield pd.DataFrame(out, columns=["node", "root"], dtype=object)


def strong(edges: DataFrame, in_task: int = EDGES_OF_A_TASK) -> DataFrame:
    """Rows node, root (the least node) of strongly connected components of two nodes or more of edges (source, target).

    Up to ``in_task`` distinct edges, a count that is checked, are one task.
    Of more, edges from nodes that nothing leads to, or into nodes that lead
    nowhere, are on no cycle and go first.  Then each node takes the node of
    the least hash that reaches it as its colour, and what leads back to that
    node inside its colour is its component; edges between colours are on no
    cycle either.  Hashes cut long chains into parts that are done at once.
    """
    left = written(edges.where("source != target").select("source", "target").distinct(), "strong")
    if left.limit(in_task + 1).count() <= in_task:
        return written(left.coalesce(1).mapInPandas(_components, "node string, root string"), "components")
    found = None
    while True:
        live = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi")
        left = written(live.join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target"), "strong")
        if left.isEmpty():
            if found is None:
                return left.select(F.col("source").alias("node"), F.col("target").alias("root"))
            return found.select("node", F.min("node").over(Window.partitionBy("root")).alias("root"))
        nodes = left.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        colour = written(nodes.withColumn("colour", F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"))), "colour")
        while True:
            into = left.join(colour.toDF("source", "c"), "source").groupBy(F.col("target").alias("node")).agg(F.min("c").alias("c"))
            step = colour.join(into, "node", "left").select("node", F.least("colour", F.coalesce("c", "colour")).alias("colour"), (F.col("c") < F.col("colour")).alias("moved"))
            step = written(step, "colour")
            colour = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        inside = left.join(colour.toDF("source", "a"), "source").join(colour.toDF("target", "b"), "target").where("a = b").select("source", "target", F.col("a").alias("colour"))
        inside = written(inside, "inside")
        back = written(colour.where("node = colour.node"), "back")
        while True:
            more = inside.join(back.select(F.col("node").alias("target")), "target", "left_semi").select(F.col("source").alias("node"), "colour").distinct()
            more = written(more.join(back, "node", "left_anti"), "back")
            if more.isEmpty():
                break
            back = written(back.unionByName(more), "back")
        size = Window.partitionBy("colour")
        some = back.withColumn("n", F.count("*").over(size)).where("n > 1").select("node", F.col("colour.node").alias("root"))
        found = written(some if found is None else found.unionByName(some), "components")
        # What is left has both ends in one colour and outside its component.
        gone = back.select("node")
        left = inside.select("source", "target").join(gone.toDF("source"), "source", "left_anti").join(gone.toDF("target"), "target", "left_anti")


def cycles(pairs: DataFrame, longest: int = 6) -> DataFrame:
    """Simple cycles of 2 to ``longest`` nodes over distinct (source, target); each starts at its smallest node.

    Paths are followed inside strongly connected components only: one that
    can't come back isn't begun.
    """
    every = pairs.where("source != target").select("source", "target").distinct()
    roots = strong(every)
    e = every.join(roots.toDF("source", "a"), "source").join(roots.toDF("target", "b"), "target").where("a = b").select("source", "target")
    e = written(e, "cycle-edges")
    paths, found = e.where("target > source").select(F.array("source", "target").alias("path")), None
    for n in range(2, longest + 1):
        last = paths.join(e, F.element_at("path", -1) == F.col("source"))
        closed = last.where(F.col("target") == F.col("path")[0]).select("path")
        found = closed if found is None else found.unionByName(closed)
        if n < longest:
            paths = written(last.where((F.col("target") > F.col("path")[0]) & ~F.array_contains("path", F.col("target"))).select(F.concat("path", F.array("target")).alias("path")), f"cycles-{n}")
    return found.distinct()


def affected_origins(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files to resolve again: the changed ones, and those with an edge into a changed or deleted one. changed: file_path, deleted."""
    touching = edges.select(ids.ref_file(F.col("source")).alias("origin"), ids.ref_file(F.col("target")).alias("file_path"))
    into = touching.join(changed.select("file_path"), "file_path", "left_semi").select(F.col("origin").alias("file_path"))
    gone = changed.where("deleted").select("file_path")
    return into.unionByName(changed.where("not deleted").select("file_path")).distinct().join(gone, "file_path", "left_anti")


def merged(old: DataFrame, partial: DataFrame, rebuilt: DataFrame, touched: DataFrame) -> DataFrame:
    """Old edges that neither start in a rebuilt file nor end in a touched one, and the new ones."""
    source, target = ids.ref_file(F.col("source")), ids.ref_file(F.col("target"))
    kept = old.join(rebuilt.select(F.col("file_path").alias("__f")), source == F.col("__f"), "left_anti").join(touched.select(F.col("file_path").alias("__g")), target == F.col("__g"), "left_anti")
    return deduplicated(kept.unionByName(partial))
