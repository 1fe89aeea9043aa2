"""Mixing sources to target weights by min-cost flow.

Documents with the same set of sources form a pattern; only patterns, not
documents, enter the flow.  A pattern's words may be used up to ``max_repeats``
times, each further use at a higher cost (convex), so the cheapest flow that
fills the sources' quotas repeats nothing before everything was used.  The
flow gives the words taken of each pattern; whole rounds of its documents are
taken, and the rest are documents in seeded order, cut where the rest is
reached.

Nulls: a null text has 0 words; a null source is a source of its own, last in
order.  Repeated rows count each.  With no words at all, all targets are 0.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Sources and patterns are names in a catalogue, not data; more than these are refused, not cut.
MAX_PATTERNS = 100_000


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def by_code_point(source: str | None) -> tuple[bool, bytes]:
    return source is None, (source or "").encode("utf-8", "surrogatepass")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> dict[str | None, Fraction]:
    """Shares of all words by weight; none above max_repeats times its source's size, the excess shared again by weight."""
    order = sorted(sizes, key=by_code_point)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = Fraction(sum(sizes.values())), {}, set(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > max_repeats * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in free}
        for s in full:
            out[s] = Fraction(max_repeats * sizes[s])
            left -= out[s]
            free.remove(s)
    return out


def flow(supply: dict[frozenset, int], quota: dict[str | None, int], max_repeats: int = MAX_REPEATS) -> dict[tuple[frozenset, str | None], int]:
    """Words routed from patterns to sources: successive shortest paths with potentials.

    Edges: start to a pattern, once for each use (capacity its words, cost 0,
    1, 2, ...); a pattern to its sources; a source to the end (its quota).
    """
    names: dict[object, int] = {"start": 0, "end": 1}
    graph: list[list[list]] = [[], []]

    def node(x: object) -> int:
        if x not in names:
            names[x] = len(graph)
            graph.append([])
        return names[x]

    def edge(u: int, v: int, capacity: int, cost: int) -> list:
        e, back = [v, capacity, cost, None], [u, 0, -cost, None]
        e[3], back[3] = back, e
        graph[u].append(e)
        graph[v].append(back)
        return e

    routed: dict[tuple[frozenset, str | None], list] = {}
    for p, words in sorted(supply.items(), key=lambda x: sorted(map(by_code_point, x[0]))):
        for use in range(max_repeats):
            edge(0, node(("pattern", p)), words, use)
        for s in sorted(p, key=by_code_point):
            routed[p, s] = edge(node(("pattern", p)), node(("source", s)), max_repeats * words, 0)
    for s in sorted(quota, key=by_code_point):
        edge(node(("source", s)), 1, quota[s], 0)
    height = [0] * len(graph)
    while True:
        far, via = [None] * len(graph), [None] * len(graph)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > far[u]:
                continue
            for e in graph[u]:
                if e[1] > 0:
                    nd = d + e[2] + height[u] - height[e[0]]
                    if far[e[0]] is None or nd < far[e[0]]:
                        far[e[0]], via[e[0]] = nd, e
                        heapq.heappush(queue, (nd, e[0]))
        if far[1] is None:
            return {k: e[3][1] for k, e in routed.items() if e[3][1]}
        reached = max(x for x in far if x is not None)
        height = [h + (reached if f is None else f) for h, f in zip(height, far, strict=True)]
        path, v = [], 1
        while v:
            path.append(via[v])
            v = via[v][3][0]
        amount = min(e[1] for e in path)
        for e in path:
            e[1] -= amount
            e[3][1] += amount


def plan(patterns: list[tuple[tuple[str | None, ...], int]], weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> tuple[dict[str | None, int], dict[str | None, Fraction], dict[tuple, int]]:
    """Of patterns and their words: words by source, target by source, words to take by pattern.

    A source's size counts all documents that are in it; quotas share the words there are.
    """
    supply: dict[frozenset, int] = {}
    for p, words in patterns:
        supply[frozenset(p)] = supply.get(frozenset(p), 0) + words
    sizes: dict[str | None, int] = {}
    for p, words in supply.items():
        for s in p:
            sizes[s] = sizes.get(s, 0) + words
    goal = targets(sizes, weights, max_repeats)
    routed = flow(supply, {s: round(t) for s, t in goal.items()}, max_repeats)
    take: dict[frozenset, int] = {}
    for (p, _), words in routed.items():
        take[p] = take.get(p, 0) + words
    return sizes, goal, {tuple(p): take.get(frozenset(p), 0) for p, _ in patterns}


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = 17, buckets: int = 1 << 14, doc_id: str = "doc_id", text: str = "text", source: str = "source", keep_text: bool = False) -> DataFrame:
    """Rows doc_id, size, source, source_size, target, taken for each document; ``source`` may be an array of sources.

    The words of a pattern are first summed by seeded bucket.  Only the bucket
    in which a pattern's rest is reached is ordered document by document.
    """
    spark = docs.sparkSession
    many = isinstance(docs.schema[source].dataType, T.ArrayType)
    sources = F.coalesce(F.array_sort(F.array_distinct(F.col(source))), F.array(F.lit(None).cast("string"))) if many else F.array(F.col(source).cast("string"))
    key = F.concat_ws("\x1f", F.transform(sources, lambda x: F.coalesce(F.concat(F.lit("="), x), F.lit("-"))))
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        n_words(F.col(text)).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).alias("__order"),
        sources.alias("__sources"),
        key.alias("__pattern"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep_text else []),
    ).withColumn("__bucket", F.pmod(F.col("__order"), F.lit(buckets)))
    if not keep_text:  # sizes and keys only: a few bytes a document, written once, so no text is read again
        sized, _ = materialize(sized, "mix-sizes")
    sums, _ = materialize(sized.groupBy("__pattern", "__bucket").agg(F.first("__sources").alias("sources"), F.sum("size").alias("words")), "mix-sums")
    rows = sums.groupBy("__pattern").agg(F.first("sources").alias("sources"), F.sum("words").alias("words")).orderBy("__pattern").take(MAX_PATTERNS + 1)
    if len(rows) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} patterns of sources")
    sizes, goal, take = plan([(tuple(r["sources"]), r["words"]) for r in rows], weights, max_repeats)
    chosen = []
    for r in rows:
        p = tuple(r["sources"])
        rounds, rest = divmod(take[p], r["words"]) if r["words"] else (0, 0)
        main = min(p, key=by_code_point)
        chosen.append((r["__pattern"], rounds, rest, sizes[main], float(goal[main])))
    plans = spark.createDataFrame(chosen, "__pattern string, rounds long, rest long, source_size long, target double")
    before = Window.partitionBy("__pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        sums.join(F.broadcast(plans.select("__pattern", "rest")), "__pattern")
        .withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
        .where("before <= rest and before + words > rest")
        .select("__pattern", F.col("__bucket").alias("cut"), F.col("rest") - F.col("before"))
        .toDF("__pattern", "cut", "rest_in_cut")
    )
    planned = sized.join(F.broadcast(plans), "__pattern").join(F.broadcast(cut), "__pattern", "left")
    within = Window.partitionBy("__pattern", "__cut").orderBy("__order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    is_cut = F.coalesce(F.col("__bucket") == F.col("cut"), F.lit(False))
    whole = F.when(F.coalesce(F.col("__bucket") < F.col("cut"), F.lit(True)) & (F.col("rest") > 0), F.col("size")).otherwise(F.lit(0))
    # The documents of a cut bucket are a 1/buckets share of a pattern; the others never enter the window.
    ordered = planned.where(is_cut).withColumn("__cut", F.col("cut"))
    ordered = ordered.withColumn("__left", F.col("rest_in_cut") - F.coalesce(F.sum("size").over(within), F.lit(0)))
    in_cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__left")))
    names = ["doc_id", "size", F.col("__sources")[0].alias("source"), "source_size", "target"]
    tail = ["__row"] if keep_text else []
    one = planned.where(~is_cut).select(*names, (F.col("rounds") * F.col("size") + whole).cast("long").alias("taken"), *tail)
    two = ordered.select(*names, (F.col("rounds") * F.col("size") + in_cut).cast("long").alias("taken"), *tail)
    return one.unionByName(two)


def taken_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix takes them: whole rows as often as they are taken whole, and once more, cut after the words that are left, where a part is."""
    out = mix(docs, doc_id=doc_id, text=text, source=source, keep_text=True, **options).where("taken > 0")
    whole = (F.col("taken") / F.col("size")).cast("int")
    part = F.col("taken") - whole * F.col("size")
    copies = F.concat(F.array_repeat(F.lit(-1).cast("long"), whole), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<long>")))
    each = out.withColumn("__words", F.explode(copies))
    words = F.regexp_extract_all("__text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    cut = F.array_join(F.slice(words, 1, F.greatest(F.col("__words"), F.lit(0)).cast("int")), "")
    columns = [F.col(f"__row.`{c}`").alias(c) if c != text else F.when(F.col("__words") < 0, F.col("__text")).otherwise(cut).alias(c) for c in docs.columns]
    return each.withColumn("__text", F.col(f"__row.`{text}`")).select(*columns)
