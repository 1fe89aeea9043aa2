"""What to search for, by how often a question was tried: columns, so that a whole table of questions is one scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import texts

# Fixed value: what any tree has something about.
ANYWHERE = "readme overview module class function main entry"
PLACE = r":[0-9]+-[0-9]+$"

CANDIDATES = "array<struct<strategy:string,query:string>>"


def hint_terms(hints: Column) -> tuple[Column, Column]:
    """Names and paths in hints.

    A hint is a place (``path:1-9``), which gives its path and the file's name
    without suffixes; ``symbol:`` or ``search:`` with what follows; or a text,
    which gives three names.
    """
    own = F.filter(F.transform(F.coalesce(hints, F.array().cast("array<string>")), texts.stripped), lambda h: h != "")
    path = lambda h: F.regexp_replace(h, PLACE, "")
    stem = lambda h: F.substring_index(F.substring_index(F.replace(path(h), F.lit("\\"), F.lit("/")), "/", -1), ".", 1)

    def terms(h: Column) -> Column:
        at = F.filter(F.array(stem(h)), lambda x: x != "")
        named = h.startswith("symbol:") | h.startswith("search:")
        return F.when(h.rlike(PLACE), at).when(named, F.array(texts.stripped(F.substring(h, 8, 1 << 30)))).otherwise(texts.names(h, 3))

    return F.flatten(F.transform(own, terms)), F.transform(F.filter(own, lambda h: h.rlike(PLACE)), path)


def plan_parts(plan: Column) -> Column:
    """Of each step (query, keywords) its query and three keywords, short; eight distinct ones."""
    step = lambda s: F.concat(F.array(texts.clipped(s["query"], 64)), F.transform(F.slice(s["keywords"], 1, 3), lambda k: texts.clipped(k, 40)))
    return F.slice(F.array_distinct(F.filter(F.flatten(F.transform(plan, step)), lambda p: p != "")), 1, 8)


def plan_keywords(plan: Column) -> Column:
    """Of each step three keywords and four names of its query; twelve distinct ones."""
    step = lambda s: F.concat(F.slice(s["keywords"], 1, 3), texts.names(s["query"], 4))
    return F.slice(F.array_distinct(F.flatten(F.transform(plan, step))), 1, 12)


def candidates(question: Column, plan: Column, hints: Column, retries: Column) -> Column:
    """Distinct (strategy, query), the best first.

    ``plan`` is an array of (query, keywords).  The first try has the plan in
    it, the second the hints, later ones only what is broad.  Nulls count as
    empty; a question alone is a candidate where nothing else is.
    """
    base = texts.stripped(F.coalesce(question, F.lit("")))
    plan = F.coalesce(plan, F.array().cast("array<struct<query:string,keywords:array<string>>>"))
    named, paths = hint_terms(hints)
    at = F.coalesce(retries, F.lit(0))

    def made(hint: Column, words: Column) -> Column:
        start = lambda n: F.array(F.substring(base, 1, n))
        few = lambda n: F.slice(words, 1, n)
        tries = [
            [("plan_compact", start(80), F.slice(plan_parts(plan), 1, 4), hint), ("plan_keywords", start(60), few(8), hint), ("question", start(100), hint)],
            [("retry_hints", start(60), hint, few(6)), ("keywords_only", few(10), hint), ("question", start(80), hint)],
            [("retry_broad", start(50), hint), ("question_short", start(50), hint), ("explore_seed", F.array(F.lit(ANYWHERE)), hint)],
        ]
        first, second, later = (F.array(*[F.struct(F.lit(name).alias("strategy"), texts.joined_query(F.concat(*parts)).alias("query")) for name, *parts in t]) for t in tries)
        return F.when(at <= 0, first).when(at == 1, second).otherwise(later)

    own = texts.once(F.array(texts.joined_query(F.concat(named, paths), 120)), lambda hint: texts.once(plan_keywords(plan), lambda words: made(hint, words)))
    distinct = texts.once(own, lambda every: F.filter(every, lambda c, i: (c["query"] != "") & ~F.exists(F.slice(every, 1, i), lambda x: x["query"] == c["query"])))
    alone = F.filter(F.array(F.struct(F.lit("question").alias("strategy"), F.substring(base, 1, 100).alias("query"))), lambda c: c["query"] != "")
    return texts.once(distinct, lambda found: F.when(F.size(found) > 0, found).otherwise(alone)).cast(CANDIDATES)
