"""Names to what they mean: files of types, methods of types, near names, owners of lines, and who waits for what.

Everything is an equal join.  A suffix of a path key is looked up by cutting
the keys to the lengths that are asked for; a near name shares one of its
rarest pairs of letters; a line is looked up in blocks of lines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..sources.tables import written

#: Lines of a block that spans and sites are matched in.
LINES = 64
#: The least ratio of near names.
NEAR = 0.82


def first_by(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


# --- files by key ----------------------------------------------------------------


def file_keys(files: DataFrame) -> DataFrame:
    """Rows target, key, pos: what a file can be imported by; its path, without ending, dotted, as a package, and its stem."""
    p = F.col("file_path")
    plain = F.regexp_replace(p, r"\.[^./]*$", "")
    package = F.regexp_replace(plain, r"/(__init__|index)$", "")
    dotted = lambda x: F.replace(x, F.lit("/"), F.lit("."))
    keys = F.array_distinct(F.array(p, plain, dotted(plain), package, dotted(package), paths.stem(p)))
    return files.select(p.alias("target"), F.posexplode(keys).alias("pos", "key"))


def suffix_hits(keys: DataFrame, types: DataFrame) -> DataFrame:
    """Rows of ``keys`` (key, target, ..) with each type (type) that the key, or the stem of its file, ends with or is."""
    # Lengths of names that are asked for: few, whatever the number of names.
    sizes = [r[0] for r in types.select(F.length("type")).distinct().collect() if r[0]]
    if not sizes:
        return keys.withColumn("type", F.lit("")).limit(0)
    size = F.explode(F.array(*map(F.lit, sorted(sizes))))
    cut = keys.withColumn("__k", size).where(F.col("__k") <= F.length("key")).withColumn("type", F.expr("right(key, __k)")).drop("__k")
    stems = keys.withColumn("type", paths.stem(F.col("target")))
    return cut.unionByName(stems).join(types.select("type").distinct(), "type").distinct()


def type_files(asked: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows file_path, type, target of asked types (file_path, type): what the file imports by that name, a file of that key, or else the first file with a key that ends with it."""
    asked = asked.select("file_path", "type").where("type != ''").distinct()
    keys = file_keys(files)
    last = keys.groupBy("key").agg(F.max("target").alias("target"), F.min(F.struct("target", "pos")).alias("place"))
    types = asked.select("type").distinct()
    exact = last.join(types.withColumnRenamed("type", "key"), "key").select(F.col("key").alias("type"), "target")
    ends = suffix_hits(last, types.join(exact, "type", "left_anti"))
    found = exact.unionByName(ends.groupBy("type").agg(F.min_by("target", "place").alias("target")))
    own = imports.select("file_path", F.col("alias").alias("type"), F.col("target").alias("imported")).where("type is not null").groupBy("file_path", "type").agg(F.max("imported").alias("imported"))
    return asked.join(own, ["file_path", "type"], "left").join(found, "type", "left").select("file_path", "type", F.coalesce("imported", "target").alias("target")).where("target is not null")


def named_types(asked: DataFrame, defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows file_path, type, ref: the class of that name in the type's file, else that file's first class; one of the asking file; or the only one of its name."""
    classes = defs.where("kind = 'class'").select(F.col("file_path").alias("t_file"), "name", "ref", "ordinal")
    at = type_files(asked, imports, files).withColumnRenamed("target", "t_file")
    in_file = first_by(at.join(classes, "t_file"), ["file_path", "type"], (F.col("name") != F.col("type")), "ordinal")
    one = in_file.select("file_path", "type", "ref", F.lit(0).alias("turn"))
    asked = asked.select("file_path", "type").distinct()
    named = asked.join(classes.withColumnRenamed("name", "type"), "type")
    two = first_by(named.where("t_file = file_path"), ["file_path", "type"], "ordinal").select("file_path", "type", "ref", F.lit(1).alias("turn"))
    lone = classes.groupBy(F.col("name").alias("type")).agg(F.count("*").alias("same"), F.first("ref").alias("ref")).where("same = 1")
    three = asked.join(lone, "type").select("file_path", "type", "ref", F.lit(2).alias("turn"))
    return first_by(one.unionByName(two).unionByName(three), ["file_path", "type"], "turn").select("file_path", "type", "ref")


def methods_on_types(sites: DataFrame, defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows file_path, pos, ref of sites (file_path, pos, callee, type): the method in the file of the type's implementation, or else of the type; one of a class of such a name first."""
    wide = sites.select("file_path", "pos", "callee", F.posexplode(F.array(F.concat("type", F.lit("Impl")), F.col("type"))).alias("way", "type"))
    at = wide.join(type_files(wide, imports, files), ["file_path", "type"])
    methods = defs.where("kind = 'method'").select(F.col("file_path").alias("target"), F.col("name").alias("callee"), "parent_name", "ordinal", "ref")
    hit = at.join(methods, ["target", "callee"])
    plain = F.regexp_replace("type", "Impl$", "")
    liked = F.coalesce(F.col("parent_name").isin(F.col("type")) | (F.col("parent_name") == F.concat("type", F.lit("Impl"))) | (F.col("parent_name") == plain), F.lit(False))
    return first_by(hit, ["file_path", "pos"], "way", ~liked, "ordinal").select("file_path", "pos", "ref")


# --- near names --------------------------------------------------------------------


def _numbered(items: Column) -> Column:
    """Items, each with which of its equals it is, so that sets count repeats."""
    return F.transform(items, lambda x, i: F.concat(x, F.size(F.filter(F.slice(items, 1, i + 1), lambda y: y == x)).cast("string")))


def near_candidates(names: DataFrame, known: DataFrame, least: float = NEAR) -> DataFrame:
    """Rows name, match: all pairs of different names whose longest-blocks ratio may reach ``least``, and few others.

    Blocks of m letters in common leave d = |a| + |b| - 2m insertions and
    deletions, and the ratio 2m / (|a| + |b|) bounds d.  Each of them spoils
    one and a half letter pairs on average, so two near names share
    (|a| + |b|) / 2 - 1 - 1.5 d pairs at least; so also one of the rarest of
    each.  Then they share that many, and m letters.
    """
    if not 0.8 < least < 1:
        raise ValueError("the least ratio must be between 0.8 and 1")
    lo, off = least / (2 - least), 1 - least

    def made(df: DataFrame) -> DataFrame:
        df = df.select("name", F.length("name").alias("n")).where("n > 1").distinct()
        return df.select("name", "n", _numbered(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.substring("name", i, F.lit(2)))).alias("pairs"), _numbered(F.split("name", "")).alias("letters"))

    def rare(df: DataFrame, freq: DataFrame) -> DataFrame:
        least_n = F.col("n") + F.ceil(F.col("n") * lo)
        need = F.greatest(F.lit(1), F.ceil((0.5 - 1.5 * off) * least_n - 1 - 1e-9))
        turn = F.row_number().over(Window.partitionBy("name").orderBy("often", "pair"))
        each = df.select("name", "n", need.alias("need"), F.explode("pairs").alias("pair")).join(freq, "pair")
        return each.withColumn("turn", turn).where(F.col("turn") <= F.col("n") - 1 - F.col("need") + 1).select("name", "n", "pair")

    asked, have = written(made(names), "names"), written(made(known), "known")
    freq = asked.unionByName(have).select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("often"))
    a, b = rare(asked, freq), rare(have, freq).select(F.col("name").alias("match"), F.col("n").alias("m"), "pair")
    total = F.col("n") + F.col("m")
    # The most insertions and deletions, which are even if the total is.
    most = F.floor(off * total + 1e-9)
    most = most - (most + total) % 2
    met = a.join(b, "pair").where((F.col("name") != F.col("match")) & (most >= F.abs(F.col("n") - F.col("m")))).select("name", "match").distinct()
    both = met.join(asked, "name").join(have.select(F.col("name").alias("match"), F.col("n").alias("m"), F.col("pairs").alias("pairs2"), F.col("letters").alias("letters2")), "match")
    shared = F.size(F.array_intersect("pairs", "pairs2")) >= total / 2 - 1 - 1.5 * most
    letters = 2 * F.size(F.array_intersect("letters", "letters2")) >= least * total - 1e-9
    return both.where(shared & letters).select("name", "match")


def near_names(names: DataFrame, known: DataFrame, least: float = NEAR) -> DataFrame:
    """Rows name, match, ratio of all pairs of different names with that ratio at least."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])

    return near_candidates(names, known, least).withColumn("ratio", ratio("name", "match")).where(F.col("ratio") >= least)


# --- lines ---------------------------------------------------------------------------


def innermost(sites: DataFrame, spans: DataFrame, keep: str = "ref") -> DataFrame:
    """Sites (file_path, line, ..) with ``keep`` of the shortest span (file_path, start_line, end_line, ``keep``) around the line, the later one of equal ones; null if there is none.

    A span is in each block of lines that it has a line in, so a site meets
    only spans of its own block.
    """
    block = lambda c: F.floor(F.col(c) / LINES)
    s = spans.where("start_line <= end_line").select("file_path", "start_line", "end_line", F.col(keep).alias("__keep"), F.explode(F.sequence(block("start_line"), block("end_line"))).alias("__block"))
    own = sites.withColumn("__site", F.monotonically_increasing_id()).withColumn("__block", block("line"))
    own = written(own, "sites")
    hit = own.select("__site", "file_path", "line", "__block").join(s, ["file_path", "__block"]).where("line between start_line and end_line")
    best = hit.groupBy("__site").agg(F.min_by("__keep", F.struct((F.col("end_line") - F.col("start_line")).alias("size"), (-F.col("start_line")).alias("later"), F.col("__keep"))).alias(keep))
    return own.join(best, "__site", "left").drop("__site", "__block")


# --- who waits for what ---------------------------------------------------------------


def asked(parsed_files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows file_path, kind, key: what a file's edges depend on.

    ``path``: keys it may import by (file_path, key of ``candidates``); ``name``:
    names that it calls, imports or extends; ``type``: names of types whose
    file it looks for.
    """
    f = "file_path"
    sites = parsed_files.select(f, F.explode("calls").alias("c")).select(f, "c.callee", "c.receiver")
    fields = parsed_files.select(f, F.explode("fields").alias("x")).select(f, F.col("x.type").alias("key"))
    imports = parsed_files.select(f, F.explode("imports").alias("i")).select(f, F.explode(F.array("i.name", "i.alias")).alias("key"))
    bases = parsed_files.select(f, F.explode("definitions").alias("d")).select(f, F.explode("d.bases").alias("b")).select(f, F.col("b.name").alias("key"))
    types = bases.unionByName(fields).unionByName(sites.select(f, F.col("receiver").alias("key"))).where("key is not null and key != ''")
    types = types.select(f, F.explode(F.array("key", F.concat("key", F.lit("Impl")))).alias("key"))
    names = sites.select(f, F.col("callee").alias("key")).unionByName(imports).unionByName(bases)
    kinds = [("path", candidates.select(f, "key")), ("name", names), ("type", types)]
    out = None
    for kind, df in kinds:
        df = df.select(f, F.lit(kind).alias("kind"), "key")
        out = df if out is None else out.unionByName(df)
    return out.where("key is not null").distinct()


def waiting(asks: DataFrame, changed: DataFrame, defs: DataFrame, known: DataFrame, parsed_files: DataFrame) -> DataFrame:
    """Files (file_path) whose edges may differ once ``changed`` files (file_path) were added, changed or deleted.

    asks: of all files, see :func:`asked`; defs: definitions of the changed
    files, as they were and as they are; known: all definitions now.  A file
    waits for a path key or name of a changed file, for a type that one of its
    keys ends with, or has called a name that nobody defines and that is near
    to a changed one.
    """
    keys = file_keys(changed)
    names = defs.select(F.col("name").alias("key")).distinct()
    by_path = asks.where("kind = 'path'").join(keys.select("key").distinct(), "key", "left_semi")
    by_name = asks.where("kind = 'name'").join(names, "key", "left_semi")
    types = asks.where("kind = 'type'").select("file_path", F.col("key").alias("type"))
    by_type = types.join(suffix_hits(keys, types).select("type").distinct(), "type", "left_semi")
    called = parsed_files.select("file_path", F.explode("calls").alias("c")).where("c.receiver is null").select("file_path", F.col("c.callee").alias("name"))
    open_ = called.join(known.select("name").distinct(), "name", "left_anti")
    near = near_names(open_.select("name").distinct(), names.withColumnRenamed("key", "name")).select("name").distinct()
    by_near = open_.join(near, "name", "left_semi")
    one = lambda df: df.select("file_path")
    return one(by_path).unionByName(one(by_name)).unionByName(one(by_type)).unionByName(one(by_near)).unionByName(one(changed)).distinct()


# --- the older order of call resolution ------------------------------------------------


def older_calls(parsed_files: DataFrame, defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Rows source, target, line by the order without scores.

    A function or class of the same file, even behind a receiver; a method of
    the same file without one; the method of the receiver's type; the imported
    name, which also ends the search; the only definition of that name in
    another file.  Of equal names in a file the last one counts, but the first
    one of an imported file.
    """
    key = ["file_path", "pos"]
    sites = parsed_files.select("file_path", F.posexplode("calls").alias("pos", "c")).select(*key, "c.*").where("caller is not null")
    fields = parsed_files.select("file_path", F.explode("fields").alias("f")).select("file_path", F.col("f.name").alias("receiver"), F.col("f.type").alias("type")).dropDuplicates(["file_path", "receiver"])
    sites = sites.join(fields, ["file_path", "receiver"], "left").withColumn("type", F.coalesce("type", "receiver"))
    free, methods = defs.where("kind != 'method'"), defs.where("kind = 'method'")
    last = lambda df: first_by(df, ["file_path", "name"], F.desc("ordinal")).select("file_path", F.col("name").alias("callee"), "ref")
    tier = lambda df, turn: df.select(*key, F.col("ref").alias("target"), F.lit(turn).alias("turn"))
    one = tier(sites.join(last(free), ["file_path", "callee"]), 1)
    two = tier(sites.where("receiver is null").join(last(methods), ["file_path", "callee"]), 2)
    three = tier(methods_on_types(sites.where("type is not null"), defs, imports, files), 3)
    own = first_by(imports.where("alias is not null"), ["file_path", "alias"], F.desc("line")).select("file_path", F.col("alias").alias("callee"), F.col("target").alias("t_file"), F.coalesce("name", "alias").alias("t_name"))
    firsts = first_by(free, ["file_path", "name"], "ordinal").select(F.col("file_path").alias("t_file"), F.col("name").alias("t_name"), "ref")
    four = tier(sites.join(own, ["file_path", "callee"]).join(firsts, ["t_file", "t_name"], "left"), 4)
    lone = free.groupBy(F.col("name").alias("callee")).agg(F.count("*").alias("same"), F.first("file_path").alias("c_file"), F.first("ref").alias("ref")).where("same = 1")
    five = tier(sites.join(lone, "callee").where("c_file != file_path"), 5)
    every = one.unionByName(two).unionByName(three).unionByName(four).unionByName(five)
    chosen = first_by(every, key, "turn").where("target is not null")
    out = chosen.join(sites.select(*key, "caller", "line"), key).select(F.concat("file_path", F.lit("::"), "caller").alias("source"), "target", "line")
    return out.groupBy("source", "target").agg(F.min("line").alias("line"))
