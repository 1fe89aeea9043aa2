"""What to read first: seeds of a question, entry points, core files and their beginnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, paths

# How files, classes and functions that programs start in are called.
START_FILES = ("main.py", "app.py", "application.py", "manage.py", "main.go", "main.ts", "main.js", "index.ts", "index.js")
START_CLASS = r"(Application|App|Main|Bootstrap)$"
START_FUNCTIONS = ("main", "create_app", "app")
ENTRY_POINTS, SNIPPET = 20, 800
FILE_LINES, FILE_CHARS = 150, 6000
#: All that ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def seeds(hits: DataFrame, limit: int = 8) -> DataFrame:
    """Of each query, hits once a symbol (or file, without one), best first: query_id, ref, score, citation, snippet, place.

    hits: query_id, rank, score, file_path, symbol_name, start_line, end_line,
    language, kind, content.  The first hit of a symbol counts; the source's
    quality weighs its score once more, and equal scores keep the order of the
    hits.  Null contents give empty snippets.
    """
    ref = F.when(F.coalesce("symbol_name", F.lit("")) != "", F.concat("file_path", F.lit("::"), "symbol_name")).otherwise(F.col("file_path"))
    one = hits.withColumn("ref", ref).withColumn("n", F.row_number().over(Window.partitionBy("query_id", "ref").orderBy("rank"))).where("n = 1")
    one = one.withColumn("score", F.col("score") * paths.quality(F.col("file_path"), F.col("language"), F.col("kind")))
    one = one.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rank"))).where(F.col("place") <= limit)
    return one.select(
        "query_id", "ref", "score", ids.citation(F.col("file_path"), F.col("start_line"), F.col("end_line")).alias("citation"),
        F.substring(F.coalesce("content", F.lit("")), 1, SNIPPET).alias("snippet"), "place",
    )


def with_call_lines(blast: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds ``citation`` and ``strategy`` of the call that led to a caller or callee of a blast radius; null for relatives and calls without a line.

    blast: seed, ref, relation, hops; edges have line, ordinal and strategy.
    Of several calls, the one from the least ref reached a hop before counts,
    and its first line.
    """
    reached = blast.where(~F.col("relation").isin("extends", "implements")).select("seed", F.col("ref").alias("via"), "hops")
    starts = blast.select("seed", F.col("seed").alias("via"), F.lit(0).alias("hops")).distinct()
    near = reached.unionByName(starts).withColumn("last", F.max("hops").over(Window.partitionBy("seed"))).groupBy("seed", "via", "last").agg(F.min("hops").alias("at")).where("at < last").drop("last")
    lines = edges.where("edge_type = 'call' and line is not null").groupBy("source", "target").agg(F.min_by(F.struct("line", "strategy"), "ordinal").alias("call"))
    called = lines.select(F.col("source").alias("ref"), F.col("target").alias("via"), F.lit("caller").alias("relation"), F.col("source").alias("of"), "call")
    calls = lines.select(F.col("target").alias("ref"), F.col("source").alias("via"), F.lit("callee").alias("relation"), F.col("source").alias("of"), "call")
    # From what was reached, as the radius itself grew: no more rows than its hops had.
    led = near.join(called.unionByName(calls), "via").join(blast, ["seed", "ref", "relation"]).where("at < hops")
    first = led.groupBy("seed", "ref", "relation").agg(F.min_by(F.struct("of", "call"), F.struct("at", "via")).alias("c"))
    cited = first.select("seed", "ref", "relation", ids.citation(ids.ref_file(F.col("c.of")), F.col("c.call.line"), F.col("c.call.line")).alias("citation"), F.col("c.call.strategy").alias("strategy"))
    return blast.join(cited, ["seed", "ref", "relation"], "left")


def entry_points(nodes: DataFrame, limit: int = ENTRY_POINTS) -> DataFrame:
    """Files, classes and functions that programs start in: entry, file_path, place, the first ``limit`` by kind and id.

    A node is named by its file if the file's name says it, and by itself if
    its own name does; each entry counts once.
    """
    path = ids.posix(F.col("file_path"))
    by_file = F.when(F.lower(paths.base_name(path)).isin(*START_FILES), path)
    own = ((F.col("kind") == "class") & F.col("name").rlike(START_CLASS)) | ((F.col("kind") == "function") & F.col("name").isin(*START_FUNCTIONS))
    named = F.array_compact(F.array(by_file, F.when(own, F.col("qualified_name"))))
    each = nodes.where("file_path is not null").select("kind", "id", path.alias("file_path"), F.posexplode(named).alias("turn", "entry"))
    once = each.groupBy("entry").agg(F.min(F.struct("kind", "id", "turn", "file_path")).alias("at"))
    few = once.orderBy("at").limit(limit)
    return few.select("entry", "at.file_path", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at")).alias("place"))


def excerpts(files: DataFrame, lines: int = FILE_LINES, chars: int = FILE_CHARS) -> DataFrame:
    """Adds ``excerpt``, the first lines of content up to both limits, and ``cut``, whether there is more. Null is empty."""
    text = F.coalesce("content", F.lit(""))
    # A line's end at the end of the text begins no line.
    split = F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END, -1)
    head = F.substring(F.array_join(F.slice(split, 1, lines), "\n"), 1, chars)
    return files.withColumn("excerpt", head).withColumn("cut", (F.size(split) > lines) | (F.length(text) > chars))


def core_files(entries: DataFrame, modules: DataFrame, files: DataFrame, limit: int = 5) -> DataFrame:
    """Files of entry points, then the first file of each module by falling coupling: file_path, reason, excerpt, cut, place.

    entries: file_path, place; modules: module, coupling; files: file_path,
    module, content.  Each file counts once; empty ones are left out at the end.
    """
    heads = files.groupBy("module").agg(F.min("file_path").alias("file_path")).join(modules, "module")
    by_entry = entries.select("file_path", F.lit(0).alias("turn"), F.col("place").cast("double").alias("at"), F.lit("").alias("name"), F.lit("entrypoint").alias("reason"))
    by_module = heads.select("file_path", F.lit(1).alias("turn"), (-F.col("coupling")).cast("double").alias("at"), F.col("module").alias("name"), F.lit("high_coupling_module").alias("reason"))
    first = by_entry.unionByName(by_module).groupBy("file_path").agg(F.min(F.struct("turn", "at", "name", "reason")).alias("of"))
    few = first.orderBy("of", "file_path").limit(limit).withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("of", "file_path")))
    shown = excerpts(files.join(F.broadcast(few), "file_path"))
    return shown.where("excerpt != ''").select("file_path", "of.reason", "excerpt", "cut", "place")
