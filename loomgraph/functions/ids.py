"""Identities: references, node and edge ids, hashes, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILE, SYMBOL = "file:", "sym:"
UNIT = "\x1f"


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def repo_id(source: Column) -> Column:
    """16 hex digits of the source's normal form: no trailing slash or .git."""
    plain = F.regexp_replace(posix(F.trim(source)), r"/+$", "")
    return F.substring(F.sha2(F.regexp_replace(plain, r"\.git$", ""), 256), 1, 16)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def chunk_id(path: Column, start: Column, end: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", path, start.cast("string"), end.cast("string"), F.coalesce(name, F.lit(""))), 256), 1, 16)


def row_hash(*cols: Column) -> Column:
    """Of a row's values, nulls as empty; only equality means something."""
    return F.sha2(F.concat_ws(UNIT, *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)


def point_id(chunk: Column) -> Column:
    """MD5 of a chunk id, in the form of a UUID."""
    return F.regexp_replace(F.md5(chunk), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def file_node(path: Column) -> Column:
    return F.concat(F.lit(FILE), posix(path))


def symbol_node(ref: Column) -> Column:
    r = posix(ref)
    return F.when(r.startswith(SYMBOL) | r.startswith(FILE), r).otherwise(F.concat(F.lit(SYMBOL), r))


def node_ref(node: Column) -> Column:
    return F.when(node.startswith(SYMBOL), F.substr(node, F.lit(len(SYMBOL) + 1)))


def node_file(node: Column) -> Column:
    ref = node_ref(node)
    return F.when(node.startswith(FILE), F.substr(node, F.lit(len(FILE) + 1))).when(F.contains(ref, F.lit("::")), F.substring_index(ref, "::", 1))


def ref_file(ref: Column) -> Column:
    return F.substring_index(ref, "::", 1)


def ref_symbol(ref: Column) -> Column:
    """What follows the first ``::``, or nothing."""
    return F.substr(ref, F.length(ref_file(ref)) + 3)


def ref_short(ref: Column) -> Column:
    """The last name: a method without its class."""
    return F.substring_index(ref_symbol(ref), ".", -1)


def make_ref(path: Column, name: Column, parent: Column) -> Column:
    return F.concat(path, F.lit("::"), F.when(parent.isNotNull(), F.concat(parent, F.lit("."))).otherwise(F.lit("")), name)


def edge_id(kind: Column, source: Column, target: Column) -> Column:
    return F.concat(kind, F.lit(":"), source, F.lit("->"), target)


CITATION = r"^(.+):(\d+)-(\d+)$"


def citation(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def is_citation(text: Column) -> Column:
    return text.rlike(CITATION)


def parse_citation(text: Column) -> Column:
    part = lambda i: F.regexp_extract(text, CITATION, i)
    return F.when(is_citation(text), F.struct(part(1).alias("file_path"), part(2).cast("int").alias("start_line"), part(3).cast("int").alias("end_line")))


def confidence_bucket(score: Column) -> Column:
    return F.when(score >= 0.85, "high").when(score >= 0.55, "medium").otherwise("low")


def pattern_confidence(score: Column) -> Column:
    return F.when(score >= 0.75, "high").when(score >= 0.45, "medium").otherwise("low")


def collection_name(repo: Column) -> Column:
    return F.regexp_replace(repo, r"[^\w-]", "_")
