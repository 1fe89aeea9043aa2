"""Source files: reading trees, and what stands in a file.

Parsing is the one step that isn't relational; it runs once a changed file, in
Arrow batches, and gives one row with arrays.  Everything after it is joins.
Python is read by its own grammar; Java, JavaScript and TypeScript by patterns
and braces, after comments and strings were blanked out.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import ids, paths
from . import resolution

EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".idea", ".mypy_cache", ".pytest_cache")
CHUNK_LINES = 80
IGNORED_BASES = {"object", "Object", "Any", "Protocol"}

DEFINITION = "array<struct<name:string,kind:string,start_line:int,end_line:int,parent_name:string,bases:array<struct<name:string,relation:string>>,ordinal:int>>"
CALL = "array<struct<caller:string,callee:string,receiver:string,line:int>>"
IMPORT = "array<struct<module:string,name:string,alias:string,line:int,level:int>>"
FIELD = "array<struct<name:string,type:string>>"


#: Of files that Spark's readers hide, all together.
MAX_HIDDEN_BYTES = 64 << 20


def _hidden(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """Spark's file readers skip files and folders whose name begins with an underscore or a full stop; source files there (``__init__.py``, ``__tests__/a.js``) are read by the driver, through the file system that holds the folder."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.getFileStatus(root).getPath().toString().rstrip("/") + "/"
    found, size, listed = [], 0, fs.listFiles(root, True)
    while listed.hasNext():
        status = listed.next()
        rel = status.getPath().toString().removeprefix(base)
        parts = rel.split("/")
        if not any(x.startswith(("_", ".")) for x in parts) or not rel.lower().endswith(tuple(paths.LANGUAGES)) or set(parts) & set(EXCLUDED):
            continue
        size += status.getLen()
        if size > MAX_HIDDEN_BYTES:
            raise ValueError(f"files that begin with _ hold more than {MAX_HIDDEN_BYTES} bytes")
        stream = fs.open(status.getPath())
        found.append((rel, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")))
        stream.close()
    return found


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Rows file_path (relative), content, content_hash, language of all source files under a folder."""
    # Only files of the known suffixes are opened.
    suffixes = ",".join("".join(f"[{c}{c.upper()}]" for c in x[1:]) for x in paths.LANGUAGES)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{suffixes}}}").load(folder)
    root = re.escape(folder.rstrip("/").removeprefix("file://"))
    rel = F.regexp_replace(F.col("path"), rf"^[a-z]+:/*{root}/|^[a-z]+://{root}/|^file:{root}/", "")
    seen = raw.select(rel.alias("file_path"), F.decode("content", "UTF-8").alias("content"))
    both = seen.unionByName(spark.createDataFrame(_hidden(spark, folder), "file_path string, content string"))
    out = both.withColumn("content_hash", ids.content_hash(F.col("content")))
    parts = F.split("file_path", "/")
    return out.where(~F.arrays_overlap(parts, F.array(*map(F.lit, EXCLUDED)))).withColumn("language", paths.language(F.col("file_path"))).where("language is not null")


# --- one file ------------------------------------------------------------------


def _python(content: str) -> dict[str, list]:
    out: dict[str, list] = {"definitions": [], "calls": [], "imports": [], "fields": []}
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError):
        return out

    def base(x: ast.expr) -> str | None:
        if isinstance(x, ast.Subscript):
            x = x.value
        return x.id if isinstance(x, ast.Name) else x.attr if isinstance(x, ast.Attribute) else None

    def visit(node: ast.AST, cls: str | None, owner: str | None) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef):
                bases = [{"name": b, "relation": "extends"} for b in map(base, child.bases) if b and b not in IGNORED_BASES]
                out["definitions"].append({"name": child.name, "kind": "class", "start_line": child.lineno, "end_line": child.end_lineno, "parent_name": cls, "bases": bases})
                visit(child, child.name, child.name)
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inside = isinstance(node, ast.ClassDef)
                out["definitions"].append({"name": child.name, "kind": "method" if inside else "function", "start_line": child.lineno, "end_line": child.end_lineno, "parent_name": cls if inside else None, "bases": []})
                visit(child, cls, f"{cls}.{child.name}" if inside else child.name)
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    if isinstance(f, ast.Name):
                        out["calls"].append({"caller": owner, "callee": f.id, "receiver": None, "line": child.lineno})
                    elif isinstance(f, ast.Attribute):
                        v = f.value
                        r = v.id if isinstance(v, ast.Name) else v.attr if isinstance(v, ast.Attribute) else base(v.func) if isinstance(v, ast.Call) else None
                        r = cls if r in ("self", "cls", "super") and cls else r
                        out["calls"].append({"caller": owner, "callee": f.attr, "receiver": r, "line": child.lineno})
                elif isinstance(child, ast.Import):
                    out["imports"] += [{"module": a.name, "name": None, "alias": a.asname or a.name.split(".")[0], "line": child.lineno, "level": 0} for a in child.names]
                elif isinstance(child, ast.ImportFrom):
                    out["imports"] += [{"module": child.module or "", "name": a.name, "alias": a.asname or a.name, "line": child.lineno, "level": child.level} for a in child.names]
                elif isinstance(child, ast.Assign) and isinstance(child.value, ast.Call) and isinstance(child.value.func, ast.Name) and child.value.func.id[:1].isupper():
                    for t in child.targets:
                        name = t.id if isinstance(t, ast.Name) else t.attr if isinstance(t, ast.Attribute) else None
                        if name:
                            out["fields"].append({"name": name, "type": child.value.func.id})
                visit(child, cls, owner)

    visit(tree, None, None)
    return out


_BLANK = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.DOTALL)
_TYPE = re.compile(r"\b(?:class|interface|enum|record)\s+([A-Za-z_$][\w$]*)(?:\s*<[^{]*?>)?([^{;]*)\{")
_FUNCTION = re.compile(r"\bfunction\s*\*?\s*([A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(")
_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:async\s+)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=>")
_METHOD = re.compile(r"(?m)^[ \t]*(?:@[\w.]+(?:\([^)]*\))?\s*)*((?:[\w$<>\[\],.?&| ]+?\s)??)([A-Za-z_$][\w$]*)\s*\(([^;{}]*)\)\s*(?::[^={};\n]+)?(?:throws [\w., ]+)?\s*([{;])")
_CALLED = re.compile(r"(?:\b(?:this\.)?([A-Za-z_$][\w$]*)\s*\.\s*)?\b([A-Za-z_$][\w$]*)\s*\(")
_JS_FROM = re.compile(r"(?m)^\s*(?:import|export)\s+(?:type\s+)?([\s\S]*?)\s+from\s+['\"]([^'\"]+)['\"]")
_JS_PLAIN = re.compile(r"(?m)^\s*import\s+['\"]([^'\"]+)['\"]")
_JS_REQUIRE = re.compile(r"(?:const|let|var)\s+([\w${},\s]+?)\s*=\s*require\(\s*['\"]([^'\"]+)['\"]\s*\)")
_JAVA_IMPORT = re.compile(r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)\s*;")
_FIELD = re.compile(r"(?:private|protected|public|final|static|\s)*\b([A-Z]\w*)(?:<[^;=()]*>)?\s+([a-z]\w*)\s*[;=,)]")
_NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "function", "super", "synchronized", "typeof", "await", "throw", "else", "do", "import", "require"}


def _braced(content: str, language: str) -> dict[str, list]:
    out: dict[str, list] = {"definitions": [], "calls": [], "imports": [], "fields": []}
    plain = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), content)
    ends = [m.start() for m in re.finditer("\n", plain)]
    line = lambda at: bisect_right(ends, at - 1) + 1
    close: dict[int, int] = {}
    stack: list[int] = []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            close[stack.pop()] = m.start()
    spans: list[tuple[int, int, str, str, list, int]] = []
    for m in _TYPE.finditer(plain):
        rest = m[2]
        bases = []
        for word, names in re.findall(r"\b(extends|implements)\s+([\w$.,<>\s]+?)(?=\bextends\b|\bimplements\b|$)", rest):
            flat = re.sub(r"<[^<>]*>", "", re.sub(r"<[^<>]*>", "", names))
            bases += [{"name": x.strip().split(".")[-1], "relation": word} for x in flat.split(",") if x.strip() and x.strip() not in IGNORED_BASES]
        spans.append((m.start(), close.get(m.end() - 1, len(plain)), m[1], "class", bases, m.start()))
    types = [(a, b, n) for a, b, n, k, _, _ in spans if k == "class"]
    within = lambda at: max(((a, n) for a, b, n in types if a < at < b), default=(0, None))[1]
    heads: set[int] = set()
    if language != "java":
        for pattern in (_FUNCTION, _ARROW):
            for m in pattern.finditer(plain):
                at = plain.find("{", m.end())
                spans.append((m.start(), close.get(at, m.end()), m[1], "function", [], m.start()))
                heads.add(m.start(1))
    for m in _METHOD.finditer(plain):
        name, owner = m[2], within(m.start(2))
        if name in _NOT_CALLS or not owner or m.start(2) in heads or (m[4] == ";" and (language != "java" or not m[1].strip())) or re.search(r"\b(new|return|throw|else)\s*$", m[1]):
            continue
        at = m.end() - 1
        spans.append((m.start(2), close.get(at, m.end()) if m[4] == "{" else m.end(), name, "method", [], m.start(2)))
        heads.add(m.start(2))
    for a, b, n, k, bases, _ in spans:
        parent = within(a) if k == "method" else None
        out["definitions"].append({"name": n, "kind": k, "start_line": line(a), "end_line": line(b), "parent_name": parent, "bases": bases})
    inner = sorted(((b - a, a, b, n, k) for a, b, n, k, _, _ in spans))
    for m in _CALLED.finditer(plain):
        if m[2] in _NOT_CALLS or m.start(2) in heads:
            continue
        owner = next(((n, k, a) for _, a, b, n, k in inner if a < m.start() < b), None)
        caller = None if owner is None else f"{within(owner[2])}.{owner[0]}" if owner[1] == "method" else owner[0]
        out["calls"].append({"caller": caller, "callee": m[2], "receiver": within(m.start()) if m[1] == "this" else m[1], "line": line(m.start())})
    if language == "java":
        out["imports"] = [{"module": m[1], "name": m[1].rsplit(".", 1)[-1], "alias": m[1].rsplit(".", 1)[-1], "line": line(m.start(1)), "level": 0} for m in _JAVA_IMPORT.finditer(plain)]
        out["fields"] = [{"name": m[2], "type": m[1]} for m in _FIELD.finditer(plain)]
        return out
    for pattern in (_JS_FROM, _JS_REQUIRE):
        for m in pattern.finditer(content):
            for part in re.split(r"[{},]", m[1]):
                words = part.replace("* as", "").split()
                if words and words != ["type"]:
                    whole = "{" not in m[1] or "*" in part
                    out["imports"].append({"module": m[2], "name": None if whole else words[0], "alias": words[-1], "line": line(m.start(2)), "level": 0})
    out["imports"] += [{"module": m[1], "name": None, "alias": None, "line": line(m.start(1)), "level": 0} for m in _JS_PLAIN.finditer(content)]
    return out


def parse_file(content: str | None, language: str | None) -> dict[str, list]:
    if not content:
        return {"definitions": [], "calls": [], "imports": [], "fields": []}
    got = _python(content) if language == "python" else _braced(content, language or "")
    once = {(d["name"], d["start_line"], d["end_line"], d["kind"]): d for d in reversed(got["definitions"])}
    got["definitions"] = [d | {"ordinal": i} for i, d in enumerate(sorted(once.values(), key=lambda d: (d["start_line"], d["end_line"], d["name"])))]
    return got


def parsed(files: DataFrame) -> DataFrame:
    """One row a file: file_path, language, definitions, calls, imports, fields."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [parse_file(c, x) for c, x in zip(frame["content"], frame["language"], strict=True)]
            yield pd.DataFrame({"file_path": frame["file_path"], "language": frame["language"], **{k: [g[k] for g in got] for k in ("definitions", "calls", "imports", "fields")}})

    return files.select("file_path", "language", "content").mapInPandas(run, f"file_path string, language string, definitions {DEFINITION}, calls {CALL}, imports {IMPORT}, fields {FIELD}")


def definitions(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.select("file_path", "language", F.explode("definitions").alias("d")).select("file_path", "language", "d.*").withColumn("ref", ids.make_ref(F.col("file_path"), F.col("name"), F.col("parent_name")))


# --- chunks --------------------------------------------------------------------


def fallback_chunks(files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Windows of ``size`` lines: adds start_line, end_line; content is the window's."""
    cut = files.withColumn("__lines", F.split("content", "\n", -1)).withColumn("__at", F.explode(F.sequence(F.lit(0), F.size("__lines") - 1, F.lit(size))))
    out = cut.withColumn("content", F.array_join(F.slice("__lines", F.col("__at") + 1, F.lit(size)), "\n"))
    out = out.withColumn("start_line", F.col("__at") + 1).withColumn("end_line", F.least(F.col("__at") + size, F.size("__lines")))
    return out.drop("__lines", "__at")


def chunks(files: DataFrame, defs: DataFrame) -> DataFrame:
    """A chunk for each definition (methods are in their class's), windows for files without any."""
    classes = defs.where("kind = 'class'").select("file_path", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    inside = (F.col("d.file_path") == F.col("c.file_path")) & (F.col("d.kind") == "method") & (F.col("d.start_line") > F.col("c.s")) & (F.col("d.end_line") <= F.col("c.e"))
    outer = defs.alias("d").join(classes.alias("c"), inside, "left_anti")
    last = outer.withColumn("n", F.row_number().over(Window.partitionBy("file_path", "start_line", "end_line").orderBy(F.desc("ordinal")))).where("n = 1")
    text = F.array_join(F.slice(F.split("content", "\n", -1), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    name = F.concat_ws(".", "parent_name", "name")
    one = last.join(files.select("file_path", "content"), "file_path").select("file_path", "start_line", "end_line", text.alias("content"), "kind", name.alias("symbol_name"), "language", F.col("name").alias("__name"))
    none = files.join(defs.select("file_path").distinct(), "file_path", "left_anti").where(F.length("content") > 0)
    two = fallback_chunks(none).select("file_path", "start_line", "end_line", "content", F.lit("fallback").alias("kind"), F.lit(None).cast("string").alias("symbol_name"), "language", F.lit(None).cast("string").alias("__name"))
    both = one.unionByName(two)
    return both.withColumn("chunk_id", ids.chunk_id(F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("__name"))).withColumn("content_hash", ids.content_hash(F.col("content"))).drop("__name")


# --- imports and calls -----------------------------------------------------------


def path_index(files: DataFrame) -> DataFrame:
    """Rows key, target: keys a file can be imported by; of several files the last by name counts."""
    return resolution.file_keys(files).groupBy("key").agg(F.max("target").alias("target"))


def import_candidates(parsed_files: DataFrame) -> DataFrame:
    """Rows file_path, pos, alias, name, line, language, turn, key: keys that an import may mean, best first."""
    raw = parsed_files.select("file_path", "language", F.posexplode("imports").alias("pos", "i")).select("file_path", "language", "pos", "i.*")
    parts = F.split("file_path", "/")
    here = F.slice(parts, 1, F.greatest(F.size(parts) - F.greatest(F.col("level"), F.lit(1)), F.lit(0)))
    dotted = F.array_join(here, ".")
    under = F.when(F.size(here) > 0, F.concat(dotted, F.lit("."))).otherwise(F.lit(""))
    sub = F.when(F.col("name").isNotNull(), F.concat("module", F.when(F.col("module") != "", ".").otherwise(""), "name"))
    python = F.when(F.col("level") > 0, F.array(F.concat(under, sub), F.concat(under, "module"))).otherwise(F.array(sub, F.col("module"), F.concat(under, sub), F.concat(under, "module"), F.element_at(F.split("module", r"\."), -1)))
    steps = F.split(F.concat_ws("/", F.array_join(here, "/"), "module"), "/")
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when((s == ".") | (s == ""), a).when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(s))))
    js = F.when(F.col("module").startswith("."), F.array(F.array_join(walked, "/"), F.regexp_replace(F.array_join(walked, "/"), r"\.[cm]?[jt]sx?$", "")))
    java = F.array(F.replace("module", F.lit("."), F.lit("/")), F.element_at(F.split("module", r"\."), -1))
    keys = F.when(F.col("language") == "python", python).when(F.col("language") == "java", java).otherwise(js)
    return raw.select("file_path", "pos", "alias", "name", "line", "language", F.posexplode(keys).alias("turn", "key")).where("key is not null and key != ''")


def resolved_imports(parsed_files: DataFrame, files: DataFrame) -> DataFrame:
    """Rows file_path, target, alias, name, line: the first candidate that is a file counts."""
    hit = import_candidates(parsed_files).join(path_index(files), "key").where("target != file_path")
    # A name of a package that is itself a module is that module.
    first = hit.groupBy("file_path", "pos", "alias", "name", "line").agg(F.min_by("target", "turn").alias("target"), F.min_by("key", "turn").alias("key"))
    return first.select("file_path", "target", "alias", F.when(F.element_at(F.split("key", r"[./]"), -1) == F.col("name"), F.when(paths.stem(F.col("target")) == F.col("name"), F.lit(None).cast("string")).otherwise(F.col("name"))).otherwise(F.col("name")).alias("name"), "line")


def resolved_calls(parsed_files: DataFrame, defs: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """Call edges by falling trust, the first tier that finds a target: rows source, target, confidence, strategy, line."""
    sites = parsed_files.select("file_path", F.posexplode("calls").alias("pos", "c")).select("file_path", "pos", "c.*").where("caller is not null")
    fields = parsed_files.select("file_path", F.explode("fields").alias("f")).select("file_path", F.col("f.name").alias("receiver"), F.col("f.type").alias("type")).dropDuplicates(["file_path", "receiver"])
    sites = sites.join(fields, ["file_path", "receiver"], "left").withColumn("type", F.coalesce("type", "receiver"))
    free = defs.where("kind != 'method'")
    first = lambda df, keys: df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("file_path", "ordinal"))).where("__n = 1").drop("__n")
    own = first(free, ["file_path", "name"]).select(F.col("file_path").alias("d_file"), F.col("name").alias("d_name"), "ref")
    key = ["file_path", "pos"]
    bare, sent = sites.where("receiver is null"), sites.where("receiver is not null")

    def tier(df: DataFrame, turn: int, confidence, strategy) -> DataFrame:
        c = F.lit(confidence) if isinstance(confidence, float) else confidence
        return df.select("file_path", "pos", F.col("ref").alias("target"), F.lit(turn).alias("turn"), c.cast("double").alias("confidence"), F.lit(strategy).alias("strategy"))

    imp = imports.select("file_path", F.col("target").alias("d_file"), "alias", F.coalesce("name", "alias").alias("i_name"))
    named = bare.join(imp, (bare.file_path == imp.file_path) & (F.col("callee") == F.col("alias"))).drop(imp.file_path)
    t1 = named.join(own, (named.d_file == own.d_file) & (F.col("i_name") == F.col("d_name")))
    t2 = bare.join(own, (F.col("file_path") == F.col("d_file")) & (F.col("callee") == F.col("d_name")))
    reach = imports.select("file_path", F.col("target").alias("d_file")).distinct()
    t3 = bare.join(reach, "file_path").join(own, (reach.d_file == own.d_file) & (F.col("callee") == F.col("d_name")))
    world = first(free, ["file_path", "name"]).withColumn("same", F.count("*").over(Window.partitionBy("name"))).select(F.col("file_path").alias("c_file"), F.col("name").alias("d_name"), "ref", "same")
    cand = bare.join(world, F.col("callee") == F.col("d_name")).join(reach.select("file_path", F.col("d_file").alias("c_file"), F.lit(1).alias("near")), ["file_path", "c_file"], "left")
    t4 = cand.where("same = 1")
    order = Window.partitionBy(*key).orderBy(F.coalesce("near", F.lit(0)).desc(), F.desc("shared"), "c_file")
    close = cand.where("same > 1").withColumn("shared", paths.shared_prefix(F.col("c_file"), F.col("file_path")))
    close = close.withColumn("n", F.row_number().over(order)).withColumn("tie", F.lead(F.struct(F.coalesce("near", F.lit(0)), "shared")).over(order) == F.struct(F.coalesce("near", F.lit(0)), "shared"))
    t5 = close.where("n = 1 and not coalesce(tie, false)")
    unknown = bare.join(world.select("d_name").distinct(), F.col("callee") == F.col("d_name"), "left_anti").select(F.col("callee").alias("name")).distinct()
    fuzzy = resolution.near_names(unknown, world.where("same = 1").select(F.col("d_name").alias("name")))
    best = fuzzy.withColumn("n", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("ratio"), "match"))).where("n = 1")
    t6 = bare.join(best, F.col("callee") == F.col("name")).join(world.where("same = 1"), F.col("match") == F.col("d_name"))
    methods = first(defs.where("kind = 'method'"), ["file_path", "parent_name", "name"]).select(F.col("name").alias("m_name"), "ref")
    r1 = resolution.methods_on_types(sent, defs, imports, files)
    r2 = sent.join(imp.select("file_path", "d_file", F.col("alias").alias("receiver")), ["file_path", "receiver"]).join(own, "d_file").where("callee = d_name")
    lone = methods.withColumn("same", F.count("*").over(Window.partitionBy("m_name"))).where("same = 1")
    r3 = sent.join(lone, F.col("callee") == F.col("m_name"))
    # The file that holds the call, and a name that only one file has.
    t4_sure = F.when(F.col("c_file") == F.col("file_path"), 0.90).when(F.col("near") == 1, 0.75).otherwise(0.60)
    tiers = [
        tier(t1, 1, 0.95, "import_map"), tier(t2, 2, 0.90, "same_module"), tier(t3, 3, 0.85, "import_suffix"), tier(t4, 4, t4_sure, "unique_name"),
        tier(t5, 5, 0.55, "import_distance"), tier(t6, 6, F.round(0.30 + 0.10 * F.col("ratio"), 3), "fuzzy"),
        tier(r1, 1, 0.95, "type_resolved"), tier(r2, 2, 0.95, "import_map"), tier(r3, 3, 0.60, "unique_name"),
    ]
    every = tiers[0]
    for t in tiers[1:]:
        every = every.unionByName(t)
    chosen = every.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("turn", "target"))).where("n = 1")
    out = chosen.join(sites.select(*key, "caller", "line"), key).select(F.concat("file_path", F.lit("::"), "caller").alias("source"), "target", "confidence", "strategy", "line")
    return out.where("source != target").withColumn("__n", F.row_number().over(Window.partitionBy("source", "target").orderBy("line"))).where("__n = 1").drop("__n")


def inherit_edges(defs: DataFrame, imports: DataFrame, files: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Rows source (child), target (parent), relation, line of each base that is found (see :func:`resolution.named_types`); of the definitions ``children`` if given."""
    own = children if children is not None else defs
    child = own.where("kind = 'class'").select("file_path", F.col("ref").alias("source"), F.col("start_line").alias("line"), F.explode("bases").alias("b")).select("file_path", "source", "line", F.col("b.name").alias("type"), F.col("b.relation").alias("relation"))
    found = resolution.named_types(child, defs, imports, files)
    hit = child.join(found, ["file_path", "type"]).select("source", F.col("ref").alias("target"), "relation", "line").where("source != target")
    return resolution.first_by(hit, ["source", "target", "relation"], "line")


def edges(parsed_files: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """All edges in one table."""
    imp = resolved_imports(parsed_files, files)
    none = lambda t: F.lit(None).cast(t)
    i = imp.groupBy(F.col("file_path").alias("source"), "target").agg(F.min("line").alias("line")).select("source", "target", F.lit("import").alias("edge_type"), F.lit(1.0).alias("confidence"), none("string").alias("strategy"), "line", none("string").alias("relation"))
    c = resolved_calls(parsed_files, defs, imp, files).select("source", "target", F.lit("call").alias("edge_type"), "confidence", "strategy", "line", none("string").alias("relation"))
    own = defs.join(parsed_files.select("file_path"), "file_path", "left_semi")
    h = inherit_edges(defs, imp, files, own).select("source", "target", F.lit("inherit").alias("edge_type"), F.lit(1.0).alias("confidence"), none("string").alias("strategy"), "line", "relation")
    return i.unionByName(c).unionByName(h).withColumn("ordinal", F.coalesce("line", F.lit(0)).cast("long"))
