"""Predicates and scores of file paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import posix

# Suffixes and path segments that decide a file's kind.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript",
    ".tsx": "tsx", ".java": "java", ".md": "markdown", ".markdown": "markdown",
}
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt", ".adoc", ".html")
SOURCE_SUFFIXES = (".py", ".java", ".js", ".jsx", ".ts", ".tsx", ".go", ".rs", ".kt", ".kts", ".cs", ".cpp", ".c", ".h", ".hpp", ".rb", ".php", ".scala")
DOC_MARKERS = ("/docs/", "/doc/", "/documentation/", "/changelog")
SOURCE_LANGUAGES = ("python", "java", "javascript", "typescript", "tsx", "go", "rust", "kotlin", "csharp")
CODE_KINDS = ("function", "method", "class", "module", "code")
NOISE_SEGMENTS = (
    "src", "main", "java", "kotlin", "scala", "resources", "test", "tests", "python", "__pycache__", "node_modules", "target",
    "build", "dist", "out", "bin", "lib", "libs", "vendor", "com", "org", "net", "io",
)
ENTRY_FILES = (
    "main.py", "app.py", "__main__.py", "manage.py", "wsgi.py", "asgi.py", "index.js", "index.ts", "index.tsx", "main.ts", "main.js",
    "app.ts", "Application.java", "Main.java", "App.java", "Bootstrap.java",
)


def _suffix(path: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def base_name(path: Column) -> Column:
    return F.element_at(F.split(posix(path), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def language(path: Column) -> Column:
    table = F.create_map(*map(F.lit, chain.from_iterable(LANGUAGES.items())))
    return F.try_element_at(table, F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)))


def is_doc(path: Column) -> Column:
    p = F.lower(posix(F.coalesce(path, F.lit(""))))
    marked = p.startswith("docs/")
    for m in DOC_MARKERS:
        marked = marked | F.contains(p, F.lit(m))
    return (p != "") & (marked | _suffix(p, DOC_SUFFIXES))


def is_source(path: Column, lang: Column) -> Column:
    p = F.lower(posix(F.coalesce(path, F.lit(""))))
    return F.when(F.lower(F.coalesce(lang, F.lit(""))).isin(*SOURCE_LANGUAGES), ~is_doc(path)).otherwise(_suffix(p, SOURCE_SUFFIXES))


def quality(path: Column, lang: Column, kind: Column) -> Column:
    """Factor on a retrieval score: documents down, application code up."""
    p = F.lower(posix(F.coalesce(path, F.lit(""))))
    k = F.lower(F.coalesce(kind, F.lit("")))
    doc = F.when(base_name(p).isin("readme.md", "readme.markdown", "readme"), 0.55).otherwise(0.35)
    source = F.when(is_source(path, lang), 1.15).otherwise(1.0)
    code = F.when(k.isin(*CODE_KINDS), 1.10).when(k.isin("fallback", "doc", "markdown"), 0.70).otherwise(1.0)
    test = F.contains(p, F.lit("/test/")) | F.contains(p, F.lit("/tests/")) | p.endswith("_test.py") | p.startswith("test_")
    return F.when(is_doc(path), doc).otherwise(source * code * F.when(test, 0.90).otherwise(1.0))


def is_entry(path: Column, names: tuple[str, ...] = ENTRY_FILES) -> Column:
    name = F.lower(base_name(path))
    return name.isin(*[n.lower() for n in names]) | (name.endswith("application.java") & F.contains(F.lower(posix(path)), F.lit("/src/main/java/")))


def is_api(path: Column) -> Column:
    return F.coalesce(F.lower(posix(path)).rlike(r"(^|/)(api|controller|controllers|routes?|rest|web|endpoints?|handlers?)(/|$)"), F.lit(False))


def cluster_key(path: Column) -> Column:
    """The directory that a file's module is named by: the first that isn't noise; two levels under a general root."""
    parts = F.filter(F.split(posix(path), "/"), lambda p: (p != "") & (p != "."))
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    flags = F.transform(dirs, lambda d: F.lower(d).isin(*NOISE_SEGMENTS))
    noise = F.array_position(flags, False)
    useful = F.when(noise > 0, F.slice(dirs, noise.cast("int"), F.size(dirs))).otherwise(F.array().cast("array<string>"))
    first = F.get(useful, 0)
    two = F.lower(first).isin("app", "application", "project") & (F.size(useful) >= 2)
    named = F.when(two, F.concat_ws("/", first, F.get(useful, 1))).otherwise(first)
    single = F.when((F.size(parts) == 1) & ~F.contains(F.get(parts, 0), F.lit(".")), F.get(parts, 0))
    return F.when(F.size(parts) < 2, single).when(F.size(useful) == 0, F.element_at(dirs, -1)).otherwise(named)


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    x, y = F.split(a, "/"), F.split(b, "/")
    n = F.least(F.size(x), F.size(y)) - 1
    same = F.zip_with(F.slice(x, 1, n), F.slice(y, 1, n), lambda p, q: p == q)
    broken = F.array_position(same, False)
    return F.when(broken > 0, broken - 1).otherwise(n).cast("int")
