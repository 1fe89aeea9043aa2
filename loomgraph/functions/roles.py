"""Architectural roles from names, paths, annotations and parents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ids import ref_symbol
from .paths import stem

# Name endings, path segments and annotations, most telling first.
NAMES = (
    ("controller", r"(?i)(Controller|Resource|RestController|ApiHandler|RequestHandler)$"),
    ("gateway", r"(?i)(Gateway|Middleware|Filter|Interceptor)$"),
    ("repository", r"(?i)(Repository|Repo|Dao|Mapper|Store)$"),
    ("mq", r"(?i)(Producer|Consumer|Listener|Publisher|Subscriber|Kafka|Rabbit|MessageHandler)$"),
    ("cache", r"(?i)(Cache|Redis|Caffeine)$"),
    ("service", r"(?i)(Service|UseCase|Interactor|Manager|Facade)$"),
)
PATHS = (
    ("controller", r"(?i)(^|/)(controller|controllers|web|api|rest|endpoints?|handlers?|routes?)(/|$)"),
    ("gateway", r"(?i)(^|/)(gateway|filter|middleware)(/|$)"),
    ("repository", r"(?i)(^|/)(repositories?|repos?|dao|persistence|infra|infrastructure|mapper)(/|$)"),
    ("mq", r"(?i)(^|/)(messaging|mq|kafka|rabbit|events?)(/|$)"),
    ("cache", r"(?i)(^|/)(cache|redis)(/|$)"),
    ("service", r"(?i)(^|/)(services?|domain|application|usecases?)(/|$)"),
)
JAVA = (("controller", r"@(RestController|Controller|RequestMapping|GetMapping|PostMapping)\b"), ("repository", r"@(Repository|Mapper)\b"), ("service", r"@Service\b"))
ROUTER = r"(?i)\b(APIRouter|FastAPI)\b|@(?:app|router)\.(get|post|put|delete|patch)\b"
HANDLERS = ("login", "logout", "signin", "signup", "register", "create", "update", "delete", "list", "get", "post", "handler")
HANDLER_STARTS = r"^(get_|post_|put_|delete_|create_|list_)"
LAYER = {"controller": 0, "gateway": 0, "service": 1, "unknown": 2, "cache": 3, "mq": 3, "repository": 3, "database": 4, "external": 4}
SINKS = ("repository", "database", "mq", "cache")
UNKNOWN = "unknown"


def _first(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The role of the first rule that the text matches, or null."""
    return reduce(lambda c, r: c.when(text.rlike(r[1]), r[0]), rules[1:], F.when(text.rlike(rules[0][1]), rules[0][0]))


def _words(rules: tuple[tuple[str, str], ...]) -> list[str]:
    """Words of which a text that the rules match has one, in lower case; those that have another of them are left out."""
    found = {(w[:-1] if o else w).lower() for _, p in rules for w, o in re.findall(r"([A-Za-z]{2,})(\??)", p.replace("(?i)", ""))}
    return sorted(w for w in found if not any(v in w for v in found - {w}))


def _may(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Whether it is worth matching: most names have none of the words, and looking for words is far cheaper than matching."""
    words = F.lit(_words(rules))
    return F.exists(F.array(F.lower(text)), lambda low: F.exists(words, lambda w: F.contains(low, w)))


def by_name(name: Column) -> Column:
    return F.when(_may(name, NAMES), _first(name, NAMES))


def by_path(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.coalesce(F.when(_may(p, PATHS), _first(p, PATHS)), F.when(_may(p, NAMES), _first(stem(p), NAMES)))


def is_handler(name: Column) -> Column:
    return F.lower(name).isin(*HANDLERS) | F.lower(name).rlike(HANDLER_STARTS)


def by_text(text: Column, kind: Column, name: Column, language: Column, path: Column) -> Column:
    java = (F.coalesce(language, F.lit("java")) == "java") | path.endswith(".java")
    python = (F.coalesce(language, F.lit("python")) == "python") | path.endswith(".py")
    route = kind.isin("function", "method", "file") & ((kind == "file") | is_handler(name)) & text.rlike(ROUTER)
    return F.coalesce(F.when(java & kind.isin("class", "file", "method"), _first(text, JAVA)), F.when(python & route, "controller"))


def with_roles(nodes: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Adds ``role``: methods take their class's, unless their own name says queue, cache or database.

    ``texts`` has file_path and content.
    """
    own = nodes.join(texts.select("file_path", F.col("content").alias("__text")), "file_path", "left") if texts is not None else nodes.withColumn("__text", F.lit(None).cast("string"))
    class_name = F.substring_index(ref_symbol(F.col("qualified_name")), ".", 1)
    name, kind = F.col("name"), F.col("kind")
    local = F.coalesce(
        F.when(kind == "file", by_path(F.coalesce("file_path", "name"))),
        F.when(kind != "file", F.coalesce(by_name(name), F.when(class_name != name, by_name(class_name)), by_path(F.col("file_path")), by_text(F.col("__text"), kind, name, F.col("language"), F.col("file_path")))),
    )
    own = own.withColumn("__own", local).drop("__text")
    parents = own.where(kind != "method").select(F.col("id").alias("__parent"), F.col("__own").alias("__inherited"))
    # What has no parent to take from would meet in the task of the null key, so it is dealt by id.
    own = own.withColumn("__salt", F.when((kind == "method") & F.col("parent_id").isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(1 << 20))))
    both = own.join(parents.withColumn("__zero", F.lit(0).cast("long")), (F.col("parent_id") == F.col("__parent")) & (F.col("__salt") == F.col("__zero")), "left")
    strong = F.when(by_name(name).isin("mq", "cache", "database"), by_name(name))
    role = F.when((kind == "method") & F.col("__inherited").isNotNull(), F.coalesce(strong, "__inherited")).otherwise(F.col("__own"))
    return both.withColumn("role", F.coalesce(role, F.lit(UNKNOWN))).drop("__own", "__parent", "__inherited", "__salt", "__zero")


def layer(role: Column) -> Column:
    return reduce(lambda c, x: c.when(role == x[0], x[1]), list(LAYER.items())[1:], F.when(role == "controller", 0)).otherwise(2)


def is_sink(role: Column) -> Column:
    return role.isin(*SINKS)
