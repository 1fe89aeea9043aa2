"""What a repository is built with: build systems, frameworks and infrastructure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# Manifest names, and what words in manifests and configurations mean.
BUILD_FILES = {
    "pom.xml": "maven", "build.gradle": "gradle", "build.gradle.kts": "gradle", "settings.gradle": "gradle", "settings.gradle.kts": "gradle",
    "package.json": "npm", "pnpm-lock.yaml": "pnpm", "yarn.lock": "yarn", "pyproject.toml": "poetry_or_pep621", "requirements.txt": "pip",
    "Pipfile": "pipenv", "go.mod": "go_modules", "Cargo.toml": "cargo", "Gemfile": "bundler", "composer.json": "composer",
}
FRAMEWORKS = (
    ("Spring Boot", r"(?i)spring-boot|springframework", "high"), ("Spring", r"(?i)\bspring\b", "medium"), ("FastAPI", r"(?i)\bfastapi\b", "high"),
    ("Django", r"(?i)\bdjango\b", "high"), ("Flask", r"(?i)\bflask\b", "high"), ("Express", r"(?i)\bexpress\b", "high"),
    ("Next.js", r"(?i)\bnext\b", "medium"), ("React", r"(?i)\breact\b", "medium"), ("NestJS", r"(?i)\b@nestjs\b|\bnestjs\b", "high"),
    ("Gin", r"(?i)\bgin-gonic\b|\bgithub.com/gin-gonic", "high"),
)
INFRASTRUCTURE = (
    ("PostgreSQL", r"(?i)postgres|postgresql|psycopg", "database"), ("MySQL", r"(?i)\bmysql\b|mariadb", "database"), ("MongoDB", r"(?i)\bmongo\b|mongodb", "database"),
    ("SQLite", r"(?i)\bsqlite\b", "database"), ("Redis", r"(?i)\bredis\b", "cache"), ("Kafka", r"(?i)\bkafka\b", "mq"), ("RabbitMQ", r"(?i)\brabbit\b|amqp", "mq"),
    ("Elasticsearch", r"(?i)elasticsearch|opensearch", "search"), ("AWS", r"(?i)\baws-sdk\b|\bboto3\b|amazonaws", "cloud"),
)
CONFIGS = ("docker-compose.yml", "docker-compose.yaml", "compose.yaml", "application.yml", "application.yaml", "application.properties", ".env.example")
# Folders without a project's own configurations.
NOT_OWN = (".git", "node_modules", ".venv", "venv", "target")
READ_LIMIT, MANIFESTS, MOST_CONFIGS, README_CHARS = 200_000, 80, 40, 8000
READMES = ("README.md", "README.rst", "README.txt", "README", "readme.md")


def chosen(found: DataFrame, most: int = MANIFESTS, most_configs: int = MOST_CONFIGS) -> DataFrame:
    """Of file_path and name, the first manifests and the first configurations by path, each with a limit of its own; excluded folders are left out."""
    own = found.where(~F.arrays_overlap(F.split("file_path", "/"), F.array(*map(F.lit, NOT_OWN))))
    few = lambda names, n: own.where(F.col("name").isin(*names)).orderBy("file_path").limit(n)
    return few(BUILD_FILES, most).unionByName(few(CONFIGS, most_configs))


def manifests(spark: SparkSession, folder: str, most: int = MANIFESTS, most_configs: int = MOST_CONFIGS) -> DataFrame:
    """Rows file_path, name, text of manifests and configurations, the first by path; each up to 200 KB."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    # Names are chosen before any content is read, and folders above the root don't matter.
    inside = F.substring("path", len(root) + 2, 1 << 20)
    listed = chosen(raw.select(inside.alias("file_path"), paths.base_name(F.col("path")).alias("name")), most, most_configs)
    named = raw.select(F.col("path"), inside.alias("file_path"), "content").join(F.broadcast(listed), "file_path").withColumn("file_path", F.col("path"))
    return named.select("file_path", "name", F.substring(F.decode("content", "UTF-8"), 1, READ_LIMIT).alias("text"))


def readme(spark: SparkSession, folder: str) -> str | None:
    """The first README of a folder, up to 8000 characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "[Rr][Ee][Aa][Dd][Mm][Ee]*").load(folder)
    rank = F.array_position(F.array(*map(F.lit, READMES)), paths.base_name(F.col("path")))
    r = raw.where(rank > 0).orderBy(rank).select(F.substring(F.decode("content", "UTF-8"), 1, README_CHARS).alias("t")).first()
    return r.t if r else None


def _rules(rules: tuple[tuple[str, str, str], ...], text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.struct(F.lit(n).alias("name"), F.lit(k).alias("kind"))) for n, p, k in rules]))


def found(texts: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """Rows name, kind, file_path: the first file that a rule matches. texts: file_path, text."""
    hit = texts.select("file_path", F.explode(_rules(rules, F.col("text"))).alias("r"))
    return hit.groupBy("r.name", "r.kind").agg(F.min("file_path").alias("file_path"))


def build_systems(names: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in BUILD_FILES.items() for x in kv])
    return names.select(F.try_element_at(table, F.col("name")).alias("build_system"), "file_path").where("build_system is not null").groupBy("build_system").agg(F.min("file_path").alias("file_path"))


def profile(spark: SparkSession, folder: str) -> dict[str, list[dict]]:
    m = manifests(spark, folder)
    rows = lambda df, by: [r.asDict() for r in df.orderBy(by).collect()]
    return {"build_systems": rows(build_systems(m), "build_system"), "frameworks": rows(found(m, FRAMEWORKS), "name"), "infrastructure": rows(found(m, INFRASTRUCTURE), "name")}
