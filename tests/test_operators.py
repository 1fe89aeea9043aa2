"""Operators on small inputs, and every query with SQL against that SQL."""

import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import ids, paths, roles, texts
from loomgraph.operators import architecture, changes, context, evaluation, graph, retrieval
from loomgraph.plans import queries
from loomgraph.streaming import watch

DATA = Path("/root/testdata/sf0.001")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


# --- functions -------------------------------------------------------------------


def test_paths(spark):
    p = lambda x: F.lit(x)
    got = {x: one(spark, paths.cluster_key(p(x))) for x in ("app/services/a.py", "src/main/java/com/shop/auth/A.java", "a.py", "src/a.py", "pkg/b/c.py")}
    assert got == {"app/services/a.py": "app/services", "src/main/java/com/shop/auth/A.java": "shop", "a.py": None, "src/a.py": "src", "pkg/b/c.py": "pkg"}
    assert one(spark, paths.shared_prefix(p("a/b/c.py"), p("a/b/d/e.py"))) == 2
    assert one(spark, paths.quality(p("README.md"), F.lit(None), F.lit(None))) == 0.55
    assert one(spark, paths.quality(p("docs/x.py"), F.lit("python"), F.lit("function"))) == 0.35
    assert math.isclose(one(spark, paths.quality(p("a/tests/x.py"), F.lit("python"), F.lit("function"))), 1.15 * 1.1 * 0.9)
    assert one(spark, paths.language(p("A.PY"))) == "python" and one(spark, paths.language(p("x.zip"))) is None
    assert one(spark, paths.is_entry(p("shop/src/main/java/x/ShopApplication.java")))


def test_ids(spark):
    assert one(spark, ids.repo_id(F.lit("https://x/y.git"))) == one(spark, ids.repo_id(F.lit("https://x/y/")))
    assert one(spark, ids.node_file(F.lit("sym:a/b.py::C.d"))) == "a/b.py"
    assert one(spark, ids.parse_citation(F.lit("a:b.py:3-9"))).asDict() == {"file_path": "a:b.py", "start_line": 3, "end_line": 9}
    assert one(spark, ids.parse_citation(F.lit("a.py:3"))) is None
    assert [one(spark, ids.confidence_bucket(F.lit(x))) for x in (0.9, 0.6, 0.1)] == ["high", "medium", "low"]
    assert len(one(spark, ids.point_id(F.lit("c")))) == 36


def test_roles(spark):
    nodes = spark.createDataFrame(
        [
            ("c", "class", "UserRepo", "x/a.py::UserRepo", "x/a.py", None, "python"),
            ("m", "method", "find", "x/a.py::UserRepo.find", "x/a.py", "c", "python"),
            ("q", "method", "EventPublisher", "x/a.py::UserRepo.EventPublisher", "x/a.py", "c", "python"),
            ("f", "function", "get_user", "x/r.py::get_user", "x/r.py", None, "python"),
            ("g", "function", "other", "api/r.py::other", "api/r.py", None, "python"),
        ],
        "id string, kind string, name string, qualified_name string, file_path string, parent_id string, language string",
    )
    text = spark.createDataFrame([("x/r.py", "app = FastAPI()")], "file_path string, content string")
    got = {r.id: r.role for r in roles.with_roles(nodes, text).collect()}
    assert got == {"c": "repository", "m": "repository", "q": "mq", "f": "controller", "g": "controller"}


def test_texts(spark):
    assert one(spark, texts.lexical_tokens(F.lit("Foo_1 + 22;"))) == ["foo_1", "+", "22", ";"]
    assert [one(spark, texts.n_tokens(F.lit(x))) for x in ("", "a", "abcde")] == [0, 1, 2]
    assert one(spark, texts.joined_query(F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.lit("c" * 300)))) == "a b"
    assert one(spark, texts.has_symbol(F.lit("A.find"), F.lit("x.find(1)"))) and not one(spark, texts.has_symbol(F.lit("fin"), F.lit("find")))


# --- retrieval ---------------------------------------------------------------------


def test_rrf_ignores_channel_order(spark):
    rows = [(1, "v", "a", 1), (1, "v", "b", 2), (1, "v", "c", 3), (1, "l", "b", 1), (1, "l", "a", 2), (1, "l", "d", 3)]
    make = lambda r: {x.doc_id: x.score for x in retrieval.rrf(spark.createDataFrame(r, "query_id int, channel string, doc_id string, rank int")).collect()}
    got = make(rows)
    assert set(got) == set("abcd") and max(got, key=got.get) in "ab" and math.isclose(got["a"], 1 / 61 + 1 / 62)
    assert {k: round(v, 12) for k, v in make(rows[::-1]).items()} == {k: round(v, 12) for k, v in got.items()}


def test_weighted_fusion(spark):
    rows = [(1, "v", "a", 0.9), (1, "v", "b", 0.1), (1, "l", "a", 1.0), (1, "l", "b", 10.0), (1, "k", "c", 4.0)]
    df = spark.createDataFrame(rows, "query_id int, channel string, doc_id string, score double")
    got = {r.doc_id: r.score for r in retrieval.weighted_fusion(df, {"v": 0.5, "l": 0.5, "k": 0.2}).collect()}
    assert got == {"a": 0.5, "b": 0.5, "c": 0.2}


def test_bm25_plain(spark):
    docs = {1: "the cat sat", 2: "the dog", 3: "cat cat dog bird", 4: ""}
    index = retrieval.bm25_index(spark.createDataFrame(list(docs.items()), "doc_id int, text string"))
    q = spark.createDataFrame([(1, "cat bird the")], "query_id int, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(index, q).collect()}
    words = {k: v.split() for k, v in docs.items()}
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    raw = {t: math.log(4 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    avg = sum(map(len, words.values())) / 4
    want = {k: sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / avg)) for t in ("cat", "bird", "the")) for k, w in words.items()}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items() if v > 0}


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    assert sorted(map(tuple, retrieval.upserted(old, new, "id").collect())) == [(1, "a"), (2, "c"), (3, "d")]


# --- graph -------------------------------------------------------------------------

EDGE = "source string, target string, edge_type string, confidence double, relation string, ordinal long"


def edges(spark, pairs, kind="call"):
    return spark.createDataFrame([(a, b, kind, 1.0, None, i) for i, (a, b) in enumerate(pairs)], EDGE)


def seed(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def test_impact_follows_subtypes(spark):
    e = edges(spark, [("b", "a"), ("c", "b"), ("a", "c")]).unionByName(edges(spark, [("k", "a")], "inherit"))
    got = {(r.ref, r.relation, r.hops) for r in graph.impact(e, seed(spark, "a"), depth=4).collect()}
    assert got == {("b", "caller", 1), ("k", "subtype", 1), ("c", "caller", 2)}
    assert graph.impact(e, seed(spark, "nobody")).count() == 0
    assert graph.impact(e, seed(spark, "a"), depth=4, limit=1).count() == 1


def test_blast_radius_reports_supertypes_without_following(spark):
    e = edges(spark, [("x", "p")]).unionByName(edges(spark, [("a", "p"), ("p", "g")], "inherit"))
    got = {(r.ref, r.relation) for r in graph.blast_radius(e, seed(spark, "a"), depth=3).collect()}
    assert got == {("p", "extends")}


def test_chain_stops_at_a_cycle(spark):
    e = edges(spark, [("a", "b"), ("a", "z"), ("b", "c"), ("c", "a")])
    assert [r.path for r in graph.call_chain(e, seed(spark, "a", "z")).collect()] == [["a", "b", "c"]]


def test_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "c"), ("d", "a")], "source string, target string")
    assert sorted(r.path for r in graph.cycles(e).collect()) == [["a", "b"], ["a", "b", "c"]]


def test_beam_prefers_layers(spark):
    nodes = spark.createDataFrame([(n, n, n, f"{n}.py", r) for n, r in (("login", "controller"), ("svc", "service"), ("store", "repository"), ("helper", "unknown"))], "id string, name string, qualified_name string, file_path string, role string")
    e = edges(spark, [("login", "svc"), ("login", "helper"), ("svc", "store"), ("store", "login")])
    got = graph.beam_search(nodes, e, spark.createDataFrame([("login",)], "entry string"), ["login"]).orderBy("rank").collect()
    assert got[0].path == ["login", "svc", "store"] and got[0].score > got[1].score
    conf = lambda r, b=("high", "high"): one(spark, graph.path_confidence(F.array(*map(F.lit, b)), F.lit(0), F.array(*map(F.lit, r))))
    assert conf(["controller", "service", "repository"]) == "high" and conf(["repository", "service", "controller"]) == "medium" and conf(["controller", "service"], ("low",)) == "low"


def test_merge_is_idempotent(spark):
    old = edges(spark, [("a.py::f", "b.py::g"), ("b.py::g", "c.py::h")])
    part = edges(spark, [("a.py::f", "c.py::h")])
    f = spark.createDataFrame([("a.py",)], "file_path string")
    once = graph.merged(old, part, f, f)
    pairs = lambda d: sorted((r.source, r.target) for r in d.collect())
    assert pairs(once) == [("a.py::f", "c.py::h"), ("b.py::g", "c.py::h")] == pairs(graph.merged(once, part, f, f))


# --- architecture, changes, context, evaluation, streaming ------------------------------


def test_architecture(spark):
    files = spark.createDataFrame([("a/1", "a"), ("a/2", "a"), ("b/1", "b"), ("c/1", "c")], "file_path string, module string")
    e = spark.createDataFrame([("a/1", "a/2"), ("a/1", "b/1"), ("a/2", "b/1"), ("b/1", "a/1")], "source string, target string")
    pairs, names = architecture.module_edges(e, files), files.select("module").distinct()
    assert {r.module: (r.fan_in, r.fan_out) for r in architecture.coupling(pairs, names).collect()} == {"a": (1, 1), "b": (1, 1), "c": (0, 0)}
    assert {r.module: r.cohesion for r in architecture.cohesion(pairs, names).collect()} == {"a": 0.25, "b": 0.0, "c": 1.0}
    t = architecture.totals(pairs, names).first()
    assert (t.module_count, t.cross_edges, t.directed_pairs, round(t.density, 6)) == (3, 3, 2, round(2 / 6, 6))


def test_differential_sync(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, row_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, row_hash string")
    table, counts = changes.differential(old, new, "id")
    assert sorted(map(tuple, table.collect())) == [("a", "1"), ("b", "9"), ("d", "4")]
    assert tuple(counts.first()) == (2, 1, 1)


def test_update_mode():
    assert changes.update_mode({"unchanged": 9}) == "cached"
    assert changes.update_mode({"unchanged": 9, "changed": 1}) == "merge"
    assert changes.update_mode({"unchanged": 1, "changed": 2}) == "full"
    assert changes.update_mode({"unchanged": 9}, forced=True) == "full"
    assert changes.update_mode({"unchanged": 1000, "changed": 33}) == "full"


def test_run_keeps_created_at(spark):
    old = spark.createDataFrame([("r", 1, "x")], "run_id string, created_at int, status string")
    new = spark.createDataFrame([("r", 5, "y"), ("s", 6, "z")], "run_id string, created_at int, status string")
    assert sorted(map(tuple, changes.upserted_run(old, new).collect())) == [("r", 1, "y"), ("s", 6, "z")]


def test_budget_keeps_the_best(spark):
    rows = [(1, "a", 0.9, 1.0, 50), (1, "b", 0.5, 1.0, 100), (1, "c", 0.1, 1.0, 10), (2, "d", 0.1, 1.0, 900)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, priority double, tier double, tokens int")
    assert {r.chunk_id for r in context.within_budget(df, 200).collect()} == {"a", "d"}


def test_review(spark):
    f = spark.createDataFrame([(1, "login is checked", ["a.py:1-2"], ["login"], 0), (2, "x", [], [], 9), (3, "x", ["bad"], [], 9), (4, "x", ["z.py:1-2"], [], 9), (5, "x", ["a.py:1-2"], ["nothing"], 9)], "finding_id int, claim string, citations array<string>, symbols array<string>, step int")
    allowed = spark.createDataFrame([("a.py:1-2", "def login(): pass", False)], "citation string, content string, expanded boolean")
    plan = spark.createDataFrame([(0, "where is login"), (1, "which tables are written")], "step int, question string")
    got = sorted((r.type, r.finding_id) for r in context.review(f, allowed, plan).collect() if r.finding_id) + [r.type for r in context.review(f, allowed, plan).collect() if r.finding_id is None]
    assert got == [("citation_not_in_retrieve", 4), ("malformed_citation", 3), ("missing_citation", 2), ("ungrounded_symbol", 5), "incomplete_plan"]
    assert not context.verdict(context.review(f, allowed, plan)).first().passed


def test_metrics(spark):
    p = spark.createDataFrame([(1, 1, "a.py", 1, 5), (1, 2, "a.py", 20, 30), (2, 1, "b.py", 1, 2)], "query_id int, rank int, file_path string, start_line int, end_line int")
    g = spark.createDataFrame([(1, "a.py", 25, 26), (1, "c.py", 1, 9)], "query_id int, file_path string, start_line int, end_line int")
    q = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    got = {r.query_id: (r.recall, r.precision, r.mrr) for r in evaluation.at_k(p, g, q, evaluation.overlaps("p", "g")).collect()}
    assert got == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    arr = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, evaluation.ordered_coverage(arr("x/a", "b", "c"), arr("a", "c"))) == 1.0
    assert one(spark, evaluation.ordered_coverage(arr("c", "a"), arr("a", "c"))) == 0.5
    assert one(spark, evaluation.set_recall(arr("x/a"), arr("a", "b"))) == 0.5


def test_latency_interpolates(spark):
    s = spark.createDataFrame([("t", float(x)) for x in (1, 2, 3, 10)], "tool string, ms double")
    r = evaluation.latency(s, "tool", "ms").first()
    assert (r.p50, round(r.p95, 6)) == (2.5, 8.95)


def test_debounce_fires_once_a_burst(spark):
    rows = [("r", "2024-01-01 00:00:00", "a"), ("r", "2024-01-01 00:00:01", "b"), ("r", "2024-01-01 00:00:02.5", "c"), ("r", "2024-01-01 00:00:09", "d")]
    e = spark.createDataFrame(rows, "repo string, at string, why string").withColumn("ts", F.to_timestamp("at"))
    got = watch.debounced(e, by="repo", reason="why").orderBy("started").collect()
    assert [(r.n_events, r.reason) for r in got] == [(3, "c"), (1, "d")]


def test_debounce_streams(spark, tmp_path):
    rows = [("r", "2024-01-01 00:00:00", "a"), ("r", "2024-01-01 00:00:01", "b"), ("r", "2024-01-01 00:01:00", "c")]
    e = spark.createDataFrame(rows, "repo string, at string, why string").select("repo", "why", F.to_timestamp("at").alias("ts"))
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = watch.debounced(stream, by="repo", reason="why", late="1 second").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n_events, r.reason) for r in spark.table("bursts").collect()] == [(2, "b")]


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    rows = sorted(want.fetchall(), key=key)
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=key) == rows
