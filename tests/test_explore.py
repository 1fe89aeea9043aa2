"""What to read first."""

import random

import pytest

from loomgraph.operators import explore, graph, profile

HIT = "query_id int, rank int, score double, file_path string, symbol_name string, start_line int, end_line int, language string, kind string, content string"
EDGE = "source string, target string, edge_type string, relation string, confidence double, line int, ordinal long, strategy string"


def test_seeds(spark):
    rows = [
        (1, 1, 0.9, "docs/a.md", None, 1, 9, "markdown", "doc", "x" * 900),
        (1, 2, 0.8, "app/a.py", "f", 3, 5, "python", "function", None),
        (1, 3, 0.7, "app/a.py", "f", 6, 8, "python", "function", "later"),
        (1, 4, 0.8, "app/b.py", "g", 1, 2, "python", "function", "g"),
        (2, 1, 0.1, "app/c.py", "", 1, 2, "python", "fallback", "c"),
    ]
    got = explore.seeds(spark.createDataFrame(rows, HIT)).orderBy("query_id", "place").collect()
    # Once a symbol, documents down, equal scores in the order of the hits; without a symbol the file.
    assert [(r.query_id, r.ref, r.citation) for r in got] == [(1, "app/a.py::f", "app/a.py:3-5"), (1, "app/b.py::g", "app/b.py:1-2"), (1, "docs/a.md", "docs/a.md:1-9"), (2, "app/c.py", "app/c.py:1-2")]
    assert got[0].score == pytest.approx(0.8 * 1.15 * 1.1) and got[0].snippet == "" and len(got[2].snippet) == explore.SNIPPET
    assert explore.seeds(spark.createDataFrame(rows, HIT), 1).where("query_id = 1").count() == 1
    assert explore.seeds(spark.createDataFrame([], HIT)).count() == 0


def test_call_lines_equal_brute_force(spark):
    rng = random.Random(3)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(40)})
    rows = [(f"m/{a}.py::f{a}", f"m/{b}.py::f{b}", "call", None, 1.0, None if (a + b) % 4 == 0 else 10 * a + b, i, "same_module") for i, (a, b) in enumerate(pairs) if a != b]
    rows += [("m/1.py::f1", "m/9.py::f9", "inherit", "extends", 1.0, 4, 99, None)]
    edges = spark.createDataFrame(rows, EDGE)
    seeds = spark.createDataFrame([("m/1.py::f1",), ("m/2.py::f2",)], "seed string")
    blast = graph.blast_radius(edges, seeds, 2)
    hits = {(r.seed, r.ref, r.relation): r.hops for r in blast.collect()}
    near = {}
    for (seed, ref, relation), hops in hits.items():
        near[seed, seed] = 0
        if relation != "extends":
            near[seed, ref] = min(hops, near.get((seed, ref), 9))
    line = {(a, b): n for a, b, t, _, _, n, _, _ in rows if t == "call" and n is not None}
    want = {}
    for (seed, ref, relation), hops in hits.items():
        of = lambda v: (ref, v) if relation == "caller" else (v, ref)  # noqa: B023, E731
        ways = sorted((at, via) for (s, via), at in near.items() if s == seed and at < hops and relation in ("caller", "callee") and of(via) in line)
        call = of(ways[0][1]) if ways else None
        want[seed, ref, relation] = f"{call[0].split('::')[0]}:{line[call]}-{line[call]}" if call else None
    got = {(r.seed, r.ref, r.relation): r.citation for r in explore.with_call_lines(blast, edges).collect()}
    assert got == want and any(got.values()) and not all(got.values())


def test_entry_points_and_core_files(spark):
    node = "id string, kind string, name string, qualified_name string, file_path string"
    rows = [
        ("file:b/Main.py", "file", "Main.py", "b/Main.py", "b/Main.py"),
        ("sym:a/x.java::ShopApp", "class", "ShopApp", "a/x.java::ShopApp", "a/x.java"),
        ("sym:a/x.java::Apple", "class", "Apple", "a/x.java::Apple", "a/x.java"),
        ("sym:c/y.py::main", "function", "main", "c/y.py::main", "c/y.py"),
        ("sym:c/y.py::K.main", "method", "main", "c/y.py::K.main", "c/y.py"),
        ("sym:nowhere::main", "function", "main", "nowhere::main", None),
    ]
    nodes = spark.createDataFrame(rows, node)
    entries = explore.entry_points(nodes)
    assert [(r.entry, r.place) for r in entries.orderBy("place").collect()] == [("a/x.java::ShopApp", 1), ("b/Main.py", 2), ("c/y.py::main", 3)]
    assert explore.entry_points(nodes, 1).count() == 1 and explore.entry_points(nodes.limit(0)).count() == 0
    files = spark.createDataFrame([("a/x.java", "a", "class"), ("b/Main.py", "b", ""), ("c/y.py", "c", "y"), ("d/one.py", "d", "one"), ("d/two.py", "d", "two"), ("e/z.py", "e", None)], "file_path string, module string, content string")
    modules = spark.createDataFrame([("a", 1.0), ("d", 9.0), ("e", 5.0)], "module string, coupling double")
    core = [(r.file_path, r.reason) for r in explore.core_files(entries, modules, files, 6).orderBy("place").collect()]
    assert core == [("a/x.java", "entrypoint"), ("c/y.py", "entrypoint"), ("d/one.py", "high_coupling_module")]


@pytest.mark.parametrize("text", [None, "", "a\n", "a\r\nb\rc d\x85e", "\n" * 151, "\n" * 150, "x" * 6001, "é" * 6000, "line\n" * 400])
def test_excerpts(spark, text):
    own = text or ""
    got = explore.excerpts(spark.createDataFrame([("f", text)], "file_path string, content string")).first()
    assert got.excerpt == "\n".join(own.splitlines()[:150])[:6000]
    assert got.cut == (len(own.splitlines()) > 150 or len(own) > 6000)


def test_limits_of_manifests_and_configurations_are_apart(spark):
    rows = [(f"m{i:03}/pom.xml", "pom.xml") for i in range(90)] + [(f"z{i:03}/application.yml", "application.yml") for i in range(50)] + [("node_modules/a/package.json", "package.json"), ("a/.git/compose.yaml", "compose.yaml")]
    got = [r.name for r in profile.chosen(spark.createDataFrame(rows, "file_path string, name string")).collect()]
    assert got.count("pom.xml") == profile.MANIFESTS and got.count("application.yml") == profile.MOST_CONFIGS and len(got) == 120
