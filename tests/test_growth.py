"""Work that must not be done again and again, or by pairs, as the tables grow."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import ids, roles
from loomgraph.operators import architecture, evaluation, flow, graph, postings, retrieval
from loomgraph.plans import queries

DATA = str(Path("/root/testdata/sf0.001"))


@pytest.mark.parametrize("name", ["architecture_totals", "module_coupling", "coupling_findings", "module_cohesion"])
def test_calls_are_counted_once(spark, name):
    """What follows the counts by files doesn't read the line items again."""
    assert not [f for f in queries.QUERIES[name](spark, DATA).inputFiles() if "lineitem" in f]


def test_counted_edges(spark):
    files = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "k")], "file_path string, module string")
    edges = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("x", "a")], "source string, target string")
    want = [("m", "k", 1), ("m", "m", 2)]
    counted = edges.groupBy("source", "target").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, architecture.module_edges(edges, files).collect())) == want
    assert sorted(map(tuple, architecture.module_edges(counted, files).collect())) == want


@pytest.fixture
def texts_asked(spark):
    words = ["alpha", "beta", "gamma", "delta", "eps_1", "7"]
    rows = [(i, " ".join(words[(i * j) % 6] for j in range(i % 9)), i % 13) for i in range(300)] + [(1000 + i, "alpha beta", 5) for i in range(80)] + [(2000, None, 1)]
    asked = [(1, "Alpha beta beta"), (2, "gamma 7 nothing"), (3, "none of these"), (4, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3), spark.createDataFrame(asked, "query_id int, text string")


def ranked(df):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in df.collect())


def test_best_without_pairs(spark, texts_asked, monkeypatch):
    """The best of tasks are those of all pairs, with many ties, however small the slices are."""
    monkeypatch.setattr(retrieval, "SLICE_TOKENS", 40)
    docs, asked = texts_asked
    index = retrieval.bm25_index(docs, keep=("n",))
    pairs = retrieval.bm25_scores(index, asked).withColumn("score", F.round("score", 6)).where("score > 0")
    assert ranked(retrieval.bm25_best(index, asked, 7, 6)) == ranked(retrieval.top_k(pairs, 7))
    sizes = pairs.drop("score").join(docs.select("doc_id", F.col("n").cast("double").alias("score")), "doc_id")
    assert ranked(retrieval.bm25_best(index, asked, 7, by="n")) == ranked(retrieval.top_k(sizes, 7))
    of = retrieval.hash_embedding(asked, doc_id="query_id").withColumnRenamed("doc_id", "query_id")
    pairs = retrieval.sparse_scores(retrieval.hash_embedding(docs), of).withColumn("score", F.round("score", 6)).where("score > 0")
    assert ranked(retrieval.embedding_best(docs, asked, 7, 6)) == ranked(retrieval.top_k(pairs, 7))


def test_rounded():
    assert retrieval.rounded(retrieval.np.array([0.5, 1.5, -0.5, 2.4, 0.125]), 0).tolist() == [1, 2, -1, 2, 0]
    assert retrieval.rounded(retrieval.np.array([0.125, -0.125]), 2).tolist() == [0.13, -0.13]


def test_windows_go_without_texts(spark, monkeypatch):
    """What is kept of matching windows is ids, and what it leads to is verified."""
    kept = []
    monkeypatch.setattr(evaluation, "written", lambda df, name: kept.append(df.columns) or df, raising=False)
    docs = spark.createDataFrame([(1, "x a b c d e f g y"), (2, "b c d e f only"), (3, "a b c d e f g")], "doc_id long, text string")
    asked = spark.createDataFrame([("q", "a b c d e f g")], "query_id string, text string")
    assert sorted(r.doc_id for r in evaluation.containing(docs, asked).collect()) == [1, 3]
    assert kept == [["query_id", "doc_id"]]


def test_blocks_are_made_in_their_segment(spark):
    """A segment's postings become blocks, and lose places, without a row and a shuffle for each."""
    docs = spark.createDataFrame([(0, ["b", "a", "b"]), (127, ["b"]), (128, ["a"]), (130, [])], "ord long, t array<string>")
    blocks = postings._encoded(docs, 2.0)
    flat = lambda df: sorted((r.term, r.segment, r.n, r.gaps, r.tfs, r.dls) for r in df.collect())
    assert flat(blocks) == [("a", 0, 1, [0], [1], [3]), ("a", 1, 1, [0], [1], [1]), ("b", 0, 2, [0, 127], [2, 1], [3, 1])]
    lost = spark.createDataFrame([(0, [0])], "segment long, lost array<int>")
    assert flat(postings._without(blocks.join(lost, "segment"), 2.0)) == [("b", 0, 1, [127], [1], [1])]


def test_index_without_texts_on_disk(spark, tmp_path, monkeypatch):
    """Neither texts nor tokens are sorted, shuffled or written: a segment is packed where its documents are read."""
    seen, real = {}, postings.written
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    def keep(df, name, **options):
        table = real(df, name, **options)
        seen[name] = df.columns, shuffles(df), table.agg(F.count("*"), F.countDistinct(df.columns[0])).first(), table.inputFiles()
        return table

    monkeypatch.setattr(postings, "written", keep)
    monkeypatch.setattr(postings, "SEGMENT_BITS", 3)
    monkeypatch.setattr(postings, "SORTED_SEGMENTS", 1, raising=False)
    monkeypatch.setattr(postings, "BUCKETS", 2)
    # Ids out of order, many ties, a segment in several batches, and segments without a term.
    rows = [(f"d{i * 37 % 101:03}", "same words Same" if i % 3 else f"own{i} + words") for i in range(101)] + [("e1", None), ("e2", " ")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    docs = docs.unionByName(spark.createDataFrame([(f"f{i}", "") for i in range(20)], "doc_id string, text string").coalesce(1))
    asked = spark.createDataFrame([(1, "same"), (2, "words +"), (3, "own3 own6 none")], "query_id int, text string")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        index = postings.Postings.build(f"file://{tmp_path}/kept", docs)
        pairs = retrieval.bm25_scores(retrieval.bm25_index(docs), asked).withColumn("score", F.round("score", 6)).where("score > 0")
        assert ranked(index.search(asked, 7, 6, first=2)) == ranked(retrieval.top_k(pairs, 7))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    # Equal texts tie in each segment; its postings and documents meet no other's.
    assert index.table("docs").count() == index.table("docs").select("ord").distinct().count() == 123
    assert not [name for name, (columns, *_) in seen.items() if {"t", "text"} & set(columns)]
    # A row a segment; the only shuffle is the one that dealt the documents out above.
    columns, n, (rows, segments), files = seen["packed"]
    assert columns[0] == "segment" and n == shuffles(docs) and rows == segments
    # What was packed is gone once it is committed.
    assert files and not [f for f in files if Path(f.removeprefix("file:")).exists()]


def test_nearest_without_pairs(spark, monkeypatch):
    """Products of slices give what all pairs give, with ties."""
    monkeypatch.setattr(retrieval, "SLICE_CELLS", 16)
    rows = [(i, [float(i % 7), float(i % 5) - 2, 1.0]) for i in range(120)] + [(500, None), (501, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    q = v.where("vec_id % 40 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    pairs = retrieval.cosine_scores(v, q).withColumn("score", F.round("score", 6))
    of = lambda df: sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())
    assert of(retrieval.cosine_best(v, q, 9, 6)) == of(retrieval.top_k(pairs, 9, item="vec_id"))


def test_nodes_read_the_calls_once(spark):
    """Definitions, files and shadows come from one written table of symbols."""
    assert not [f for f in queries._nodes(spark, DATA).inputFiles() if "lineitem" in f]


def test_nodes_by_known_ends(spark):
    files = spark.createDataFrame([("a.py", "python")], "file_path string, language string")
    defs = spark.createDataFrame([("a.py", "f", "function", 1, 2, "python", None)], "file_path string, name string, kind string, start_line int, end_line int, language string, parent_name string")
    edges = spark.createDataFrame([("call", "a.py::f", "b.py::C.m"), ("call", "b.py::C.m", "a.py::f"), ("import", "a.py", "c.py")], "edge_type string, source string, target string")
    ends = edges.where("edge_type = 'call'").select(F.explode(F.array("source", "target")).alias("ref")).distinct()
    want = sorted(map(str, graph.knowledge_nodes(files, defs, edges).collect()))
    assert len(want) == 3 and sorted(map(str, graph.knowledge_nodes(files, defs, ends=ends).collect())) == want


def test_parts_of_refs(spark):
    refs = ["a.py::C.m", "a.py::f", "a::b::c.d", "x\ny::p\nq.r\ns", "plain", "a.b", "::", "a::.", "", None]
    got = spark.createDataFrame([(r,) for r in refs], "r string").select("r", ids.ref_symbol(F.col("r")), ids.ref_short(F.col("r")))
    assert {r: (s, t) for r, s, t in got.collect()} == {r: (None, None) if r is None else ((s := r.partition("::")[2]), s.rpartition(".")[2]) for r in refs}


def test_first_edges_without_sorts(spark):
    """The first edge of each key is whole, and no edges are sorted for it."""
    rows = [("call", "a", "b", None, 0.5, 7), ("call", "a", "b", None, None, 3), ("call", "a", "b", "x", 0.1, 9), ("call", "a", "b", "x", 0.2, None), ("import", "a", "b", None, 0.3, 1)]
    edges = spark.createDataFrame(rows, "edge_type string, source string, target string, relation string, confidence double, ordinal long")
    got = graph.deduplicated(edges)
    assert got.columns == edges.columns and sorted(map(str, got.collect())) == sorted(str(r) for r in edges.collect() if r.ordinal in (3, None, 1))
    plan = queries.QUERIES["deduplicated_edges"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "Sort" not in plan and "Window" not in plan


def test_scores_compute_names_once(spark):
    """A score's parts don't repeat what they share, so that its expression grows with the terms only."""
    said = str(flow.name_score(F.col("name"), F.col("qualified_name"), ["a", "b", "c"]))
    assert said.count("concat_ws") == 1 and str(flow.path_term_score(F.col("file_path"), ["a", "b", "c"])).count("replace") == 1


def test_roles_match_only_what_may(spark):
    """Names without any of the words have no role; with one, the patterns decide as before."""
    words = ["UserController", "controllers", "useCACHE", "Cache2", "x", "", "myRepo", "Repos", "a/rest/b.py", "a/endpoint/x.py", "a/repositorie/x.py", "REPOSITORIES/y.py", "a/mqx/OrderDao.java", "Store\n", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    p, w = F.replace("w", F.lit("\\"), F.lit("/")), F.col("w")
    plain = [roles._first(w, roles.NAMES), F.coalesce(roles._first(p, roles.PATHS), roles._first(roles.stem(p), roles.NAMES))]
    rows = df.select(roles.by_name(w).alias("a"), roles.by_path(w).alias("b"), plain[0].alias("c"), plain[1].alias("d")).collect()
    assert [(r.a, r.b) for r in rows] == [(r.c, r.d) for r in rows] and len({r.b for r in rows}) > 3
    assert "controller" in roles._words(roles.NAMES) and "endpoint" in roles._words(roles.PATHS)


def plain_beam(nodes, calls, entries, term, depth, width=4, branching=8, most=3):
    """The search in lists, for nodes without roles."""
    topic = {n: 1.0 if name == term else 0.85 if term in name else 0.0 for n, name in nodes.items()}
    order = lambda p: (-p[1], len(p[0]), p[0][-1], p[0])
    out = []
    for entry in entries:
        beam, ended = [([entry], 0.5 + 0.2 * topic[entry], [topic[entry]])] if entry in nodes else [], []
        for _ in range(depth):
            new = []
            for path, score, seen in beam:
                steps = []
                for source, target, confidence in calls:
                    if source == path[-1] and target in nodes and nodes[target] not in graph.NOISE:
                        c = 1.0 if confidence is None else confidence
                        steps.append((0.35 + (0.25 if c >= 0.85 else 0.1 if c >= 0.55 else -0.15) + 0.3 * topic[target], target))
                steps = sorted(steps, key=lambda s: (-s[0], s[1]))[:branching]
                more = [([*path, t], score + s, [*seen, topic[t]]) for s, t in steps if t not in path]
                if not more and len(path) > 1:
                    ended.append((path, score, seen))
                new += more
            beam = sorted(new, key=order)[:width]
        every = {tuple(p): (p, s + (0.15 * min(sum(t >= 0.5 for t in seen), 3) + (0.15 if 3 <= len(p) <= 5 else 0.0))) for p, s, seen in ended + [b for b in beam if len(b[0]) > 1]}
        out += [(entry, p, round(s, 6), i + 1) for i, (p, s) in enumerate(sorted(every.values(), key=order)[:most])]
    return sorted(out)


@pytest.mark.parametrize("sent, table", [(0, True), (1 << 20, True), (1 << 20, False)])
def test_paths_take_only_calls_of_their_ends(spark, monkeypatch, sent, table):
    """Rounds hold the calls and nodes that paths can go on with, however these are chosen, and find the same paths."""
    kept, real = {}, graph.written
    monkeypatch.setattr(graph, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    monkeypatch.setattr(graph, "REFS_SENT", sent, raising=False)
    ref = [f"p{i % 5}.py::S{i % 3}.go{i}" for i in range(40)]
    nodes = {r: "log" if i == 7 else r.split(".")[-1] for i, r in enumerate(ref) if i % 11 != 5}
    # From the first 30 to any; the last ten call one another, and nothing leads there from an entry.
    calls = {(i, (i * j + j) % 30): (0.5, 0.6, 0.9, None)[(i + j) % 4] for i in range(30) for j in range(1, 2 + i % 11)}
    calls = [(ref[a], ref[b], c) for (a, b), c in calls.items()]
    far = [(ref[i], ref[30 + (i + 1) % 10], 0.9) for i in range(30, 40)]
    entries = [*ref[0:27:3], ref[29], "nowhere.py::x"]
    n = spark.createDataFrame([(r, m, r, r.split("::")[0], "unknown") for r, m in nodes.items()], "id string, name string, qualified_name string, file_path string, role string")
    e = spark.createDataFrame([("call", *c) for c in calls + far], "edge_type string, source string, target string, confidence double")
    starts = spark.createDataFrame([(x,) for x in entries], "entry string")
    want = plain_beam(nodes, calls + far, entries, "go1", 3)
    given = n if table else lambda refs: n.join(refs, n["id"] == refs["ref"], "left_semi")
    got = graph.beam_search(given, e, starts, ["go1"], 3).collect()
    assert sorted((r.entry, r.path, round(r.score, 6), r.rank) for r in got) == want and len(want) > 20
    met = lambda part, column: {r[column] for name, df in kept.items() if name.startswith(part) for r in df.collect()}
    assert met("beam-calls", "source") and not met("beam-calls", "source") & set(ref[30:])
    assert table or met("beam-nodes", "id") and not met("beam-nodes", "id") & set(ref[30:])


def test_flow_paths_choose_calls_where_they_are_read(spark, monkeypatch):
    """Line items of no path's end go before they are made distinct, and nodes aren't made of all symbols."""
    plans, real = {}, graph.written

    def keep(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return real(df, name)

    monkeypatch.setattr(graph, "written", keep)
    monkeypatch.setattr(queries, "written", keep)
    queries.QUERIES["flow_paths"](spark, DATA)
    for plan in (plans.get(f"beam-calls-{d}", "") for d in range(3)):
        assert 0 <= plan.find("Aggregate") < plan.find("LeftSemi")
    assert "symbols" not in plans and not [n for n, plan in plans.items() if "nodes" in n and "l_orderkey" in plan]
