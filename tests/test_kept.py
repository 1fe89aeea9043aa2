"""Kept indexes and versioned tables: what is read back equals what a scan gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import cells, postings, retrieval
from loomgraph.sources.versions import Conflict, Versions


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/kept"


# --- versions ------------------------------------------------------------------


def test_versions(spark, folder):
    rows = lambda xs: spark.createDataFrame(xs, "id long, meta map<string,string>, n int").withColumn("meta", F.to_json("meta"))
    kept = Versions(spark, folder)
    assert kept.latest() == 0 and kept.read("nodes") is None
    one = [(i, {"b": "x", "a": None}, i % 3) for i in range(40)]
    assert kept.sync({"nodes": (rows(one), ["id"])}, buckets=8)["nodes"] == {"written": 40, "deleted": 0, "unchanged": 0}
    old = kept.read("nodes")
    assert kept.sync({"nodes": (rows(one), ["id"])})["nodes"] == {"written": 0, "deleted": 0, "unchanged": 40} and kept.latest() == 1
    two = [*one[:20], (20, {"b": "y"}, None), *one[22:], (99, None, 1), (99, None, 1)]
    got = kept.sync({"nodes": (rows(two), ["id"]), "edges": (rows([]), ["id"])})
    assert got == {"nodes": {"written": 2, "deleted": 1, "unchanged": 38}, "edges": {"written": 0, "deleted": 0, "unchanged": 0}}
    assert kept.read("edges").count() == 0
    assert {r.id for r in kept.read("nodes").collect()} == {*range(21), *range(22, 40), 99} and kept.read("nodes").count() == 40
    # Who reads the version before still can, and a part of the table is only that.
    assert old.count() == 40 and kept.read("nodes", 1).where("id = 21").count() == 1
    assert 0 < kept.read("nodes", buckets=[0, 1]).count() < 40
    # Untouched buckets are the same folders.
    a, b = (kept.manifest(v)["tables"]["nodes"]["folders"] for v in (1, 2))
    assert 0 < sum(a[k] == b.get(k) for k in a) < len(a)
    # Of two commits from one version the second fails, and nothing of it is read.
    stale = kept.manifest(1)
    with pytest.raises(Conflict):
        kept.commit({"nodes": (rows(one).withColumn("__bucket", F.lit(0)), None, 1, ["id"])}, stale)
    assert kept.latest() == 2 and kept.read("nodes").count() == 40
    # Other columns make another table.
    assert kept.sync({"nodes": (rows(two).drop("n"), ["id"])})["nodes"]["written"] == 40
    assert kept.vacuum(1) > 0 and kept.read("nodes").count() == 40 and kept.read("nodes").columns == ["id", "meta", "row_hash"]


# --- postings ------------------------------------------------------------------


def texts(n, seed=1):
    r = random.Random(seed)
    common = [f"w{i}" for i in range(30)]
    return [(i, " ".join(r.choices(common, k=r.randrange(5, 30)) + [f"rare{r.randrange(n)}" for _ in range(4)] + ["hot"] * (9 if i // 8 == 7 else i % 3 == 0))) for i in range(n)]


def plain(spark, docs, queries, k):
    scores = retrieval.bm25_scores(retrieval.bm25_index(docs), queries).withColumn("score", F.round("score", 6)).where("score > 0")
    return {(r.query_id, r.rank): (r.doc_id, r.score) for r in retrieval.top_k(scores, k).collect()}


def found(df):
    return {(r.query_id, r.rank): (r.doc_id, r.score) for r in df.collect()}


def test_postings(spark, folder, monkeypatch):
    monkeypatch.setattr(postings, "SEGMENT_BITS", 3)
    rows = texts(400)
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "w1 w1 w1")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "rare7 rare9 W1"), (2, "rare11 rare12"), (3, "nothing here"), (4, "w1 w2 w2 rare50"), (5, "")], "query_id long, text string")
    want = plain(spark, docs.fillna(""), queries, 5)
    index = postings.Postings.build(folder, docs)
    assert found(postings.Postings(spark, folder).search(queries, 5, 6, first=2)) == want
    hot, reads = spark.createDataFrame([(6, "hot rare7")], "query_id long, text string"), []
    assert found(index.search(hot, 5, 6, first=8, reads=reads)) == plain(spark, docs.fillna(""), hot, 5)
    assert reads[0] < 0.3 * reads[1] < 0.2 * reads[2]
    # Changed, deleted and added documents; buckets without any stay.
    changed = [(i, t if i % 40 else "rare7 new text w1") for i, t in rows if i % 90 != 5] + [(2000 + i, t) for i, t in texts(9, 5)]
    now = spark.createDataFrame(changed, "doc_id long, text string")
    new = index.updated(now)
    assert new.kept.latest() == 2 and found(new.search(queries, 5, 6, first=2)) == plain(spark, now, queries, 5)
    fresh = postings.Postings.build(folder + "-again", now)
    key = lambda x: {(r.term, r.df) for r in x.table("blocks").groupBy("term").agg(F.sum("n").alias("df")).collect()}
    assert key(fresh) == key(new) and abs(fresh.table("totals").first().mean_raw - new.table("totals").first().mean_raw) < 1e-9
    a, b = (new.kept.manifest(v)["tables"]["blocks"]["folders"] for v in (1, 2))
    assert any(a[k] == b.get(k) for k in a)
    assert new.updated(now) is new
    # The version before is still searched as it was.
    assert found(postings.Postings(spark, folder, 1).search(queries, 5, 6)) == want


def test_postings_of_nothing(spark, folder):
    none = spark.createDataFrame([], "doc_id string, text string")
    asked = spark.createDataFrame([(1, "a b")], "query_id int, text string")
    index = postings.Postings.build(folder, none)
    assert index.search(asked).count() == 0
    more = index.updated(spark.createDataFrame([("x", "a b c"), ("y", "d e"), ("z", "f")], "doc_id string, text string"))
    assert [r.doc_id for r in more.search(asked).collect()] == ["x"]
    with pytest.raises(FileNotFoundError):
        postings.Postings(spark, folder + "-none")


# --- cells -----------------------------------------------------------------------


def test_cells(spark, folder):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + r.normal(size=8) * 0.2).tolist()) for i in range(600)] + [(700, [0.0] * 8), (701, None), (702, rows0 := centres[0].tolist()), (703, rows0)]
    schema = "vec_id long, v array<double>"
    vectors = spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(i, rows[i][1]) for i in (0, 5, 77)] + [(9, [0.0] * 8), (10, None)], "query_id long, query array<double>")

    def scan(df):
        scores = retrieval.cosine_scores(df.where("v is not null"), asked.where("query is not null"), vector="v").withColumn("score", F.round("score", 6))
        return {(x.query_id, x.rank): (x.vec_id, x.score) for x in retrieval.top_k(scores, 7, item="vec_id").collect()}

    got = lambda df: {(x.query_id, x.rank): (x.vec_id, x.score) for x in df.collect()}
    store = cells.Cells.build(folder, vectors)
    reads = []
    assert got(cells.Cells(spark, folder).search(asked, 7, 6, reads=reads)) == scan(vectors)
    assert reads[0] < reads[1]
    only = asked.where("query_id < 9")
    reads = []
    store.search(only, 7, 6, reads=reads)
    assert reads[0] < 0.5 * reads[1]
    new = spark.createDataFrame([(3, rows[5][1]), (900, rows[0][1]), (77, None)], schema)
    gone = spark.createDataFrame([(12,), (5,)], "vec_id long")
    after = store.upserted(new, gone)
    now = spark.createDataFrame([x for x in rows if x[0] not in (3, 77, 12, 5)] + [(3, rows[5][1]), (900, rows[0][1])], schema)
    assert got(after.search(asked, 7, 6)) == scan(now)
    a, b = (after.kept.manifest(v)["tables"]["vectors"]["folders"] for v in (1, 2))
    assert any(a[k] == b.get(k) for k in a)


def test_cells_of_nothing(spark, folder):
    none = spark.createDataFrame([], "vec_id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<double>")
    store = cells.Cells.build(folder, none)
    assert store.search(asked).count() == 0
    assert [x.vec_id for x in store.upserted(spark.createDataFrame([(4, [2.0, 0.0])], "vec_id long, v array<double>")).search(asked).collect()] == [4]
