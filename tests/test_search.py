"""Search options, settings, embeddings, strong components, and the stream of bursts."""

import hashlib
import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from loomgraph.functions import settings
from loomgraph.operators import graph, retrieval
from loomgraph.plans.tools import CodeIndex
from loomgraph.streaming import watch

# --- settings --------------------------------------------------------------------


def test_settings(tmp_path):
    at = tmp_path / "s.json"
    at.write_text(json.dumps({"retrieval": {"top_k_bm25": 7, "fusion": "weighted"}, "watch": {"poll_ms": 1}}))
    s = settings.load(settings.Retrieval, "retrieval", at, {"LOOMGRAPH_RETRIEVAL_RERANK": "no", "LOOMGRAPH_RETRIEVAL_TOP_K_BM25": "9", "OTHER": "1"}, final_top_n=3, rrf_k=None)
    assert (s.top_k_bm25, s.fusion, s.rerank, s.final_top_n, s.rrf_k, s.cut) == (9, "weighted", False, 3, 60, 16)
    assert settings.load(settings.Watch, "watch", at, {}).poll_ms == 200 and settings.Watch(debounce_ms=10**9).debounce_ms == 60_000
    assert settings.load(settings.Context, "context", tmp_path / "none.json", {}) == settings.Context()
    for bad in ({"fusion": "x"}, {"final_top_n": 0}, {"unknown": 1}):
        with pytest.raises(ValueError):
            settings.load(settings.Retrieval, "retrieval", None, {}, **bad)
    at.write_text("[]")
    with pytest.raises(ValueError):
        settings.load(settings.Retrieval, "retrieval", at, {})


# --- embeddings ------------------------------------------------------------------


def test_embedding_by_blake2b(spark):
    rows = [(1, "Find the User_id 42 find"), (2, ""), (3, None), (4, "é ü"), (5, "a b " * 3000)]

    def plain(text):
        w = [0.0] * 384
        for t in re.findall(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+", (text or "").lower()):
            h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
            w[h % 384] += 1.0 if (h // 384) % 2 == 0 else -1.0
        size = max(sum(x * x for x in w) ** 0.5, 1e-12)
        return {i: round(x / size, 9) for i, x in enumerate(w) if x}

    got = {i: {} for i, _ in rows}
    for r in retrieval.hash_embedding(spark.createDataFrame(rows, "doc_id int, text string"), digest="blake2b").collect():
        got[r.doc_id][r.idx] = round(r.weight, 9)
    assert got == {i: plain(t) for i, t in rows}


# --- retrieval -------------------------------------------------------------------


def test_retrieved(spark):
    hits = [(1, "a", "bm25", 4.0, 1), (1, "b", "bm25", 2.0, 2), (1, "b", "vector", 0.9, 1), (1, "c", "vector", 0.3, 2)]
    channels = spark.createDataFrame(hits, "query_id int, doc_id string, channel string, score double, rank int")
    info = spark.createDataFrame([("a", "README.md", "markdown", "x", "how"), ("b", "x/b.py", "python", "function", "nothing"), ("c", "x/c.py", "python", "function", "how to load")], "doc_id string, file_path string, language string, kind string, content string").withColumn("query", F.lit("how to load"))
    got = lambda s, mode="hybrid", rerank=None: [r.doc_id for r in retrieval.retrieved(channels, info, s, mode, rerank).orderBy("rank").collect()]
    assert got(settings.Retrieval(), "bm25") == ["b", "a"]  # the README's score is lowered
    assert got(settings.Retrieval(), "vector") == ["b", "c"]
    assert got(settings.Retrieval()) == ["b", "c", "a"]
    assert got(settings.Retrieval(fusion="weighted", weight_vector=0.0, weight_bm25=1.0, final_top_n=1)) == ["a"] or got(settings.Retrieval(fusion="weighted", weight_vector=0.0, weight_bm25=1.0)) [0] == "a"
    assert got(settings.Retrieval(), rerank=retrieval.overlap) == ["c", "a", "b"]
    assert got(settings.Retrieval(rerank=False), rerank=retrieval.overlap) == ["b", "c", "a"]
    assert got(settings.Retrieval(final_top_n=1), rerank=retrieval.overlap) == ["c"]
    with pytest.raises(ValueError):
        retrieval.fused(channels, settings.Retrieval(), "other")


def test_committed_code_index(spark, tmp_path):
    files = {"app/api.py": "from app.repo import load\n\n\ndef handler(x):\n    return load(x)\n", "app/repo.py": "def load(x):\n    return x\n", "web/a.ts": "export function load() {\n  return 1;\n}\n", "README.md": "load load load\n"}
    table = lambda fs: spark.createDataFrame(list(fs.items()), "file_path string, content string")
    index = CodeIndex.from_files(spark, table(files))
    folder = f"file://{tmp_path}/index"
    assert CodeIndex.open(spark, folder) is None
    first = index.commit(folder)
    assert first["files"] == {"written": 4, "deleted": 0, "unchanged": 0} and first["nodes"]["written"] >= 7
    again = CodeIndex.open(spark, folder)
    assert all(c["written"] == c["deleted"] == 0 for c in again.commit(folder).values())
    hits = again.search_code("load", mode="bm25")
    assert [h["file_path"] for h in hits] == [h["file_path"] for h in index.search_code("load", mode="bm25")] and len(hits) >= 3
    assert {h["file_path"] for h in again.search_code("load", language="typescript")} == {"web/a.ts"}
    assert again.search_code("load x", rerank=retrieval.overlap)[0]["file_path"] in ("app/api.py", "app/repo.py")
    changed = dict(files) | {"app/repo.py": "def load(x):\n    return save(x)\n\n\ndef save(x):\n    return x\n"}
    del changed["web/a.ts"]
    counts = again.updated(table(changed)).commit(folder)
    assert counts["files"] == {"written": 1, "deleted": 1, "unchanged": 2} and counts["nodes"]["deleted"] == 2
    now, was = CodeIndex.open(spark, folder), CodeIndex.open(spark, folder, 1)
    assert now.query_dependencies("save")["callers"] == ["app/repo.py::load"] and was.query_dependencies("save")["callers"] == []
    assert "web/a.ts" not in {h["file_path"] for h in now.search_code("load", mode="bm25")}
    from loomgraph.sources.versions import Versions

    kept = Versions(spark, folder)
    edge = kept.read("edges").where("edge_type = 'call' and target like '%save'").first()
    assert [(e.file_path, e.start_line) for e in edge.evidence] == [("app/repo.py", 2)]
    assert [r.ordinal for r in kept.read("chunks").where("file_path = 'app/repo.py'").orderBy("start_line").collect()] == [0, 1]
    assert json.loads(kept.read("nodes").where("kind = 'file'").first().meta)["role"]


# --- cycles ----------------------------------------------------------------------


def plain_strong(edges):
    nodes = sorted({x for e in edges for x in e})
    near = {n: {b for a, b in edges if a == n} for n in nodes}

    def reach(n):
        seen, todo = set(), [n]
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return seen

    far = {n: reach(n) for n in nodes}
    return {frozenset([n, *(m for m in far[n] if n in far[m])]) for n in nodes if n in far[n]} - {frozenset([n]) for n in nodes}


@pytest.mark.parametrize("in_task", [1000, 5])
def test_strong_components(spark, in_task):
    r = random.Random(1)
    edges = [(f"n{r.randrange(15):02d}", f"n{r.randrange(15):02d}") for _ in range(18)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1"), ("x3", "y1"), ("y1", "y2"), ("y2", "y1"), ("z", "z")]
    got: dict = {}
    for x in graph.strong(spark.createDataFrame(edges, "source string, target string"), in_task).collect():
        got.setdefault(x.root, set()).add(x.node)
    assert {frozenset(v) for v in got.values()} == plain_strong(edges)
    assert all(k == min(v) for k, v in got.items())


def test_cycles_of_many_modules(spark):
    """Two thousand modules in layers, and three cycles."""
    edges = [(f"m{i:04d}", f"m{j:04d}") for i in range(2000) for j in (i + 1 + i % 7, i + 3 + i % 11, i + 40) if j < 2000]
    edges += [("m0011", "m0005"), ("a", "b"), ("b", "c"), ("c", "a"), ("c", "m0001"), ("p", "q"), ("q", "p")]
    got = {tuple(x.path) for x in graph.cycles(spark.createDataFrame(edges, "source string, target string")).collect()}
    near: dict = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    want = set()

    def walk(path):
        for y in near.get(path[-1], []):
            if y == path[0]:
                want.add(tuple(path))
            elif y > path[0] and y not in path and len(path) < 6 and (path[0] in ("a", "p") or y <= "m0011"):
                walk([*path, y])

    for s in [f"m{i:04d}" for i in range(12)] + ["a", "p"]:
        walk([s])
    assert got == want and {("a", "b", "c"), ("p", "q"), ("m0005", "m0011")} <= got


# --- bursts ----------------------------------------------------------------------


def test_bursts_survive_a_restart(spark, tmp_path):
    """Each burst is given once, with late events and a query that is stopped and started again."""
    source, seen = tmp_path / "events", []
    source.mkdir()

    def drop(name, rows):
        draft = tmp_path / f"{name}.draft"
        draft.write_text("\n".join(json.dumps({"repo": k, "ts": t, "reason": why}) for k, t, why in rows))
        draft.rename(source / f"{name}.json")

    def start():
        events = spark.readStream.schema("repo string, ts timestamp, reason string").json(f"file://{source}")
        fired = watch.bursts(events, 1500)

        def keep(df, number):
            seen.extend((r.repo, r.n_events, r.reason) for r in df.collect())

        return fired.writeStream.foreachBatch(keep).option("checkpointLocation", f"file://{tmp_path}/check").trigger(processingTime="200 milliseconds").start()

    def wait(q, n, most=90):
        end = time.time() + most
        while len(seen) < n and time.time() < end and q.isActive:
            time.sleep(0.3)

    q = start()
    drop("1", [("a", "2024-01-01T00:00:05", "late one"), ("a", "2024-01-01T00:00:09", "last"), ("b", "2024-01-01T00:00:01", "only")])
    wait(q, 2)
    assert sorted(seen) == [("a", 2, "last"), ("b", 1, "only")]
    # What came before the stop, even long ago by its own clock, is a burst of the query that goes on.
    drop("2", [("a", "2023-01-01T00:00:00", "old")])
    time.sleep(1.0)
    q.stop()
    q = start()
    wait(q, 3)
    time.sleep(2)
    q.stop()
    assert sorted(seen) == [("a", 1, "old"), ("a", 2, "last"), ("b", 1, "only")]


def test_synced_once(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/kept", []
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"repo": "b"}\n{"repo": "a"}\n{"repo": "a"}')
    for check in ("one", "two"):
        rows = spark.readStream.schema("repo string").json(f"file://{tmp_path}/in")
        q = watch.synced(rows, folder, calls.append, f"file://{tmp_path}/{check}", poll_ms=200)
        q.processAllAvailable()
        q.stop()
    # The second query has the same batch number in the folder's table, so it isn't synced again.
    assert calls == [["a", "b"]]
