"""Workflow, reports, records, profile and extension points."""

import json

import numpy as np
import pytest

from loomgraph.functions import models, topics
from loomgraph.operators import profile
from loomgraph.plans import workflow
from loomgraph.plans.tools import CodeIndex
from loomgraph.sources import records


@pytest.fixture(scope="module")
def index(spark):
    files = [("app/api/auth.py", "from app.services.login import sign_in\n\n\ndef login(name):\n    return sign_in(name)\n"), ("app/services/login.py", "def sign_in(name):\n    return name\n")]
    return CodeIndex.from_files(spark, spark.createDataFrame(files, "file_path string, content string"))


def test_topics():
    assert topics.topic("how does login work")[0] == "login"
    assert topics.topic("创建订单的流程")[0] == "order_create"
    assert topics.topic("parse the widget")[1] == ["parse", "widget"]
    assert topics.is_flow("call chain of x") and not topics.is_flow("what is x")
    assert [topics.intent("please refactor"), topics.intent("interview me"), topics.intent("?"), topics.intent("refactor", "summary")] == ["refactor", "interview", "summary", "summary"]


def test_workflow_passes(index):
    state = workflow.run(index, "how does login sign_in work")
    assert state.status == "ok" and len(state.findings) == 3 and not state.issues and state.retries == 0
    assert "## Findings" in workflow.as_markdown(state) and workflow.as_json(state)["status"] == "ok"


def test_workflow_catches_hallucination(index):
    bad = lambda s: [workflow.Finding(1, "made up", ["nowhere.py:1-2"], ["ghost"], 0)]
    state = workflow.run(index, "how does login sign_in work", analyzer=bad)
    assert state.status == "partial" and state.retries == workflow.RETRIES
    assert {"citation_not_in_retrieve", "incomplete_plan"} <= {i["type"] for i in state.issues}
    assert state.findings[0].confidence == "low"


def test_events(index):
    got = [json.loads(e.removeprefix("data: ")) for e in workflow.events(index, "login")]
    assert [g["node"] for g in got] == ["route", "planner", "retrieve", "analyze", "review", "finalize"]


def test_markdown(index):
    assert "login" in workflow.impact_markdown("sign_in", index.analyze_impact("sign_in"))
    assert "Blast radius" in workflow.explore_markdown("login", index.context_explore("login"))
    assert "1. app/api/auth.py::login" in workflow.flow_markdown(index.trace_flow("login"))
    assert "modules" in workflow.architecture_markdown(index.analyze_architecture())


def test_saved_index(index, spark, tmp_path):
    index.save(str(tmp_path), "r1")
    again = CodeIndex.load(spark, str(tmp_path), "r1")
    assert again.query_dependencies("sign_in") == index.query_dependencies("sign_in")
    assert CodeIndex.load(spark, f"{tmp_path}/none", "r1") is None


def test_questions(spark, tmp_path):
    lines = ['# comment', '', json.dumps({"id": "1", "question": "q", "gold_spans": ["a.py:1-2"]}), json.dumps({"id": "2", "question": "q", "gold_spans": [{"file_path": "b.py", "start_line": 3, "end_line": 4}]}), json.dumps({"id": "3", "relevant_citations": ["c.py:5-6"]})]
    (tmp_path / "qa.jsonl").write_text("\n".join(lines))
    got = {r.id: [tuple(s) for s in r.spans] for r in records.questions(spark, f"{tmp_path}/qa.jsonl").collect()}
    assert got == {"1": [("a.py", 1, 2)], "2": [("b.py", 3, 4)], "3": [("c.py", 5, 6)]}


def test_run_store(spark, tmp_path):
    store = records.RunStore(spark, f"{tmp_path}/runs")
    make = lambda i, status, at: spark.createDataFrame([(i, "r", "q", "summary", "{}", True, False, status, "[]", "{}")], records.RUN.rsplit(", ", 1)[0]).selectExpr("*", f"timestamp'{at}' as created_at")
    assert store.list_recent() == []
    store.save(make("a", "ok", "2024-01-01 00:00:00"))
    store.save(make("b", "ok", "2024-01-02 00:00:00"))
    store.save(make("a", "failed", "2024-01-03 00:00:00"))
    assert [r["run_id"] for r in store.list_recent()] == ["b", "a"]
    assert store.get("a")["status"] == "failed" and store.get("a")["created_at"].day == 1 and store.get("z") is None


def test_run_state():
    s = records.RunState()
    s.set("k", {"a": 1})
    s.set("gone", 1, ttl=-1)
    assert s.get("k") == {"a": 1} and s.get("gone") is None
    s.delete("k")
    assert s.get("k") is None


def test_checkout(tmp_path):
    got = records.checkout(str(tmp_path), "/nowhere")
    assert got["local_path"] == str(tmp_path) and got["commit"] == "" and len(got["repo_id"]) == 16
    with pytest.raises(FileNotFoundError):
        records.checkout(f"{tmp_path}/missing", "/nowhere")


def test_profile(spark, tmp_path):
    (tmp_path / "requirements.txt").write_text("fastapi\nredis\npsycopg2\n")
    (tmp_path / "README.md").write_text("hello")
    got = profile.profile(spark, str(tmp_path))
    assert [b["build_system"] for b in got["build_systems"]] == ["pip"] and [f["name"] for f in got["frameworks"]] == ["FastAPI"]
    assert {i["name"] for i in got["infrastructure"]} == {"PostgreSQL", "Redis"}
    assert profile.readme(spark, str(tmp_path)) == "hello"


def test_models(spark):
    e = models.create_embedder("hash", dim=32)
    v = e.embed(["a b", "a b", ""])
    assert np.allclose(v[0], v[1]) and np.isclose(np.linalg.norm(v[0]), 1) and not v[2].any()
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    assert [len(r.embedding) for r in models.embedded(docs, e).collect()] == [32, 32]
    hits = spark.createDataFrame([(1, "x", "find me", "me", 0.1), (1, "y", "find me", "find me", 0.05)], "query_id int, doc_id string, query string, content string, score double")
    assert [r.doc_id for r in models.reranked(hits, models.ratio_rerank, 1).collect()] == ["y"]
    assert [r.doc_id for r in models.reranked(hits, None, 1).collect()] == ["x"]
