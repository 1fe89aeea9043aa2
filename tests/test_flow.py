"""Entries, steps and lookups, by hand and against plain versions."""

import pytest

from loomgraph.functions import texts, topics
from loomgraph.operators import evaluation, flow, retrieval

NODE = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, parent_id string, role string"
EDGE = "edge_type string, source string, target string, confidence double, ordinal long"


def node(path, symbol, kind="function", role="unknown", line=1, parent=None):
    return (f"sym:{path}::{symbol}", kind, symbol.split(".")[-1], f"{path}::{symbol}", path, line, None if line is None else line + 3, "python", parent, role)


NODES = [
    node("app/api/auth.py", "login", role="controller"),
    node("app/services/login.py", "login", role="service"),
    node("app/services/login.py", "get_login", role="service"),
    node("app/store/users.py", "UserRepo", "class", "repository"),
    node("app/store/users.py", "UserRepo.find", "method", "repository", parent="sym:app/store/users.py::UserRepo"),
    node("app/store/users.py", "UserRepo.UserRepo", "method", "repository", parent="sym:app/store/users.py::UserRepo"),
    node("app/health.py", "health"),
    node("app/broker.py", "publish", role="mq", line=None),
]
CALLS = [("call", "app/api/auth.py::login", "app/services/login.py::login", 0.9, 1), ("call", "app/services/login.py::login", "app/store/users.py::UserRepo.find", 0.9, 2), ("import", "a.py", "b.py", 1.0, 3)]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(NODES, NODE)


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(CALLS, EDGE)


def test_entries_prefer_the_controller(nodes, edges):
    got = flow.entries(nodes, edges, ["login", "auth"]).orderBy("position").collect()
    assert got[0].qualified_name == "app/api/auth.py::login" and got[0].role == "controller"
    # Constructors and demoted names are no entries; without any match there is none.
    assert not {"UserRepo.UserRepo", "health"} & {r.qualified_name.split("::")[1] for r in got}
    assert flow.entries(nodes, edges, ["zzz"]).count() == 0


def test_entry_scores_add_up(nodes, edges):
    got = {r.qualified_name: r.score for r in flow.scored_entries(nodes, edges, ["login"]).collect()}
    # whole name, request layer, controller, callable with a handler's name and no callers
    assert got["app/api/auth.py::login"] == pytest.approx(0.35 + 0.25 * 0.40 + 0.20 + 0.05)
    assert got["app/services/login.py::login"] == pytest.approx(0.35 + 0.25 * 0.75 + 0.20 * 0.55 + 0.05 * 0.95)
    assert got["app/services/login.py::get_login"] == pytest.approx(0.35 * (0.85 - 0.12) + 0.25 * 0.75 + 0.20 * 0.55 + 0.05 * 1.0)


def test_hint_and_method_promotion(nodes, edges):
    hinted = flow.entries(nodes, edges, [], hint="UserRepo.find").orderBy("position").first()
    assert hinted.qualified_name == "app/store/users.py::UserRepo.find"
    classes = nodes.where("kind = 'class' or parent_id is not null")
    promoted = flow.entries(classes, edges, ["userrepo", "find"]).orderBy("position").first()
    assert promoted.qualified_name == "app/store/users.py::UserRepo.find"


def test_retrieval_boosts(spark, nodes):
    hits = spark.createDataFrame([(1, "docs/a.md", "login"), (2, "app/api/auth.py", "login"), (3, "app/store/users.py", "find"), (4, "app/health.py", None), (13, "app/broker.py", None)], "rank int, file_path string, symbol_name string")
    got = {r.id.split("::")[1]: round(r.boost, 2) for r in flow.retrieval_boosts(nodes, hits).collect()}
    assert got == {"login": 0.93, "UserRepo.find": 0.86, "health": 0.79}


def test_steps_end_in_a_store(spark, nodes):
    path = ["sym:app/api/auth.py::login", "sym:app/services/login.py::login", "sym:app/store/users.py::UserRepo.find"]
    found = spark.createDataFrame([(1, path), (2, ["sym:app/broker.py::publish"]), (3, ["sym:gone::x"])], "path_id int, path array<string>")
    got = {(r.path_id, r.step): r for r in flow.steps(found, nodes).collect()}
    assert [got[1, k].symbol for k in (1, 2, 3, 4)] == ["login", "login", "UserRepo.find", "Database / persistent store"]
    assert got[1, 4].citation == got[1, 3].citation == "app/store/users.py:1-4" and got[1, 4].confidence == "medium"
    assert got[1, 2].edge == f"call:{path[0]}->{path[1]}" and got[1, 1].edge is None
    assert got[2, 1].problem == "missing_location:publish" and got[2, 2].symbol == "Message queue"
    assert got[3, 1].reason == "missing_node" and got[3, 1].confidence == "low"


def test_topics_widen_by_aliases():
    topic, terms = topics.topic("How does the Scheduler dispatch?")
    assert topic == "task_schedule" and "cron" in terms and "workflow" not in terms
    assert topics.is_flow("what is a login") and not topics.is_flow("login form")


def test_words_of_questions(spark):
    text = "The Main idea: find Foo_bar, foo_bar and Foo_bar in app/x.py?"
    one = spark.createDataFrame([(text,)], "t string").select(texts.keywords("t").alias("k"), texts.short_query("t", 4).alias("s")).first()
    assert one.k == ["idea", "Foo_bar", "foo_bar", "app"] and one.s == "The Main idea find"


def test_containing(spark):
    docs = {1: "x one two three four five six seven eight y", 2: "one two three four five six seven", 3: "two three", 4: "aone two three four five six seven eightb", 5: None}
    asked = {10: "one two three four five six seven eight", 11: "two three", 12: "nothing of it is here at all"}
    got = evaluation.containing(spark.createDataFrame(list(docs.items()), "doc_id int, text string"), spark.createDataFrame(list(asked.items()), "query_id int, text string"))
    assert sorted((r.query_id, r.doc_id) for r in got.collect()) == sorted((q, d) for q, t in asked.items() for d, x in docs.items() if x and t in x)


def test_scores_need_only_asked_terms(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, ""), (3, None)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "b b zzz")], "query_id int, text string")
    assert {r.doc_id for r in retrieval.bm25_scores(retrieval.bm25_index(docs), q).collect()} <= {1}
