"""Small trees in four languages, and the facts they must yield."""

import pytest

from loomgraph.plans.tools import CodeIndex
from loomgraph.sources import code, resolution

FILES = {
    "shop/__init__.py": "VERSION = 1\n",
    "shop/api/auth.py": "from shop.services.login import sign_in as do_sign_in\n\n\ndef login(name):\n    return do_sign_in(name)\n\n\ndef health():\n    return 'ok'\n",
    "shop/services/login.py": "from shop.store.users import UserRepo\n\n\ndef sign_in(name):\n    repo = UserRepo()\n    return repo.find(name)\n",
    "shop/store/users.py": "class Base:\n    pass\n\n\nclass UserRepo(Base):\n    def find(self, name):\n        return name\n",
    "shop/other.py": "def find(x):\n    return x\n\n\ndef show(thing):\n    return thing.find(1)\n",
    "java/pets/Animal.java": "package pets;\n\npublic interface Animal {\n    String sound();\n}\n",
    "java/pets/Dog.java": "package pets;\n\nimport pets.Animal;\n\npublic class Dog implements Animal {\n    private Store store;\n\n    public String sound() {\n        return store.load();\n    }\n}\n",
    "java/pets/Store.java": "package pets;\n\npublic class Store {\n    public String load() {\n        return \"{ load() }\";\n    }\n}\n",
    "web/util.ts": "export function trim(s: string) {\n  return s;\n}\n",
    "web/main.ts": "import { trim } from './util';\n\nexport class Page extends Base {\n  render() {\n    return trim('x');\n  }\n}\n",
    "notes.md": "# nothing to parse\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return root


@pytest.fixture(scope="module")
def index(spark, tree):
    return CodeIndex.build(spark, str(tree))


def test_scan_keeps_source_files(index):
    got = {r.file_path: r.language for r in index.files.collect()}
    assert got["web/main.ts"] == "typescript" and got["java/pets/Dog.java"] == "java"
    assert got["notes.md"] == "markdown" and len(got) == len(FILES)


def test_scan_of_hidden_folders(spark, tmp_path):
    files = {"__tests__/a.js": "let a = 1;\n", "_private/m.py": "x = 1\n", "pkg/__init__.py": "", ".ci/run.PY": "y = 2\n", "node_modules/x.js": "no", "pkg/data.bin": "no", "README.markdown": "# title\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.file_path: (r.language, r.content) for r in code.read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"__tests__/a.js", "_private/m.py", "pkg/__init__.py", ".ci/run.PY", "README.markdown"}
    assert got["README.markdown"] == ("markdown", "# title\n")


def test_definitions(index):
    got = {(r.ref, r.kind) for r in index.definitions.collect()}
    assert {("shop/store/users.py::UserRepo.find", "method"), ("shop/api/auth.py::login", "function"), ("java/pets/Dog.java::Dog.sound", "method"), ("web/main.ts::Page", "class"), ("web/main.ts::Page.render", "method"), ("web/util.ts::trim", "function")} <= got


def test_edges(index):
    got = {(r.edge_type, r.source, r.target) for r in index.edges.collect()}
    assert ("import", "shop/api/auth.py", "shop/services/login.py") in got
    assert ("import", "web/main.ts", "web/util.ts") in got
    assert ("import", "java/pets/Dog.java", "java/pets/Animal.java") in got
    assert ("call", "shop/api/auth.py::login", "shop/services/login.py::sign_in") in got
    assert ("call", "shop/services/login.py::sign_in", "shop/store/users.py::UserRepo.find") in got
    assert ("call", "java/pets/Dog.java::Dog.sound", "java/pets/Store.java::Store.load") in got
    assert ("call", "web/main.ts::Page.render", "web/util.ts::trim") in got
    assert ("inherit", "java/pets/Dog.java::Dog", "java/pets/Animal.java::Animal") in got
    assert ("inherit", "shop/store/users.py::UserRepo", "shop/store/users.py::Base") in got
    # A call with a receiver never binds to a function of that name.
    assert ("call", "shop/other.py::show", "shop/other.py::find") not in got
    sure = {(r.source, r.target): (r.strategy, r.confidence) for r in index.edges.where("edge_type = 'call'").collect()}
    assert sure["shop/other.py::show", "shop/store/users.py::UserRepo.find"] == ("unique_name", 0.6)
    assert sure["shop/api/auth.py::login", "shop/services/login.py::sign_in"] == ("import_map", 0.95)


def test_chunks(index):
    got = {(r.file_path, r.symbol_name): r for r in index.chunks.collect()}
    assert ("shop/store/users.py", "UserRepo.find") not in got
    assert got["shop/store/users.py", "UserRepo"].start_line == 5
    assert "do_sign_in" in got["shop/api/auth.py", "login"].content


def test_tools(index):
    assert index.query_dependencies("sign_in")["callers"] == ["shop/api/auth.py::login"]
    affected = {(r["ref"], r["hops"]) for r in index.analyze_impact("UserRepo.find")["affected"]}
    # show() calls find() on something unknown: the only method of that name is a weaker guess.
    assert affected == {("shop/services/login.py::sign_in", 1), ("shop/other.py::show", 1), ("shop/api/auth.py::login", 2)}
    trace = index.trace_flow("how does login work")
    assert [r["symbol"] for r in trace["cited"]][:2] == ["login", "sign_in"] and trace["cited"][0]["citation"].startswith("shop/api/auth.py:")
    assert trace["confidence"] in ("high", "medium", "low") and isinstance(trace["alternatives"], list)
    assert trace["steps"][:2] == ["shop/api/auth.py::login", "shop/services/login.py::sign_in"]
    hits = index.search_code("sign_in login", top_k=3)
    assert hits[0]["file_path"].startswith("shop/")
    assert {h["symbol_name"] for h in hits[:2]} <= {"login", "sign_in"}
    near = [h for h in index.search_code("health", top_k=1, graph_expand=True) + index.search_code("sign_in", top_k=1, graph_expand=True) if h["reason"]]
    assert near and all(h["reason"].startswith(("calls:", "called_by:")) and h["score"] == 0 for h in near)
    part = index.view_source("shop/api/auth.py", most_chars=70)
    assert part["cut"] and len(part["content"]) <= 70 and part["next_line"] == part["end_line"] + 1
    assert [x["symbol"] for x in part["outline"]] == ["login", "health"]
    rest = index.view_source("shop/api/auth.py", start=part["next_line"])
    assert part["content"] + "\n" + rest["content"] == FILES["shop/api/auth.py"] and rest["next_line"] is None
    assert index.view_source("web/util.ts", symbol="trim")["content"].startswith("export function trim")
    arch = index.analyze_architecture()
    assert arch["totals"]["module_count"] >= 3
    explored = index.context_explore("login sign_in")
    assert all(s["citation"] and s["snippet"] for s in explored["must_read"]) and {p["source"] for p in explored["call_paths"]} >= {"flow_tracer"}
    assert any(h["citation"] for h in explored["blast_radius"])
    assert explored["seeds"] and any(h["relation"] in ("caller", "callee") for h in explored["blast_radius"])
    assert index.get_repo_summary()["n_files"] == len(FILES)
    first = index.get_initial_context()
    assert first["modules"] and first["core_files"] == [x["file_path"] for x in first["excerpts"]]
    assert isinstance(index.suggest_refactor("shop/store/users.py"), list)


def test_comment_is_cosmetic(spark, tree, index):
    changed = dict(FILES)
    changed["shop/other.py"] += "# a comment\n"
    changed["web/util.ts"] = "export function trim(s: string) {\n  return pad(s);\n}\n"
    new = spark.createDataFrame([(k, v) for k, v in changed.items()], "file_path string, content string")
    plan = index.changes(new)
    assert plan["mode"] == "merge"
    assert {r.file_path: r.structural for r in plan["changed"].collect()} == {"shop/other.py": False, "web/util.ts": True}


def test_incremental_equals_full(spark, index):
    changed = dict(FILES)
    changed["shop/api/auth.py"] = changed["shop/api/auth.py"].replace("return 'ok'", "return login('x')")
    new = spark.createDataFrame([(k, v) for k, v in changed.items()], "file_path string, content string")
    a = CodeIndex.from_files(spark, new)
    b = index.updated(new)
    key = lambda x: {(r.edge_type, r.source, r.target) for r in x.edges.collect()}
    assert key(a) == key(b)
    assert ("call", "shop/api/auth.py::health", "shop/api/auth.py::login") in key(b)


def test_fuzzy_ratio(spark):
    names = spark.createDataFrame([("find_user",)], "name string")
    known = spark.createDataFrame([("find_users",), ("remove",)], "name string")
    assert [(r.match, round(r.ratio, 3)) for r in resolution.near_names(names, known).collect()] == [("find_users", 0.947)]
