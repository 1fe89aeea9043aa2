"""Resolution by equal joins, against nested loops."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from loomgraph.plans.tools import CodeIndex
from loomgraph.sources import code, resolution


def stem(p):
    return p.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def keys_of(p):
    plain = p.rsplit(".", 1)[0] if "." in p.rsplit("/", 1)[-1] else p
    package = plain[: -len("/__init__")] if plain.endswith("/__init__") else plain[: -len("/index")] if plain.endswith("/index") else plain
    return list(dict.fromkeys([p, plain, plain.replace("/", "."), package, package.replace("/", "."), stem(p)]))


def test_type_files(spark):
    paths = ["a/BigStore.java", "a/Store.java", "b/Store.java", "b/util/__init__.py", "c/my_index.py", "z/StoreImpl.java", "c/index.ts", "c/e.java"]
    asked = [(f, t) for f in ("x.java", "y.java") for t in ("Store", "igStore", "StoreImpl", "util", "dex", "Nope", "e", "Named", "")]
    imports = [("y.java", "c/e.java", "Named", None, 1), ("y.java", "a/BigStore.java", "Store", None, 2)]
    last, place = {}, {}
    for p in paths:
        for i, k in enumerate(keys_of(p)):
            last[k] = max(p, last.get(k, ""))
            place[k] = min((p, i), place.get(k, (p, i)))
    want = set()
    for f, t in asked:
        named = [x[1] for x in imports if x[0] == f and x[2] == t]
        near = sorted((place[k], last[k]) for k in last if t and (k.endswith(t) or stem(last[k]) == t))
        hit = named[0] if named else last.get(t) if t in last else near[0][1] if near else None
        if t and hit:
            want.add((f, t, hit))
    df = spark.createDataFrame(asked, "file_path string, type string")
    imp = spark.createDataFrame(imports, "file_path string, target string, alias string, name string, line int")
    out = resolution.type_files(df, imp, spark.createDataFrame([(p,) for p in paths], "file_path string"))
    assert {tuple(r) for r in out.collect()} == want
    assert "NestedLoop" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()


def test_near_names(spark):
    r = random.Random(4)
    parts = ["find", "user", "by", "name", "load", "store", "item", "Order", "total", "check", "_id", "get", "set", "all", "Repo", "make"]
    names = {"".join(r.choices(parts, k=r.randrange(1, 5))) for _ in range(700)}
    for n in list(names)[:200]:
        k = r.randrange(len(n))
        names |= {n[:k] + n[k + 1 :], n[:k] + r.choice("abcxyz_") + n[k:], n[:k] + r.choice("abc") + n[k + 1 :]}
    names = sorted(names - {""}) + ["a", "ab", "abc"]
    some, known = names[::3], names

    def near(x, y):
        m = SequenceMatcher(None, x, y)
        return x != y and m.real_quick_ratio() >= 0.82 and m.quick_ratio() >= 0.82 and m.ratio() >= 0.82

    want = {(x, y) for x in some for y in known if near(x, y)}
    a, b = spark.createDataFrame([(x,) for x in some], "name string"), spark.createDataFrame([(x,) for x in known], "name string")
    assert {(x.name, x.match) for x in resolution.near_names(a, b).collect()} == want and len(want) > 200
    assert resolution.near_candidates(a, b).count() < 0.01 * len(some) * len(known)
    with pytest.raises(ValueError):
        resolution.near_candidates(a, b, 0.7)


def test_innermost(spark):
    r = random.Random(6)
    spans = []
    for f in "ab":
        for i in range(60):
            s = r.randrange(1, 400)
            spans.append((f, s, s + r.choice([0, 3, 10, 70, 300]), f"{f}{i}"))
    sites = [(f, r.randrange(0, 720), i) for f in "abc" for i in range(80)] + [("a", 5, 1), ("a", 5, 1)]

    def own(f, line):
        hit = [(e - s, -s, n) for g, s, e, n in spans if g == f and s <= line <= e]
        return min(hit)[2] if hit else None

    got = resolution.innermost(spark.createDataFrame(sites, "file_path string, line int, k int"), spark.createDataFrame(spans, "file_path string, start_line int, end_line int, ref string"))
    assert sorted((x.file_path, x.line, x.k, x.ref or "") for x in got.collect()) == sorted((f, n, k, own(f, n) or "") for f, n, k in sites)
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def project(seed):
    r = random.Random(seed)
    files = {}
    for i in range(8):
        used = r.sample(range(8), 2)
        lines = [f"from pkg.m{u} import run{u} as go{u}" for u in used]
        lines += [f"class Kind{i}({r.choice(['Base', f'Kind{used[0]}', 'Odd'])}):", f"    def act{i % 3}(self):", f"        return go{used[0]}()", f"def run{i}():", f"    k = Kind{used[1]}()", f"    return k.act{r.randrange(3)}() or helper{r.randrange(4)}() or run{r.randrange(9)}() or finder_of_usr()"]
        files[f"pkg/m{i}.py"] = "\n".join(lines) + "\n"
    return files


def changed(files, seed):
    r = random.Random(seed)
    out = dict(files)
    kind = seed % 3
    if kind == 0:
        out["pkg/late.py"] = "class Base:\n    pass\n\n\ndef helper1():\n    return 1\n\n\ndef finder_of_user():\n    return 2\n"
    elif kind == 1:
        del out[sorted(out)[r.randrange(len(out))]]
    else:
        k = sorted(out)[r.randrange(len(out))]
        out[k] = out[k].replace("def run", "def jog").replace("class Kind", "class Sort")
    return out


def test_incremental_with_added_changed_and_deleted_files(spark):
    table = lambda fs: spark.createDataFrame(list(fs.items()), "file_path string, content string")
    edges = lambda x: sorted(tuple(str(v) for v in r) for r in x.edges.select("edge_type", "source", "target", "confidence", "strategy", "line", "relation").collect())
    files = project(1)
    index = CodeIndex.from_files(spark, table(files))
    for seed in (0, 1, 2):
        files = changed(files, seed)
        index = index.updated(table(files))
        assert edges(index) == edges(CodeIndex.from_files(spark, table(files)))
    assert any("late.py::Base" in e[2] for e in edges(index))


def test_only_waiting_files_are_resolved(spark):
    files = {f"pkg/a{i}.py": f"def one{i}():\n    return two{i}()\n" for i in range(6)}
    df = spark.createDataFrame(list(files.items()), "file_path string, content string").withColumn("language", F.lit("python"))
    parsed = code.parsed(df).cache()
    new = spark.createDataFrame([("pkg/new.py", "def two3():\n    return 1\n", "python")], "file_path string, content string, language string")
    defs = code.definitions(code.parsed(new))
    redo = resolution.waiting(resolution.asked(parsed, code.import_candidates(parsed)), new.select("file_path"), defs, code.definitions(parsed).unionByName(defs), parsed)
    # two0 to two5 are near to two3, so only a name that is known elsewhere or far away keeps a file out.
    got = {r.file_path for r in redo.collect()}
    assert {"pkg/new.py", "pkg/a3.py"} <= got
    far = spark.createDataFrame([("pkg/new.py", "def unrelated():\n    return 1\n", "python")], "file_path string, content string, language string")
    defs = code.definitions(code.parsed(far))
    redo = resolution.waiting(resolution.asked(parsed, code.import_candidates(parsed)), far.select("file_path"), defs, code.definitions(parsed).unionByName(defs), parsed)
    assert {r.file_path for r in redo.collect()} == {"pkg/new.py"}


def test_older_calls(spark):
    files = {
        "app/a.py": "from app.b import go as run_it\n\n\ndef local():\n    return 1\n\n\nclass K:\n    def m(self):\n        return local() + other.local() + run_it() + only_one() + m()\n",
        "app/b.py": "def go():\n    return missing()\n\n\ndef only_one():\n    return local2()\n",
        "app/c.py": "from app.b import nothing\n\n\ndef nothing2():\n    return nothing() + x.act()\n\n\nclass X:\n    def act(self):\n        return 1\n",
        "J.java": "public class J {\n    private Shop shop;\n    void go() {\n        shop.buy();\n    }\n}\n",
        "Shop.java": "public interface Shop {\n    void buy();\n}\n",
        "ShopImpl.java": "public class ShopImpl implements Shop {\n    public void buy() {\n        stop();\n    }\n}\n",
    }
    df = spark.createDataFrame(list(files.items()), "file_path string, content string").withColumn("language", F.when(F.col("file_path").endswith(".py"), "python").otherwise("java"))
    parsed = code.parsed(df).cache()
    defs = code.definitions(parsed)
    got = {(r.source, r.target) for r in resolution.older_calls(parsed, defs, code.resolved_imports(parsed, df), df).collect()}
    assert {("app/a.py::K.m", "app/a.py::local"), ("app/a.py::K.m", "app/b.py::go"), ("app/a.py::K.m", "app/b.py::only_one"), ("app/a.py::K.m", "app/a.py::K.m"), ("J.java::J.go", "ShopImpl.java::ShopImpl.buy")} == got - {("app/c.py::nothing2", "app/c.py::X.act")}
