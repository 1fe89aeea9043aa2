"""The driver's contract."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 60


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rest_does_not_need_the_corpus_operators(tmp_path):
    """Without that subpackage the other queries are all there."""
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('loomgraph.llm'):\n"
        "            raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e, loomgraph.plans.workflow, loomgraph.streaming.watch, loomgraph.sources.records\n"
        "assert len(e.queries()) >= 50 and not [q for q in e.queries() if q.startswith('op')]\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_with_the_corpus_folders_deleted(tmp_path):
    """In a copy without the corpus operators and their pipeline, the rest imports and lists its queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    shutil.rmtree(copy / "loomgraph" / "llm", ignore_errors=True)
    shutil.rmtree(copy / "tests" / "llm", ignore_errors=True)
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'bm25_search' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(o) <= set(q); import loomgraph.plans.tools, loomgraph.plans.workflow, bench"
    got = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    assert got.returncode == 0, got.stderr
