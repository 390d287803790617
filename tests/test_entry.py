import importlib.util
import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() == 1


def test_sql_is_for_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 100


def test_works_without_the_corpus_package(monkeypatch):
    find = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if name.startswith(("quarrykit.llm", "corpus_pipeline")) else find(name, *a))
    assert not [k for k in entry.queries() if k.startswith("op") or k == "pipeline"] and "corpus_pipeline" not in entry.oracle_sql()
    assert sys.modules["quarrykit.plans.catalogue"]


def test_a_copy_without_the_corpus_folders_works(tmp_path):
    """As when both folders are deleted: the entry imports and offers all other queries."""
    here = Path(entry.__file__).parent
    copy = tmp_path / "repo"
    shutil.copytree(here, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", "corpus_pipeline.py", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q), set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=300, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})
    n, corpus, fits = out.stdout.split()
    assert int(n) > 150 and corpus == "0" and fits == "True", out.stderr
