import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from nearfield.plans.queries import ORACLES, QUERIES
from tests.conftest import ROOT, SF


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, duck, same, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLES:
        same(got, duck.execute(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    assert entry.entry(spark).columns == ["id", "rank", "neighbor_id", "distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_errors_are_not_hidden(monkeypatch):
    def broken(name):
        raise ModuleNotFoundError("no library", name="library")

    monkeypatch.setattr(entry.importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry._removable("nearfield.plans.queries")
    monkeypatch.undo()
    with pytest.raises(ModuleNotFoundError):
        entry._removable("nearfield.no_such_part")


@pytest.mark.parametrize("gone", [("nearfield/llm", "tests/llm"), ("nearfield/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_removable_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for part in gone:
        path = copy / part
        shutil.rmtree(path, ignore_errors=True) if path.suffix == "" else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and set(e.oracle_sql()) <= set(e.queries()); print([q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"
    ran = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(copy)}, timeout=120)
    assert ran.returncode == 0 and ran.stdout.strip() == "[]", ran.stderr
