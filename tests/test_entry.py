import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"


def names(folder, more=""):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", more + ASK], cwd=folder, env=env, capture_output=True, text=True, check=True).stdout
    return [set(x.split()) for x in out.splitlines()]


@pytest.mark.parametrize("gone", [["formgrain/llm", "tests/llm", "corpus_pipeline.py"], ["formgrain/llm", "tests/llm"], ["corpus_pipeline.py"]])
def test_queries_without_what_was_taken_out(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(HERE, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for x in gone:
        path = copy / x
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    found, sql = names(copy)
    assert {"cells", "summary"} <= found and "cells" in sql
    assert "pipeline" not in found
    if "formgrain/llm" in gone:
        assert not any(x.startswith("op") for x in found | sql)


def test_each_operator_goes_by_its_own_imports():
    if not os.path.isdir(f"{HERE}/formgrain/llm"):
        pytest.skip("the operators have been taken out")
    found, sql = names(HERE, "import sys; sys.modules['zstandard'] = None; ")
    assert "op9_warc" not in found | sql and {"cells", "op6_exact_dedup", "pipeline"} <= found
