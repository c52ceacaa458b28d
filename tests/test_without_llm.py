"""The library without the training-data subpackage: a copy without it still imports and lists its queries."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_copy_without_llm_lists_its_queries(tmp_path, with_pipeline):
    skipped = {"llm", "__pycache__", ".git", ".pytest_cache", *([] if with_pipeline else ["corpus_pipeline.py"])}
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=lambda _, names: skipped & set(names))
    done = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    queries, oracles = (set(line.split()) for line in done.stdout.splitlines())
    assert "lex_scores_by_quality" in queries and oracles <= queries
    assert not any(q.startswith("op") or q == "pipeline" for q in queries)
