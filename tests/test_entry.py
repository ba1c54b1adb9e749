"""The entry works with and without the training-data operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), 'pipeline' in q, sorted(set(s) - set(q)))"


def found(home: Path) -> str:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}  # it may name the repository itself
    return subprocess.run([sys.executable, "-c", SAYS], cwd=home, env=env, capture_output=True, text=True, check=True).stdout.strip()


@pytest.mark.parametrize("gone", [("tallymark/llm",), ("tallymark/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_other_queries_stay(tmp_path, gone):
    shutil.copytree(HOME / "tallymark", tmp_path / "tallymark", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (HOME / name).exists():
            shutil.copy(HOME / name, tmp_path / name)
    for name in gone:
        at = tmp_path / name
        shutil.rmtree(at) if at.is_dir() else at.unlink(missing_ok=True)
    n_queries, n_sql, pipeline, without = found(tmp_path).split(" ", 3)
    assert int(n_queries) >= 50 and int(n_sql) >= 50 and pipeline == "False" and without == "[]"
