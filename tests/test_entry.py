import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from pipehat import queries

REPO = Path(__spark_entry__.__file__).resolve().parent


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["pid", "val"]
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(queries.ORACLES) == set(queries.QUERIES)


def test_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO / "pipehat", tmp_path / "pipehat", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert n and not [x for x in n if x.startswith('op') or x == 'pipeline']; print(len(n), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(queries.QUERIES))] * 2


def test_nothing_else_imports_them():
    for p in (REPO / "pipehat").rglob("*.py"):
        if "llm" not in p.relative_to(REPO).parts:
            assert "pipehat.llm" not in p.read_text()
