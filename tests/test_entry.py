"""The driver's contract, with and without the pipeline operators."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    row = entry.entry(spark).first()
    assert 0 < row["auroc"] <= 1


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_pipeline_operators(tmp_path):
    shutil.copytree(ROOT / "starsift", tmp_path / "starsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'evaluate' in q and 'pipeline' not in q and not [n for n in q if n.startswith('op')]"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)


def test_library_does_not_import_the_pipeline_operators():
    for path in (ROOT / "starsift").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "starsift.llm" not in path.read_text(), path
