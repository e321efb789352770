"""The driver's entry points, with and without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LIST = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') for k in e.queries()))"


def listed(where, **env):
    done = subprocess.run([sys.executable, "-c", LIST], cwd=where, capture_output=True, text=True, env=os.environ | env)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def copy_of(tmp_path, *left_out):
    shutil.copytree(ROOT / "stemma", tmp_path / "stemma", ignore=shutil.ignore_patterns(*left_out, "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    return tmp_path


def test_works_without_the_training_data_operators(tmp_path):
    n, sql, ops = listed(copy_of(tmp_path, "llm", "corpus_pipeline.py"))
    assert n == sql and int(n) > 40 and ops == "False"


def test_works_without_what_the_training_data_operators_need(tmp_path):
    (tmp_path / "absent").mkdir()
    (tmp_path / "absent" / "xxhash.py").write_text("raise ImportError('absent')")
    n, sql, ops = listed(copy_of(tmp_path), PYTHONPATH=str(tmp_path / "absent"))
    assert n == sql and int(n) > 40 and ops == "False"


def test_entry(spark):
    import __spark_entry__ as entry

    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("the driver's tables are not here")
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["pos", "code_norm", "found", "book_page", "hits"]
