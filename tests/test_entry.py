"""The driver contract, with and without the llm subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    assert entry.entry(spark).count() == 1489


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_llm(tmp_path):
    shutil.copytree(os.path.join(REPO, "rangeloom"), tmp_path / "rangeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'overlap_join' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)
