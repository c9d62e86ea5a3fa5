"""The audit library without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as e
from ledgerlens.session import local_session
names = set(e.queries())
assert "ghv5_ghost_vendors" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
assert set(e.oracle_sql()) <= names
print(e.entry(local_session(2, memory="2g")).count())
"""


@pytest.mark.parametrize("gone", [["ledgerlens/llm", "tests/llm"], ["ledgerlens/llm", "tests/llm", "corpus_pipeline.py"]])
def test_import_and_query_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__") or any(str(Path(folder) / n) == str(ROOT / g) for g in gone)])
    assert not (copy / gone[0]).exists()
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split()[-1]) > 0
