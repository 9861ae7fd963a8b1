"""The driver entry with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
PROGRAM = "import __spark_entry__ as e; q = e.queries(); assert not [n for n in q if n.startswith('op')] and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q); print(len(q))"


def test_entry_without_llm(tmp_path):
    """Without the training-data folders and the pipeline all other queries stay."""
    for name in ("__spark_entry__.py", "spanforge"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "spanforge" / "llm", ignore_errors=True)
    done = subprocess.run([sys.executable, "-c", PROGRAM], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    others = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]
    assert int(done.stdout) == len(others) > 190


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
