"""The entry file with and without the training-data folders."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k[:2] == 'op' or k == 'pipeline' for k in q), set(e.oracle_sql()) <= set(q))"


def counts(root: Path) -> list[str]:
    out = subprocess.run([sys.executable, "-c", COUNT], cwd=root, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


@pytest.mark.parametrize("gone", [("footfall/llm", "tests/llm"), ("footfall/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_without_the_training_data_folders(tmp_path, gone):
    def left_out(folder: str, names: list[str]) -> list[str]:
        here = Path(folder).relative_to(ROOT)
        return [n for n in names if n == ".git" or n == "__pycache__" or str(here / n) in gone]

    shutil.copytree(ROOT, tmp_path / "copy", ignore=left_out)
    total, training, named = counts(tmp_path / "copy")
    assert int(total) > 180 and int(training) == 0 and named == "True"


def test_entry_has_the_training_data_queries_when_they_are_there():
    if not (ROOT / "footfall/llm/__init__.py").exists():
        pytest.skip("without the folders")
    total, training, _ = counts(ROOT)
    assert int(total) - int(training) > 180 and int(training) >= 11
