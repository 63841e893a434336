"""The entry with and without the removable part."""

import json
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def shown(folder):
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120)
    return json.loads(done.stdout) if done.returncode == 0 else done.stderr


@pytest.mark.parametrize("gone", [["skein/llm", "tests/llm"], ["skein/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_removable_part(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in gone:
        path = copy / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    names, sql = shown(copy)
    assert {"query_subgraph", "leiden", "report"} <= set(names) and set(sql) <= set(names)
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]


def test_failures_of_the_removable_part_show(tmp_path):
    if not (ROOT / "skein/llm").exists():
        pytest.skip("not there")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    (copy / "skein/llm/bpe.py").unlink()
    assert "No module named 'skein.llm.bpe'" in shown(copy)
