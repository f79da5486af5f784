"""The entry with the llm folders gone, and with one that fails to import."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture
def copy(tmp_path):
    shutil.copytree(ROOT / "pagelens", tmp_path / "pagelens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def _names(folder):
    code = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def test_without_llm(copy):
    for leftover in (None, "pagelens/llm/__pycache__"):
        if leftover:
            (copy / leftover).mkdir(parents=True)
        names, sql = _names(copy).stdout.splitlines()
        assert "lane_scorecard" in names.split() and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names.split())
        assert set(sql.split()) == set(names.split())


def test_broken_llm_is_not_hidden(copy):
    (copy / "pagelens/llm").mkdir()
    (copy / "pagelens/llm/__init__.py").touch()
    (copy / "pagelens/llm/registry.py").write_text("import no_such_module\n", encoding="utf-8")
    told = _names(copy)
    assert told.returncode and "no_such_module" in told.stderr
