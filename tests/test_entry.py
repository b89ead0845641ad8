"""The driver contract without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys

from tests.conftest import ROOT


def _run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_queries_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "*.json", "*.txt")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=skip)
    assert not (tmp_path / "rest/slopecast/llm").exists()
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 140 and set(o) <= set(q); print(sorted(n for n in q if n.startswith('op') and n[2:3].isdigit()), 'pipeline' in q)"
    done = _run(tmp_path / "rest", code)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "[] False"


def test_other_missing_modules_are_raised(tmp_path):
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "*.json", "*.txt")
    shutil.copytree(ROOT, tmp_path / "rest", ignore=skip)
    (tmp_path / "rest/corpus_pipeline.py").write_text("import no_such_module_anywhere\n")
    done = _run(tmp_path / "rest", "import __spark_entry__ as e; e.queries()")
    assert done.returncode != 0 and "no_such_module_anywhere" in done.stderr
