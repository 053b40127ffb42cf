"""The rest of the library without the corpus operators."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = """
import __spark_entry__ as e
names = set(e.queries())
assert names and not any(n.startswith("op") or n == "pipeline" for n in names), names
assert set(e.oracle_sql()) <= names
import scriptorium.cli, scriptorium.plans.ingest
print("fine")
"""


@pytest.mark.parametrize("also", [("corpus_pipeline.py",), ()])
def test_without_the_corpus_operators(tmp_path, also):
    """A copy without the folders (with and without the pipeline's file) still registers its own queries."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md"))
    for gone in ("scriptorium/llm", "tests/llm"):
        shutil.rmtree(copy / gone, ignore_errors=True)
    (copy / "scriptorium" / "llm").mkdir()  # an empty folder may stay
    for gone in also:
        (copy / gone).unlink(missing_ok=True)
    env = {**os.environ, "PYTHONPATH": str(copy)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip() == "fine", done.stderr


def test_the_rest_passes_its_tests(tmp_path):
    """In a copy without the folders every other test is collected, and some are run."""
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", "*.md", "llm"))
    run = lambda *a: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *a], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert run("--collect-only", "tests").returncode == 0
    done = run("tests/test_text.py")
    assert done.returncode == 0, done.stdout[-2000:]


def test_nothing_else_imports_them():
    for path in [*ROOT.glob("scriptorium/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            text = path.read_text(encoding="utf-8")
            assert "scriptorium.llm" not in text and "from .llm" not in text and "corpus_pipeline" not in text, path
