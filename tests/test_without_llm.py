"""The library without the training-data subpackage: it imports, lists its queries and tests."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 150 and set(o) <= set(q); assert not [n for n in q if n == 'pipeline' or n.startswith('op')], q"


def environment() -> dict[str, str]:
    """This process's environment without the repository's own path, which would bring the subpackage back."""
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != os.path.realpath(ROOT)]
    return os.environ | {"PYTHONPATH": os.pathsep.join(path)}


@pytest.mark.parametrize("gone", [("tessera/llm", "tests/llm"), ("tessera/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_subpackage(tmp_path, gone):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse", *(os.path.basename(g) for g in gone)))
    assert not any((copy / g).exists() for g in gone)
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, env=environment(), capture_output=True, text=True, timeout=300)
    listed = run("-c", LISTED)
    assert listed.returncode == 0, listed.stderr
    collected = run("-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert collected.returncode == 0, collected.stdout + collected.stderr
    if len(gone) == 3:
        few = run("-m", "pytest", "tests/test_colour.py", "-q", "-p", "no:cacheprovider")
        assert few.returncode == 0, few.stdout + few.stderr
