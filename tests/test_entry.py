"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(k.startswith('op') for k in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"


@pytest.mark.parametrize("gone", [(), ("rillstone/llm", "tests/llm"), ("rillstone/llm", "tests/llm", "corpus_pipeline.py")])
def test_entry_imports_without_optional_parts(tmp_path, gone):
    shutil.copytree(ROOT, tmp_path / "tree", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in gone:
        path = tmp_path / "tree" / name
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=tmp_path / "tree", env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    n, pipeline, ops, twins = run.stdout.split()
    there = os.path.isdir(tmp_path / "tree" / "rillstone" / "llm")
    assert int(n) >= 36 and (pipeline, ops, twins) == (str(there), str(there), "True")


def test_library_does_not_import_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "rillstone")):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "llm" not in f.read(), name
