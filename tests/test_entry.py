"""The entry module in copies of the library that lack the training-text parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = (
    "import __spark_entry__ as e; from kindred.registry import catalog; "
    "q = set(e.queries()); assert set(catalog.queries()) <= q, q; "
    "assert set(e.oracle_sql()) <= q; print(len(q - set(catalog.queries())))"
)


@pytest.mark.parametrize("left", ["nothing", "pipeline", "compiled files"])
def test_queries_without_the_text_folders(tmp_path, left):
    shutil.copytree(f"{ROOT}/kindred", tmp_path / "kindred", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if left == "pipeline" and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    if left == "compiled files":
        (tmp_path / "kindred" / "llm" / "__pycache__").mkdir(parents=True)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"
