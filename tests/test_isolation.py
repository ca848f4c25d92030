"""The library without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/foldmark", tmp_path / "foldmark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    text = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(q for q in e.queries() if q[:2] == 'op' or q == 'pipeline'))"
    out = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True).stdout.split(maxsplit=2)
    assert int(out[0]) > 150 and int(out[1]) > 150 and out[2].strip() == "[]"


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(f"{ROOT}/foldmark"):
        for name in names:
            if name.endswith(".py") and "/llm" not in folder:
                with open(f"{folder}/{name}") as f:
                    assert ".llm" not in f.read() and "corpus_pipeline" not in name
