"""The entry module with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_statements_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_stands_without_corpus_operators(tmp_path):
    """Nothing else imports them: the entry module still gives all other queries once their folders and the pipeline are gone."""
    for name in ("sparkoire", "__spark_entry__.py", "bench.py"):
        source = ROOT / name
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import bench, __spark_entry__ as e; names = set(e.queries()); assert set(e.oracle_sql()) <= names; print(len(names), any(n.startswith('op') and n[2:3].isdigit() for n in names))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True)
    n, corpus = out.stdout.split()
    assert int(n) > 150 and corpus == "False"
