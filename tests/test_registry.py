"""Queries and their SQL agree in names; the corpus operators can be missing."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    for p in ROOT.rglob("*.py"):
        name = p.relative_to(ROOT)
        if "llm" not in name.parts and name.name != "corpus_pipeline.py" and name.parts[0] in ("pointweave", "__spark_entry__.py"):
            (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / name).write_text(p.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a20_pairwise' in q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join([str(tmp_path), *[p for p in sys.path if "packages" in p]])})


def test_entry(spark):
    assert entry.entry(spark).count() == 1
