"""Every registered query against its SQL in DuckDB, and the repository without its corpus folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillspan.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    d = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(d.columns)
    got = sorted(map(repr, (tuple(r) for r in d.select(*[f"`{c}`" for c in cols]).collect())))
    if name in registry.ORACLE_SQL:
        q = duck.execute(registry.ORACLE_SQL[name])
        names = [x[0] for x in q.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in q.fetchall())
    else:
        assert got


def test_entry_without_the_corpus_folder(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'resolve_items' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert out.stdout.strip() == "fine", out.stderr
