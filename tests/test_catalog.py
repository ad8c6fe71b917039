"""Every query that has a SQL twin against DuckDB, and the engine without its llm subpackage."""

import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quillspark import catalog

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def duck(sf01):
    con = duckdb.connect()
    for path in glob.glob(f"{sf01}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_sql(spark, sf01, duck, name):
    query, sql = catalog.QUERIES[name]
    found = query(spark, sf01)
    rows = sorted(repr([str(r[c]) for c in sorted(found.columns)]) for r in found.collect())
    assert rows
    if sql:
        result = duck.execute(sql)
        names = [x[0] for x in result.description]
        assert sorted(names) == sorted(found.columns)
        assert rows == sorted(repr([str(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in result.fetchall())


def test_chunks_are_bounded_and_whole(spark, sf001):
    chunks = catalog.QUERIES["document_chunks"][0](spark, sf001).collect()
    assert all(r.chars <= 1000 or r.n_elements == 1 for r in chunks)


def test_entry_imports_without_the_subpackage():
    code = "import sys; sys.modules['quillspark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'overlap_containment' in q and 'op1_repair_shards' not in q and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, check=True, timeout=60)
