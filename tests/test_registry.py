"""Registered vector queries against their SQL in DuckDB, and the entry point."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from orrery.plans.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    rows = [tuple(None if x is None or isinstance(x, float) and math.isnan(x) else "%.9g" % x if isinstance(x, float) else str(x) for x in r) for r in frame.itertuples(index=False)]
    return list(frame.columns), sorted(rows, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tables, name):
    assert plain(QUERIES[name](spark, SMALL).toPandas()) == plain(tables.sql(ORACLES[name]).df())


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SMALL).count() > 0


def test_inner_products_of_all_rows_in_parts(spark, tmp_path, monkeypatch):
    from orrery.operators import arrays
    from orrery.plans import registry

    rows = [(i, [float((i * j) % 7 - 3) for j in range(64)]) for i in (-50, -1, 0, 1, 50, 100)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    parts = arrays.query_parts
    monkeypatch.setattr(arrays, "query_parts", lambda queries: parts(queries, each=512))
    found = registry.binary_inner_product(spark, str(tmp_path)).collect()
    assert sorted((r.qid, r.vec_id) for r in found) == sorted((q, v) for q in (-50, 0, 50, 100) for v, _ in rows)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_point_without_the_llm_folders(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    with monkeypatch.context() as m:
        m.setitem(sys.modules, "orrery.llm", None)
        for name in [n for n in sys.modules if n.startswith("orrery.llm.") or n == "corpus_pipeline"]:
            m.delitem(sys.modules, name)
        bare = importlib.reload(entry)
        assert set(bare.queries()) == set(QUERIES) and set(bare.oracle_sql()) == set(ORACLES)
    importlib.reload(entry)
