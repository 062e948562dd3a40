"""Every query with oracle SQL against DuckDB on the smallest tables."""

import datetime
import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
QUERIES = {k: v for m in entry._MODULES if not m.__name__.startswith("talus.llm") for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in entry._MODULES if not m.__name__.startswith("talus.llm") for k, v in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert got == sorted(tuple(norm(row[i]) for i in at) for row in r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_vector_topk_has_all_queries(spark):
    rows = QUERIES["vector_topk"](spark, DATA).groupBy("query_id").count().collect()
    asked = spark.read.parquet(f"{DATA}/embeddings.parquet").where("vec_id % 20 = 0").count()
    assert len(rows) == asked > 20 and {r["count"] for r in rows} == {10}
