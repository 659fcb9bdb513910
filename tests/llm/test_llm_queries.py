import os

import pytest

from quillsift.llm.queries import oracle_sql, queries

ROOT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    import glob

    import duckdb

    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = queries()[name](spark, ROOT)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries()))
def test_rows_are_distinct(spark, name):
    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    rows = [repr(r) for r in queries()[name](spark, ROOT).collect()]
    assert len(rows) == len(set(rows)) or name in ("p1_consistent", "p3_segments")


def test_containers_are_full(spark):
    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    from pyspark.sql import functions as F

    packed = queries()["p6_containers"](spark, ROOT)
    held = [r.t for r in packed.filter("container is not null").groupBy("container").agg(F.sum("tokens").alias("t")).collect()]
    assert max(held) <= 1024 and len(held) <= sum(held) / 1024 * 1.02 + 1
