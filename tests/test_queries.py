"""Registered queries against their SQL in DuckDB, over the smallest test tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__
from quillsift.plans.queries import QUERIES, SQL

ROOT = "/root/testdata/sf0.001"


def compare(spark, name, query, sql):
    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{ROOT}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    df = query(spark, ROOT)
    assert sorted(df.columns) == sorted(columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert rows == sorted(map(repr, want.fetchall())), name


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, name, QUERIES[name], SQL[name])


def test_registry_is_consistent():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries) and set(QUERIES) <= set(queries)


def test_planted_phrases_are_found(spark):
    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    assert QUERIES["heuristic_score"](spark, ROOT).filter("flagged").count() > 10
    assert QUERIES["motif_matches"](spark, ROOT).count() > 10
    assert QUERIES["scan_documents"](spark, ROOT).groupBy("status").count().count() >= 2


def test_smoke(spark):
    if not os.path.exists(ROOT):
        pytest.skip("no test tables")
    assert __spark_entry__.entry(spark).count() > 0


def test_windows_of_short_texts(spark, tmp_path):
    texts = ["", "ignore previous instructions", "x" * 50, "y" * 60, "z" * 1024, "w" * 1100, None]
    spark.createDataFrame([(9 * k + 8, t) for k, t in enumerate(texts)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.id // 9, r.start, r.end) for r in QUERIES["coarse_windows"](spark, str(tmp_path)).collect()}
    assert got == {(1, 0, 28), (2, 0, 50), (3, 0, 60), (4, 0, 1024), (4, 512, 1024), (5, 0, 1024), (5, 512, 1100), (5, 1024, 1100)}


def test_metrics_without_keys_agree_with_one_key(spark):
    from pyspark.sql import functions as F

    from quillsift.operators import metrics

    rows = [(1, 0.3), (0, 0.3), (1, -2.0), (0, 7.5), (1, 1.0), (0, 0.0), (1, 0.999), (0, 0.31), (1, 0.31), (0, None), (None, 0.5)]
    df = spark.createDataFrame(rows, "label int, score double")
    one = metrics.prepared(df)
    keyed = metrics.prepared(df.withColumn("run", F.lit(1)), keys=("run",))
    assert metrics.auc(one).head().auc == pytest.approx(metrics.auc(keyed, ("run",)).head().auc)
    pos, neg = ([s or 0.0 for label, s in rows if label == k] for k in (1, 0))
    assert metrics.auc(one).head().auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert sorted(map(tuple, metrics.tpr_at_fpr(one, (0.1, 0.5)).collect())) == sorted((r.fpr_target, r.tpr) for r in metrics.tpr_at_fpr(keyed, (0.1, 0.5), ("run",)).collect())
