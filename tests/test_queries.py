"""Every application query against its SQL twin."""

import os

import duckdb
import pandas as pd
import pytest

from rillstone import queries

SF = "/root/testdata/sf0.01"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v != v else str(v))
        elif str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(9)
        elif str(df[c].dtype) in ("Int64", "Int32"):  # whole numbers with nulls, as toPandas() gives them as doubles
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def test_each_query_has_a_twin():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got, want = normal(queries.QUERIES[name](spark, SF).toPandas()), normal(duck.execute(queries.ORACLE_SQL[name]).df())
    assert len(got)
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-12)


def test_closure_follows_transfers_of_late_bids(spark, tmp_path):
    from pyspark.sql import functions as F

    kind = F.when(F.col("id") == 400, "purchase").otherwise("view")
    events = spark.range(500).select(F.col("id").alias("event_id"), F.when(F.col("id") == 400, 5).otherwise(F.col("id") % 160).alias("user_id"), kind.alias("event_type"), F.lit(0.01).alias("value"))
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in queries.partition_dependency_closure(spark, str(tmp_path)).select("lost", "affected").collect()}
    assert got == {(i, i) for i in range(16)} | {(0, 4), (4, 0)}  # bid 401 pays from key 5 to key 48


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
