"""Percentages against SQL's."""

import duckdb
from pyspark.sql import functions as F

from matchloom.operators.summary import percent


def test_percent_rounds_as_sql(spark):
    got = spark.range(4001).select("id", percent(F.col("id"), F.lit(4000)).alias("p")).orderBy("id").collect()
    want = duckdb.sql("SELECT n, round(n / 4000 * 100, 1) FROM range(4001) t(n) ORDER BY n").fetchall()
    assert [tuple(r) for r in got] == want
    assert got[18].p == 0.5  # 18 / 4000 * 100 is 0.44999999999999996
