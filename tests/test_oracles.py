"""Each query against its SQL in DuckDB."""

import os

import duckdb
import pandas as pd
import pytest

from matchloom.plans import catalog, kept, learned, market, strict  # noqa: F401


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return int(v) if hasattr(v, "dtype") and v.dtype.kind in "iu" else v if isinstance(v, (int, str)) else str(v)

    frame = frame[sorted(frame.columns)]
    whole = [[float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in map(plain, column)] for column in (frame[c].tolist() for c in frame.columns)]
    return sorted(zip(*whole, strict=True), key=repr)


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(data):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{data}/{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, data, sql, name):
    got, want = catalog.QUERIES[name](spark, data).toPandas(), sql.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_lexical_top_k_against_plain_python(spark, data):
    """The sparse join against dense vectors made by the definition."""
    import re

    def fnv(s, seed):
        h = 0x811C9DC5 ^ seed
        for c in s:
            h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
        return h

    def vector(s):
        tokens = re.findall(r"\d+(?:[.,]\d+)?|[a-z]+", s.lower())
        v = {}
        for f, w in [("t:" + x, 1.0) for x in tokens] + [("g:" + x[k : k + 3], 0.35) for x in tokens if len(x) >= 4 for k in range(len(x) - 2)]:
            i = fnv(f, 0) % 1536
            v[i] = v.get(i, 0.0) + (w if fnv(f, 0x9E3779B9) & 1 else -w)
        n = sum(x * x for x in v.values()) ** 0.5
        return {i: x / n for i, x in v.items()}

    part = spark.read.parquet(f"{data}/part.parquet").collect()
    vectors = {r.p_partkey: vector(f"{r.p_name} {r.p_brand}") for r in part}
    got = {(r.line_no, r["rank"]): r.score for r in catalog.QUERIES["lexical_topk"](spark, data).collect()}
    for line in [k for k in vectors if k % 20 == 0][:10]:
        scores = sorted((sum(w * vectors[i].get(x, 0.0) for x, w in vectors[line].items()) for i in vectors if i % 20), reverse=True)[:5]
        assert scores == pytest.approx([got[line, k] for k in range(1, 6)], abs=2e-6)
