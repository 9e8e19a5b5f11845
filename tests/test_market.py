"""Comparison of offers, and joins on time, against their plain definitions."""

from collections import defaultdict
from datetime import datetime, timedelta
from decimal import Decimal as D
from random import Random

import pytest
from pyspark.sql import functions as F

from matchloom import cli, config
from matchloom.errors import EngineError
from matchloom.operators import comparison, temporal
from matchloom.operators.store import Store

from .test_sources import workbook

QUOTES = "item_no long, provider string, quantity decimal(14,3), unit_price decimal(14,4)"


def quotes(spark):
    rows = [(1, "a", 2, 10), (1, "a", 3, 9), (1, "a", 5, 9), (1, "b", 2, 9), (1, "c", 1, 12), (2, "b", 1, 4), (3, "a", 1, None), (None, "a", 1, 5), (4, "c", 2, 0), (4, "b", 2, 3)]
    return spark.createDataFrame([(i, p, D(q), None if u is None else D(u)) for i, p, q, u in rows], QUOTES)


def asked(spark):
    return spark.createDataFrame([(k, D(10)) for k in (1, 2, 3, 4)], "item_no long, quantity decimal(14,3)")


def test_best_offers_and_coverage(spark):
    offered = comparison.offers_of(quotes(spark))
    assert {(r.item_no, r.provider): (r.unit_price, r.quantity, r.lines) for r in offered.collect()}[1, "a"] == (9, 5, 3)
    best = {r.item_no: r for r in comparison.best_quotes(offered).collect()}
    assert set(best) == {1, 2, 4}
    assert (best[1].best_provider, best[1].second_provider, best[1].saving_pct, best[1].providers, best[1].worst_price) == ("a", "b", 0.0, 3, 12)
    assert (best[2].best_provider, best[2].second_provider, best[2].saving_pct) == ("b", None, None)
    assert (best[4].best_provider, best[4].saving_pct) == ("c", 100.0)
    of = {r.provider: (r.covered, r.cheapest, r.only_here, r.total, r.coverage_pct, r["items"]) for r in comparison.coverage(offered, asked(spark)).collect()}
    assert of == {"a": (1, 1, 0, 90, 25.0, 4), "b": (3, 1, 1, 160, 75.0, 4), "c": (2, 1, 0, 120, 50.0, 4)}
    won = comparison.award(offered, asked(spark)).first()
    assert (won["items"], won.unquoted, won.providers_needed, won.split_total, won.single_provider, won.single_covered, won.single_total) == (4, 1, 3, 130, "b", 3, 160)


def test_matrix_and_totals(spark):
    offered = comparison.offers_of(quotes(spark))
    shown = comparison.matrix(offered)
    assert shown.columns == ["item_no", "a", "b", "c"] and {tuple(r) for r in shown.collect()} == {(1, 9, 9, 12), (2, None, 4, None), (4, None, 3, 0)}
    levels = defaultdict(dict)
    for r in comparison.totals(offered).collect():
        levels[r.level][r.item_no, r.provider] = (r.quotes, r.least_price, r.amount)
    assert levels["all"] == {(None, None): (6, 0, 45 + 18 + 12 + 4 + 0 + 6)} and levels["item"][1, None] == (3, 9, 75) and levels["provider"][None, "b"] == (3, 3, 28) and len(levels["item and provider"]) == 6
    kept, comparison.MAX_COLUMNS = comparison.MAX_COLUMNS, 2
    try:
        with pytest.raises(EngineError):
            comparison.matrix(offered)
    finally:
        comparison.MAX_COLUMNS = kept
    assert comparison.best_quotes(offered.where("false")).collect() == [] and comparison.coverage(offered.where("false"), asked(spark)).collect() == []


def test_two_offers_of_one_request(spark, tmp_path):
    """From files to the comparison: only each offer's newest reconciliation counts."""
    (tmp_path / "purchase_requests.csv").write_text("request_id,title\nR1,Compra\n")
    (tmp_path / "purchase_request_items.csv").write_text("request_id,item_id,description,quantity,unit\nR1,1,Cable rojo 4 mm2,10,metro\nR1,2,Tubo PVC 110,2,tubo\n")
    head = ["Linea", "Codigo", "Descripcion", "Cantidad", "Unidad", "Precio"]
    workbook(tmp_path / "uno.xlsx", [["Proveedor", "Norte"], head, [1, "A-1", "Cable rojo 4 mm2", 10, "metro", 2.5], [2, "A-2", "Tubo PVC 110", 2, "tubo", 3]])
    workbook(tmp_path / "dos.xlsx", [["Proveedor", "Sur"], head, [1, "B-1", "Cable rojo 4 mm2", 10, "metro", 2]])
    store = Store(spark, str(tmp_path / "store"), buckets=4)
    cli.seed(store, str(tmp_path))
    for name in ("uno.xlsx", "dos.xlsx", "uno.xlsx"):
        cli.run_reconcile(store, cli.process(store, str(tmp_path / name), "R1"), config.Config())
    assert store.read("reconciliations").count() == 3
    assert {tuple(r) for r in cli.compared(store, "R1", "matrix").select("item_no", F.col("Norte").cast("double"), F.col("Sur").cast("double")).collect()} == {(1, 2.5, 2.0), (2, 3.0, None)}
    assert [(r.provider, r.covered, float(r.total)) for r in cli.compared(store, "R1", "coverage").collect()] == [("Norte", 2, 31.0), ("Sur", 1, 20.0)]
    assert float(cli.compared(store, "R1", "award").first().split_total) == 26.0 and cli.compared(store, "R1", "best").first().best_provider == "Sur"


START = datetime(2024, 3, 1)


def moments(spark, rng, n, hot=0.4):
    rows = [(None if rng.random() < 0.03 else "hot" if rng.random() < hot else f"k{rng.randrange(4)}", None if rng.random() < 0.03 else START + timedelta(minutes=rng.randrange(40_000)), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "k string, at timestamp_ntz, n int")


@pytest.mark.parametrize("bucket, tolerance", [(3600, None), (7 * 86_400, 7200.0), (10**9, None)])
def test_asof_join(spark, bucket, tolerance):
    rng = Random(bucket)
    ours, left = moments(spark, rng, 400)
    theirs, right = moments(spark, rng, 150)
    got = temporal.asof_join(left, right.select("k", F.col("at").alias("since"), F.col("n").alias("v")), ["k"], "at", "since", ["v"], tolerance, bucket).collect()
    want = {}
    for k, at, n in ours:
        found = max(((t, v) for key, t, v in theirs if k is not None and at is not None and key == k and t is not None and t <= at and (tolerance is None or (at - t).total_seconds() <= tolerance)), default=(None, None))
        want[n] = (k, at, *found[::-1])
    assert len(got) == len(ours) and {r.n: (r.k, r["at"], r.v, r.since_found) for r in got} == want
    assert temporal.asof_join(left, right.where("false").select("k", F.col("at").alias("since"), F.col("n").alias("v")), ["k"], "at", "since", ["v"]).where("v IS NOT NULL").count() == 0


def test_interval_join(spark):
    rng = Random(4)
    points, left = moments(spark, rng, 300)
    spans = []
    for n in range(120):
        start = START + timedelta(minutes=rng.randrange(40_000))
        long = timedelta(minutes=rng.choice([0, 1, 60, 5_000, 90_000]))
        spans.append((rng.choice(["hot", "k1", "k2", None]), None if n == 5 else start, None if n % 11 == 0 else start + long, n))
    right = spark.createDataFrame(spans, "k string, since timestamp_ntz, until timestamp_ntz, m int")
    got = sorted((r.n, r.m) for r in temporal.interval_join(left, right, ["k"], "at", "since", "until", 3600).collect())
    assert got == sorted((n, m) for k, at, n in points for key, a, b, m in spans if k is not None and k == key and at is not None and a is not None and a <= at and (b is None or at < b))
    assert temporal.interval_join(left, right.where("false"), ["k"], "at", "since", "until").count() == 0


def test_few_pairs_outside_their_interval_are_met(spark):
    points = spark.sql("SELECT 0 AS k, date_add(DATE'2024-01-01', int(id)) AS at FROM range(400)")
    lists = spark.sql("SELECT 0 AS k, date_add(DATE'2024-01-01', int(id)) AS since, date_add(DATE'2024-01-01', int(id + 1 + id % 39)) AS until FROM range(350)")
    asked = (points, lists, ["k"], "at", "since", "until")
    given = temporal.interval_join(*asked).count()
    assert given == sum(1 + k % 39 for k in range(350))
    assert temporal.met_in_bins(*asked).count() < 1.5 * given


def test_points_of_an_interval_join_are_shuffled_once(spark):
    """Whatever lengths there are, and open intervals too; only intervals of very many bins take wider ones."""
    points = spark.sql("SELECT id % 2 AS k, timestampadd(MINUTE, int(id), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS at FROM range(4000)")
    spans = [(k % 2, START + timedelta(minutes=90 * (k % 5)), None if k % 7 == 0 else START + timedelta(minutes=90 * (k % 5) + 3 ** (k % 8)), k) for k in range(300)]
    lists = spark.createDataFrame(spans, "k bigint, since timestamp_ntz, until timestamp_ntz, m int").withColumns({c: F.col(c) - F.expr("INTERVAL 60 DAYS") for c in ("since", "until")})
    asked = (points, lists, ["k"], "at", "since", "until", 60)
    want = sorted((r["at"], r.m) for r in points.join(lists, "k").where("at >= since AND (until IS NULL OR at < until)").select("at", "m").collect())
    assert len(want) > 10_000 and sorted((r["at"], r.m) for r in temporal.interval_join(*asked).select("at", "m").collect()) == want
    plan = temporal.met_in_bins(*asked)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1  # of intervals
    kept = temporal.MOST_BINS, temporal.TASK_ROWS
    temporal.MOST_BINS, temporal.TASK_ROWS = 8, 700
    try:
        assert sorted((r["at"], r.m) for r in temporal.interval_join(*asked).select("at", "m").collect()) == want
        assert temporal.met_in_bins(*asked)._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
    finally:
        temporal.MOST_BINS, temporal.TASK_ROWS = kept
