"""Totals and matrices of offers hold only the groups they need, and large quotes are dealt to more tasks."""

from pyspark.sql import functions as F

from matchloom.operators import comparison


def quotes(spark, n=400):
    return spark.range(n).select((F.col("id") % 2).alias("r"), (F.col("id") % 40).alias("item_no"), F.concat(F.lit("p"), (F.col("id") % 7).cast("string")).alias("provider"), (F.col("id") % 13 + 1).cast("decimal(14,4)").alias("unit_price"), (F.col("id") % 5 + 1).cast("decimal(14,3)").alias("quantity"))


def test_totals_expand_only_upper_levels(spark):
    offered = comparison.offers_of(quotes(spark), ("r",))
    found = comparison.totals(offered, ("r",))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    sets = found.groupBy("level").count().collect()
    assert {r.level: r["count"] for r in sets} == {"item and provider": 280, "item": 40, "provider": 14, "all": 2}
    expand = next(line for line in plan.splitlines() if "Expand" in line)
    assert expand.split("]], [")[0].count("], [") == 2  # three sets, not four
    whole = found.groupBy("level").agg(F.sum("amount").alias("a"), F.sum("quotes").alias("n")).collect()
    assert len({(r.a, r.n) for r in whole}) == 1


def test_matrix_in_one_grouping(spark):
    found = comparison.matrix(comparison.offers_of(quotes(spark)))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "pivotfirst" not in plan and found.columns == ["item_no"] + [f"p{k}" for k in range(7)]
    want = {}
    for r in quotes(spark).collect():
        key = (r.item_no, r.provider)
        want[key] = min(want.get(key, r.unit_price), r.unit_price)
    assert {(r.item_no, p): r[p] for r in found.collect() for p in found.columns[1:] if r[p] is not None} == want


def test_large_quotes_take_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(comparison, "TASK_ROWS", 20)
    found = comparison.offers_of(quotes(spark), ("r",))
    assert ", 20), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 280
