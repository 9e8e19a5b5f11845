"""Unit conversions, alias learning, sketches and offers assembled from a stream."""

from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from matchloom.operators import aliases, rollups, units
from matchloom.operators.cascade import reconcile
from matchloom.operators.store import Store
from matchloom.streaming.assembly import assembled


@pytest.mark.parametrize(
    "text, want",
    [
        ("Cable rojo rollo x 100 m", ("roll", "meter", 100.0)), ("Guantes CAJA de 1.500 unidades", ("box", "unit", 1500.0)), ("Pintura balde x 3,6 l blanca", ("bucket", "liter", 3.6)), ("Bidón por 20 litros", ("drum", "liter", 20.0)),
        ("pack x6 u.", ("pack", "unit", 6.0)), ("caja x 1 caja", None), ("rollo de cable", None), ("tubo x 0 m", None), ("enrollo x 5 m", None), (None, None),
    ],
)
def test_pack_sizes(spark, text, want):
    row = spark.createDataFrame([(text,)], "d string").select(units.pack_size(F.col("d")).alias("s")).first().s
    assert (None if row is None else tuple(row)) == want


def factors(spark, rows):
    return spark.createDataFrame(rows, "item_no long, from_unit string, to_unit string, factor double")


def test_factors_close_over_long_chains(spark):
    chain = [(1, f"u{k}", f"u{k + 1}", 2.0) for k in range(11)]
    got = {(r.from_unit, r.to_unit): (r.factor, r.steps, r.conflict) for r in units.closed(factors(spark, [*chain, (1, "u3", "u4", None), (1, "x", "y", -1.0), (2, "u0", "u9", 7.0)]), "item_no").where("item_no = 1").collect()}
    assert len(got) == 144 and got["u0", "u11"] == (2048.0, 11, False) and got["u11", "u0"] == (1 / 2048, 11, False) and got["u5", "u5"] == (1.0, 0, False)
    assert units.closed(factors(spark, []), "item_no").collect() == []


def test_ways_that_disagree_are_a_conflict(spark):
    ring = [(1, "a", "b", 2.0), (1, "b", "c", 3.0), (1, "c", "d", 1.0), (1, "d", "e", 1.0), (1, "a", "e", 6.5), (2, "a", "b", 2.0), (2, "b", "a", 0.5), (3, "a", "b", 2.0), (3, "a", "b", 3.0)]
    got = {r.item_no: r.c for r in units.closed(factors(spark, ring), "item_no").groupBy("item_no").agg(F.bool_or("conflict").alias("c"), F.bool_and("conflict").alias("all")).collect()}
    assert got == {1: True, 2: False, 3: True}


def test_cascade_compares_unlike_units(spark):
    offer = spark.createDataFrame([(k, None, "x", D(q), D(1), [], u) for k, q, u in ((1, 2, "roll"), (2, 2, "roll"), (3, 5, "kit"), (4, 7, None))], "line_no long, supplier_code string, description string, quantity decimal(14,3), unit_price decimal(14,4), flags array<string>, unit_of_measure string")
    asked = spark.createDataFrame([(k, "y", D(q), u) for k, q, u in ((1, 200, "meter"), (2, 150, "meter"), (3, 5, "meter"), (4, 7, "meter"))], "item_no long, description string, quantity decimal(14,3), unit_of_measure string")
    found = spark.createDataFrame([(k, 1, k, "y", 0.9) for k in (1, 2, 3, 4)], "line_no long, rank int, item_no long, description string, score double")
    ways = units.closed(factors(spark, [(1, "roll", "meter", 100.0), (2, "roll", "meter", 100.0)]), "item_no")
    got = {r.line_no: (r.status, r.quantity_delta, r.needs_review, "sin conversion" in r.reasoning) for r in reconcile(offer, asked, found, conversions=ways).collect()}
    assert got == {1: ("match", 0, False, False), 2: ("partial_quantity", 50, False, False), 3: ("match", 0, True, True), 4: ("match", 0, False, False)}
    plain = {r.line_no: (r.status, r.quantity_delta) for r in reconcile(offer, asked, found).collect()}
    assert plain[1] == ("partial_quantity", -198)  # without conversions as before


T0 = datetime(2024, 5, 1)
TOLD = "confirmation_id long, provider_id string, supplier_code string, item_id string, accepted boolean, confirmed_at timestamp"


def told(spark, rows):
    return spark.createDataFrame([(i, "p", code, item, yes, T0 + timedelta(days=day)) for i, code, item, yes, day in rows], TOLD)


def learnt(store):
    return {r.supplier_code: r.item_id for r in store.read("supplier_item_aliases").collect()}


def test_aliases_are_learnt_in_rounds(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    first = told(spark, [(1, "A", "i1", True, 1), (1, "A", "i1", True, 1), (2, "B", "i2", True, 1), (3, "B", "i3", True, 2), (4, "C", "i4", False, 1), (5, None, "i5", True, 1), (6, "D", "i6", True, 1)])
    aliases.learn(store, first, 1)
    assert learnt(store) == {"A": "i1", "D": "i6"}  # B is split, C was rejected
    version = aliases.learn(store, told(spark, [(9, "A", "i9", True, 9)]), 1)
    assert version == store.state().version and learnt(store)["A"] == "i1"  # the round is known
    aliases.learn(store, told(spark, [(7, "B", "i3", True, 3), (8, "B", "i3", True, 4), (9, "D", "i6", False, 5), (10, "A", "i7", True, 5), (11, "A", "i7", True, 6), (12, "A", "i7", True, 7)]), 2)
    assert learnt(store) == {"A": "i7", "B": "i3"}  # D was rejected last
    assert {r.supplier_code: r.confirmed_at for r in store.read("supplier_item_aliases").collect()} == {"A": T0 + timedelta(days=5), "B": T0 + timedelta(days=2)}
    aliases.learn(store, told(spark, []), 3)
    assert learnt(store) == {"A": "i7", "B": "i3"} and store.read("alias_votes").count() == 6


def test_cascade_uses_what_was_learnt(spark, tmp_path):
    from tests.test_cascade import case

    store = Store(spark, str(tmp_path), buckets=4)
    offer, items, found = case(spark)
    line, item = offer.first(), items.orderBy(F.desc("item_no")).first()
    aliases.learn(store, spark.createDataFrame([(1, "p", "SKU-1", str(item.item_no), True, T0)], TOLD), 1)
    known = store.of("supplier_item_aliases", "p").select("supplier_code", F.col("item_id").cast("long").alias("item_no"))
    coded = offer.withColumn("supplier_code", F.when(F.col("line_no") == line.line_no, "SKU-1").otherwise(F.col("supplier_code")))
    row = reconcile(coded, items, found, known).where(F.col("line_no") == line.line_no).first()
    assert (row.item_no, row.decided_by, row.confidence) == (item.item_no, "alias", 1.0)


def test_sketches_merge_as_if_made_at_once(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("flag"), (F.col("id") % 24).alias("month"), (F.xxhash64("id") % 100_000 / 7).alias("price"), (F.xxhash64("id") % 4_000).alias("supplier"))
    partial = rollups.partial_sketches(rows.withColumn("price", F.when(F.col("month") != 5, F.col("price"))), ["flag", "month"], "price", "supplier")
    got = rollups.estimates(rollups.rolled_up(partial, ["flag", "month"], cube=True)).collect()
    assert len(got) == 24 + 24 + 3 + 1
    frame = rows.toPandas()
    frame.loc[frame.month == 5, "price"] = None
    for r in got:
        own = frame[((frame.flag == r.flag) | (r.flag is None)) & ((frame.month == r.month) | (r.month is None))]
        assert r.n == own.price.notna().sum() and abs(r.suppliers - own.supplier.nunique()) <= rollups.COUNT_ERROR * own.supplier.nunique()
        for q, at in ((0.25, r.q25), (0.5, r.q50), (0.75, r.q75)):
            assert r.n == 0 or abs((own.price.dropna() <= at).mean() - q) <= rollups.RANK_ERROR
    by_month = rollups.rolled_up(partial, ["month"])
    assert {r.month: r.n for r in by_month.select("month", "n").collect()} == frame.groupby("month").price.count().to_dict()


def test_offers_close_when_no_number_is_missing_or_time_is_up(spark, tmp_path):
    """Late, repeated and out-of-order lines over several batches."""
    source, out = tmp_path / "in", []
    schema = "offer_id string, line_no int, last_line int, at timestamp"
    at = lambda minutes: T0 + timedelta(minutes=minutes)
    batches = [
        [("a", 2, None, at(0)), ("a", 1, None, at(1)), ("b", 1, None, at(1)), ("a", 2, None, at(1)), (None, 1, None, at(1)), ("a", 0, None, at(1))],
        [("a", 4, 4, at(2)), ("c", 1, 1, at(2))],
        [("a", 3, None, at(3)), ("b", 4, 5, at(3))],
        [("a", 3, None, at(4)), ("z", 1, None, at(120))],
        [("z", 2, None, at(121))],
        [("y", 1, 1, at(300))],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = assembled(spark.readStream.schema(schema).parquet(str(source)))
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.offer_id: (r.lines, r.last_line, r.repeated, r.missing, r.complete, r.closed_by) for r in out}
    assert len(out) == len(got) and got["c"] == (1, 1, 0, [], True, "numbers") and got["y"] == (1, 1, 0, [], True, "numbers")
    assert got["a"] == (4, 4, 1, [], True, "numbers") and got["b"] == (2, 5, 0, [2, 3, 5], False, "time") and got["z"] == (2, 2, 0, [], False, "time")
