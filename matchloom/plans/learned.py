"""Queries on unit conversions, learnt aliases and rolled-up sketches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases, rollups, units
from ..operators.cascade import alias_matches
from ..operators.store import Store
from ..written import scratch, written
from .registry import query, t

_UNITS = ("unit", "pack", "box", "roll", "drum", "kit")
_EDGES = "SELECT p_brand AS brand, p_size % 6 AS a, (p_size + 1 + p_partkey % 3) % 6 AS b, pow(2, p_size % 6 - (p_size + 1 + p_partkey % 3) % 6) * CASE WHEN p_brand = 'Brand#3' AND p_partkey % 50 = 0 THEN 3 ELSE 1 END AS factor FROM part"
_NAMED = "['" + "', '".join(_UNITS) + "']"


@query(f"""WITH RECURSIVE said AS ({_EDGES}), edges AS (SELECT DISTINCT brand, a, b, factor FROM said UNION SELECT DISTINCT brand, b, a, 1 / factor FROM said),
  walks AS (SELECT DISTINCT brand, a, a AS b, 1.0::DOUBLE AS factor, 0 AS steps FROM edges UNION SELECT w.brand, w.a, e.b, w.factor * e.factor, steps + 1 FROM walks w JOIN edges e ON w.brand = e.brand AND w.b = e.a WHERE steps < 5),
  ways AS (SELECT brand, a, b, arg_min(factor, (steps, factor)) AS factor, min(steps)::INT AS steps, max(factor) > min(factor) * 1.000001 AS torn FROM walks GROUP BY brand, a, b)
  SELECT brand, ({_NAMED})[a + 1] AS from_unit, ({_NAMED})[b + 1] AS to_unit, round(factor, 9) AS factor, steps, bool_or(torn) OVER (PARTITION BY brand) AS conflict FROM ways""")
def unit_closure(spark, d):
    """All conversions that factors between neighbouring units imply, for each brand; one brand's factors contradict each other."""
    named = F.array(*[F.lit(u) for u in _UNITS])
    n, m = F.col("p_size") % 6, (F.col("p_size") + 1 + F.col("p_partkey") % 3) % 6
    odd = F.when((F.col("p_brand") == "Brand#3") & (F.col("p_partkey") % 50 == 0), 3.0).otherwise(1.0)
    said = t(spark, d, "part").select(F.col("p_brand").alias("brand"), F.element_at(named, (n + 1).cast("int")).alias("from_unit"), F.element_at(named, (m + 1).cast("int")).alias("to_unit"), (F.pow(F.lit(2.0), n - m) * odd).alias("factor"))
    return units.closed(said, "brand").withColumn("factor", F.round("factor", 9))


_STATED = """stated AS (SELECT p_partkey AS item_no, CASE WHEN p_partkey % 4 = 0 THEN 'roll' WHEN p_partkey % 4 = 1 THEN 'box' END AS from_unit, CASE WHEN p_partkey % 4 = 0 THEN 'meter' WHEN p_partkey % 4 = 1 THEN 'unit' END AS to_unit,
    CASE WHEN p_partkey % 4 = 0 THEN p_size / 2 WHEN p_partkey % 4 = 1 THEN 1000 + p_size END::DOUBLE AS factor FROM part)"""


def _stated(spark, d):
    half = F.concat((F.col("p_size") / 2).cast("int").cast("string"), F.when(F.col("p_size") % 2 == 1, ",5").otherwise(""))
    said = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" rollo x "), half, F.lit(" m"))).when(F.col("p_partkey") % 4 == 1, F.concat(F.lit(" CAJA  de 1."), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(" Unidades"))).when(F.col("p_partkey") % 4 == 2, " caja x 1 caja").otherwise("")
    return units.stated_factors(t(spark, d, "part").select(F.col("p_partkey").alias("item_no"), F.concat("p_name", said).alias("description")), "item_no", "description")


@query(f"WITH {_STATED} SELECT * FROM stated WHERE factor IS NOT NULL")
def pack_sizes(spark, d):
    return _stated(spark, d)


@query(f"""WITH {_STATED}, rows AS (SELECT l_orderkey, l_linenumber, l_partkey AS item_no, l_quantity AS quantity, ['roll', 'box', 'meter', 'unit', NULL][l_orderkey % 5 + 1] AS offered, ['meter', 'unit', 'roll'][l_partkey % 3 + 1] AS requested FROM lineitem),
  ways AS (SELECT * FROM stated WHERE factor IS NOT NULL UNION ALL SELECT item_no, to_unit, from_unit, 1 / factor FROM stated WHERE factor IS NOT NULL)
  SELECT l_orderkey, l_linenumber, item_no, quantity, offered, requested, CASE WHEN offered IS NULL OR offered = requested THEN 'same' WHEN factor IS NULL THEN 'unknown' ELSE 'converted' END AS conversion,
    CASE WHEN offered IS NULL OR offered = requested THEN quantity ELSE round(quantity * factor, 4) END AS converted_quantity FROM rows LEFT JOIN ways USING (item_no) WHERE ways.item_no IS NULL OR from_unit = offered AND to_unit = requested
  UNION ALL SELECT l_orderkey, l_linenumber, item_no, quantity, offered, requested, CASE WHEN offered IS NULL OR offered = requested THEN 'same' ELSE 'unknown' END, CASE WHEN offered IS NULL OR offered = requested THEN quantity END
  FROM rows WHERE item_no IN (SELECT item_no FROM ways) AND NOT EXISTS (SELECT 1 FROM ways w WHERE w.item_no = rows.item_no AND from_unit = offered AND to_unit = requested)""")
def unit_quantities(spark, d):
    """Offered quantities in the units that were asked for, by the pack sizes of the items' descriptions."""
    named = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), (at + 1).cast("int"))
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("item_no"), F.col("l_quantity").alias("quantity"), named(("roll", "box", "meter", "unit", None), F.col("l_orderkey") % 5).alias("offered"), named(("meter", "unit", "roll"), F.col("l_partkey") % 3).alias("requested"))
    got = units.converted(rows, units.closed(_stated(spark, d), "item_no"), "item_no", "quantity", "offered", "requested")
    return got.withColumn("converted_quantity", F.round("converted_quantity", 4))


_VOTES = """told AS (SELECT o_orderkey AS id, 'p' || o_custkey % 7 AS provider_id, 'c' || o_custkey % 83 AS supplier_code, 'i' || CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 ELSE o_custkey % 4 END AS item_id, o_orderstatus <> 'F' AS accepted, o_orderdate AS moment FROM orders),
  sums AS (SELECT provider_id, supplier_code, item_id, greatest(count(*) FILTER (WHERE accepted) - count(*) FILTER (WHERE NOT accepted), 0) AS votes, min(moment) FILTER (WHERE accepted) AS since, max(moment) FILTER (WHERE accepted) AS last_yes, max(moment) FILTER (WHERE NOT accepted) AS last_no FROM told GROUP BY ALL),
  placed AS (SELECT *, sum(votes) OVER (PARTITION BY provider_id, supplier_code) AS n, row_number() OVER (PARTITION BY provider_id, supplier_code ORDER BY votes DESC, last_yes DESC NULLS LAST, item_id) AS place FROM sums),
  learnt AS (SELECT provider_id, supplier_code, item_id, since FROM placed WHERE place = 1 AND votes >= 1 AND votes / n >= 2 / 3::DOUBLE AND NOT coalesce(last_no >= last_yes, false))"""


def _learnt(spark, d) -> Store:
    """A store that learnt from three rounds of confirmations, the second of them given twice."""
    store, n, c = Store(spark, scratch(spark, "aliases"), buckets=8), F.col("o_orderkey"), F.col("o_custkey")
    text = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    told = t(spark, d, "orders").select(n.alias("confirmation_id"), text("p", c % 7).alias("provider_id"), text("c", c % 83).alias("supplier_code"), text("i", F.when(n % 5 == 0, n % 3).otherwise(c % 4)).alias("item_id"), (F.col("o_orderstatus") != "F").alias("accepted"), F.col("o_orderdate").cast("timestamp").alias("confirmed_at"))
    for k, round_no in enumerate((0, 1, 1, 2)):
        part = told.where(F.year("confirmed_at") % 3 == round_no)
        aliases.learn(store, part.unionByName(part.limit(3)) if k == 0 else part, round_no)
    return store


@query(f"WITH {_VOTES} SELECT provider_id, supplier_code, item_id, since::DATE::VARCHAR AS since FROM learnt")
def aliases_learnt(spark, d):
    return _learnt(spark, d).read("supplier_item_aliases").select("provider_id", "supplier_code", "item_id", F.col("confirmed_at").cast("date").cast("string").alias("since"))


@query(f"WITH {_VOTES} SELECT l_orderkey, l_linenumber, l_partkey, item_id FROM lineitem JOIN learnt ON provider_id = 'p' || l_suppkey % 7 AND supplier_code = 'c' || l_partkey % 83")
def aliases_applied(spark, d):
    """Offer lines whose code has an alias that earlier rounds taught: level 0 of the cascade, provider by provider in one join."""
    learnt = _learnt(spark, d).read("supplier_item_aliases").select(F.concat_ws("/", "provider_id", "supplier_code").alias("supplier_code"), F.col("item_id").alias("item_no"))
    key = F.concat(F.lit("p"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/c"), (F.col("l_partkey") % 83).cast("string"))
    rows = t(spark, d, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("line_no"), key.alias("supplier_code"))
    return alias_matches(rows, learnt).select("line_no.*", F.col("item_no").alias("item_id"))


@query("""WITH r AS (SELECT l_returnflag AS flag, year(l_shipdate)::INT AS year, l_extendedprice AS price FROM lineitem)
  SELECT flag, year, grouping(flag, year)::INT AS level, count(*) AS n, sum(price::DECIMAL(18, 4))::DOUBLE AS total, true AS median_ok, true AS suppliers_ok FROM r GROUP BY CUBE (flag, year)""")
def price_rollup(spark, d):
    """Prices by flag and year at all levels, from sketches by month; the medians' ranks and the suppliers counted are held to their bounds against the rows."""
    rows = t(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"), F.col("l_extendedprice").alias("price"), F.col("l_suppkey").alias("supplier"))
    partial = written(rollups.partial_sketches(rows, ["flag", "year", "month"], "price", "supplier"), "price-sketches")
    found = written(rollups.estimates(rollups.rolled_up(partial, ["flag", "year"], cube=True), (0.5,)), "price-rollup")
    # A row is checked against each level that it is part of.
    small = F.broadcast(found.select("level", F.col("flag").alias("_flag"), F.col("year").alias("_year"), "q50"))  # flags by years
    each = rows.withColumn("level", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    each = each.select("price", "supplier", "level", F.when(F.col("level") < 2, F.col("flag")).alias("flag"), F.when(F.col("level") % 2 == 0, F.col("year")).alias("year"))
    same = (each["level"] == small["level"]) & each["flag"].eqNullSafe(F.col("_flag")) & each["year"].eqNullSafe(F.col("_year"))
    true = each.join(small, same).groupBy(each["level"], "flag", "year").agg((F.count_if(F.col("price") <= F.col("q50")) / F.count("*")).alias("_rank"), F.count_distinct("supplier").alias("_suppliers"))
    true = true.select(F.col("level").alias("_l"), F.col("flag").alias("_f"), F.col("year").alias("_y"), "_rank", "_suppliers")
    both = found.join(true, (F.col("level") == F.col("_l")) & F.col("flag").eqNullSafe(F.col("_f")) & F.col("year").eqNullSafe(F.col("_y")))
    # A small group's median can be no nearer to a half than its rows allow.
    close = F.abs(F.col("_rank") - 0.5) <= rollups.RANK_ERROR + 1 / F.col("n")
    return both.select("flag", "year", "level", "n", F.col("total").cast("double").alias("total"), close.alias("median_ok"), (F.abs(F.col("suppliers") - F.col("_suppliers")) <= rollups.COUNT_ERROR * F.col("_suppliers")).alias("suppliers_ok"))
