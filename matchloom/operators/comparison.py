"""All offers of a requisition side by side: the prices of each item by provider, the best ones, coverage, and totals.

Quotes are rows of item_no, provider, quantity and unit_price (decimals), of one requisition or, with further `by` columns,
of many.  A provider may quote an item in several lines; its cheapest line, and of equally cheap ones the one of more units, is its
quote.  Everything combines by (item, provider) first, so that what is ranked for an item is as small as its providers
are many, however many lines a hot item or provider has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import EngineError
from .summary import percent

#: Providers that a matrix shows as columns; more are an error, and stay in the long form.
MAX_COLUMNS = 200
#: Quotes that a task groups; beyond what the session's shuffles deal, more tasks are made, so that none grows with the input.
TASK_ROWS = 500_000
#: Statuses of lines whose price does not stand for the item.
NOT_COMPARABLE = ("alternative", "extra", "missing_from_offer")


def quoted(reconciled: DataFrame, offers: DataFrame, providers: DataFrame, offer_items: DataFrame, reconciliations: DataFrame) -> DataFrame:
    """requisition_id, item_no, provider, quantity, unit_price: the comparable lines of the newest reconciliation of each offer."""
    newest = reconciliations.groupBy("offer_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("reconciliation_id"))
    heads = newest.join(offers.select(F.col("id").alias("offer_id"), "requisition_id", "provider_id"), "offer_id").join(providers.select(F.col("id").alias("provider_id"), F.col("name").alias("provider")), "provider_id")
    lines = reconciled.where(F.col("requisition_item_id").isNotNull() & ~F.col("status").isin(*NOT_COMPARABLE)).select("reconciliation_id", F.col("requisition_item_id").cast("long").alias("item_no"), F.col("offer_item_id").cast("int").alias("line_no"))
    prices = offer_items.select("offer_id", "line_no", F.col("offered_quantity").alias("quantity"), "unit_price")
    return lines.join(heads, "reconciliation_id").join(prices, ["offer_id", "line_no"]).select("requisition_id", "item_no", "provider", "quantity", "unit_price")


def offers_of(quotes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, item_no, provider, unit_price, quantity, lines: one quote for each item and provider; lines without a price are none."""
    priced = quotes.where(F.col("unit_price").isNotNull() & F.col("item_no").isNotNull())
    best = F.min(F.struct("unit_price", (-F.col("quantity")).alias("_q")))
    tasks = -(-priced.count() // TASK_ROWS)
    if tasks > int(quotes.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        priced = priced.repartition(tasks, *by, "item_no", "provider")
    return priced.groupBy(*by, "item_no", "provider").agg(best.alias("_best"), F.count("*").alias("lines")).select(*by, "item_no", "provider", F.col("_best.unit_price").alias("unit_price"), (-F.col("_best._q")).alias("quantity"), "lines")


def best_quotes(offered: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each item the cheapest and second cheapest provider, what the best saves, and how many quote it; ties go to the first name."""
    item = Window.partitionBy(*by, "item_no")
    order = item.orderBy("unit_price", "provider")
    two = offered.withColumn("_place", F.row_number().over(order)).where("_place <= 2")  # a group limit before the shuffle

    def of(place: int, column: str) -> Column:
        return F.max(F.when(F.col("_place") == place, F.col(column)))

    ranked = two.groupBy(*by, "item_no").agg(of(1, "provider").alias("best_provider"), of(1, "unit_price").alias("best_price"), of(2, "provider").alias("second_provider"), of(2, "unit_price").alias("second_price"))
    sizes = offered.groupBy(*by, "item_no").agg(F.count("*").alias("providers"), F.max("unit_price").alias("worst_price"))
    saving = F.when(F.col("second_price") > 0, F.round((F.col("second_price") - F.col("best_price")) / F.col("second_price") * 100, 2))
    return ranked.join(sizes, [*by, "item_no"]).select(*by, "item_no", "providers", "best_provider", "best_price", "second_provider", "second_price", "worst_price", saving.cast("double").alias("saving_pct"))


def coverage(offered: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """For each provider: items it quotes of those asked for (item_no, quantity), those at which it alone or first is cheapest, and its total for the asked quantities.

    `only_here`: items that nobody else quotes.
    """
    wanted = asked.select(*by, "item_no", F.col("quantity").alias("asked"))
    best = best_quotes(offered, by).select(*by, "item_no", "best_provider", "providers")
    rows = offered.join(wanted, [*by, "item_no"]).join(best, [*by, "item_no"])
    totals = wanted.groupBy(*by).agg(F.count("*").alias("items"))
    of = rows.groupBy(*by, "provider").agg(
        F.count("*").alias("covered"), F.count_if(F.col("provider") == F.col("best_provider")).alias("cheapest"), F.count_if(F.col("providers") == 1).alias("only_here"),
        F.sum((F.col("unit_price") * F.col("asked")).cast("decimal(38,4)")).alias("total"),
    )
    joined = of.join(totals, list(by)) if by else of.crossJoin(totals)  # one row
    return joined.withColumn("coverage_pct", percent(F.col("covered"), F.col("items")))


def award(offered: DataFrame, asked: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every item at its best price: items, items nobody quotes, providers needed, and the total, beside the best single provider of most coverage."""
    wanted = asked.select(*by, "item_no", F.col("quantity").alias("asked"))
    each = wanted.join(best_quotes(offered, by), [*by, "item_no"], "left")
    split = each.groupBy(*by).agg(
        F.count("*").alias("items"), F.count_if(F.col("best_price").isNull()).alias("unquoted"), F.count_distinct("best_provider").alias("providers_needed"), F.sum((F.col("best_price") * F.col("asked")).cast("decimal(38,4)")).alias("split_total")
    )
    single = coverage(offered, asked, by).groupBy(*by).agg(F.min(F.struct((-F.col("covered")).alias("_c"), "total", "provider")).alias("_one"))
    single = single.select(*by, F.col("_one.provider").alias("single_provider"), (-F.col("_one._c")).alias("single_covered"), F.col("_one.total").alias("single_total"))
    return split.join(single, list(by), "left") if by else split.crossJoin(single)


def totals(offered: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sums by item and provider, by item, by provider, and over all, as `level` says; `offered` has one row for each item and provider."""
    item, provider, others = F.col("item_no"), F.col("provider"), [F.col(c) for c in by]
    sets = [[*others, item], [*others, provider], others]
    level = F.when(F.grouping("item_no") == 0, "item").when(F.grouping("provider") == 0, "provider").otherwise("all")
    amount = (F.col("unit_price") * F.col("quantity")).cast("decimal(38,4)")
    upper = offered.groupingSets(sets, *others, item, provider).agg(level.alias("level"), F.count("*").alias("quotes"), F.min("unit_price").alias("least_price"), F.max("unit_price").alias("most_price"), F.sum(amount).alias("amount"))
    # The lowest level has nothing to sum, and only the others' few groups are held.
    return offered.select(*others, item, provider, F.lit("item and provider").alias("level"), F.lit(1).cast("long").alias("quotes"), F.col("unit_price").alias("least_price"), F.col("unit_price").alias("most_price"), amount.alias("amount")).unionByName(upper)


def matrix(offered: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """`by`, item_no and a column of unit prices for each provider, in order of names; up to MAX_COLUMNS providers."""
    names = [r.provider for r in offered.select("provider").where(F.col("provider").isNotNull()).distinct().orderBy("provider").limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise EngineError("too many providers for a matrix; use the rows of offers_of", providers=f"more than {MAX_COLUMNS}")
    if not names:
        return offered.select(*by, "item_no").distinct()
    return offered.groupBy(*by, "item_no").agg(*[F.min(F.when(F.col("provider") == n, F.col("unit_price"))).alias(n) for n in names])
