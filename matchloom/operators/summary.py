"""Summaries of reconciliations, and their quality against a guide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import is_shortfall

COVERING = ("match", "partial_quantity", "semantic_match")


def percent(part: Column, whole: Column) -> Column:
    """To one place, halves up, as SQL rounds doubles: by tenfold values, as 18 / 4000 * 100 is a little below 0.45."""
    return F.round(part / whole * 100 * 10) / 10


def summarize(lines: DataFrame, requisition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row (for each of `keys`) of counts, coverage and totals.

    An ambiguous loser counts in comparable_total, and an item may so be counted twice: that is the rule.
    """
    keys = keys or []
    of_status = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("match", "partial_quantity", "semantic_match", "alternative", "missing_from_offer", "extra", "ambiguous")}
    price = F.coalesce("price_total", F.lit(0))
    asked = F.col("item_no").isNotNull()
    counted = lines.groupBy(*keys).agg(
        F.count("line_no").alias("offer_lines"),
        *of_status.values(),
        F.count_if("needs_review").alias("needs_review"),
        F.sum(price).cast("decimal(18,2)").alias("quoted_total"),
        F.sum(F.when(asked & (F.col("status") != "alternative"), price).otherwise(0)).cast("decimal(18,2)").alias("comparable_total"),
        F.sum(F.when(F.col("status") == "extra", price).otherwise(0)).cast("decimal(18,2)").alias("extras_total"),
        F.count_if(is_shortfall(F.col("quantity_delta"))).alias("shortfall_lines"),
        F.count_if(F.coalesce(F.col("quantity_delta") > 0, F.lit(False))).alias("overage_lines"),
    )
    by_item = lines.where(asked).groupBy(*keys, "item_no").agg(
        F.bool_or(F.col("line_no").isNotNull() & F.col("status").isin(*COVERING)).alias("_covered"), F.bool_or(F.col("status") == "ambiguous").alias("_ambiguous")
    )
    items = by_item.groupBy(*keys).agg(F.count_if("_covered").alias("covered"), F.count_if(F.col("_ambiguous") & ~F.col("_covered")).alias("ambiguous_items"))
    requested = requisition.groupBy(*keys).agg(F.count("*").alias("requisition_items"))
    both = counted.join(items, keys).join(requested, keys) if keys else counted.crossJoin(items).crossJoin(requested)
    share = percent(F.col("covered"), F.col("requisition_items"))
    return both.withColumn("coverage_pct", share).withColumn("not_covered", F.col("requisition_items") - F.col("covered") - F.col("ambiguous_items"))


def status_counts(lines: DataFrame, column: str = "status") -> DataFrame:
    return lines.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """Each parent with the number of its children, 0 included.  Children are counted before the join."""
    counted = children.groupBy(F.col(child_key).alias("_key")).agg(F.count("*").alias("n"))
    return parents.join(counted, F.col(parent_key) == F.col("_key"), "left").withColumn("n", F.coalesce("n", F.lit(0))).drop("_key")


def recall_at_k(ranked: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    """lines, recall_at_1, recall_at_k over the lines of `truth` (line_no, item_no); lines that lost the item count as misses."""
    places = truth.join(ranked.select("line_no", "item_no", "rank"), ["line_no", "item_no"], "left").groupBy("line_no").agg(F.min("rank").alias("place"))
    hit = F.coalesce((F.col("place") <= k).cast("double"), F.lit(0.0))
    return places.agg(F.count("*").alias("lines"), F.avg(F.coalesce((F.col("place") == 1).cast("double"), F.lit(0.0))).alias("recall_at_1"), F.avg(hit).alias("recall_at_k"))


def lost_lines(ranked: DataFrame, truth: DataFrame, k: int = 5) -> DataFrame:
    return truth.join(ranked.where(F.col("rank") <= k), ["line_no", "item_no"], "left_anti")


KNOWN_LABELS = ("match", "partial_quantity", "semantic_match", "missing_from_offer", "extra")


def accuracy(lines: DataFrame, guide: DataFrame) -> DataFrame:
    """Item and item-and-status accuracy over all guide rows with an offer line, and over those with a known label.

    `guide`: line_no, item_no (null: an extra), label.  No row is dropped for its label.
    """
    got = lines.where("line_no IS NOT NULL").select("line_no", F.col("item_no").alias("got_item"), F.col("status").alias("got_status"))
    both = guide.where("line_no IS NOT NULL").join(got, "line_no", "left")
    item = F.col("item_no").eqNullSafe(F.col("got_item"))
    known = F.col("label").isin(*KNOWN_LABELS)
    return both.agg(
        F.count("*").alias("rows"), F.count_if(item).alias("item_ok"), F.count_if(item & (F.col("label") == F.col("got_status"))).alias("status_ok"),
        F.count_if(known).alias("known_rows"), F.count_if(known & item).alias("known_item_ok"), F.count_if(known & item & (F.col("label") == F.col("got_status"))).alias("known_status_ok"),
    )


def missing_quality(lines: DataFrame, guide: DataFrame) -> DataFrame:
    """How many items were found missing, should have been, and both."""
    got = lines.where("status = 'missing_from_offer'").select("item_no").distinct().withColumn("_got", F.lit(1))
    wanted = guide.where("label = 'missing_from_offer'").select("item_no").distinct().withColumn("_wanted", F.lit(1))
    return got.join(wanted, "item_no", "full_outer").agg(F.count("_got").alias("found"), F.count("_wanted").alias("expected"), F.count_if(F.col("_got").isNotNull() & F.col("_wanted").isNotNull()).alias("both"))
