"""Checks on numbered lines: gaps, duplicates, and two readings of one document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def line_gaps(df: DataFrame, group: list[str], line: str = "line_no") -> DataFrame:
    """group, line_no (the first missing one) and missing, for each hole between lines that are there."""
    seen = df.select(*group, F.col(line).alias("_line")).distinct()
    before = F.lag("_line").over(Window.partitionBy(*group).orderBy("_line"))
    gaps = seen.withColumn("_before", before).where("_line <> _before + 1")
    return gaps.select(*group, (F.col("_before") + 1).alias("line_no"), (F.col("_line") - F.col("_before") - 1).alias("missing"))


def duplicate_lines(df: DataFrame, key: list[str], order: list) -> tuple[DataFrame, DataFrame]:
    """(the first row of each key, the further ones with their `occurrence`)."""
    numbered = df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return numbered.where("occurrence = 1").drop("occurrence"), numbered.where("occurrence > 1")


def cross_check(read: DataFrame, reference: DataFrame) -> DataFrame:
    """line_no, code, field, read_value, reference_value where two readings of a document differ.

    Both have line_no, unit_price, quantity, supplier_code.  A price is compared where the reference has one, a code
    where it has a non-empty one; lines that only the reference has are `omitted`; lines that only `read` has pass.
    """
    old = reference.select("line_no", *[F.col(c).alias(f"_{c}") for c in ("unit_price", "quantity", "supplier_code")], F.lit(True).alias("_there"))
    new = read.select("line_no", "unit_price", "quantity", "supplier_code", F.lit(True).alias("_read"))
    both = old.join(new, "line_no", "left")

    def differs(field: str, when):
        value, other = F.col(field).cast("string"), F.col(f"_{field}").cast("string")
        return F.when(F.col("_read") & when & ~F.col(field).eqNullSafe(F.col(f"_{field}")), F.struct(F.lit("llm_retry").alias("code"), F.lit(field).alias("field"), value.alias("read_value"), other.alias("reference_value")))

    none = F.lit(None).cast("string")
    omitted = F.when(F.col("_read").isNull(), F.struct(F.lit("llm_failed").alias("code"), F.lit("line").alias("field"), none.alias("read_value"), none.alias("reference_value")))
    found = F.array(
        differs("unit_price", F.col("_unit_price").isNotNull()), differs("quantity", F.lit(True)), differs("supplier_code", F.coalesce(F.col("_supplier_code") != "", F.lit(False))), omitted
    )
    return both.select("line_no", F.inline(F.filter(found, lambda x: x.isNotNull())))
