"""Sketches of prices and suppliers, kept by partition and rolled up: quantiles and distinct counts without the rows.

A partial row holds a KLL sketch of prices and an HLL sketch of suppliers.  Both merge, so a day's rows are read once, and every
level of a cube, or any span of days, follows from the partial rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Of KLL, whose rank error falls as it grows (about 1.7 % at 200); of HLL, the logarithm of its registers (about 1.6 % at 12).
KLL_K, HLL_K = 200, 12
#: Rank error, and relative error of distinct counts, that the tests hold the sketches to.
RANK_ERROR, COUNT_ERROR = 0.03, 0.05


def partial_sketches(rows: DataFrame, by: list[str], value: str, distinct: str) -> DataFrame:
    """`by`, n, total, prices (KLL), suppliers (HLL): to be written by partition and merged later.  Null values are left out of prices and totals."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("decimal(18,4)")).alias("total"), F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("prices"), F.hll_sketch_agg(distinct, HLL_K).alias("suppliers"))


def rolled_up(partial: DataFrame, by: list[str], cube: bool = False) -> DataFrame:
    """Partial rows merged by `by`, or by all its subsets, with `level` as Spark's grouping_id numbers them."""
    sums = [F.sum("n").alias("n"), F.sum("total").alias("total"), F.kll_merge_agg_double("prices").alias("prices"), F.hll_union_agg("suppliers").alias("suppliers")]
    return partial.cube(*by).agg(F.grouping_id().cast("int").alias("level"), *sums) if cube else partial.groupBy(*by).agg(*sums)


def estimates(sketched: DataFrame, quantiles: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """The sketches' quantiles (q25, q50, ...) and distinct count in place of the sketches; groups without values have no quantiles."""
    at = [F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("prices", F.lit(q))).alias(f"q{round(q * 100)}") for q in quantiles]
    return sketched.select(*[c for c in sketched.columns if c not in ("prices", "suppliers")], *at, F.hll_sketch_estimate("suppliers").alias("suppliers"))
