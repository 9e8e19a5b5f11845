"""Quantities over unlike units: factors between units as a graph, closed by joins, and checked for contradictions.

A factor says how many of `to_unit` one `from_unit` is, for a key (an item, a provider's code): one roll of item 7 is 100 meters.
Pack sizes are read from descriptions.  Units are few for each key (the vocabulary's, at most), so the closure
has few rows for each key, whatever the number of keys; it doubles the length of paths in each round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import UNIT_WORDS, folded, let, normalize_unit, parse_arg_number
from ..written import written

#: Relative difference of two ways between units that is not a contradiction.
TOLERANCE = 1e-6
_CONTAINERS = ("roll", "box", "bag", "pack", "set", "kit", "can", "bucket", "drum", "tube", "jar")
_WORDS = {kind: "|".join(sorted((w.replace("_", "/?") for u in units for w in UNIT_WORDS[u]), key=len, reverse=True)) for kind, units in (("container", _CONTAINERS), ("content", tuple(UNIT_WORDS)))}
#: A container, a word that joins, a number, and what it counts: `rollo x 100 m`, `caja de 12 unidades`.
PACK = rf"\b({_WORDS['container']})\s*(?:x|de|por|con)\s*(\d+(?:[.,]\d+)*)\s*({_WORDS['content']})\b"


def pack_size(description: Column) -> Column:
    """Struct of from_unit, to_unit and factor that a description states; null if it states none, or one of a unit by itself."""
    def stated(plain: Column) -> Column:
        return F.when(F.regexp_like(plain, F.lit(PACK)), F.struct(*[F.nullif(F.regexp_extract(plain, PACK, k), F.lit("")).alias(n) for k, n in ((1, "container"), (2, "number"), (3, "content"))]))

    def size(part: Column) -> Column:
        return F.struct(normalize_unit(part["container"]).alias("from_unit"), normalize_unit(part["content"]).alias("to_unit"), parse_arg_number(part["number"]).alias("factor"))

    # A pattern is met once for each description: its groups are used many times.
    found = let(F.trim(F.regexp_replace(folded(description), r"\s+", " ")), stated)
    kept = lambda s: F.when(s["from_unit"].isNotNull() & s["to_unit"].isNotNull() & (s["from_unit"] != s["to_unit"]) & (s["factor"] > 0), s)
    return let(found, lambda part: F.when(part.isNotNull(), let(size(part), kept)))


def stated_factors(rows: DataFrame, key: str, description: str) -> DataFrame:
    """`key`, from_unit, to_unit, factor of the rows whose description states a pack size."""
    # Dealt first: few tasks read a small table, and the patterns take far longer than its rows.
    return rows.select(key, description).repartition(key).select(key, pack_size(F.col(description)).alias("_size")).where(F.col("_size").isNotNull()).select(key, "_size.*")


def closed(factors: DataFrame, key: str) -> DataFrame:
    """`key`, from_unit, to_unit, factor, steps, conflict: every conversion that the factors (key, from_unit, to_unit, factor) imply, by a shortest way.

    Factors go both ways.  `conflict` marks all conversions of a key if any two ways between two units disagree.
    Factors that are null or not positive say nothing.
    """
    said = factors.where("factor > 0 AND from_unit IS NOT NULL AND to_unit IS NOT NULL").select(key, F.col("from_unit").alias("a"), F.col("to_unit").alias("b"), F.col("factor").cast("double").alias("factor"))
    said = written(said, "unit-factors")  # read four times
    both = said.unionByName(said.select(key, F.col("b").alias("a"), F.col("a").alias("b"), (1 / F.col("factor")).alias("factor"))).withColumn("steps", F.lit(1))
    units = both.select(key, "a").distinct()
    both = both.unionByName(units.select(key, "a", F.col("a").alias("b"), F.lit(1.0).alias("factor"), F.lit(0).alias("steps")))

    def shortest(ways: DataFrame) -> DataFrame:
        best = F.min(F.struct("steps", "factor"))
        found = ways.groupBy(key, "a", "b").agg(best.alias("_best"), (F.max("factor") > F.min("factor") * (1 + TOLERANCE)).alias("conflict"))
        return found.select(key, "a", "b", "_best.*", "conflict")

    paths = written(shortest(both), "unit-paths")
    known = paths.count()
    while True:
        left, right = paths.select(key, "a", F.col("b").alias("_m"), F.col("factor").alias("_f"), F.col("steps").alias("_s")), paths.select(key, F.col("a").alias("_m"), "b", "factor", "steps")
        ways = left.join(right, [key, "_m"]).select(key, "a", "b", (F.col("_f") * F.col("factor")).alias("factor"), (F.col("_s") + F.col("steps")).alias("steps"))
        paths = written(shortest(ways), "unit-paths")  # a way through the unit itself keeps what is known
        if (now := paths.count()) == known:
            break
        known = now
    torn = paths.where("conflict").select(key).distinct().withColumn("_torn", F.lit(True))
    return paths.drop("conflict").join(torn, key, "left").select(key, F.col("a").alias("from_unit"), F.col("b").alias("to_unit"), "factor", "steps", F.coalesce("_torn", F.lit(False)).alias("conflict"))


def converted(lines: DataFrame, closure: DataFrame, key: str, quantity: str, offered: str, requested: str) -> DataFrame:
    """`lines` with `converted_quantity` in the requested unit and `conversion`: same, converted, conflict, or unknown.

    Where a unit is not known the quantities are compared as they stand, as without conversions.
    """
    ways = closure.where("from_unit <> to_unit").select(F.col(key).alias("_key"), F.col("from_unit").alias("_from"), F.col("to_unit").alias("_to"), F.col("factor").alias("_factor"), F.col("conflict").alias("_conflict"))
    joined = lines.join(ways, (F.col(key) == F.col("_key")) & (F.col(offered) == F.col("_from")) & (F.col(requested) == F.col("_to")), "left")
    same = F.col(offered).isNull() | F.col(requested).isNull() | (F.col(offered) == F.col(requested))
    kind = F.when(same, "same").when(F.col("_factor").isNull(), "unknown").when(F.col("_conflict"), "conflict").otherwise("converted")
    number = F.when(kind == "same", F.col(quantity).cast("double")).when(kind == "converted", F.round(F.col(quantity).cast("double") * F.col("_factor"), 6))
    return joined.withColumns({"converted_quantity": number, "conversion": kind}).drop("_key", "_from", "_to", "_factor", "_conflict")
