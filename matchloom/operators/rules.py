"""Decision rules as Column expressions: lexical decision, status, review, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds of the rules.
AMBIGUOUS_BELOW = 0.6
SUPPLIER_EXTRA_BELOW = 0.6
PROPOSE_FROM = 0.25
MARGIN_CAP = 0.15
CONFIDENCE_CAP = 0.95
ALTERNATIVE_GAP = 0.15
PRIORITY = {"ambiguous": 0, "missing_from_offer": 1, "semantic_match": 2, "alternative": 3, "partial_quantity": 4, "extra": 5, "match": 6}
REVIEWED = ("semantic_match", "alternative", "ambiguous", "missing_from_offer")


def lexical_margin(first: Column, second: Column) -> Column:
    return F.when(second.isNull(), first).otherwise(first - second)


def lexical_confidence(first: Column, second: Column) -> Column:
    return F.round(F.least(F.lit(CONFIDENCE_CAP), first + F.least(lexical_margin(first, second), F.lit(MARGIN_CAP))), 2)


def lexical_kind(first: Column, flags: Column) -> Column:
    """`extra` or `match` from the best score (null: no candidate) and the supplier's flags."""
    flagged = F.array_contains(flags, "extra_suggested") & (first < SUPPLIER_EXTRA_BELOW)
    return F.when(first.isNull() | flagged | (first < PROPOSE_FROM), F.lit("extra")).otherwise(F.lit("match"))


def lexical_reason(first: Column, second: Column, description: Column, flags: Column) -> Column:
    """Fixed wording of each branch of the lexical decision."""
    flagged = F.array_contains(flags, "extra_suggested") & (first < SUPPLIER_EXTRA_BELOW)
    shown = F.format_string("%.3f", first)
    match = F.concat(
        F.lit("similitud lexica "), shown, F.lit(' contra "'), description, F.lit('"'),
        F.when(second.isNotNull(), F.format_string(", margen de %.3f sobre el siguiente candidato", lexical_margin(first, second))).otherwise(""),
        F.when(lexical_confidence(first, second) < AMBIGUOUS_BELOW, " (por debajo del umbral de confianza)").otherwise(""),
    )
    low = F.concat(F.lit("el proveedor la anota como producto adicional y la similitud con el mejor candidato es baja ("), shown, F.lit(' contra "'), description, F.lit('")'))
    none = F.concat(F.lit("ningun item solicitado se le parece (mejor candidato: "), shown, F.lit(")"))
    return F.when(first.isNull(), "no hay ningun item solicitado con el cual comparar").when(flagged, low).when(first < PROPOSE_FROM, none).otherwise(match)


def status_of(confidence: Column, delta: Column, flags: Column) -> Column:
    return (
        F.when(confidence < AMBIGUOUS_BELOW, "ambiguous")
        .when(delta != 0, "partial_quantity")
        .when(F.array_contains(flags, "technical_equivalent"), "semantic_match")
        .otherwise("match")
    )


def plain_number(x: Column) -> Column:
    """A decimal without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def status_reason(confidence: Column, offered: Column, requested: Column, flags: Column) -> Column:
    delta = offered - requested
    o, r, d = plain_number(offered), plain_number(requested), plain_number(F.abs(delta))
    less = F.concat(F.lit("el proveedor ofrece "), o, F.lit(" de las "), r, F.lit(" pedidas (faltan "), d, F.lit(")"))
    more = F.concat(F.lit("el proveedor ofrece "), o, F.lit(" contra "), r, F.lit(" pedidas ("), d, F.lit(" de mas, probable presentacion comercial)"))
    status = status_of(confidence, delta, flags)
    return (
        F.when(status == "ambiguous", F.format_string("confianza %.2f, por debajo del umbral de 0.6", confidence))
        .when(status == "partial_quantity", F.when(delta < 0, less).otherwise(more))
        .when(status == "semantic_match", "el proveedor lo ofrece como equivalente tecnico: requiere aprobacion del comprador")
        .otherwise("mismo producto y misma cantidad")
    )


def needs_review(status: Column, confidence: Column) -> Column:
    return status.isin(*REVIEWED) | (confidence < AMBIGUOUS_BELOW)


def is_shortfall(delta: Column) -> Column:
    return F.coalesce(delta < 0, F.lit(False))


def status_priority(status: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair]), status)


def extra_confidence(best_score: Column) -> Column:
    return F.when(best_score.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.round(best_score, 4)))


#: Losing lines that are put together at a time.
LOSERS_AT_ONCE = 4096


def losing_lines(claims: DataFrame) -> DataFrame:
    """_of, _first and _losers: each item with several claimants, its winner, and all of its losing lines in order.

    Places are told in a sort, which may go to disk, and lines are put together in parts; only the list of an item is whole, eight bytes a line.
    """
    order = Window.partitionBy("item_no").orderBy(F.desc("confidence"), "line_no")
    placed = claims.select("item_no", "line_no", F.row_number().over(order).alias("_place"), F.first("line_no").over(order).alias("_first")).where("_place > 1")
    parts = placed.groupBy("item_no", "_first", F.expr(f"_place div {LOSERS_AT_ONCE}").alias("_part")).agg(F.sort_array(F.collect_list(F.struct("_place", "line_no"))).alias("_lines"))
    parts = parts.select("item_no", "_first", F.struct("_part", F.col("_lines.line_no").alias("lines")).alias("_part"))
    return parts.groupBy(F.col("item_no").alias("_of"), "_first").agg(F.flatten(F.sort_array(F.collect_list("_part"))["lines"]).alias("_losers"))


def resolve_conflicts(claims: DataFrame) -> DataFrame:
    """Adds to `claims` (line_no, item_no, confidence, is_alternative) for items with several claimants:

    conflict_role (`winner`, `loser` or null), conflict_status of losers, winner_line, winner_confidence,
    and to winners losers (all of their lines, in order) and losing (how many there are).  The order is confidence descending, then line.

    Winners and counts are sums that combine before their shuffle, so an item that very many lines claim is not gathered for them.
    Losers join their winner alone, and only where they are asked for.
    """
    best = F.max(F.struct("confidence", (-F.col("line_no")).alias("_minus")))
    items = claims.groupBy("item_no").agg(best.alias("_best"), (F.count("*") - 1).alias("losing")).where("losing > 0")
    facts = items.select(F.col("item_no").alias("_item"), F.col("_best.confidence").alias("winner_confidence"), (-F.col("_best._minus")).alias("winner_line"), "losing")
    rows = claims.join(facts, F.col("item_no") == F.col("_item"), "left").join(losing_lines(claims), (F.col("item_no") == F.col("_of")) & (F.col("line_no") == F.col("_first")), "left")
    several, won = F.col("_item").isNotNull(), F.col("line_no") == F.col("winner_line")
    lost = F.when(F.col("is_alternative") & (F.col("winner_confidence") - F.col("confidence") <= ALTERNATIVE_GAP), "alternative").otherwise("ambiguous")
    return rows.select(
        *claims.columns,
        F.when(several, F.when(won, "winner").otherwise("loser")).alias("conflict_role"),
        F.when(several & ~won, lost).alias("conflict_status"),
        "winner_line", "winner_confidence",
        F.when(several & won, F.col("_losers")).alias("losers"),
        F.when(several & won, F.col("losing")).alias("losing"),
    )


def conflict_note(role: Column, status: Column, winner: Column, winner_confidence: Column, confidence: Column, losers: Column, losing: Column) -> Column:
    """Fixed wording of the notes on conflicts; `losing`: how many lines lost, all of which `losers` names."""
    won = F.concat(
        F.lit("otra(s) "), losing.cast("string"), F.lit(" linea(s) de la oferta apuntan al mismo item ("),
        F.array_join(F.transform(losers, lambda n: F.concat(F.lit("#"), n.cast("string"))), ", "), F.format_string("): gano esta por confianza %.2f", confidence),
    )
    alternative = F.concat(F.lit("el proveedor la ofrece como alternativa de la linea #"), winner.cast("string"), F.lit(" para el mismo item"))
    lost = F.concat(
        F.lit("reclama el mismo item que la linea #"), winner.cast("string"), F.format_string(", que gano por confianza (%.2f contra %.2f)", winner_confidence, confidence),
        F.lit(": no se puede determinar a que item corresponde esta linea"),
    )
    return F.when(role == "winner", won).when(status == "alternative", alternative).when(role == "loser", lost)
