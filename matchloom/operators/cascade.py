"""The five-level cascade: confirmed aliases, candidates, decision, conflicts, and what was not quoted."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import MatchingError
from ..written import written
from .rules import conflict_note, extra_confidence, lexical_confidence, lexical_kind, lexical_reason, needs_review, resolve_conflicts, status_of, status_reason
from .units import converted


class Decider(Protocol):
    """Level 2.  `pending`: offer lines with `candidates`, best first.  Gives a row for each line it decides:

    line_no, item_no (null: an extra), confidence, reasoning, decided_by, failed (no decision could be had).
    """

    def decide(self, pending: DataFrame) -> DataFrame: ...


class LexicalDecider:
    """The rule on the two best scores."""

    def decide(self, pending: DataFrame) -> DataFrame:
        best, second = F.try_element_at("candidates", F.lit(1)), F.try_element_at("candidates", F.lit(2))
        first_score, second_score = best["score"], second["score"]
        match = lexical_kind(first_score, F.col("flags")) == "match"
        return pending.select(
            "line_no",
            F.when(match, best["item_no"]).alias("item_no"),
            F.when(match, lexical_confidence(first_score, second_score)).alias("confidence"),
            lexical_reason(first_score, second_score, best["description"], F.col("flags")).alias("reasoning"),
            F.lit("lexical").alias("decided_by"),
            F.lit(False).alias("failed"),
        )


ALIAS_REASON = "alias confirmado por el comprador para el codigo "
MISSING_REASON = "ninguna linea de la oferta corresponde a este item solicitado"
UNLIKE_UNITS = " (unidades distintas sin conversion conocida)"
FAILED_REASON = "el modelo no devolvio una decision para esta linea"


def alias_matches(offer: DataFrame, aliases: DataFrame) -> DataFrame:
    """line_no and item_no of offer lines whose supplier_code has an alias; of several the least item_no."""
    known = aliases.where(F.col("supplier_code").isNotNull()).groupBy("supplier_code").agg(F.min("item_no").alias("item_no"))
    return offer.select("line_no", "supplier_code").join(known, "supplier_code").select("line_no", "item_no", "supplier_code")


def candidate_lists(candidates: DataFrame) -> DataFrame:
    """line_no and `candidates`, best first: at most the k of the search."""
    entry = F.struct("rank", "item_no", "description", "score")
    return candidates.groupBy("line_no").agg(F.sort_array(F.collect_list(entry)).alias("candidates"))


def reconcile(offer: DataFrame, requisition: DataFrame, candidates: DataFrame, aliases: DataFrame | None = None, decider: Decider | None = None, review_brands: bool = False, check: bool = False, conversions: DataFrame | None = None) -> DataFrame:
    """One row for each offer line, and one for each requested item that no line claims.

    `offer`: line_no, supplier_code, description, quantity, unit_price (decimals), flags; `requisition`: item_no,
    description, quantity; `candidates`: line_no, rank, item_no, description, score; `aliases`: supplier_code, item_no.
    `check`: raise on an empty side (two small jobs).  `review_brands`: also review brands to be confirmed, beyond the default rules.
    A line whose decider failed is ambiguous and under review, not an extra.  `conversions` (item_no, from_unit, to_unit, factor, conflict; see units.closed):
    quantities are compared in the requested unit, by the `unit_of_measure` of both sides; where units differ and no way leads from
    one to the other, or ways disagree, quantities are compared as they stand and the line is under review.
    """
    if check and (offer.isEmpty() or requisition.isEmpty()):
        raise MatchingError("offer and requisition need at least one line each")
    lines = offer.join(candidate_lists(candidates), "line_no", "left")
    aliased = alias_matches(offer, aliases) if aliases is not None else None
    pending = lines.join(aliased, "line_no", "left_anti") if aliased is not None else lines
    decided = (decider or LexicalDecider()).decide(pending)
    decided = decided.select("line_no", "item_no", F.col("confidence").cast("double").alias("confidence"), "reasoning", "decided_by", "failed")
    if aliased is not None:
        confirmed = aliased.select("line_no", "item_no", F.lit(1.0).alias("confidence"), F.concat(F.lit(ALIAS_REASON), "supplier_code").alias("reasoning"), F.lit("alias").alias("decided_by"), F.lit(False).alias("failed"))
        decided = decided.unionByName(confirmed)
    asked = requisition.select("item_no", F.col("description").alias("requested_description"), F.col("quantity").alias("requested_quantity"))
    if conversions is not None:
        asked = asked.join(requisition.select("item_no", F.col("unit_of_measure").alias("requested_unit")), "item_no")
    rows = lines.join(decided, "line_no", "left").join(asked, "item_no", "left")
    if conversions is not None:
        rows = converted(rows, conversions, "item_no", "quantity", "unit_of_measure", "requested_unit")
    # Written once: claims, conflicts, extras and the sweep all read it, and a model is asked once.
    rows = written(rows, "cascade-rows")
    matched = rows.where(F.col("requested_quantity").isNotNull()).withColumn("is_alternative", F.array_contains("flags", "alternative_line"))
    matched = resolve_conflicts(matched)

    compared = F.col("quantity") if conversions is None else F.coalesce(F.col("converted_quantity").cast("decimal(14,3)"), "quantity")
    unlike = F.lit(False) if conversions is None else F.col("conversion").isin("unknown", "conflict")
    delta = compared - F.col("requested_quantity")
    total = (F.col("unit_price") * F.col("quantity")).cast("decimal(16,4)")
    status = F.coalesce("conflict_status", status_of(F.col("confidence"), delta, F.col("flags")))
    note = conflict_note(F.col("conflict_role"), F.col("conflict_status"), F.col("winner_line"), F.col("winner_confidence"), F.col("confidence"), F.col("losers"), F.col("losing"))
    own = status_reason(F.col("confidence"), compared, F.col("requested_quantity"), F.col("flags"))
    own = F.concat(own, F.when(unlike, UNLIKE_UNITS).otherwise(""))
    reason = F.when(F.col("conflict_role") == "loser", note).otherwise(F.concat("reasoning", F.lit(". "), F.coalesce(note, own)))
    brand = F.array_contains("flags", "brand_to_confirm") if review_brands else F.lit(False)
    review = needs_review(status, F.col("confidence")) | F.col("conflict_role").isNotNull() | brand | unlike
    empty = F.array().cast("array<struct<rank:int,item_no:bigint,description:string,score:double>>")
    listed = F.transform(F.coalesce("candidates", empty), lambda c: F.struct(c["rank"].cast("int").alias("rank"), c["item_no"].cast("long").alias("item_no"), c["description"].alias("description"), F.round(c["score"], 4).alias("score")))
    claimed = matched.select(
        "line_no", "item_no", status.alias("status"), "confidence", delta.cast("decimal(14,3)").alias("quantity_delta"), total.alias("price_total"), reason.alias("reasoning"),
        listed.alias("candidates"), review.alias("needs_review"), "decided_by", (F.coalesce("conflict_role", F.lit("")) != "loser").alias("claims"),
    )
    best = F.try_element_at("candidates", F.lit(1))["score"]
    failed = F.coalesce("failed", F.lit(False))
    nothing = F.lit(None)
    extras = rows.where(F.col("requested_quantity").isNull()).select(
        "line_no", nothing.cast("long").alias("item_no"), F.when(failed, "ambiguous").otherwise("extra").alias("status"), F.when(failed, 0.0).otherwise(extra_confidence(best)).alias("confidence"),
        nothing.cast("decimal(14,3)").alias("quantity_delta"), total.alias("price_total"), F.when(failed, FAILED_REASON).otherwise(F.coalesce("reasoning", F.lit(FAILED_REASON))).alias("reasoning"),
        listed.alias("candidates"), failed.alias("needs_review"), F.lit("unmatched").alias("decided_by"), F.lit(False).alias("claims"),
    )
    covered = claimed.where("claims").select("item_no").distinct()
    missing = requisition.join(covered, "item_no", "left_anti").select(
        nothing.cast("long").alias("line_no"), F.col("item_no").cast("long").alias("item_no"), F.lit("missing_from_offer").alias("status"), F.lit(1.0).alias("confidence"), nothing.cast("decimal(14,3)").alias("quantity_delta"),
        nothing.cast("decimal(16,4)").alias("price_total"), F.lit(MISSING_REASON).alias("reasoning"), empty.alias("candidates"), F.lit(True).alias("needs_review"), F.lit("unmatched").alias("decided_by"), F.lit(False).alias("claims"),
    )
    return claimed.unionByName(extras).unionByName(missing).drop("claims")
