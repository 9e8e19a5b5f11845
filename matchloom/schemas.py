"""Schemas and fixed vocabularies of the reconciliation model."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA_VERSION = 1

# The vocabularies that results are written in.
UNITS = ("unit", "meter", "roll", "box", "bag", "pack", "pair", "set", "kit", "can", "bucket", "drum", "liter", "tube", "cartridge", "sheet", "jar")
FLAGS = ("technical_equivalent", "alternative_line", "partial_stock", "min_order_qty", "brand_to_confirm", "extra_suggested")
STATUSES = ("match", "partial_quantity", "semantic_match", "alternative", "missing_from_offer", "extra", "ambiguous")
DECIDED_BY = ("exact_code", "alias", "vector+llm", "llm", "lexical", "unmatched")
WARNINGS = ("duplicate_line", "header_fallback", "line_gap", "llm_failed", "llm_retry", "missing_price", "unknown_note", "unknown_unit")

QUANTITY, PRICE, CONFIDENCE, TOTAL = T.DecimalType(14, 3), T.DecimalType(14, 4), T.DecimalType(3, 2), T.DecimalType(16, 4)
S, I, B, L = T.StringType(), T.IntegerType(), T.BooleanType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


CANDIDATE = _struct(rank=I, item_no=I, description=S, score=T.DoubleType())
WARNING = _struct(code=S, message=S, line_no=I)

TABLES: dict[str, T.StructType] = {
    "providers": _struct(id=S, name=S, created_at=T.TimestampType()),
    "requisitions": _struct(id=S, code=S, title=S, created_at=T.TimestampType()),
    "requisition_groups": _struct(id=S, requisition_id=S, name=S, delivery_method=S),
    "items": _struct(id=S, code=S, description=S, unit_of_measure=S, attributes=T.MapType(S, S), embedding=T.ArrayType(T.FloatType())),
    "requisition_items": _struct(id=S, requisition_id=S, item_id=S, line_no=I, quantity=QUANTITY, unit_of_measure=S, raw_description=S, raw_unit=S),
    "offers": _struct(id=S, requisition_id=S, provider_id=S, quote_code=S, quote_date=S, terms=S, currency=S, source_format=S, source_filename=S, source_hash=S, status=S),
    "offer_items": _struct(id=S, offer_id=S, line_no=I, supplier_code=S, offered_description=S, offered_quantity=QUANTITY, unit_of_measure=S, raw_unit=S, unit_price=PRICE, raw_notes=S, flags=T.ArrayType(S)),
    "reconciliations": _struct(id=S, offer_id=S, requisition_id=S, summary=S, created_at=T.TimestampType()),
    "reconciliation_lines": _struct(reconciliation_id=S, requisition_item_id=S, offer_item_id=S, status=S, confidence=CONFIDENCE, quantity_delta=QUANTITY, price_total=TOTAL, reasoning=S, candidates=T.ArrayType(CANDIDATE), needs_review=B, decided_by=S),
    "supplier_item_aliases": _struct(id=S, provider_id=S, supplier_code=S, item_id=S, confirmed_at=T.TimestampType()),
    "offer_warnings": _struct(offer_id=S, code=S, message=S, line_no=I),
    "alias_votes": _struct(provider_id=S, supplier_code=S, item_id=S, yes=L, no=L, first_yes=T.TimestampType(), last_yes=T.TimestampType(), last_no=T.TimestampType()),
}

#: Columns that name a row of each table; upserts go by them.
KEYS: dict[str, tuple[str, ...]] = {
    "providers": ("name",),
    "requisitions": ("code",),
    "items": ("code",),
    "requisition_items": ("requisition_id", "line_no"),
    "offers": ("requisition_id", "source_hash"),
    "offer_items": ("offer_id", "line_no"),
    "supplier_item_aliases": ("provider_id", "supplier_code"),
}

#: The column whose hash says in which bucket of its table a row lies; part of the key where there is one.
BUCKET_BY: dict[str, str] = {
    "providers": "name",
    "requisitions": "code",
    "requisition_groups": "requisition_id",
    "items": "code",
    "requisition_items": "requisition_id",
    "offers": "requisition_id",
    "offer_items": "offer_id",
    "reconciliations": "offer_id",
    "reconciliation_lines": "reconciliation_id",
    "supplier_item_aliases": "provider_id",
    "offer_warnings": "offer_id",
    "alias_votes": "provider_id",
    "text_embeddings": "text_hash",
}

REQUESTS = _struct(request_id=S, title=S)
REQUEST_ITEMS = _struct(request_id=S, item_id=S, description=S, quantity=S, unit=S)
EMBEDDINGS = _struct(text_hash=S, model=S, dims=I, vector=T.ArrayType(_struct(index=I, weight=T.DoubleType())))
TABLES["text_embeddings"] = EMBEDDINGS
KEYS["text_embeddings"] = ("text_hash", "model", "dims")
