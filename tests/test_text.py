import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.functions import features, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


NUMBERS = [
    ("2.839,20", 2839.2), ("47,53", 47.53), ("129.010,00", 129010.0), ("1.234.567,89", 1234567.89), ("1.000", 1000.0), ("1.5", 1.5), ("0.75", 0.75), ("12.3456", 12.3456),
    ("$ 2.839,20", 2839.2), ("ARS 1.500,00", 1500.0), ("-1.200,50", -1200.5), ("1 000", 1000.0), ("", None), ("  ", None), ("-", None), (None, None), ("a confirmar", None), ("12 unidades", None),
    ("1,2,5", 12.5), ("1.2.3", 123.0), ("1,234.5", 1234.5), ("+3", 3.0), ("1.2,3.4", None), ("u$s 5", 5.0),
]


def test_numbers(spark):
    rows = spark.createDataFrame(NUMBERS, "raw string, want double").withColumn("got", text.parse_arg_number(F.col("raw"))).withColumn("bad", text.number_is_unreadable(F.col("raw"))).collect()
    assert [(r.raw, r.got) for r in rows] == NUMBERS
    assert {r.raw for r in rows if r.bad} == {"a confirmar", "12 unidades", "1.2,3.4"}


def test_required_number_fails(spark):
    with pytest.raises(Exception, match="a number is needed"):
        one(spark, text.require_arg_number(F.lit("  ")))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.decimals(0, 10**9, places=2), min_size=1, max_size=40))
def test_formatted_numbers_come_back(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double").withColumn("back", text.parse_arg_number(text.money(F.col("v"))))
    assert all(abs(r.v - r.back) < 1e-6 * max(1, r.v) for r in df.collect())


UNITS = {
    "unidad": "unit", "metro": "meter", "par": "pair", "lata": "can", "rollo": "roll", "bidon": "drum", "caja": "box", "hoja": "sheet", "cartucho": "cartridge", "set": "set", "pomo": "jar", "paquete": "pack",
    "kit": "kit", "bolsa": "bag", "tubo": "tube", "pack": "pack", "litro": "liter", "balde": "bucket", "u.": "unit", "UN": "unit", "mts": "meter", "bidón": "drum", "barril": None, "c/u": None, "": None,
}


def test_units(spark):
    rows = spark.createDataFrame([(u,) for u in UNITS] + [(None,)], "raw string").withColumn("got", text.normalize_unit(F.col("raw"))).collect()
    assert {r.raw: r.got for r in rows} == UNITS | {None: None}


NOTES = {
    "Equivalente técnico": ["technical_equivalent"], "equivalente alternativo": ["alternative_line"], "Linea alternativa": ["alternative_line"], "alternativa para el item 3": ["alternative_line"],
    "stock parcial": ["partial_stock"], "disponibilidad parcial": ["partial_stock"], "cantidad disponible menor": ["partial_stock"], "menor a la solicitada": ["partial_stock"], "bulto mínimo": ["min_order_qty"],
    "presentacion comercial": ["min_order_qty"], "marca a confirmar": ["brand_to_confirm"], "adicional sugerido": ["extra_suggested"], "adicional no pedido": ["extra_suggested"], "sugerido para stock": ["extra_suggested"],
    "stock parcial; bulto minimo": ["partial_stock", "min_order_qty"], "stock parcial; stock parcial": ["partial_stock"], "": [], None: [],
}


def test_notes(spark):
    rows = spark.createDataFrame([(n,) for n in NOTES], "raw string").withColumn("got", text.parse_notes(F.col("raw"))).collect()
    assert {r.raw: r.got.flags for r in rows} == NOTES
    kept = one(spark, text.parse_notes(F.lit(" Entrega rápida ; stock parcial")))
    assert kept.flags == ["partial_stock"] and kept.unrecognized == ["Entrega rápida"]


@pytest.mark.parametrize(
    "raw, description, flags",
    [
        ("Equivalente tecnico Conductor flexible 4 mm2", "Conductor flexible 4 mm2", ["technical_equivalent"]),
        ("Cable  rojo linea alternativa", "Cable rojo", ["alternative_line"]),
        ("Equivalente técnica Cable línea alternativa", "Cable", ["technical_equivalent", "alternative_line"]),
        ("Equivalente Cable", "Equivalente Cable", []),
        ("  Cable   azul ", "Cable azul", []),
    ],
)
def test_descriptions(spark, raw, description, flags):
    got = one(spark, text.parse_description(F.lit(raw)))
    assert (got.description, got.flags) == (description, flags)


def test_embedding_text_and_accents(spark):
    assert one(spark, text.embedding_text(F.lit("Cañería  PVC 110mm"), F.lit("meter"))) == "caneria pvc 110mm [meter]"
    assert one(spark, text.strip_accents(F.lit("ÁÉÍ ñ ü é"))) == "AEI n u e"


@pytest.mark.parametrize("raw, want", [("2026-05-20T10", "2026-05-20"), ("3/4/2026", "2026-04-03"), ("03-04-2026", "2026-04-03"), ("46162", "2026-05-20"), ("mayo 2026", None), ("3/4/2026 x", None), ("12", None)])
def test_dates(spark, raw, want):
    assert one(spark, text.normalize_date(F.lit(raw))) == want


def test_dates_inside_text(spark):
    assert one(spark, text.normalize_iso_date(F.lit("del 3/4/2026, vence"))) == "2026-04-03"


@pytest.mark.parametrize("value, want", [(2.0, "2"), (2.5, "2,5"), (1234.567, "1.234,567"), (0.0, "0"), (None, "-"), (100.0, "100")])
def test_quantities(spark, value, want):
    assert one(spark, text.qty(F.lit(value).cast("double"))) == want


def test_hash_and_tokens(spark):
    assert one(spark, features.fnv1a(F.lit("t:rojo"), 0)) == 3251245735
    assert one(spark, features.fnv1a(F.lit("t:rojo"), features.SIGN_SEED)) == 288238338
    assert one(spark, features.fnv1a(F.lit(""), 0)) == 0x811C9DC5
    assert one(spark, features.tokenize(F.lit("Cable 1,5mm2 ROJO"))) == ["cable", "1.5", "mm", "2", "rojo"]
    assert one(spark, features.trigrams(features.tokenize(F.lit("rojo azul 1234")))) == ["roj", "ojo", "azu", "zul", "123", "234"]


def test_sparse_embedding_is_a_unit_vector(spark):
    rows = features.sparse_embedding(spark.createDataFrame([(1, "cable rojo"), (2, ""), (3, None)], "k long, s string"), ["k"], F.col("s")).collect()
    for k in (1, 2, 3):
        assert abs(sum(r.weight**2 for r in rows if r.k == k) - 1) < 1e-9
    assert [(r["index"], r.weight) for r in rows if r.k == 2] == [(0, 1.0)]
