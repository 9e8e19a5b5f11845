"""Readers of documents and descriptions: each text is met by its patterns once, and small inputs are dealt to tasks before that."""

import pytest
from pyspark.sql import functions as F

from matchloom.functions.text import folded, strip_accents
from matchloom.operators import units
from matchloom.sources import offers


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def cells(spark):
    rows = [("a", 0, 0, "Proveedor"), ("a", 2, 0, "Línea"), ("a", 2, 1, "CODIGO"), ("a", 2, 3, "Descripción"), ("a", 3, 0, "1"), ("a", 3, 1, "caja"), ("a", 3, 3, "cable 2"), ("a", 30, 0, "linea"), ("b", 1, 2, "sku"), ("b", 1, 4, "code"), ("b", 1, 1, "detalle"), ("b", 3, 0, "line"), ("b", 3, 1, "detalle"), ("c", 0, 0, "nada")]
    return spark.createDataFrame([(p, "h", r, c, v, v.isdigit()) for p, r, c, v in rows], "path string, source_hash string, row int, column int, value string, is_number boolean")


def test_header_columns_reads_cells_once(spark):
    found = offers.header_columns(cells(spark))
    plan = plan_of(found)
    got = sorted(tuple(r) for r in found.collect())
    assert got == [("a", 2, "line_no", 0), ("a", 2, "offered_description", 3), ("a", 2, "supplier_code", 1), ("b", 1, "offered_description", 1), ("b", 1, "supplier_code", 2)]
    assert "Join" not in plan and plan.count("ExistingRDD") == 1


def test_xlsx_rows_shuffles_cells_once(spark):
    given = cells(spark)
    found = offers.xlsx_rows(given, offers.header_columns(given))
    got = sorted((r.path, r.row, r.line_no, r.supplier_code, r.offered_description, r.line_no_is_number, r.unit_is_number) for r in found.collect())
    assert got == [("a", 3, "1", "caja", "cable 2", True, False), ("b", 3, None, None, "detalle", False, False)]


def test_page_lines_are_read_once(spark):
    text = "Proveedor:  Á\n\nPágina 1 de 2\n 3 / 4 \nLínea  Código proveedor Descripción ofertada Cantidad\nProveedor: otro"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "suelta")], "path string, page int, text string")
    found = offers.page_lines(pages)
    assert plan_of(found).count("(?U)") == 1
    assert sorted((r.page, r.pos, r.line, r.part) for r in found.collect()) == [(1, 0, "Proveedor: Á", "header"), (1, 5, "Proveedor: otro", "body"), (2, 0, "suelta", "body")]


@pytest.mark.parametrize("text", ["plain", "Línea", "ÁÉÍ é", "", "日本", "Ωμέγα"])
def test_accents(spark, text):
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    assert spark.range(1).select(strip_accents(F.lit(text)).alias("s")).first().s == plain
    assert spark.range(1).select(folded(F.lit(None).cast("string")).alias("s")).first().s is None


def test_factors_are_dealt_and_computed_once(spark):
    rows = spark.createDataFrame([(1, "Rollo x 100 m"), (2, "caja de 12 unidades"), (3, "caja de 0 un"), (4, "m x 2 m"), (5, None), (6, "caja por 1.500,5 mts")], "k long, d string")
    found = units.stated_factors(rows, "k", "d")
    assert "REPARTITION" in plan_of(found)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "roll", "meter", 100.0), (2, "box", "unit", 12.0), (6, "box", "meter", 1500.5)]


def test_sheets_deal_their_rows_once(spark, data):
    """Lines are shuffled by document and nothing is shuffled after, cells neither."""
    from matchloom.plans import registry, strict  # noqa: F401

    for name, readers in (("sheet_items", 1), ("sheet_warnings", 2)):
        plan = plan_of(registry.QUERIES[name](spark, data))
        kinds = [line for line in plan.splitlines() if "Exchange" in line and "ReusedExchange" not in line]
        assert len(kinds) == readers and all("hashpartitioning(path" in line and "REPARTITION" in line for line in kinds) and "Join" not in plan


def test_packed_rows_read_like_cells(spark):
    given = cells(spark).unionByName(spark.createDataFrame([("a", "h", 3, 3, "cable 1", True), ("b", "h", 4, 1, "otro", False)], cells(spark).schema))  # a cell told twice
    rows = offers.sheet_rows(given)
    columns = offers.header_columns(given)
    wide = offers.xlsx_rows(rows)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, offers.xlsx_rows(given, columns).select(wide.columns).collect()))
    got = {(r.path, r.row): (r.offered_description, r.offered_description_is_number, r.line_no) for r in wide.collect()}
    assert got == {("a", 3): ("cable 2", True, "1"), ("b", 3): ("detalle", False, None), ("b", 4): ("otro", False, None)}
    heads = sorted((r.path, r.provider_name, r.provider_from_name) for r in offers.xlsx_header(rows).collect())
    assert heads == [("a", "a", True), ("b", "b", True)] and heads == sorted((r.path, r.provider_name, r.provider_from_name) for r in offers.xlsx_header(given, columns).collect())
    packed = rows.select("path", "source_hash", "row", "cells")
    assert sorted(map(tuple, offers.header_columns(packed).collect())) == sorted(map(tuple, columns.collect()))
