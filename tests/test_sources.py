import zipfile

import pytest
from pyspark.sql import functions as F

from matchloom.errors import ExtractionError
from matchloom.sources import offers
from matchloom.sources.tables import check_csv, first_bad_row, read_csv_lenient, read_guide, read_requisition, run_sql

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows):
    """A minimal workbook; strings are inline, numbers are numbers."""
    cells = []
    for r, row in enumerate(rows, 1):
        out = ""
        for c, v in enumerate(row):
            at = f"{chr(65 + c)}{r}"
            if isinstance(v, str):
                out += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            elif v is not None:
                out += f'<c r="{at}"><v>{v}</v></c>'
        cells.append(f'<row r="{r}">{out}</row>')
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="a" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {NS}><sheetData>{''.join(cells)}</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "oferta_norte.xlsx", [
        ["Cotizacion QQ-ABC-77-3"], ["Fecha", "20/05/2026"], ["Condiciones", "7 dias"], [],
        ["Línea", "Código", "Descripción", "Cantidad", "Unidad", "Precio unitario", "Notas"],
        [1, "A-1", "Equivalente tecnico Cable", "1.000", "mts", "1.234,50", "stock parcial"],
        [None, "A-2", "Tubo", 1.234, "barril", "a confirmar", "algo"],
        [None, None, "Caja", 2, "caja", 3.125, None],
        [7, "A-7", "Lata", 1, "lata", 1, None],
        [7, "A-8", "Otra lata", 1, "lata", 1, None],
        [None, None, None, 9, None, None, None],
    ])
    headers, items, warnings = offers.extract_xlsx(spark, str(tmp_path))
    h = headers.first()
    assert (h.provider_name, h.quote_code, h.quote_date, h.terms, h.provider_from_name) == ("norte", "QQ-ABC-77-3", "2026-05-20", "7 dias", True)
    got = {r.line_no: r for r in items.collect()}
    assert sorted(got) == [1, 2, 3, 7]
    assert (got[1].offered_description, float(got[1].offered_quantity), got[1].unit_of_measure, float(got[1].unit_price), got[1].flags) == ("Cable", 1000.0, "meter", 1234.5, ["technical_equivalent", "partial_stock"])
    # A number cell is no text: three decimals are decimals.
    assert (float(got[2].offered_quantity), got[2].unit_price, float(got[3].unit_price)) == (1.234, None, 3.125)
    assert got[7].supplier_code == "A-7"
    codes = sorted(((w.line_no, w.code) for w in warnings.collect()), key=lambda w: (w[0] or 0, w[1]))
    assert codes == [(None, "header_fallback"), (2, "missing_price"), (2, "missing_price"), (2, "unknown_note"), (2, "unknown_unit"), (4, "line_gap"), (7, "duplicate_line")]


def test_what_cannot_be_read_fails(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Linea", "Descripcion", "Cantidad"], ["uno", "Cable", 1]])
    with pytest.raises(Exception, match="unreadable line number in row 2: uno"):
        offers.extract_xlsx(spark, str(tmp_path))[1].collect()
    workbook(tmp_path / "a.xlsx", [["Linea", "Descripcion", "Cantidad"], [1, None, 1]])
    workbook(tmp_path / "b.xlsx", [["Linea", "Descripcion", "Cantidad"], [1, "Cable", 1]])
    cells = offers.read_xlsx_cells(spark, str(tmp_path))
    with pytest.raises(ExtractionError, match="a.xlsx") as e:
        offers.require_items(cells, offers.extract_xlsx(spark, str(tmp_path))[1])
    assert "b.xlsx" not in str(e.value)


def test_sheets_are_read_a_row_at_a_time(tmp_path):
    workbook(tmp_path / "big.xlsx", [["Descripcion", "Cantidad"], *[[f"cosa {k}", k] for k in range(3000)]])
    import tracemalloc

    tracemalloc.start()
    count = sum(1 for _ in offers.sheet_cells(str(tmp_path / "big.xlsx")))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 6002 and peak < 2_500_000


def test_page_texts(spark, tmp_path):
    (tmp_path / "oferta_vivero-dos.txt").write_text("Fecha: 2026-01-02\nLinea Codigo proveedor Descripcion ofertada Cantidad Unidad Precio unit.\n1 FER-0X200 Soga 3 metro 4,00\f\n4 FER-0X201 Cinta 2 rollo 5,00\f")
    pages = offers.read_page_texts(spark, str(tmp_path))
    assert sorted(r.page for r in pages.collect()) == [1, 2]
    headers, items, warnings, _ = offers.extract_pdf_text(pages)
    assert (headers.first().provider_name, headers.first().quote_date) == ("vivero dos", "2026-01-02") and items.count() == 2
    assert sorted((w.code, w.line_no, w.message[:8]) for w in warnings.collect()) == [("header_fallback", None, "el docum"), ("line_gap", 2, "faltan 2")]


def test_missing_quantity_fails(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", [["Descripcion", "Cantidad"], ["Cable", None], ["Tubo", 1]])
    with pytest.raises(Exception, match="without a quantity"):
        offers.extract_xlsx(spark, str(tmp_path))[1].collect()


def test_pdf_lines(spark):
    head = "Linea Codigo proveedor Descripción ofertada Cantidad Unidad Precio unit. Notas"
    pages = [
        ("a.pdf", 1, f"Proveedor: Vivero Uno SA\nCotización: QQ-ABC-77-3\nFecha: 2026-05-20\n{head}\n1 FER-0X200 Manguera de riego 3/4 verde 1500 metro 87,20\nPagina 1 de 2"),
        ("a.pdf", 2, f"{head}\n2  FER-0X201 Cinta de papel 12 rollo 1.300,00 bulto minimo\nuna linea suelta\n2 / 2"),
    ]
    headers, items, warnings, unparsed = offers.extract_pdf_text(spark.createDataFrame(pages, "path string, page int, text string"))
    h = headers.first()
    assert (h.provider_name, h.quote_code, h.quote_date) == ("Vivero Uno SA", "QQ-ABC-77-3", "2026-05-20")
    got = {r.line_no: r for r in items.collect()}
    assert (got[1].offered_description, float(got[1].offered_quantity), float(got[1].unit_price)) == ("Manguera de riego 3/4 verde", 1500.0, 87.20)
    assert got[2].flags == ["min_order_qty"] and got[2].unit_of_measure == "roll"
    assert [r.line for r in unparsed.collect()] == ["una linea suelta"] and warnings.count() == 0


@pytest.mark.parametrize("line, want", [("Linea Codigo proveedor Descripcion ofertada Cantidad", True), ("Cantidad de cable", False), ("1 FER-0X200 Soga 3 metro 4,00", False)])
def test_table_header(spark, line, want):
    assert spark.range(1).select(offers.is_table_header(F.lit(line)).alias("x")).first().x is want


def test_formats():
    assert offers.source_format("a/b.XLSX") == "xlsx" and offers.source_format("b.pdf") == "pdf"
    with pytest.raises(ExtractionError):
        offers.source_format("b.doc")


def test_requisition(spark, tmp_path):
    (tmp_path / "purchase_requests.csv").write_text("request_id,title\nR1,Compra\nR2,Otra\n")
    (tmp_path / "purchase_request_items.csv").write_text('request_id,item_id,description,quantity,unit\nR1,1,Cable rojo,"1.000",metro\nR2,1,Tubo,2,tubo\nR1,2, Caja ,"2,5",caja\n')
    request, items, others = read_requisition(spark, str(tmp_path))
    assert request.first().request_id == "R1" and others.count() == 1
    assert [(r.line_no, r.description, float(r.quantity)) for r in items.orderBy("line_no").collect()] == [(1, "Cable rojo", 1000.0), (2, "Caja", 2.5)]
    (tmp_path / "purchase_request_items.csv").write_text("request_id,item_id,description,quantity,unit\nR1,1,,2,metro\n")
    with pytest.raises(ExtractionError, match="fila=2"):
        read_requisition(spark, str(tmp_path))


def test_the_first_bad_row_is_named(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    (tmp_path / "a.csv").write_text("n,s\n" + "".join(f"{k},x\n" for k in range(30)) + "\nx,b\n31,\n")
    path = str(tmp_path / "a.csv")
    assert first_bad_row(spark, path, schema) == 32 and first_bad_row(spark, path, schema, ["s"]) == 32
    (tmp_path / "a.csv").write_text("n,s\n1,a\n\n2,\n3,c\n")
    assert first_bad_row(spark, path, schema) is None and first_bad_row(spark, path, schema, ["s"]) == 3
    with pytest.raises(ExtractionError, match="fila=3"):
        check_csv(spark, path, schema, ["s"])


def test_workbooks_as_a_data_source(spark, tmp_path):
    from matchloom.sources.workbooks import Workbooks

    for k in range(3):
        workbook(tmp_path / f"{k}.xlsx", [["Descripcion", "Cantidad"], [f"cosa {k}", k]])
    spark.dataSource.register(Workbooks)
    cells = spark.read.format("workbook").load(str(tmp_path))
    assert cells.rdd.getNumPartitions() == 3
    want = offers.read_xlsx_cells(spark, str(tmp_path)).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "row", "column", "value", "is_number")
    assert sorted(map(tuple, cells.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    columns = offers.header_columns(cells)
    items, _ = offers.offer_items(offers.numbered_rows(offers.xlsx_rows(cells, columns)), "row")
    assert sorted(r.offered_description for r in items.collect()) == ["cosa 0", "cosa 1", "cosa 2"]
    assert spark.read.format("workbook").load(str(tmp_path / "1.xlsx")).count() == 4
    with pytest.raises(Exception, match="no workbooks"):
        spark.read.format("workbook").load(str(tmp_path / "none")).count()


def test_lenient_csv(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "a.csv").write_text("n,s\n1,a\nx,b\n")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("s", T.StringType())])
    assert [(r.n, r._corrupt_record) for r in read_csv_lenient(spark, str(tmp_path / "a.csv"), schema).collect()] == [(1, None), (None, "x,b")]


def test_guide(spark, tmp_path):
    (tmp_path / "g.md").write_text("# G\n## a.pdf\n\n| item | d | q | linea | c | d | q | relacion | x |\n|---|---|---|---|---|---|---|---|---|\n| 1 | Cable | 2 | 3 | A | Cable | 2 | needs_review | y |\n| 2 | Tubo | 1 |  |  |  |  | missing_from_offer | z |\n")
    rows = read_guide(spark, str(tmp_path / "g.md")).orderBy("n").collect()
    assert [(r.section, r.item_no, r.line_no, r.label) for r in rows] == [("a.pdf", 1, 3, "needs_review"), ("a.pdf", 2, None, "missing_from_offer")]


def test_sql_cuts_long_strings(spark):
    assert run_sql(spark, f"SELECT '{'x' * 70}' AS a, 1 AS b").first().a == "x" * 57 + "..."
