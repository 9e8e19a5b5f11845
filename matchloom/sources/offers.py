"""Offer documents to lines: spreadsheets, and text lines of PDF pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import ExtractionError
from ..functions.text import canon, cell_text, collapsed, folded, let, normalize_date, normalize_iso_date, normalize_unit, number_is_unreadable, parse_arg_number, parse_description, parse_notes

# Labels of columns and of the header block, in canonical form.
COLUMN_LABELS = {
    "line_no": ("lineno", "linea", "line", "nro", "numero", "item", "nrolinea"),
    "supplier_code": ("suppliercode", "codigoproveedor", "codigo", "code", "sku", "articulo"),
    "offered_description": ("offereddescription", "descripcionofertada", "descripcion", "description", "detalle", "producto"),
    "offered_quantity": ("offeredquantity", "cantidadofertada", "cantidad", "quantity", "qty", "cant"),
    "unit": ("unit", "unidad", "unidaddemedida", "unitofmeasure", "um", "medida"),
    "unit_price": ("unitprice", "preciounitario", "preciounit", "precio", "price", "punitario"),
    "notes": ("notes", "notas", "observaciones", "observacion", "comentarios", "nota"),
}
HEADER_DEPTH = 25
HEADER_LABELS = {
    "provider_name": ("proveedor", "provider", "razonsocial"),
    "quote_date": ("fecha", "date"),
    "terms": ("condiciones", "terms", "condicionescomerciales"),
    "quote_code": ("cotizacion", "quote", "codigo"),
}
QUOTE_CODE = r"\b[A-Z][A-Z0-9]{1,5}(?:-[A-Z0-9]+){2,}\b"
TABLE_HEADER_TOKENS = ("linea", "codigo proveedor", "descripcion ofertada", "cantidad", "unidad", "precio unit")
ROW_UNITS = (
    "unidad", "unidades", "metro", "metros", "rollo", "rollos", "caja", "cajas", "bolsa", "bolsas", "paquete", "paquetes",
    "pack", "par", "pares", "set", "sets", "kit", "kits", "lata", "latas", "balde", "baldes", "bidon",
    "bidones", "litro", "litros", "tubo", "tubos", "cartucho", "cartuchos", "hoja", "hojas", "pomo", "pomos", "juego",
    "mts", "un", "u",
)
ROW = (
    r"(?i)^(\d{1,4})\s+([A-Z]{2,5}-[A-Z0-9]{3,8})\s+(.+?)\s+(\d[\d.]*(?:,\d+)?)\s+("
    + "|".join(ROW_UNITS)
    + r")\s+([\d.]*\d(?:,\d{1,2})?)(?:\s+(.*))?$"
)

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REF = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _strings(book: zipfile.ZipFile) -> list[str]:
    """The strings that cells name by number."""
    out = []
    if "xl/sharedStrings.xml" in book.namelist():
        with book.open("xl/sharedStrings.xml") as part:
            for _, element in ElementTree.iterparse(part):
                if element.tag == f"{_MAIN}si":
                    out.append("".join(t.text or "" for t in element.iter(f"{_MAIN}t")))
                    element.clear()
    return out


def sheet_cells(file) -> Iterator[tuple[int, int, str, bool]]:
    """Row, column (from 0), text and whether it is a number, of the first sheet of a workbook (bytes, or a file or its name), a row at a time."""
    with zipfile.ZipFile(io.BytesIO(file) if isinstance(file, bytes) else file) as book:
        shared = _strings(book)
        first = next(iter(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[first.get(_REF)].lstrip("/")
        with book.open(target if target.startswith("xl/") else f"xl/{target}") as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag == f"{_MAIN}row":
                    for cell in element.iter(f"{_MAIN}c"):
                        yield from _cell(cell, shared)
                    element.clear()  # so that no more than a row is held


def _cell(cell: ElementTree.Element, shared: list[str]) -> Iterator[tuple[int, int, str, bool]]:
    place = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r"))
    column = 0
    for letter in place[1]:
        column = column * 26 + ord(letter) - 64
    kind, value = cell.get("t", "n"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        yield int(place[2]) - 1, column - 1, "".join(t.text or "" for t in cell.iter(f"{_MAIN}t")), False
    elif value is not None and value.text is not None:
        yield int(place[2]) - 1, column - 1, shared[int(value.text)] if kind == "s" else value.text, kind == "n"


#: Cells that a task hands on at a time.
CELLS = 20_000


def read_xlsx_cells(spark: SparkSession, path: str) -> DataFrame:
    """path, source_hash, row, column, value, is_number of the first sheets of all files at `path`, wherever Spark can read them; a file is one task's work."""

    def cells(frames):
        for frame in frames:
            for name, content, key in zip(frame.path, frame.content, frame.source_hash, strict=True):
                found = sheet_cells(bytes(content))
                while part := list(islice(found, CELLS)):
                    yield pd.DataFrame(part, columns=["row", "column", "value", "is_number"]).assign(path=name, source_hash=key)[["path", "source_hash", "row", "column", "value", "is_number"]]

    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("source_hash"))
    return files.mapInPandas(cells, "path string, source_hash string, row int, column int, value string, is_number boolean")


#: Rows of documents that a task holds; beyond what the session's shuffles deal, more tasks are made, so that no sort of a task grows with the input.
TASK_ROWS = 500_000


def by_document(rows: DataFrame) -> DataFrame:
    """`rows` dealt by path, once for all that reads documents after; a number of tasks of its own keeps them from being put together again, as reading is far slower than dealing."""
    return rows.repartition(max(-(-rows.count() // TASK_ROWS), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "path")


def _packed(cells: DataFrame) -> DataFrame:
    """A row for each row of a sheet, with its `cells` (column, value, is_number), one a column; `cells` that stand so already stay."""
    if "cells" in cells.columns:
        return cells
    one = cells.repartition("path").groupBy("path", "source_hash", "row", "column").agg(F.max("value").alias("value"), F.bool_or("is_number").alias("is_number"))
    return one.groupBy("path", "source_hash", "row").agg(F.collect_list(F.struct("column", "value", "is_number")).alias("cells"))


def _with_found(rows: DataFrame) -> DataFrame:
    """Adds _found to packed rows: what a header row names, to be compared by number of fields, then by row; null beyond HEADER_DEPTH and where there is no label."""
    known = [x for names in COLUMN_LABELS.values() for x in names]
    # No label has a digit, so most cells of a table need no canonical form.
    told = F.transform(F.filter("cells", lambda c: ~c["value"].rlike("[0-9]")), lambda c: F.struct(c["column"].alias("column"), canon(c["value"]).alias("label")))
    rows = rows.withColumn("_labels", F.when(F.col("row") < HEADER_DEPTH, F.filter(told, lambda c: c["label"].isin(*known))))
    named = lambda names: F.filter("_labels", lambda c: c["label"].isin(*names))
    rows = rows.withColumns({f"_{f}": F.array_min(named(names)["column"]) for f, names in COLUMN_LABELS.items()})
    score = sum((F.col(f"_{f}").isNotNull().cast("int") for f in COLUMN_LABELS), F.lit(0))
    found = F.struct((-score).alias("_score"), F.col("row").alias("header_row"), *[f"_{f}" for f in COLUMN_LABELS])
    return rows.withColumn("_found", F.when(F.size("_labels") > 0, found)).drop("_labels", *[f"_{f}" for f in COLUMN_LABELS])


def header_columns(cells: DataFrame) -> DataFrame:
    """path, header_row, field, column: of the first HEADER_DEPTH rows the one with most fields, the first on ties."""
    top = cells.where(F.col("row") < HEADER_DEPTH)
    rows = _with_found(_packed(top if "cells" in cells.columns else top.where(~F.col("value").rlike("[0-9]"))))
    best = rows.groupBy("path").agg(F.min("_found").alias("_best")).where("_best IS NOT NULL")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"_best._{f}").alias("column")) for f in COLUMN_LABELS])
    return best.select("path", F.col("_best.header_row").alias("header_row"), F.inline(fields)).where(F.col("column").isNotNull())


def sheet_rows(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """path, source_hash, row, `cells`, header_row and `_<field>`, the column of each field: a row for each row of a document that has a header.

    Cells stand one by one or packed as rows; cells are met where their rows are, and not shuffled one by one.  The header is that of `columns`, or else found
    among the rows of a document as they pass, without a second reading and without a join.
    """
    rows = _packed(cells)
    if columns is not None:
        heads = columns.groupBy("path").agg(F.max("header_row").alias("header_row"), *[F.max(F.when(F.col("field") == f, F.col("column"))).alias(f"_{f}") for f in COLUMN_LABELS])
        return rows.join(heads, "path")
    # In the order that numbering asks for, so that these wide rows are sorted once.
    whole = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = _with_found(rows).withColumn("_best", F.min("_found").over(whole)).where("_best IS NOT NULL")
    return best.select("path", "source_hash", "row", "cells", "_best.header_row", *[f"_best._{f}" for f in COLUMN_LABELS])


def _at(column: Column) -> Column:
    """The cell of a row in a column; null if there is none, or no such column."""
    return F.get("cells", (F.array_position(F.col("cells.column"), column) - 1).cast("int"))


def file_provider(path: Column) -> Column:
    """A provider's name from that of its file."""
    file = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.[A-Za-z]+)+$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(file, "(?i)^oferta[_-]", ""), "[_-]+", " "))


def xlsx_header(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """path, provider_name, quote_code, quote_date, terms and provider_from_name: from labels in A and values in B before the table.

    `cells` and `columns` as in `sheet_rows`, or what that gives."""
    rows = cells if "header_row" in cells.columns else sheet_rows(cells, columns)
    rows = rows.select("path", "row", (F.col("row") < F.col("header_row")).alias("_above"), _at(F.lit(0))["value"].alias("label"), _at(F.lit(1))["value"].alias("value"))
    value, label = cell_text(F.col("value")), canon(F.col("label"))
    known = [x for names in HEADER_LABELS.values() for x in names]
    loose = F.when(~label.isin(*known), F.nullif(F.regexp_extract("label", QUOTE_CODE, 0), F.lit("")))
    found = {f: F.when(label.isin(*names), normalize_date(value) if f == "quote_date" else value) for f, names in HEADER_LABELS.items()}
    found["quote_code"] = F.coalesce(found["quote_code"], loose)
    first = [F.min_by(F.col(f"_{f}"), F.when(F.col(f"_{f}").isNotNull(), F.col("row"))).alias(f) for f in found]
    # Rows of the table stay, with nulls, so that each document with a header has its row.
    named = rows.select("path", "row", *[F.when(F.col("_above"), c).alias(f"_{f}") for f, c in found.items()]).groupBy("path").agg(*first)
    fallback = file_provider(F.col("path"))
    return named.select("path", F.coalesce("provider_name", fallback).alias("provider_name"), "quote_code", "quote_date", "terms", F.col("provider_name").isNull().alias("provider_from_name"))


def xlsx_rows(cells: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """path, row and the text of each field; numbers keep `<field>_is_number`.  Rows without a description go.

    `cells` and `columns` as in `sheet_rows`, or what that gives."""
    rows = cells if "header_row" in cells.columns else sheet_rows(cells, columns)
    body = rows.where("row > header_row").select("path", "source_hash", "row", *[_at(F.col(f"_{f}")).alias(f) for f in COLUMN_LABELS])
    wide = body.select(
        "path", "source_hash", "row", *[F.col(f)["value"].alias(f) for f in COLUMN_LABELS],
        *[F.coalesce(F.col(f)["is_number"], F.lit(False)).alias(f"{f}_is_number") for f in COLUMN_LABELS],
    )
    return wide.where(cell_text(F.col("offered_description")).isNotNull())


def _number(field: str) -> Column:
    """A number cell as it is; text by the es-AR rules."""
    text = cell_text(F.col(field))
    return F.when(F.coalesce(F.col(f"{field}_is_number"), F.lit(False)), text.try_cast("double")).otherwise(parse_arg_number(text))


def numbered_rows(rows: DataFrame) -> DataFrame:
    """Adds line_no.  A row without a positive number takes the largest so far plus one, and so raises it in turn.

    The largest so far after a row is the greatest, over explicit numbers before it, of that number plus the
    unnumbered rows since; a running maximum of number minus unnumbered rows so far gives it.
    """
    bad = ~F.coalesce(F.col("line_no_is_number"), F.lit(False)) & F.coalesce(number_is_unreadable(cell_text(F.col("line_no"))), F.lit(False))
    given = F.when(bad, F.raise_error(F.concat(F.lit("unreadable line number in row "), (F.col("row") + 1).cast("string"), F.lit(": "), F.col("line_no"))).cast("int")).otherwise(F.floor(_number("line_no")).cast("int"))
    explicit = F.when(given > 0, given)
    so_far = Window.partitionBy("path").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_given", explicit).withColumn("_missing", F.sum(F.when(F.col("_given").isNull(), 1).otherwise(0)).over(so_far))
    base = F.greatest(F.lit(0), F.coalesce(F.max(F.col("_given") - F.col("_missing")).over(so_far), F.lit(0)))
    return rows.withColumn("_line", F.coalesce("_given", (base + F.col("_missing")).cast("int"))).drop("line_no", "_given", "_missing").withColumnRenamed("_line", "line_no")


def offer_items(rows: DataFrame, order: str, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(items, warnings) from rows with line_no and the texts of the fields; of lines with one number the first stays, and holes in the numbers are warned of in the same pass."""
    price, quantity = _number("unit_price"), _number("offered_quantity")
    if strict:
        quantity = F.coalesce(quantity, F.raise_error(F.concat(F.lit("line without a quantity: "), F.col("line_no").cast("string"))).cast("double"))
    read = rows.select(
        "path", F.col(order).alias("_order"), "line_no",
        cell_text(F.col("supplier_code")).alias("supplier_code"),
        parse_description(F.col("offered_description")).alias("_d"),
        quantity.alias("offered_quantity"),
        cell_text(F.col("unit")).alias("raw_unit"),
        price.alias("unit_price"),
        (~F.coalesce(F.col("unit_price_is_number"), F.lit(False)) & F.coalesce(number_is_unreadable(cell_text(F.col("unit_price"))), F.lit(False))).alias("_bad_price"),
        cell_text(F.col("notes")).alias("raw_notes"),
    )
    read = read.withColumn("_n", parse_notes(F.col("raw_notes"))).withColumn("unit_of_measure", normalize_unit(F.col("raw_unit")))
    read = read.withColumn("_occurrence", F.row_number().over(Window.partitionBy("path", "line_no").orderBy("_order")))

    # The order within documents is that of occurrences, so both windows share a sort.
    missing = F.lag("line_no").over(Window.partitionBy("path").orderBy("line_no", "_order")) + 1
    read = read.withColumn("_missing", F.when((F.col("_occurrence") == 1) & (F.col("line_no") > missing), missing))

    def warning(code: str, message: Column, at: Column = F.col("line_no")):
        return F.struct(F.lit(code).alias("code"), message.alias("message"), at.cast("int").alias("line_no"))

    line = F.col("line_no").cast("string")
    one = [
        F.when(F.col("_occurrence") > 1, warning("duplicate_line", F.concat(F.lit("el numero de linea "), line, F.lit(" aparece mas de una vez")))),
        F.when(F.col("raw_unit").isNotNull() & F.col("unit_of_measure").isNull(), warning("unknown_unit", F.concat(F.lit("unidad no reconocida en la linea "), line, F.lit(': "'), F.col("raw_unit"), F.lit('"')))),
        F.when(F.col("_bad_price"), warning("missing_price", F.concat(F.lit("precio ilegible en la linea "), line))),
        F.when(F.col("unit_price").isNull(), warning("missing_price", F.concat(F.lit("la linea "), line, F.lit(" no trae precio")))),
        F.when(F.col("_missing").isNotNull(), warning("line_gap", F.concat(F.lit("faltan "), (F.col("line_no") - F.col("_missing")).cast("string"), F.lit(" linea(s) a partir de la "), F.col("_missing").cast("string")), F.col("_missing"))),
    ]
    unknown = F.transform("_n.unrecognized", lambda n: warning("unknown_note", F.concat(F.lit("nota sin flag conocido en la linea "), line, F.lit(': "'), n, F.lit('"'))))
    found = F.concat(F.filter(F.array(*one), lambda w: w.isNotNull()), unknown)
    warnings = read.select("path", F.inline(found))
    items = read.where("_occurrence = 1").select(
        "path", "line_no", "supplier_code", F.col("_d.description").alias("offered_description"), F.col("offered_quantity").cast("decimal(14,3)").alias("offered_quantity"), "unit_of_measure", "raw_unit",
        F.col("unit_price").cast("decimal(14,4)").alias("unit_price"), "raw_notes", F.array_union("_d.flags", "_n.flags").alias("flags"),
    )
    return items, warnings


def provider_warnings(headers: DataFrame) -> DataFrame:
    """A warning for each document whose provider is taken from its file name."""
    message = F.concat(F.lit("el documento no nombra al proveedor; se usa el nombre del archivo: "), F.col("provider_name"))
    return headers.where("provider_from_name").select("path", F.lit("header_fallback").alias("code"), message.alias("message"), F.lit(None).cast("int").alias("line_no"))


def require_items(paths: DataFrame, items: DataFrame) -> None:
    """Raises if some document (path) has no line; names up to ten."""
    without = [r.path for r in paths.select("path").distinct().join(items.select("path").distinct(), "path", "left_anti").orderBy("path").limit(10).collect()]
    if without:
        raise ExtractionError("no lines were found", paths=without)


def extract_xlsx(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, items, warnings) of all workbooks at `path`."""
    rows = sheet_rows(read_xlsx_cells(spark, path))
    headers = xlsx_header(rows)
    items, warnings = offer_items(numbered_rows(xlsx_rows(rows)), "row")
    return headers, items, warnings.unionByName(provider_warnings(headers))


def _has_labels(plain: Column) -> Column:
    return sum((F.contains(plain, F.lit(t)).cast("int") for t in TABLE_HEADER_TOKENS), F.lit(0)) >= 4


def is_table_header(line: Column) -> Column:
    return let(folded(line), _has_labels)


def _is_number_of_page(plain: Column) -> Column:
    return F.trim(plain).rlike(r"^(pagina\s+\d+(\s+de\s+\d+)?|\d+\s*/\s*\d+)$")


def is_page_furniture(line: Column) -> Column:
    return _is_number_of_page(folded(line))


def page_lines(pages: DataFrame) -> DataFrame:
    """path, page, pos, line, part (`header`: on page 1 before the first table header; else `body`), from path, page (from 1), text."""
    # Each line is collapsed and folded once, before lines become rows.
    told = lambda line: let(folded(line), lambda plain: F.struct(line.alias("line"), _has_labels(plain).alias("head"), _is_number_of_page(plain).alias("furniture")))
    read = F.transform(F.split("text", "\n"), lambda line: let(collapsed(line), told))
    # Dealt as pages, not as their many lines, and into the tasks that see a page's lines in order.
    lines = pages.select("path", "page", "text").repartition("path", "page").select("path", "page", F.posexplode(read).alias("pos", "_l"))
    lines = lines.where((F.length("_l.line") > 0) & ~F.col("_l.furniture")).select("path", "page", "pos", "_l.line", F.col("_l.head").alias("_head"))
    seen = F.max(F.col("_head").cast("int")).over(Window.partitionBy("path", "page").orderBy("pos"))
    lines = lines.withColumn("part", F.when((F.col("page") == 1) & (seen == 0), "header").otherwise("body"))
    return lines.where("NOT _head").drop("_head")


def pdf_rows(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with the texts of the fields, lines that are no rows) of the body lines."""
    body = lines.where("part = 'body'")
    part = [F.regexp_extract("line", ROW, k) for k in range(1, 8)]
    is_row = F.regexp_like("line", F.lit(ROW))
    rows = body.where(is_row).select(
        "path", (F.col("page") * 1_000_000 + F.col("pos")).alias("order"), part[0].cast("int").alias("line_no"), part[1].alias("supplier_code"), part[2].alias("offered_description"), part[3].alias("offered_quantity"),
        part[4].alias("unit"), part[5].alias("unit_price"), part[6].alias("notes"), F.lit(False).alias("unit_price_is_number"), F.lit(False).alias("offered_quantity_is_number"),
    )
    return rows, body.where(~is_row).select("path", "page", "pos", "line")


def pdf_header(lines: DataFrame) -> DataFrame:
    """path, provider_name, quote_code, quote_date, terms from `label: value` lines of the header block."""
    value = F.when(F.contains("line", F.lit(":")), F.trim(F.regexp_replace("line", "^[^:]*:", ""))).otherwise(F.col("line"))
    plain = folded(F.col("line"))
    fields = {
        "provider_name": F.when(plain.startswith("proveedor"), value),
        "quote_date": F.when(plain.startswith("fecha"), normalize_iso_date(value)),
        "terms": F.when(plain.startswith("condiciones"), value),
        "quote_code": F.nullif(F.regexp_extract("line", QUOTE_CODE, 0), F.lit("")),
    }
    head = lines.where("part = 'header'").select("path", "pos", *[c.alias(f) for f, c in fields.items()])
    return head.groupBy("path").agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col("pos"))).alias(f) for f in fields])


def extract_pdf_text(pages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(headers, items, warnings, unparsed lines) of page texts (path, page, text)."""
    lines = page_lines(pages)
    rows, unparsed = pdf_rows(lines)
    items, warnings = offer_items(rows, "order", strict=False)
    named = pages.select("path").distinct().join(pdf_header(lines), "path", "left")
    headers = named.withColumn("provider_from_name", F.col("provider_name").isNull()).withColumn("provider_name", F.coalesce("provider_name", file_provider(F.col("path"))))
    return headers, items, warnings.unionByName(provider_warnings(headers)), unparsed


def read_page_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, page (from 1), text of text files whose pages are set apart by form feeds, as extractors of PDF text write them."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\f").alias("_pages"))
    pages = whole.select("path", F.posexplode("_pages").alias("page", "text")).withColumn("page", F.col("page") + 1)
    return pages.where(F.length(F.trim("text")) > 0)


def source_format(path: str) -> str:
    """xlsx, or pdf (the text of its pages), by the file's ending."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("xlsx", "xlsm", "xls"):
        return "xlsx"
    if ending in ("pdf", "txt"):
        return "pdf"
    raise ExtractionError("unknown kind of file", path=path)
