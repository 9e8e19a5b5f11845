"""Queries that hold texts to their rules where inputs are malformed or ambiguous: numbers, labels, reasons, sheets and page headers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..sources import offers
from . import report
from .catalog import _BEST, _cascade
from .registry import query, t

_ODD = """CASE l_orderkey % 14 WHEN 0 THEN l_partkey || '.' || lpad((l_suppkey % 1000)::VARCHAR, 3, '0') WHEN 1 THEN l_partkey || '.' || l_suppkey % 100 WHEN 2 THEN l_partkey || ',' || l_suppkey % 1000 WHEN 3 THEN '1.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || ',' || l_suppkey % 100
  WHEN 4 THEN '1,' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') || '.' || l_suppkey % 100 WHEN 5 THEN '1.234.' || lpad((l_partkey % 1000)::VARCHAR, 3, '0') WHEN 6 THEN '1,2,' || l_partkey WHEN 7 THEN '-$ ' || l_partkey WHEN 8 THEN 'uSd ' || l_partkey || ',5' WHEN 9 THEN l_partkey || ' m'
  WHEN 10 THEN '  ' WHEN 11 THEN ' - ' WHEN 12 THEN ' $  -' || l_partkey || ' ' END"""


@query(f"""WITH raw AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_ODD} AS raw FROM lineitem),
  bare AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^(ars|usd|u?\\$s?)\\s*', '', 'i'), '\\s', '', 'g') AS b FROM raw),
  digits AS (SELECT *, ltrim(b, '+-') AS g FROM bare),
  plain AS (SELECT *, CASE WHEN NOT regexp_full_match(g, '[0-9.,]+') THEN NULL WHEN contains(g, ',') AND strpos(reverse(g), ',') < CASE WHEN contains(g, '.') THEN strpos(reverse(g), '.') ELSE 9999 END
      THEN replace(replace(left(g, len(g) - strpos(reverse(g), ',')), ',', ''), '.', '') || '.' || right(g, strpos(reverse(g), ',') - 1)
    WHEN contains(g, ',') THEN replace(g, ',', '') WHEN len(g) - len(replace(g, '.', '')) > 1 OR regexp_matches(g, '\\.[0-9][0-9][0-9]$') THEN replace(g, '.', '') ELSE g END AS p FROM digits)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, raw, try_cast(p AS DOUBLE) * CASE WHEN b LIKE '-%' THEN -1 ELSE 1 END AS parsed, coalesce(b NOT IN ('', '-') AND try_cast(p AS DOUBLE) IS NULL, false) AS unreadable FROM plain""")
def odd_numbers(spark, d):
    """Numbers with both separators, several, none, signs, currencies and trailing text; and which of them can't be read."""
    k, p, s = F.col("l_orderkey") % 14, F.col("l_partkey"), F.col("l_suppkey")
    text_of = lambda n: n.cast("string")
    three = lambda n: F.lpad(text_of(n % 1000), 3, "0")
    made = [F.concat(text_of(p), F.lit("."), three(s)), F.concat(text_of(p), F.lit("."), text_of(s % 100)), F.concat(text_of(p), F.lit(","), text_of(s % 1000)), F.concat(F.lit("1."), three(p), F.lit(","), text_of(s % 100))]
    made += [F.concat(F.lit("1,"), three(p), F.lit("."), text_of(s % 100)), F.concat(F.lit("1.234."), three(p)), F.concat(F.lit("1,2,"), text_of(p)), F.concat(F.lit("-$ "), text_of(p)), F.concat(F.lit("uSd "), text_of(p), F.lit(",5")), F.concat(text_of(p), F.lit(" m"))]
    made += [F.lit("  "), F.lit(" - "), F.concat(F.lit(" $  -"), text_of(p), F.lit(" "))]
    raw = F.lit(None).cast("string")
    for n, value in enumerate(made):
        raw = F.when(k == n, value).otherwise(raw)
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", raw.alias("raw"))
    return rows.withColumn("parsed", text.parse_arg_number(F.col("raw"))).withColumn("unreadable", text.number_is_unreadable(F.col("raw")))


_STATUSES, _DECIDED, _FLAGGED = list(report.STATUS_LABEL), list(report.DECIDED_BY_LABEL), list(report.FLAG_LABEL)


@query("""SELECT event_id, (['Coincidencia', 'Cantidad parcial', 'Equivalente tecnico', 'Alternativa', 'No cotizado', 'Sobrante', 'Dudoso'])[event_id % 7 + 1] AS status,
    (['mismo producto y misma cantidad', 'mismo producto, cantidad distinta a la pedida', 'el proveedor lo ofrece como equivalente tecnico', 'segunda opcion del proveedor para un item ya cubierto', 'pedido pero no cotizado', 'cotizado pero no pedido', 'el sistema no pudo determinarlo con confianza'])[event_id % 7 + 1] AS meaning,
    (['codigo exacto', 'alias confirmado', 'vectorial + LLM', 'LLM', 'similitud lexica', 'sin asignar'])[event_id % 6 + 1] AS decided_by, (['equivalente tecnico', 'linea alternativa', 'stock parcial', 'bulto minimo', 'marca a confirmar', 'adicional sugerido'])[event_id % 5 + 1] AS flag FROM events""")
def all_labels(spark, d):
    """The labels of all statuses, of ways of deciding, and of flags."""
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % n + 1).cast("int"))
    of = lambda labels, key: F.element_at(text.literal_map(labels), key)
    status = at(_STATUSES, 7)
    return t(spark, d, "events").select(
        "event_id", of({k: v[0] for k, v in report.STATUS_LABEL.items()}, status).alias("status"), of({k: v[1] for k, v in report.STATUS_LABEL.items()}, status).alias("meaning"), of(report.DECIDED_BY_LABEL, at(_DECIDED, 6)).alias("decided_by"), of(report.FLAG_LABEL, at(_FLAGGED, 5)).alias("flag")
    )


@query(f"""WITH {_BEST}, decided AS (SELECT l.line_no, l.flags, l.s1, b.s2, l.top, kind, CASE WHEN line_no % 80 = 0 THEN line_no + 1 WHEN kind = 'match' THEN l.top END AS item_no, CASE WHEN line_no % 80 = 0 THEN 1.0::DOUBLE WHEN kind = 'match' THEN confidence END AS confidence,
    line_no // 20 % 4 + 1 AS quantity, line_no % 80 = 0 AS aliased FROM lexical l JOIN best b USING (line_no)),
  said AS (SELECT *, CASE WHEN aliased THEN 'alias confirmado por el comprador para el codigo C' || line_no WHEN kind = 'match' THEN 'similitud lexica ' || printf('%.3f', s1) || ' contra "item ' || top || '"' || CASE WHEN s2 IS NULL THEN '' ELSE ', margen de ' || printf('%.3f', s1 - s2) || ' sobre el siguiente candidato' END
      || CASE WHEN confidence < 0.6::DOUBLE THEN ' (por debajo del umbral de confianza)' ELSE '' END
    WHEN list_contains(flags, 'extra_suggested') AND s1 < 0.6::DOUBLE THEN 'el proveedor la anota como producto adicional y la similitud con el mejor candidato es baja (' || printf('%.3f', s1) || ' contra "item ' || top || '")'
    ELSE 'ningun item solicitado se le parece (mejor candidato: ' || printf('%.3f', s1) || ')' END AS reason FROM decided),
  placed AS (SELECT *, item_no % 4 + 1 AS asked, row_number() OVER w AS place, count(*) OVER (PARTITION BY item_no) AS n, first_value(confidence) OVER w AS best, first_value(line_no) OVER w AS winner,
    string_agg('#' || line_no, ', ' ORDER BY confidence DESC, line_no) OVER (PARTITION BY item_no) AS claims FROM said WHERE item_no IS NOT NULL WINDOW w AS (PARTITION BY item_no ORDER BY confidence DESC, line_no)),
  own AS (SELECT *, CASE WHEN confidence < 0.6::DOUBLE THEN 'confianza ' || printf('%.2f', confidence) || ', por debajo del umbral de 0.6' WHEN quantity < asked THEN 'el proveedor ofrece ' || quantity || ' de las ' || asked || ' pedidas (faltan ' || (asked - quantity) || ')'
    WHEN quantity > asked THEN 'el proveedor ofrece ' || quantity || ' contra ' || asked || ' pedidas (' || (quantity - asked) || ' de mas, probable presentacion comercial)'
    WHEN list_contains(flags, 'technical_equivalent') THEN 'el proveedor lo ofrece como equivalente tecnico: requiere aprobacion del comprador' ELSE 'mismo producto y misma cantidad' END AS plain FROM placed)
  SELECT line_no, item_no, CASE WHEN n = 1 THEN reason || '. ' || plain
    WHEN place = 1 THEN reason || '. otra(s) ' || (n - 1) || ' linea(s) de la oferta apuntan al mismo item (' || substr(claims, strpos(claims, ', ') + 2) || '): gano esta por confianza ' || printf('%.2f', confidence)
    WHEN list_contains(flags, 'alternative_line') AND best - confidence <= 0.15::DOUBLE THEN 'el proveedor la ofrece como alternativa de la linea #' || winner || ' para el mismo item'
    ELSE 'reclama el mismo item que la linea #' || winner || ', que gano por confianza (' || printf('%.2f', best) || ' contra ' || printf('%.2f', confidence) || '): no se puede determinar a que item corresponde esta linea' END AS reasoning FROM own
  UNION ALL SELECT line_no, NULL, reason FROM said WHERE item_no IS NULL
  UNION ALL SELECT NULL, vec_id, 'ninguna linea de la oferta corresponde a este item solicitado' FROM embeddings WHERE vec_id % 20 <> 0 AND vec_id NOT IN (SELECT item_no FROM placed)""")
def cascade_reasons(spark, d):
    """What the cascade says of each decision."""
    return _cascade(spark, d)[0].select("line_no", "item_no", "reasoning")


_SHEET = """told AS (SELECT l_orderkey AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS place, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_linenumber FROM lineitem),
  given AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN NULL WHEN l_suppkey % 4 = 1 THEN l_linenumber + 3 ELSE place END AS given FROM told WHERE l_suppkey % 11 <> 5),
  counted AS (SELECT *, count(*) FILTER (WHERE given IS NULL) OVER w AS unnumbered FROM given WINDOW w AS (PARTITION BY n ORDER BY place)),
  numbered AS (SELECT *, coalesce(given, greatest(0, coalesce(max(given - unnumbered) OVER (PARTITION BY n ORDER BY place), 0)) + unnumbered) AS line_no FROM counted),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY n, line_no ORDER BY place) AS copy FROM numbered)"""


def _sheets(spark, d):
    """Rows of a workbook for each order: a label row, a row of column labels, and its lines, some without a number, some without a description.

    Lines are dealt by the workbook's path, and nothing that reads workbooks deals them again.
    """
    path = F.concat(F.lit("/in/oferta_o"), F.col("l_orderkey").cast("string"), F.lit(".xlsx"))
    order = Window.partitionBy("path").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    rows = offers.by_document(t(spark, d, "lineitem").withColumn("path", path)).withColumn("place", F.row_number().over(order))
    s = F.col("l_suppkey")
    number = F.when(s % 4 == 1, F.col("l_linenumber") + 3).when(s % 4 != 0, F.col("place")).cast("string")
    name = F.when(F.col("l_orderkey") % 3 != 0, F.concat(F.lit("Casa "), F.col("l_orderkey").cast("string")))

    def row(at, *cells):
        # A cell without a value has nothing but its place.
        told = F.array(*[F.struct(F.lit(n).alias("column"), v.alias("value"), F.when(v.isNotNull(), b).alias("is_number")) for n, (v, b) in enumerate(cells)])
        return F.struct(at.alias("row"), told.alias("cells"))

    body = row(
        F.col("place") + 1, (number, True), (F.concat(F.lit("A-"), F.col("l_partkey").cast("string")), False), (F.when(s % 11 != 5, F.concat(F.lit("pieza "), F.col("l_partkey").cast("string"))), False),
        (F.col("l_quantity").cast("string"), True), (F.lit("unidad"), False), (F.col("l_extendedprice").cast("decimal(14,2)").cast("string"), True),
    )
    heads = [row(F.lit(0), (F.lit("Proveedor"), False), (name, False)), row(F.lit(1), *[(F.lit(h), False) for h in ("Línea", "Código", "Descripción", "Cantidad", "Unidad", "Precio unitario")])]
    shown = F.when(F.col("place") == 1, F.array(*heads, body)).otherwise(F.array(body))
    return offers.sheet_rows(rows.select("path", F.lit("h").alias("source_hash"), F.inline(shown)))


@query(f"""WITH {_SHEET} SELECT '/in/oferta_o' || n || '.xlsx' AS path, line_no::INT AS line_no, 'A-' || l_partkey AS supplier_code, 'pieza ' || l_partkey AS description, l_quantity AS quantity, round(l_extendedprice, 2) AS price FROM firsts WHERE copy = 1""")
def sheet_items(spark, d):
    """The lines of workbooks: columns found by their labels, numbers filled in, of lines with one number the first."""
    items, _ = offers.offer_items(offers.numbered_rows(offers.xlsx_rows(_sheets(spark, d))), "row")
    return items.select("path", "line_no", "supplier_code", F.col("offered_description").alias("description"), F.col("offered_quantity").cast("double").alias("quantity"), F.col("unit_price").cast("double").alias("price"))


@query(f"""WITH {_SHEET}, kept AS (SELECT DISTINCT n, line_no FROM firsts), gaps AS (SELECT n, lag(line_no) OVER (PARTITION BY n ORDER BY line_no) AS prev, line_no FROM kept)
  SELECT '/in/oferta_o' || n || '.xlsx' AS path, 'duplicate_line' AS code, line_no::INT AS line_no, 'el numero de linea ' || line_no || ' aparece mas de una vez' AS message FROM firsts WHERE copy > 1
  UNION ALL SELECT '/in/oferta_o' || n || '.xlsx', 'line_gap', (prev + 1)::INT, 'faltan ' || (line_no - prev - 1) || ' linea(s) a partir de la ' || (prev + 1) FROM gaps WHERE line_no <> prev + 1
  UNION ALL SELECT '/in/oferta_o' || n || '.xlsx', 'header_fallback', NULL, 'el documento no nombra al proveedor; se usa el nombre del archivo: o' || n FROM (SELECT DISTINCT l_orderkey AS n FROM lineitem) WHERE n % 3 = 0""")
def sheet_warnings(spark, d):
    """What reading the workbooks warns of: repeated numbers, gaps, and providers taken from file names."""
    rows = _sheets(spark, d)
    _, warnings = offers.offer_items(offers.numbered_rows(offers.xlsx_rows(rows)), "row")
    return warnings.unionByName(offers.provider_warnings(offers.xlsx_header(rows))).select("path", "code", "line_no", "message")


@query("""SELECT o_orderkey || '.pdf' AS path, CASE WHEN o_orderkey % 5 <> 0 THEN 'Casa ' || o_custkey END AS provider_name, 'COT-' || o_orderkey || '-' || o_custkey AS quote_code, strftime(o_orderdate, '%Y-%m-%d') AS quote_date, CASE WHEN o_orderkey % 4 = 0 THEN 'pago a ' || o_custkey % 90 || ' dias: contado' END AS terms FROM orders""")
def page_headers(spark, d):
    """The header blocks of page texts, one document for each order; labels in other lines, and after the table's head, don't count."""
    o, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    lines = [
        F.when(F.col("o_orderkey") % 5 != 0, F.concat(F.lit("PROVEEDOR:  Casa "), c)), F.concat(F.lit("Cotización Nº COT-"), o, F.lit("-"), c), F.concat(F.lit("Fecha de emisión: "), F.date_format("o_orderdate", "d/M/yyyy")),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Condiciones: pago a "), (F.col("o_custkey") % 90).cast("string"), F.lit(" dias: contado"))), F.lit("Página 1 de 1"), F.lit("Linea Codigo proveedor Descripción ofertada Cantidad Unidad Precio unit."), F.lit("Proveedor: otro"),
    ]
    pages = t(spark, d, "orders").select(F.concat(o, F.lit(".pdf")).alias("path"), F.lit(1).alias("page"), F.concat_ws("\n", *lines).alias("text"))
    return offers.pdf_header(offers.page_lines(pages)).select("path", "provider_name", "quote_code", "quote_date", "terms")
