"""Readers of tabular and text inputs with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ExtractionError
from ..functions.text import parse_arg_number
from ..schemas import REQUEST_ITEMS, REQUESTS


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> DataFrame:
    """Rows of a headed CSV, trimmed; a row that doesn't fit or lacks a required value fails the job when it is read."""
    rows = spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST", encoding="UTF-8", enforceSchema=False)
    for c in required or []:
        rows = rows.withColumn(c, F.coalesce(F.nullif(F.col(c), F.lit("")), F.raise_error(F.lit(f"{path}: {c} is empty")).cast("string")))
    return rows


def first_bad_row(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> int | None:
    """The number of the first row (the head is row 1; blank lines don't count) that doesn't fit the schema or lacks a required value."""
    corrupt = "_corrupt_record"
    rows = read_csv_lenient(spark, path, schema).withColumn("_id", F.monotonically_increasing_id())
    missing = [F.coalesce(F.col(c), F.lit("")) == "" if schema[c].dataType == T.StringType() else F.col(c).isNull() for c in required or []]
    bad = F.col(corrupt).isNotNull()
    for m in missing:
        bad |= m
    # The hash keeps all columns in the scan: a column that is not read is not checked.
    parts = rows.select(F.shiftright("_id", 33).alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), bad.alias("bad"), F.xxhash64(*schema.names).alias("_all"))
    parts = parts.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor("_all").alias("_seen"), F.min(F.when(F.col("bad"), F.col("place"))).alias("first")).orderBy("part").collect()  # a row for each partition
    before = 0
    for part in parts:
        if part["first"] is not None:
            return before + part["first"] + 2
        before += part.n
    return None


def check_csv(spark: SparkSession, path: str, schema: T.StructType, required: list[str] | None = None) -> None:
    """Raises, with the row's number, if a row doesn't fit or lacks a required value."""
    if (row := first_bad_row(spark, path, schema, required)) is not None:
        raise ExtractionError("unreadable row", path=path, fila=row)


def read_csv_lenient(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """As read_csv, but rows that don't fit stay, with their text in `_corrupt_record`."""
    return spark.read.csv(path, header=True, schema=T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]), ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE")


def read_requisition(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the first request, its items, items of other requests, which are left out)."""
    for name, schema in (("purchase_requests", REQUESTS), ("purchase_request_items", REQUEST_ITEMS)):
        check_csv(spark, f"{folder}/{name}.csv", schema, schema.names)
    requests = read_csv(spark, f"{folder}/purchase_requests.csv", REQUESTS, ["request_id", "title"])
    items = read_csv(spark, f"{folder}/purchase_request_items.csv", REQUEST_ITEMS, ["request_id", "item_id", "description", "quantity", "unit"])
    request = requests.limit(1)
    if request.isEmpty():
        raise ExtractionError("no request", folder=folder)
    own = items.join(F.broadcast(request.select("request_id")), "request_id", "left_semi")
    others = items.join(F.broadcast(request.select("request_id")), "request_id", "left_anti")
    return request, own.withColumn("line_no", F.col("item_id").cast("int")).withColumn("quantity", parse_arg_number(F.col("quantity")).cast("decimal(14,3)")), others


GUIDE_COLUMNS = ("item_no", "requested_description", "requested_quantity", "line_no", "supplier_code", "offered_description", "offered_quantity", "label", "explanation")


def read_guide(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the nine-column tables of a markdown guide, with their section; every label is kept."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    ordered = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)  # one small document
    section = F.last(F.when(F.col("line").startswith("## "), F.trim(F.substring("line", 4, 1000))), ignorenulls=True).over(ordered)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|", 9), lambda c: F.nullif(F.trim(c), F.lit("")))
    rows = lines.withColumn("section", section).where(F.col("line").startswith("|")).withColumn("cells", cells).where((F.size("cells") == 9) & ~F.col("line").rlike("^[|: -]+$"))
    named = [F.col("cells")[k].alias(name) for k, name in enumerate(GUIDE_COLUMNS)]
    rows = rows.select("n", "section", *named)
    number = F.coalesce(F.col("item_no").try_cast("int"), F.col("line_no").try_cast("int"))
    return rows.where(number.isNotNull()).withColumns({c: F.col(c).try_cast("int") for c in ("item_no", "line_no")})


def embedding_widths(table: DataFrame, dims: int) -> DataFrame:
    """Rows whose vector has another width than `dims`."""
    return table.where(F.col("embedding").isNotNull() & (F.size("embedding") != dims))


def run_sql(spark: SparkSession, query: str, width: int = 60) -> DataFrame:
    """Any statement; strings over `width` characters are cut for display, ending in three dots."""
    found = spark.sql(query)
    short = [F.when(F.length(F.col(f"`{n}`")) > width, F.concat(F.substring(F.col(f"`{n}`"), 1, width - 3), F.lit("..."))).otherwise(F.col(f"`{n}`")).alias(n) if t == "string" else F.col(f"`{n}`") for n, t in found.dtypes]
    return found.select(*short)
