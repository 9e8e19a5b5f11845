"""Command line: seed, process, reconcile, report, list, compare, sql, reset."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .errors import EngineError, MatchingError
from .functions.text import embedding_text, normalize_unit
from .observe import stage
from .operators import comparison, providers, similarity, summary, units
from .operators.cascade import reconcile
from .operators.models import ensure_embeddings, stored_vectors
from .operators.store import Store, Transaction, stable_id, to_lines
from .plans import report
from .sources import offers
from .sources.tables import read_requisition, run_sql
from .written import written


def seed(store: Store, folder: str) -> str:
    """Stores a request and its items; gives its code."""
    request, items, _ = read_requisition(store.spark, folder)
    code = request.first().request_id
    requisition = request.select(F.col("request_id").alias("code"), "title").withColumn("id", stable_id("code"))
    store.upsert("requisitions", requisition)
    rows = items.withColumn("code", F.concat_ws("-", "request_id", "item_id")).withColumn("unit_of_measure", normalize_unit(F.col("unit")))
    store.upsert("items", rows.select(stable_id("code").alias("id"), "code", "description", "unit_of_measure"))
    own = rows.join(requisition.select(F.col("code").alias("request_id"), F.col("id").alias("requisition_id")), "request_id")
    store.upsert("requisition_items", own.select(stable_id("requisition_id", "line_no").alias("id"), "requisition_id", stable_id("code").alias("item_id"), "line_no", "quantity", "unit_of_measure", F.col("description").alias("raw_description"), F.col("unit").alias("raw_unit")))
    return code


def process(store: Store, path: str, code: str) -> str:
    """Extracts an offer and stores it under a request; gives the offer's id.  Running it again changes nothing."""
    spark, kind = store.spark, offers.source_format(path)
    if kind == "xlsx":
        headers, items, warnings = offers.extract_xlsx(spark, path)
    elif path.lower().endswith(".pdf"):
        raise EngineError("PDF files need the text of their pages: give a .txt file, pages set apart by form feeds", path=path)
    else:
        headers, items, warnings, unparsed = offers.extract_pdf_text(offers.read_page_texts(spark, path))
        message = F.concat(F.lit("renglon sin leer en la pagina "), F.col("page").cast("string"), F.lit(": "), F.substring("line", 1, 120))
        warnings = warnings.unionByName(unparsed.select("path", F.lit("unparsed_line").alias("code"), message.alias("message"), F.lit(None).cast("int").alias("line_no")))
    hashed = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("source_hash"))
    offers.require_items(hashed, items.select(plain_path(F.col("path")).alias("path")).join(hashed.select(F.col("path").alias("_p"), plain_path(F.col("path")).alias("path")), "path").select(F.col("_p").alias("path")))
    headers = headers.withColumn("path", plain_path(F.col("path"))).join(hashed.withColumn("path", plain_path(F.col("path"))), "path")
    requisition = store.read("requisitions").where(F.col("code") == code).select(F.col("id").alias("requisition_id"))
    if requisition.isEmpty():
        raise MatchingError("no such request", code=code)
    head = headers.crossJoin(requisition)  # one offer and one request
    providers = head.select(stable_id("provider_name").alias("id"), F.col("provider_name").alias("name"))
    offer = head.select(
        stable_id("requisition_id", "source_hash").alias("id"), "requisition_id", stable_id("provider_name").alias("provider_id"), "quote_code", "quote_date", "terms", F.lit(kind).alias("source_format"), F.lit(os.path.basename(path)).alias("source_filename"), "source_hash", F.lit("extracted").alias("status")
    )
    key = offer.first().id
    lines = items.withColumn("offer_id", F.lit(key))

    def put(tx: Transaction) -> None:
        tx.upsert("providers", providers)
        tx.upsert("offers", offer, update=["quote_code", "quote_date", "terms", "source_format", "status"])
        tx.replace_children("offer_items", lines.select(stable_id("offer_id", "line_no").alias("id"), *[c for c in lines.columns if c != "path"]), "offer_id")
        tx.replace_children("offer_warnings", warnings.select(F.lit(key).alias("offer_id"), "code", "message", "line_no"), "offer_id", also=[key])

    store.transact(put)
    return key


def plain_path(path: Column) -> Column:
    """A file's path without the scheme that some readers put in front."""
    return F.regexp_replace(path, "^file:/*", "/")


def warnings_of(store: Store, offer_id: str) -> DataFrame:
    return store.of("offer_warnings", offer_id).orderBy(F.asc_nulls_first("line_no"), "code", "message")


def sides(store: Store, offer_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(offer lines, requested items, confirmed aliases) of an offer."""
    offer = store.read("offers").where(F.col("id") == offer_id).first()
    if offer is None:
        raise MatchingError("no such offer", offer=offer_id)
    lines = store.of("offer_items", offer_id).select(F.col("line_no").cast("long").alias("line_no"), "supplier_code", F.col("offered_description").alias("description"), F.col("offered_quantity").alias("quantity"), "unit_price", "flags", "raw_unit", "unit_of_measure", "raw_notes")
    asked = store.of("requisition_items", offer.requisition_id)
    aliases = store.of("supplier_item_aliases", offer.provider_id).join(asked.select("item_id", F.col("line_no").cast("long").alias("item_no")), "item_id").select("supplier_code", "item_no")
    items = asked.select(F.col("line_no").cast("long").alias("item_no"), F.col("raw_description").alias("description"), "quantity", "raw_unit", "unit_of_measure")
    return lines, items, aliases


def embedded_text(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, embedding_text(F.col("description"), F.col("unit_of_measure")).alias("text"))


def ensure_requisition_embeddings(store: Store, requisition_id: str, settings: config.Config, force: bool = False) -> int:
    """Makes the vectors of a request's items that are not stored yet; gives how many."""
    items = store.of("requisition_items", requisition_id).select(F.col("raw_description").alias("description"), "unit_of_measure", "line_no")
    model, embed = providers.embedder(settings)
    return ensure_embeddings(store, embedded_text(items, "line_no"), model, settings.dims, embed, force)


def candidates(store: Store, lines: DataFrame, items: DataFrame, settings: config.Config) -> DataFrame:
    """Candidates from stored vectors; those of lines or items that lack one are made and stored first."""
    own, theirs = embedded_text(lines, "line_no"), embedded_text(items, "item_no")
    model, embed = providers.embedder(settings)
    ensure_embeddings(store, own.select("text").unionByName(theirs.select("text")), model, settings.dims, embed)
    found = similarity.top_k_sparse(stored_vectors(store, own, "line_no", model, settings.dims), stored_vectors(store, theirs, "item_no", model, settings.dims), settings.top_k)
    return found.join(items.select("item_no", "description"), "item_no")


def run_reconcile(store: Store, offer_id: str, settings: config.Config, decider=None) -> tuple[str, DataFrame]:
    """Stores a reconciliation of an offer; gives its id and summary."""
    lines, items, aliases = sides(store, offer_id)
    # What the items' descriptions say of pack sizes, if units are to be converted.
    conversions = units.closed(units.stated_factors(items, "item_no", "description"), "item_no") if settings.convert_units else None
    rows = reconcile(lines, items, candidates(store, lines, items, settings), aliases, decider, settings.review_brands, check=True, conversions=conversions)
    rows = written(rows, "reconciled")  # read by the summary and by the store
    found = written(summary.summarize(rows, items), "summary")
    offer = store.read("offers").where(F.col("id") == offer_id).select(F.col("id").alias("offer_id"), "requisition_id")
    made = {}

    def put(tx: Transaction) -> None:
        # Two runs at the same time read the same number, and the later one conflicts and takes the next.
        key = made["key"] = f"{offer_id[:16]}-{tx.of('reconciliations', offer_id).count() + 1}"
        head = offer.select(F.lit(key).alias("id"), "offer_id", "requisition_id").crossJoin(found.select(F.to_json(F.struct("*")).alias("summary"))).withColumn("created_at", F.current_timestamp())  # one row each
        tx.replace_children("reconciliation_lines", to_lines(rows, key), "reconciliation_id")
        tx.append("reconciliations", head)

    store.transact(put)
    return made["key"], found


def run_report(store: Store, reconciliation_id: str, form: str, folder: str) -> str:
    head = report.report_head(store.read("reconciliations").where(F.col("id") == reconciliation_id), store.read("offers"), store.read("providers"), store.read("requisitions"))
    row = head.first()
    if row is None:
        raise MatchingError("no such reconciliation", id=reconciliation_id)
    lines, items, _ = sides(store, row.offer_id)
    stored = store.of("reconciliation_lines", reconciliation_id)
    rows = stored.withColumns({"line_no": F.col("offer_item_id").cast("long"), "item_no": F.col("requisition_item_id").cast("long"), "confidence": F.col("confidence").cast("double")})
    loaded = report.load(head, summary.summarize(rows, items), lines, report.report_lines(rows, lines, items), warnings_of(store, row.offer_id))
    path = os.path.join(folder, f"{report.report_name(row.requisition_code, row.source_filename)}.{form}")
    os.makedirs(folder, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(report.RENDERERS[form](loaded))
    return path


def compared(store: Store, code: str, what: str) -> DataFrame:
    """The offers of a request side by side: prices by provider, the best ones, coverage, or the award at the best prices."""
    requisition = store.read("requisitions").where(F.col("code") == code).first()
    if requisition is None:
        raise MatchingError("no such request", code=code)
    quotes = comparison.quoted(store.read("reconciliation_lines"), store.of("offers", requisition.id), store.read("providers"), store.read("offer_items"), store.read("reconciliations"))
    offered = comparison.offers_of(quotes)
    asked = store.of("requisition_items", requisition.id).select(F.col("line_no").cast("long").alias("item_no"), "quantity")
    return {"matrix": lambda: comparison.matrix(offered).orderBy("item_no"), "best": lambda: comparison.best_quotes(offered).orderBy("item_no"), "coverage": lambda: comparison.coverage(offered, asked).orderBy(F.desc("covered"), "total"), "award": lambda: comparison.award(offered, asked)}[what]()


def listed(store: Store, what: str) -> DataFrame:
    if what == "requisitions":
        return summary.child_counts(store.read("requisitions"), store.read("requisition_items"), "id", "requisition_id")
    if what == "offers":
        return summary.child_counts(store.read("offers"), store.read("offer_items"), "id", "offer_id")
    counts = [F.get_json_object("summary", f"$.{c}").cast("int").alias(c) for c in ("covered", "requisition_items", "needs_review")]
    return store.read("reconciliations").select("id", "offer_id", "created_at", *counts)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="matchloom")
    parser.add_argument("--root")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, arguments in {"seed": ["folder"], "process": ["path", "code"], "reconcile": ["offer"], "report": ["reconciliation"], "list": ["what"], "compare": ["code", "view"], "sql": ["query"], "reset": []}.items():
        sub = commands.add_parser(name)
        for a in arguments:
            sub.add_argument(a, choices={"what": ["requisitions", "offers", "reconciliations"], "view": ["matrix", "best", "coverage", "award"]}.get(a))
        if name == "reconcile":
            sub.add_argument("--model", action="store_true", help="let the configured model decide; without it, or without a key, the lexical rule does")
        if name == "report":
            sub.add_argument("--format", choices=sorted(report.RENDERERS), default="md")
            sub.add_argument("--out", default="out")
    given = parser.parse_args(argv)
    settings = config.load({"root": given.root})
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    store = Store(spark, settings.root)
    with stage(given.command) as counts:
        run(spark, store, given, settings, counts)


#: Warnings that processing an offer prints.
PRINTED_WARNINGS = 10


def run(spark: SparkSession, store: Store, given: argparse.Namespace, settings: config.Config, counts: dict) -> None:
    if given.command == "seed":
        code = seed(store, given.folder)
        requisition = store.read("requisitions").where(F.col("code") == code).first()
        counts["vectors"] = ensure_requisition_embeddings(store, requisition.id, settings)
        print(code)
    elif given.command == "process":
        key = process(store, given.path, given.code)
        found = warnings_of(store, key)
        counts["lines"], counts["warnings"] = store.of("offer_items", key).count(), found.count()
        for w in found.limit(PRINTED_WARNINGS).collect():
            print(f"[{w.code}] {w.message}")
        if counts["warnings"] > PRINTED_WARNINGS:
            print(f"... y {counts['warnings'] - PRINTED_WARNINGS} mas")
        print(key)
    elif given.command == "reconcile":
        key, found = run_reconcile(store, given.offer, settings, providers.decider(settings) if given.model else None)
        print(key, json.dumps(found.first().asDict(), default=str))
    elif given.command == "report":
        print(run_report(store, given.reconciliation, given.format, given.out))
    elif given.command == "list":
        listed(store, given.what).show(truncate=False)
    elif given.command == "compare":
        compared(store, given.code, given.view).show(1000, truncate=False)
    elif given.command == "reset":
        store.reset()
    else:
        from .schemas import TABLES

        for name in TABLES:
            store.read(name).createOrReplaceTempView(name)
        run_sql(spark, given.query).show(truncate=False)


if __name__ == "__main__":
    main()
