"""Model-backed stages with injected clients, and deterministic stand-ins for where there is no network.

A client is a picklable function of a batch; batches run inside tasks, whose retries make calls again, so
clients must give the same answer to the same batch.
"""

from __future__ import annotations

import inspect
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ExtractionError
from ..functions.features import DIMS, sparse_embedding, text_hash
from ..observe import observed
from ..sources import offers
from ..written import written
from .lines import cross_check
from .rules import lexical_confidence, lexical_kind
from .store import Store

MATCH_BATCH, LINE_BATCH, EMBED_BATCH = 10, 40, 100


class ModelDecider:
    """Level 2 by a model: `client(lines)` gives for each request its item_no (or None), confidence and reasoning.

    Requests are dicts of line_no, description and candidates.  Lines that the client leaves out, or
    whose batch fails twice, come back as failed.
    """

    def __init__(self, client: Callable[[list[dict]], list[dict]], batch: int = MATCH_BATCH):
        self.client, self.batch = client, batch

    def decide(self, pending: DataFrame) -> DataFrame:
        client, size = self.client, self.batch

        def ask(requests: list[dict]) -> dict[int, dict]:
            for attempt in (1, 2):
                try:
                    asked = {r["line_no"] for r in requests}
                    return {d["line_no"]: d for d in client(requests) if d["line_no"] in asked}
                except Exception:
                    if attempt == 2:
                        return {}
            return {}

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for at in range(0, len(frame), size):
                    part = frame.iloc[at : at + size]
                    requests = [{"line_no": int(r.line_no), "description": r.description, "candidates": [dict(c) for c in r.candidates] if r.candidates is not None else []} for r in part.itertuples()]
                    found = ask(requests)
                    for r in requests:
                        d = found.get(r["line_no"])
                        known = {c["item_no"] for c in r["candidates"]}
                        item = d.get("item_no") if d else None
                        failed = d is None or (item is not None and item not in known)
                        rows.append((r["line_no"], None if failed else item, None if failed or item is None else float(d["confidence"]), None if failed else d.get("reasoning"), "vector+llm", failed))
                yield pd.DataFrame(rows, columns=["line_no", "item_no", "confidence", "reasoning", "decided_by", "failed"]).astype({"item_no": "Int64"})

        return pending.select("line_no", "description", "candidates").mapInPandas(run, "line_no long, item_no long, confidence double, reasoning string, decided_by string, failed boolean")


def stand_in_match(requests: list[dict]) -> list[dict]:
    """A client without a model: the best candidate, if its score reaches one half."""
    out = []
    for r in requests:
        best = max(r["candidates"], key=lambda c: c["score"], default=None)
        item = best["item_no"] if best and best["score"] >= 0.5 else None
        out.append({"line_no": r["line_no"], "item_no": item, "confidence": best["score"] if item is not None else 0.0, "reasoning": "mejor candidato"})
    return out


def extract_lines(lines: DataFrame, client: Callable[..., list[dict]], batch: int = LINE_BATCH) -> DataFrame:
    """path, the texts of line fields that `client` reads from batches of text lines, failed and mismatch.

    `client(texts)`; after an error it is asked once more, as `client(texts, error)`, where it takes two arguments, so that it can mend
    what was wrong.  A batch that fails twice is one row with `failed`; `mismatch` marks the rows of a batch that gave another number of lines.
    """
    told = len(inspect.signature(client).parameters) > 1
    fields = ["line_no", "supplier_code", "offered_description", "offered_quantity", "unit", "unit_price", "notes"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, part in frame.groupby("path", sort=False):
                texts = part["line"].tolist()
                for at in range(0, len(texts), batch):
                    part = texts[at : at + batch]
                    try:
                        found = client(part)
                    except Exception as first:
                        try:
                            found = client(part, str(first)) if told else client(part)
                        except Exception:
                            rows.append((path, *[None] * len(fields), True, False))
                            continue
                    rows += [(path, *[None if f.get(k) is None else str(f[k]) for k in fields], False, len(found) != len(part)) for f in found]
            yield pd.DataFrame(rows, columns=["path", *fields, "failed", "mismatch"])

    return lines.where("part = 'body'").select("path", "line").mapInPandas(run, "path string, " + ", ".join(f"{f} string" for f in fields) + ", failed boolean, mismatch boolean")


def extract_pdf_with_model(pages: DataFrame, client: Callable[..., list[dict]], batch: int = LINE_BATCH) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, items, warnings) of page texts (path, page, text), lines read by the model and checked against those that patterns read.

    Warnings: those of the lines, failed batches, batches of another number of lines, and differences from the lines that
    patterns could read.
    """
    headers, reference, _, _ = offers.extract_pdf_text(pages)
    read = written(extract_lines(offers.page_lines(pages), client, batch), "model-lines")
    numbered = read.where("NOT failed").withColumn("line_no", F.col("line_no").try_cast("int")).where("line_no IS NOT NULL")
    numbered = numbered.withColumns({"order": F.monotonically_increasing_id(), "unit_price_is_number": F.lit(False), "offered_quantity_is_number": F.lit(False)})
    items, found = offers.offer_items(numbered, "order", strict=False)

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.select(F.struct("path", "line_no").alias("line_no"), "unit_price", F.col("offered_quantity").alias("quantity"), "supplier_code")

    off = cross_check(keyed(items), keyed(reference)).select(
        F.col("line_no.path").alias("path"), "code",
        F.concat(F.lit("linea "), F.col("line_no.line_no").cast("string"), F.when(F.col("field") == "line", " no fue leida por el modelo").otherwise(F.concat(F.lit(": "), "field", F.lit(" leido "), F.coalesce("read_value", F.lit("-")), F.lit(" contra "), F.coalesce("reference_value", F.lit("-"))))).alias("message"),
        F.col("line_no.line_no").alias("line_no"),
    )
    none = F.lit(None).cast("int").alias("line_no")
    failed = read.where("failed").select("path", F.lit("llm_failed").alias("code"), F.lit("un lote de renglones fallo dos veces").alias("message"), none)
    counts = read.where("mismatch").select("path", F.lit("llm_retry").alias("code"), F.lit("el modelo devolvio otra cantidad de lineas que las dadas").alias("message"), none).distinct()
    return headers, items, found.unionByName(off).unionByName(failed).unionByName(counts)


def hashed_vectors(misses: DataFrame, dims: int) -> DataFrame:
    """text_hash and vector of texts (text_hash, text): the hashed features, which need no client."""
    made = sparse_embedding(misses, ["text_hash"], F.col("text"), dims).groupBy("text_hash")
    return made.agg(F.sort_array(F.collect_list(F.struct("index", "weight"))).alias("vector"))


def client_vectors(client: Callable[[list[str]], list[list[float]]], batch: int = EMBED_BATCH) -> Callable[[DataFrame, int], DataFrame]:
    """An embedder that asks `client` for the vectors of `batch` texts at a time; each must be of the width asked for, and is brought to length 1."""

    def embed(misses: DataFrame, dims: int) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), batch):
                    part = frame.iloc[at : at + batch]
                    vectors = client(part["text"].tolist())
                    if len(vectors) != len(part) or any(len(v) != dims for v in vectors):
                        raise ExtractionError("the model gave vectors of another number or width", expected=f"{len(part)} x {dims}", widths=sorted({len(v) for v in vectors}))
                    lengths = [math.sqrt(math.fsum(x * x for x in v)) or 1.0 for v in vectors]
                    sparse = [[{"index": k, "weight": float(x) / n} for k, x in enumerate(v) if x] for v, n in zip(vectors, lengths, strict=True)]
                    yield pd.DataFrame({"text_hash": part["text_hash"].tolist(), "vector": sparse})

        return misses.select("text_hash", "text").mapInPandas(run, "text_hash string, vector array<struct<index: int, weight: double>>")

    return embed


def embeddings_with_cache(texts: DataFrame, cache: DataFrame, model: str = "hashed", dims: int = DIMS, embed: Callable[[DataFrame, int], DataFrame] = hashed_vectors, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(text_hash and vector of all `texts` (text), the rows to add to the cache).

    Keys hold model and width, so vectors of different models never meet.  `force`: makes all vectors anew.  Of
    rows of the cache with one key, which writers at the same time can leave, the least counts.
    """
    keyed = texts.where(F.col("text").isNotNull()).select("text", text_hash(F.col("text")).alias("text_hash")).distinct()
    own = cache.where((F.col("model") == model) & (F.col("dims") == dims)).select("text_hash", "vector").join(keyed.select("text_hash"), "text_hash", "left_semi")
    misses = keyed if force else keyed.join(own.select("text_hash"), "text_hash", "left_anti")
    made = embed(misses, dims).select("text_hash", F.lit(model).alias("model"), F.lit(dims).alias("dims"), "vector")
    known = own.where("false") if force else own.groupBy("text_hash").agg(F.min("vector").alias("vector"))
    return known.unionByName(made.select("text_hash", "vector")), made


def ensure_embeddings(store: Store, texts: DataFrame, model: str = "hashed", dims: int = DIMS, embed: Callable[[DataFrame, int], DataFrame] = hashed_vectors, force: bool = False) -> int:
    """Makes and stores the vectors that `texts` (text) lack, all with `force`; gives how many were made.

    The rows are appended, so writers at the same time don't conflict; each vector's indexes must lie within the width.
    """
    _, made = embeddings_with_cache(texts, store.read("text_embeddings"), model, dims, embed, force)
    fits = F.forall("vector", lambda x: (x["index"] >= 0) & (x["index"] < dims))
    made = made.withColumn("vector", F.when(fits, F.col("vector")).otherwise(F.raise_error(F.lit(f"a vector is wider than {dims}"))))
    rows, seen = observed(made, "vectors made")
    if force:
        store.upsert("text_embeddings", rows)
    else:
        store.append("text_embeddings", rows)
    return seen.get["rows"]


def stored_vectors(store: Store, texts: DataFrame, key: str, model: str = "hashed", dims: int = DIMS) -> DataFrame:
    """`key`, index, weight of each row of `texts` (key, text), from the store; texts without a stored vector have no rows."""
    own = store.read("text_embeddings").where((F.col("model") == model) & (F.col("dims") == dims)).groupBy("text_hash").agg(F.min("vector").alias("vector"))
    return texts.select(key, text_hash(F.col("text")).alias("text_hash")).join(own, "text_hash").select(key, F.inline("vector"))


def lexical_columns(candidates: Column, flags: Column) -> tuple[Column, Column]:
    """Kind and confidence of the lexical rule on an array of candidates."""
    first, second = F.try_element_at(candidates, F.lit(1))["score"], F.try_element_at(candidates, F.lit(2))["score"]
    return lexical_kind(first, flags), lexical_confidence(first, second)
