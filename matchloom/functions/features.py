"""Deterministic hashed text features as Column expressions, and similarities of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import folded

# Fixed values of the hash and of the feature weights.
FNV_OFFSET, FNV_PRIME, SIGN_SEED = 0x811C9DC5, 0x01000193, 0x9E3779B9
TOKEN_WEIGHT, TRIGRAM_WEIGHT = 1.0, 0.35
DIMS = 1536


def fnv1a(text: Column, seed: int) -> Column:
    """32-bit FNV-1a of ASCII text as a non-negative long; `seed` is xored into the offset."""
    start = F.lit((FNV_OFFSET ^ seed) & 0xFFFFFFFF).cast("long")
    codes = F.transform(F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "")), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, start, lambda h, c: (h.bitwiseXOR(c) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def tokenize(text: Column) -> Column:
    """Numbers (a comma counts as a point) and runs of letters."""
    return F.regexp_extract_all(F.replace(folded(text), F.lit(","), F.lit(".")), F.lit(r"\d+(?:[.,]\d+)?|[a-z]+"), F.lit(0))


def trigrams(tokens: Column) -> Column:
    """All runs of three characters of tokens of four or more, with repeats."""
    long = F.filter(tokens, lambda t: F.length(t) >= 4)
    return F.flatten(F.transform(long, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda k: F.substring(t, k, F.lit(3)))))


def sparse_vectors(df: DataFrame, key: list[str], text: Column, dims: int = DIMS) -> DataFrame:
    """key and `entries` (index, weight; by index): the nonzero entries of each text's unit vector; a text without features has index 0 alone.

    Rows that share a key are one text.  Texts, not their features, are shuffled and grouped, so that a task holds one batch's features at a time.
    """
    named = df.select(*key, text.alias("_text")).repartition(*key).groupBy(*key).agg(F.array_join(F.collect_list("_text"), "\n").alias("_text"))
    tokens = tokenize(F.col("_text"))

    def tagged(parts: Column, tag: str, weight: float) -> Column:
        def entry(t: Column) -> Column:
            feature = F.concat(F.lit(tag), t)
            sign = F.when(fnv1a(feature, SIGN_SEED) % 2 == 1, 1.0).otherwise(-1.0)
            return F.struct((fnv1a(feature, 0) % dims).cast("int").alias("index"), (sign * F.lit(weight)).alias("w"))

        return F.transform(parts, entry)

    rows = named.select(*key, F.concat(tagged(tokens, "t:", TOKEN_WEIGHT), tagged(trigrams(tokens), "g:", TRIGRAM_WEIGHT)).alias("_features"))

    def run(batches):
        for batch in batches:
            lists = batch.column("_features")
            flat, n = lists.flatten(), len(lists)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
            places, at = np.unique(row << 32 | flat.field("index").to_numpy().astype(np.int64), return_inverse=True)
            sums, row = np.bincount(at, flat.field("w").to_numpy(), len(places)), places >> 32
            length = np.sqrt(np.bincount(row, sums * sums, n))
            kept = sums != 0
            blank = np.flatnonzero(length == 0)
            row, index, weight = (np.append(x, y) for x, y in ((row[kept], blank), ((places & 0xFFFFFFFF)[kept], 0 * blank), (sums[kept] / length[row[kept]], 1.0 + 0 * blank)))
            order = np.argsort(row, kind="stable")
            entries = pa.StructArray.from_arrays([pa.array(index[order].astype(np.int32)), pa.array(weight[order])], ["index", "weight"])
            ends = np.append(0, np.cumsum(np.bincount(row, minlength=n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in key), pa.ListArray.from_arrays(pa.array(ends), entries)], names=[*key, "entries"])

    schema = T.StructType([named.schema[k] for k in key]).add("entries", T.ArrayType(T.StructType().add("index", T.IntegerType()).add("weight", T.DoubleType())))
    return rows.mapInArrow(run, schema)


def sparse_embedding(df: DataFrame, key: list[str], text: Column, dims: int = DIMS) -> DataFrame:
    """key, index, weight: the entries of sparse_vectors, a row each."""
    return sparse_vectors(df, key, text, dims).select(*key, F.inline("entries"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_text(vector: Column) -> Column:
    """A vector as JSON text, and so as pgvector writes it."""
    return F.to_json(vector)


def vector_of(text: Column) -> Column:
    return F.from_json(text, "array<double>")


def text_hash(text: Column) -> Column:
    """The key of a cached embedding."""
    return F.substring(F.sha2(text, 256), 1, 32)


