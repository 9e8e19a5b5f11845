"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks by a hash of the document id.  Whole passes over a source and then
whole blocks in permuted order make up its target; the last one is drawn in part, document by
document, and is the one with the shortest longest document of those that can fill the rest.  These block quotas go down a binary tree over the output shards: at each node the left
half's share of every source is one draw of the multivariate hypergeometric law, so that quotas
add up exactly.  Every shard then takes the next blocks of each source's permutation, disjoint from
all other shards', and orders its documents locally by a hash.

Only sums by source and by block reach the driver: at most MAX_SOURCES sources (more raise an error)
and MAX_BLOCKS blocks besides one for each source.

Defined results: null or empty texts have size 0 and are drawn with their block; a null source is a
source of its own, last in order; rows that share an id share a block and are drawn each; a
table without words has targets and takes of 0; further columns are kept or ignored as the caller selects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, fresh

MAX_SOURCES = 100_000
MAX_BLOCKS = 1 << 16
#: Documents for each block, where the bound on blocks allows.
BLOCK_DOCS = 8
MOST_COPIES = 3
#: Words of an output shard, about, where the caller names no number of shards; there are at least LEAST_SHARDS and at most a quarter of MAX_BLOCKS.
SHARD_WORDS = 1 << 22
LEAST_SHARDS = 16


def targets(sizes: np.ndarray, weights: np.ndarray, most: float = MOST_COPIES) -> np.ndarray:
    """Shares of the total by weight, none above `most` times its size; the excess is shared again by weight."""
    total, caps = float(sizes.sum()), most * sizes.astype(float)
    order = np.argsort(caps / weights, kind="stable")
    capped, weight = 0.0, float(weights.sum())
    out = caps.copy()
    for n, k in enumerate(order):
        level = (total - capped) / weight
        if caps[k] > level * weights[k]:
            rest = order[n:]
            out[rest] = level * weights[rest]
            break
        capped += caps[k]
        weight -= weights[k]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Rows by shard that add up to `quotas`: the leaves of the splitting tree, whose capacities differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, quotas.astype(np.int64))]
    while nodes:
        first, stop, held = nodes.pop()
        if stop - first == 1:
            out[first] = held
            continue
        middle = (first + stop) // 2
        left = int(held.sum()) * (middle - first) // (stop - first)
        drawn = rng.multivariate_hypergeometric(held, left, method="marginals") if len(held) and left else np.zeros_like(held)
        nodes += [(middle, stop, held - drawn), (first, middle, drawn)]
    return out


@dataclass
class Plan:
    """For each block of each source: the shard of each whole copy, and the words and shard of a copy in part."""

    rows: list[tuple]
    schema = "_source string, _block int, _target double, _source_size long, _shards array<int>, _part_words double, _part_shard int"


def plan_blocks(sources: list[str | None], words: list[np.ndarray], longest: list[np.ndarray], weights: np.ndarray, shards: int, seed: int) -> Plan:
    """`words` and `longest`: for each source, the words in each of its blocks and in the longest document of each."""
    sizes = np.array([int(w.sum()) for w in words], np.int64)
    wanted = targets(sizes, weights)
    units: list[list[tuple[int, float | None]]] = []  # for each source, its drawn blocks in order; with words: in part
    for k, (size, target) in enumerate(zip(sizes, wanted, strict=True)):
        order = np.random.default_rng([seed, k]).permutation(len(words[k]))
        full = min(MOST_COPIES, int(target / size + 1e-12)) if size else 0
        rest = target - full * size if size and full < MOST_COPIES else 0.0
        own: list[tuple[int, float | None]] = [(int(b), None) for _ in range(full) for b in order]
        for n, b in enumerate(order):
            if rest < 0.5:
                break
            if words[k][b] > rest:
                able = [int(c) for c in order[n:] if words[k][c] >= rest]
                own.append((min(able, key=lambda c: longest[k][c]), rest))
                break
            own.append((int(b), None))
            rest -= float(words[k][b])
        units.append(own)
    quotas = split_quotas(np.array([len(u) for u in units], np.int64), shards, np.random.default_rng([seed, len(units)]))
    rows = []
    for k, own in enumerate(units):
        shard_of = np.repeat(np.arange(shards), quotas[:, k])
        whole: list[list[int]] = [[] for _ in words[k]]
        part: dict[int, tuple[float, int]] = {}
        for (b, some), shard in zip(own, shard_of.tolist(), strict=True):
            if some is None:
                whole[b].append(shard)
            else:
                part[b] = (float(some), shard)
        rows += [(sources[k], b, float(wanted[k]), int(sizes[k]), whole[b], *part.get(b, (None, None))) for b in range(len(whole))]
    return Plan(rows)


def mix_sources(df: DataFrame, shards: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and `draws` (array of shard and local order) for every row."""
    spark = df.sparkSession
    sized = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("_source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    sized = checkpointed(sized.withColumn("_key", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed))), "mix-sizes")
    by_source = sized.groupBy("_source").agg(F.count("*").alias("docs")).limit(MAX_SOURCES + 1).collect()
    if len(by_source) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    by_source.sort(key=lambda r: (r._source is None, r._source or ""))
    docs = np.array([r.docs for r in by_source], np.int64)
    each = max(BLOCK_DOCS, -(-int(docs.sum()) // MAX_BLOCKS)) if len(docs) else 1
    blocks = -(-docs // each)
    counts = spark.createDataFrame([(r._source, int(b)) for r, b in zip(by_source, blocks, strict=True)], "_source string, _blocks int")
    sized = sized.join(counts.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    sized = sized.withColumn("_block", F.pmod(F.col("_key"), F.col("_blocks")).cast("int")).drop("_blocks")
    place = {r._source: k for k, r in enumerate(by_source)}
    words = [np.zeros(b, np.int64) for b in blocks]
    longest = [np.zeros(b, np.int64) for b in blocks]
    for r in sized.groupBy("_source", "_block").agg(F.sum("size").alias("words"), F.max("size").alias("longest")).collect():
        words[place[r._source]][r._block], longest[place[r._source]][r._block] = r.words, r.longest
    if shards is None:
        shards = min(max(LEAST_SHARDS, int(sum(w.sum() for w in words)) // SHARD_WORDS), MAX_BLOCKS // 4)
    plan = plan_blocks([r._source for r in by_source], words, longest, np.arange(len(docs)) % 3 + 1.0, shards, seed)
    planned = spark.createDataFrame(plan.rows, plan.schema).withColumnsRenamed({"_source": "_s", "_block": "_b"})
    drawn = sized.join(planned, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    before = F.sum("size").over(Window.partitionBy("_source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    in_part = F.col("_part_words").isNotNull() & (F.coalesce(before, F.lit(0)) + F.col("size") / 2 <= F.col("_part_words"))
    shards_of = F.when(in_part, F.concat("_shards", F.array("_part_shard"))).otherwise(F.col("_shards"))
    draws = F.transform(shards_of, lambda shard, i: F.struct(shard.alias("shard"), F.xxhash64(F.lit(seed), F.col("_key"), i).alias("place")))
    drawn = drawn.withColumn("draws", draws)
    return drawn.select("doc_id", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("size") * F.size("draws")).alias("taken"), "draws")


def mixed_rows(df: DataFrame, shard_col: str | None = None, **options) -> DataFrame:
    """The rows of `df` as the mix draws them, once for each draw: each shard in one partition, in its local order.

    With `shard_col`, a column of that name holds the shard's number.  Ids that repeat keep the draws of one of their rows.
    """
    id_col = options.get("id_col", "doc_id")
    key, drawn, draw = (fresh(df, n) for n in ("drawn_id", "draws", "draw"))
    draws = mix_sources(df, **options).groupBy(F.col("doc_id").alias(key)).agg(F.max_by("draws", F.size("draws")).alias(drawn))
    shards = (draws.select(F.max(F.array_max(F.transform(drawn, lambda d: d.shard)))).first()[0] or 0) + 1
    rows = df.join(draws, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key))).withColumn(draw, F.explode(drawn))
    rows = rows.repartition(shards, F.col(draw).shard).sortWithinPartitions(F.col(draw).shard, F.col(draw).place)
    return rows.select(*[F.col(f"`{c}`") for c in df.columns], *([F.col(draw).shard.alias(shard_col)] if shard_col else []))
