"""Vectors dealt to shards and queries to blocks, each held as one row of bytes.

Shards stay where they are: each is indexed once, and the far smaller blocks of queries go to all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpointed

SHARD_ROWS = 8192
QUERY_ROWS = 1024


@dataclass
class Block:
    """Ids, ascending, and their vectors, of equal length (shorter ones end in zeros)."""

    ids: np.ndarray
    vectors: np.ndarray

    @classmethod
    def of(cls, ids: bytes, vectors: bytes) -> Block:
        ids = np.frombuffer(ids, np.int64)
        return cls(ids, np.frombuffer(vectors, np.float64).reshape(len(ids), -1))


def resized(vectors: np.ndarray, dims: int) -> np.ndarray:
    """Vectors with `dims` components: what is missing is 0, what is beyond meets only zeros."""
    return vectors[:, :dims] if vectors.shape[1] >= dims else np.pad(vectors, ((0, 0), (0, dims - vectors.shape[1])))


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector (doubles) of the rows whose vector and all of its components are there and finite."""
    own = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & fine)


def blocks(vectors: DataFrame, rows: int, name: str) -> tuple[DataFrame, int]:
    """(name, ids, vectors) of about `rows` rows each, dealt by a hash of id and place, so that repeated rows spread; and how many there are."""
    count = max(1, -(-vectors.count() // rows))
    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(count)).cast("int"))

    def pack(rows: pa.Table) -> pa.Table:
        ids = rows.column("vec_id").to_numpy()
        lists = rows.column("vector").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        out = np.zeros((len(ids), int(sizes.max(initial=0))))
        out[np.repeat(np.arange(len(ids)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
        order = np.lexsort((*out.T[::-1], ids)) if out.shape[1] else np.argsort(ids, kind="stable")
        return pa.table({name: rows.column(name)[:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "vectors": pa.array([out[order].tobytes()], pa.binary())})

    return dealt.groupBy(name).applyInArrow(pack, f"{name} int, ids binary, vectors binary"), count


class Best:
    """The best `top` of each query: scores, then smaller ids."""

    def __init__(self, floors: np.ndarray, top: int):
        self.floors, self.top = floors.astype(np.float64), top
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0), np.zeros(0, np.int64))] * len(floors)

    def threshold(self, query: int) -> float:
        """What a candidate must reach: the query's floor, or its last place once all are taken."""
        scores = self.found[query][0]
        return max(self.floors[query], scores[-1] if len(scores) == self.top else -np.inf)

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.top:
            keep = scores >= np.partition(scores, len(scores) - self.top)[len(scores) - self.top]
            scores, ids = scores[keep], ids[keep]
        scores, ids = np.concatenate([self.found[query][0], scores]), np.concatenate([self.found[query][1], ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.found[query] = scores[order], ids[order]

    def triples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query's place, id and score of all that was found."""
        sizes = [len(ids) for _, ids in self.found]
        scores, ids = (np.concatenate([f[k] for f in self.found]) if self.found else np.zeros(0) for k in (0, 1))
        return np.repeat(np.arange(len(sizes)), sizes), ids.astype(np.int64), scores

    def thresholds(self) -> np.ndarray:
        return np.array([self.threshold(k) for k in range(len(self.found))])


def searched(vectors: DataFrame, every: int, index: Callable[[Block], object], search: Callable[[object, Block, np.ndarray], Best], top: int, score: str, pilot: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the best `top` of what `search(index(shard), queries, floors)` finds for each row whose id is a multiple of `every`.

    With `pilot`, one shard is searched first, and the scores that the queries have reached there are the floors
    with which all shards are searched.  Ties go to the smaller id.  Of rows that share a query's id none is its
    candidate; the query is the one with the least vector.
    """
    queries = vectors.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    shards, n_shards = blocks(vectors, SHARD_ROWS, "shard")
    shards = checkpointed(shards, "vector-shards")
    asked = blocks(queries, QUERY_ROWS, "block")[0].toDF("block", "query_ids", "queries")

    def each(batches):
        """Rows with the index of their shard; one index is held, as the rows of a shard follow each other."""
        number, held = None, None
        for rows in batches:
            for row in rows.to_pylist():
                if held is None or row["shard"] != number:
                    number, held = row["shard"], index(Block.of(row["ids"], row["vectors"]))
                asked = Block.of(row["query_ids"], row["queries"])
                floors = row.get("floors")
                yield row, asked, search(held, asked, np.full(len(asked.ids), -np.inf) if floors is None else np.frombuffer(floors, np.float64))

    def floored(batches):
        for row, _, best in each(batches):
            yield batch(block=pa.array([row["block"]], pa.int32()), query_ids=pa.array([row["query_ids"]], pa.binary()), queries=pa.array([row["queries"]], pa.binary()), floors=pa.array([best.thresholds().tobytes()], pa.binary()))

    def found(batches):
        for _, asked, best in each(batches):
            place, ids, scores = best.triples()
            yield batch(query_id=asked.ids[place], vec_id=ids, score=scores.astype(np.int64 if score == "long" else np.float64))

    columns = "block int, query_ids binary, queries binary"
    if pilot and n_shards > 1:
        one = F.broadcast(shards.orderBy("shard").limit(1))  # one row, of SHARD_ROWS vectors or so
        asked = asked.crossJoin(one).mapInArrow(floored, f"{columns}, floors binary")
    asked = checkpointed(asked, "query-blocks")
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).repartition(min(4096, 4 * n_shards), "shard")
    pairs = shards.repartition(min(4096, 4 * n_shards), "shard").hint("merge").join(sent.hint("merge"), "shard")
    got = pairs.mapInArrow(found, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
