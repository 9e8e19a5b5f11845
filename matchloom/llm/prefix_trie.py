"""Prefix tries of conversations: succinct level-order tries by prefix shard, heavy upper levels merged by Spark.

A node is a distinct run of initial turns (role, text), named by two 64-bit hashes; the root is the empty run.  Upper
nodes, those that more than HEAVY conversations start with, and the root, are kept out of the shards: they are as few as their
conversations are many.  What hangs below them are units of at most HEAVY conversations, dealt to shards by the hash of their
top node, so that a turn that a third of all conversations start with is spread over many shards.

A shard numbers its nodes in level order under a super-root and keeps a LOUDS bitvector (for each node a 1 for each child,
then a 0) and label arrays.  Parents and degrees are read from the bits by rank and select, and numbers are
rolled up from the last level to the first by add.at.  For upper nodes, tops of units and the upper nodes themselves
send what they add to their ancestors, which are on the path of a conversation that holds them; the sums combine before their shuffle.

Before that each conversation may borrow its beginning: see `rebuilt`.  Texts are hashed where they are read and never shuffled.
One conversation's turns are ordered by one task (sorted, so it may spill), and lie in one shard.

Defined results: null roles and texts are empty; turns are ordered by number (null first), then role, then
sha256 of the text, and repeated rows are turns each; rows with a null id belong to no conversation and
are left out; further columns are ignored; an empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpointed, counted

#: A conversation borrows from the one at the last multiple of STRIDE at most MOST_BORROWED turns.
STRIDE, MOST_BORROWED = 5, 8
#: Conversations of a unit, at most.
HEAVY = 256
#: About how many rows of paths a shard holds.
SHARD_ROWS = 1 << 16
#: Bytes of ids that are joined at a time.
PIECE_BYTES = 1 << 16
NO_ENDS = hashlib.sha256(b"").hexdigest()


def hashed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), one, two (hashes of role and text), size (bytes of the text)."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), *[F.xxhash64(F.lit(k), "role", "text").alias(n) for k, n in ((1, "one"), (2, "two"))], F.octet_length("text").cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return rows.withColumn("place", F.row_number().over(order)).select("conv_id", "place", "one", "two", "size")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations with the first h turns of the one at the last multiple of STRIDE in place of their own; h is their id's crc32 modulo MOST_BORROWED + 1.

    Adds a row at place 0 for each conversation.  If the other has fewer turns all of them are taken, and none if there is no such conversation.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_BORROWED + 1)).cast("int")
    begins = turns.where("place = 1").select("conv_id", h.alias("_h"), (F.col("conv_id") - F.col("conv_id") % STRIDE).alias("_from"))
    lent = turns.where(F.col("place") <= MOST_BORROWED).withColumnRenamed("conv_id", "_from")
    borrowed = begins.where("_from <> conv_id AND _h > 0").join(lent, "_from").where("place <= _h").select("conv_id", "place", "one", "two", "size")
    own = turns.where((F.col("conv_id") % STRIDE == 0) | (F.col("place") > h))
    roots = begins.select("conv_id", F.lit(0).alias("place"), F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"), F.lit(0).cast("long").alias("size"))
    return borrowed.unionByName(own).unionByName(roots)


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, node and up (one, two), size, end (the last turn) of turns with places, those at 0 being the root."""
    order = Window.partitionBy("conv_id").orderBy("place")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("depth", F.row_number().over(order) - 1)
    rows = rows.withColumn("node", F.struct(*[F.bit_xor(F.xxhash64(F.lit(k), "depth", "one", "two")).over(so_far).alias(n) for k, n in ((3, "one"), (4, "two"))]))
    return rows.select("conv_id", "depth", "node", F.lag("node").over(order).alias("up"), "size", F.lead("depth").over(order).isNull().alias("end"))


@dataclass
class Louds:
    """A trie in level order under a super-root, node 0: `bits` holds for each node a 1 for each child, then a 0."""

    bits: np.ndarray
    n: int

    @classmethod
    def of(cls, degrees: np.ndarray) -> Louds:
        n = len(degrees)
        ones = np.ones(2 * n - 1, np.uint8)
        ones[np.cumsum(degrees) + np.arange(n)] = 0
        return cls(np.packbits(ones), n)

    def _ones(self) -> np.ndarray:
        return np.unpackbits(self.bits, count=2 * self.n - 1)

    def parents(self) -> np.ndarray:
        """Of each node but the super-root: the zeros before the 1 that stands for it."""
        ones = self._ones()
        return np.cumsum(ones == 0)[ones == 1]

    def degrees(self) -> np.ndarray:
        """The ones between each node's zero and the one before it."""
        return np.diff(np.flatnonzero(self._ones() == 0), prepend=-1) - 1


@dataclass
class Trie:
    """A shard's trie: bits, labels (one, two, size), where levels start, and the node of each row of paths."""

    louds: Louds
    one: np.ndarray
    two: np.ndarray
    size: np.ndarray
    levels: list[int]
    node_of: np.ndarray

    @classmethod
    def of(cls, conv: np.ndarray, one: np.ndarray, two: np.ndarray, size: np.ndarray) -> Trie:
        """From rows sorted by conversation and depth, each conversation's first row a top."""
        n = len(conv)
        starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])[:n])
        level = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
        by_level = np.argsort(level, kind="stable")
        bounds = np.searchsorted(level[by_level], np.arange(int(level.max(initial=-1)) + 2))
        node_of, parents, firsts, levels = np.zeros(n, np.int64), [], [], [1]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            rows = by_level[a:b]
            up = node_of[rows - 1] if a else np.zeros(len(rows), np.int64)
            order = np.lexsort((two[rows], one[rows], up))
            rows, up = rows[order], up[order]
            new = np.append(True, (up[1:] != up[:-1]) | (one[rows[1:]] != one[rows[:-1]]) | (two[rows[1:]] != two[rows[:-1]]))[: len(rows)]
            node_of[rows] = levels[-1] + np.cumsum(new) - 1
            parents.append(up[new])
            firsts.append(rows[new])
            levels.append(levels[-1] + int(new.sum()))
        first = np.concatenate([np.zeros(0, np.int64), *firsts])
        degrees = np.bincount(np.concatenate([np.zeros(0, np.int64), *parents]), minlength=levels[-1])
        zero = np.zeros(1, np.int64)
        return cls(Louds.of(degrees), *[np.concatenate([zero, x[first]]) for x in (one, two, size)], levels, node_of)

    def rolled_up(self, conv: np.ndarray) -> dict[str, np.ndarray]:
        """Of all nodes but the super-root: parent, conv_id, n_convs, n_children, n_leaves, saved_tokens."""
        parent = np.concatenate([[0], self.louds.parents()])
        degrees = self.louds.degrees()
        times = np.bincount(self.node_of, minlength=self.louds.n)
        least = np.full(self.louds.n, np.iinfo(np.int64).max)
        np.minimum.at(least, self.node_of, conv)
        leaves, saved = (degrees == 0).astype(np.int64), (times - 1) * self.size
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1], strict=True):
            np.add.at(leaves, parent[a:b], leaves[a:b])
            np.add.at(saved, parent[a:b], saved[a:b])
        return {k: v[1:] for k, v in dict(parent=parent, conv_id=least, n_convs=times, n_children=degrees, n_leaves=leaves, saved_tokens=saved).items()}


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_TOP = "struct<one: long, two: long>"


def _sorted(rows: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A shard's columns by conversation and depth, and the order they were put in."""
    plain = {c: rows.column(c).to_numpy() for c in ("conv_id", "depth", "one", "two", "size", "end")}
    order = np.lexsort((plain["depth"], plain["conv_id"]))
    return {c: x[order] for c, x in plain.items()}, order


def _ends(node: np.ndarray, conv: np.ndarray, n: int) -> list[str]:
    """Of nodes 1 to n - 1, the digest of the conversations that end there."""
    out = [NO_ENDS] * (n - 1)
    order = np.lexsort((conv, node))
    node, conv = node[order], conv[order]
    starts = np.flatnonzero(np.append(True, node[1:] != node[:-1])[: len(node)])
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(node)).tolist() if len(starts) else [], strict=True):
        out[int(node[a]) - 1] = hashlib.sha256(",".join(map(str, conv[a:b].tolist())).encode()).hexdigest()
    return out


def shard_nodes(rows: pa.Table) -> pa.Table:
    """The nodes of a shard, with `top` and `up` (the names of a unit's top and of the upper node above it; null elsewhere)."""
    of, order = _sorted(rows)
    trie = Trie.of(of["conv_id"], of["one"], of["two"], of["size"])
    found = trie.rolled_up(of["conv_id"])
    first = np.full(trie.louds.n, len(order))
    np.minimum.at(first, trie.node_of, np.arange(len(order)))
    first, top = first[1:], found["parent"] == 0
    above = np.concatenate([[0], found["conv_id"]])[found["parent"]]
    at = pa.array(np.where(top, order[first], -1))
    at = pc.if_else(pc.less(at, 0), None, at)
    end = of["end"].astype(bool)
    return pa.table({
        "conv_id": found["conv_id"], "depth": of["depth"][first].astype(np.int64), "parent_conv_id": pa.array(above, mask=top), "n_convs": found["n_convs"], "n_children": found["n_children"],
        "n_leaves": found["n_leaves"], "saved_tokens": found["saved_tokens"], "ends_sha256": _ends(trie.node_of[end], of["conv_id"][end], trie.louds.n), "up": rows.column("up").combine_chunks().take(at),
    })


def shard_trie(rows: pa.Table) -> pa.Table:
    """A shard's trie as it is stored: LOUDS bits and label arrays in level order."""
    of, _ = _sorted(rows)
    trie = Trie.of(of["conv_id"], of["one"], of["two"], of["size"])
    stored = {"one": trie.one[1:], "two": trie.two[1:], "size": trie.size[1:]}
    return pa.table({"shard": rows.column("shard")[:1], "nodes": [trie.louds.n - 1], "bits": [trie.louds.bits.tobytes()], **{k: pa.array([v.tobytes()], pa.binary()) for k, v in stored.items()}})


def divided(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(all paths, upper nodes, the paths' rows below upper nodes with their shard)."""
    rows = checkpointed(paths(rebuilt(checkpointed(hashed_turns(conversations), "trie-turns"))), "trie-paths")
    upper = rows.groupBy("node").agg(F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("conv_id", "depth", "up", "size")]).where((F.col("n_convs") > HEAVY) | (F.col("depth") == 0))
    upper = checkpointed(upper, "trie-upper")
    n_shards = max(1, -(-rows.count() // SHARD_ROWS))
    below = rows.join(counted(upper.select("node")), "node", "left_anti")
    top = F.min(F.struct("depth", "node")).over(Window.partitionBy("conv_id"))["node"]
    below = below.withColumn("shard", F.pmod(F.xxhash64(top), F.lit(n_shards)).cast("int"))
    return rows, upper, below.select("shard", "conv_id", "depth", F.col("node.one").alias("one"), F.col("node.two").alias("two"), "up", "size", "end")


def stored_tries(conversations: DataFrame) -> DataFrame:
    """shard, nodes, bits, one, two, size: the tries below the upper nodes, as LOUDS bits and label arrays."""
    return divided(conversations)[2].groupBy("shard").applyInArrow(shard_trie, "shard int, nodes long, bits binary, one binary, two binary, size binary")


def ends_digests(ended: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """node, ends_sha256: the digest of each node's conversations (node, conv_id), ascending, however many.

    Ids are joined in sorted ranges by many tasks; the one that hashes a node reads pieces in order and holds one at a time.
    """

    def joined(batches):
        node, held, size = None, [], 0

        def piece():
            return batch(node=pa.array([node], pa.struct([("one", pa.int64()), ("two", pa.int64())])), first=pa.array([held[0]], pa.int64()), ids=pa.array([",".join(map(str, held))]))

        for rows in batches:
            for row in rows.to_pylist():
                if held and (row["node"] != node or size > piece_bytes):
                    yield piece()
                    held, size = [], 0
                node = row["node"]
                held.append(row["conv_id"])
                size += 20
        if held:
            yield piece()

    def digested(batches):
        node, state = None, None

        def done():
            return batch(node=pa.array([node], pa.struct([("one", pa.int64()), ("two", pa.int64())])), ends_sha256=[state.hexdigest()])

        for rows in batches:
            for row in rows.to_pylist():
                if state is not None and row["node"] != node:
                    yield done()
                    state = None
                if state is None:
                    node, state = row["node"], hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
        if state is not None:
            yield done()

    pieces = ended.select("node", "conv_id").repartitionByRange("node.one", "node.two", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(joined, f"node {_TOP}, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digested, f"node {_TOP}, ends_sha256 string")


def trie_nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the rebuilt conversations."""
    rows, upper, below = divided(conversations)
    lower = checkpointed(below.groupBy("shard").applyInArrow(shard_nodes, f"{_NODE}, up {_TOP}"), "trie-lower")
    tops = lower.where("up IS NOT NULL")
    children = tops.select("up").unionByName(upper.where("up IS NOT NULL").select("up")).groupBy("up").agg(F.count("*").alias("n_children")).withColumnRenamed("up", "node")
    upper = checkpointed(upper.join(counted(children), "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-children")
    # What a top or an upper node adds goes to the upper nodes on the path of its least conversation.
    added = tops.select("conv_id", (F.col("depth") - 1).alias("_to"), "n_leaves", "saved_tokens").unionByName(
        upper.select("conv_id", F.col("depth").cast("long").alias("_to"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    )
    added = added.groupBy("conv_id", "_to").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    sums = rows.select("conv_id", "depth", "node").join(counted(added), "conv_id").where("depth <= _to").groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens")])
    ended = rows.where("end").select("node", "conv_id").join(counted(upper.select("node")), "node", "left_semi")
    names = counted(upper.select(F.col("node").alias("up"), F.col("conv_id").alias("_above")))
    whole = upper.join(sums, "node").join(ends_digests(ended), "node", "left").join(names, "up", "left")
    columns = ["conv_id", F.col("depth").cast("long").alias("depth"), F.coalesce("parent_conv_id", "_above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")]
    return whole.withColumn("parent_conv_id", F.lit(None).cast("long")).select(*columns).unionByName(lower.join(names, "up", "left").select(*columns))
