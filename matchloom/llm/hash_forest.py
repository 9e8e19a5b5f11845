"""Approximate nearest neighbours by cosine with a forest of hash-prefix arrays.

Each tree of a shard is a sorted array of long hash strings, one bit for the side of each of BITS random
planes.  A query descends each tree to its longest matching prefixes, and then all trees ascend
together, one bit at a time, so that the ranges of equal prefixes widen, until they hold SHARE of the shard's
rows together.  All rows are indexed, each shard's forest is built once, and cosines are computed for the rows reached alone, exactly on the original
vectors.

SHARE and TREES trade recall for work: the more trees, the longer the prefixes that hold a share, and the better the
rows in it.  The tests measure recall against brute force (at least 0.9 is asked for; the README has the figures).

Defined results: vectors that are null, all zero, or hold null or non-finite components take no part;
missing trailing components count as 0; of rows that share an id see `searched`; a shard with fewer
rows than are asked for gives all; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import Best, Block, resized, searched, usable

TREES = 208
BITS = 32
SHARE = 0.25


def planes(dims: int, tree: int) -> np.ndarray:
    return np.random.default_rng([dims, tree]).normal(size=(dims, BITS)).astype(np.float32)


def hash_strings(vectors: np.ndarray, tree: int) -> np.ndarray:
    """A row's bits, the first plane's on top."""
    sides = np.packbits(vectors @ planes(vectors.shape[1], tree) > 0, axis=1)
    return np.ascontiguousarray(sides).view(">u4").reshape(-1).astype(np.uint32)


class Forest:
    """`strings`: of each tree, ascending; `order`: the rows they are of; and the rows' lengths."""

    def __init__(self, rows: Block, trees: int = TREES):
        self.rows, self.n, self.lengths = rows, len(rows.ids), np.sqrt((rows.vectors * rows.vectors).sum(1))
        units = (rows.vectors / self.lengths[:, None]).astype(np.float32)
        strings = [hash_strings(units, tree) for tree in range(trees)]
        order = [np.argsort(s, kind="stable") for s in strings]
        self.strings, self.order = [s[o] for s, o in zip(strings, order, strict=True)], np.concatenate(order) if trees else np.zeros(0, np.int64)

    def reached(self, queries: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For each query, the rows in its prefixes' ranges: the longest prefixes first, all trees one bit shorter at a time, until there are `wanted`."""
        asked = [hash_strings(queries, tree) for tree in range(len(self.strings))]
        first = np.arange(len(self.strings)) * self.n
        out, open_ = [np.zeros(0, np.int64)] * len(queries), np.arange(len(queries))
        # What lies deeper than the first level lies within the ranges of that level.
        for level in range(min(BITS, int(np.log2(max(self.n, 1))) + 4), -1, -1):
            rest = np.uint32(2 ** (BITS - level) - 1)
            low = np.stack([np.searchsorted(s, a[open_] & ~rest, "left") for s, a in zip(self.strings, asked, strict=True)], axis=1)
            size = np.stack([np.searchsorted(s, a[open_] | rest, "right") for s, a in zip(self.strings, asked, strict=True)], axis=1) - low
            closed = np.zeros(len(open_), bool)
            for k in np.flatnonzero(size.sum(axis=1) >= wanted):
                ends = np.cumsum(size[k])
                places = np.arange(ends[-1]) + np.repeat(first + low[k] - ends + size[k], size[k])
                seen = np.zeros(self.n, bool)
                seen[self.order[places]] = True
                rows = np.flatnonzero(seen)
                if len(rows) >= wanted:
                    out[open_[k]], closed[k] = rows, True
            open_ = open_[~closed]
            if not len(open_):
                break
        return out


def nearest_in(forest: Forest, queries: Block, floors: np.ndarray, top: int, share: float = SHARE, counts: dict | None = None) -> Best:
    """The nearest `top` of the rows that the forest reaches.  `counts` gets the rows scored."""
    best = Best(floors, top)
    if not forest.n:
        return best
    dims = forest.rows.vectors.shape[1]
    lengths, asked = np.sqrt((queries.vectors * queries.vectors).sum(1)), resized(queries.vectors, dims)
    reached = forest.reached((asked / lengths[:, None]).astype(np.float32), min(forest.n, max(top + 1, int(np.ceil(share * forest.n)))))
    for k, rows in enumerate(reached):
        if counts is not None:
            counts["scored"] = counts.get("scored", 0) + len(rows)
        rows = rows[forest.rows.ids[rows] != queries.ids[k]]
        if not len(rows):
            continue
        near = (forest.rows.vectors[rows] @ asked[k]) / forest.lengths[rows]
        # The product's last bits depend on a row's place; what may be among the best is computed again row by row.
        if len(rows) > top:
            kth = np.partition(near, len(near) - top)[len(near) - top]
            rows = rows[near >= kth - 1e-9 * lengths[k]]
        best.add(k, (forest.rows.vectors[rows] * asked[k]).sum(1) / (lengths[k] * forest.lengths[rows]), forest.rows.ids[rows])
    return best


def nearest_neighbours(df: DataFrame, top: int = 5, every: int = 50, trees: int = TREES, share: float = SHARE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (cosine), for the rows whose id is a multiple of `every`."""
    vectors = usable(df, id_col, vector_col).where(F.exists("vector", lambda x: x != 0))
    return searched(vectors, every, lambda rows: Forest(rows, trees), lambda forest, queries, floors: nearest_in(forest, queries, floors, top, share), top, "double")
