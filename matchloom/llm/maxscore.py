"""Exact top-k search by MaxScore over integer vectors.

Dimensions are terms; a term's postings in a shard are its column of weights, with their largest and least one.
A query's terms are ordered by what they can add at most.  What a tail of that order can add together is bounded by the
sum of its terms' bounds, and by the lengths of the query's tail and of the longest row.  The longest tail that alone cannot
reach the query's threshold is non-essential.  The postings of the essential terms are traversed; a row stays competitive
while its sum and the bound of the terms not seen reach the threshold, and only for such rows the
non-essential terms are probed, a few at a time, those that can add most first.

A first pass over one shard gives each query the threshold with which it meets all shards; their results
are merged by score.  Sums of integers are exact in doubles below 2^53.

Defined results: vectors that are null or hold null or non-finite components take no part; missing
trailing components count as 0; of rows that share an id see `searched`; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from .vector_blocks import Best, Block, resized, searched, usable

#: Non-essential terms that are probed at a time.
PROBED = 4


class Postings:
    """A shard's weights by term, what a term can add at most, and the length of the longest row."""

    def __init__(self, rows: Block):
        self.ids = rows.ids
        exact = np.float32 if (np.abs(rows.vectors).max(initial=0) + 1) ** 2 * max(rows.vectors.shape[1], 1) < 1 << 23 else np.float64
        self.weights = np.ascontiguousarray(rows.vectors.T.astype(exact))
        self.most, self.least = rows.vectors.max(axis=0, initial=0), rows.vectors.min(axis=0, initial=0)
        self.length = float(np.sqrt((rows.vectors * rows.vectors).sum(axis=1).max(initial=0)))
        self.largest = float(np.abs(rows.vectors).max(initial=0))


def tail_bounds(weights: np.ndarray, bounds: np.ndarray, length: float) -> np.ndarray:
    """What the terms from each place on can add at most together, and 0 for none; a little more, for rounding."""
    added = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
    lengths = np.append(np.sqrt(np.cumsum((weights * weights)[::-1])[::-1]), 0.0) * length
    return np.minimum(added, lengths) * (1 + 1e-9)


def maxscore(postings: Postings, queries: Block, floors: np.ndarray, top: int, counts: dict | None = None) -> Best:
    """The best `top` of the shard for each query, those below its floor left out.  `counts` gets the postings traversed and probed, and the rows scored."""
    best = Best(floors, top)
    if not len(postings.ids):
        return best
    asked = resized(queries.vectors, len(postings.weights))
    kind = postings.weights.dtype if (np.abs(asked).sum(axis=1).max(initial=0) + 1) * (postings.largest + 1) < 1 << 24 else np.dtype(np.float64)
    for k, query in enumerate(asked):
        bounds = np.maximum(np.maximum(query * postings.most, query * postings.least), 0)
        order = np.argsort(-bounds, kind="stable")
        query = query[order]
        tails, threshold = tail_bounds(query, bounds[order], postings.length), best.threshold(k)
        essential = int(np.argmax(tails < threshold)) if tails[-1] < threshold else len(order)
        sums = query[:essential].astype(kind) @ postings.weights[order[:essential]].astype(kind, copy=False)
        rows = np.flatnonzero((sums >= threshold - tails[essential]) & (postings.ids != queries.ids[k]))
        sums, seen, probed = sums[rows], essential, 0
        while seen < len(order):
            here = slice(seen, seen + PROBED)
            sums = sums + query[here].astype(kind) @ postings.weights[order[here][:, None], rows].astype(kind, copy=False)
            probed += len(rows) * len(order[here])
            seen = min(seen + PROBED, len(order))
            keep = sums >= threshold - tails[seen]
            if not keep.all():
                rows, sums = rows[keep], sums[keep]
        best.add(k, sums.astype(np.float64), postings.ids[rows])
        if counts is not None:
            for name, n in (("traversed", essential * len(postings.ids)), ("probed", probed), ("scored", len(rows)), ("all", len(order) * len(postings.ids))):
                counts[name] = counts.get(name, 0) + n
    return best


def top_products(df: DataFrame, top: int = 20, every: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: inner products of floor(scale * x), for the rows whose id is a multiple of `every`."""

    def whole(block: Block) -> Block:
        return Block(block.ids, np.floor(scale * block.vectors))

    return searched(usable(df, id_col, vector_col), every, lambda rows: Postings(whole(rows)), lambda postings, queries, floors: maxscore(postings, whole(queries), floors, top), top, "long", pilot=True)
