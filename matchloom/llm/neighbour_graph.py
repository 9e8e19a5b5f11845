"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors form one node.  Lists begin with what sorted runs of hash strings give: nodes are sorted by the
sides of random planes, salted so that runs of equal strings split, and nodes of one block of BLOCK rows are compared, TREES times.  In each round
a node's neighbours, and the nodes that have it as one, meet in its task: pairs with a member that is new there are compared by 8-bit codes of their vectors, and
those that beat the last place of a list go to it.  Rounds end when few places change.

A list all of whose members may reach the threshold is saturated, and is enlarged fourfold, up to LONGEST; its
rounds go on.  Components that still hold saturated lists are compared whole: their
members are dealt to blocks, and pairs of blocks whose centres and radii settle it are counted without looking at members;
others are multiplied.  So copies in groups of any size get all their links, and no list of pairs is made.

Codes give bounds: what they leave off a vector is known, so every pair that may reach the threshold is computed in double
precision from the original vectors, and no other pair is a link.

The recall of links is audited: AUDITED nodes, drawn by hash, are compared with all nodes.  While it is below TARGET, lists get
further trees and rounds, at most PASSES times; `Graph.recall` says what was reached.

Defined results: vectors that are null, all zero, or hold null or non-finite components link with nothing;
missing trailing components count as 0; rows that share an id are vectors each; a null id comes after all others,
and a component of null ids alone has a null component_id; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpointed, counted
from .components import components
from .vector_blocks import usable

THRESHOLD = 0.95
#: Neighbours of a node, and at most so many once saturated lists are enlarged.
LIST, LONGEST = 8, 32
TREES, BLOCK, BITS = 4, 128, 32
#: Rounds end when fewer than this share of all places change, or after ROUNDS.
STILL, ROUNDS = 0.02, 6
#: Members of a block of a component that is compared whole.
MEMBERS = 2048
AUDITED, TARGET, PASSES = 512, 0.95, 4
#: What rounding may do to a product of codes.
SLACK = 1e-5


@dataclass
class Graph:
    """nodes (node, vec_id, times, one, two, length), degrees (node, links), labels (node, label), and the audited recall of links."""

    nodes: DataFrame
    degrees: DataFrame
    labels: DataFrame
    recall: float


def units(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors in double precision of a column of lists; what is missing is 0."""
    lists = column if isinstance(column, pa.Array) else column.combine_chunks()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dims))
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy(zero_copy_only=False)
    out /= np.abs(out).max(axis=1, initial=1e-300)[:, None]  # so that no square overflows
    return out / np.sqrt((out * out).sum(axis=1))[:, None]


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """8-bit codes of unit vectors, the size of a step of each, and the length of what the codes leave off."""
    step = np.abs(vectors).max(axis=1, initial=0) / 127
    codes = np.rint(vectors / step[:, None]).astype(np.int8)
    left = vectors - codes * step[:, None]
    return codes, step, np.sqrt((left * left).sum(axis=1))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _read(column: pa.Array, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def graph_nodes(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Distinct vectors: node, vec_id (the least), times, one and two (hashes of the vector), vector, code, step, left."""
    rows = usable(df.where(F.col(vector_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("vec_id"), F.col(vector_col).alias("vector")), "vec_id", "vector")
    rows = rows.where(F.exists("vector", lambda x: x != 0)).select("vec_id", *_names("vector"), "vector")
    nodes = rows.groupBy("one", "two").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("times"), F.first("vector").alias("vector"))
    return checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()), "graph-nodes")


def _names(vector: str):
    return [F.xxhash64(F.lit(k), vector).alias(n) for k, n in ((5, "one"), (6, "two"))]


def with_codes(nodes: DataFrame, dims: int) -> DataFrame:
    """node, code, step, left."""

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                codes, step, left = coded(units(rows.column("vector"), dims))
                yield batch(node=rows.column("node"), code=_binary(codes), step=step, left=left)

    return nodes.select("node", "vector").mapInArrow(run, "node long, code binary, step double, left double")


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best entries of each row."""
    k = min(k, scores.shape[1])
    columns = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.repeat(np.arange(len(scores)), k), columns.ravel()


def tree_neighbours(codes: DataFrame, dims: int, first_tree: int) -> DataFrame:
    """node, other, score, sure: the LIST nearest of each node's block in each of TREES sorted runs; `score` by codes, `sure` the least it can be off."""

    def hashed(batches):
        for rows in batches:
            if rows.num_rows:
                vectors = _read(rows.column("code"), np.int8).astype(np.float32)
                for tree in range(first_tree, first_tree + TREES):
                    planes = np.random.default_rng([dims, tree]).normal(size=(dims, BITS)).astype(np.float32)
                    sides = np.packbits(vectors @ planes > 0, axis=1).view(">u4").reshape(-1).astype(np.int64)
                    yield batch(tree=np.full(len(sides), tree), sides=sides, **{c: rows.column(c) for c in ("node", "code", "step", "left")})

    def compared(batches):
        held: list[pa.RecordBatch] = []

        def blocks(rows: pa.Table, whole: bool):
            tree, at = rows.column("tree").to_numpy(), 0
            while at < len(tree):
                stop = min(at + BLOCK, int(np.searchsorted(tree, tree[at], "right")))
                if stop == len(tree) and stop - at < BLOCK and not whole:
                    break
                part = rows.slice(at, stop - at)
                node, left = part.column("node").to_numpy(), part.column("left").to_numpy()
                vectors = _read(part.column("code"), np.int8) * part.column("step").to_numpy().astype(np.float32)[:, None]
                scores = vectors @ vectors.T
                np.fill_diagonal(scores, -2)
                a, b = _best(scores, LIST)
                keep = a != b
                a, b = a[keep], b[keep]
                yield batch(node=node[a], other=node[b], score=scores[a, b].astype(np.float64), sure=left[a] + left[b] + left[a] * left[b])
                at = stop
            held[:] = rows.slice(at).to_batches()

        for rows in batches:
            held.append(rows)
            yield from blocks(pa.Table.from_batches(held), False)
        if held:
            yield from blocks(pa.Table.from_batches(held), True)

    rows = codes.mapInArrow(hashed, "tree long, sides long, node long, code binary, step double, left double")
    order = ["tree", "sides", F.xxhash64("node")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compared, "node long, other long, score double, sure double")


def best_lists(found: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """node, other, score, sure, new: of candidates (and lists, `new` false) the best LIST of each node, or as many as `sizes` (node, size) says."""
    once = found.repartition("node").groupBy("node", "other").agg(*[F.max(c).alias(c) for c in ("score", "sure")], F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))
    placed = once.withColumn("rank", rank).where(F.col("rank") <= (LIST if sizes is None else LONGEST))
    if sizes is not None:
        placed = placed.join(counted(sizes), "node", "left").where(F.col("rank") <= F.coalesce("size", F.lit(LIST))).drop("size")
    return placed.drop("rank")


def local_joins(lists: DataFrame, codes: DataFrame, sizes: DataFrame | None) -> DataFrame:
    """Candidates (node, other, score, sure, new) from the neighbours that meet at each node, in both directions; with `sizes`, at its nodes alone.

    Of the nodes that have a node as a neighbour, as many take part as its own list has places: new ones first, then by hash.
    """
    columns = ["at", "member", "new"]
    forth = lists.select(F.col("node").alias("at"), F.col("other").alias("member"), "new")
    back = lists.select(F.col("other").alias("at"), F.col("node").alias("member"), "new")
    most = LIST
    if sizes is not None:
        here = counted(sizes.select(F.col("node").alias("at")))
        forth, back, most = forth.join(here, "at", "left_semi"), back.join(here, "at", "left_semi"), LONGEST
    rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("new"), F.xxhash64("member")))
    back = back.withColumn("_rank", rank).where(F.col("_rank") <= most).select(columns)
    # A full list's last place is what a candidate must beat.
    full = F.count("*") >= (F.first("_size") if sizes is not None else LIST)
    own = lists.join(counted(sizes.withColumnRenamed("size", "_size")), "node", "left").withColumn("_size", F.coalesce("_size", F.lit(LIST))) if sizes is not None else lists
    floors = own.groupBy("node").agg(F.when(full, F.min("score")).otherwise(-2.0).alias("floor"))
    members = codes.join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0))).withColumnRenamed("node", "member")
    met = forth.unionByName(back).groupBy("at", "member").agg(F.max("new").alias("new")).join(members, "member")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(rows: pa.Table):
            at = rows.column("at").to_numpy()
            member, new, step, left, floor = (rows.column(c).to_numpy() for c in ("member", "new", "step", "left", "floor"))
            vectors = _read(rows.column("code").combine_chunks(), np.int8) * step.astype(np.float32)[:, None]
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            out = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(at)], strict=True):
                if b - a < 2 or not new[a:b].any():
                    continue
                scores = vectors[a:b] @ vectors[a:b].T
                wanted = (new[a:b][:, None] | new[a:b]) & (scores > floor[a:b][:, None])
                np.fill_diagonal(wanted, False)
                i, j = np.nonzero(wanted)
                out.append((i + a, j + a, scores[i, j]))
            if out:
                i, j, score = (np.concatenate([o[k] for o in out]) for k in range(3))
                yield batch(node=member[i], other=member[j], score=score.astype(np.float64), sure=left[i] + left[j] + left[i] * left[j], new=np.ones(len(i), bool))

        for rows in batches:
            if not rows.num_rows:
                continue
            whole = pa.Table.from_batches([*held, rows])
            at = whole.column("at")
            n = int(np.flatnonzero(at.to_numpy() != at[-1].as_py())[-1]) + 1 if at[0].as_py() != at[-1].as_py() else 0
            if n:
                yield from groups(whole.slice(0, n))
            held = whole.slice(n).to_batches()
        if held:
            yield from groups(pa.Table.from_batches(held))

    rows = met.select("at", "member", "new", "code", "step", "left", "floor").repartition("at").sortWithinPartitions("at", "member")
    return rows.mapInArrow(run, "node long, other long, score double, sure double, new boolean")


def descended(lists: DataFrame, codes: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The lists after rounds of local joins."""
    places = lists.count()
    for _ in range(ROUNDS):
        old = lists.withColumn("new", F.lit(False))
        lists = checkpointed(best_lists(old.unionByName(local_joins(lists, codes, sizes)), sizes), "graph-lists")
        changed = lists.where("new").count()
        if changed <= STILL * max(places, 1):
            break
        places = max(places, changed)
    return lists


def saturated(lists: DataFrame, size: int) -> DataFrame:
    """node: those with `size` or more neighbours, all of which may reach the threshold."""
    least = lists.groupBy("node").agg(F.min(F.col("score") + F.col("sure")).alias("_least"), F.count("*").alias("_n"))
    return least.where((F.col("_n") >= size) & (F.col("_least") >= THRESHOLD - SLACK)).select("node")


def links_of(lists: DataFrame, nodes: DataFrame, dims: int, threshold: float) -> DataFrame:
    """a, b (a < b): pairs of the lists whose cosine, in double precision, reaches the threshold."""
    pairs = lists.where(F.col("score") + F.col("sure") >= threshold - SLACK).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    both = pairs.join(nodes.select(F.col("node").alias("a"), F.col("vector").alias("_p")), "a").join(nodes.select(F.col("node").alias("b"), F.col("vector").alias("_q")), "b")

    def run(batches):
        for rows in batches:
            if rows.num_rows:
                near = pa.array((units(rows.column("_p"), dims) * units(rows.column("_q"), dims)).sum(axis=1) >= threshold)
                yield batch(a=rows.column("a").filter(near), b=rows.column("b").filter(near))

    return both.mapInArrow(run, "a long, b long")


def whole_degrees(members: DataFrame, dims: int, threshold: float) -> DataFrame:
    """node, links: the exact number of vectors that each member (label, node, times, vector) is linked with in its component."""
    counts = members.groupBy("label").agg(F.count("*").alias("_n"))
    dealt = members.join(counted(counts), "label").withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("_n") / MEMBERS)).cast("int"))

    def packed(rows: pa.Table) -> pa.Table:
        vectors = units(rows.column("vector"), dims)
        centre = vectors.sum(axis=0)
        centre /= max(float(np.sqrt((centre * centre).sum())), 1e-300)
        radius = float(np.arccos(np.clip(vectors @ centre, -1, 1)).max())
        ids, times = rows.column("node").to_numpy(), rows.column("times").to_numpy()
        return pa.table({
            "label": rows.column("label")[:1], "block": rows.column("block")[:1], "all": [int(times.sum())], "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [radius],
            "ids": pa.array([ids.tobytes()], pa.binary()), "times": pa.array([times.tobytes()], pa.binary()), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        })

    blocks = checkpointed(dealt.select("label", "block", "node", "times", "vector").groupBy("label", "block").applyInArrow(packed, "label long, block int, all long, centre binary, radius double, ids binary, times binary, vectors binary"), "graph-blocks")
    limit = float(np.arccos(threshold))

    def judged(batches):
        """A pair of blocks is `all` linked, or to be multiplied; else none of it is."""
        for rows in batches:
            if rows.num_rows:
                p, q = (_read(rows.column(c), np.float64) for c in ("centre", "_centre"))
                apart = np.arccos(np.clip((p * q).sum(axis=1), -1, 1))
                reach = rows.column("radius").to_numpy() + rows.column("_radius").to_numpy()
                sure, maybe = apart + reach < limit - 1e-6, apart - reach <= limit + 1e-6
                sure &= rows.column("block").to_numpy() != rows.column("_block").to_numpy()
                sure |= (rows.column("block").to_numpy() == rows.column("_block").to_numpy()) & (reach < limit - 1e-6)
                keep = pa.array(maybe | sure)
                yield batch(**{c: rows.column(c).filter(keep) for c in ("label", "block", "_block", "_all")}, sure=pa.array(sure).filter(keep))

    heads = blocks.select("label", "block", "all", "centre", "radius")
    met = heads.join(heads.select("label", *[F.col(c).alias(f"_{c}") for c in ("block", "all", "centre", "radius")]), "label")
    met = checkpointed(met.mapInArrow(judged, "label long, block int, _block int, _all long, sure boolean"), "graph-met")

    def counted_whole(batches):
        for rows in batches:
            for row in rows.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                yield batch(node=ids, links=np.full(len(ids), row["links"]))

    def multiplied(batches):
        for rows in batches:
            for row in rows.to_pylist():
                ids, times = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["_times"], np.int64)
                p, q = (np.frombuffer(row[c], np.float64).reshape(-1, dims) for c in ("vectors", "_vectors"))
                links = np.concatenate([((p[k : k + 256] @ q.T) >= threshold) @ times for k in range(0, len(p), 256)])
                yield batch(node=ids, links=links.astype(np.int64))

    out = "node long, links long"
    surely = met.where("sure").groupBy("label", "block").agg(F.sum("_all").alias("links"))
    surely = blocks.select("label", "block", "ids").join(surely, ["label", "block"]).mapInArrow(counted_whole, out)
    pairs = met.where("NOT sure").select("label", "block", "_block").join(blocks.select("label", "block", "ids", "vectors"), ["label", "block"])
    pairs = pairs.join(blocks.select("label", F.col("block").alias("_block"), F.col("times").alias("_times"), F.col("vectors").alias("_vectors")), ["label", "_block"]).mapInArrow(multiplied, out)
    # A vector is no link of its own.
    return surely.unionByName(pairs).groupBy("node").agg((F.sum("links") - 1).alias("links"))


def audit(nodes: DataFrame, degrees: DataFrame, dims: int, threshold: float) -> float:
    """The share of the links of AUDITED nodes, drawn by hash, that `degrees` (node, links) has."""
    drawn = nodes.orderBy(F.xxhash64("one", "two"), "node").limit(AUDITED).select("node", "times", "vector").toArrow()  # AUDITED rows
    if not drawn.num_rows:
        return 1.0
    asked, ids = units(drawn.column("vector"), dims), drawn.column("node").to_numpy()

    def run(batches):
        total = np.zeros(len(ids), np.int64)
        for rows in batches:
            if rows.num_rows:
                times = rows.column("times").to_numpy()
                vectors = units(rows.column("vector"), dims)
                for k in range(0, len(vectors), 1024):
                    total += ((asked @ vectors[k : k + 1024].T) >= threshold) @ times[k : k + 1024]
        yield batch(node=ids, links=total)

    true = nodes.select("times", "vector").mapInArrow(run, "node long, links long").groupBy("node").agg((F.sum("links") - 1).alias("_true"))
    sums = true.join(degrees, "node", "left").agg(F.sum("_true").alias("all"), F.sum(F.least(F.coalesce("links", F.lit(0)), "_true")).alias("found")).first()
    return sums.found / sums.all if sums.all else 1.0


def neighbour_graph(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> Graph:
    """The links of all rows whose cosine reaches the threshold, as far as NN-descent finds them."""
    nodes = graph_nodes(df, id_col, vector_col)
    dims = max(1, nodes.agg(F.max(F.size("vector"))).first()[0] or 1)
    codes = checkpointed(with_codes(nodes, dims), "graph-codes")
    lists, reached = None, 0.0
    for n in range(PASSES):
        fresh = tree_neighbours(codes, dims, n * TREES).withColumn("new", F.lit(True))
        old = [lists.withColumn("new", F.lit(False))] if lists is not None else []
        lists = checkpointed(best_lists(old[0].unionByName(fresh) if old else fresh), "graph-lists")
        lists = descended(lists, codes)
        size, full = LIST, saturated(lists, LIST)
        while size < LONGEST:
            size *= 4
            sizes = checkpointed(full.withColumn("size", F.lit(size)), "graph-saturated")
            if sizes.isEmpty():
                break
            # All members meet anew at a node whose list has grown.
            lists = descended(lists.withColumn("new", F.lit(True)), codes, sizes)
            full = saturated(lists, size)
        links = checkpointed(links_of(lists, nodes, dims, threshold), "graph-links")
        labels = components(links)
        times = nodes.select("node", "times")
        own = times.where("times > 1").select("node", (F.col("times") - 1).alias("links"))
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        listed = both.join(times.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), F.col("times").alias("links")).unionByName(own).groupBy("node").agg(F.sum("links").alias("links"))
        crowded = labels.join(counted(full), "node", "left_semi").select("label").distinct()
        whole = checkpointed(labels.join(counted(crowded), "label", "left_semi"), "graph-crowded")
        exact = whole_degrees(whole.join(nodes.select("node", "times", "vector"), "node"), dims, threshold)
        degrees = checkpointed(listed.join(counted(whole.select("node")), "node", "left_anti").unionByName(exact), "graph-degrees")
        reached = audit(nodes, degrees, dims, threshold)
        if reached >= TARGET:
            break
    return Graph(nodes, degrees, labels, reached)


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id (the least vec_id that links reach, its own included), kept, for every row."""
    graph = neighbour_graph(df, threshold, id_col, vector_col)
    last = F.lit((1 << 63) - 1)
    labelled = graph.nodes.select("node", "vec_id", "one", "two").join(counted(graph.labels), "node", "left").join(counted(graph.degrees), "node", "left")
    known = checkpointed(labelled.where("label IS NOT NULL OR links > 0").withColumn("label", F.coalesce("label", "node")).select("label", "vec_id", "one", "two", F.coalesce("links", F.lit(0)).alias("links")), "graph-known")
    least = known.groupBy("label").agg(F.min("vec_id").alias("_component"))
    known = known.join(counted(least), "label").select("one", "two", "links", "_component")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")).select("vec_id", *_names("vector"))
    found = rows.join(counted(known), ["one", "two"], "left")
    component = F.coalesce(F.nullif("_component", last), "vec_id")
    return found.select("vec_id", F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
