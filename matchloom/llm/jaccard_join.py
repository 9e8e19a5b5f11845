"""N-gram Jaccard join: the size-aware heavy-light method, exact for a similarity of 4/5 or more.

Documents with equal shingle sets form one class, and classes are joined.  Light classes, of at
most `boundary` shingles, enumerate all their subsets of the sizes that a similar pair must share;
two light classes are candidates where a subset meets.  Heavy classes scan inverted lists: only of the
first shingles of each set in one order for all (frequent ones last), which similar sets must share.
Classes just below the boundary also stand in the lists, for pairs of a light and a heavy one.
The boundary has the least estimated cost over the sizes of a sample of documents.

Long lists aren't paired: all members are compared with the list's pivot, then those that are not
yet connected with it with a few more pivots of both kinds, twice, and last whoever is still apart with the members of other
components.  Links within one component can't change the result.  The shingles that a set has left from
a key on bound what it can share from there, so a pair counts only at keys where both have enough left: the
smaller set of a pair must meet the other in its first ninth, and lists that no set meets so early
pair nothing.  There the parities of both sets' members by hash range must also differ in few places, as each
shingle that only one set has changes one.  A bound on the intersection from counts by hash range leaves out most other pairs; the others are verified on whole sets, which are made
from the texts for the documents concerned alone.

Lists of rare shingles are short and are gathered by one shuffle; those of frequent ones, and subsets,
are summed before a shuffle and joined back, where AQE splits hot ones.

Order and boundary come from a sample of documents, but only cost depends on them, not the result.
Rows collected in the driver: the sample's frequent shingles, at most FREQUENT, and its counts by small size.

Defined results: null texts, empty ones and those without words have the empty set and link with
nothing; a null id stands before all others; rows that share an id are separate documents; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, batch, checkpointed, counted, fresh, in_arrow, texts
from .components import components
from .substring_dedup import text_key
from .words import Words, mix, rolling, signed, split_words

SHINGLE = 5
#: One document in so many gives the order of shingles and the boundary.
SAMPLED = 16
FREQUENT = 1 << 18
#: Sizes that may be light.
MOST_LIGHT = 14
#: Members of an inverted list that are paired; longer lists have pivots.
SHORT_LIST = 3
PIVOTS = 8
#: Ranges of hashes whose members are counted for the bound, each count up to 255.
PARTS = 256
MARKS = [f"mark{k}" for k in range(PARTS // 64)]
_NULL_ID = -(1 << 63)


def shared_least(a: int, b: int) -> int:
    """Shingles that sets of these sizes share at least if 5 * intersection >= 4 * union."""
    return -(-4 * (a + b) // 9)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


def subset_sizes(n: int, boundary: int) -> list[int]:
    """Sizes of the subsets that a light set of `n` enumerates: what it must share with each other light size."""
    sizes = range((4 * n + 4) // 5, min(boundary, 5 * n // 4) + 1)
    return sorted({shared_least(n, m) for m in sizes})


def in_lists(n: int, boundary: int) -> bool:
    return 5 * n >= 4 * (boundary + 1)


def best_boundary(counts: dict[int, int], length: float) -> int:
    """`counts`: documents by set size; `length`: of an inverted list, as a posting meets it."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, docs in counts.items():
            if n <= boundary:
                total += docs * sum(comb(n, c) for c in subset_sizes(n, boundary))
            if in_lists(n, boundary):
                total += docs * prefix_length(n) * length
        return total

    return min(range(MOST_LIGHT + 1), key=cost)


def sets_of(words: Words) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    hashes = words.hashes(lower=True)
    runs, whole, offsets = rolling(hashes, SHINGLE), text_key(words, hashes), words.offsets.tolist()
    out = []
    for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if b - a >= SHINGLE:
            s = np.sort(runs[a : b - SHINGLE + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        else:
            out.append(mix(whole[k : k + 1] + np.uint64(11)) if b > a else hashes[:0])
    return out


def set_key(s: np.ndarray) -> int:
    """A 64-bit number of a set's content."""
    total = np.array([mix(s).sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0], np.uint64)
    return int(signed(mix(mix(total[:1]) ^ total[1:] + np.uint64(len(s))))[0])


class Order:
    """Shingles by whether they are frequent, then by hash."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = np.sort(frequent)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(frequent >> np.uint64(42)).astype(np.int64)] = True

    def prefix(self, s: np.ndarray) -> tuple[np.ndarray, int]:
        """The first shingles of a sorted set, and how many of them are rare; those come first."""
        n = prefix_length(len(s))
        often = self.maybe[(s >> np.uint64(42)).astype(np.int64)]
        if often.any():
            at = np.minimum(np.searchsorted(self.frequent, s[often]), len(self.frequent) - 1)
            often[often] = self.frequent[at] == s[often]
        rare = s[~often][:n]
        return np.concatenate([rare, s[often][: n - len(rare)]]), len(rare)


def light_keys(s: np.ndarray, boundary: int) -> list[int]:
    out = []
    for c in subset_sizes(len(s), boundary):
        index = np.array(list(combinations(range(len(s)), c)))
        mixed = mix(s ^ np.uint64(c * 0x9E3779B97F4A7C15 & (2**64 - 1)))[index].sum(axis=1, dtype=np.uint64)
        out += signed(mix(mixed)).tolist()
    return out


def sample_of(docs: DataFrame) -> tuple[np.ndarray, dict[int, int], float]:
    """Frequent shingles of the sample, its documents by small set size, and the mean length of a list as a posting meets it."""

    def task(rows: pa.RecordBatch):
        for words in split_words(rows.column("text")):
            yield batch(shingle=signed(np.concatenate([*sets_of(words), np.zeros(0, np.uint64)])))

    drawn = docs.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(SAMPLED)) == 0)
    found = checkpointed(in_arrow(drawn, task, "shingle long").groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1"), "jaccard-sample")
    frequent = found.where("times > 2").orderBy(F.desc("times"), "shingle").limit(FREQUENT)
    twice = found.where("times = 2").count()
    sizes = drawn.select(F.greatest(F.regexp_count("text", F.lit(WORD)) - SHINGLE + 1, F.lit(1)).alias("size")).groupBy("size").agg(F.count("*").alias("docs")).groupBy(F.least("size", F.lit(MOST_LIGHT + 1)).alias("size"))
    sizes = sizes.agg(F.sum("docs").alias("docs"), F.sum(F.col("docs") * F.col("size")).alias("all")).where("size IS NOT NULL").collect()
    length = 1 + SAMPLED * 2 * twice / max(sum(r["all"] for r in sizes), 1)
    return np.array([r.shingle for r in frequent.select("shingle").collect()], np.int64).view(np.uint64), {r.size: r.docs for r in sizes if r.size <= MOST_LIGHT}, length


def parts_of(s: np.ndarray) -> bytes:
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def marks_of(parts: list[np.ndarray]) -> np.ndarray:
    """The parities of each set's members by hash range, as MARKS whole numbers."""
    odd = np.array([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=PARTS) & 1 for s in parts], np.uint8).reshape(-1, PARTS)
    return np.packbits(odd, axis=1).view(np.int64)


def profile(docs: DataFrame, order: Order, boundary: int, kept: tuple[str, ...] = ()) -> DataFrame:
    """`kept` (long columns of `docs`), _id, node (the class), size, parts (members by hash range), and the keys under which the class is looked for: rare ones, and others, `placed` of which continue the rare ones in order; and marks."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def task(rows: pa.RecordBatch):
        ids, long = rows.column("_id"), pa.list_(pa.int64())
        for words in split_words(rows.column("text")):
            sets = sets_of(words)
            rare, others, placed = [], [], []
            for s in sets:
                first, n = shared.value.prefix(s) if len(s) and in_lists(len(s), boundary) else (s[:0], 0)
                keys = signed(mix(first + np.uint64(29)))
                rare.append(keys[:n])
                placed.append(len(keys) - n)
                others.append(keys[n:].tolist() + (light_keys(s, boundary) if 0 < len(s) <= boundary else []))
            yield batch(
                **{c: rows.column(c).slice(words.first_row, len(sets)) for c in kept}, _id=ids.slice(words.first_row, len(sets)), node=pa.array([set_key(s) for s in sets], pa.int64()), size=pa.array([len(s) for s in sets], pa.int64()),
                parts=pa.array([parts_of(s) for s in sets], pa.binary()), rare=pa.array(rare, long), others=pa.array(others, long), placed=pa.array(placed, pa.int64()),
                **dict(zip(MARKS, marks_of(sets).T.copy(), strict=True)),
            )

    return in_arrow(docs, task, "".join(f"{c} long, " for c in kept) + "_id long, node long, size long, parts binary, rare array<long>, others array<long>, placed long, " + ", ".join(f"{m} long" for m in MARKS))


def class_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and its members, sorted, for `nodes` (_id, node)."""

    def task(rows: pa.RecordBatch):
        for words in split_words(rows.column("text")):
            sets = sets_of(words)
            yield batch(_id=rows.column("_id").slice(words.first_row, len(sets)), node=pa.array([set_key(s) for s in sets], pa.int64()), members=pa.array([signed(s) for s in sets], pa.list_(pa.int64())))

    kept = docs.join(counted(nodes.select("_id").distinct()), "_id", "left_semi")
    return in_arrow(kept, task, "_id long, node long, members array<long>").join(counted(nodes), ["_id", "node"], "left_semi").drop("_id")


#: What both sets have left from a key on must hold what similar sets share; subsets leave the whole set.
_ENOUGH = "9 * least(rest, _rest) >= 4 * (size + _size)"
_ALIKE = f"9 * ({' + '.join(f'bit_count({m} ^ _{m})' for m in MARKS)}) <= size + _size"
#: Whether a set can be the smaller one of a similar pair that first meets here.
_EARLY = "9 * rest >= 8 * size"


def linked(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of `pairs` (a, b) those that are similar; `classes`: _id, node, size, parts, one row for each node."""

    def possible(rows: pa.RecordBatch):
        one, two = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int64) for c in ("_p", "_q"))
        m, n = rows.column("_m").to_numpy(), rows.column("_n").to_numpy()
        # A count of 255 may stand for more: the bound must not fall below the truth.
        most = np.where((one == 255) | (two == 255), np.minimum(m, n)[:, None], np.minimum(one, two)).sum(axis=1)
        keep = pa.array(9 * most >= 4 * (m + n))
        yield batch(a=rows.column("a").filter(keep), b=rows.column("b").filter(keep))

    parts = classes.select("node", "size", "parts")
    near = pairs.distinct().join(parts.toDF("a", "_m", "_p"), "a").join(parts.toDF("b", "_n", "_q"), "b").select("a", "b", "_m", "_n", "_p", "_q")
    near = checkpointed(in_arrow(near, possible, "a long, b long"), "jaccard-possible")
    needed = near.select("a").union(near.select("b")).distinct().toDF("node")
    needed = checkpointed(classes.select("_id", "node").join(needed, "node", "left_semi"), "jaccard-needed")
    sets = class_sets(docs, needed)  # of rows that repeat, both give the same links
    both = near.join(sets.toDF("b", "_q"), "b").join(sets.toDF("a", "_p"), "a")
    shared = F.size(F.array_intersect("_p", "_q"))
    return checkpointed(both.where(100 * shared >= 80 * (F.size("_p") + F.size("_q") - shared)).select("a", "b"), "jaccard-links")


def inverted_lists(classes: DataFrame) -> DataFrame:
    """key, node, size, rest, times, pivot of the keys that several classes have, one of them early; rest: shingles of the class from the key on."""
    keyed = classes.select("node", "size", F.posexplode("rare").alias("_at", "key")).select("key", "node", "size", (F.col("size") - F.col("_at")).alias("rest"))
    by_key = Window.partitionBy("key")
    short = keyed.withColumns({"times": F.count("*").over(by_key), "pivot": F.min("node").over(by_key), "_early": F.max(F.expr(_EARLY)).over(by_key)}).where("times > 1 AND _early")
    keyed = classes.select("node", "size", "placed", F.size("rare").alias("_rare"), F.posexplode("others").alias("_at", "key"))
    keyed = keyed.select("key", "node", "size", F.expr("if(_at < placed, size - _rare - _at, size)").alias("rest"))
    sums = keyed.groupBy("key").agg(F.count("*").alias("times"), F.min("node").alias("pivot"), F.max(F.expr(_EARLY)).alias("_early")).where("times > 1 AND _early")
    columns = ["key", "node", "size", "rest", "times", "pivot"]
    return short.select(columns).unionByName(keyed.join(sums, "key").select(columns))


def met(one: DataFrame, two: DataFrame) -> DataFrame:
    """a, b: pairs of different labels, one of each table (key, node, size, rest, label, marks), that can be similar and first meet under a key."""

    def joined(early: DataFrame, other: DataFrame) -> DataFrame:
        other = other.select("key", *(F.col(c).alias(f"_{c}") for c in ("node", "size", "rest", "label", *MARKS)))
        return early.where(_EARLY).join(other, "key").where("label <> _label").where(_ENOUGH).where(_ALIKE).select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b"))

    return joined(one, two).union(joined(two, one))


def similar_links(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """a, b: links that connect all classes which are connected; `seen`: the profile."""
    first = seen.where("size > 0").groupBy("node").agg(F.min("_id").alias("_first"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    others = checkpointed(seen.select("_id", "node").join(counted(checkpointed(first, "jaccard-firsts")), "node").where("_id > _first").select("_id", "node").distinct(), "jaccard-copies")
    classes = seen.where("size > 0").join(counted(others), ["_id", "node"], "left_anti")
    hits = checkpointed(inverted_lists(classes), "jaccard-lists")
    short, long = hits.where(F.col("times") <= SHORT_LIST), hits.where(F.col("times") > SHORT_LIST)
    paired = short.join(short.select("key", *(F.col(c).alias(f"_{c}") for c in ("node", "size", "rest"))), "key").where("node < _node").where(_ENOUGH)
    stars = long.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b"))
    links = linked(docs, classes, paired.select(F.col("node").alias("a"), F.col("_node").alias("b")).union(stars))
    long = checkpointed(long.select("key", "node", "size", "rest", "pivot").join(classes.select("node", *MARKS), "node"), "jaccard-long")
    for draw in (1, 2, None):
        # Members that are not connected with their list's pivot are compared with the members of other components.
        labels = components(links)
        placed = long.join(labels.toDF("node", "_l"), "node", "left").withColumn("label", F.coalesce("_l", "node")).drop("_l")
        placed = placed.join(labels.toDF("pivot", "_l"), "pivot", "left").withColumn("_home", F.coalesce("_l", "pivot")).drop("_l")
        placed = checkpointed(placed, "jaccard-placed")
        away = F.col("label") != F.col("_home")
        if placed.where(away).isEmpty():
            break
        if draw:
            rank = F.row_number().over(Window.partitionBy("key", away).orderBy(F.xxhash64("node", F.lit(draw)), "node"))
            pivots = checkpointed(placed.withColumn("_rank", rank).where(F.col("_rank") <= PIVOTS), "jaccard-pivots")
        else:
            pivots = placed.where(away)
        columns = ["key", "node", "size", "rest", "label", *MARKS]
        links = links.union(linked(docs, classes, met(pivots.select(columns), placed.select(columns))))
    return links


def placed_rows(docs: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """_id, size, `kept`, and of rows that others are linked with, or share the set of: label and _component, its least _id."""
    frequent, counts, length = sample_of(docs)
    boundary = best_boundary(counts, length)
    seen = checkpointed(profile(docs, Order(frequent), boundary, kept), "jaccard-profile")
    labels = components(similar_links(docs.select("_id", "text"), seen).select("a", "b"))
    # Only classes of several documents or with links: all other documents are components of their own.
    classes = seen.where("size > 0").groupBy("node").agg(F.min("_id").alias("_first"), F.count("*").alias("_times")).join(counted(labels), "node", "left").where("_times > 1 OR label IS NOT NULL")
    classes = checkpointed(classes.select("node", "_first", F.coalesce("label", "node").alias("label")), "jaccard-classes")
    least = classes.groupBy("label").agg(F.min("_first").alias("_component"))
    joined = checkpointed(classes.join(least, "label").select("node", "label", "_component"), "jaccard-joined")
    return seen.select("_id", "node", "size", *kept).join(counted(joined), "node", "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach, its own included) for every row."""
    whole = placed_rows(texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("_id"), "text"))

    def shown(c):
        return F.when(c != _NULL_ID, c)

    component = F.when(F.col("size") > 0, F.coalesce("_component", "_id")).otherwise(F.col("_id"))
    return whole.select(shown(F.col("_id")).alias("doc_id"), F.col("size").alias("n_shingles"), shown(component).alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` with one of each component: the one of the least id (null before all others), and of its rows the one of the least text hash.

    Rows are told apart by id and text, so rows that share an id, or have none, stay unless they are linked; of rows equal in both one stays.
    Rows without words are linked with nothing and all stay.
    """
    key = {n: fresh(df, n) for n in ("other_id", "text_one", "text_two")}
    own = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NULL_ID)), *[F.xxhash64(F.lit(k), F.col(f"`{text_col}`").cast("string")) for k in (31, 32)]]
    docs = df.select(own[0].alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"), own[1].alias("_one"), own[2].alias("_two"))
    rows = placed_rows(docs, ("_one", "_two")).where("label IS NOT NULL AND size > 0").groupBy("label", "_id", "_one", "_two").agg(F.count("*").alias("_times"))
    rows = checkpointed(rows, "jaccard-rows")
    best = rows.groupBy("label").agg(F.min(F.struct("_id", "_one", "_two")).alias("_best"))
    rows = rows.join(counted(best), "label").withColumn("_stays", F.struct("_id", "_one", "_two") == F.col("_best")).where("NOT _stays OR _times > 1")
    rows = checkpointed(rows.select(*[F.col(a).alias(b) for a, b in zip(("_id", "_one", "_two"), key.values(), strict=True)], "_stays"), "jaccard-decided")
    gone, again = (rows.where(F.col("_stays") == stays).drop("_stays") for stays in (False, True))
    keyed = df.withColumns(dict(zip(key.values(), own, strict=True)))
    kept = keyed.join(counted(gone), list(key.values()), "left_anti")
    if again.isEmpty():
        return kept.select(df.columns)
    again = counted(again)
    return kept.join(again, list(key.values()), "left_anti").unionByName(kept.join(again, list(key.values()), "left_semi").dropDuplicates(list(key.values()))).select(df.columns)
