"""Top-K candidates by cosine similarity."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import cosine
from ..written import written

DEFAULT_K = 5
#: Vectors, and components of them, that a block of lines or items may hold; a task holds one block of both.
BROADCAST_ITEMS, BLOCK_VALUES = 65_536, 1 << 22
#: Pairs of blocks that are made if there are lines enough; a block of lines has LEAST_LINES or more.
CELLS, LEAST_LINES = 64, 256
#: Lines and items whose products are taken at a time, and pairs whose exact scores are.
STEP_LINES, STEP_ITEMS, STEP_PAIRS = 1024, 8192, 1 << 20


def ranked(scored: DataFrame, line: str, item: str, k: int = DEFAULT_K) -> DataFrame:
    """The k best rows of each line by `score`, ties by item; Spark limits groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(line).orderBy(F.desc("score"), item))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_dense(lines: DataFrame, items: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """line_no, item_no, score, rank by exact cosine; `lines` (line_no, vector), `items` (item_no, vector); numbers are whole.

    Null vectors take no part, and a line without candidates has no row.  Vectors that are zero or hold nulls score 0 with all; of other pairs
    those of unlike width have no score, and come last.  Blocks of lines meet blocks of items, so a task holds one of each: products
    in single precision leave out what can't be among the best, whose scores are then taken in double precision.
    """
    kinds = {n: df.schema[n].dataType for df, n in ((lines, "line_no"), (items, "item_no"))}
    lines, items = (df.select(F.col(n).cast("long").alias(n), F.col(v)).where(F.col(v).isNotNull()) for df, n, v in ((lines, "line_no", "line_vector"), (items, "item_no", "item_vector")))
    (asked, _), (count, width) = (df.agg(F.count("*"), F.max(F.size(v))).first() for df, v in ((lines, "line_vector"), (items, "item_vector")))
    rows = max(1, min(BROADCAST_ITEMS, BLOCK_VALUES // max(width or 1, 1)))
    item_blocks = max(1, -(-count // rows))
    line_blocks = max(-(-asked // rows), min(-(-CELLS // item_blocks), -(-asked // LEAST_LINES)), 1)

    def dealt(df: DataFrame, number: str, own: int, others: int, cell):
        """Each row in its own block, once for each block of the other side."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(others - 1).cast("long")))
        return df.withColumn("_own", F.pmod(F.xxhash64(number), F.lit(own))).withColumn("_other", other).withColumn("_cell", cell).drop("_own", "_other")

    ours = dealt(lines, "line_no", line_blocks, item_blocks, F.col("_own") * item_blocks + F.col("_other"))
    theirs = dealt(items, "item_no", item_blocks, line_blocks, F.col("_other") * item_blocks + F.col("_own"))
    cells = ours.groupBy("_cell").cogroup(theirs.groupBy("_cell"))
    scored = cells.applyInArrow(lambda a, b: _best_of_cell(a, b, k), "line_no long, item_no long, score double")
    return ranked(scored.select(*[F.col(n).cast(kind).alias(n) for n, kind in kinds.items()], "score"), "line_no", "item_no", k)


def _matrix(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors (rows of doubles, ended by zeros; zero if a component is null), their widths, lengths, and unit vectors in single precision.

    What single precision can't bound (not finite, very short or long) is not a number there.
    """
    lists = rows.column(column).combine_chunks()
    widths = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(widths)), widths)
    out = np.zeros((len(widths), int(widths.max(initial=0))))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(widths) - widths, widths)] = flat.fill_null(0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        out[row[flat.is_null().to_numpy(zero_copy_only=False)]] = 0
    lengths = np.sqrt(_sums(out, out, np.arange(len(out)), np.arange(len(out))))
    sound = (lengths > 1e-100) & (lengths < 1e100)
    unit = np.where(sound, 1 / lengths, np.nan)[:, None] * out
    unit[lengths == 0] = 0
    return out, widths, lengths, unit.astype(np.float32)


def _sums(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Products of rows `r` of `a` and `c` of `b`, added from the first component on, so that equal vectors have equal products."""
    total = np.zeros(len(r))
    for x, y in zip(a.T, b.T, strict=True):
        total += x[r] * y[c]
    return total


def _first_copies(vectors: np.ndarray, widths: np.ndarray, k: int) -> np.ndarray:
    """Of equal rows the places of the first `k`, ascending."""
    bits = vectors.view(np.uint64)
    odd = np.random.default_rng(1).integers(1 << 62, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = np.argsort((bits * odd).sum(axis=1, dtype=np.uint64) + widths.astype(np.uint64), kind="stable")
    same = np.append(False, (bits[order[1:]] == bits[order[:-1]]).all(axis=1) & (widths[order[1:]] == widths[order[:-1]]))
    at = np.arange(len(order))
    return np.sort(order[at - np.maximum.accumulate(np.where(same, 0, at)) < k])


def _best_of_cell(lines: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """line_no, item_no, score: each line's k best items of a block."""
    out = []
    if lines.num_rows and items.num_rows:
        items = items.sort_by("item_no")
        with np.errstate(all="ignore"):
            own, theirs = _matrix(lines, "line_vector"), _matrix(items, "item_vector")
            dims = max(own[0].shape[1], theirs[0].shape[1])
            own, theirs = ((np.pad(v, ((0, 0), (0, dims - v.shape[1]))), w, n, np.pad(u, ((0, 0), (0, dims - u.shape[1])))) for v, w, n, u in (own, theirs))
            kept = _first_copies(theirs[0], theirs[1], k)
            numbers, theirs = items.column("item_no").to_numpy()[kept], tuple(x[kept] for x in theirs)
            for at in range(0, lines.num_rows, STEP_LINES):
                out.append(_best_of_lines(lines.column("line_no").to_numpy()[at : at + STEP_LINES], tuple(x[at : at + STEP_LINES] for x in own), numbers, theirs, k))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table({"line_no": columns[0], "item_no": columns[1], "score": pa.array(columns[2], mask=columns[2] == -np.inf)})


def _best_of_lines(line_no: np.ndarray, own: tuple, numbers: np.ndarray, theirs: tuple, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _best_of_cell for a few lines; `numbers`, ascending, and `theirs`: the items.  A score of minus infinity stands for none."""
    (a, a_width, a_length, a_unit), (b, b_width, b_length, b_unit) = own, theirs
    margin = 2 * (a.shape[1] + 8) * 2.0**-23  # of two products in single precision
    unlike = len(np.unique(np.concatenate([a_width, b_width]))) > 1
    row, item, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    floor = np.full(len(line_no), -np.inf)
    # Zero vectors score 0 with all items, so the first ones are the best.
    blank = np.flatnonzero(a_length == 0)
    row, item = np.repeat(blank, min(k, len(numbers))), np.tile(np.arange(min(k, len(numbers))), len(blank))
    score = np.zeros(len(row))
    floor[blank] = np.inf
    for at in range(0, len(numbers), STEP_ITEMS):
        near = a_unit @ b_unit[at : at + STEP_ITEMS].T
        if unlike:
            near[(a_width[:, None] != b_width[None, at : at + STEP_ITEMS]) & (a_length > 0)[:, None] & (b_length > 0)[None, at : at + STEP_ITEMS]] = -np.inf
        if not at and near.shape[1] > k:
            known = np.where(np.isnan(near), -np.inf, near)
            floor = np.maximum(floor, np.partition(known, known.shape[1] - k, axis=1)[:, -k])
        # What is not a number is not below the floor.
        possible = ~(near < (floor - margin).astype(np.float32)[:, None])
        possible[blank] = False
        much = -(-np.count_nonzero(possible) // STEP_PAIRS)
        for lot in np.array_split(np.arange(len(line_no)), max(1, much)):
            r, c = np.nonzero(possible[lot])
            if not len(r):
                continue
            r, c = lot[r], c + at
            exact = np.where(unlike & (a_width[r] != b_width[c]), -np.inf, _sums(a, b, r, c) / (a_length[r] * b_length[c]))
            exact[(a_length[r] == 0) | (b_length[c] == 0)] = 0
            row, item, score = np.append(row, r), np.append(item, c), np.append(score, exact)
            order = np.lexsort((item, np.where(np.isnan(score), -np.inf, -score), row))
            row, item, score = row[order], item[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, item, score, place = (x[place < k] for x in (row, item, score, place))
            last = (place == k - 1) & (a_length[row] != 0)
            floor[row[last]] = np.where(np.isnan(score[last]), np.inf, score[last])
    return line_no[row], numbers[item], score


#: Features of a line, its rarest, whose items give the score that all others must reach.
PILOT = 3
#: What sums of products in another order may differ by.
_MARGIN = 1e-9


def _classes(vectors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(`key` and class of each row's vector, class and its sorted entries); equal vectors, as equal texts give them, are one class."""
    if "entries" in vectors.columns:
        rows = vectors.select(key, F.sort_array(F.transform("entries", lambda e: F.struct(e["index"].alias("index"), F.round(e["weight"], 14).alias("weight")))).alias("entries"))
    else:
        rows = vectors.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("index", F.round("weight", 14).alias("weight")))).alias("entries"))  # as many as a text has features
    named = written(rows.withColumn("class", F.sha2(F.to_json("entries"), 256)), "sparse-vectors")
    return named.select(key, "class"), written(named.select("class", "entries").distinct(), "sparse-classes")


def _dots(pairs: DataFrame) -> DataFrame:
    """line_class, item_class, score of pairs with the `entries` of both (_a, _b), by sorting each batch's entries together."""

    def run(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            places, weights = [], []
            for c in ("_a", "_b"):
                lists = rows.column(c)
                flat = lists.flatten()
                pair = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
                places.append(pair << 32 | flat.field("index").to_numpy().astype(np.int64))
                weights.append(flat.field("weight").to_numpy())
            _, at, other = np.intersect1d(*places, assume_unique=True, return_indices=True)
            score = np.round(np.bincount(places[0][at] >> 32, weights[0][at] * weights[1][other], rows.num_rows), 12)  # equal scores tie, whatever the order of sums
            yield pa.RecordBatch.from_arrays([rows.column("line_class"), rows.column("item_class"), pa.array(score)], names=["line_class", "item_class", "score"])

    return pairs.mapInArrow(run, "line_class string, item_class string, score double")


def top_k_sparse(lines: DataFrame, items: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """As top_k_dense over sparse unit vectors (line_no or item_no, index, weight; or, without a shuffle of entries, line_no or item_no, entries).

    Equal vectors are searched once.  A line's features are taken from the rarest among items on.  The items of its PILOT rarest
    give a score that k items reach; what an item can score by the features from some place on is at most the length of the line's
    vector there, so once that is below the score, items without an earlier feature can't be among the best and are never met.
    Lines for which the pilot finds no k items of a positive score meet all items with a common feature.
    """
    line_of, asked = _classes(lines, "line_no")
    item_of, held = _classes(items, "item_no")
    members = item_of.withColumn("_place", F.row_number().over(Window.partitionBy("class").orderBy("item_no"))).where(F.col("_place") <= k).select(F.col("class").alias("item_class"), "item_no")
    firsts = members.groupBy("item_class").agg(F.min("item_no").alias("first"), F.count("*").alias("times"))
    held = written(held.select(F.col("class").alias("item_class"), "entries").join(firsts, "item_class"), "sparse-items")
    postings = held.select("item_class", F.inline("entries"))
    often = F.broadcast(postings.groupBy("index").agg(F.count("*").alias("_often")))  # a row for each index, as many as vectors are wide
    order = Window.partitionBy("class").orderBy("_often", "index")
    rest = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(order.rowsBetween(0, Window.unboundedFollowing)))
    features = written(asked.select("class", F.inline("entries")).join(often, "index").select(F.col("class").alias("line_class"), "index", F.row_number().over(order).alias("_rank"), rest.alias("_rest")), "sparse-features")

    def scored(wanted: DataFrame, name: str) -> DataFrame:
        met = wanted.select("line_class", "index").join(postings.select("item_class", "index"), "index").select("line_class", "item_class").distinct()
        both = met.join(asked.select(F.col("class").alias("line_class"), F.col("entries").alias("_a")), "line_class").join(held.select("item_class", F.col("entries").alias("_b")), "item_class")
        return written(_dots(both), name)

    pilot = scored(features.where(F.col("_rank") <= PILOT), "sparse-pilot").join(firsts, "item_class")
    so_far = F.sum("times").over(Window.partitionBy("line_class").orderBy(F.desc("score"), "item_class"))
    reached = pilot.withColumn("_so_far", so_far).where(F.col("_so_far") >= k).groupBy("line_class").agg(F.max("score").alias("_floor")).where(F.col("_floor") > _MARGIN)
    bound = features.join(reached, "line_class", "left")
    needed = bound.where(F.col("_floor").isNull() | (F.col("_rest") >= F.col("_floor") - _MARGIN))
    found = scored(needed, "sparse-scores").join(firsts, "item_class")
    # Lines of fewer than k items with a positive score: items without a common feature have score 0, and the first numbers suffice.
    positive = found.where("score > 0").groupBy("line_class").agg(F.sum("times").alias("_n"))
    short = asked.select(F.col("class").alias("line_class")).join(positive, "line_class", "left").where(F.coalesce("_n", F.lit(0)) < k).select("line_class")
    best = found.withColumn("_place", F.row_number().over(Window.partitionBy("line_class").orderBy(F.desc("score"), "first"))).where(F.col("_place") <= k)
    top = ranked(best.select("line_class", "item_class", "score").join(members, "item_class").select("line_class", "item_no", "score"), "line_class", "item_no", k)
    top = top.select("line_class", "item_no", "score")
    top = ranked(top.unionByName(_padded(short, found, item_of, k)).groupBy("line_class", "item_no").agg(F.max("score").alias("score")), "line_class", "item_no", k)
    return line_of.withColumnRenamed("class", "line_class").join(top, "line_class").select("line_no", "item_no", "score", "rank")


def _padded(short: DataFrame, found: DataFrame, item_of: DataFrame, k: int) -> DataFrame:
    """line_class, item_no, score 0: the first k items that a line of `short` has no common feature with."""
    met = found.join(short, "line_class", "left_semi").select("line_class", "item_class")
    sizes = item_of.groupBy(F.col("class").alias("item_class")).agg(F.count("*").alias("_size"))
    counts = short.join(met.join(sizes, "item_class").groupBy("line_class").agg(F.sum("_size").alias("_met")), "line_class", "left").select("line_class", F.coalesce("_met", F.lit(0)).alias("_met"))
    # A line that met m items misses at most m of the first m + k item numbers: no more than those are numbered.
    most = counts.agg(F.max("_met")).first()[0]
    if most is None:
        return short.select("line_class", F.lit(None).cast(item_of.schema["item_no"].dataType).alias("item_no"), F.lit(0.0).alias("score")).where("false")
    numbered = item_of.select("item_no", "class").orderBy("item_no").limit(most + k).withColumn("_n", F.row_number().over(Window.orderBy("item_no")))
    pads = counts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_met").cast("int") + k))).join(numbered, "_n").withColumnRenamed("class", "item_class")
    pads = pads.join(met, ["line_class", "item_class"], "left_anti")
    return pads.select("line_class", "item_no", F.lit(0.0).alias("score"))


def top_k_for(items: DataFrame, vector: Column, k: int = DEFAULT_K) -> DataFrame:
    """The best items for one vector."""
    scored = items.where(F.col("item_vector").isNotNull()).select("item_no", cosine(vector, F.col("item_vector")).alias("score"))
    return scored.orderBy(F.desc("score"), "item_no").limit(k)


def brute_force_comparisons(lines: int, items: int) -> int:
    return lines * items
