"""Importance resampling towards a target's n-grams: hashed features, bucket gains, Gumbel draws.

Features are runs of 1 to NGRAM words, hashed by crc32 into BUCKETS buckets.  A bucket's gain compares its rate in the
target with its rate in the documents; a document's weight is the mean gain of its features, and the draw takes the highest
sums of weight and Gumbel noise, so that documents are drawn without replacement in proportion to exp(weight / 1000).

Texts are skewed, so long ones are chunked: a text of more than CHUNK_BYTES is split at word boundaries into chunks of
about that size.  A chunk owns the starting positions of its own words and carries the NGRAM - 1 words that follow, so each
feature is counted in exactly one chunk, and chunks of one text go to many tasks.  Counts and sums of gains are
whole numbers, and are summed by document.  Texts of one chunk never leave the task that read them.

crc32 is linear over bits: words are hashed by table, one byte of all words at a time, and a run's hash follows
from its words' hashes by tables that append a word's length of zeros.

Only the counts of the BUCKETS buckets, a fixed number of rows, come to the driver.  Ranks come from a range partitioning of the rows that
can be drawn, and its partitions' sizes.

Defined results: null and empty texts, and those without words, have no features and the weight 0; a null id has the noise of
the empty text, is drawn after all others that tie with it, and comes back null; rows that share an id are documents each; further columns are ignored; without
a target text all rates there are 0; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpointed, texts
from .words import Words, split_words

NGRAM = 2
BUCKETS = 10_000
#: Bytes of a chunk's own words; a single longer word is a chunk.
CHUNK_BYTES = 1 << 16
LEAST_WORDS, DRAWN_PERCENT, SEED = 20, 25, 7
#: Words of more bytes are hashed one by one.
SHORT_WORD = 32

_OUTSIDE = np.ones(256, bool)
_OUTSIDE[0x30:0x3A] = _OUTSIDE[0x41:0x5B] = _OUTSIDE[0x61:0x7B] = _OUTSIDE[0x80:] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ONES = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> np.uint32(1) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_BYTES = _byte_table()


def _zeros(crc: np.ndarray) -> np.ndarray:
    """What a zero byte makes of a state."""
    return _BYTES[crc & np.uint32(255)] ^ crc >> np.uint32(8)


def _append_tables() -> np.ndarray:
    """[length, k, byte]: the state after `length` zero bytes of a state whose k-th byte is `byte` and whose others are 0."""
    out = [np.arange(256, dtype=np.uint32) << np.uint32(8) * np.arange(4, dtype=np.uint32)[:, None]]
    for _ in range(SHORT_WORD):
        out.append(_zeros(out[-1]))
    return np.stack(out)


_APPEND = _append_tables()


def word_hashes(words: Words) -> np.ndarray:
    """crc32 of each word, A-Z lowered."""
    sizes = words.ends - words.starts
    out = np.full(len(sizes), _ONES)
    order = np.argsort(-np.minimum(sizes, SHORT_WORD), kind="stable")
    starts, sorted_sizes, crc = words.starts[order], sizes[order], out[order]
    for k in range(min(SHORT_WORD, int(sizes.max(initial=0)))):
        n = int(np.searchsorted(-sorted_sizes.clip(max=SHORT_WORD), -k, "left"))  # words of more than k bytes come first
        crc[:n] = _BYTES[(crc[:n] ^ _LOWER[words.data[starts[:n] + k]]) & np.uint32(255)] ^ crc[:n] >> np.uint32(8)
    out[order] = crc ^ _ONES
    for k in np.flatnonzero(sizes > SHORT_WORD):
        out[k] = zlib.crc32(_LOWER[words.data[words.starts[k] : words.ends[k]]].tobytes())
    return out


def joined_hashes(crc: np.ndarray, single: np.ndarray, words: Words) -> np.ndarray:
    """crc32 of runs that end before each word (`crc`) with a space and that word; `single`: the words' own."""
    spaced = _BYTES[(crc ^ _ONES ^ np.uint32(32)) & np.uint32(255)] ^ (crc ^ _ONES) >> np.uint32(8) ^ _ONES
    sizes = words.ends - words.starts
    at = np.minimum(sizes, SHORT_WORD)
    out = single.copy()
    for k in range(4):
        out ^= _APPEND[at, k, spaced >> np.uint32(8 * k) & np.uint32(255)]
    for k in np.flatnonzero(sizes > SHORT_WORD):
        out[k] = zlib.crc32(_LOWER[words.data[words.starts[k] : words.ends[k]]].tobytes(), int(spaced[k]))
    return out


def features(words: Words, owned: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 to NGRAM words: the starting words of the features, ascending, and the features' buckets.

    `owned`: of each row, how many words it owns; a feature belongs to the row that owns its first word.
    """
    single = word_hashes(words)
    ends = np.repeat(words.offsets[1:], words.counts)
    place = np.arange(len(single)) - np.repeat(words.offsets[:-1], words.counts)
    mine = place < np.repeat(owned, words.counts)
    out, crc = [], single
    for width in range(1, NGRAM + 1):
        first = np.flatnonzero(mine & (np.arange(len(single)) + width <= ends))
        if width > 1:
            # The run before each word ends with the word before it.
            crc = np.concatenate([crc[:1], joined_hashes(crc[:-1], single[1:], Words(words.data, words.starts[1:], words.ends[1:], words.offsets, 0))])
        out.append((first, (crc[first + width - 1] % np.uint32(BUCKETS)).astype(np.int64)))
    return out


def split_text(text: str, chunk_bytes: int = CHUNK_BYTES) -> list[tuple[str, int]]:
    """A long text's chunks: each one's own words and the words it carries, as they stand, and the number of its own; one empty chunk of a text without words."""
    out = []
    for words in split_words(pa.array([text]), len(text.encode()) + 1, _OUTSIDE):
        n, first = len(words.starts), 0
        while first < n:
            stop = max(first + 1, int(np.searchsorted(words.ends, words.starts[first] + chunk_bytes, "right")))
            last = min(n, stop + NGRAM - 1) - 1
            out.append((words.data[words.starts[first] : words.ends[last]].tobytes().decode(), stop - first))
            first = stop
    return out or [("", 0)]


_PIECE = "doc_id long, one long, two long, place int, own long, text string"


def pieces(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, one, two (of a long text), place, own (words it owns, null: all), text: whole short texts, and chunks of long ones dealt to tasks."""

    def cut(rows: pa.RecordBatch):
        for row in rows.to_pylist():
            for place, (text, own) in enumerate(split_text(row["text"], chunk_bytes)):
                yield batch(doc_id=pa.array([row["doc_id"]], pa.int64()), one=pa.array([row["one"]], pa.int64()), two=pa.array([row["two"]], pa.int64()), place=pa.array([place], pa.int32()), own=pa.array([own], pa.int64()), text=[text])

    def run(batches):
        for rows in batches:
            yield from cut(rows)

    size = F.octet_length("text")
    none = F.lit(None)
    short = docs.where(F.coalesce(size, F.lit(0)) <= chunk_bytes).select("doc_id", none.cast("long").alias("one"), none.cast("long").alias("two"), none.cast("int").alias("place"), none.cast("long").alias("own"), "text")
    long = docs.where(size > chunk_bytes).select("doc_id", F.xxhash64(F.lit(1), "text").alias("one"), F.xxhash64(F.lit(2), "text").alias("two"), "text").mapInArrow(run, _PIECE)
    return short.unionByName(long.repartition("doc_id", "one", "place"))


def bucket_counts(df: DataFrame) -> np.ndarray:
    """How many features fall into each bucket; a partial count for each task is all that is shuffled."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for rows in batches:
            for words, owned in _owned(rows):
                for _, buckets in features(words, owned):
                    total += np.bincount(buckets, minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield batch(bucket=found, times=total[found])

    sums = df.mapInArrow(run, "bucket long, times long").groupBy("bucket").agg(F.sum("times").alias("times"))
    out = np.zeros(BUCKETS, np.int64)
    for row in sums.collect():  # BUCKETS rows at most
        out[row.bucket] = row.times
    return out


def _owned(rows: pa.RecordBatch):
    own = rows.column("own").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
    for words in split_words(rows.column("text"), outside=_OUTSIDE):
        yield words, own[words.first_row : words.first_row + len(words.counts)]


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's rate in the target by its rate in the source, each with one more feature in each bucket."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(parts: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document, from its `pieces`."""

    def run(batches):
        for rows in batches:
            for words, owned in _owned(rows):
                n = len(words.counts)
                counts, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
                for first, buckets in features(words, owned):
                    total = np.concatenate([[0], np.cumsum(gain[buckets])])
                    at = np.searchsorted(first, words.offsets)
                    counts += np.diff(at)
                    sums += total[at[1:]] - total[at[:-1]]
                same = {c: rows.column(c).slice(words.first_row, n) for c in ("doc_id", "one", "two", "place")}
                yield batch(**same, n_words=np.minimum(words.counts, owned), n_features=counts, gain=sums)

    found = parts.mapInArrow(run, "doc_id long, one long, two long, place int, n_words long, n_features long, gain long")
    sums = ["n_words", "n_features", "gain"]
    short = found.where("place IS NULL").select("doc_id", *sums)
    # Rows that share id and text add up together: as many as first chunks, with equal shares.
    long = found.where("place IS NOT NULL").groupBy("doc_id", "one", "two").agg(F.count_if(F.col("place") == 0).alias("copies"), *[F.sum(c).alias(c) for c in sums])
    long = long.select("doc_id", *[F.expr(f"{c} div copies").alias(c) for c in sums], F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
    whole = short.unionByName(long)
    floored = F.expr("(gain - pmod(gain, n_features)) div n_features")
    return whole.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, floored).otherwise(F.lit(0).cast("long")).alias("weight"))


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = DRAWN_PERCENT, seed: int = SEED, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_features, weight, score, rank (of the drawn rows, from 1) for every row of `df`; `target`: texts in a column `text`."""
    docs = texts(df, id_col, text_col)
    aim = texts(target.withColumn("_id", F.lit(0)), "_id", "text")
    gain = gains(bucket_counts(pieces(docs, chunk_bytes)), bucket_counts(pieces(aim, chunk_bytes)))
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / 4294967296.0)))
    scored = checkpointed(weighed(pieces(docs, chunk_bytes), gain).withColumn("score", F.col("weight") + gumbel), "resample-scores")
    able = F.col("n_words") >= LEAST_WORDS
    # A row for each distinct score: their range is that of the gains and the noise, whatever the number of documents.
    by_score = checkpointed(scored.where(able).groupBy("score").agg(F.count("*").alias("times")), "resample-counts")
    wanted = (by_score.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0] * percent) // 100
    reached = by_score.withColumn("so_far", F.sum("times").over(Window.orderBy(F.desc("score")))).where(F.col("so_far") >= wanted).agg(F.max("score")).first()[0]
    cut = F.col("score") >= F.lit(reached if wanted else None).cast("long")
    drawable = F.coalesce(able & cut, F.lit(False))
    # Places within a partition and partitions' sizes give ranks; the last key splits runs of equal rows.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), "n_features", "weight", "_row"]
    ordered = scored.withColumn("_row", F.monotonically_increasing_id()).where(drawable).repartitionByRange(*order).sortWithinPartitions(*order)
    ordered = checkpointed(ordered.select("doc_id", "n_features", "weight", "score", F.monotonically_increasing_id().alias("_at")), "resample-order").withColumn("_part", F.shiftright("_at", 33))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ordered.join(F.broadcast(before), "_part").select(*columns, F.when(rank <= wanted, rank).alias("rank"))
    return drawn.unionByName(scored.where(~drawable).select(*columns, F.lit(None).cast("long").alias("rank")))
