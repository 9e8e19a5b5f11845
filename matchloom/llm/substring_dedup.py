"""Substring dedup by De Bruijn compaction of repeated word runs.

Windows of WINDOW consecutive words are the edges of a De Bruijn graph over runs of WINDOW - 1
words.  Each window's first place (smallest id, then earliest start) is kept, and every word under a
later occurrence goes.

1. Anchors: each window has the least-hashed run of ANCHOR words in it as its anchor, so equal windows
   have equal anchors.  Only about one place in seven starts an anchor; anchors that stand at several
   places tell which windows can repeat at all.  Nothing that repeats is lost.  An anchor that
   repeats within a batch of documents is known to at once, and the batch sends it on only once, so
   that even an anchor of all documents is a few rows.
2. Edges: the windows with repeated anchors, once for each document, under two independent 64-bit
   hashes, are summed to edges with their first source coordinate; a join gives every later
   occurrence its source.  Repeats within a document are found where its text is.
3. Compaction: later occurrences whose places and source places both advance by one form a
   nonbranching path; such paths become spans (place, source place, length), and their union is cut.

Whole copies of an earlier document lose all their windows by definition, and so skip steps 1 to 3,
but for the anchors that they send for others of their batch.
Sums combine before each shuffle, joins on hot keys are split by AQE, and ids are broadcast only up
to a bound, counted first; beyond that the join shuffles.

Defined results: null or empty texts have no words; a null id stands before all others; rows that
share an id are versions of one document, whose equal places are not earlier than each other; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpointed, counted, fresh, in_arrow, texts
from .words import Words, mix, rolling, signed, split_words, window_rows

WINDOW = 20
ANCHOR = 8
_NULL_ID = -(1 << 63)


def anchors(words: Words, hashes: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window of each document: its first word, its document, and the first word of its anchor."""
    first, docs = window_rows(words.offsets, window)
    if not len(first):
        return first, docs, first
    bits = max(20, int(len(hashes)).bit_length())  # places below, so that of equal runs the leftmost is least
    ranked = (rolling(hashes, anchor) >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(hashes) - anchor + 1, dtype=np.uint64)
    width, size, least = window - anchor + 1, 1, ranked
    while size * 2 <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[: len(ranked) - width + 1], least[width - size :])
    return first, docs, (least[first] & np.uint64((1 << bits) - 1)).astype(np.int64)


def text_key(words: Words, hashes: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each document."""
    salted = mix(hashes + np.uint64(0x5851F42D4C957F2D))
    place = np.arange(len(hashes)) - np.repeat(words.offsets[:-1], words.counts)
    total = np.append(np.uint64(0), np.cumsum(mix(salted ^ mix(place.astype(np.uint64) + np.uint64(1)))))
    return mix(total[words.offsets[1:]] - total[words.offsets[:-1]] + words.counts.astype(np.uint64))


def profile(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """A row for each document: _id, n_words, _key and _check (two hashes of its words), whole_sha256 and its anchors; `known`: to repeat, `send`: to the other batches."""

    def task(rows: pa.RecordBatch):
        counts, keys, checks, shas, doc, value, times = [], [], [], [], [], [], []
        for words in split_words(rows.column("text")):
            hashes = words.hashes(lower=False)
            _, docs, at = anchors(words, hashes, window, anchor)
            runs = rolling(hashes, anchor)
            fresh = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (docs[1:] != docs[:-1]))) if len(at) else np.zeros(0, np.int64)
            own, run = docs[fresh], runs[at[fresh]] if len(fresh) else np.zeros(0, np.uint64)
            order = np.lexsort((run, own))
            own, run = own[order], run[order]
            heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (run[1:] != run[:-1]))) if len(own) else np.zeros(0, np.int64)
            doc.append(own[heads] + words.first_row)
            value.append(run[heads])
            times.append(np.diff(np.append(heads, len(own))))
            counts.append(words.counts)
            keys.append(text_key(words, hashes))
            checks.append(text_key(words, mix(hashes ^ np.uint64(0x94D049BB133111EB))))
            shas += [hashlib.sha256(b" ".join(words.data[a:b].tobytes().split())).hexdigest() for a, b in _bounds(words)]
        if not counts:
            return
        doc, value, times = (np.concatenate(x) for x in (doc, value, times))
        _, first, place, here = np.unique(value, return_index=True, return_inverse=True, return_counts=True)
        send = np.zeros(len(value), bool)
        send[first] = True
        found = pa.StructArray.from_arrays([pa.array(signed(value)), pa.array((times > 1) | (here[place] > 1)), pa.array(send)], ["run", "known", "send"])
        yield batch(
            _id=rows.column("_id"),
            n_words=np.concatenate(counts),
            _key=signed(np.concatenate(keys)),
            _check=signed(np.concatenate(checks)),
            whole_sha256=pa.array(shas, pa.string()),
            anchors=pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(rows.num_rows + 1)), pa.int32()), found),
        )

    return in_arrow(docs, task, "_id long, n_words long, _key long, _check long, whole_sha256 string, anchors array<struct<run: long, known: boolean, send: boolean>>")


def _bounds(words: Words) -> list[tuple[int, int]]:
    """The bytes from the first word of each document to the end of its last."""
    first, stop = words.offsets[:-1], words.offsets[1:]
    return [(int(words.starts[a]), int(words.ends[b - 1])) if b > a else (0, 0) for a, b in zip(first.tolist(), stop.tolist(), strict=True)]


def _firsts(docs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where each value of each document stands first."""
    order = np.lexsort((np.arange(len(values)), values, docs))
    docs, values = docs[order], values[order]
    return order[np.append(True, (docs[1:] != docs[:-1]) | (values[1:] != values[:-1]))] if len(order) else order


def later_windows(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text"):
    """(profile of all documents; ids of whole copies; texts that may hold repeats; for each of those its later windows)."""
    docs = texts(df, id_col, text_col).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("_id"), "text")
    seen = checkpointed(profile(docs, window, anchor), "dedup-profile")
    same = ["_key", "_check", "n_words"]
    keyed = seen.where(F.col("n_words") >= window).groupBy(same).agg(F.min("_id").alias("_first"), F.count("*").alias("_times")).where("_times > 1").drop("_times")
    copies = checkpointed(seen.select("_id", *same).join(counted(checkpointed(keyed, "dedup-firsts")), same).where("_id > _first").select("_id", "_key").distinct(), "dedup-copies")
    copied = counted(copies)
    runs = seen.select("_id", "_key", "anchors").join(copied.withColumn("_copy", F.lit(True)), ["_id", "_key"], "left").select("_id", "_copy", F.inline("anchors"))
    # A copy may have sent an anchor in place of others of its batch, which are known through it.
    sent = runs.where("send AND (_copy IS NULL OR known)")
    by_run = Window.partitionBy("run").orderBy("_id")
    again = F.lag("run").over(by_run).isNotNull() | F.lead("run").over(by_run).isNotNull()
    told = sent.select("run", "_id", "known").withColumn("again", again).where("again AND NOT known").select("_id", "run")
    runs = runs.where("_copy IS NULL")
    maybe = runs.where("known").select("_id", "run").union(told).groupBy("_id").agg(F.collect_list("run").alias("runs"))
    maybe = checkpointed(maybe, "dedup-candidates")
    held = checkpointed(docs.join(counted(maybe.select("_id")), "_id", "left_semi").join(maybe, "_id"), "dedup-texts")

    def edges(rows: pa.RecordBatch):
        ids, lists = rows.column("_id").to_numpy(), rows.column("runs")
        for words in split_words(rows.column("text")):
            hashes = words.hashes(lower=False)
            first, docs, at = anchors(words, hashes, window, anchor)
            if not len(first):
                continue
            value = signed(rolling(hashes, anchor))[at]
            keep = np.zeros(len(first), bool)
            for doc, (a, b) in enumerate(zip(*(np.searchsorted(docs, np.arange(len(words.counts)) + k) for k in (0, 1)), strict=True)):
                if b > a:
                    keep[a:b] = np.isin(value[a:b], lists[words.first_row + doc].values.to_numpy())
            keep = np.flatnonzero(keep)
            one, two = rolling(hashes, window)[first[keep]], rolling(hashes, window, seed=7)[first[keep]]
            once = np.sort(_firsts(docs[keep], one))
            keep, one, two = keep[once], one[once], two[once]
            docs = docs[keep]
            version = (text_key(words, hashes) & np.uint64(0x7FFFFFFF)).astype(np.int64)[docs]
            place = (first[keep] - words.offsets[docs]) << 32 | version
            yield batch(one=signed(one), two=signed(two), _id=ids[words.first_row + docs], place=place)

    found = in_arrow(held, edges, "one long, two long, _id long, place long")
    first = found.groupBy("one", "two").agg(F.count("*").alias("times"), F.min("_id").alias("source_id"), F.shiftright(F.min_by("place", "_id"), 32).alias("source_place")).where("times > 1").drop("times")
    later = found.join(first, ["one", "two"]).where("_id > source_id")
    later = later.groupBy("_id").agg(F.collect_list(F.struct("place", "source_id", "source_place")).alias("later"))
    return seen, copies, held.drop("runs"), later


def compact(places: np.ndarray, source_ids: np.ndarray, source_places: np.ndarray, window: int) -> np.ndarray:
    """Nonbranching paths among one text's later windows: rows of start, length in words, source id, source start."""
    if not len(places):
        return np.zeros((0, 4), np.int64)
    order = np.argsort(places, kind="stable")
    places, source_ids, source_places = places[order], source_ids[order], source_places[order]
    heads = np.flatnonzero(np.append(True, (np.diff(places) != 1) | (np.diff(source_ids) != 0) | (np.diff(source_places) != 1)))
    sizes = np.diff(np.append(heads, len(places)))
    return np.stack([places[heads], sizes + window - 1, source_ids[heads], source_places[heads]], axis=1)


def cut_texts(held: DataFrame, later: DataFrame, window: int) -> DataFrame:
    """_id, _key, kept_text, n_kept and spans of every text that loses words."""

    def task(rows: pa.RecordBatch):
        ids, lists = rows.column("_id"), rows.column("later")
        out = {"_id": [], "_key": [], "kept_text": [], "n_kept": [], "spans": []}
        for words in split_words(rows.column("text")):
            hashes = words.hashes(lower=False)
            keys, edges = text_key(words, hashes), rolling(hashes, window)
            for doc, (a, b) in enumerate(_bounds(words)):
                place = source_id = source_place = np.zeros(0, np.int64)
                if lists[words.first_row + doc].is_valid:
                    found = lists[words.first_row + doc].values
                    place = found.field("place").to_numpy()
                    own = (place & 0x7FFFFFFF) == int(keys[doc] & np.uint64(0x7FFFFFFF))
                    place, source_id, source_place = place[own] >> 32, found.field("source_id").to_numpy()[own], found.field("source_place").to_numpy()[own]
                start, stop = int(words.offsets[doc]), int(words.offsets[doc + 1]) - window + 1
                if stop > start:
                    _, first, inverse = np.unique(edges[start:stop], return_index=True, return_inverse=True)
                    self_place = np.setdiff1d(np.flatnonzero(first[inverse] != np.arange(stop - start)), place)
                    place = np.concatenate([place, self_place])
                    source_id = np.concatenate([source_id, np.full(len(self_place), ids[words.first_row + doc].as_py())])
                    source_place = np.concatenate([source_place, first[inverse][self_place]])
                spans = compact(place, source_id, source_place, window)
                if not len(spans):
                    continue
                listed = words.data[a:b].tobytes().split()
                change = np.zeros(len(listed) + 1, np.int64)
                np.add.at(change, spans[:, 0], 1)
                np.add.at(change, spans[:, 0] + spans[:, 1], -1)
                kept = [listed[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                out["_id"].append(ids[words.first_row + doc].as_py())
                out["_key"].append(int(signed(keys[doc : doc + 1])[0]))
                out["kept_text"].append(b" ".join(kept).decode())
                out["n_kept"].append(len(kept))
                out["spans"].append([dict(zip(("start", "n_words", "source_id", "source_start"), map(int, s), strict=True)) for s in spans])
        span = pa.struct([(n, pa.int64()) for n in ("start", "n_words", "source_id", "source_start")])
        types = {"_id": pa.int64(), "_key": pa.int64(), "kept_text": pa.string(), "n_kept": pa.int64(), "spans": pa.list_(span)}
        yield batch(**{n: pa.array(v, types[n]) for n, v in out.items()})

    schema = "_id long, _key long, kept_text string, n_kept long, spans array<struct<start: long, n_words: long, source_id: long, source_start: long>>"
    return in_arrow(held.join(later, "_id", "left"), task, schema)


def drop_repeats(df: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every document: doc_id, n_words, n_removed, kept_sha256, and where words went, kept_text and the spans (none for whole copies)."""
    seen, copies, held, later = later_windows(df, window, anchor, id_col, text_col)
    cut = checkpointed(cut_texts(held, later, window), "dedup-cut").distinct()
    whole = seen.join(copies.withColumn("_copy", F.lit(True)), ["_id", "_key"], "left").join(cut, ["_id", "_key"], "left")
    copy = F.coalesce("_copy", F.lit(False))
    kept = F.when(copy, 0).otherwise(F.coalesce("n_kept", "n_words"))
    text = F.when(copy, F.lit("")).otherwise(F.col("kept_text"))
    return whole.select(
        F.when(F.col("_id") != _NULL_ID, F.col("_id")).alias("doc_id"),
        "n_words",
        (F.col("n_words") - kept).alias("n_removed"),
        F.when(text.isNull(), F.col("whole_sha256")).otherwise(F.sha2(text, 256)).alias("kept_sha256"),
        text.alias("kept_text"),
        "spans",
        "_key",
    )


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` with repeated runs cut from their texts, and `n_chars`, where there is one, counted anew.

    A text that loses words becomes the kept words, joined by single spaces; others stay as they are.
    Rows that share an id must have one text (`one_of_each` sees to that).
    """
    key, kept = fresh(df, "cut_id"), fresh(df, "kept_text")
    cut = drop_repeats(df, id_col=id_col, text_col=text_col).where("n_removed > 0").groupBy(F.col("doc_id").alias(key)).agg(F.min("kept_text").alias(kept))
    rows = df.join(cut, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)), "left").withColumn(text_col, F.coalesce(kept, F.col(f"`{text_col}`")))
    if "n_chars" in df.columns:
        rows = rows.withColumn("n_chars", F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length(kept)).cast(df.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in df.columns])
