"""Chat formatting as a prefix tree: conversations that share initial turns share their tokens.

A turn is written `### role: text</turn>` and a line end; a backslash stands before each control string inside roles and
texts (and before each backslash), which `unescape` takes back.  A node of the tree is a distinct
run of initial turns, named by two 64-bit hashes; its segment is its last turn.  Conversations are
sorted by their paths, so nodes in the order of the first conversation that holds them, and then of depth, are in
depth-first order, and each segment is emitted once.  Tokens are code points.  Each node carries:

- packed_start: its place in the emitted stream,
- position_start: the position id of its first token, its place in every conversation that holds it,
- loss_start, loss_end: the tokens of the segment under the loss mask (an assistant's text),
- attention: merged intervals of the stream that hold its ancestors; within the segment attention is causal.

The stream is emitted as pages of PAGE tokens, each with the segments in it.  A conversation is read back from its
last turn alone: the attention intervals of that node and the node's own tokens are its tokens, in order, and the pages
give them, with position ids and loss mask.  One sorted pass holds one turn at a time.  Only
8-byte names of a conversation's turns are ever gathered in one row, to sort by.  Shared first turns
combine before they are shuffled; places in the stream are sums over runs of 1024 conversations, and of 1024 such runs.

Defined results: null roles and texts are empty; turns are ordered by number (null first), then role and text,
repeated rows are turns each; a null id is a conversation of its own; further columns are ignored;
an empty table gives an empty tree.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, checkpointed

OPEN, CLOSE = "###", "</turn>"
LEARNED_ROLE = "assistant"
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_SEGMENT = re.compile(r"### ((?:[^\\:]|\\.)*): (.*)</turn>\n", re.DOTALL)
#: Conversations whose nodes are summed together, and runs of those, as powers of 2.
RUN_BITS = 10
#: Tokens of a page of the stream.
PAGE = 4096


def escaped(text: Column, role: bool = False) -> Column:
    for control in ("\\", OPEN, CLOSE, *([":"] if role else [])):
        text = F.replace(text, F.lit(control), F.lit("\\" + control))
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_segment(segment: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def keyed_turns(conversations: DataFrame) -> DataFrame:
    """Each turn with its depth, formatted segment, position, and the names of its node and that node's parent."""
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    ordered = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(OPEN + " "), escaped(F.col("role"), role=True), F.lit(": "))
    turns = turns.withColumn("depth", F.row_number().over(ordered)).withColumn("segment", F.concat(head, escaped(F.col("text")), F.lit(CLOSE + "\n")))
    learned = F.col("role") == LEARNED_ROLE
    tail = len(CLOSE) + 1
    turns = turns.withColumn("loss_start", F.when(learned, F.length(head)).otherwise(0)).withColumn("loss_end", F.when(learned, F.length("segment") - tail).otherwise(0))
    names = [F.bit_xor(F.xxhash64(F.lit(k), "depth", "role", "text")).over(so_far) for k in (1, 2)]
    turns = turns.withColumn("node", F.struct(names[0].alias("one"), names[1].alias("two")))
    position = F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0))
    return turns.withColumn("position_start", position).withColumn("parent", F.lag("node").over(ordered)).select("conv_id", "depth", "node", "parent", "segment", "loss_start", "loss_end", "position_start")


def prefix_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes (node, parent, depth, first, segment, loss_start, loss_end, position_start, packed_start), and paths (conv_id, place, depth, node)."""
    turns = checkpointed(keyed_turns(conversations), "chat-turns")
    paths = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    order = checkpointed(paths.orderBy("path", "conv_id").select("conv_id", F.monotonically_increasing_id().alias("place")), "chat-order")
    placed = turns.join(order.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
    same = [F.min(c).alias(c) for c in ("parent", "depth", "segment", "loss_start", "loss_end", "position_start")]
    nodes = placed.groupBy("node").agg(F.min("place").alias("first"), *same).withColumn("_run", F.shiftright("first", RUN_BITS))
    nodes = checkpointed(nodes.withColumn("_length", F.length("segment").cast("long")), "chat-nodes")
    runs = nodes.groupBy("_run").agg(F.sum("_length").alias("_sum")).withColumn("_many", F.shiftright("_run", RUN_BITS))
    many = runs.groupBy("_many").agg(F.sum("_sum").alias("_all"))  # a row for a million conversations
    rows_before = [Window.unboundedPreceding, -1]
    many = many.select("_many", F.coalesce(F.sum("_all").over(Window.orderBy("_many").rowsBetween(*rows_before)), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_many").orderBy("_run").rowsBetween(*rows_before)), F.lit(0))
    runs = runs.withColumn("_before", before).join(many, "_many").select("_run", (F.col("_base") + F.col("_before")).alias("_start"))
    within = F.sum("_length").over(Window.partitionBy("_run").orderBy("first", "depth").rowsBetween(*rows_before))
    nodes = nodes.withColumn("_within", F.coalesce(within, F.lit(0))).join(runs, "_run").withColumn("packed_start", F.col("_start") + F.col("_within"))
    return nodes.drop("_run", "_length", "_start", "_within"), placed.select("conv_id", "place", "depth", "node")


def emitted(nodes: DataFrame) -> DataFrame:
    """The packed stream: page, text (its tokens, once each), and the segments in it (start, stop, position, loss_start, loss_stop), all by place in the stream but `position`."""
    start, stop = F.col("packed_start"), F.col("packed_start") + F.length("segment")
    pages = nodes.select("segment", start.alias("start"), stop.alias("stop"), F.col("position_start").alias("position"), (start + F.col("loss_start")).alias("loss_start"), (start + F.col("loss_end")).alias("loss_stop"))
    pages = pages.withColumn("page", F.explode(F.expr(f"sequence(start div {PAGE}, (stop - 1) div {PAGE})")))
    piece = F.expr(f"substring(segment, int(greatest(page * {PAGE} - start, 0)) + 1, int(least(stop, (page + 1) * {PAGE}) - greatest(start, page * {PAGE})))")
    parts = F.sort_array(F.collect_list(F.struct("start", "stop", "position", "loss_start", "loss_stop", piece.alias("piece"))))
    pages = pages.groupBy("page").agg(parts.alias("parts"))
    return pages.select("page", F.concat_ws("", F.transform("parts", lambda p: p.piece)).alias("text"), F.transform("parts", lambda p: p.dropFields("piece")).alias("segments"))


def with_attention(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes with `attention`, in the stream's order within each partition."""

    def walk(batches):
        place, spans = None, []
        for rows in batches:
            out = []
            for row in rows.to_pylist():
                if row["place"] != place:
                    place, spans = row["place"], []
                if row["first"] == place:
                    out.append((row["node"], [dict(start=a, stop=b) for a, b in spans]))
                start, stop = row["packed_start"], row["packed_start"] + row["size"]
                spans = [*spans[:-1], (spans[-1][0], stop)] if spans and spans[-1][1] == start else [*spans, (start, stop)]
            yield batch(
                node=pa.array([o[0] for o in out], pa.struct([("one", pa.int64()), ("two", pa.int64())])),
                attention=pa.array([o[1] for o in out], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            )

    spans = nodes.select("node", "first", "packed_start", F.length("segment").alias("size"))
    rows = paths.join(spans, "node").select("place", "depth", "first", "packed_start", "node", "size").repartition("place").sortWithinPartitions("place", "depth")
    found = rows.mapInArrow(walk, "node struct<one: long, two: long>, attention array<struct<start: long, stop: long>>")
    return nodes.join(found, "node").sortWithinPartitions("packed_start")


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, read from the emitted stream.

    `nodes`: with attention.
    """
    last = paths.groupBy("place", "conv_id").agg(F.max_by("node", "depth").alias("node"))
    own = F.array(F.struct(F.col("packed_start").alias("start"), (F.col("packed_start") + F.length("segment")).alias("stop")))
    spans = last.join(nodes.select("node", F.concat("attention", own).alias("spans")), "node").select("place", "conv_id", F.inline("spans"))
    asked = spans.withColumn("page", F.explode(F.expr(f"sequence(start div {PAGE}, (stop - 1) div {PAGE})")))
    asked = asked.select("place", "conv_id", "page", F.greatest("start", F.col("page") * PAGE).alias("start"), F.least("stop", (F.col("page") + 1) * PAGE).alias("stop"))
    pieces = asked.join(emitted(nodes), "page").select(
        "place", "conv_id", "start", F.expr(f"substring(text, int(start - page * {PAGE}) + 1, int(stop - start))").alias("text"),
        F.filter("segments", lambda s: (s.start < F.col("stop")) & (s.stop > F.col("start"))).alias("segments"),
    )

    def walk(batches):
        place, state, held = None, None, []

        def closed(state):
            conv_id, turns, all_, learned, chars, formatted = state
            return dict(conv_id=conv_id, n_turns=turns, turns_sha256=all_.hexdigest(), loss_chars=chars, loss_sha256=learned.hexdigest(), formatted_chars=formatted)

        def shown(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

        for rows in batches:
            out = []
            for row in rows.to_pylist():
                if row["place"] != place:
                    if state:
                        out.append(closed(state))
                    place, state, held = row["place"], [row["conv_id"], 0, hashlib.sha256(), hashlib.sha256(), 0, 0], []
                start, stop = row["start"], row["start"] + len(row["text"])
                for s in row["segments"]:
                    first, end = max(s["start"], start), min(s["stop"], stop)
                    if s["position"] + first - s["start"] != state[5]:
                        raise ValueError("positions do not join")
                    held.append(row["text"][first - start : end - start])
                    state[5] += end - first
                    if end < s["stop"]:
                        continue
                    segment, held = "".join(held), []
                    role, text = parse_segment(segment)
                    masked = unescape(segment[s["loss_start"] - s["start"] : s["loss_stop"] - s["start"]])
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    state[3].update(masked.encode())
                    state[4] += len(masked)
            yield shown(out)
        if state:
            yield shown([closed(state)])

    rows = pieces.repartition("place").sortWithinPartitions("place", "start")
    return rows.mapInArrow(walk, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted_digest(conversations: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from the emitted stream."""
    nodes, paths = prefix_tree(conversations)
    nodes, paths = checkpointed(nodes, "chat-stream"), checkpointed(paths, "chat-paths")
    return read_back(checkpointed(with_attention(nodes, paths), "chat-attention"), paths)
