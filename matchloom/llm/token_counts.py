"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens at spaces, which no vocabulary piece crosses; the distinct pre-tokens
of a batch are held as one ragged array of symbols.  In every round each sequence applies its own
lowest-rank pair at all places at once, and sequences without a pair drop out; what survives is
counted.  One scan, no shuffle: a task's memory depends on its slice of text alone.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import batch, in_arrow, texts

SPACE = "▁"
#: Bytes of text whose distinct pre-tokens are merged together.
SLICE_BYTES = 12 << 20
#: Counted pre-tokens that a process remembers.
KNOWN = 300_000
_NONE = np.int32(2**31 - 1)


@dataclass
class PieceTable:
    """A sentencepiece BPE vocabulary as arrays.  Pairs are keyed left * size + right."""

    size: int
    symbol_of_char: np.ndarray  # by code point; -1: not in the vocabulary
    keys: np.ndarray  # of the pairs, sorted
    ranks: np.ndarray
    merged: np.ndarray
    char_class: np.ndarray  # by code point: a small number for each that pieces hold, else 0
    beside: np.ndarray  # bits by class and class: the two stand side by side in some piece
    space_sizes: frozenset  # lengths of the pieces made of spaces alone, which all rank last and alike
    known: dict = field(default_factory=dict)  # pre-tokens that this process has counted, at most KNOWN
    _runs: dict = field(default_factory=dict)

    def space_run(self, length: int) -> int:
        """Pieces of so many bare spaces: of equal ranks the leftmost pair goes first, so one piece grows at a time.

        Where the piece cannot grow by one space, the spaces behind it join each other until it can take them whole.
        """
        if length not in self._runs:
            done: list[int] = []  # sizes of pieces from the left; only the last two can still change
            for _ in range(length):
                done.append(1)
                while len(done) > 1 and done[-2] + done[-1] in self.space_sizes:
                    done[-2:] = [done[-2] + done[-1]]
            self._runs[length] = len(done)
        return self._runs[length]

    @classmethod
    def load(cls, path: str) -> PieceTable:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = {model.id_to_piece(i): i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        order = sorted(pieces, key=lambda p: -model.get_score(pieces[p]))
        chars = np.full(0x110000, -1, np.int32)
        pairs, adjacent = {}, set()
        classes = np.zeros(0x110000, np.int32)
        held = sorted({ord(c) for piece in pieces for c in piece})
        classes[held] = np.arange(1, len(held) + 1)
        for rank, piece in enumerate(order):
            if len(piece) == 1:
                chars[ord(piece)] = pieces[piece]
            elif piece.strip(SPACE):
                for k in range(1, len(piece)):
                    adjacent.add((ord(piece[k - 1]), ord(piece[k])))
                    if piece[:k] in pieces and piece[k:] in pieces:
                        pairs[pieces[piece[:k]] * size + pieces[piece[k:]]] = (rank, pieces[piece])
        keys = np.array(sorted(pairs), np.int64)
        values = np.array([pairs[k] for k in keys.tolist()], np.int32).reshape(-1, 2)
        beside = np.zeros((len(held) + 1) ** 2, bool)
        left, right = classes[np.array(sorted(adjacent)).T].astype(np.int64)
        beside[left * (len(held) + 1) + right] = True
        return cls(size, chars, keys, values[:, 0].copy(), values[:, 1].copy(), classes, np.packbits(beside), frozenset(len(p) for p in pieces if not p.strip(SPACE)))

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; the rank of no pair is the largest."""
        key = left.astype(np.int64) * self.size + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]


def merge_all(table: PieceTable, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that survive in each sequence, and the first of them.  `starts`: the first symbol of each, none empty."""
    n = len(starts)
    left_over, first = np.ones(n, np.int64), symbols[starts].copy()
    if not n:
        return left_over, first
    lengths = np.diff(np.append(starts, len(symbols)))
    owner = np.repeat(np.arange(n), lengths)
    symbols = symbols.copy()
    rank, merged = _pair_ranks(table, symbols, owner)
    while len(symbols):
        begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(begins, len(symbols)))
        lowest = np.minimum.reduceat(rank, begins)
        done = lowest == _NONE
        if done.any():
            ended = owner[begins[done]]
            left_over[ended], first[ended] = sizes[done], symbols[begins[done]]
            keep = np.repeat(~done, sizes)
            symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
            lowest, sizes = lowest[~done], sizes[~done]
            if not len(symbols):
                break
        at = np.flatnonzero(rank == np.repeat(lowest, sizes))
        fresh = np.append(True, np.diff(at) != 1)  # of overlapping places every other one counts, from the left
        run = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[run % 2 == 0]
        symbols[at] = merged[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        moved = np.cumsum(keep) - 1
        symbols, owner, rank, merged = symbols[keep], owner[keep], rank[keep], merged[keep]
        at = moved[at]
        again = np.zeros(len(symbols), bool)
        again[at] = again[np.maximum(at - 1, 0)] = True
        touched = np.flatnonzero(again)
        rank[touched], merged[touched] = _pair_ranks(table, symbols, owner, touched)
    return left_over, first


def _pair_ranks(table: PieceTable, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(len(symbols)) if at is None else at
    after = np.minimum(at + 1, len(symbols) - 1)
    rank, merged = table.lookup(symbols[at], symbols[after])
    rank[(owner[at] != owner[after]) | (after == at)] = _NONE
    return rank, merged


def word_counts(table: PieceTable, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each pre-token, a space and then the word: symbols without a bare space in front, and whether one is in front."""
    joined = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(words)
    points = np.empty(len(joined) + n, np.int64)
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    inner = np.ones(len(points), bool)
    inner[begins] = False
    points[begins], points[inner] = ord(SPACE), joined
    word = np.repeat(np.arange(n), lengths + 1)
    symbols = table.symbol_of_char[points]
    utf8 = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
    unknown = symbols < 0
    # A sequence ends wherever no piece holds the two code points side by side: no merge can cross there.
    of = table.char_class[points]
    at = of[:-1].astype(np.int64) * (int(table.char_class.max()) + 1) + of[1:]
    apart = (table.beside[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 0
    cut = np.append(True, apart) if len(points) else np.zeros(0, bool)
    cut[begins] = True
    keep = ~unknown
    fresh = np.logical_or(cut, np.append(False, unknown[:-1])) if len(points) else cut
    starts = np.flatnonzero(fresh[keep])
    left_over, first = merge_all(table, symbols[keep], starts)
    owner = word[keep][starts]
    total = np.bincount(owner, left_over, n).astype(np.int64) + np.bincount(word[unknown], utf8[unknown], n).astype(np.int64)
    bare = first[np.searchsorted(owner, np.arange(n))] == table.symbol_of_char[ord(SPACE)] if n else np.zeros(0, bool)
    return total - bare, bare


def known_counts(table: PieceTable, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """As word_counts; each process counts a word that it has met lately only once."""
    known, listed = table.known, words.to_pylist()
    if len(known) > KNOWN:
        known.clear()
    got = np.array([known.get(w, -1) for w in listed], np.int64)
    new = np.flatnonzero(got < 0)
    if len(new):
        total, bare = word_counts(table, words.take(pa.array(new)))
        got[new] = total * 2 + bare
        known.update(zip([listed[i] for i in new], got[new].tolist(), strict=True))
    return got >> 1, (got & 1).astype(bool)


def slice_counts(table: PieceTable, column: pa.Array) -> np.ndarray:
    """Tokens of each text."""
    lists = pc.split_pattern(pc.replace_substring(column, SPACE, " "), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    encoded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    total, bare = known_counts(table, encoded.dictionary)
    empty = pc.equal(encoded.dictionary, "").to_numpy(zero_copy_only=False)
    index = encoded.indices.to_numpy()
    counts = np.append(0, np.cumsum(np.where(empty, 0, total)[index]))
    out = counts[offsets[1:]] - counts[offsets[:-1]]
    # Bare spaces, left by empty words and by words whose first character takes none, join into runs.
    lone, blank = (empty | bare)[index], empty[index]
    if lone.any():
        row = np.repeat(np.arange(len(out)), np.diff(offsets))
        at = np.flatnonzero(lone)
        follows = np.append(False, (at[1:] == at[:-1] + 1) & (row[at[1:]] == row[at[:-1]]) & blank[at[:-1]])
        run = np.cumsum(~follows) - 1
        sizes, inverse = np.unique(np.bincount(run), return_inverse=True)
        np.add.at(out, row[at[~follows]], np.array([table.space_run(int(x)) for x in sizes])[inverse])
    out[pc.equal(column, "").to_numpy(zero_copy_only=False)] = 0
    return out


def count_tokens(df: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; `limit`: of tokens."""
    shared = df.sparkSession.sparkContext.broadcast(PieceTable.load(model_path))

    def task(rows: pa.RecordBatch):
        column = rows.column("text").fill_null("")
        sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, row, counts = np.cumsum(sizes), 0, []
        while row < len(column):
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + SLICE_BYTES, "right")))
            counts.append(slice_counts(shared.value, column.slice(row, stop - row)))
            row = stop
        counts = np.concatenate([*counts, np.zeros(0, np.int64)])
        yield batch(doc_id=rows.column("doc_id"), n_bytes=sizes, n_tokens=counts, over_limit=counts > limit)

    return in_arrow(texts(df, id_col, text_col), task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
