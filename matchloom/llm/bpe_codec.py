"""BPE encoding and decoding with a priority queue over a linked symbol list.

The vocabulary is a `tokenizers` JSON file of a BPE model with word ends, over byte-level characters,
after NFC, joining of white space and lower case.  White space never lies within a token, so texts are
put together from stretches without it, and those from pre-tokens.  A process remembers both together, in two generations
of bounded number and size, so that what stands often stays known and what stands once goes.  One scan, no shuffle.

Defined results: null or empty text has no ids and decodes to empty text; repeated rows are encoded
each; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from contextlib import contextmanager
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, in_arrow, remembered, texts

#: White space of the vocabulary's normaliser (the Unicode property), where Python's differs by the separators below.
_SPACES = regex.compile("[\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+")
_SEPARATORS = regex.compile("[\\x1C-\\x1F]")
#: Half of the stretches and pre-tokens that a generation of a process's memory holds, and of the characters that it and they may take.
KNOWN, KNOWN_CHARACTERS = 1 << 17, 16_000_000
#: Characters of a stretch that is remembered; longer ones, as texts without white space are, are put together from pre-tokens each time.
LONGEST_KNOWN = 64
#: Characters of results that are handed on at a time, about; a longer text's are handed on alone.
SLICE_CHARACTERS = 1 << 21
OWNER = "bpe codec"
#: Bits of an id within one number.
_ID = 24
#: Letters and numbers that Unicode has since version 17 and planned ones, as ranges.  The library's classes are
#: those of version 16, where they are neither.
_NEWER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: Capitals since version 16, and how far their small letters are from them.
_NEWER_CAPITALS = {0x1C89: 1, 0xA7CB: 0x264 - 0xA7CB, 0xA7CC: 1, 0xA7CE: 1, 0xA7D2: 1, 0xA7D4: 1, 0xA7DA: 1, 0xA7DC: 0x19B - 0xA7DC, **dict.fromkeys(range(0x10D50, 0x10D66), 32), **dict.fromkeys(range(0x16EA0, 0x16EB9), 27)}
_LOWERED = {c: c + d for c, d in _NEWER_CAPITALS.items()}
#: Marks that the library's normaliser doesn't know as such, as ranges, and one that it doesn't know to combine; to it they are letters.
_LATER_MARKS = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C),
    (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A),
    (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45),
    (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
)
_AT_LATER_MARKS = regex.compile("([" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _LATER_MARKS) + "])")
_NEWER_CLASS = "[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in _NEWER) + "]"
_CAPITALS = regex.compile("[" + "".join(map(chr, _LOWERED)) + "]")
_HAS_NEWER = regex.compile(_NEWER_CLASS)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself where it is visible, else the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in visible else next(others)) for b in range(256)]


class Memory(dict):
    """Remembers what was asked for lately: two generations, of which the older one goes when the younger one is full, by number or by characters; long keys are not kept."""

    def __init__(self, make, size: int = KNOWN, characters: int = KNOWN_CHARACTERS):
        self.make, self.size, self.most, self.held, self.old = make, size, characters, 0, {}

    def __missing__(self, key: str):
        return self.kept(key, self.old.get(key) or self.make(key))

    def kept(self, key: str, found: tuple[str, str]) -> tuple[str, str]:
        if len(key) > LONGEST_KNOWN:
            return found
        self.held += len(key) + len(found[0]) + len(found[1])
        if len(self) >= self.size or self.held > self.most:
            self.old, self.held = dict(self), 0
            self.clear()
        self[key] = found
        return found


class Codec:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, text: str):
        given = json.loads(text)
        model = given["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank by left and right id, as one number; and the merged id by rank.
        self.merges = {self.ids[a] << _ID | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [self.ids[a + b] for a, b in pairs]
        characters = byte_characters()
        self.inner = [self.ids[c] for c in characters]
        self.last = [self.ids[c + model["end_of_word_suffix"]] for c in characters]
        #: Rank by two bytes within a word, and at its end; -1 where they don't merge.
        self.first_ranks, self.last_ranks = ([[self.merges.get(a << _ID | b, -1) for b in ends] for a in self.inner] for ends in (self.inner, self.last))
        self.decimal = {i: str(i) for i in self.strings}
        pattern = given["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.cut = regex.compile(pattern)
        #: Letters alone are one pre-token then.
        self.runs_of_letters = "|[\\p{L}]+|" in pattern
        self.cut_newer = regex.compile(re.sub(r"\\p\{[LN]\}", lambda m: f"[{m[0]}--{_NEWER_CLASS}]", pattern), regex.V1)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        #: Of stretches and of pre-tokens: one that is a stretch by itself has the same ids.
        self.known = Memory(self.encode_stretch, 2 * KNOWN, 2 * KNOWN_CHARACTERS)

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token.

        The queue holds rank and place of pairs, as one number; `at` has the present pair's rank for
        each place, or -1, so that an entry that differs from it is stale.
        """
        data = piece.encode()
        n, final = len(data), data[-1]
        inner, ranks = self.inner, self.first_ranks
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[final]
        if n == 1:
            return symbols
        at = [ranks[a][b] for a, b in zip(data, data[1:], strict=False)]
        at[-1] = self.last_ranks[data[-2]][final]
        shift = n.bit_length()
        queue = [rank << shift | i for i, rank in enumerate(at) if rank >= 0]
        if not queue:
            return symbols
        at.append(-1)
        heapify(queue)
        find, merges, places = self.merges.get, self.merged, (1 << shift) - 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            i = entry & places
            rank = entry >> shift
            if at[i] != rank:
                continue
            j = after[i]
            k = after[i] = after[j]
            merged = symbols[i] = merges[rank]
            symbols[j] = at[j] = -1
            if k < n:
                before[k] = i
                at[i] = rank = find(merged << _ID | symbols[k], -1)
                if rank >= 0:
                    heappush(queue, rank << shift | i)
            else:
                at[i] = -1
            h = before[i]
            if h >= 0:
                at[h] = rank = find(symbols[h] << _ID | merged, -1)
                if rank >= 0:
                    heappush(queue, rank << shift | h)
        return [s for s in symbols if s >= 0]

    def shown(self, ids: list[int]) -> tuple[str, str]:
        """Ids in decimal, and their strings; each joined by spaces."""
        if len(ids) == 1:
            return self.decimal[ids[0]], self.strings[ids[0]]
        decimal, strings = self.decimal, self.strings
        return " ".join([decimal[i] for i in ids]), " ".join([strings[i] for i in ids])

    def encode_stretch(self, stretch: str) -> tuple[str, str]:
        """Ids of normalised text without white space, in decimal, and their strings; a space in front marks a special token."""
        if stretch[0] == " ":
            return str(self.special[stretch[1:]]), stretch[1:]
        if stretch.isascii():
            pieces = [stretch] if self.runs_of_letters and stretch.isalpha() else self.cut.findall(stretch)
        else:
            pieces = (self.cut_newer if _HAS_NEWER.search(stretch) else self.cut).findall(stretch)
        if len(pieces) == 1:
            return self.shown(self.encode_piece(pieces[0]))
        known = self.known
        ids, strings = zip(*[known.get(p) or known.kept(p, known.old.get(p) or self.shown(self.encode_piece(p))) for p in pieces], strict=True)
        return " ".join(ids), " ".join(strings)

    def decode(self, ids: list[int]) -> str:
        """The vocabulary's strings, joined by spaces as the file names no decoder."""
        return " ".join([self.strings[i] for i in ids])

    def stretches(self, text: str) -> list[str]:
        """Normalised stretches without white space; special tokens stand alone, as they are, marked by a space in front."""
        if self.specials is not None and "<|" in text:
            out = []
            for k, part in enumerate(self.specials.split(text)):
                out += [" " + part] if k % 2 else self._normalised(part)
            return out
        return self._normalised(text)

    @staticmethod
    def _normalised(text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = "".join([unicodedata.normalize("NFC", part) for part in _AT_LATER_MARKS.split(text)])
            text = text.replace("Σ", "σ")  # lower case is taken one character at a time, without final forms
            if _CAPITALS.search(text):
                text = text.translate(_LOWERED)
        if _SEPARATORS.search(text):
            return [s.lower() for s in _SPACES.split(text) if s]
        return text.lower().split()

    def encode(self, text: str) -> tuple[str, str]:
        """Ids of a text in decimal, and its decoded text."""
        found = list(map(self.known.__getitem__, self.stretches(text)))
        return " ".join([f[0] for f in found]), " ".join([f[1] for f in found])


@contextmanager
def no_collection():
    """Pauses the search for cycles: encoding makes none, and the search would walk all that the memories hold."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def codec_of(key: str, text) -> Codec:
    """The codec of this process for a vocabulary; it stays while this operator's tasks follow each other."""
    codecs = remembered(OWNER)
    if key not in codecs:
        codecs[key] = Codec(text())
    return codecs[key]


def encode_texts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; with `keep`, also `ids` (decimal, by spaces) and `decoded`."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    key = hashlib.sha256(shared.value.encode()).hexdigest()

    def task(rows: pa.RecordBatch):
        codec = codec_of(key, lambda: shared.value)
        first, column = 0, rows.column("text")
        while first < rows.num_rows:
            counts, of_ids, of_texts, all_ids, all_texts, held = [], [], [], [], [], 0
            with no_collection():
                for at in range(first, rows.num_rows):
                    ids, decoded = codec.encode(column[at].as_py() or "")
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    of_ids.append(hashlib.sha256(ids.encode()).hexdigest())
                    of_texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                    held += 128
                    if keep:
                        all_ids.append(ids)
                        all_texts.append(decoded)
                        held += len(ids) + len(decoded)
                    if held >= SLICE_CHARACTERS:
                        break
            out = {"doc_id": rows.column("doc_id").slice(first, len(counts)), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_texts, pa.string())}
            yield batch(**out, **({"ids": pa.array(all_ids, pa.string()), "decoded": pa.array(all_texts, pa.string())} if keep else {}))
            first += len(counts)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * keep
    return in_arrow(texts(df, id_col, text_col), task, schema, OWNER)
