"""Language-model scoring with a hierarchical Pitman-Yor model.

Each word, and the begin of a text, has a restaurant of its own, for what follows it; all of
them share one parent, the root, whose base gives half to the one unknown word and half evenly to the known
ones.  Every table of a context restaurant sends one customer to the root.

Seating.  Counts by word and context cover all training documents.  They are dealt by word, so that a
word's seats in all restaurants lie together, and each deal runs its own Gibbs chain: a sweep seats all
customers of each word and context anew at once, under the shares that the rest of the seating gives: with
weight w of a new table, c customers have k tables with odds w^k S(c, k), S being generalised Stirling
numbers of the discount; the root's seats of a word are then drawn anew in sequence.  Of the
restaurants' totals a deal knows the customers and word types of all deals; their tables follow from its own state.
A pair that occurs once has one table in every state: it is not dealt, and its customer goes to the root at once.
The root's shares of words and the shares that contexts give to the root are averaged over SAMPLES states of the chains, with the
true totals.

Scoring.  A token's probability is its word's share in the root, times what its context gives to the root, and what the pair's own
tables give it.  The shares of the 8 * FREQUENT most frequent words and the seats of as many pairs (bounded tables) are
broadcast; other words' shares are joined to the texts that have them, as lists.  A scan sums the logarithms of what it knows and
deals the other tokens by pair, as packed bytes: the hash of the pair and what a seat is worth there.  There they meet the seats of pairs
that occur more than once; one that occurs once shows as such by its tokens, so that no table has a row for each pair.  Discounts follow from
the counts of counts.

Defined results: null or empty text is its end token alone; rows that share an id are scored each, all in
the id's fold (rows that share id and text are told by that, and get what one of them gets); a null id's fold is that of empty text; with no training rows every token has base
score 0; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import batch, checkpointed, counted, discarded, fold, forget_others, give_back, in_arrow, texts
from .words import mix, signed, split_words

#: In a chain's rows, the mark of a word's whole count; restaurants have the other numbers.
ROOT = 63
FREQUENT = 1 << 17
SAMPLES, BURN_IN = 4, 4
#: Counts dealt to one chain, about.
DEAL = 150_000
STRENGTH = 1.0
END = int(mix(np.array([0x454E44], np.uint64))[0])
BEGIN = int(mix(np.array([0x424547], np.uint64))[0])
#: With so many customers a restaurant's own tables count as much as those of its whole deal.
POOLED = 10
#: Distinct keys that a task sums, or tokens that it deals, before it hands them on.
PENDING = 1_000_000
#: Tokens of one slot, about.
SLOT = 1_000_000
#: Steps of the Stirling numbers between two that take logarithms; numbers grow by far less than doubles hold.
STEPS = 24


def tokens(column: pa.Array):
    """(first row, token hashes, offsets): the words of each text, A-Z lowered, and its end."""
    for words in split_words(column):
        counts = words.counts
        offsets = np.append(0, np.cumsum(counts + 1))
        out = np.full(offsets[-1], END, np.uint64)
        inner = np.ones(len(out), bool)
        inner[offsets[1:] - 1] = False
        out[inner] = words.hashes(lower=True)
        yield words.first_row, out, offsets


def contexts_of(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The word before each token, or BEGIN."""
    out = np.full(len(hashes), BEGIN, np.uint64)
    out[1:] = hashes[:-1]
    out[offsets[:-1]] = BEGIN
    return out


def pair_keys(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return mix(words ^ mix(contexts + np.uint64(0x9E3779B97F4A7C15)))


def summed(df: DataFrame, keys, schema: str) -> DataFrame:
    """Counts of the key columns that `keys(rows)` yields, summed in each task in bounded portions."""

    def add(parts):
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort(columns[-2::-1])
        columns = [c[order] for c in columns]
        fresh = np.zeros(len(order), bool)
        fresh[:1] = True
        for c in columns[:-1]:
            fresh[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(fresh)
        return [*(c[heads] for c in columns[:-1]), np.add.reduceat(columns[-1], heads) if len(heads) else columns[-1]]

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        parts, held = [], 0
        for rows in batches:
            for found in keys(rows):
                parts.append(add([(*found, np.ones(len(found[0]), np.int64))]))
                held += len(parts[-1][0])
                if held > PENDING:
                    parts = [add(parts)]
                    held = len(parts[0][0])
                    if held > PENDING // 2:
                        yield batch(**dict(zip(names, parts[0], strict=True)))
                        parts, held = [], 0
        if parts:
            yield batch(**dict(zip(names, add(parts), strict=True)))

    return df.mapInArrow(run, schema)


def table_estimate(customers: np.ndarray, weight: np.ndarray, discount: float) -> np.ndarray:
    """Tables that so many customers of one dish take on average, new ones having `weight`: Euler steps of 1/8 in the logarithm."""
    tables, k = np.ones(len(customers)), np.ones(len(customers))
    while (open_ := k < customers).any():
        step = np.where(open_, np.minimum(np.maximum(k / 8, 1), customers - k), 0)
        tables += step * weight / np.maximum(k - discount * tables + weight, 1e-9)
        k += step
    return np.clip(np.round(tables), 1, customers).astype(np.int64)


class Seats:
    """Table sizes of dishes with at least 2 customers, moved one customer at a time: what the tests hold `Tables` against.

    Up to `width` tables each, and the rest, which stay, as sums.
    """

    def __init__(self, customers: np.ndarray, tables: np.ndarray, width: int):
        n = len(customers)
        own = np.minimum(tables, width)
        each, extra = customers // np.maximum(tables, 1), customers % np.maximum(tables, 1)
        slot = np.arange(width)[None, :]
        self.sizes = np.where(slot < own[:, None], each[:, None] + (slot < extra[:, None]), 0)
        self.rest = customers - self.sizes.sum(1)
        self.rest_tables = tables - own
        self.rows = np.arange(n)

    def tables(self) -> np.ndarray:
        return (self.sizes > 0).sum(1) + self.rest_tables

    def step(self, weight: np.ndarray, discount: float, rng: np.random.Generator) -> None:
        """One customer of each dish leaves a table and sits down again; `weight`: of a new table."""
        sizes, rows = self.sizes, self.rows
        cumulative = np.cumsum(sizes, axis=1)
        total = cumulative[:, -1]
        movable = total > 0
        left = (cumulative <= (rng.random(len(rows)) * total)[:, None]).sum(1).clip(0, sizes.shape[1] - 1)
        sizes[rows, left] -= movable
        attraction = np.concatenate([np.where(sizes > 0, sizes - discount, 0), np.where(self.rest_tables > 0, self.rest - discount * self.rest_tables, 0)[:, None], weight[:, None]], axis=1)
        cumulative = np.cumsum(attraction, axis=1)
        at = (cumulative <= (rng.random(len(rows)) * cumulative[:, -1])[:, None]).sum(1).clip(0, sizes.shape[1] + 1)
        width = sizes.shape[1]
        free = np.argmin(sizes > 0, axis=1)
        full = (sizes > 0).all(axis=1)
        new = at == width + 1
        slot = np.where(new, free, np.minimum(at, width - 1))
        to_rest = ((at == width) | (new & full)) & movable
        sizes[rows, slot] += movable & ~to_rest
        self.rest += to_rest
        self.rest_tables += to_rest & new


class Tables:
    """Draws of how many tables the customers of each dish take, all of them seated anew."""

    def __init__(self, customers: np.ndarray, discount: float, tables: np.ndarray):
        self.n, self.discount, self.groups = len(customers), discount, []
        bits = np.ceil(np.log2(customers)).astype(np.int64) if self.n else customers
        for b in np.unique(bits):
            rows = np.flatnonzero(bits == b)
            sizes, at = np.unique(customers[rows], return_inverse=True)
            width = min(int(sizes[-1]), 2 * int(tables[rows].max()) + 32)
            self.groups.append([rows, sizes, at, self.stirling(sizes, width)])

    def stirling(self, sizes: np.ndarray, width: int) -> np.ndarray:
        """Logarithms of the generalised Stirling numbers of each of the ascending sizes and 1 to `width` tables."""
        out, k = np.empty((len(sizes), width)), np.arange(1, width + 1)
        row, done, c = np.full(width, -np.inf), 0, 1
        row[0] = 0
        while True:
            if c == sizes[done]:
                out[done] = row
                done += 1
                if done == len(sizes):
                    return out
            if c >= width:
                break
            stay = row[: c + 1] + np.log(np.maximum(c - self.discount * k[: c + 1], 1e-300))
            stay[1:] = np.logaddexp(stay[1:], row[:c])
            row[: c + 1] = stay
            c += 1
        # Every number is above 0 now: a few steps at a time are taken on multiples of those at their start, without logarithms.
        gone, part, moved, factor = self.discount * k, np.empty(width), np.empty(width - 1), np.empty(width)
        left, right, wanted = part[:-1], part[1:], sizes.tolist()
        while True:
            part[:], from_left = 1, np.exp(row[:-1] - row[1:])
            for _ in range(STEPS):
                np.multiply(left, from_left, out=moved)
                np.subtract(c, gone, out=factor)
                np.multiply(part, factor, out=part)
                np.add(right, moved, out=right)
                c += 1
                if c == wanted[done]:
                    out[done] = row + np.log(part)
                    done += 1
                    if done == len(wanted):
                        return out
            row = row + np.log(part)

    def draw(self, weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Tables of each dish; `weight`: of a new table."""
        out, log_weight = np.ones(self.n, np.int64), np.log(weight)
        for group in self.groups:
            rows, sizes, at, _ = group
            step = max(1, (1 << 21) // group[3].shape[1])
            first = 0
            while first < len(rows):
                own = slice(first, first + step)
                odds = group[3][at[own]] + log_weight[rows[own], None] * np.arange(1, group[3].shape[1] + 1)
                # Where more tables than the width have a share that doubles can tell, it is doubled.
                if group[3].shape[1] < sizes[-1] and (odds[:, -1] > odds.max(axis=1) - 40).any():
                    group[3] = self.stirling(sizes, min(int(sizes[-1]), 2 * group[3].shape[1]))
                    step = max(1, (1 << 21) // group[3].shape[1])
                    continue
                out[rows[own]] = np.argmax(odds + rng.gumbel(size=odds.shape), axis=1) + 1
                first += step
        return out


@dataclass
class Totals:
    """What a chain knows of all deals: by context the word types and tokens; all tokens and types; the discounts; types and tokens of contexts without rows here."""

    types: np.ndarray
    customers: np.ndarray
    n: int
    v: int
    discount: float
    root_discount: float
    elsewhere: tuple[int, int] = (0, 0)

    @property
    def base(self) -> float:
        return 0.5 / self.v if self.v else 0.0


def chain(word: np.ndarray, context: np.ndarray, count: np.ndarray, totals: Totals, seed: list[int]) -> dict[str, np.ndarray]:
    """Gibbs chain over one deal.  `word`: the number of each row's word, ascending; rows of ROOT have the words' whole counts.
    What a word's count has beyond its pairs (those that occur once need no row) are customers of the root in every state.

    Gives the pairs' word, context, count and tables by sample, and the words' root customers and tables by sample.
    """
    rng = np.random.default_rng(seed)
    whole = count[context == ROOT]
    pair = context != ROOT
    word, context, count = word[pair], context[pair], count[pair]
    words = len(whole)
    direct = whole - np.bincount(word, count, words).astype(np.int64)
    d, d0 = totals.discount, totals.root_discount
    restaurants = len(totals.types)
    own_more = np.bincount(context, count - 1, restaurants)
    tables = np.ones(len(word), np.int64)
    direct_all = totals.n - int(totals.customers.sum()) - totals.elsewhere[1]
    root_tables = np.ones(words, np.int64)
    many = count > 1

    def shares() -> tuple[np.ndarray, np.ndarray]:
        """Each pair's weight of a new table, and each word's root customers."""
        more = np.bincount(context, tables - 1, restaurants)
        pooled = more.sum() / max(own_more.sum(), 1)
        all_tables = totals.types + (totals.customers - totals.types) * (more + POOLED * pooled) / (own_more + POOLED)
        elsewhere = totals.elsewhere[0] + (totals.elsewhere[1] - totals.elsewhere[0]) * pooled
        root = direct + np.bincount(word, tables, words).astype(np.int64)
        root_all = direct_all + all_tables.sum() + elsewhere
        root_share = (root - d0 * root_tables + (STRENGTH + d0 * totals.v * root_tables.mean() if words else 0) * totals.base) / (root_all + STRENGTH)
        return (STRENGTH + d * all_tables)[context] * root_share[word], root

    weight, _ = shares()
    tables[many] = table_estimate(count[many].astype(float), weight[many], d)
    seats = Tables(count[many], d, tables[many])
    kept_tables, kept_root, kept_root_tables = [], [], []
    for sweep in range(BURN_IN + SAMPLES):
        weight, root = shares()
        tables[many] = seats.draw(weight[many], rng)
        root = direct + np.bincount(word, tables, words).astype(np.int64)
        root_tables = root_seats(root, (STRENGTH + d0 * totals.v * root_tables.mean() if words else 0) * totals.base, d0, rng)
        if sweep >= BURN_IN:
            kept_tables.append(tables.copy())
            kept_root.append(root)
            kept_root_tables.append(root_tables)
    return {"word": word, "context": context, "count": count, "whole": whole, "tables": np.stack(kept_tables, 1), "root": np.stack(kept_root, 1), "root_tables": np.stack(kept_root_tables, 1)}


def root_seats(customers: np.ndarray, weight: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each word in the root: its customers sit down in sequence, those beyond the 32nd as a Poisson number of new tables."""
    tables = np.minimum(customers, 1)
    for k in range(1, 32):
        more = np.flatnonzero(customers > k)
        if not len(more):
            break
        new = rng.random(len(more)) * (k - discount * tables[more] + weight) < weight
        tables[more] += new
    far = np.flatnonzero(customers > 32)
    tables[far] += rng.poisson(weight * np.log((customers[far] + weight) / (32 + weight)))
    return np.minimum(tables, customers)


@dataclass
class Predictive:
    """Averages over the samples: by restaurant and sample the share that goes to the root, and the root's own shares."""

    totals: Totals
    tables: np.ndarray  # restaurants x samples
    root_customers: np.ndarray | None = None  # by sample; without them and the root's tables, `tables` are those of all, and has the root's in ROOT
    root_tables: np.ndarray | None = None

    def __post_init__(self):
        t, self.samples, inner = self.totals, self.tables.shape[1], self.tables
        if self.root_customers is None:
            inner, self.root_tables = inner.copy(), inner[ROOT]
            inner[ROOT] = 0
            self.root_customers = t.n - t.customers.sum() + inner.sum(0)
        self.beta = (STRENGTH + t.discount * inner) / (t.customers + STRENGTH)[:, None]
        if inner is not self.tables:
            self.beta[ROOT] = 1
        self.new = (STRENGTH + t.root_discount * self.root_tables) / (self.root_customers + STRENGTH)
        self.unknown = self.new * (0.5 if t.v else 1.0)

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Words x samples: the root's predictive probability."""
        return (customers - self.totals.root_discount * tables) / (self.root_customers + STRENGTH) + self.new * self.totals.base

    def seats(self, context: np.ndarray, count: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """What a word's own tables give it in a context, besides the root's part."""
        return (count - self.totals.discount * tables.mean(1)) / (self.totals.customers[context] + STRENGTH)


def count_unigrams(train: DataFrame) -> DataFrame:
    def words(rows):
        for _, hashes, _ in tokens(rows.column("text")):
            yield (signed(hashes),)

    return summed(train, words, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))


def packed(slot: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """A row for each slot that occurs, with its part of each column (of one or more values for each entry) as bytes, in the order given."""
    order = np.argsort(slot, kind="stable")
    slots, firsts = np.unique(slot[order], return_index=True)
    bounds = np.append(firsts, len(slot))

    def as_bytes(values: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(values[order])
        return pa.Array.from_buffers(pa.binary(), len(slots), [None, pa.py_buffer((bounds * (values.nbytes // max(len(values), 1))).astype(np.int32)), pa.py_buffer(values)])

    return {"slot": pa.array(slots, pa.int32()), **{k: as_bytes(v) for k, v in columns.items()}}


def unpacked(rows: pa.Table, name: str, kind) -> np.ndarray:
    """All values of a column of bytes, one row after the other."""
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in rows.column(name) if x.is_valid)])


def slot_of(keys: np.ndarray, slots: int) -> np.ndarray:
    return (mix(keys) >> np.uint64(32)).astype(np.int64) % slots


def runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(fresh)


def added(values: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the runs that begin at `heads`."""
    return np.add.reduceat(values, heads, axis=0) if len(heads) else values[:0]


def filled(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A batch of the schema, null in columns that are not given."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


_COUNTED = pa.schema([(x, pa.int64()) for x in ("word", "context", "count")] + [("slot", pa.int32())] + [(x, pa.binary()) for x in ("contexts", "types", "customers", "alone")])
_COUNTED_SQL = "word long, context long, count long, slot int, contexts binary, types binary, customers binary, alone binary"


def count_pairs(train: DataFrame, slots: int) -> DataFrame:
    """Rows with word, context and count of each pair that occurs more than once; and rows with parts of the contexts' sums over all pairs, by slots, for `sum_contexts`.

    Pairs are dealt by both their words, so that no slot holds a whole frequent word.
    """

    def deal(batches):
        parts, held = [], 0

        def pack():
            words, contexts = (np.concatenate(x) for x in zip(*parts, strict=True))
            keys = pair_keys(words, contexts)
            order = np.argsort(keys)
            heads = runs(keys[order])
            at, times = order[heads], np.diff(np.append(heads, len(keys)))
            at, times = (x[by] for by in [np.argsort(words[at])] for x in (at, times))  # equal words side by side take few bytes
            return batch(**packed(slot_of(keys[at], slots), words=words[at], contexts=contexts[at], times=times.astype(np.int32)))

        for rows in batches:
            for _, hashes, offsets in tokens(rows.column("text")):
                parts.append((hashes, contexts_of(hashes, offsets)))
                held += len(hashes)
                if held >= PENDING:
                    yield pack()
                    parts, held = [], 0
        if held:
            yield pack()

    def count(rows: pa.Table) -> pa.Table:
        words, contexts, times = (unpacked(rows, n, k) for n, k in (("words", np.uint64), ("contexts", np.uint64), ("times", np.int32)))
        keys = pair_keys(words, contexts)
        order = np.argsort(keys)
        heads = runs(keys[order])
        counts, words, contexts = added(times[order].astype(np.int64), heads), words[order[heads]], contexts[order[heads]]
        many = counts > 1
        pairs = filled(_COUNTED, word=signed(words[many]), context=signed(contexts[many]), count=counts[many])
        order = np.argsort(contexts)
        heads = runs(contexts[order])
        names, types = contexts[order[heads]], np.diff(np.append(heads, len(contexts)))
        sums = packed(slot_of(names, slots), contexts=names, types=types.astype(np.int32), customers=added(counts[order], heads), alone=added((~many[order]).astype(np.int64), heads).astype(np.int32))
        return pa.Table.from_batches([pairs, filled(_COUNTED, **sums)])

    return train.mapInArrow(deal, "slot int, words binary, contexts binary, times binary").groupBy("slot").applyInArrow(count, _COUNTED_SQL)


def sum_contexts(found: DataFrame) -> DataFrame:
    """context, types, customers and alone (pairs that occur once) of every context, from the parts of `count_pairs`."""

    def add(rows: pa.Table) -> pa.Table:
        names = unpacked(rows, "contexts", np.uint64)
        order = np.argsort(names)
        heads = runs(names[order])
        sums = {n: added(unpacked(rows, n, k)[order].astype(np.int64), heads) for n, k in (("types", np.int32), ("customers", np.int64), ("alone", np.int32))}
        return pa.Table.from_batches([batch(context=signed(names[order[heads]]), **sums)])

    parts = found.where("slot IS NOT NULL").select("slot", "contexts", "types", "customers", "alone")
    return parts.groupBy("slot").applyInArrow(add, "context long, types long, customers long, alone long")


_MODEL = "word long, context long, count long, tables array<int>, root_tables array<int>"


def seat_all(counts: DataFrame, totals: Totals, all_types: int, seed: int) -> DataFrame:
    """A row for each pair of `counts`, with its tables in each sample, and one without a context for each word, with its customers and tables in the root."""

    def run(rows: pa.Table):
        word, count = rows.column("word").to_numpy(), rows.column("count").to_numpy()
        whole = rows.column("context").is_null().to_numpy()
        names, context = np.unique(rows.column("context").fill_null(0).to_numpy(), return_inverse=True)
        names, context = np.insert(names, min(ROOT, len(names)), 0), context + (context >= ROOT)
        context[whole] = ROOT
        names = np.pad(names, (0, max(0, ROOT + 1 - len(names))))
        types, customers = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        types[context[~whole]], customers[context[~whole]] = (rows.column(c).fill_null(0).to_numpy()[~whole] for c in ("types", "customers"))
        order = np.lexsort((context, word))
        words, number = np.unique(word[order], return_inverse=True)
        elsewhere = all_types - int(types.sum()), totals.n - int(customers.sum())
        got = chain(number, context[order], count[order], replace(totals, types=types, customers=customers, elsewhere=elsewhere), [seed, rows.column("deal")[0].as_py()])

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * SAMPLES, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), pa.int32()))

        yield batch(word=words, context=pa.nulls(len(words), pa.int64()), count=got["whole"], tables=lists(got["root"]), root_tables=lists(got["root_tables"]))
        pairs = len(got["word"])
        yield batch(word=words[got["word"]], context=names[got["context"]], count=got["count"], tables=lists(got["tables"]), root_tables=pa.nulls(pairs, pa.list_(pa.int32())))

    def table(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(rows.combine_chunks())))

    return counts.groupBy("deal").applyInArrow(table, _MODEL)


def word_shares(model: DataFrame, contexts: DataFrame, totals: Totals) -> tuple[DataFrame, Row]:
    """word, n (its count), r (its share in the root), b (the share that it, as a context, gives to the root) and customers (as a context), r and b
    averaged over the samples, of every word and the begin; and what an unknown word has."""
    sums = [F.coalesce(F.sum(F.col("tables")[s]), F.lit(0)).alias(f"t{s}") for s in range(SAMPLES)]
    seats, words = model.where("context IS NOT NULL").select("context", "tables"), model.where("context IS NULL")
    root = words.agg(*[F.coalesce(F.sum(F.col("root_tables")[s]), F.lit(0)).alias(f"t{s}") for s in range(SAMPLES)]).first()
    sent = contexts.select("context", "customers", "alone").join(seats.groupBy("context").agg(*sums), "context", "left")
    sent = sent.select("context", "customers", F.array(*[F.coalesce(f"t{s}", F.lit(0)) + F.col("alone") for s in range(SAMPLES)]).alias("sent"))
    sent = checkpointed(sent, "lm-restaurants")  # a row for each distinct word
    every = sent.agg(*[F.coalesce(F.sum(F.col("sent")[s]), F.lit(0)).alias(f"t{s}") for s in range(SAMPLES)]).first()
    given = Predictive(replace(totals, customers=np.zeros(0, np.int64)), np.zeros((0, SAMPLES)), np.array([float(x) for x in every]), np.array([float(x) for x in root]))
    unknown = float(given.unknown.mean())

    def mean(parts):
        return sum(parts[1:], parts[0]) / SAMPLES

    r = mean([(F.col("tables")[s] - totals.root_discount * F.col("root_tables")[s]) / float(given.root_customers[s] + STRENGTH) for s in range(SAMPLES)]) + float(given.new.mean() * totals.base)
    b = mean([(F.lit(STRENGTH) + totals.discount * F.col("sent")[s]) / (F.col("customers") + STRENGTH) for s in range(SAMPLES)])
    shares = words.select("word", F.col("count").alias("n"), r.alias("r")).join(sent.select(F.col("context").alias("word"), "customers", b.alias("b")), "word", "full")
    shares = checkpointed(shares.select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("r", F.lit(unknown)).alias("r"), F.coalesce("b", F.lit(1.0)).alias("b"), F.coalesce("customers", F.lit(0)).alias("customers")), "lm-words")
    discarded(sent)
    return shares, Row(n=0, r=unknown, b=1.0, customers=0)


def pair_seats(model: DataFrame, discount: float, slots: int) -> DataFrame:
    """slot, pair, count and seat (what its own tables give it) of each pair that occurs more than once."""

    def task(rows: pa.RecordBatch):
        word, context = (rows.column(c).to_numpy().view(np.uint64) for c in ("word", "context"))
        keys, count = pair_keys(word, context), rows.column("count").to_numpy()
        seat = count - discount * rows.column("tables").flatten().to_numpy().reshape(-1, SAMPLES).mean(1)
        yield batch(slot=slot_of(keys, slots).astype(np.int32), pair=signed(keys), count=count, seat=seat.astype(np.float32))

    return in_arrow(model.where("context IS NOT NULL").select("word", "context", "count", "tables"), task, "slot int, pair long, count long, seat float")


@dataclass
class Known:
    """Values by ascending key."""

    keys: np.ndarray
    values: dict[str, np.ndarray]

    @classmethod
    def of(cls, key: np.ndarray, **values: np.ndarray) -> Known:
        order = np.argsort(key)
        return cls(key[order], {k: v[order] for k, v in values.items()})

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys it has, and where."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        asked, inverse = np.unique(keys, return_inverse=True)  # in order, and few of them, they are found faster
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return (self.keys[at] == asked)[inverse], at[inverse]


def frequent_part(df: DataFrame, key: str, by, values: list[str]) -> Known:
    """The rows with the 8 * FREQUENT largest values of `by`."""
    got = df.orderBy(by.desc(), key).select(key, *values).limit(8 * FREQUENT).toArrow().combine_chunks()
    return Known.of(got.column(key).to_numpy().view(np.uint64), **{c: got.column(c).to_numpy() for c in values})


_SHARES = ["n", "r", "b", "customers"]
#: By row, what is summed over its tokens, and how many equal rows that is.
_SUMS = ["copies", "n_tokens", "known", "base", "score"]


def rare_shares(docs: DataFrame, shares: DataFrame, frequent) -> DataFrame:
    """_row and the shares of its words that are not broadcast."""

    def task(rows: pa.RecordBatch):
        names = rows.column("_row").to_numpy()
        for first, hashes, offsets in tokens(rows.column("text")):
            open_ = np.flatnonzero(~frequent.value.find(hashes)[0])
            of, words = np.searchsorted(offsets, open_, "right") - 1, hashes[open_]
            order = np.lexsort((words, of))
            of, words = of[order], words[order]
            heads = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (words[1:] != words[:-1]))) if len(of) else of
            yield batch(_row=names[first + of[heads]], word=signed(words[heads]))

    found = in_arrow(docs.select("_row", "text"), task, "_row long, word long").join(shares, "word")
    return found.groupBy("_row").agg(F.collect_list(F.struct("word", *_SHARES)).alias("rare"))


_DEALT = pa.schema([("slot", pa.int32())] + [(x, pa.binary()) for x in ("rows", "pairs", "gains", "sums")])
_SUMMED = pa.schema([("slot", pa.int32())] + [(x, pa.binary()) for x in ("rows", "more", "sums")])
_DEALT_SQL = "slot int, rows binary, pairs binary, gains binary, sums binary"


def deal_tokens(docs: DataFrame, words, pairs, begin: Row, unknown: Row, totals: Totals, slots: int) -> DataFrame:
    """Rows with the sums of texts as if no pair had seats of its own, and of the broadcast pairs' seats; and rows with all other tokens, by slots of their pairs.

    A token's share is r * b + seat / (customers + STRENGTH), so its seat adds log10(1 + seat * gain).  Gains of held-out texts are negative.
    """

    def given(rows: pa.RecordBatch, first: int, hashes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        has, at = words.value.find(hashes)
        out = {c: np.where(has, v[at], unknown[c]) if len(v) else np.full(len(hashes), unknown[c]) for c, v in words.value.values.items()}
        open_ = np.flatnonzero(~has)
        lists = rows.column("rare").slice(first, len(offsets) - 1)
        if len(open_) and lists.null_count < len(lists):
            inner, of = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
            own = {c: inner.field(c).to_numpy() for c in ("word", *_SHARES)}
            rare = Known.of(pair_keys(own.pop("word").view(np.uint64), of.astype(np.uint64)), **own)
            has, at = rare.find(pair_keys(hashes[open_], (np.searchsorted(offsets, open_, "right") - 1).astype(np.uint64)))
            for c, v in rare.values.items():
                out[c][open_[has]] = v[at[has]]
        return out

    def run(batches):
        parts, sums, held = [], [], 0

        def pack():
            keys, gains, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield filled(_DEALT, **packed(slot_of(keys, slots), rows=rows, pairs=keys, gains=gains))
            names, values = (np.concatenate(x) for x in zip(*sums, strict=True))
            yield filled(_DEALT, **packed(slot_of(names.view(np.uint64), slots), rows=names, sums=values))

        forget_others("")
        for rows in batches:
            names, train = rows.column("_row").to_numpy(), rows.column("train").to_numpy(zero_copy_only=False)
            for first, hashes, offsets in tokens(rows.column("text")):
                n = len(offsets) - 1
                if not n:
                    continue
                of = np.repeat(np.arange(first, first + n), np.diff(offsets))
                own = given(rows, first, hashes, offsets)
                b, customers = np.append(begin.b, own["b"][:-1]), np.append(begin.customers, own["customers"][:-1])
                b[offsets[:-1]], customers[offsets[:-1]] = begin.b, begin.customers
                share = own["r"] * b
                gain = 1 / (share * (customers + STRENGTH))
                keys = pair_keys(hashes, contexts_of(hashes, offsets))
                has, at = pairs.value.find(keys)
                score = np.log10(share)
                score[has] += np.log10(1 + pairs.value.values["seat"][at[has]] * gain[has])
                values = np.stack([np.zeros(len(share)), np.ones(len(share)), own["n"] > 0, np.log10((own["n"] + 0.5) / (totals.n + 0.5 * (totals.v + 1))), score], 1)
                values = np.add.reduceat(values, offsets[:-1])
                values[:, 0] = 1
                sums.append((names[first : first + n], values))
                rest = np.flatnonzero(~has & (own["n"] > 0) & (customers > 0))
                parts.append((keys[rest], np.where(train[of[rest]], gain[rest], -gain[rest]).astype(np.float32), names[of[rest]]))
                held += len(rest) + n
                if held >= PENDING:
                    yield from pack()
                    parts, sums, held = [], [], 0
        if sums:
            yield from pack()
        give_back()

    return docs.mapInArrow(run, _DEALT_SQL)


def seat_sums(dealt: DataFrame, seats: DataFrame, discount: float, slots: int) -> DataFrame:
    """_row and the sums of every text, from the tokens of `deal_tokens` and the seats of their pairs."""

    def seat(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, gains, rows = (unpacked(left.filter(left.column("pairs").is_valid()), n, k) for n, k in (("pairs", np.uint64), ("gains", np.float32), ("rows", np.int64)))
        order = np.argsort(keys)
        keys, gains, rows = keys[order], gains[order].astype(float), rows[order]
        heads = runs(keys)
        # A pair's count is that of its tokens in training texts; one that occurs once has one table.
        own = np.where(added((gains > 0).astype(np.int64), heads) == 1, 1 - discount, 0.0)
        known = Known.of(right.column("pair").to_numpy().view(np.uint64), seat=right.column("seat").to_numpy().astype(float))
        has, at = known.find(keys[heads])
        own[has] = known.values["seat"][at[has]]
        more = np.log10(1 + np.repeat(own, np.diff(np.append(heads, len(keys)))) * np.abs(gains))
        order = np.argsort(rows, kind="stable")
        heads = runs(rows[order])
        names = rows[order[heads]]
        found = packed(slot_of(names.view(np.uint64), slots), rows=names, more=added(more[order], heads))
        whole = left.filter(left.column("sums").is_valid()).combine_chunks()
        return pa.concat_tables([pa.Table.from_batches([filled(_SUMMED, **found)]), pa.Table.from_arrays([whole.column(c) if c in whole.column_names else pa.nulls(len(whole), pa.binary()) for c in _SUMMED.names], schema=_SUMMED)])

    def add(rows: pa.Table) -> pa.Table:
        whole, parts = rows.filter(rows.column("sums").is_valid()), rows.filter(rows.column("more").is_valid())
        more = unpacked(parts, "more", float)
        sums = np.concatenate([unpacked(whole, "sums", float).reshape(-1, len(_SUMS)), np.zeros((len(more), len(_SUMS)))])
        sums[len(sums) - len(more) :, -1] = more
        names = np.concatenate([unpacked(x, "rows", np.int64) for x in (whole, parts)])
        order = np.argsort(names, kind="stable")
        heads = runs(names[order])
        sums = added(sums[order], heads)
        return pa.Table.from_batches([batch(_row=names[order[heads]], **{c: np.ascontiguousarray(sums[:, k]) for k, c in enumerate(_SUMS)})])

    parts = dealt.groupBy("slot").cogroup(seats.select("slot", "pair", "seat").groupBy("slot")).applyInArrow(seat, "slot int, rows binary, more binary, sums binary")
    return parts.groupBy("slot").applyInArrow(add, "_row long, " + ", ".join(f"{c} double" for c in _SUMS))


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 1, folds: int = 5, seed: int = 23) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = df.sparkSession
    docs = texts(df, id_col, text_col).withColumns({"train": fold("doc_id", folds) != held_out, "_row": F.xxhash64("doc_id", "text")})
    train = docs.where("train").select("text")
    unigrams = checkpointed(count_unigrams(train), "lm-unigrams")
    sizes = [F.sum("count").alias("n"), F.count("*").alias("v"), F.count_if(F.col("count") == 1).alias("one"), F.count_if(F.col("count") == 2).alias("two")]
    all_ = unigrams.agg(*sizes).first()
    slots = max(1, -(-(all_.n or 0) // SLOT))
    found = checkpointed(count_pairs(train, slots), "lm-pairs")
    trained = found.where("slot IS NULL").select("word", "context", "count")
    contexts = checkpointed(sum_contexts(found), "lm-contexts")
    kinds = contexts.agg(F.coalesce(F.sum("types"), F.lit(0)).alias("v"), F.coalesce(F.sum("alone"), F.lit(0)).alias("one")).first()
    twos = trained.where("count = 2").count()

    def discount(ones: int, twos: int) -> float:
        return min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones else 0.5

    totals = Totals(np.zeros(0, np.int64), np.zeros(0, np.int64), all_.n or 0, all_.v, discount(kinds.one, twos), discount(all_.one, all_.two))
    deals = max(1, -(-(all_.v + kinds.v) // DEAL))
    none = F.lit(None).cast("long")
    counts = unigrams.select("word", none.alias("context"), "count", none.alias("types"), none.alias("customers")).unionByName(trained.join(counted(contexts.drop("alone")), "context"))
    counts = counts.withColumn("deal", F.pmod(F.xxhash64("word", F.lit(seed)), F.lit(deals)))
    model = checkpointed(seat_all(counts, totals, kinds.v, seed), "lm-seats")
    discarded(unigrams, found)
    shares, unknown = word_shares(model, contexts, totals)
    seats = checkpointed(pair_seats(model, totals.discount, slots), "lm-pair-seats")
    discarded(contexts, model)
    words = spark.sparkContext.broadcast(frequent_part(shares, "word", F.greatest("n", "customers"), _SHARES))
    pairs = spark.sparkContext.broadcast(frequent_part(seats, "pair", F.col("count"), ["seat"]))
    begin = shares.where(F.col("word") == int(signed(np.array([BEGIN], np.uint64))[0])).first() or unknown
    given = docs.join(rare_shares(docs, shares, words), "_row", "left").select("_row", "text", "train", "rare")
    sums = checkpointed(seat_sums(deal_tokens(given, words, pairs, begin, unknown, totals, slots), seats, totals.discount, slots), "lm-sums")
    discarded(shares, seats)

    def each(name: str, kind: str = "double"):
        return (F.col(name) / F.col("copies")).cast(kind)

    return docs.select("_row", "doc_id").join(sums, "_row").select(
        "doc_id",
        (fold("doc_id", folds) == held_out).alias("held_out"),
        each("n_tokens", "long").alias("n_tokens"),
        each("known", "long").alias("n_known"),
        F.lit(totals.n).cast("long").alias("train_tokens"),
        each("base").alias("base_score"),
        each("score").alias("score"),
    )
