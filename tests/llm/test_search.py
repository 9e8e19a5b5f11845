"""Top-k searches, language model and chat tree."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from matchloom.llm import chat_tree, hash_forest, maxscore, pitman_yor, vector_blocks
from matchloom.llm.chat_tree import escaped, formatted_digest, parse_segment, prefix_tree, unescape, with_attention
from matchloom.llm.vector_blocks import Block
from matchloom.llm.words import lowered_words


@pytest.fixture
def vectors(spark, data):
    return spark.read.parquet(f"{data}/embeddings.parquet")


def brute(ids, scores, queries, top):
    out = []
    for row, q in zip(scores, queries, strict=True):
        order = sorted((-s, i) for s, i in zip(row, ids, strict=True) if i != q)[:top]
        out += [(q, k + 1, i, -s) for k, (s, i) in enumerate(order)]
    return out


def test_exact_search(vectors, monkeypatch):
    monkeypatch.setattr(vector_blocks, "SHARD_ROWS", 120)
    monkeypatch.setattr(vector_blocks, "QUERY_ROWS", 10)
    table = vectors.toPandas().sort_values("vec_id")
    ids, x = table.vec_id.tolist(), np.floor(64 * np.stack(table.embedding).astype(float))
    at = [k for k, i in enumerate(ids) if i % 20 == 0]
    got = sorted(tuple(r) for r in maxscore.top_products(vectors).collect())
    assert got == brute(ids, (x[at] @ x.T).astype(int).tolist(), [ids[k] for k in at], 20)


@pytest.mark.parametrize("dims, high", [(12, 3), (40, 200), (3, 10_000_000)])
def test_maxscore_with_ties_and_sparse_rows(dims, high):
    rng = np.random.default_rng(0)
    rows = Block(np.arange(500), rng.integers(-2, high, (500, dims)) * (rng.random((500, dims)) < 0.3).astype(float))
    asked = Block(np.arange(0, 500, 50), rows.vectors[::50])
    want = sorted((q, -s, i) for q, _, i, s in brute(rows.ids.tolist(), (asked.vectors @ rows.vectors.T).tolist(), asked.ids.tolist(), 7))
    postings = maxscore.Postings(rows)
    first = maxscore.maxscore(postings, asked, np.full(10, -np.inf), 7)
    for found in (first, maxscore.maxscore(postings, asked, first.thresholds(), 7)):
        place, ids, scores = found.triples()
        assert sorted((int(asked.ids[p]), -s, int(i)) for p, i, s in zip(place, ids, scores, strict=True)) == want


def unit_rows(n, dims=64, seed=3):
    x = np.random.default_rng(seed).normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_maxscore_skips_postings_and_rows():
    x = np.floor(64 * unit_rows(8000))
    rows, counts = Block(np.arange(8000), x), {}
    asked = Block(rows.ids[::200], x[::200])
    floors = maxscore.maxscore(maxscore.Postings(Block(rows.ids[::4], x[::4])), asked, np.full(40, -np.inf), 20).thresholds()
    maxscore.maxscore(maxscore.Postings(rows), asked, floors, 20, counts)
    assert counts["traversed"] + counts["probed"] < 0.6 * counts["all"] and counts["scored"] < 0.05 * 40 * 8000


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (21, None), (22, [None, 1.0]), (23, [nan, 1.0]), (24, [inf, 1.0]), (25, [0.0, 0.0]), (40, [0.5, 0.5]), (50, [0.5]), (50, [0.5]), (None, [1.0, 1.0])]
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, shard string")


def test_searches_of_awkward_rows(spark):
    rows = odd_vectors(spark)
    got = maxscore.top_products(rows).collect()
    assert {r.query_id for r in got} == {0, 20, 40} and not {21, 22, 23, 24} & {r.vec_id for r in got}
    assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(20, 2048), (40, 2048), (50, 2048), (50, 2048), (25, 0)]
    near = hash_forest.nearest_neighbours(rows).collect()
    assert {r.query_id for r in near} == {0, 50} and 25 not in {r.vec_id for r in near}
    assert [r.vec_id for r in sorted(near, key=lambda r: r["rank"]) if r.query_id == 50] == [0, 20, 40]
    for search in (maxscore.top_products, hash_forest.nearest_neighbours):
        assert search(rows.where("false")).count() == 0


def test_forest_recall_and_scores(spark, data):
    vectors = spark.read.parquet(f"{data.replace('0.001', '0.1')}/embeddings.parquet")
    table = vectors.toPandas().sort_values("vec_id")
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    got = hash_forest.nearest_neighbours(vectors).toPandas()
    at = {i: k for k, i in enumerate(ids)}
    hits = 0
    for q, found in got.groupby("query_id"):
        scores = unit @ unit[at[q]]
        scores[at[q]] = -2
        hits += len(set(found.vec_id) & set(ids[np.argsort(-scores)[:5]]))
        assert np.allclose(found.score, [x[at[q]] @ x[at[v]] / np.linalg.norm(x[at[q]]) / np.linalg.norm(x[at[v]]) for v in found.vec_id])
    assert hits / len(got) >= 0.9


def test_forest_recall_and_work_over_full_shards():
    n, hits, found = 24_000, 0, []
    x, ids, counts = unit_rows(n), np.arange(n), {}
    asked = Block(ids[::200], x[::200])
    for k in range(3):
        forest = hash_forest.Forest(Block(ids[k::3], x[k::3]))
        found.append(hash_forest.nearest_in(forest, asked, np.full(len(asked.ids), -np.inf), 5, counts=counts).triples())
    place, near, scores = (np.concatenate(c) for c in zip(*found, strict=True))
    for k, q in enumerate(asked.ids):
        cosine = x @ x[q]
        cosine[q] = -2
        own = near[place == k][np.argsort(-scores[place == k])[:5]]
        hits += len({*own} & {*np.argsort(-cosine)[:5]})
    assert hits >= 0.9 * 5 * len(asked.ids) and counts["scored"] < 0.4 * n * len(asked.ids)


def test_forest_reaches_the_longest_prefixes_first():
    x = np.random.default_rng(2).normal(size=(4000, 16))
    reached = hash_forest.Forest(Block(np.arange(4000), x), trees=4).reached(x[:3].astype(np.float32), 20)
    assert all(k in rows and 20 <= len(rows) < 4000 for k, rows in enumerate(reached))


def test_tiny_and_repeated_vectors_reach_all():
    x = np.repeat(unit_rows(2, 8), 3, axis=0)
    forest, asked = hash_forest.Forest(Block(np.arange(6), x)), Block(np.arange(6), x)
    place, ids, _ = hash_forest.nearest_in(forest, asked, np.full(6, -np.inf), 5).triples()
    assert [sorted(ids[place == k].tolist()) for k in range(6)] == [sorted({*range(6)} - {k}) for k in range(6)]


def test_blocks_hold_every_row(spark, vectors):
    shards, n = vector_blocks.blocks(vector_blocks.usable(vectors, "vec_id", "embedding"), 100, "shard")
    rows = shards.collect()
    assert n == 5 and sorted(i for r in rows for i in np.frombuffer(r.ids, np.int64)) == list(range(500))


# --- language model ----------------------------------------------------------------------------


def test_language_model(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in pitman_yor.score_documents(docs).collect()}
    words = {r.doc_id: [*lowered_words(r.text), "\n"] for r in docs.collect()}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r, base = rows[i], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), n, zlib.crc32(str(i).encode()) % 5 == 1)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_rare_and_frequent_words_score_alike(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    whole = {r.doc_id: r.score for r in pitman_yor.score_documents(docs).collect()}
    monkeypatch.setattr(pitman_yor, "FREQUENT", 80)
    part = {r.doc_id: r.score for r in pitman_yor.score_documents(docs).collect()}
    assert all(abs(whole[i] - part[i]) < 1e-4 for i in whole)


def test_every_word_is_a_context(documents):
    """After each of 150 words one other always follows, so that a text in that order is likelier than one out of order."""
    pairs = [f"a{k} b{k}" for k in range(150)]
    texts = [" ".join(pairs[k:] + pairs[:k]) for k in range(0, 150, 3)]
    mixed = " ".join(f"a{k} b{(k * 7 + 3) % 150}" for k in range(150))
    rows = [(k, t) for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    held = [k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    got = {r.doc_id: r for r in pitman_yor.score_documents(documents(rows + [(held[0], texts[0]), (held[1], mixed)])).collect()}
    one, other = got[held[0]], got[held[1]]
    assert abs(one.base_score - other.base_score) < 1e-6 and one.score > -0.2 * one.n_tokens and other.score < one.score - 100


def test_language_model_of_awkward_rows(awkward, empty):
    rows = pitman_yor.score_documents(awkward).collect()
    assert len(rows) == 10 and all(r.n_tokens == 1 for r in rows if r.doc_id in (1, 2, 3)) and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert pitman_yor.score_documents(empty).count() == 0


def test_pairs_that_occur_once_are_not_dealt(documents, monkeypatch):
    dealt, seat_all = [], pitman_yor.seat_all
    monkeypatch.setattr(pitman_yor, "seat_all", lambda counts, *more: dealt.extend(counts.collect()) or seat_all(counts, *more))
    docs = documents([(i, f"uno dos solo{i} uno dos") for i in range(30)])
    rows = pitman_yor.score_documents(docs).collect()
    assert len(rows) == 30 and all(r.score < 0 for r in rows)
    assert {r["count"] > 1 for r in dealt if r.context is not None} == {True}
    learnt = sum(not r.held_out for r in rows)
    assert sum(r.context is None for r in dealt) == learnt + 3  # every word and the end keep their whole counts


def test_no_step_has_a_row_for_each_pair(documents, monkeypatch):
    """Pairs that occur once are most of a corpus, and steps with a row for each went beyond the disk limit."""
    steps, checkpointed = [], pitman_yor.checkpointed

    def noted(df, what):
        steps.append(checkpointed(df, what))
        counts[what] = steps[-1].count()
        return steps[-1]

    counts = {}
    monkeypatch.setattr(pitman_yor, "checkpointed", noted)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, 100)) for _ in range(150)]
    pairs = len({p for t in texts for p in zip(t.split(), t.split()[1:], strict=False)})
    assert pitman_yor.score_documents(documents(list(enumerate(texts)))).count() == 150
    assert max(counts.values()) < pairs / 2, (counts, pairs)


def test_scores_where_every_word_occurs_once(documents, monkeypatch):
    """All tables are known then, so that scores follow by hand; in many slots, most of them without seats of their own."""
    monkeypatch.setattr(pitman_yor, "SLOT", 1)
    train = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 != 1)
    held, other = [i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    rows = pitman_yor.score_documents(documents([(train, "A b c"), (held, "a b z c"), (held, "a b z c"), (other, None)])).collect()
    d, n = 0.95, 4
    new = (1 + d * n) / (n + 1)
    root, unknown, context = (1 - d) / (n + 1) + new * 0.5 / n, new * 0.5, (1 + d) / 2
    known = root * context + (1 - d) / 2
    wanted = {train: [known] * 4, held: [known, known, unknown * context, root, known], other: [root * context]}
    assert len(rows) == 4
    for r in rows:
        assert r.n_tokens == len(wanted[r.doc_id]) and abs(r.score - sum(map(math.log10, wanted[r.doc_id]))) < 1e-5


def test_stirling_numbers_are_those_of_their_recursion():
    tables = pitman_yor.Tables(np.zeros(0, np.int64), 0.7, np.zeros(0, np.int64))
    for sizes, width in (([1, 2, 5], 5), ([3, 40, 41, 120], 7), ([30], 1)):
        got, row = tables.stirling(np.array(sizes), width), [1.0] + [0.0] * (width - 1)
        for c in range(1, sizes[-1] + 1):
            if c in sizes:
                own = min(c, width)
                assert np.allclose(got[sizes.index(c)][:own], [math.log(x) for x in row[:own]], atol=1e-9) and (got[sizes.index(c)][own:] == -np.inf).all()
            row = [(c - 0.7 * (k + 1)) * row[k] + (row[k - 1] if k else 0) for k in range(width)]


def small_chain(seed=0, words=200):
    rng = np.random.default_rng(seed)
    pairs = Counter(zip(rng.zipf(1.3, 8000).clip(max=words) - 1, rng.choice([0, 1, 2, 63], 8000), strict=True))
    rows = sorted((int(w), int(c), k) for (w, c), k in pairs.items() if c != 63)
    whole = Counter()
    for (w, _), k in pairs.items():
        whole[int(w)] += k
    names = {w: k for k, w in enumerate(sorted(whole))}
    rows = sorted([(names[w], c, k) for w, c, k in rows] + [(names[w], 63, k) for w, k in whole.items()])
    word, context, count = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    of = context != 63
    totals = pitman_yor.Totals(np.bincount(context[of], minlength=64), np.bincount(context[of], count[of], 64).astype(np.int64), int(count[~of].sum()), len(names), 0.6, 0.7)
    return pitman_yor.chain(word, context, count, totals, [seed]), totals


def test_probabilities_add_up():
    got, totals = small_chain()
    n = len(got["whole"])
    sums = np.stack([np.bincount(got["context"], got["tables"][:, s], 64) for s in range(pitman_yor.SAMPLES)], 1)
    sums[63] = got["root_tables"].sum(0)
    p = pitman_yor.Predictive(totals, sums)
    root = p.root(got["root"], got["root_tables"])
    for context in (0, 1, 2, 63):
        share = (root * p.beta[context]).mean(1)
        at = got["context"] == context
        share[got["word"][at]] += p.seats(got["context"][at], got["count"][at], got["tables"][at])
        assert (share > 0).all() and abs(share.sum() + (p.unknown * p.beta[context]).mean() - 1) < 1e-9
    assert n == totals.v


def test_seats_stay_consistent():
    rng = np.random.default_rng(1)
    customers, tables = np.array([2, 5, 8, 300]), np.array([1, 2, 8, 120])
    seats = pitman_yor.Seats(customers, tables, 8)
    for _ in range(200):
        seats.step(np.array([0.5, 2.0, 0.1, 5.0]), 0.5, rng)
        assert (seats.sizes >= 0).all() and (seats.sizes.sum(1) + seats.rest == customers).all() and (seats.tables() >= 1).all() and (seats.tables() <= customers).all()


def test_two_customers_share_a_table_as_often_as_they_should():
    """With weight w of a new table, the second of two customers joins the first with odds (1 - d) to w."""
    rng, n = np.random.default_rng(3), 4000
    seats = pitman_yor.Seats(np.full(n, 2), np.ones(n, np.int64), 8)
    for _ in range(30):
        seats.step(np.full(n, 1.5), 0.5, rng)
    assert abs((seats.tables() == 1).mean() - 0.5 / 2.0) < 0.03


def test_tables_drawn_at_once_are_those_of_single_moves():
    rng, n = np.random.default_rng(5), 1000
    customers, weight = np.repeat([2, 5, 40], n), np.repeat([1.5, 0.7, 3.0], n)
    seats = pitman_yor.Seats(customers, np.ones(3 * n, np.int64), 40)
    for _ in range(3000):
        seats.step(weight, 0.5, rng)
    drawn = pitman_yor.Tables(customers, 0.5, np.ones(3 * n, np.int64)).draw(weight, rng)
    for own in (slice(0, n), slice(n, 2 * n), slice(2 * n, None)):
        assert abs(drawn[own].mean() - seats.tables()[own].mean()) < 0.4 and abs(drawn[own].std() - seats.tables()[own].std()) < 0.3
    assert (pitman_yor.Tables(np.array([3, 500]), 0.5, np.array([1, 1])).draw(np.array([1e9, 1e9]), rng) == [3, 500]).all()


def test_a_sweep_moves_all_customers_of_frequent_pairs():
    """Seats of pairs with thousands of customers don't depend on those of an earlier sweep."""
    n = 400
    word, context, count = np.repeat(np.arange(n), 2), np.tile([0, 63], n), np.tile([2000, 102_000], n)
    totals = pitman_yor.Totals(np.bincount([0], [n], 64).astype(np.int64), np.bincount([0], [2000 * n], 64).astype(np.int64), 102_000 * n, n, 0.6, 0.7)
    tables = pitman_yor.chain(word, context, count, totals, [1])["tables"]
    own = (tables - tables.mean(0)).astype(float)
    assert (own.std(0) > 0.5).all() and abs((own[:, 0] * own[:, -1]).mean()) / (own[:, 0].std() * own[:, -1].std()) < 0.25


# --- chat tree ---------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def digests(rows):
    """By conversation, what the formatted turns hold, from the definition."""

    def escape(text, controls):
        for c in controls:
            text = text.replace(c, "\\" + c)
        return text

    talks = {}
    for i, _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        talks.setdefault(i, []).append((role or "", text or ""))
    out = {}
    for i, turns in talks.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        formatted = "".join(f"### {escape(r, ['\\', '###', '</turn>', ':'])}: {escape(t, ['\\', '###', '</turn>'])}</turn>\n" for r, t in turns)
        out[i] = (len(turns), whole, len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted))
    return out


def read(spark, df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in formatted_digest(df).collect()}


@pytest.mark.parametrize("page", [5, 4096])
def test_chat_digests(spark, monkeypatch, page):
    monkeypatch.setattr(chat_tree, "PAGE", page)
    said = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hola"), (1, 1, "assistant", "sí"), (2, 0, "user", "hola"), (2, 1, "assistant", "sí"), (2, 2, "user", "###: \\"), (3, 0, "user", "hola"), (3, 1, "assistant", None), (-7, 0, "user", said), (-7, 1, "assistant", said), (9, 3, "a: b\n###", ""), (None, None, None, "x")]
    rows += [(11, 0, "user", "rep"), (11, 0, "user", "rep"), (12, 0, "user", "\U0001d518中文 " * 500), (12, 1, "assistant", "largo " * 2000)]
    clashing = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS + ", node string, page string")
    assert read(spark, clashing) == digests(rows)


def test_chat_digests_of_the_table(spark, data):
    df = spark.read.parquet(f"{data}/conversations.parquet")
    assert read(spark, df) == digests([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])


def test_tree_shares_and_attends(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "assistant", "b"), (1, 2, "u", "c"), (2, 0, "u", "a"), (2, 1, "assistant", "b"), (2, 2, "u", "d"), (3, 0, "u", "a"), (3, 1, "assistant", "z"), (4, 0, "u", "a"), (4, 1, "assistant", "b"), (5, 0, "u", "q")]
    nodes, paths = prefix_tree(spark.createDataFrame(rows, TURNS))
    found = with_attention(nodes, paths).collect()
    assert len(found) == 6 and paths.count() == len(rows)
    stream, at = "", {}
    for r in sorted(found, key=lambda r: r.packed_start):
        assert r.packed_start == len(stream)
        stream += r.segment
        at[r.node] = r
    for r in found:
        chain, node = [], r.parent
        while node is not None:
            chain.append(at[node])
            node = at[node].parent
        before = "".join(x.segment for x in reversed(chain))
        assert "".join(stream[s.start : s.stop] for s in r.attention) == before and r.position_start == len(before)
        # Depth first: what follows a parent up to a child lies below the parent.
        assert all(x.packed_start < r.packed_start for x in chain)
    assert sum(len(r.attention) > 1 for r in found) >= 1


def test_escapes_come_back(spark):
    from pyspark.sql import functions as F

    texts = ["", "\\", "\\\\###", "####</turn></turn>", "a\\:b:", "</turn", "##</turn>#"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e"), escaped(F.col("t"), role=True).alias("r")).collect()
    for r in rows:
        assert unescape(r.e) == r.t and unescape(r.r) == r.t
        assert parse_segment(f"### {r.r}: {r.e}</turn>\n") == (r.t, r.t)


def test_empty_chat(spark):
    assert formatted_digest(spark.createDataFrame([], TURNS)).count() == 0
