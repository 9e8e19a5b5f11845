"""NN-descent, importance resampling and prefix tries against their plain definitions."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from matchloom.llm import importance, neighbour_graph, prefix_trie
from matchloom.llm.importance import _OUTSIDE, features, split_text
from matchloom.llm.words import split_words

# --- embedding near-dedup ---------------------------------------------------------------------


def clustered(seed=0, dims=24):
    """Random vectors, with near copies in a large, a spread, and many small groups, and equal vectors; by id."""
    rng = np.random.default_rng(seed)

    def near(centre, n, noise):
        x = centre + noise * rng.normal(size=(n, dims))
        return x * rng.uniform(0.1, 9, (n, 1))

    unit = rng.normal(size=(40, dims))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    parts = [rng.normal(size=(300, dims)), near(unit[0], 90, 0.02), near(unit[1], 60, 0.05), np.repeat(unit[2:3], 50, axis=0)]
    parts += [near(c, 3, 0.03) for c in unit[3:]]
    x = np.concatenate(parts)
    ids = rng.permutation(len(x)) * 3 + 5
    return {int(i): v.tolist() for i, v in zip(ids, x, strict=True)}


def brute_links(rows):
    """(vec_id, n_links, component_id, kept) by all pairs; `rows`: id and vector."""
    fine = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max(len(rows[k][1]) for k in fine)
    x = np.array([rows[k][1] + [0.0] * (width - len(rows[k][1])) for k in fine])
    x /= np.abs(x).max(axis=1)[:, None]
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.95
    links, label = Counter({k: int(n) - 1 for k, n in zip(fine, near.sum(axis=1), strict=True)}), {k: {k} for k in range(len(rows))}
    for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        if label[fine[a]] is not label[fine[b]]:
            both = label[fine[a]] | label[fine[b]]
            for k in both:
                label[k] = both
    least = {k: min((rows[j][0] for j in label[k] if rows[j][0] is not None), default=None) for k in label}
    return sorted([(rows[k][0], links[k], least[k], rows[k][0] == least[k]) for k in label], key=repr)


def test_links_of_groups(spark):
    rows = sorted(clustered().items())
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    graph = neighbour_graph.neighbour_graph(table)
    assert graph.recall == 1.0
    got = sorted((tuple(r) for r in neighbour_graph.near_vectors(table).collect()), key=repr)
    assert got == brute_links(rows)
    assert max(n for _, n, _, _ in got) >= 89  # groups larger than any list


def test_links_of_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [0.0, -3.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [0.0, 0.0]), (8, []), (9, [0.0, 1.0]), (9, [0.0, 1.0])]
    rows += [(None, [0.1, 5.0]), (None, [-1.0, 0.0]), (10, [1e200, 1e190]), (11, [5.0])]
    table = spark.createDataFrame([(i, v, "clash", 7) for i, v in rows], "vec_id long, embedding array<double>, node string, times int")
    got = sorted((tuple(r) for r in neighbour_graph.near_vectors(table).collect()), key=repr)
    assert got == brute_links(rows)
    assert neighbour_graph.near_vectors(table.where("false")).collect() == []
    assert {tuple(r)[1:] for r in neighbour_graph.near_vectors(table.where("vec_id = 7")).collect()} == {(0, 7, True)}


def test_codes_bound_products():
    x = np.array(list(clustered(3).values()))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    codes, step, left = neighbour_graph.coded(u)
    near = codes * step[:, None]
    off = np.abs(u @ u.T - near @ near.T)
    assert (off <= left[:, None] + left + left[:, None] * left + 1e-12).all() and off.max() < 0.05


def test_whole_components_by_blocks(spark, monkeypatch):
    """Blocks that are settled by their centres and blocks that are multiplied give the same degrees."""
    monkeypatch.setattr(neighbour_graph, "MEMBERS", 25)
    rows = sorted(clustered(5).items())
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    members = spark.createDataFrame([(0, k, 1 + k % 3, v) for k, (_, v) in enumerate(rows)], "label long, node long, times long, vector array<double>")
    got = {r.node: r.links for r in neighbour_graph.whole_degrees(members, x.shape[1], 0.95).collect()}
    times = 1 + np.arange(len(rows)) % 3
    assert got == dict(enumerate((((u @ u.T) >= 0.95) @ times - 1).tolist()))


# --- importance resampling -------------------------------------------------------------------------


def plain_words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_buckets(text):
    w = plain_words(text)
    return [zlib.crc32(f.encode()) % 10_000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]


def brute_resampled(docs, target):
    s, t = Counter(b for _, x in docs for b in plain_buckets(x)), Counter(b for x in target for b in plain_buckets(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for i, x in docs:
        buckets = plain_buckets(x)
        weight = sum(gain[b] for b in buckets) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain_words(x)) >= 20])
    able = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


LONG = "ab" * 40 + "É" * 30


@pytest.mark.parametrize("chunk_bytes", [importance.CHUNK_BYTES, 200, 1])
def test_resampling(spark, documents, chunk_bytes):
    rng = np.random.default_rng(1)
    vocabulary = ["La", "de", "un", "CABLE", "rojo1", "año", "中文", LONG, "x_y", "norte-sur", "tubo"]
    docs = [(k, " ".join(vocabulary[j] for j in rng.integers(0, len(vocabulary), n))) for k, n in enumerate(rng.integers(0, 90, 60).tolist())]
    docs += [(100, None), (101, ""), (102, " .;\n"), (103, docs[7][1]), (103, docs[7][1]), (104, docs[8][1]), (104, docs[9][1]), (None, docs[10][1]), (None, docs[10][1]), (105, "palabra " * 3000)]
    target = ["rojo1 tubo de cable", None, "rojo1 tubo"]
    aim = spark.createDataFrame([(t, "clash") for t in target], "text string, _id string")
    got = sorted((tuple(r) for r in importance.resampled(documents(docs), aim, chunk_bytes=chunk_bytes).collect()), key=repr)
    assert got == brute_resampled(docs, target)


def test_resampling_of_empty_tables(spark, documents, empty):
    nothing = spark.createDataFrame([], "text string")
    assert importance.resampled(empty, nothing).collect() == []
    docs = [(k, "uno dos tres cuatro " * 6) for k in range(4)]
    assert sorted((tuple(r) for r in importance.resampled(documents(docs), nothing).collect()), key=repr) == brute_resampled(docs, [])


def test_chunks_own_their_words():
    text = "uno  dos, tres CUATRO " + LONG + " cinco seis " * 20
    for size in (1, 30, 400):
        chunks = split_text(text, size)
        assert sum(own for _, own in chunks) == len(plain_words(text))
        got = []
        for chunk, own in chunks:
            for words in split_words(pa.array([chunk]), outside=_OUTSIDE):
                got += [b for _, buckets in features(words, np.array([own])) for b in buckets.tolist()]
        assert sorted(got) == sorted(plain_buckets(text))


# --- prefix trie --------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    told = {c: [(r[2], r[4]) for r in sorted(t)] for c, t in turns.items()}
    made = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = told.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        ends = ",".join(str(c) for c in sorted(convs) if len(made[c]) == len(node))
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), sum(not children[m] for m in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk(rng, n):
    rows = []
    for conv in range(-7, n):
        if conv % 11 == 4:
            continue
        words = rng.integers(0, 2, rng.integers(1, 12))
        rows += [(conv, k, "user" if k % 2 == 0 else "assistant", "ñandú"[: 2 + int(w)]) for k, w in enumerate(words)]
    return rows


@pytest.mark.parametrize("heavy, shard_rows", [(prefix_trie.HEAVY, prefix_trie.SHARD_ROWS), (6, 40), (1, 10), (0, 10)])
def test_trie(spark, monkeypatch, heavy, shard_rows):
    monkeypatch.setattr(prefix_trie, "HEAVY", heavy)
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", shard_rows)
    rows = talk(np.random.default_rng(heavy), 90)
    rows += [(200, None, None, None), (200, 1, "user", ""), (201, 1, "user", "b"), (201, 1, "user", "a"), (201, 1, "user", "a"), (None, 0, "user", "x"), (205, 0, "user", "x" * 50_000), (206, 0, "user", "z")]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int")
    assert sorted((tuple(r) for r in prefix_trie.trie_nodes(table).collect()), key=repr) == brute_trie(rows)


def test_trie_of_nothing(spark):
    table = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie_nodes(table).collect() == []


def test_ends_of_a_hot_node_come_in_pieces(spark):
    rows = [({"one": 1, "two": k % 2}, k * 7919 % 5000) for k in range(400)]
    got = {r.node.two: r.ends_sha256 for r in prefix_trie.ends_digests(spark.createDataFrame(rows, "node struct<one: long, two: long>, conv_id long"), 200).collect()}
    assert got == {t: hashlib.sha256(",".join(map(str, sorted(c for n, c in rows if n["two"] == t))).encode()).hexdigest() for t in (0, 1)}


def test_louds_bits():
    conv, one = np.array([0, 0, 1, 1, 1, 2]), np.array([5, 6, 5, 7, 8, 9])
    trie = prefix_trie.Trie.of(conv, one, one * 0, one * 0)
    assert np.unpackbits(trie.louds.bits, count=2 * trie.louds.n - 1).tolist() == [1, 1, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    assert trie.one.tolist() == [0, 5, 9, 6, 7, 8] and trie.louds.parents().tolist() == [0, 0, 1, 1, 4] and trie.louds.degrees().tolist() == [2, 2, 0, 0, 1, 0]


def test_stored_tries_hold_all_lower_nodes(spark, data):
    table = spark.read.parquet(f"{data}/conversations.parquet")
    stored = prefix_trie.stored_tries(table).collect()
    assert sum(r.nodes for r in stored) + prefix_trie.divided(table)[1].count() == prefix_trie.trie_nodes(table).count()
    for r in stored:
        assert len(np.frombuffer(r.one, np.int64)) == r.nodes and prefix_trie.Louds(np.frombuffer(r.bits, np.uint8), r.nodes + 1).degrees().sum() == r.nodes
