"""Jaccard join, substring dedup and components against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.llm import jaccard_join as j
from matchloom.llm import substring_dedup as sd
from matchloom.llm.components import components
from matchloom.llm.words import lowered_words

from .conftest import prose


def joined(sets):
    """Least member of each component, for links of similar sets; all pairs."""
    label = {k: k for k in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    keys = sorted(sets)
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {k: find(k) for k in sets}


def shingles(text):
    w = lowered_words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def near_copies(seed, groups, most, words=(4, 90)):
    rng, out = np.random.default_rng(seed), []
    for _ in range(groups):
        base = prose(rng, int(rng.integers(*words)))
        for _ in range(int(rng.integers(1, most))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, len(copy)))] = f"w{rng.integers(0, 10**6)}"
            out.append(" ".join(copy))
    random.Random(seed).shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("seed, groups, most", [(1, 40, 6), (2, 3, 90)])
def test_join_against_all_pairs(documents, monkeypatch, seed, groups, most):
    monkeypatch.setattr(j, "SHORT_LIST", 4)
    monkeypatch.setattr(j, "PIVOTS", 2)
    pairs = near_copies(seed, groups, most)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.near_duplicates(documents(pairs)).collect()}
    sets = {i: shingles(t) for i, t in pairs}
    labels = joined(sets)
    assert got == {i: (len(sets[i]), labels[i]) for i in sets}


@pytest.mark.parametrize("boundary", [0, 6, 14])
def test_every_boundary_gives_the_same(documents, monkeypatch, boundary):
    monkeypatch.setattr(j, "best_boundary", lambda counts, length: boundary)
    pairs = near_copies(5, 60, 5, words=(4, 24))
    sets = {i: shingles(t) for i, t in pairs}
    assert {r.doc_id: r.component_id for r in j.near_duplicates(documents(pairs)).collect()} == joined(sets)


def test_join_of_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    assert {r.doc_id: r.component_id for r in j.near_duplicates(docs).collect()} == joined(sets)


def test_join_of_awkward_rows(awkward, empty):
    rows = j.near_duplicates(awkward).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 10 and [got[k] for k in (1, 2, 3)] == [(0, 1), (0, 2), (0, 3)] and got[6] == (4, 5) and got[None][1] is None and got[9] == (1, 9)
    assert j.near_duplicates(empty).count() == 0
    kept = j.one_of_each(awkward)
    assert kept.columns == awkward.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9]


def test_rows_that_share_ids_are_documents_each(spark):
    """Ids don't decide: texts that share nothing all stay, and copies go whatever their ids."""
    said = [" ".join(f"{w}{k}" for k in range(9)) for w in "abcdef"]
    rows = [(None, said[0]), (None, said[1]), (None, said[2]), (7, said[3]), (7, said[4])]
    make = lambda rows: spark.createDataFrame([(i, t, {"a": 1}, "x") for i, t in rows], "doc_id long, text string, other_id map<string, int>, text_one string")
    assert sorted((r.text for r in j.one_of_each(make(rows)).collect())) == sorted(t for _, t in rows)
    more = [*rows, (3, said[4]), (8, said[4]), (8, said[4]), (8, said[5]), (8, said[5]), (None, said[5].upper()), (7, None), (7, None), (7, ""), (9, said[0] + " more"), (9, said[1] + " more")]
    got = sorted(((r.doc_id, r.text) for r in j.one_of_each(make(more)).collect()), key=repr)
    assert got == sorted([(None, said[0]), (None, said[1]), (None, said[2]), (7, said[3]), (3, said[4]), (None, said[5].upper()), (7, None), (7, None), (7, "")], key=repr)
    twice = j.one_of_each(make([(1, said[0]), (1, said[0] + " more"), (1, said[0])])).collect()
    assert len(twice) == 1 and twice[0].doc_id == 1


def test_prefixes_meet():
    for n in range(1, 60):
        for m in range(n, 5 * n // 4 + 1):
            assert j.shared_least(n, m) >= -(-4 * m // 5) - (m - n) or j.prefix_length(m) >= m - j.shared_least(n, m) + 1
            assert j.prefix_length(m) >= m - j.shared_least(n, m) + 1 and j.prefix_length(n) >= n - j.shared_least(n, m) + 1


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)]
    names = {x: rng.randint(0, 10**9) for x in range(400)}
    links = [(names[a], names[b]) for a, b in links]
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            label[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == find(x) for pair in links if pair[0] != pair[1] for x in pair)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def cut(pairs, window=20):
    """Words, removed words and the kept text's digest of each document, in order of ids."""
    seen, out = set(), {}
    for i, text in sorted(pairs, key=lambda p: p[0]):
        w = sd_words(text)
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            if run in seen:
                keep[k : k + window] = [False] * window
            seen.add(run)
        kept = " ".join(x for x, y in zip(w, keep, strict=True) if y)
        out[i] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def sd_words(text):
    return [w.decode() for w in (text or "").encode().split()]


def passages(seed, n=120):
    rng = np.random.default_rng(seed)
    shared = [prose(rng, int(k)) for k in rng.integers(15, 70, 6)]
    out = []
    for k in range(n):
        parts = [[f"d{k}w{x}" for x in range(int(rng.integers(0, 40)))]]
        for _ in range(int(rng.integers(0, 3))):
            parts += [shared[int(rng.integers(0, 6))], [f"d{k}v{x}" for x in range(int(rng.integers(0, 8)))]]
        if k % 10 == 3:
            parts.append(["eco"] * int(rng.integers(20, 45)))
        if k % 17 == 5:
            parts = [sd_words(out[-1][1])]
        out.append((k, " \n".join(" ".join(p) for p in parts)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_by_definition(documents, seed):
    pairs = passages(seed)
    rows = sd.drop_repeats(documents(pairs)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == cut(pairs)
    texts = dict(pairs)
    spans = [(texts[r.doc_id], s) for r in rows for s in r.spans or []]
    assert spans and all(sd_words(t)[s.start : s.start + s.n_words] == sd_words(texts[s.source_id])[s.source_start : s.source_start + s.n_words] for t, s in spans)


def test_cuts_of_the_tables(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    want = cut([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in sd.drop_repeats(docs).collect()} == want


def test_copies_send_for_their_batch(documents, monkeypatch):
    monkeypatch.setattr("matchloom.llm.common.BATCH_ROWS", "2")
    text = " ".join(f"w{k}" for k in range(60))
    pairs = [(0, text), (1, "solo"), (2, text), (3, "otro " + " ".join(text.split()[10:50]) + " fin")]
    rows = sd.drop_repeats(documents(pairs).coalesce(1)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == cut(pairs)


def test_cuts_of_awkward_rows(awkward, empty, documents):
    rows = sd.drop_repeats(awkward).collect()
    assert len(rows) == 10 and all(r.n_removed == 0 for r in rows if r.doc_id in (1, 2, 3, 5, 6, None))
    assert sd.drop_repeats(empty).count() == 0
    text = " ".join(f"w{k}" for k in range(25))
    got = sd.without_repeats(documents([(1, text), (2, text), (3, "solo " + text), (4, "otro")]).withColumn("n_chars", F.length("text"))).collect()
    assert {r.doc_id: (r.text, r.n_chars) for r in got} == {1: (text, len(text)), 2: ("", 0), 3: ("solo", 4), 4: ("otro", 4)}


def test_equal_anchors_for_equal_windows():
    import pyarrow as pa

    from matchloom.llm.words import rolling, split_words

    rng = np.random.default_rng(4)
    run = prose(rng, 30)
    texts = [" ".join(prose(rng, 11) + run + prose(rng, 7)), " ".join(run), " ".join(["eco"] * 40)]
    words = next(iter(split_words(pa.array(texts))))
    hashes = words.hashes(lower=False)
    first, _, at = sd.anchors(words, hashes, 20, 8)
    found = {}
    for f, place in zip(first.tolist(), at.tolist(), strict=True):
        assert f <= place <= f + 12
        key = int(rolling(hashes, 20)[f])
        assert found.setdefault(key, (place - f, int(rolling(hashes, 8)[place]))) == (place - f, int(rolling(hashes, 8)[place]))
