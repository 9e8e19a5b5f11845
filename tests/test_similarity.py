"""The sparse top-k against all pairs: equal vectors, negative scores, lines that share nothing with any item."""

from random import Random

import pytest

from matchloom.operators import similarity


def vectors(rng, n, dims, kinds):
    """Unit vectors, many of them equal, by number."""
    made = []
    for _ in range(kinds):
        entries = {rng.randrange(dims): rng.choice([1.0, 1.0, 0.35, -0.35, -1.0]) for _ in range(rng.randrange(1, 7))}
        length = sum(w * w for w in entries.values()) ** 0.5
        made.append({k: w / length for k, w in entries.items()})
    return {k: rng.choice(made) for k in range(n)}


@pytest.mark.parametrize("dims, lines, items, k", [(12, 40, 90, 5), (300, 30, 60, 5), (60, 25, 3, 5), (12, 20, 80, 1)])
def test_sparse_top_k(spark, dims, lines, items, k):
    rng = Random(dims * 7 + items)
    ours, theirs = vectors(rng, lines, dims, 15), vectors(rng, items, dims, 25)
    rows = lambda given, key: spark.createDataFrame([(n, i, w) for n, v in given.items() for i, w in v.items()], f"{key} long, index int, weight double")
    got = {}
    for r in similarity.top_k_sparse(rows(ours, "line_no"), rows(theirs, "item_no"), k).collect():
        got.setdefault(r.line_no, []).append((r["rank"], r.item_no, round(r.score, 9)))
    want = {}
    for n, v in ours.items():
        scored = sorted((-round(sum(w * theirs[i].get(x, 0.0) for x, w in v.items()), 12), i) for i in theirs)[:k]
        want[n] = [(p + 1, i, round(-s, 9) + 0.0) for p, (s, i) in enumerate(scored)]
    assert {n: sorted(g) for n, g in got.items()} == want


def test_a_bound_on_pairs(spark, monkeypatch):
    """With near texts among the items, most pairs that share a frequent feature are never met."""
    seen = []
    kept = similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, name: seen.append((name, made := kept(df, name))) or made)
    item = [(n, i, w) for n in range(400) for i, w in ((0, 0.5), (1, 0.5), (10 + n // 4, 0.70710678))]
    lines = [(n, i, w) for n in range(40) for i, w in ((0, 0.5), (1, 0.5), (10 + n, 0.70710678))]
    found = similarity.top_k_sparse(spark.createDataFrame(lines, "line_no long, index int, weight double"), spark.createDataFrame(item, "item_no long, index int, weight double"), 2)
    assert found.count() == 80
    scored = dict(seen)["sparse-scores"].count()
    assert scored == 40  # of 40 x 100 pairs of different vectors


def test_texts_and_not_features_are_shuffled(spark):
    """A vector is made from its text within a batch: no task groups the features of all its rows.  Rows of one key are one text; null and empty ones have index 0."""
    from pyspark.sql import functions as F

    from matchloom.functions.features import sparse_embedding, sparse_vectors

    rows = spark.createDataFrame([(1, "tornillo 3,5 mm"), (1, "acero acero"), (2, "tornillo 3,5 mm acero acero"), (3, None), (4, ""), (5, "ñandú")], "k long, x string")
    found = sparse_embedding(rows, ["k"], F.col("x"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "MapInArrow" in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.k, {})[r["index"]] = round(r.weight, 12)
    assert got[1] == got[2] and len(got[1]) > 5 and got[3] == got[4] == {0: 1.0}
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in got.values())
    assert sparse_vectors(rows.where("k > 9"), ["k"], F.col("x")).count() == 0
