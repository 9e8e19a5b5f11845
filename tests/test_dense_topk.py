"""The dense top-k against all pairs: copies, ties, zero and unlike vectors, what is not a number; and that pairs don't pass through Spark's rows."""

from random import Random

import numpy as np
import pytest

from matchloom.operators import similarity


def score_of(a, b):
    """None: no score."""
    lengths = []
    for v in (a, b):
        total = 0.0
        for x in v:
            total += np.nan if x is None else x * x
        lengths.append(0.0 if None in v else float(np.sqrt(total)))
    if 0.0 in lengths:
        return 0.0
    if len(a) != len(b):
        return None
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += x * y
    return total / (lengths[0] * lengths[1])


def best(lines, items, k):
    out = {}
    for n, a in lines.items():
        scored = [(score_of(a, b), i) for i, b in items.items()]
        scored.sort(key=lambda x: (np.inf if x[0] is None else -np.inf if x[0] != x[0] else -x[0], x[1]))
        out[n] = [(i, None if s is None else repr(s)) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("rows, step", [(65_536, 8192), (40, 16)])
@pytest.mark.parametrize("kind", ["copies", "near", "odd"])
def test_dense_top_k(spark, monkeypatch, rows, step, kind):
    monkeypatch.setattr(similarity, "BROADCAST_ITEMS", rows)
    monkeypatch.setattr(similarity, "STEP_ITEMS", step)
    monkeypatch.setattr(similarity, "STEP_PAIRS", 50)
    rng = Random(kind)
    made = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(25)]
    if kind == "near":
        made = [[1.0 + rng.random() * 1e-7 for _ in range(6)] for _ in range(60)]
    if kind == "odd":
        made += [[0.0] * 6, [1.0] * 4, [], [1.0, None, 2.0, 3.0, 4.0, 5.0], [float("nan")] * 6, [float("inf"), 1.0, 1.0, 1.0, 1.0, 1.0], [1e-120] * 6, [1e120] * 6]
    lines, items = {n: rng.choice(made) for n in range(1000, 1050)}, {n: rng.choice(made) for n in range(130)}
    frame = lambda given, n, v: spark.createDataFrame(list(given.items()), f"{n} long, {v} array<double>")
    got = {}
    for r in similarity.top_k_dense(frame(lines, "line_no", "line_vector"), frame(items, "item_no", "item_vector")).orderBy("line_no", "rank").collect():
        got.setdefault(r.line_no, []).append((r.item_no, None if r.score is None else repr(r.score)))
    assert got == best(lines, items, 5)


def test_no_pairs_in_rows(spark):
    """No join of all pairs is planned: what leaves a task is k rows for each line and block."""
    vectors = spark.range(2000).selectExpr("id", "array(cast(id % 7 as float), cast(id % 11 as float), 1f) AS v")
    found = similarity.top_k_dense(vectors.selectExpr("id AS line_no", "v AS line_vector"), vectors.selectExpr("id AS item_no", "v AS item_vector"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert found.count() == 10_000


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, [1.0])], "line_no int, line_vector array<double>")
    none = spark.createDataFrame([], "item_no int, item_vector array<double>")
    found = similarity.top_k_dense(some, none)
    assert found.schema["item_no"].dataType.simpleString() == "int" and found.count() == 0


def test_guide_reads_one_search(spark, data, monkeypatch):
    """guide_accuracy's labels and its cascade share one search of all pairs."""
    from matchloom.plans import catalog

    searches = []
    search = similarity.top_k_dense
    monkeypatch.setattr(similarity, "top_k_dense", lambda *a, **b: searches.append(a) or search(*a, **b))
    assert catalog.guide_accuracy(spark, data).count() == 1
    assert len(searches) == 1
