from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from matchloom.errors import MatchingError
from matchloom.operators import rules, similarity, summary
from matchloom.operators.cascade import reconcile
from matchloom.operators.lines import cross_check, duplicate_lines, line_gaps
from matchloom.operators.models import ModelDecider, stand_in_match

OFFER = "line_no long, supplier_code string, description string, quantity decimal(14,3), unit_price decimal(14,4), flags array<string>"
ITEMS = "item_no long, description string, quantity decimal(14,3)"
CANDIDATES = "line_no long, rank int, item_no long, description string, score double"


def case(spark):
    D = Decimal
    offer = spark.createDataFrame([
        (1, "A", "uno", D(5), D(2), []), (2, "B", "dos", D(4), None, ["technical_equivalent"]), (3, "C", "tres", D(4), D(1), ["alternative_line"]),
        (4, "D", "cuatro", D(1), D(1), ["extra_suggested"]), (5, "E", "cinco", D(9), D(1), []), (6, "F", "seis", D(1), D(1), []),
    ], OFFER)
    items = spark.createDataFrame([(10, "uno", D(5)), (20, "dos", D(4)), (30, "tres", D(3)), (40, "otro", D(1))], ITEMS)
    found = spark.createDataFrame([
        (1, 1, 10, "uno", 0.9), (1, 2, 20, "dos", 0.2), (2, 1, 20, "dos", 0.8), (2, 2, 10, "uno", 0.75), (3, 1, 20, "dos", 0.72), (3, 2, 10, "uno", 0.1), (4, 1, 10, "uno", 0.55), (5, 1, 30, "tres", 0.3),
    ], CANDIDATES)
    return offer, items, found


def test_cascade(spark):
    offer, items, found = case(spark)
    rows = {(r.line_no, r.item_no): r for r in reconcile(offer, items, found).collect()}
    status = {k: r.status for k, r in rows.items()}
    assert status[1, 10] == "match" and rows[1, 10].confidence == 0.95 and not rows[1, 10].needs_review
    # Line 3 has a wider margin and wins; line 2 is no alternative, so it is in doubt.
    assert status[3, 20] == "match" and rows[3, 20].needs_review and "#2" in rows[3, 20].reasoning
    assert status[2, 20] == "ambiguous" and rows[2, 20].price_total is None
    assert status[4, None] == "extra" and abs(rows[4, None].confidence - 0.45) < 1e-9
    assert status[5, 30] == "partial_quantity" if rows[5, 30].confidence >= 0.6 else status[5, 30] == "ambiguous"
    assert status[6, None] == "extra" and rows[6, None].confidence == 0.5
    assert status[None, 40] == "missing_from_offer" and len(rows) == 7
    assert all(len(r.reasoning) > 10 and 0 <= r.confidence <= 1 for r in rows.values())


def test_aliases_come_first(spark):
    offer, items, found = case(spark)
    aliases = spark.createDataFrame([("F", 40), ("F", 30)], "supplier_code string, item_no long")
    row = reconcile(offer, items, found, aliases).where("line_no = 6").first()
    assert (row.item_no, row.decided_by, row.confidence) == (30, "alias", 1.0)


def test_summary_is_a_partition(spark):
    offer, items, found = case(spark)
    s = summary.summarize(reconcile(offer, items, found), items).first()
    assert s.covered + s.ambiguous_items + s.n_missing_from_offer == s.requisition_items == 4
    assert s.quoted_total - s.comparable_total == s.extras_total
    assert s.offer_lines == 6


def test_failed_lines_are_reviewed(spark):
    offer, items, found = case(spark)

    def broken(requests):
        raise RuntimeError("no model")

    rows = reconcile(offer, items, found, decider=ModelDecider(broken)).where("line_no IS NOT NULL").collect()
    assert {(r.status, r.needs_review) for r in rows} == {("ambiguous", True)}
    good = reconcile(offer, items, found, decider=ModelDecider(stand_in_match, batch=2)).where("line_no = 1").first()
    assert (good.item_no, good.decided_by) == (10, "vector+llm")


def test_empty_sides(spark):
    offer, items, found = case(spark)
    with pytest.raises(MatchingError):
        reconcile(offer.where("false"), items, found, check=True)
    assert reconcile(offer.where("false"), items, found.where("false")).count() == 4


def test_gap_is_taken_on_doubles(spark):
    rows = spark.createDataFrame([(1, 1, 0.65, True), (2, 1, 0.5, True), (3, 2, 0.95, True), (4, 2, 0.80, True)], "line_no long, item_no long, confidence double, is_alternative boolean")
    got = {r.line_no: r.conflict_status for r in rules.resolve_conflicts(rows).collect()}
    assert got == {1: None, 2: "ambiguous", 3: None, 4: "alternative"}


def test_one_winner_for_each_item(spark):
    claims = spark.range(300).select(F.col("id").alias("line_no"), (F.col("id") % 17).alias("item_no"), ((F.col("id") * 7 % 10) / 10).alias("confidence"), F.lit(False).alias("is_alternative"))
    got = rules.resolve_conflicts(claims).groupBy("item_no").agg(F.count_if(F.col("conflict_role") == "winner").alias("w")).collect()
    assert {r.w for r in got} == {1}


def test_every_losing_line_is_named(spark, monkeypatch):
    """By whole parts and by parts of seven lines; and in the reasons of the cascade."""
    claims = spark.range(260).select((F.col("id") * 37 % 260).alias("line_no"), F.when(F.col("id") < 250, 1).otherwise(F.col("id")).alias("item_no"), ((F.col("id") * 7 % 10) / 10).alias("confidence"), F.lit(False).alias("is_alternative"))
    lines = sorted((-r.confidence, r.line_no) for r in claims.where("item_no = 1").collect())
    want = [n for _, n in lines]
    for at_once in (rules.LOSERS_AT_ONCE, 7):
        monkeypatch.setattr(rules, "LOSERS_AT_ONCE", at_once)
        got = {r.line_no: (r.losers, r.losing) for r in rules.resolve_conflicts(claims).collect()}
        assert len(got) == 260 and got[want[0]] == (want[1:], 249) and sum(v != (None, None) for v in got.values()) == 1
    offer = spark.range(1, 151).select(F.col("id").alias("line_no"), F.lit("A").alias("supplier_code"), F.lit("uno").alias("description"), F.lit(5).cast("decimal(14,3)").alias("quantity"), F.lit(2).cast("decimal(14,4)").alias("unit_price"), F.array().cast("array<string>").alias("flags"))
    items, found = spark.createDataFrame([(10, "uno", Decimal(5))], ITEMS), spark.createDataFrame([(k, 1, 10, "uno", 0.9) for k in range(1, 151)], CANDIDATES)
    reason = reconcile(offer, items, found).where("line_no = 1").first().reasoning
    assert "otra(s) 149 linea(s) de la oferta apuntan al mismo item (" + ", ".join(f"#{k}" for k in range(2, 151)) + "): gano esta" in reason


def test_roles_alone_do_not_gather_losers(spark):
    claims = spark.range(30).select(F.col("id").alias("line_no"), (F.col("id") % 7).alias("item_no"), F.lit(0.5).alias("confidence"), F.lit(False).alias("is_alternative"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" in plan(rules.resolve_conflicts(claims)) and "collect_list" not in plan(rules.resolve_conflicts(claims).select("line_no", "conflict_role", "conflict_status", "winner_line"))


def test_sparse_top_k_pads_with_zeros(spark):
    own = spark.createDataFrame([(1, 0, 1.0), (2, 5, 1.0)], "line_no long, index int, weight double")
    items = spark.createDataFrame([(10, 0, -1.0), (20, 0, 0.5), (20, 1, 0.8), (30, 1, 1.0), (40, 2, 1.0)], "item_no long, index int, weight double")
    got = {(r.line_no, r["rank"]): (r.item_no, r.score) for r in similarity.top_k_sparse(own, items, 3).collect()}
    assert [got[1, k] for k in (1, 2, 3)] == [(20, 0.5), (30, 0.0), (40, 0.0)]
    assert [got[2, k][0] for k in (1, 2, 3)] == [10, 20, 30]


def test_dense_blocks_give_the_same(spark, data, monkeypatch):
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    own = e.where("vec_id < 5").select(F.col("vec_id").alias("line_no"), F.col("embedding").alias("line_vector"))
    items = e.where("vec_id >= 5").select(F.col("vec_id").alias("item_no"), F.col("embedding").alias("item_vector"))
    whole = similarity.top_k_dense(own, items).orderBy("line_no", "rank").collect()
    monkeypatch.setattr(similarity, "BROADCAST_ITEMS", 100)
    assert similarity.top_k_dense(own, items).orderBy("line_no", "rank").collect() == whole


def test_cross_check(spark):
    schema = "line_no int, unit_price double, quantity double, supplier_code string"
    reference = spark.createDataFrame([(1, 1.0, 2.0, "A"), (2, None, 2.0, ""), (3, 3.0, 1.0, "C")], schema)
    read = spark.createDataFrame([(1, 1.5, 2.0, "A"), (2, 9.0, 2.0, "Z"), (4, 1.0, 1.0, "X")], schema)
    assert sorted((r.line_no, r.code, r.field) for r in cross_check(read, reference).collect()) == [(1, "llm_retry", "unit_price"), (3, "llm_failed", "line")]
    assert cross_check(read, reference.where("false")).count() == 0


def test_gaps_and_duplicates(spark):
    rows = spark.createDataFrame([("a", 2, 1), ("a", 3, 2), ("a", 3, 3), ("a", 7, 4)], "doc string, line_no int, n int")
    assert [(r.line_no, r.missing) for r in line_gaps(rows, ["doc"]).collect()] == [(4, 3)]
    first, more = duplicate_lines(rows, ["doc", "line_no"], ["n"])
    assert first.count() == 3 and [(r.n, r.occurrence) for r in more.collect()] == [(3, 2)]


def test_quality_keeps_every_label(spark):
    lines = spark.createDataFrame([(1, 10, "match"), (2, 20, "match"), (None, 30, "missing_from_offer")], "line_no long, item_no long, status string")
    guide = spark.createDataFrame([(1, 10, "match"), (2, 20, "needs_review"), (None, 30, "missing_from_offer")], "line_no long, item_no long, label string")
    a = summary.accuracy(lines, guide).first()
    assert (a["rows"], a.item_ok, a.status_ok, a.known_rows, a.known_status_ok) == (2, 2, 1, 1, 1)
    m = summary.missing_quality(lines, guide).first()
    assert (m.found, m.expected, m.both) == (1, 1, 1)
