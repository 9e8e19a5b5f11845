"""Queries over the driver's tables, and SQL that gives the same rows.

The tables stand in for the model's: `embeddings` for vectors of offer lines (the rows whose vec_id is a multiple of 20) and of
items (all others), `part` for requested items, `lineitem` for offer lines, texts built from rows for what documents say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import features, text
from ..operators import lines, rules, similarity, store, summary
from ..operators.cascade import alias_matches, reconcile
from ..operators.models import ModelDecider, embeddings_with_cache, stand_in_match
from ..schemas import EMBEDDINGS
from ..sources import offers
from ..written import written
from . import report
from .registry import ORACLE_SQL, QUERIES, query, t  # noqa: F401

# --- similarity -------------------------------------------------------------------------------

#: Rows of `embeddings` with such multiples as ids are the lines; all others are the items.
LINE_EVERY = 20


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = t(spark, d, "embeddings")
    asks = F.col("vec_id") % LINE_EVERY == 0
    own = e.where(asks).select(F.col("vec_id").alias("line_no"), F.col("embedding").alias("line_vector"))
    return own, e.where(~asks).select(F.col("vec_id").alias("item_no"), F.col("embedding").alias("item_vector"))


_PAIRS = """pairs AS (SELECT q.vec_id AS line_no, i.vec_id AS item_no, q.label AS line_label, i.label AS item_label,
    list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS score
  FROM embeddings q CROSS JOIN embeddings i WHERE q.vec_id % 20 = 0 AND i.vec_id % 20 <> 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY score DESC, item_no) AS rank FROM pairs)"""


@query(f"WITH {_PAIRS} SELECT line_no, rank::INT AS rank, item_no, round(score, 4) AS score FROM ranked WHERE rank <= 5")
def topk_cosine(spark, d):
    return similarity.top_k_dense(*_vectors(spark, d)).select("line_no", "rank", "item_no", F.round("score", 4).alias("score"))


@query("""SELECT i.vec_id AS item_no, round(list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]), 4) AS score
  FROM embeddings q, embeddings i WHERE q.vec_id = 7 AND i.vec_id <> 7 ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) DESC, item_no LIMIT 5""")
def topk_single(spark, d):
    e = t(spark, d, "embeddings")
    vector = F.array(*[F.lit(float(x)) for x in e.where("vec_id = 7").first().embedding])
    items = e.where("vec_id <> 7").select(F.col("vec_id").alias("item_no"), F.col("embedding").alias("item_vector"))
    return similarity.top_k_for(items, vector).select("item_no", F.round("score", 4).alias("score"))


@query(f"""WITH {_PAIRS}, best AS (SELECT line_no, min(CASE WHEN item_label = line_label THEN rank END) AS place FROM ranked WHERE rank <= 5 GROUP BY line_no)
  SELECT count(*) AS lines, round(avg(CASE WHEN place = 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k FROM best""")
def recall_at_k(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", "label")
    ranked = similarity.top_k_dense(*_vectors(spark, d))
    # Every item of the line's label is right: one truth row for each line that finds any, and one for each that doesn't.
    labelled = ranked.join(e.toDF("line_no", "_l"), "line_no").join(e.toDF("item_no", "_i"), "item_no")
    place = labelled.groupBy("line_no").agg(F.min(F.when(F.col("_l") == F.col("_i"), F.col("rank"))).alias("rank"))
    found = place.select("line_no", F.lit(0).alias("item_no"), "rank").where("rank IS NOT NULL")
    got = summary.recall_at_k(found, place.select("line_no", F.lit(0).alias("item_no")))
    return got.select("lines", F.round("recall_at_1", 6).alias("recall_at_1"), F.round("recall_at_k", 6).alias("recall_at_k"))


_FLAGS = """(CASE WHEN {0} % 11 = 3 THEN ['extra_suggested'] WHEN {0} % 7 = 2 THEN ['technical_equivalent'] WHEN {0} % 5 = 1 THEN ['alternative_line'] ELSE []::VARCHAR[] END)"""


def _flags(line_no):
    n, none = F.expr(f"{line_no} div {LINE_EVERY}"), F.array().cast("array<string>")
    return F.when(n % 11 == 3, F.array(F.lit("extra_suggested"))).when(n % 7 == 2, F.array(F.lit("technical_equivalent"))).when(n % 5 == 1, F.array(F.lit("alternative_line"))).otherwise(none)


_BEST = f"""{_PAIRS}, best AS (SELECT line_no, max(CASE WHEN rank = 1 THEN score END) AS s1, max(CASE WHEN rank = 2 THEN score END) AS s2, max(CASE WHEN rank = 1 THEN item_no END) AS top
  FROM ranked WHERE rank <= 5 GROUP BY line_no), lexical AS (SELECT line_no, top, s1, {_FLAGS.format("(line_no // 20)")} AS flags,
  CASE WHEN list_contains({_FLAGS.format("(line_no // 20)")}, 'extra_suggested') AND s1 < 0.6 THEN 'extra' WHEN s1 < 0.25 THEN 'extra' ELSE 'match' END AS kind,
  round(least(0.95::DOUBLE, s1 + least(CASE WHEN s2 IS NULL THEN s1 ELSE s1 - s2 END, 0.15::DOUBLE)), 2) AS confidence FROM best)"""


@query(f"WITH {_BEST} SELECT line_no, kind, CASE WHEN kind = 'match' THEN top END AS item_no, CASE WHEN kind = 'match' THEN confidence END AS confidence FROM lexical")
def lexical_decide(spark, d):
    ranked = similarity.top_k_dense(*_vectors(spark, d))
    best = ranked.groupBy("line_no").agg(*[F.max(F.when(F.col("rank") == k, F.col(c))).alias(n) for k, c, n in ((1, "score", "s1"), (2, "score", "s2"), (1, "item_no", "top"))])
    kind = rules.lexical_kind(F.col("s1"), _flags("line_no"))
    match = kind == "match"
    return best.select("line_no", kind.alias("kind"), F.when(match, F.col("top")).alias("item_no"), F.when(match, rules.lexical_confidence(F.col("s1"), F.col("s2"))).alias("confidence"))


# --- conflicts, status, joins ------------------------------------------------------------------

_CLAIMS = """claims AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS line_no,
    l_partkey AS item_no, round(0.5 + l_discount * 4, 2) AS confidence, l_quantity % 2 = 0 AS is_alternative FROM lineitem)"""


def _claims(spark, d) -> DataFrame:
    own = t(spark, d, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    line = (F.col("l_orderkey") * 1000 + F.row_number().over(order)).cast("long")
    return own.select(line.alias("line_no"), F.col("l_partkey").alias("item_no"), F.round(0.5 + F.col("l_discount") * 4, 2).alias("confidence"), (F.col("l_quantity") % 2 == 0).alias("is_alternative"))


@query(f"""WITH {_CLAIMS}, placed AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY item_no) AS n, first_value(confidence) OVER w AS best, first_value(line_no) OVER w AS winner
    FROM claims WINDOW w AS (PARTITION BY item_no ORDER BY confidence DESC, line_no))
  SELECT line_no, item_no, CASE WHEN n > 1 THEN CASE WHEN place = 1 THEN 'winner' ELSE 'loser' END END AS conflict_role,
    CASE WHEN n > 1 AND place > 1 THEN CASE WHEN is_alternative AND best - confidence <= 0.15::DOUBLE THEN 'alternative' ELSE 'ambiguous' END END AS conflict_status,
    CASE WHEN n > 1 THEN winner END AS winner_line FROM placed""")
def conflict_resolve(spark, d):
    claims = written(_claims(spark, d), "claims")  # read three times
    return rules.resolve_conflicts(claims).select("line_no", "item_no", "conflict_role", "conflict_status", "winner_line")


@query(f"""WITH {_CLAIMS} SELECT item_no, count(*) AS claimants, string_agg('#' || line_no, ', ' ORDER BY confidence DESC, line_no) AS claims FROM claims GROUP BY item_no HAVING count(*) > 1""")
def claimant_lists(spark, d):
    listed = _claims(spark, d).groupBy("item_no").agg(F.count("*").alias("claimants"), F.sort_array(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "line_no"))).alias("l"))
    return listed.where("claimants > 1").select("item_no", "claimants", F.array_join(F.transform("l", lambda x: F.concat(F.lit("#"), x["line_no"].cast("string"))), ", ").alias("claims"))


_STATUS = """CASE WHEN c < 0.6::DOUBLE THEN 'ambiguous' WHEN delta <> 0 THEN 'partial_quantity' WHEN k % 7 = 2 THEN 'semantic_match' ELSE 'match' END"""


@query(f"""WITH x AS (SELECT l_orderkey AS k, l_linenumber AS line, l_partkey AS part, l_quantity AS offered, p_size AS requested, round(0.55 + l_discount * 4, 2) AS c, l_quantity - p_size AS delta, l_extendedprice AS price, l_shipdate AS shipped, l_tax AS tax FROM lineitem JOIN part ON l_partkey = p_partkey),
  y AS (SELECT *, {_STATUS} AS status FROM x)
  SELECT k, line, part, price, shipped, tax, status, delta, status IN ('semantic_match', 'alternative', 'ambiguous', 'missing_from_offer') OR c < 0.6::DOUBLE AS review, coalesce(delta < 0, false) AS short,
    CASE status WHEN 'ambiguous' THEN 0 WHEN 'semantic_match' THEN 2 WHEN 'partial_quantity' THEN 4 ELSE 6 END::INT AS priority FROM y""")
def status_rules(spark, d):
    rows = t(spark, d, "lineitem").join(t(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    c, delta = F.round(0.55 + F.col("l_discount") * 4, 2), F.col("l_quantity") - F.col("p_size")
    flags = F.when(F.col("l_orderkey") % 7 == 2, F.array(F.lit("technical_equivalent"))).otherwise(F.array().cast("array<string>"))
    status = rules.status_of(c, delta, flags)
    return rows.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"), F.col("l_shipdate").alias("shipped"), F.col("l_tax").alias("tax"),
        status.alias("status"), delta.alias("delta"), rules.needs_review(status, c).alias("review"), rules.is_shortfall(delta).alias("short"), rules.status_priority(status).alias("priority"),
    )


@query("SELECT p_partkey AS item_no, p_name AS description FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
def missing_sweep(spark, d):
    claimed = t(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("item_no"))
    return t(spark, d, "part").select(F.col("p_partkey").alias("item_no"), F.col("p_name").alias("description")).join(claimed, "item_no", "left_anti")


@query("""SELECT l_orderkey AS line_no, min(p_partkey) AS item_no FROM lineitem JOIN part ON l_suppkey = p_partkey % 10 + 1 AND l_partkey = p_partkey GROUP BY ALL""")
def alias_join(spark, d):
    code = lambda supplier, part: F.concat(F.lit("S"), supplier.cast("string"), F.lit("-"), F.col(part).cast("string"))
    offer = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("line_no"), code(F.col("l_suppkey"), "l_partkey").alias("supplier_code"))
    aliases = t(spark, d, "part").select(code(F.col("p_partkey") % 10 + 1, "p_partkey").alias("supplier_code"), F.col("p_partkey").alias("item_no"))
    return alias_matches(offer, aliases).groupBy("line_no").agg(F.min("item_no").alias("item_no"))


def _cascade(spark, d, decider=None, ranked=None) -> tuple[DataFrame, DataFrame]:
    """(cascade rows, requisition) over embeddings: quantities, prices, flags and aliases follow from ids.  `ranked`: the search's result, where the caller has it."""
    own, items = _vectors(spark, d)
    n, m = F.col("line_no"), F.expr(f"line_no div {LINE_EVERY}")
    offer = own.select(
        "line_no", F.when(m % 2 == 0, F.concat(F.lit("C"), n.cast("string"))).alias("supplier_code"), F.concat(F.lit("line "), n.cast("string")).alias("description"),
        (m % 4 + 1).cast("decimal(14,3)").alias("quantity"), F.when(m % 9 != 4, (m * 3 + 1) / 4).cast("decimal(14,4)").alias("unit_price"), _flags("line_no").alias("flags"),
    )
    requisition = items.select("item_no", F.concat(F.lit("item "), F.col("item_no").cast("string")).alias("description"), (F.col("item_no") % 4 + 1).cast("decimal(14,3)").alias("quantity"))
    ranked = similarity.top_k_dense(own, items) if ranked is None else ranked
    ranked = ranked.select("line_no", "rank", "item_no", F.concat(F.lit("item "), F.col("item_no").cast("string")).alias("description"), "score")
    aliases = own.where(m % 4 == 0).select(F.concat(F.lit("C"), n.cast("string")).alias("supplier_code"), (n + 1).alias("item_no"))
    return reconcile(offer, requisition, ranked, aliases, decider), requisition


_FLAGSHIP = f"""{_BEST}, decided AS (SELECT line_no, flags, s1, CASE WHEN line_no % 80 = 0 THEN line_no + 1 WHEN kind = 'match' THEN top END AS item_no,
    CASE WHEN line_no % 80 = 0 THEN 1.0::DOUBLE WHEN kind = 'match' THEN confidence END AS confidence, CASE WHEN line_no % 80 = 0 THEN 'alias' WHEN kind = 'match' THEN 'lexical' ELSE 'unmatched' END AS decided_by,
    (line_no // 20 % 4 + 1) AS quantity, CASE WHEN line_no // 20 % 9 <> 4 THEN ((line_no // 20 * 3 + 1) / 4)::DECIMAL(14, 4) END AS unit_price FROM lexical),
  claims AS (SELECT d.*, (item_no % 4 + 1) AS requested, row_number() OVER w AS place, count(*) OVER (PARTITION BY item_no) AS n, first_value(confidence) OVER w AS best FROM decided d WHERE item_no IS NOT NULL
    WINDOW w AS (PARTITION BY item_no ORDER BY confidence DESC, line_no)),
  settled AS (SELECT line_no, item_no, confidence, (quantity - requested)::DECIMAL(14, 3) AS quantity_delta, (unit_price * quantity)::DECIMAL(16, 4) AS price_total, decided_by, n, place, CASE
    WHEN n > 1 AND place > 1 THEN CASE WHEN list_contains(flags, 'alternative_line') AND best - confidence <= 0.15::DOUBLE THEN 'alternative' ELSE 'ambiguous' END
    WHEN confidence < 0.6::DOUBLE THEN 'ambiguous' WHEN quantity <> requested THEN 'partial_quantity' WHEN list_contains(flags, 'technical_equivalent') THEN 'semantic_match' ELSE 'match' END AS status FROM claims),
  cascade AS (SELECT line_no, item_no, status, confidence, quantity_delta, price_total, status IN ('semantic_match', 'alternative', 'ambiguous', 'missing_from_offer') OR confidence < 0.6::DOUBLE OR n > 1 AS needs_review, decided_by FROM settled
    UNION ALL SELECT line_no, NULL, 'extra', greatest(0, 1 - round(s1, 4)), NULL, (unit_price * quantity)::DECIMAL(16, 4), false, 'unmatched' FROM decided WHERE item_no IS NULL
    UNION ALL SELECT NULL, vec_id, 'missing_from_offer', 1.0, NULL, NULL, true, 'unmatched' FROM embeddings WHERE vec_id % 20 <> 0 AND vec_id NOT IN (SELECT item_no FROM settled WHERE place = 1))"""


@query(f"WITH {_FLAGSHIP} SELECT line_no, item_no, status, round(confidence, 4) AS confidence, quantity_delta::DOUBLE AS quantity_delta, price_total::DOUBLE AS price_total, needs_review, decided_by FROM cascade")
def cascade_flagship(spark, d):
    rows, _ = _cascade(spark, d)
    return rows.select("line_no", "item_no", "status", F.round("confidence", 4).alias("confidence"), F.col("quantity_delta").cast("double").alias("quantity_delta"), F.col("price_total").cast("double").alias("price_total"), "needs_review", "decided_by")


@query(f"""WITH {_FLAGSHIP}, by_item AS (SELECT item_no, bool_or(line_no IS NOT NULL AND status IN ('match', 'partial_quantity', 'semantic_match')) AS c, bool_or(status = 'ambiguous') AS a FROM cascade WHERE item_no IS NOT NULL GROUP BY item_no)
  SELECT count(line_no) AS offer_lines, (SELECT count(*) FROM embeddings WHERE vec_id % 20 <> 0) AS requisition_items, (SELECT count(*) FROM by_item WHERE c) AS covered, (SELECT count(*) FROM by_item WHERE a AND NOT c) AS ambiguous_items,
    count(*) FILTER (status = 'match') AS n_match, count(*) FILTER (status = 'extra') AS n_extra, count(*) FILTER (status = 'missing_from_offer') AS n_missing, count(*) FILTER (needs_review) AS needs_review,
    sum(coalesce(price_total, 0))::DOUBLE AS quoted_total, sum(CASE WHEN item_no IS NOT NULL AND status <> 'alternative' THEN coalesce(price_total, 0) ELSE 0 END)::DOUBLE AS comparable_total,
    sum(CASE WHEN status = 'extra' THEN coalesce(price_total, 0) ELSE 0 END)::DOUBLE AS extras_total, count(*) FILTER (quantity_delta < 0) AS shortfall_lines, count(*) FILTER (quantity_delta > 0) AS overage_lines,
    round((SELECT count(*) FROM by_item WHERE c) / (SELECT count(*) FROM embeddings WHERE vec_id % 20 <> 0) * 100, 1) AS coverage_pct FROM cascade""")
def summary_agg(spark, d):
    rows, requisition = _cascade(spark, d)
    s = summary.summarize(rows, requisition)
    money = [F.col(c).cast("double").alias(c) for c in ("quoted_total", "comparable_total", "extras_total")]
    return s.select("offer_lines", "requisition_items", "covered", "ambiguous_items", "n_match", "n_extra", F.col("n_missing_from_offer").alias("n_missing"), "needs_review", *money, "shortfall_lines", "overage_lines", "coverage_pct")


@query(f"WITH {_FLAGSHIP} SELECT status, count(*) AS n FROM cascade GROUP BY status")
def cascade_status_counts(spark, d):
    return summary.status_counts(_cascade(spark, d)[0])


@query(f"""WITH {_FLAGSHIP} SELECT count(*) AS rows, count(*) FILTER (item_no IS NOT DISTINCT FROM guide_item) AS item_ok, count(*) FILTER (item_no IS NOT DISTINCT FROM guide_item AND status = label) AS status_ok
  FROM (SELECT c.line_no, c.item_no, c.status, r.item_no AS guide_item, CASE WHEN r.line_no // 20 % 6 = 5 THEN 'needs_review' WHEN r.line_no // 20 % 2 = 0 THEN 'match' ELSE 'partial_quantity' END AS label FROM cascade c JOIN ranked r ON c.line_no = r.line_no AND r.rank = 1)""")
def guide_accuracy(spark, d):
    ranked = written(similarity.top_k_dense(*_vectors(spark, d)), "candidates")  # the guide's labels and the cascade read one search
    rows, _ = _cascade(spark, d, ranked=ranked)
    ranked = ranked.where("rank = 1")
    m = F.expr(f"line_no div {LINE_EVERY}")
    label = F.when(m % 6 == 5, "needs_review").when(m % 2 == 0, "match").otherwise("partial_quantity")
    return summary.accuracy(rows, ranked.select("line_no", "item_no", label.alias("label"))).select("rows", "item_ok", "status_ok")


@query(f"""WITH {_PAIRS} SELECT line_no, CASE WHEN score >= 0.5 THEN item_no END AS item_no, CASE WHEN score >= 0.5 THEN round(score, 4) END AS confidence FROM ranked WHERE rank = 1""")
def model_decide(spark, d):
    ranked = similarity.top_k_dense(*_vectors(spark, d)).withColumn("description", F.lit("item"))
    listed = ranked.groupBy("line_no").agg(F.sort_array(F.collect_list(F.struct("rank", "item_no", "description", "score"))).alias("candidates")).withColumn("description", F.lit("line"))
    return ModelDecider(stand_in_match).decide(listed).select("line_no", "item_no", F.round("confidence", 4).alias("confidence"))


# --- counts, lines, sets -----------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def status_counts(spark, d):
    return summary.status_counts(t(spark, d, "events"), "event_type")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL")
def list_counts(spark, d):
    return summary.child_counts(t(spark, d, "customer").select("c_custkey", "c_name"), t(spark, d, "orders"), "c_custkey", "o_custkey")


@query("""SELECT l_orderkey AS doc, prev + 1 AS line_no, cur - prev - 1 AS missing FROM (SELECT l_orderkey, l_linenumber AS cur, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS prev
  FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) WHERE cur <> prev + 1""")
def line_gaps(spark, d):
    return lines.line_gaps(t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "doc"), ["doc"], "l_linenumber")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, occurrence FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate)::INT AS occurrence FROM lineitem) WHERE occurrence > 1""")
def duplicate_lines(spark, d):
    order = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
    return lines.duplicate_lines(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], order)[1].select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "occurrence")


_READ = "SELECT o_orderkey AS line_no, o_totalprice AS unit_price, o_custkey::DOUBLE AS quantity, o_orderpriority AS supplier_code FROM orders"


@query(f"""WITH r AS (SELECT line_no, unit_price, quantity, CASE WHEN line_no % 3 = 0 THEN '' ELSE supplier_code END AS supplier_code FROM ({_READ})),
  m AS (SELECT line_no, CASE WHEN line_no % 17 = 0 THEN unit_price + 1 ELSE unit_price END AS unit_price, CASE WHEN line_no % 19 = 0 THEN quantity + 1 ELSE quantity END AS quantity, CASE WHEN line_no % 23 < 2 THEN 'X' ELSE supplier_code END AS supplier_code FROM ({_READ}) WHERE line_no % 29 <> 0)
  SELECT line_no, 'llm_retry' AS code, 'unit_price' AS field FROM r JOIN m USING (line_no) WHERE r.unit_price IS NOT NULL AND m.unit_price IS DISTINCT FROM r.unit_price
  UNION ALL SELECT line_no, 'llm_retry', 'quantity' FROM r JOIN m USING (line_no) WHERE m.quantity IS DISTINCT FROM r.quantity
  UNION ALL SELECT line_no, 'llm_retry', 'supplier_code' FROM r JOIN m USING (line_no) WHERE r.supplier_code <> '' AND m.supplier_code IS DISTINCT FROM r.supplier_code
  UNION ALL SELECT line_no, 'llm_failed', 'line' FROM r WHERE line_no NOT IN (SELECT line_no FROM m)""")
def cross_check(spark, d):
    n = F.col("line_no")
    base = t(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.col("o_totalprice").alias("unit_price"), F.col("o_custkey").cast("double").alias("quantity"), F.col("o_orderpriority").alias("supplier_code"))
    reference = base.withColumn("supplier_code", F.when(n % 3 == 0, "").otherwise(F.col("supplier_code")))
    read = base.where(n % 29 != 0).select(
        "line_no", F.when(n % 17 == 0, F.col("unit_price") + 1).otherwise(F.col("unit_price")).alias("unit_price"), F.when(n % 19 == 0, F.col("quantity") + 1).otherwise(F.col("quantity")).alias("quantity"),
        F.when(n % 23 < 2, "X").otherwise(F.col("supplier_code")).alias("supplier_code"),
    )
    return lines.cross_check(read, reference).select("line_no", "code", "field")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, 'Q' || s_suppkey AS quote_code, n_name AS provider_name, r_name AS requisition_title FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON l_partkey % 5 = r_regionkey""")
def report_head(spark, d):
    done = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("offer_id"), (F.col("l_partkey") % 5).alias("requisition_id"))
    none = [F.lit(None).cast("string").alias(c) for c in ("quote_date", "terms", "source_format", "source_filename")]
    offered = t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("provider_id"), F.concat(F.lit("Q"), F.col("s_suppkey").cast("string")).alias("quote_code"), *none)
    providers = t(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    requisitions = t(spark, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("code"), F.col("r_name").alias("title"))
    return report.report_head(done, offered, providers, requisitions).select("l_orderkey", "l_linenumber", "l_partkey", "quote_code", "provider_name", "requisition_title")


_REPORTED = """reported AS (SELECT o_orderkey AS line_no, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS item_no, CASE o_orderstatus WHEN 'O' THEN 'ambiguous' WHEN 'P' THEN 'partial_quantity' ELSE 'match' END AS status, (o_orderkey % 97)::DOUBLE AS confidence,
    o_orderpriority AS offered_description, c_name AS requested_description, CASE WHEN o_orderkey % 3 = 0 THEN 'caja' ELSE 'unit' END AS offered_unit, CASE WHEN c_custkey IS NOT NULL THEN c_mktsegment END AS requested_unit, o_totalprice AS unit_price
  FROM orders LEFT JOIN customer ON CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END = c_custkey)"""
_SHOWN = ["line_no", "item_no", "status", "confidence", "offered_description", "requested_description", "offered_unit", "requested_unit", "unit_price"]


def _reported(spark, d) -> DataFrame:
    orders, n = t(spark, d, "orders"), F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "O", "ambiguous").when(F.col("o_orderstatus") == "P", "partial_quantity").otherwise("match")
    rows = orders.select(n.alias("line_no"), F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("item_no"), status.alias("status"), (n % 97).cast("double").alias("confidence"))
    offer = orders.select(
        n.alias("line_no"), F.col("o_orderpriority").alias("description"), F.lit(1.0).alias("quantity"), F.lit("x").alias("supplier_code"), F.col("o_totalprice").alias("unit_price"),
        F.when(n % 3 == 0, "caja").alias("raw_unit"), F.lit("unit").alias("unit_of_measure"),
    )
    requisition = t(spark, d, "customer").select(F.col("c_custkey").alias("item_no"), F.col("c_name").alias("description"), F.lit(1.0).alias("quantity"), F.lit(None).cast("string").alias("raw_unit"), F.col("c_mktsegment").alias("unit_of_measure"))
    return report.report_lines(rows, offer, requisition).select(_SHOWN)


@query(f"WITH {_REPORTED} SELECT {', '.join(_SHOWN)} FROM reported")
def report_lines(spark, d):
    return _reported(spark, d)


@query(f"""WITH {_REPORTED} SELECT {', '.join(_SHOWN)} FROM reported ORDER BY CASE status WHEN 'ambiguous' THEN 0 WHEN 'partial_quantity' THEN 4 ELSE 6 END, confidence, coalesce(item_no, line_no, 0), coalesce(line_no, 0) LIMIT 40""")
def report_details(spark, d):
    """The first lines of a report, as many as its list of details shows."""
    return _reported(spark, d).limit(report.SHOWN_DETAILS)


@query("SELECT DISTINCT n_regionkey AS k, 'common' AS side FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region) UNION ALL SELECT DISTINCT c_nationkey, 'customers only' FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) UNION ALL SELECT n_nationkey, 'all' FROM nation UNION ALL SELECT r_regionkey, 'all' FROM region")
def set_ops(spark, d):
    nations, regions = t(spark, d, "nation"), t(spark, d, "region").select(F.col("r_regionkey").alias("k"))
    common = nations.select(F.col("n_regionkey").alias("k")).intersect(regions)
    only = t(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(t(spark, d, "supplier").where("s_acctbal < 0").select("s_nationkey"))
    both = nations.select(F.col("n_nationkey").alias("k")).unionByName(regions)
    return common.withColumn("side", F.lit("common")).unionByName(only.withColumn("side", F.lit("customers only"))).unionByName(both.withColumn("side", F.lit("all")))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'a, b, c' ELSE 'a, b' END AS flags FROM orders")
def flag_union(spark, d):
    own, notes = F.array(F.lit("a"), F.lit("b")), F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    return t(spark, d, "orders").select("o_orderkey", F.array_join(F.array_union(own, notes), ", ").alias("flags"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 60")
def ordered_limit(spark, d):
    return t(spark, d, "orders").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(60).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, greatest(1, count(*) OVER () // 10) AS step FROM orders) WHERE i % step = 0")
def stride_sample(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey")
    step = max(1, orders.count() // 10)
    # Places come from counts of ranges, so that no task orders all rows.
    ranged = orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").withColumn("_id", F.monotonically_increasing_id())
    # Written once: bounds are sampled, and counts and rows must be of the same partitions.
    ranged = written(ranged, "stride").withColumn("_part", F.shiftright("_id", 33)).withColumn("_in", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(F.broadcast(before), "_part").where((F.col("_before") + F.col("_in")) % step == 0).select("o_orderkey")


@query("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.v, o.v) AS v, o.kept AS kept FROM (SELECT o_orderkey AS k, o_totalprice AS v, o_orderpriority AS kept FROM orders WHERE o_orderkey % 3 <> 0) o
  FULL JOIN (SELECT o_orderkey AS k, o_totalprice + 1 AS v FROM orders WHERE o_orderkey % 5 = 0) n ON o.k = n.k""")
def upsert_merge(spark, d):
    orders = t(spark, d, "orders")
    old = orders.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderpriority").alias("kept"))
    new = orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1).alias("v"))
    return store.merged(old, new, ["k"])


@query("SELECT o_orderkey AS id, CASE WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'reconciled' ELSE 'extracted' END AS status FROM orders")
def reconciled_status(spark, d):
    done = t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("offer_id"))
    return store.reconciled_offers(t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("x").alias("status")), done)


@query("SELECT p_brand, count(*) AS rows, count(DISTINCT p_type) AS types, count(*) FILTER (p_size > 25) AS large, sum(p_retailprice::DECIMAL(14, 4))::DOUBLE AS total FROM part GROUP BY p_brand")
def conditional_counts(spark, d):
    price = F.sum(F.col("p_retailprice").cast("decimal(14,4)")).cast("double")
    return t(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("rows"), F.countDistinct("p_type").alias("types"), F.count_if(F.col("p_size") > 25).alias("large"), price.alias("total"))


@query("SELECT vec_id, len(embedding) AS width FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) <> 63")
def embedding_width(spark, d):
    from ..sources.tables import embedding_widths

    return embedding_widths(t(spark, d, "embeddings"), 63).select("vec_id", F.size("embedding").cast("long").alias("width"))


# --- scalar functions --------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS price, round(l_extendedprice, 2) AS parsed, (CASE WHEN l_quantity >= 1000 THEN 0 ELSE l_quantity END)::DOUBLE AS whole FROM lineitem""")
def parse_arg_number(spark, d):
    rows = t(spark, d, "lineitem")
    shown = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "$ ").otherwise(""), text.es_number(F.col("l_extendedprice"), 2))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), text.parse_arg_number(shown).alias("parsed"), text.parse_arg_number(F.col("l_quantity").cast("int").cast("string")).alias("whole"))


_UNIT_TEXTS = ("Unidad", "MTS.", "bidón", "c/u", "c u", "Rollos", "barril", " litro ", "Cajas", "juego", "u.", "paquete")


@query("""SELECT p_partkey, raw, CASE replace(regexp_replace(lower(strip_accents(trim(raw))), '\\.$', ''), ' ', '') WHEN 'unidad' THEN 'unit' WHEN 'mts' THEN 'meter' WHEN 'bidon' THEN 'drum' WHEN 'rollos' THEN 'roll' WHEN 'litro' THEN 'liter'
  WHEN 'cajas' THEN 'box' WHEN 'juego' THEN 'set' WHEN 'u' THEN 'unit' WHEN 'cu' THEN 'unit' WHEN 'paquete' THEN 'pack' END AS unit
  FROM (SELECT p_partkey, ['Unidad', 'MTS.', 'bidón', 'c/u', 'c u', 'Rollos', 'barril', ' litro ', 'Cajas', 'juego', 'u.', 'paquete'][p_partkey % 12 + 1] AS raw FROM part)""")
def normalize_unit(spark, d):
    raw = F.element_at(F.array(*[F.lit(u) for u in _UNIT_TEXTS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    return t(spark, d, "part").select("p_partkey", raw.alias("raw"), text.normalize_unit(raw).alias("unit"))


_NOTES = ("Equivalente técnico; bulto mínimo", "stock parcial | entrega rápida", "línea alternativa", "", "marca a confirmar;marca a confirmar", "adicional no pedido", "cantidad disponible menor", "sin datos")


@query("""SELECT p_partkey, n, (['technical_equivalent,min_order_qty', 'partial_stock', 'alternative_line', '', 'brand_to_confirm', 'extra_suggested', 'partial_stock', ''])[n + 1] AS flags, (['', 'entrega rápida', '', '', '', '', '', 'sin datos'])[n + 1] AS unknown
  FROM (SELECT p_partkey, p_partkey % 8 AS n FROM part)""")
def parse_notes(spark, d):
    raw = F.element_at(F.array(*[F.lit(n) for n in _NOTES]), (F.col("p_partkey") % 8 + 1).cast("int"))
    parsed = text.parse_notes(raw)
    return t(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 8).alias("n"), F.array_join(parsed["flags"], ",").alias("flags"), F.array_join(parsed["unrecognized"], ",").alias("unknown"))


@query("""SELECT p_partkey, p_name AS description, CASE WHEN p_partkey % 3 = 0 THEN 'technical_equivalent' WHEN p_partkey % 3 = 1 THEN 'alternative_line' ELSE '' END AS flags FROM part""")
def parse_description(spark, d):
    n = F.col("p_partkey") % 3
    raw = F.when(n == 0, F.concat(F.lit("Equivalente  técnico "), "p_name")).when(n == 1, F.concat(F.lit("  "), "p_name", F.lit("  Línea alternativa "))).otherwise(F.col("p_name"))
    parsed = text.parse_description(raw)
    return t(spark, d, "part").select("p_partkey", parsed["description"].alias("description"), F.array_join(parsed["flags"], ",").alias("flags"))


@query("SELECT p_partkey, lower(strip_accents(p_name)) || CASE WHEN p_partkey % 2 = 0 THEN ' [meter]' ELSE '' END AS embedded, regexp_replace(lower(strip_accents(p_type)), '[^a-z0-9]', '', 'g') AS canon FROM part")
def embedding_text(spark, d):
    unit = F.when(F.col("p_partkey") % 2 == 0, "meter")
    return t(spark, d, "part").select("p_partkey", text.embedding_text(F.col("p_name"), unit).alias("embedded"), text.canon(F.col("p_type")).alias("canon"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark, d):
    return t(spark, d, "documents").select("doc_id", text.strip_accents(F.col("text")).alias("plain"))


@query("""WITH k AS (SELECT item_id, regexp_extract_all(replace(lower(strip_accents(text)), ',', '.'), '\\d+(?:[.,]\\d+)?|[a-z]+') AS tokens FROM benchmark)
  SELECT item_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens, list_sum(list_transform(list_filter(tokens, lambda x: len(x) >= 4), lambda x: len(x) - 2))::BIGINT AS n_trigrams FROM k""")
def tokenize(spark, d):
    tokens = features.tokenize(F.col("text"))
    return t(spark, d, "benchmark").select("item_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"), F.nullif(F.size(features.trigrams(tokens)).cast("long"), F.lit(0)).alias("n_trigrams"))


@query("""SELECT item_id, word, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(word, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::UBIGINT)::BIGINT AS h
  FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z]+')) AS word FROM benchmark)""")
def fnv_hash(spark, d):
    words = t(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(text.folded(F.col("text")), F.lit("[a-z]+"), F.lit(0))).alias("word")).distinct()
    return words.select("item_id", "word", features.fnv1a(F.col("word"), 0).alias("h"))


def _embedded(rows: str) -> str:
    """CTEs that end in `embedded` (key, index, weight) of the rows (key, text) of a query."""
    fnv = "list_reduce(list_prepend({0}::UBIGINT, list_transform(string_split(f, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: ((xor(h, c)::HUGEINT * 16777619) % 4294967296)::UBIGINT)"
    return f"""texts AS ({rows}),
  tokens AS (SELECT text, unnest(regexp_extract_all(replace(lower(strip_accents(text)), ',', '.'), '\\d+(?:[.,]\\d+)?|[a-z]+')) AS tok FROM (SELECT DISTINCT text FROM texts)),
  feats AS (SELECT text, 't:' || tok AS f, 1.0::DOUBLE AS w FROM tokens UNION ALL SELECT text, 'g:' || unnest(list_transform(range(1, len(tok) - 1), lambda i: tok[i:i + 2])), 0.35::DOUBLE FROM tokens WHERE len(tok) >= 4),
  hashed AS (SELECT f, {fnv.format(0x811C9DC5)} % 1536 AS index, {fnv.format(0x811C9DC5 ^ 0x9E3779B9)} % 2 = 1 AS plus FROM (SELECT DISTINCT f FROM feats)),
  sums AS (SELECT text, index::INT AS index, sum(CASE WHEN plus THEN w ELSE -w END) AS w FROM feats JOIN hashed USING (f) GROUP BY text, index),
  units AS (SELECT text, index, w / sqrt(sum(w * w) OVER (PARTITION BY text)) AS weight FROM sums WHERE abs(w) > 1e-12),
  embedded AS (SELECT key, coalesce(index, 0) AS index, coalesce(weight, 1) AS weight FROM texts LEFT JOIN units USING (text))"""


@query(f"WITH {_embedded('SELECT p_partkey AS key, p_name AS text FROM part')} SELECT key AS p_partkey, index, round(weight, 6) AS weight FROM embedded")
def lexical_embedding(spark, d):
    return features.sparse_embedding(t(spark, d, "part"), ["p_partkey"], F.col("p_name")).select("p_partkey", "index", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_embedded("SELECT p_partkey AS key, p_name || ' ' || p_brand AS text FROM part")}, named AS (SELECT DISTINCT text, index, weight FROM embedded JOIN texts USING (key)),
  dots AS (SELECT a.text AS line_text, b.text AS item_text, round(sum(a.weight * b.weight), 12) AS score FROM named a JOIN named b USING (index) GROUP BY ALL),
  pairs AS (SELECT l.key AS line_no, i.key AS item_no, coalesce(score, 0) AS score FROM texts l JOIN texts i ON l.key % 20 = 0 AND i.key % 20 <> 0 LEFT JOIN dots ON line_text = l.text AND item_text = i.text),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY line_no ORDER BY score DESC, item_no)::INT AS rank FROM pairs)
  SELECT line_no, rank, item_no, round(score, 6) AS score FROM ranked WHERE rank <= 5""")
def lexical_topk(spark, d):
    part = t(spark, d, "part")
    own = features.sparse_vectors(part.where("p_partkey % 20 = 0"), ["p_partkey"], F.concat("p_name", F.lit(" "), "p_brand")).withColumnRenamed("p_partkey", "line_no")
    items = features.sparse_vectors(part.where("p_partkey % 20 <> 0"), ["p_partkey"], F.concat("p_name", F.lit(" "), "p_brand")).withColumnRenamed("p_partkey", "item_no")
    return similarity.top_k_sparse(own, items).select("line_no", "rank", "item_no", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT left(sha256(p_name), 32) AS text_hash FROM part")
def embedding_cache(spark, d):
    part = t(spark, d, "part")
    _, cached = embeddings_with_cache(part.where("p_partkey % 2 = 0").select(F.col("p_name").alias("text")), spark.createDataFrame([], EMBEDDINGS))
    return embeddings_with_cache(part.select(F.col("p_name").alias("text")), cached)[0].select("text_hash")


def _rows_as_text(spark, d) -> DataFrame:
    """Text lines of offers, one page of 40 lines for each stretch of parts, with headings and page numbers; line numbers have four digits at most."""
    part = t(spark, d, "part")
    row = F.concat((F.col("p_partkey") % 10000).cast("string"), F.lit(" ABC-"), F.lpad((F.col("p_partkey") % 100000).cast("string"), 5, "0"), F.lit(" "), "p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(" metro "), text.es_number(F.round("p_retailprice", 2), 2))
    row = F.when(F.col("p_partkey") % 13 == 0, F.concat(F.lit("nota "), row)).otherwise(row)
    return part.select("p_partkey", row.alias("line"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 10000 END AS line_no, CASE WHEN p_partkey % 13 <> 0 THEN p_name END AS description, CASE WHEN p_partkey % 13 <> 0 THEN p_size::DOUBLE END AS quantity,
  CASE WHEN p_partkey % 13 <> 0 THEN 'meter' END AS unit, CASE WHEN p_partkey % 13 <> 0 THEN round(p_retailprice, 2) END AS price FROM part""")
def pdf_row_parse(spark, d):
    part = lambda k: F.nullif(F.regexp_extract("line", offers.ROW, k), F.lit(""))
    return _rows_as_text(spark, d).select("p_partkey", part(1).cast("long").alias("line_no"), part(3).alias("description"), text.parse_arg_number(part(4)).alias("quantity"), text.normalize_unit(part(5)).alias("unit"), text.parse_arg_number(part(6)).alias("price"))


@query("""SELECT page, count(*) AS body FROM (SELECT p_partkey // 40 + 1 AS page FROM part) GROUP BY page""")
def header_detect(spark, d):
    head = F.lit("Linea Codigo proveedor Descripción ofertada Cantidad Unidad Precio unit.")
    page = F.floor(F.col("p_partkey") / 40) + 1
    pages = _rows_as_text(spark, d).groupBy(page.alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "line"))), lambda x: x["line"]), "\n").alias("rows"))
    pages = pages.select(F.lit("a.pdf").alias("path"), "page", F.concat(F.lit("Proveedor: X\n"), head, F.lit("\n"), "rows", F.lit("\nPágina "), F.col("page").cast("string"), F.lit(" de 9")).alias("text"))
    body = offers.page_lines(pages).where("part = 'body'")
    # Only the first page's first line is a header block; on later pages it is a body line.
    return body.groupBy("page").agg(F.count_if(~F.col("line").startswith("Proveedor")).alias("body"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS dmy, strftime(o_orderdate, '%Y-%m-%d') AS serial, NULL::VARCHAR AS bad FROM orders""")
def normalize_date(spark, d):
    day = F.col("o_orderdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    return t(spark, d, "orders").select("o_orderkey", text.normalize_date(F.date_format(day, "yyyy-MM-dd'T'HH:mm")).alias("iso"), text.normalize_date(F.date_format(day, "d/M/yyyy")).alias("dmy"), text.normalize_date(serial).alias("serial"), text.normalize_date(F.date_format(day, "MMM yyyy")).alias("bad"))


@query("SELECT event_id, (props->>'$.k')::INT AS k, event_type || ':' || (props->>'$.k') AS tag FROM events")
def json_extract(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").select("event_id", k.cast("int").alias("k"), F.concat("event_type", F.lit(":"), k).alias("tag"))


@query("""SELECT o_orderkey, unnest([1, 2, 3])::INT AS n, unnest([o_orderstatus, o_orderpriority, 'x']) AS v FROM orders""")
def unnest_zip(spark, d):
    both = F.arrays_zip(F.array(F.lit(1), F.lit(2), F.lit(3)).alias("n"), F.array("o_orderstatus", "o_orderpriority", F.lit("x")).alias("v"))
    return t(spark, d, "orders").select("o_orderkey", F.inline(both)).toDF("o_orderkey", "n", "v")


@query("SELECT doc_id, sha256(text) AS key FROM documents")
def sha256_key(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key"))


@query("""SELECT o_orderkey, '$ ' || replace(replace(replace(format('{:,.2f}', round(o_totalprice, 2)), ',', '#'), '.', ','), '#', '.') AS money, format('{:.1f}', round((o_orderkey % 1000) / 10.0, 1)::DOUBLE) || '%' AS pct,
  CASE WHEN o_custkey % 7 - 3 = 0 THEN '-' WHEN o_custkey % 7 > 3 THEN '+' || (o_custkey % 7 - 3) ELSE '-' || (3 - o_custkey % 7) END AS delta FROM orders""")
def es_format(spark, d):
    price = F.round(F.col("o_totalprice"), 2)
    return t(spark, d, "orders").select("o_orderkey", text.money(price).alias("money"), text.pct(F.round((F.col("o_orderkey") % 1000) / 10.0, 1)).alias("pct"), text.delta(F.col("o_custkey") % 7 - 3).alias("delta"))


@query(r"""SELECT page_id, replace(replace(url, '|', '\|'), chr(10), ' ') AS md, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS esc, lower(regexp_replace(url, '[^a-zA-Z0-9_.-]', '_', 'g')) AS slug FROM pages""")
def escapes(spark, d):
    name = F.lower(F.regexp_replace("url", "[^a-zA-Z0-9_.-]", "_"))
    return t(spark, d, "pages").select("page_id", text.markdown_escaped(F.col("url")).alias("md"), text.html_escaped(F.col("html")).alias("esc"), name.alias("slug"))


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Coincidencia' WHEN 'F' THEN 'Sobrante' END AS label FROM orders""")
def label_maps(spark, d):
    from .report import STATUS_LABEL

    status = F.when(F.col("o_orderstatus") == "O", "match").when(F.col("o_orderstatus") == "F", "extra")
    return t(spark, d, "orders").select("o_orderkey", F.try_element_at(text.literal_map({k: v[0] for k, v in STATUS_LABEL.items()}), status).alias("label"))
