"""Queries that run through the store: replacement of an offer's lines, updates from arrays, vectors kept between runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.models import ensure_embeddings, stored_vectors
from ..operators.store import Store
from ..written import scratch
from .catalog import _embedded
from .registry import query, t


@query("""WITH new AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity + 1 AS quantity FROM lineitem WHERE l_orderkey % 7 = 0 AND l_quantity > 40)
  SELECT l_orderkey::VARCHAR AS offer_id, l_linenumber AS line_no, l_suppkey::VARCHAR AS supplier_code, l_quantity AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM new)
  UNION ALL SELECT l_orderkey::VARCHAR, l_linenumber, l_suppkey::VARCHAR, quantity FROM new""")
def children_replaced(spark, d):
    """The lines of some offers come again, and take the place of all that the offers had."""
    store, own = Store(spark, scratch(spark, "children"), buckets=8), t(spark, d, "lineitem")

    def lines(rows, quantity):
        return rows.select(F.col("l_orderkey").cast("string").alias("offer_id"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").cast("string").alias("supplier_code"), quantity.alias("offered_quantity"))

    store.replace("offer_items", lines(own, F.col("l_quantity")))
    store.replace_children("offer_items", lines(own.where("l_orderkey % 7 = 0 AND l_quantity > 40"), F.col("l_quantity") + 1), "offer_id")
    return store.read("offer_items").select("offer_id", "line_no", "supplier_code", F.col("offered_quantity").cast("double").alias("quantity"))


@query("""SELECT p_partkey::VARCHAR AS code, p_name AS description, CASE WHEN p_partkey % 10 = 3 THEN p_size::DOUBLE END AS first, CASE WHEN p_partkey % 10 = 3 THEN (p_partkey % 128)::DOUBLE END AS second FROM part""")
def vectors_updated(spark, d):
    """UPDATE ... FROM unnest: batches of parallel arrays of ids and vectors set the vectors of the items they name."""
    store, part = Store(spark, scratch(spark, "vectors"), buckets=8), t(spark, d, "part")
    store.replace("items", part.select(F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").cast("string").alias("code"), F.col("p_name").alias("description")))
    given = part.where("p_partkey % 10 = 3").select(F.expr("p_partkey div 250").alias("batch"), F.concat(F.lit("i"), F.col("p_partkey").cast("string")).alias("id"), F.array(F.col("p_size").cast("float"), (F.col("p_partkey") % 128).cast("float")).alias("vector"))
    # 25 ids to a batch
    batches = given.groupBy("batch").agg(F.collect_list(F.struct("id", "vector")).alias("_r")).select(F.transform("_r", lambda r: r["id"]).alias("ids"), F.transform("_r", lambda r: r["vector"]).alias("vectors"))
    rows = batches.select(F.inline(F.arrays_zip("ids", "vectors"))).toDF("id", "embedding")
    store.update_from("items", rows, "id", ["embedding"])
    at = [F.try_element_at("embedding", F.lit(k)).cast("double") for k in (1, 2)]
    return store.read("items").select("code", "description", at[0].alias("first"), at[1].alias("second"))


@query(f"WITH {_embedded('SELECT p_partkey AS key, p_name AS text FROM part')} SELECT key AS p_partkey, index, round(weight, 6) AS weight, 0 AS made_again FROM embedded")
def embeddings_kept(spark, d):
    """Vectors of part names from the store, filled in two runs; a third run makes none."""
    store, part = Store(spark, scratch(spark, "embeddings"), buckets=8), t(spark, d, "part").select("p_partkey", F.col("p_name").alias("text"))
    ensure_embeddings(store, part.where("p_partkey % 3 = 0"))
    ensure_embeddings(store, part)
    again = ensure_embeddings(store, part)
    return stored_vectors(store, part, "p_partkey").select("p_partkey", "index", F.round("weight", 6).alias("weight"), F.lit(again).cast("int").alias("made_again"))
