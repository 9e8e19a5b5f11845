"""The queries that __spark_entry__.py adds for this subpackage, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_codec import encode_texts
from .chat_tree import formatted_digest
from .common import table
from .hash_forest import nearest_neighbours
from .importance import _BYTES, resampled
from .jaccard_join import near_duplicates
from .maxscore import top_products
from .neighbour_graph import near_vectors
from .pitman_yor import score_documents
from .prefix_trie import trie_nodes
from .quality import score_quality
from .source_mix import mix_sources
from .substring_dedup import drop_repeats
from .token_counts import count_tokens


def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return formatted_digest(table(spark, sf_dir, "conversations").select(*added.columns).unionByName(added))


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix_sources(table(spark, sf_dir, "documents"))
    return rows.withColumns({"shards": F.col("draws.shard"), "places": F.col("draws.place")}).drop("draws")


def op11_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pitman_yor, op2_jaccard_join, op3_quality, op4_token_counts, op5_chat_tree, op6_maxscore, op7_bpe_codec, op8_hash_forest, op9_substring_dedup, op10_source_mix, op11_neighbour_graph, op12_importance, op13_prefix_trie)}


_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
classes AS (SELECT min(doc_id) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s),
members AS (SELECT node, len(s) AS size, unnest(s) AS shingle FROM classes),
shared AS (SELECT a.node AS a, b.node AS b, any_value(a.size) AS m, any_value(b.size) AS n, count(*) AS common FROM members a JOIN members b ON a.shingle = b.shingle AND a.node < b.node GROUP BY a.node, b.node),
links AS (SELECT a, b FROM shared WHERE 100 * common >= 80 * (m + n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT node, node AS other FROM classes UNION SELECT r.node, l.b FROM reach r JOIN ways l ON r.other = l.a),
least AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(component, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s AND len(sets.s) > 0 LEFT JOIN least USING (node)"""

_OP5 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
shown AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 8 AS size FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars FROM shown GROUP BY conv_id"""

_OP6 = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM whole q JOIN whole c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

_OP9 = r"""
WITH words AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS place, w FROM words),
keyed AS (SELECT doc_id, place, sha256(array_to_string(w[place:place + 19], ' ')) AS k FROM windows),
later AS (SELECT doc_id, place FROM (SELECT doc_id, place, row_number() OVER (PARTITION BY k ORDER BY doc_id, place) AS copy FROM keyed) WHERE copy > 1),
removed AS (SELECT DISTINCT doc_id, place + step AS place FROM later, range(20) AS r(step)),
gone AS (SELECT doc_id, list(place) AS g FROM removed GROUP BY doc_id),
kept AS (SELECT doc_id, len(w) AS n, CASE WHEN g IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(g, i)), lambda i: w[i]) END AS k FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n::BIGINT AS n_words, (n - len(k))::BIGINT AS n_removed, sha256(array_to_string(k, ' ')) AS kept_sha256 FROM kept"""


_OP11 = """
WITH RECURSIVE fine AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM fine p JOIN fine q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.v, q.v) >= 0.95),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least"""

#: crc32 of a list of bytes as a number.
_CRC32 = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {{0}}), lambda c, b: xor(([{', '.join(map(str, _BYTES.tolist()))}]::BIGINT[])[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)"

_OP12 = rf"""
WITH told AS (SELECT 'd' AS side, doc_id, row_number() OVER () AS r, text FROM documents UNION ALL SELECT 'b', NULL, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, doc_id, r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM told),
seen AS (SELECT side, r, unnest(w) AS f FROM words UNION ALL SELECT side, r, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words),
kinds AS (SELECT f, ({_CRC32.format("list_transform(range(0, strlen(f)), lambda i: ('0x' || hex(f)[2 * i + 1:2 * i + 2])::BIGINT)")} % 10000)::INT AS bucket FROM (SELECT DISTINCT f FROM seen)),
placed AS (SELECT side, r, bucket FROM seen JOIN kinds USING (f)),
sums AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM placed GROUP BY bucket),
totals AS (SELECT count(*) FILTER (side = 'd')::DOUBLE AS s_all, count(*) FILTER (side = 'b')::DOUBLE AS t_all FROM placed),
gains AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums, totals),
weights AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM words LEFT JOIN weights USING (r) WHERE side = 'd'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place, 25 * count(*) OVER (PARTITION BY n_words >= 20) // 100 AS wanted FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= wanted THEN place END AS rank FROM ranked"""

_OP13 = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS source, {_CRC32.format("list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
made AS (
  SELECT i.conv_id, place, role, text FROM ids i JOIN turns t ON t.conv_id = i.source AND place <= h AND i.source <> i.conv_id
  UNION ALL SELECT conv_id, place, role, text FROM ids JOIN turns USING (conv_id) WHERE place > h OR source = conv_id),
steps AS (
  SELECT conv_id, row_number() OVER w AS depth, list({{'r': role, 't': text}}) OVER w AS path, strlen(text) AS size FROM made WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, []::STRUCT(r VARCHAR, t VARCHAR)[], 0 FROM ids),
lasts AS (SELECT conv_id, max(depth) AS last FROM steps GROUP BY conv_id),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(size) AS saved, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM steps JOIN lasts USING (conv_id) GROUP BY path, depth),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (path)),
sums AS (SELECT s.path, sum(CASE WHEN d.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(d.saved) AS saved_tokens FROM whole d JOIN steps s ON s.conv_id = d.conv_id AND s.depth <= d.depth GROUP BY s.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM whole n JOIN sums USING (path) LEFT JOIN nodes p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the tests hold the others against brute force, the libraries, or held-out rows."""
    return {"op2_jaccard_join": _OP2, "op5_chat_tree": _OP5, "op6_maxscore": _OP6, "op9_substring_dedup": _OP9, "op11_neighbour_graph": _OP11, "op12_importance": _OP12, "op13_prefix_trie": _OP13}
