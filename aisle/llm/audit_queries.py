"""The registered queries of negative mining, manifests and decontamination, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.llm import decontaminate, merkle, negatives
from aisle.llm.queries import query, table

_MERKLE = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) AS f(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
shown AS (
  SELECT doc_id, source, text, lang, n_chars,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 AS tampered
  FROM documents, crcs),
fields AS (
  SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN tampered THEN replace(text, chr(10), '') ELSE text END AS seen
  FROM shown),
leaves AS (
  SELECT doc_id, source IS NOT NULL AS named, coalesce(source, '') AS source,
    sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(seen) || ':' || seen, '-')) AS seen FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY named, source ORDER BY doc_id) - 1 AS pos,
    count(*) OVER (PARTITION BY named, source) AS n FROM leaves),
low AS (
  SELECT named, source, 0 AS level, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT named, source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM low WHERE n > 1 GROUP BY named, source, level, pos // 3, n),
groups AS (
  SELECT named, source, level AS depth, h AS subroot,
    row_number() OVER (ORDER BY named, source) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, pos, subroot AS h, n FROM groups
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3
  FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
runs AS (
  SELECT l.doc_id, level, coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos < own), '') AS before,
    coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos > own), '') AS after
  FROM (SELECT p.*, level, pos // (3 ** level)::BIGINT AS own FROM placed p, range(40) AS f(level)) l
  JOIN low x USING (named, source, level)
  WHERE x.n > 1 AND x.pos // 3 = own // 3 GROUP BY l.doc_id, level
  UNION ALL
  SELECT p.doc_id, depth + g.level, coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos < own), ''),
    coalesce(string_agg(h, '' ORDER BY x.pos) FILTER (x.pos > own), '')
  FROM (SELECT *, pos // (3 ** level)::BIGINT AS own FROM groups, range(40) AS f(level)) g
  JOIN high x USING (level) JOIN placed p USING (named, source)
  WHERE x.n > 1 AND x.pos // 3 = own // 3 GROUP BY p.doc_id, depth, g.level),
paths AS (
  SELECT doc_id, list({'l': before, 'r': after} ORDER BY level) AS path,
    sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM runs GROUP BY doc_id),
folds AS (
  SELECT doc_id, seen AS h, coalesce(path, []) AS path, 0 AS k FROM placed LEFT JOIN paths USING (doc_id)
  UNION ALL
  SELECT doc_id, sha256(path[k + 1].l || h || path[k + 1].r), path, k + 1 FROM folds WHERE k < len(path))
SELECT p.doc_id, leaf, subroot, t.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
  f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN groups g USING (named, source) JOIN folds f ON f.doc_id = p.doc_id AND f.k = len(f.path)
LEFT JOIN paths ON paths.doc_id = p.doc_id, (SELECT h FROM high WHERE n = 1) t
"""


@query("op12_merkle", _MERKLE)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    rows = merkle.manifest(docs, seen={"text": without})
    return merkle.verified_rows(rows).drop("path", "seen_leaf")


_PASSAGES = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, list_aggregate(ws[i:i + least(len(ws), 10) - 1], 'string_agg', ' ') AS w
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM items WHERE len(ws) > 0)),
body AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
runs AS (
  SELECT r, m, i, list_aggregate(ws[i:i + m - 1], 'string_agg', ' ') AS w
  FROM (SELECT r, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM body, (SELECT DISTINCT m FROM windows) WHERE len(ws) >= m)),
found AS (SELECT r, m, i, item_id FROM runs JOIN windows USING (m, w)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit
  FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, m, i FROM found)) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM body LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""


@query("op13_decontaminate", _PASSAGES)
def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest_columns(decontaminate.find_passages(docs, benchmark))


_NEGATIVES = """
WITH shown AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
  FROM shown a JOIN shown b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
mined AS (
  SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM positives JOIN scores USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM mined WHERE rank <= 3
"""


@query("op11_negatives", _NEGATIVES)
def op11_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("id") % 50 == 0)
