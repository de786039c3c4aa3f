"""Queries of the training-data problems and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.llm.clusters import density_clusters
from sembla.llm.groups import group_ids
from sembla.llm.leakage import leaked_items
from sembla.llm.neighbours import similar_vectors
from sembla.llm.pii import personal_items, redact_personal
from sembla.llm.rank_fusion import best_item, ideal_point_scores
from sembla.llm.tokenizer import encode_corpus
from sembla.llm.topn import top_n
from sembla.session import read_table


def usable_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments whose descriptor has 32 values that are not all zero."""
    rows = read_table(spark, sf_dir, "search_segment").select("segment_uid", "collection_name", "descriptor")
    return rows.where((F.size("descriptor") == 32) & F.exists("descriptor", lambda x: x != 0))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 reference segments nearest to every query segment."""
    rows = usable_segments(spark, sf_dir).withColumns({"is_query": F.col("collection_name") == "query", "is_reference": F.col("collection_name") == "reference"})
    out = similar_vectors(rows, "segment_uid", "descriptor", 5, "is_query", "is_reference", "uint8")
    return out.select(F.col("segment_uid").alias("query_uid"), F.col("neighbour").alias("reference_uid"))


_USABLE = "u AS (SELECT DISTINCT segment_uid AS uid, collection_name AS side, CAST(descriptor AS FLOAT[32]) AS x FROM search_segment WHERE len(descriptor) = 32 AND list_max(descriptor) > 0)"
P1_SQL = f"""
WITH {_USABLE}, k AS (
  SELECT q.uid AS query_uid, r.uid AS reference_uid, row_number() OVER (PARTITION BY q.uid ORDER BY array_distance(q.x, r.x), r.uid) AS n
  FROM u q, u r WHERE q.side = 'query' AND r.side = 'reference'
)
SELECT query_uid, reference_uid FROM k WHERE n <= 5
"""
P2_SQL = f"""
WITH {_USABLE}
SELECT a.uid AS segment_uid, min(b.uid) AS cluster_uid FROM u a, u b WHERE array_distance(a.x, b.x) <= 160 GROUP BY a.uid HAVING count(*) >= 20
"""


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every usable segment in a group of at least 20 alike segments."""
    members, _ = density_clusters(usable_segments(spark, sf_dir), "segment_uid", "descriptor", resolution=160.0, dtype="uint8", summary=False)
    return members.select("segment_uid", F.col("cluster").alias("cluster_uid"))


def p2_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, stability and most typical segments of every group."""
    _, summary = density_clusters(usable_segments(spark, sf_dir), "segment_uid", "descriptor", resolution=160.0, dtype="uint8")
    return summary.select(F.col("cluster").alias("cluster_uid"), "num_elements", F.round("stability", 6).alias("stability"), "exemplars")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 3 nearest neighbours of every query and the 3 best detections of every video."""
    knn = read_table(spark, sf_dir, "mknn_result_query").where("nn_distance >= 0")
    knn = knn.select(F.lit("knn").alias("list_name"), F.col("query_uid").cast("string").alias("group_key"), F.col("nn_distance").alias("badness"), F.col("nn_position").alias("item_id"))
    det = read_table(spark, sf_dir, "detection").where("video_q is not null")
    det = det.select(F.lit("detection").alias("list_name"), F.col("video_q").alias("group_key"), (-F.col("score")).alias("badness"), F.col("detection_id").alias("item_id"))
    out = top_n(knn.unionByName(det), ["list_name", "group_key"], "badness", "item_id", 3)
    return out.select("list_name", "group_key", "item_id")


P4_SQL = """
WITH k AS (
  SELECT DISTINCT 'knn' AS list_name, CAST(query_uid AS VARCHAR) AS group_key, nn_distance AS s, nn_position AS item_id
  FROM mknn_result_query WHERE nn_distance >= 0 AND NOT isnan(nn_distance)
  UNION
  SELECT DISTINCT 'detection', video_q, -score, detection_id FROM detection WHERE video_q IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY list_name, group_key ORDER BY s, item_id) AS n FROM k
)
SELECT list_name, group_key, item_id FROM r WHERE n <= 3
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every video that has a link with a score of at least 20."""
    links = read_table(spark, sf_dir, "detection").where("score >= 20 and not isnan(score)")
    return group_ids(links, "video_q", "video_r", "video_id", "group_id")


P6_SQL = """
WITH RECURSIVE e AS (
  SELECT DISTINCT video_q AS a, video_r AS b FROM detection
  WHERE score >= 20 AND NOT isnan(score) AND video_q IS NOT NULL AND video_r IS NOT NULL AND video_q <> video_r
), l AS (
  SELECT a, b FROM e UNION SELECT b, a FROM e
), r(v, w) AS (
  SELECT a, a FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.w = l.a
)
SELECT v AS video_id, min(w) AS group_id FROM r GROUP BY v
"""

def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbour that heads the combined ranking of every query."""
    lists = read_table(spark, sf_dir, "query_txt").select("ss_name", "name_query", F.inline("nns"))
    file = lambda c: F.regexp_replace(c, "@[^@]*$", "")
    foreign = lists.where(file("name_nn") != file("name_query"))
    return best_item(ideal_point_scores(foreign, "name_query", "ss_name", "name_nn", "distance"), "name_query", "name_nn")


P5_SQL = """
WITH x AS (
  SELECT ss_name, name_query, unnest(nns) AS n FROM query_txt
), r AS (
  SELECT ss_name AS c, name_query AS q, n.name_nn AS i, n.distance AS x FROM x
  WHERE n.distance IS NOT NULL AND NOT isnan(n.distance) AND n.name_nn IS NOT NULL
    AND regexp_replace(n.name_nn, '@[^@]*$', '') <> regexp_replace(name_query, '@[^@]*$', '')
), b AS (
  SELECT c, quantile_disc(x, 0.01) AS lo, quantile_disc(x, 0.95) AS hi FROM r GROUP BY c
), o AS (
  SELECT q, c, i, greatest(any_value(lo), least(any_value(hi), min(x))) AS x FROM r JOIN b USING (c) GROUP BY q, c, i
), l AS (
  SELECT q, c, CASE WHEN sum(x * x) > 0 THEN sqrt(sum(x * x)) ELSE 1 END AS norm, min(x) AS low, max(x) AS high FROM o GROUP BY q, c
), m AS (
  SELECT q, c, norm, low / norm AS ideal, CASE WHEN high > 0 THEN high / norm * 1.5 ELSE high / norm + 1 END AS worst FROM l
), p AS (
  SELECT o.q, o.i, m.c, coalesce(y.x / m.norm, m.worst) AS v, m.ideal, m.worst
  FROM (SELECT DISTINCT q, i FROM o) o JOIN m ON m.q = o.q LEFT JOIN o y ON y.q = o.q AND y.i = o.i AND y.c = m.c
), s AS (
  SELECT q, i, sqrt(sum((v - ideal) ** 2)) AS near, sqrt(sum((worst - v) ** 2)) AS far FROM p GROUP BY q, i
), k AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(CASE WHEN near + far > 0 THEN far / (near + far) ELSE 0.5 END, 12) DESC, i) AS n FROM s
)
SELECT q AS name_query, i AS name_nn FROM k WHERE n = 1
"""


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return encode_corpus(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read_table(spark, sf_dir, "eval_items")
    return leaked_items(read_table(spark, sf_dir, "documents"), "doc_id", "text", items, "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of an evaluation item, with the item."""
    return _leaks(spark, sf_dir).where("literal").select("doc_id", "item_id")


def p8_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with passages that ask an item again with other values: words, words that differ, and whether it is literal."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id", F.col("words").cast("long").alias("words"), F.col("changed").cast("long").alias("changed"), "literal")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different item of personal information in every document."""
    out = personal_items(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "name_lexicon"))
    return out.select("doc_id", "kind", "value_key")


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal information replaced by typed placeholders."""
    return redact_personal(read_table(spark, sf_dir, "documents"), "doc_id", "text", read_table(spark, sf_dir, "name_lexicon"))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_summary": p2_summary, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_found": p8_found, "p8_templates": p8_templates, "p9_found": p9_found, "p9_redacted": p9_redacted}
SQL = {"p1_found": P1_SQL, "p2_found": P2_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
