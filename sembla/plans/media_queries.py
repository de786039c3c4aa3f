"""Queries on media files, segments, detections, texts and synthetic frames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from sembla.functions import pixels as P
from sembla.functions import strings as X
from sembla.functions.distances import distance_column
from sembla.operators import detect as D
from sembla.operators import segments as G
from sembla.operators import text as T
from sembla.operators.intervals import overlap_join, overlap_ratio
from sembla.operators.ordered import with_positions
from sembla.operators.search import find_segments, join_truth, spatial_inliers
from sembla.operators.stats import pixel_stats, shape_stats, static_crop
from sembla.session import map_arrow, read_table

QUERIES = {}
SQL = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different files with their length in seconds."""
    length = (F.col("time_end") - F.col("time_start")).alias("length")
    return read_table(spark, sf_dir, "media_catalog").select("file_id", "media_type", "path", "filesize", length).distinct()


_FILES = "WITH f AS (SELECT DISTINCT file_id, media_type, path, filesize, time_end - time_start AS length FROM media_catalog)"
_GOOD = ", g AS (SELECT DISTINCT file_id, length AS n FROM f WHERE length > 0 AND NOT isnan(length))"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("file_id", "num_segment", "start_second", "selected_second", "end_second")


def _segments_sql(start: str, end: str) -> str:
    return f" SELECT file_id, num_segment, {start} AS start_second, ({start} + {end}) / 2 AS selected_second, {end} AS end_second FROM s"


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("file_id", "length").distinct()


@query(_FILES + _GOOD + ", s AS (SELECT file_id, n, greatest(1, floor(n / 20 + 0.5)) AS c, unnest(range(CAST(greatest(1, floor(n / 20 + 0.5)) AS BIGINT))) AS num_segment FROM g)" + _segments_sql("(num_segment * n / c)", "((num_segment + 1) * n / c)"))
def segment_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constant segments of about 20 seconds."""
    return _rounded(G.segment_constant(_lengths(spark, sf_dir), "file_id", "length", 20.0))


@query(_FILES + _GOOD + ", s AS (SELECT file_id, n, unnest(range(CAST(greatest(1, ceil((n - 15) / 10)) AS BIGINT))) AS num_segment FROM g)" + _segments_sql("(num_segment * 10.0::DOUBLE)", "least(num_segment * 10.0::DOUBLE + 30, n)"))
def segment_cte_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 30 seconds every 10 seconds."""
    return _rounded(G.segment_constant(_lengths(spark, sf_dir), "file_id", "length", 30.0, 10.0))


@query(_FILES + _GOOD + ", s AS (SELECT file_id, n, unnest(range(5)) AS num_segment FROM g)" + _segments_sql("(num_segment * n / 5)", "((num_segment + 1) * n / 5)"))
def segment_video_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five equal segments per file."""
    return _rounded(G.segment_sample(_lengths(spark, sf_dir), "file_id", "length", 5))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different segments."""
    cols = ["segment_uid", "collection_name", "file_id", "num_segment", "start_frame", "end_frame", "start_second", "selected_second", "end_second", "descriptor"]
    return read_table(spark, sf_dir, "search_segment").select(*cols).dropDuplicates(["segment_uid"])


_SEG = "WITH g AS (SELECT DISTINCT ON (segment_uid) * FROM search_segment)"


@query(_SEG + ", x AS (SELECT file_id, start_second + 0.02 AS s, end_second - 0.02 AS e FROM g WHERE end_second - 0.02 > start_second + 0.02), y AS (SELECT file_id, part, s + part * ((e - s) / 2) AS a, (e - s) / 2 AS w FROM x, (VALUES (0), (1)) p(part)) SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY a, part) - 1 AS num_segment, a AS start_second, a + w / 2 AS selected_second, a + w AS end_second FROM y")
def segment_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment as a shot, cut at its ends and halved."""
    return _rounded(G.segment_shots(segments(spark, sf_dir).select("file_id", "start_second", "end_second"), "file_id", 2, 0.02, 0.02))


@query(_SEG + ", p AS (SELECT file_id, count(*) AS n, sum(end_second - start_second) AS s, sum(end_frame - start_frame + 1) AS f FROM g GROUP BY 1) SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS segments, round(sum(s) / sum(n), 6) AS mean_seconds, round(sum(f) / sum(n), 6) AS mean_frames, round(avg(n), 6) AS mean_per_file FROM p")
def segmentation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and mean lengths of segments."""
    s = G.segmentation_summary(segments(spark, sf_dir), "file_id")
    return s.select("files", "segments", *(F.round(c, 6).alias(c) for c in ("mean_seconds", "mean_frames", "mean_per_file")))


@query(_SEG + ", w AS (SELECT *, max(end_second) OVER (PARTITION BY file_id ORDER BY start_second, num_segment ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM g) SELECT file_id, num_segment, p AS problem FROM (SELECT file_id, num_segment, CASE WHEN end_second < start_second THEN 'reversed' WHEN NOT (selected_second BETWEEN start_second AND end_second) THEN 'selected outside' WHEN b > start_second THEN 'overlap' END AS p FROM w) WHERE p IS NOT NULL")
def segmentation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that break a rule."""
    return G.invalid_segments(segments(spark, sf_dir), "file_id")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "detection").dropDuplicates(["detection_id"])
    return d.where("sec_end_q > sec_start_q and sec_end_r > sec_start_r and video_q is not null and video_r is not null and score is not null and not isnan(score)")


_DET = "WITH d AS (SELECT DISTINCT ON (detection_id) * FROM detection), k AS (SELECT * FROM d WHERE sec_end_q > sec_start_q AND sec_end_r > sec_start_r AND video_q IS NOT NULL AND video_r IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))"


@query(_DET + " SELECT k.detection_id, g.segment_uid FROM k JOIN (SELECT DISTINCT ON (segment_uid) * FROM search_segment) g ON g.file_id = k.video_q AND greatest(g.start_second, k.sec_start_q) <= least(g.end_second, k.sec_end_q) AND g.end_second >= g.start_second")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the query video that a detection touches."""
    d = _spans(spark, sf_dir).select("detection_id", F.col("video_q").alias("file_id"), "sec_start_q", "sec_end_q")
    g = segments(spark, sf_dir).select("segment_uid", "file_id", "start_second", "end_second")
    return overlap_join(d, g, ["file_id"], ("sec_start_q", "sec_end_q"), ("start_second", "end_second"), 20.0).select("detection_id", "segment_uid")


@query(_DET + " SELECT detection_id, round(CASE WHEN least(sec_end_q, sec_end_r) <= greatest(sec_start_q, sec_start_r) THEN 0 WHEN (sec_start_q <= sec_start_r AND sec_end_r <= sec_end_q) OR (sec_start_r <= sec_start_q AND sec_end_q <= sec_end_r) THEN 1 ELSE (least(sec_end_q, sec_end_r) - greatest(sec_start_q, sec_start_r)) / least(sec_end_q - sec_start_q, sec_end_r - sec_start_r) END, 6) AS pct FROM k")
def interval_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far both sides of a detection cover the same seconds."""
    return _spans(spark, sf_dir).select("detection_id", F.round(overlap_ratio(*map(F.col, ("sec_start_q", "sec_end_q", "sec_start_r", "sec_end_r"))), 6).alias("pct"))


@query(_DET + ", e AS (SELECT *, ((sec_end_q - sec_start_q) - (sec_end_r - sec_start_r)) / 4 AS t FROM k), h AS (SELECT *, greatest(0, -(sec_start_q + t), -(sec_start_r - t)) AS h FROM e) SELECT detection_id, round(sec_start_q + t + h, 6) + 0.0 AS start_q, round(sec_end_q - t, 6) + 0.0 AS end_q, round(sec_start_r - t + h, 6) + 0.0 AS start_r, round(sec_end_r + t, 6) + 0.0 AS end_r FROM h")
def detect_equalise_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every detection to one length."""
    cols = D.equalise_columns(*map(F.col, ("sec_start_q", "sec_end_q", "sec_start_r", "sec_end_r")))
    out = _spans(spark, sf_dir).select("detection_id", *cols)
    return out.select("detection_id", *((F.round(c, 6) + 0.0).alias(c) for c in ("start_q", "end_q", "start_r", "end_r")))


@query(_DET + ", r AS (SELECT *, row_number() OVER (PARTITION BY video_q ORDER BY score DESC, video_r, sec_start_q, sec_start_r) AS n FROM k WHERE score IS NOT NULL) SELECT video_q, max(score) AS top, round(sum(CASE WHEN n = 1 THEN score * 1.5 ELSE score END), 5) AS total FROM r GROUP BY 1")
def detect_best_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores after the best detection of a video got its bonus."""
    r = D.rank_detections(_spans(spark, sf_dir).where("score is not null"))
    return r.groupBy("video_q").agg(F.max("score").alias("top")).join(D.best_bonus(r).groupBy("video_q").agg(F.round(F.sum("score"), 5).alias("total")), "video_q")


@query(_DET + ", b AS (SELECT DISTINCT file_id, e FROM (SELECT file_id, unnest([start_second, end_second]) AS e FROM search_segment) WHERE e IS NOT NULL), s AS (SELECT k.detection_id, e, row_number() OVER (PARTITION BY k.detection_id ORDER BY round(abs(e - sec_start_q), 9), e) AS n FROM k JOIN b ON b.file_id = k.video_q), t AS (SELECT k.detection_id, e, row_number() OVER (PARTITION BY k.detection_id ORDER BY round(abs(e - sec_end_q), 9), e) AS n FROM k JOIN b ON b.file_id = k.video_q) SELECT k.detection_id, coalesce(s.e, sec_start_q) AS sec_start_q, coalesce(t.e, sec_end_q) AS sec_end_q FROM k LEFT JOIN s ON s.detection_id = k.detection_id AND s.n = 1 LEFT JOIN t ON t.detection_id = k.detection_id AND t.n = 1")
def detect_fit_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections moved to segment boundaries."""
    return D.fit_to_segments(_spans(spark, sf_dir), segments(spark, sf_dir)).select("detection_id", "sec_start_q", "sec_end_q")


@query()
def detect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of one pair of videos that overlap on both sides, merged."""
    return D.merge_detections(_spans(spark, sf_dir))


@query(_DET + ", r AS (SELECT *, row_number() OVER (PARTITION BY video_q ORDER BY score DESC, video_r, sec_start_q, sec_start_r) AS rank FROM k WHERE score > 0) SELECT video_q, rank, format('{:.4f}', score) || chr(9) || video_q || chr(9) || format('{:.3f}', sec_start_q) || chr(9) || format('{:.3f}', sec_end_q) || chr(9) || video_r || chr(9) || format('{:.3f}', sec_start_r) || chr(9) || format('{:.3f}', sec_end_r) || chr(9) || coalesce(num_voters, 0) || chr(9) || coalesce(num_misses, 0) AS line FROM r WHERE rank <= 3")
def detect_print_txt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best detections of every video as lines, 0 for an unknown count."""
    d = D.printable(_spans(spark, sf_dir), 3)
    return d.withColumn("rank", F.col("rank").cast("long"))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest known neighbours of every query segment, with the seconds of both."""
    m = read_table(spark, sf_dir, "mknn_result_query").where("nn_distance >= 0 and not isnan(nn_distance)").select("query_uid", "nn_position", "nn_distance").distinct()
    near = m.withColumn("rank", F.row_number().over(W.partitionBy("query_uid").orderBy("nn_distance", "nn_position"))).where("rank <= 10")
    g = segments(spark, sf_dir)
    side = lambda s, uid: g.select(F.col("segment_uid").alias(uid), F.col("file_id").alias(f"{s}_file"), F.col("start_second").alias(f"{s}_start"), F.col("end_second").alias(f"{s}_end"))
    out = near.join(side("q", "query_uid"), "query_uid").join(side("r", "nn_position"), "nn_position")
    return out.withColumn("closeness", 1.0 / (1.0 + F.col("nn_distance") / 100.0))


_MATCH = _SEG + """, m AS (SELECT DISTINCT query_uid, nn_position, nn_distance FROM mknn_result_query WHERE nn_distance >= 0 AND NOT isnan(nn_distance)), t AS (SELECT *, row_number() OVER (PARTITION BY query_uid ORDER BY nn_distance, nn_position) AS rank FROM m),
j AS (SELECT a.file_id AS q_file, b.file_id AS r_file, a.start_second AS qs, a.end_second AS qe, b.start_second AS rs, b.end_second AS re FROM t JOIN g a ON a.segment_uid = t.query_uid JOIN g b ON b.segment_uid = t.nn_position WHERE rank <= 10),
o AS (SELECT q_file, r_file, least(rs - qs, rs - qe, re - qs, re - qe) - 0.25 AS lo, greatest(rs - qs, rs - qe, re - qs, re - qe) + 0.25 AS hi FROM j WHERE qs IS NOT NULL AND qe IS NOT NULL AND rs IS NOT NULL AND re IS NOT NULL),
w AS (SELECT *, max(hi) OVER (PARTITION BY q_file, r_file ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, row_number() OVER (PARTITION BY q_file, r_file ORDER BY lo, hi) AS n FROM o),
i AS (SELECT *, sum(CASE WHEN top IS NULL OR lo > top THEN 1 ELSE 0 END) OVER (PARTITION BY q_file, r_file ORDER BY n) AS k FROM w), s AS (SELECT q_file, r_file, min(lo) AS low, max(hi) AS high, count(*) AS voters FROM i GROUP BY q_file, r_file, k HAVING count(*) >= 3)"""


@query(_MATCH + " SELECT q_file, r_file, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, voters FROM s")
def offset_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged time offsets at which two files match."""
    return D.offset_islands(matches(spark, sf_dir), 0.25, 3).select("q_file", "r_file", (F.round("low", 6) + 0.0).alias("low"), (F.round("high", 6) + 0.0).alias("high"), "voters")


@query(_MATCH + ", p AS (SELECT *, unnest(range(CAST(greatest(1, ceil((round(high - low, 9) + 0.125) / 0.25)) AS BIGINT))) AS probe FROM s) SELECT q_file, r_file, count(*) AS probes, max(probe) AS last FROM p GROUP BY q_file, r_file")
def offset_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probing windows of every island, counted."""
    p = D.offset_probes(D.offset_islands(matches(spark, sf_dir), 0.25, 3))
    return p.groupBy("q_file", "r_file").agg(F.count(F.lit(1)).alias("probes"), F.max("probe").cast("long").alias("last"))


@query()
def detect_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies found by voting over the neighbours of segments."""
    return D.detect_copies(matches(spark, sf_dir), least=3, min_length=0.5)


@query(_SEG + ", q AS (SELECT file_id AS q_file, num_segment AS q_segment, selected_second AS t FROM g WHERE collection_name = 'query'), d AS (SELECT DISTINCT ON (detection_id) * FROM detection), m AS (SELECT q_file, q_segment, video_r AS r_file, sec_start_r + (t - sec_start_q) / (sec_end_q - sec_start_q) * (sec_end_r - sec_start_r) AS r_second FROM q JOIN d ON video_q = q_file AND t >= sec_start_q AND t <= sec_end_q AND sec_end_q > sec_start_q) SELECT DISTINCT q_file, q_segment, r_file, num_segment AS r_segment, round(r_second, 6) AS r_second FROM m JOIN g ON g.file_id = r_file AND r_second >= start_second AND r_second < end_second")
def gt_segments_to_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query segments to the reference segments that detections, taken as truth, map them to."""
    g = segments(spark, sf_dir)
    q = g.where("collection_name = 'query'").select(F.col("file_id").alias("q_file"), F.col("num_segment").alias("q_segment"), F.col("selected_second").alias("q_second"))
    d = read_table(spark, sf_dir, "detection").dropDuplicates(["detection_id"])
    t = d.select(F.col("video_q").alias("q_file"), F.col("sec_start_q").alias("start_q"), F.col("sec_end_q").alias("end_q"), F.col("video_r").alias("r_file"), F.col("sec_start_r").alias("start_r"), F.col("sec_end_r").alias("end_r"))
    r = g.select(F.col("file_id").alias("r_file"), F.col("num_segment").alias("r_segment"), F.col("start_second").alias("r_start"), F.col("end_second").alias("r_end"))
    return G.interpolate_truth(q, t, r).withColumn("r_second", F.round("r_second", 6)).distinct()


@query("WITH g AS (SELECT DISTINCT ON (segment_uid) * FROM search_segment), u AS (SELECT * FROM g WHERE len(descriptor) = 32), w AS (SELECT file_id, num_segment, descriptor AS b, lag(descriptor) OVER (PARTITION BY file_id ORDER BY num_segment) AS a FROM u) SELECT file_id, num_segment, list_sum(list_transform(list_zip(a, b), lambda z: CAST(abs(z[1] - z[2]) AS DOUBLE))) AS difference FROM w WHERE a IS NOT NULL")
def shots_frame_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1 distance of every segment's descriptor to the one before it in its file."""
    g = segments(spark, sf_dir).where(F.size("descriptor") == 32).select("file_id", "num_segment", "descriptor")
    d = G.frame_differences(g, "file_id", "num_segment", distance_column("L1", F.col("prev_descriptor"), F.col("descriptor")), ["descriptor"])
    return d.where("prev_descriptor is not null").select("file_id", "num_segment", "difference")


@query(_FILES + " SELECT DISTINCT file_id, nullif(lower(regexp_extract(path, '\\.([^./]+)$', 1)), '') AS extension, regexp_replace(path, '^.*/', '') AS name, starts_with(path, '/vault') AS in_vault, position('/' IN substr(path, 2)) AS slash, upper(media_type) AS kind, CASE WHEN length(path) > 20 THEN path[1:17] || '...' ELSE path END AS short FROM f")
def string_utils(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions, names and cut paths of files."""
    p = F.col("path")
    return files(spark, sf_dir).select("file_id", X.extension(p).alias("extension"), X.base_name(p).alias("name"), p.startswith("/vault").alias("in_vault"), F.locate("/", F.substring(p, 2, 10_000)).cast("long").alias("slash"), F.upper("media_type").alias("kind"), X.truncate(p, 20).alias("short")).distinct()


@query("SELECT event_id, CAST(floor(v / 3600000) AS BIGINT) AS h, t AS text, v / 1000.0::DOUBLE AS seconds FROM (SELECT event_id, v, lpad(CAST(v // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(v // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(v // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(v % 1000 AS VARCHAR), 3, '0') AS t FROM (SELECT event_id, CAST(floor(abs(value) * 1000) AS BIGINT) AS v FROM events WHERE value IS NOT NULL))")
def format_hhmmss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as clock text and back."""
    e = read_table(spark, sf_dir, "events").where("value is not null").select("event_id", (F.floor(F.abs("value") * 1000) / 1000.0).alias("s"))
    t = e.withColumn("text", X.format_seconds(F.col("s")))
    return t.select("event_id", F.floor(F.col("s") / 3600).alias("h"), "text", F.round(X.parse_seconds(F.col("text")), 3).alias("seconds"))


@query("SELECT p_partkey, round(p_size / 7.0::DOUBLE, 9) AS fraction, CASE WHEN p_size % 2 = 0 THEN true ELSE false END AS even, regexp_replace(regexp_replace(CAST(p_size AS VARCHAR) || '.500', '(\\.\\d*?)0+$', '\\1'), '\\.$', '') AS trimmed FROM part")
def parse_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions, truth values and numbers parsed from text."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("n"))
    return p.select("p_partkey", F.round(X.parse_fraction(F.concat("n", F.lit("/7"))), 9).alias("fraction"), X.parse_bool(F.when(F.col("n").cast("int") % 2 == 0, "Yes").otherwise("off")).alias("even"), X.trim_decimals(F.concat("n", F.lit(".500"))).alias("trimmed"))


# texts


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


_TERMS = "WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+')) AS word FROM documents), t AS (SELECT doc_id, word, count(*) AS f FROM w GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT word, count(*) AS df FROM t GROUP BY 1 HAVING count(*) < (SELECT n FROM n))"


@query(_TERMS + " SELECT word, df FROM v")
def vocabulary_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every word."""
    docs = _docs(spark, sf_dir)
    return T.vocabulary(T.terms(docs, "doc_id", "text"), "doc_id", docs.count())


_TFIDF = _TERMS + ", l AS (SELECT doc_id, sum(f) AS l FROM t GROUP BY 1), r AS (SELECT t.doc_id, word, f / l * ln((SELECT n FROM n) / df) AS w FROM t JOIN v USING (word) JOIN l USING (doc_id)), m AS (SELECT doc_id, sqrt(sum(w * w)) AS m FROM r GROUP BY 1), z AS (SELECT doc_id, word, w / m AS weight FROM r JOIN m USING (doc_id) WHERE m > 0)"


@query(_TFIDF + " SELECT doc_id, word, round(weight, 6) AS weight FROM z")
def tfidf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of every word of every document."""
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    t = T.terms(docs, "doc_id", "text")
    n = docs.count()
    return T.tfidf(t, T.vocabulary(t, "doc_id", n), "doc_id", n)


@query(_TFIDF + ", p AS (SELECT a.doc_id AS query_id, b.doc_id AS ref_id, sqrt(2 * abs(1 - round(sum(a.weight * b.weight), 9))) AS d FROM z a JOIN z b ON a.word = b.word WHERE a.doc_id % 100 = 0 AND a.doc_id <> b.doc_id GROUP BY 1, 2) SELECT query_id, rank, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM p) WHERE rank <= 5")
def sparse_cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar documents of every hundredth document."""
    q = _docs(spark, sf_dir).where("doc_id % 100 = 0").select("doc_id")
    return T.sparse_knn(_weights(spark, sf_dir), "doc_id", q, 5).select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id")


@query(_TFIDF + ", q AS (SELECT doc_id, sum(weight) AS s FROM z GROUP BY 1), e AS (SELECT a.doc_id AS qid, b.doc_id AS rid, sum(abs(a.weight - b.weight) - a.weight - b.weight) AS x FROM z a JOIN z b ON a.word = b.word WHERE a.doc_id % 100 = 0 GROUP BY 1, 2), p AS (SELECT a.doc_id AS query_id, b.doc_id AS ref_id, round(a.s + b.s + coalesce(x, 0), 9) AS d FROM q a JOIN q b ON a.doc_id <> b.doc_id LEFT JOIN e ON qid = a.doc_id AND rid = b.doc_id WHERE a.doc_id % 100 = 0) SELECT query_id, rank, ref_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM p) WHERE rank <= 5")
def sparse_general_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by L1, among all documents: also those that share no word."""
    q = _docs(spark, sf_dir).where("doc_id % 100 = 0").select("doc_id")
    return T.sparse_knn(_weights(spark, sf_dir), "doc_id", q, 5, metric="L1", unrelated=True).select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id")


@query("WITH g AS (SELECT DISTINCT ON (segment_uid) * FROM search_segment), n AS (SELECT DISTINCT name_query FROM query_txt) SELECT name_query, segment_uid FROM n JOIN g ON g.file_id || '@' || CAST(g.num_segment AS VARCHAR) = name_query")
def segment_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments by their names."""
    n = read_table(spark, sf_dir, "query_txt").select("name_query").distinct()
    return find_segments(n, "name_query", segments(spark, sf_dir).select("segment_uid", "file_id", "num_segment")).select("name_query", "segment_uid")


@query(_DET + ", t AS (SELECT detection_id AS truth_id, video_q, video_r, sec_start_q AS a, sec_end_q AS b, sec_start_r AS c, sec_end_r AS e FROM k WHERE score >= 20) SELECT k.detection_id, min(truth_id) AS truth_id FROM k JOIN t ON k.video_q = t.video_q AND k.video_r = t.video_r AND greatest(sec_start_q, a) <= least(sec_end_q, b) AND greatest(sec_start_r, c) <= least(sec_end_r, e) GROUP BY 1")
def detect_truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with the first well-scored detection they overlap on both sides."""
    d = _spans(spark, sf_dir)
    t = d.where("score >= 20").select(F.col("detection_id").alias("truth_id"), "video_q", "video_r", F.col("sec_start_q").alias("start_q"), F.col("sec_end_q").alias("end_q"), F.col("sec_start_r").alias("start_r"), F.col("sec_end_r").alias("end_r"))
    return join_truth(d, t)


@query("SELECT file_id, row_number() OVER (ORDER BY lower(file_id)) - 1 AS pos FROM (SELECT DISTINCT file_id FROM media_catalog)")
def files_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of files in natural order of their names (numbers of one length)."""
    f = files(spark, sf_dir).select("file_id").distinct().withColumn("key", X.natural_key(F.col("file_id")))
    return with_positions(f, ["key"]).select("file_id", "pos")


@query("SELECT count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS deviation, round((avg(v * v * v) - 3 * avg(v) * avg(v * v) + 2 * power(avg(v), 3)) / power(stddev_pop(v), 3), 4) AS skewness FROM (SELECT value AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value))")
def stats_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and skewness of event values."""
    s = shape_stats(read_table(spark, sf_dir, "events"), "value")
    return s.select("n", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round("skewness", 4).alias("skewness"))


@query()
def stemmed_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every stem."""
    docs = _docs(spark, sf_dir)
    return T.vocabulary(T.terms(docs, "doc_id", "text", stem=True), "doc_id", docs.count())


# frames: 16 x 16 pixels made from the vectors


def frames(spark: SparkSession, sf_dir: str, color: bool = False) -> DataFrame:
    """vec_id and a frame; the pixel at row y, column x is (floor(1000 |entry 16 y + x mod 64|) + 17 y + 29 x + x y) mod 256.

    With color it is the red of the pixel; green is (2 red + 40 y) mod 256, blue (255 - red + 9 x) mod 256.
    """
    y, x = np.mgrid[0:16, 0:16]

    def run(batches):
        for batch in batches:
            flat = np.abs(batch.column(1).flatten().to_numpy()) * 1000
            v = (np.floor(flat).astype(np.int64).reshape(-1, 64)[:, (16 * y + x) % 64] + 17 * y + 29 * x + x * y) % 256
            made = np.stack([v, (2 * v + 40 * y) % 256, (255 - v + 9 * x) % 256], -1) if color else v
            yield pa.RecordBatch.from_arrays([batch.column(0), P.image_lists(list(made), kind)], names=["vec_id", "frame"])

    kind, text = P.image_type(color)
    rows = read_table(spark, sf_dir, "embeddings").where(F.size("embedding") == 64).select("vec_id", F.col("embedding").cast("array<double>"))
    return rows.transform(map_arrow, run, f"vec_id long, frame {text}")


_PIXELS = "WITH p AS (SELECT vec_id, y, x, (CAST(floor(abs(CAST(embedding[(16 * y + x) % 64 + 1] AS DOUBLE)) * 1000) AS BIGINT) + 17 * y + 29 * x + x * y) % 256 AS v FROM embeddings, range(16) a(y), range(16) b(x) WHERE len(embedding) = 64)"
_COLORS = _PIXELS + ", c AS (SELECT vec_id, y, x, CAST(v AS DOUBLE) AS r, CAST((2 * v + 40 * y) % 256 AS DOUBLE) AS g, CAST((255 - v + 9 * x) % 256 AS DOUBLE) AS b FROM p)"


def _entries(df: DataFrame, code: str) -> DataFrame:
    """One row per entry of the descriptor of every frame."""
    made = df.select("vec_id", P.extract(F.col("frame"), code).alias("d"))
    return made.select("vec_id", F.posexplode("d").alias("dim", "value")).select("vec_id", F.col("dim").cast("long").alias("dim"), (F.round("value", 6) + 0.0).alias("value"))


def _rows(df: DataFrame, code: str, color: bool = False) -> DataFrame:
    """One row per pixel of the transformed frames; with color per channel too."""
    made = df.select("vec_id", P.transform(F.col("frame"), code, color).alias("t"))
    made = made.select("vec_id", F.posexplode("t").alias("y", "r")).select("vec_id", "y", F.posexplode("r").alias("x", "value"))
    long = lambda c: F.col(c).cast("long").alias(c)
    if color:
        return made.select("vec_id", long("y"), long("x"), F.posexplode("value").alias("channel", "value")).select("vec_id", "y", "x", long("channel"), "value")
    return made.select("vec_id", long("y"), long("x"), (F.round("value", 6) + 0.0).alias("value"))


def _image_query(name: str, code: str, sql: str | None = None, color: bool = False) -> None:
    """Registers the descriptor (px_) or transformation (tr_) ``code`` of every frame."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = frames(spark, sf_dir, color)
        return _entries(df, code) if name.startswith("px") else _rows(df, code, color and code.startswith("COLOR"))

    run.__doc__ = f"{code} of every frame."
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_DIM = " SELECT vec_id, CAST({dim} AS BIGINT) AS dim, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM "
_PIX = " SELECT vec_id, y, x, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM "
_IDS = "(SELECT DISTINCT vec_id FROM p)"
_BYTE = "greatest(0, least(255, floor(round(CAST({} AS DOUBLE), 6) + 0.5)))"


def _dims(value: str, source: str, dim: str = "z") -> str:
    return _DIM.format(dim=dim, value=value) + source


def _pixel_sql(value: str, source: str) -> str:
    return _PIX.format(value=value) + source


def _counted(cells: str, bins: int, share: str) -> str:
    """Shares n of every bin b of every zone z, from rows (vec_id, z, b)."""
    return f", h AS ({cells}), k AS (SELECT vec_id, z, b, {share} AS n FROM h GROUP BY 1, 2, 3), g AS (SELECT vec_id, z, b, coalesce(n, 0) AS n FROM {_IDS} i CROSS JOIN (SELECT DISTINCT z FROM h) q CROSS JOIN range({bins}) r(b) LEFT JOIN k USING (vec_id, z, b))"


_QUARTER = "y // 8 * 2 + x // 8"
_image_query("px_histgray", "HISTGRAY_2x2_8F_4", _PIXELS + _counted(f"SELECT vec_id, {_QUARTER} AS z, v // 64 AS b FROM p", 4, "count(*) / 64") + _dims("n", "g", "z * 4 + b"))
_image_query("px_histgray_zones", "HISTGRAY_1x1+2x2_1U_4", _PIXELS + _counted(f"SELECT vec_id, 0 AS z, v // 64 AS b FROM p UNION ALL SELECT vec_id, 1 + {_QUARTER}, v // 64 FROM p", 4, "count(*) / (CASE WHEN z = 0 THEN 256 ELSE 64 END)") + _dims("ceil(round(n * 255, 9))", "g", "z * 4 + b"))
_image_query("px_kf", "KF_4x4_GRAY_8F", _PIXELS + ", m AS (SELECT vec_id, y // 4 * 4 + x // 4 AS z, avg(v) AS v FROM p GROUP BY 1, 2)" + _dims("v", "m"))
_image_query("px_omd", "OMD_4x4", _PIXELS + ", m AS (SELECT vec_id, y // 4 * 4 + x // 4 AS z, floor(avg(v) / 4 + 0.5) AS v FROM p GROUP BY 1, 2), r AS (SELECT vec_id, z, row_number() OVER (PARTITION BY vec_id ORDER BY v, z) - 1 AS r FROM m)" + _dims("r", "r"))

# The kernels of the edge histograms as SQL over the corners a b / c d of a block.
_FIVE = ["a - b + c - d", "a + b - c - d", "sqrt(2) * a - sqrt(2) * d", "sqrt(2) * b - sqrt(2) * c", "2 * a - 2 * b - 2 * c + 2 * d"]
_TEN = ["b - a + d - c", _FIVE[3], _FIVE[1], _FIVE[2], _FIVE[0], "sqrt(2) * c - sqrt(2) * b", "c + d - a - b", "sqrt(2) * d - sqrt(2) * a", _FIVE[4], "2 * b + 2 * c - 2 * a - 2 * d"]


def _edge_sql(kernels: list[str], size: int, threshold: float, absolute: bool) -> str:
    """m: of every block (yy, xx) of 2 x 2 cells of size x size pixels the number k of its strongest kernel, or -1."""
    strength = "[" + ", ".join(f"round({f'abs({k})' if absolute else k}, 9)" for k in kernels) + "]"
    cell = f"CAST(y // {size} AS BIGINT)", f"CAST(x // {size} AS BIGINT)"
    corner = lambda i, j: f"max(CASE WHEN cy % 2 = {i} AND cx % 2 = {j} THEN v END)"
    return f", cells AS (SELECT vec_id, {cell[0]} AS cy, {cell[1]} AS cx, avg(v) AS v FROM p GROUP BY 1, 2, 3), q AS (SELECT vec_id, cy // 2 AS yy, cx // 2 AS xx, {corner(0, 0)} AS a, {corner(0, 1)} AS b, {corner(1, 0)} AS c, {corner(1, 1)} AS d FROM cells GROUP BY 1, 2, 3), s AS (SELECT vec_id, yy, xx, {strength} AS s FROM q), m AS (SELECT vec_id, yy, xx, CASE WHEN list_max(s) >= {threshold} THEN {len(kernels)} - list_position(list_reverse(s), list_max(s)) ELSE -1 END AS k FROM s)"


def _ehd_sql(kernels: list[str], absolute: bool) -> str:
    n = len(kernels)
    return _PIXELS + _edge_sql(kernels, 1, 10, absolute) + f", k AS (SELECT vec_id, yy // 4 * 2 + xx // 4 AS z, k, count(*) AS n FROM m WHERE k >= 0 GROUP BY 1, 2, 3), t AS (SELECT vec_id, z, sum(n) AS t FROM k GROUP BY 1, 2), g AS (SELECT vec_id, z, b, coalesce(n, 0) / greatest(coalesce(t, 1), 1) AS n FROM {_IDS} i CROSS JOIN range(4) q(z) CROSS JOIN range({n}) r(b) LEFT JOIN k ON k.vec_id = i.vec_id AND k.z = q.z AND k.k = r.b LEFT JOIN t ON t.vec_id = i.vec_id AND t.z = q.z)".replace("SELECT vec_id, z, b, coalesce(n", "SELECT i.vec_id, q.z, b, coalesce(n") + _dims("n", "g", f"z * {n} + b")


_image_query("px_ehd", "EHD_2x2_4x4_10_K5_ABS_8F", _ehd_sql(_FIVE, True))
_image_query("px_ehd_ten", "EHD_2x2_4x4_10_K10_8F", _ehd_sql(_TEN, False))
_image_query("px_edges", "EDGES_4x4_10_K5_ABS", _PIXELS + _edge_sql(_FIVE, 2, 10, True) + _dims("k", "m", "yy * 4 + xx"))
_image_query("px_edges_ten", "EDGES_4x4_10_K10", _PIXELS + _edge_sql(_TEN, 2, 10, False) + _dims("k", "m", "yy * 4 + xx"))

#: n: every pixel with those around it (dy, dx; borders repeated).
_AROUND = ", n AS (SELECT a.vec_id, a.y, a.x, dy - 1 AS dy, dx - 1 AS dx, b.v FROM p a CROSS JOIN range(3) s(dy) CROSS JOIN range(3) t(dx) JOIN p b ON b.vec_id = a.vec_id AND b.y = greatest(0, least(15, a.y + dy - 1)) AND b.x = greatest(0, least(15, a.x + dx - 1)))"
_GRADIENT = _AROUND + ", d AS (SELECT vec_id, y, x, CAST(sum(v * dx * (2 - abs(dy))) AS DOUBLE) AS gx, CAST(sum(v * dy * (2 - abs(dx))) AS DOUBLE) AS gy FROM n GROUP BY 1, 2, 3)"


def _near(value: str) -> str:
    return _PIXELS + _AROUND + f", o AS (SELECT vec_id, y, x, {value} AS w FROM n GROUP BY 1, 2, 3)" + _pixel_sql("w", "o")


_PI = "3.141592653589793"
_TURN = f"(CASE WHEN atan2(gy, gx) < 0 THEN atan2(gy, gx) + {_PI} WHEN atan2(gy, gx) >= {_PI} THEN 0 ELSE atan2(gy, gx) END)"
_image_query("px_gdh", "GDH_2x2_8_20", _PIXELS + _GRADIENT + _counted(f"SELECT vec_id, {_QUARTER} AS z, CASE WHEN sqrt(gx * gx + gy * gy) > 20 THEN least(7, CAST(floor({_TURN} / {_PI} * 8) AS BIGINT)) ELSE -1 END AS b FROM d", 8, "count(*) / 64") + _dims("n", "g", "z * 8 + b"))
_image_query("px_hampapur", "HAMP_4x4_40", _PIXELS + _GRADIENT + ", z AS (SELECT vec_id, y // 4 * 4 + x // 4 AS z, avg(CASE WHEN sqrt(gx * gx + gy * gy) > 40 THEN x % 4 END) AS mx, avg(CASE WHEN sqrt(gx * gx + gy * gy) > 40 THEN y % 4 END) AS my FROM d GROUP BY 1, 2), u AS (SELECT vec_id, 2 * z AS z, coalesce((mx + 0.5) / 4, 0.5) AS v FROM z UNION ALL SELECT vec_id, 2 * z + 1, coalesce((my + 0.5) / 4, 0.5) FROM z)" + _dims("v", "u"))
_image_query("px_canny", "CANNY_16x16_50_100")

_image_query("tr_gray", "GRAY_c1/2_b-40_ABS_t30", _PIXELS + _pixel_sql(f"CASE WHEN {_BYTE.format('abs(v * 0.5 - 40)')} > 30 THEN 255 ELSE 0 END", "p"))
_image_query("tr_gray_erode", "GRAY_ERODE_DILATE", _PIXELS + _AROUND + ", e AS (SELECT vec_id, y, x, min(v) AS v FROM n WHERE dx * dy = 0 GROUP BY 1, 2, 3), f AS (SELECT a.vec_id, a.y, a.x, max(b.v) AS w FROM e a CROSS JOIN range(3) s(dy) CROSS JOIN range(3) t(dx) JOIN e b ON b.vec_id = a.vec_id AND b.y = greatest(0, least(15, a.y + dy - 1)) AND b.x = greatest(0, least(15, a.x + dx - 1)) WHERE (dx - 1) * (dy - 1) = 0 GROUP BY 1, 2, 3)" + _pixel_sql("w", "f"))
_image_query("tr_equalize", "EQUALIZE", _PIXELS + ", k AS (SELECT vec_id, v, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT vec_id, v, sum(n) OVER (PARTITION BY vec_id ORDER BY v) AS t FROM k), f AS (SELECT vec_id, min(t) AS f FROM t GROUP BY 1)" + _pixel_sql(_BYTE.format("(t - f) / greatest(1, 256 - f) * 255"), "(SELECT p.vec_id, y, x, t, f FROM p JOIN t USING (vec_id, v) JOIN f USING (vec_id))"))
_image_query("tr_crop", "CROP_8x8", _PIXELS + " SELECT vec_id, y - 4 AS y, x - 4 AS x, CAST(v AS DOUBLE) AS value FROM p WHERE y BETWEEN 4 AND 11 AND x BETWEEN 4 AND 11")
_image_query("tr_filter_median", "FILTER_3x3_MEDIAN", _near("median(v)"))
_image_query("tr_filter_avg", "FILTER_3x3_AVG", _near(_BYTE.format("sum(v) / 9.0::DOUBLE")))
_image_query("tr_filter_kernel", "FILTER_3x3_1/4,-1,1/4,-1,2,-1,1/4,-1,1/4,ABS,MAX,512_ADD", _near("least(255, max(CASE WHEN dx = 0 AND dy = 0 THEN v END) + " + _BYTE.format("abs(sum(v * (CASE WHEN dx = 0 AND dy = 0 THEN 2 WHEN dx * dy = 0 THEN -1 ELSE 0.25 END))) * 0.5") + ")"))
_image_query("tr_erode", "FILTER_3x3_MIN", _near("min(v)"))
_image_query("tr_dilate", "FILTER_3x3_MAX", _near("max(v)"))
_image_query("tr_sobel", "SOBEL", _PIXELS + _GRADIENT + _pixel_sql(_BYTE.format("sqrt(gx * gx + gy * gy)"), "d"))
_image_query("tr_sobel_approx", "SOBEL_120_APROX", _PIXELS + _GRADIENT + _pixel_sql("CASE WHEN abs(gx) + abs(gy) >= 120 THEN 255 ELSE 0 END", "d"))
_image_query("tr_laplace", "LAPLACE", _near(_BYTE.format("abs(sum(v * (CASE WHEN dx = 0 AND dy = 0 THEN -4 WHEN dx * dy = 0 THEN 1 ELSE 0 END)))")))
_image_query("tr_rotate", "ROTATE_90", _PIXELS + " SELECT vec_id, x AS y, 15 - y AS x, CAST(v AS DOUBLE) AS value FROM p")
_image_query("tr_flip", "ROTATE_HFLIP", _PIXELS + " SELECT vec_id, y, 15 - x AS x, CAST(v AS DOUBLE) AS value FROM p")
_image_query("tr_resize", "RESIZE_8x8", _PIXELS + " SELECT vec_id, y // 2 AS y, x // 2 AS x, avg(v) + 0.0 AS value FROM p GROUP BY 1, 2, 3")
_image_query("tr_threshold", "THRESHOLD_0", _PIXELS + ", k AS (SELECT vec_id, v, count(*) AS n FROM p GROUP BY 1, 2), c AS (SELECT vec_id, v, CAST(sum(n) OVER w AS DOUBLE) AS w, CAST(sum(n * v) OVER w AS DOUBLE) AS m, CAST(sum(n * v) OVER (PARTITION BY vec_id) AS DOUBLE) AS total FROM k WINDOW w AS (PARTITION BY vec_id ORDER BY v)), o AS (SELECT vec_id, arg_min(v, (-round(power(total * w / 256 - m, 2) / (w * (256 - w)), 6), v)) AS cut FROM c WHERE w < 256 GROUP BY 1)" + _pixel_sql("CASE WHEN v > cut THEN 255 ELSE 0 END", "(SELECT p.vec_id, y, x, v, cut FROM p JOIN o USING (vec_id))"))
_image_query("tr_crop_black", "CROPBLACK", _PIXELS + ", r AS (SELECT vec_id, min(y) AS a, max(y) AS b FROM (SELECT vec_id, y FROM p GROUP BY 1, 2 HAVING avg(CASE WHEN v > 16 THEN 1 ELSE 0 END) > 0.125) GROUP BY 1), c AS (SELECT vec_id, min(x) AS d, max(x) AS e FROM (SELECT vec_id, x FROM p GROUP BY 1, 2 HAVING avg(CASE WHEN v > 16 THEN 1 ELSE 0 END) > 0.125) GROUP BY 1) SELECT vec_id, y - a AS y, x - d AS x, CAST(v AS DOUBLE) AS value FROM p JOIN r USING (vec_id) JOIN c USING (vec_id) WHERE y BETWEEN a AND b AND x BETWEEN d AND e")
_image_query("tr_template", "TEMPLATE_100_3x3_128", _PIXELS + ", t AS (SELECT vec_id, b.y AS ty, a.x AS tx, round(avg(abs(p.v - 128)), 9) AS d FROM p JOIN (SELECT range * 3 AS y FROM range(5)) b ON p.y BETWEEN b.y AND b.y + 2 JOIN (SELECT range * 3 AS x FROM range(5)) a ON p.x BETWEEN a.x AND a.x + 2 GROUP BY 1, 2, 3), f AS (SELECT vec_id, arg_min(ty, (d, ty, tx)) AS ty, arg_min(tx, (d, ty, tx)) AS tx FROM t WHERE d < 100 GROUP BY 1)" + _pixel_sql("CASE WHEN y BETWEEN ty AND ty + 2 AND x BETWEEN tx AND tx + 2 THEN 0 ELSE v END", "(SELECT p.*, ty, tx FROM p LEFT JOIN f USING (vec_id))"))
for _n, _c in {"canny": "CANNY_50_100", "dog": "DOG_0.8_1.6", "noise": "NOISE_0.1_0.1_7", "pca": "PCA_40"}.items():
    _image_query(f"tr_{_n}", _c)

# colours

_LIGHT = "(CASE WHEN yy > 0.008856 THEN 116 * cbrt(yy) - 16 ELSE 903.3 * yy END)"
_TOXYZ = ", w AS (SELECT vec_id, y, x, 0.412453::DOUBLE * r + 0.357580::DOUBLE * g + 0.180423::DOUBLE * b AS xx, 0.212671::DOUBLE * r + 0.715160::DOUBLE * g + 0.072169::DOUBLE * b AS yy, 0.019334::DOUBLE * r + 0.119193::DOUBLE * g + 0.950227::DOUBLE * b AS zz FROM c)"
_TOONE = _TOXYZ + ", o AS (SELECT vec_id, y, x, xx / 255 AS xx, yy / 255 AS yy, zz / 255 AS zz FROM w)"
_SPAN = ", w AS (SELECT *, greatest(r, g, b) AS top, least(r, g, b) AS low FROM c), o AS (SELECT *, top - low AS d, CASE WHEN top = low THEN 0 WHEN top = r THEN 60 * (g - b) / (top - low) WHEN top = g THEN 120 + 60 * (b - r) / (top - low) ELSE 240 + 60 * (r - g) / (top - low) END AS t FROM w), s AS (SELECT *, (CASE WHEN t < 0 THEN t + 360 ELSE t END) / 2 AS hue FROM o)"
_HUE = "floor(round(hue, 6) + 0.5) % 180"


def _channels_sql(prefix: str, one: str, two: str, three: str, source: str) -> str:
    return _COLORS + prefix + f", z AS (SELECT vec_id, y, x, unnest([0, 1, 2]) AS channel, unnest([CAST({one} AS DOUBLE), CAST({two} AS DOUBLE), CAST({three} AS DOUBLE)]) AS v FROM {source}) SELECT vec_id, y, x, CAST(channel AS BIGINT) AS channel, {_BYTE.format('v')} + 0.0 AS value FROM z"


def _lab(t: str) -> str:
    return f"(CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16.0::DOUBLE / 116 END)"


_image_query("tr_color_ycrcb", "COLOR_YCRCB", _channels_sql(", w AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM c)", "l", "(r - l) * 0.713 + 128", "(b - l) * 0.564 + 128", "w"), True)
_image_query("tr_color_xyz", "COLOR_XYZ", _channels_sql(_TOXYZ, "xx", "yy", "zz", "w"), True)
_image_query("tr_color_hsv", "COLOR_HSV", _channels_sql(_SPAN, _HUE, "CASE WHEN top > 0 THEN 255 * d / top ELSE 0 END", "top", "s"), True)
_image_query("tr_color_hls", "COLOR_HLS", _channels_sql(_SPAN, _HUE, "(top + low) / 2", "CASE WHEN d > 0 THEN d / (CASE WHEN top + low < 255 THEN top + low ELSE 510 - top - low END) * 255 ELSE 0 END", "s"), True)
_image_query("tr_color_lab", "COLOR_LAB", _channels_sql(_TOONE, f"{_LIGHT} * 255 / 100", f"500 * ({_lab('(xx / 0.950456)')} - {_lab('yy')}) + 128", f"200 * ({_lab('yy')} - {_lab('(zz / 1.088754)')}) + 128", "o"), True)
_image_query("tr_color_luv", "COLOR_LUV", _channels_sql(_TOONE + ", s AS (SELECT *, CASE WHEN xx + 15 * yy + 3 * zz > 0 THEN xx + 15 * yy + 3 * zz ELSE 1 END AS d FROM o)", f"{_LIGHT} * 255 / 100", f"(13 * {_LIGHT} * (4 * xx / d - 0.19793943) + 134) * 255 / 354", f"(13 * {_LIGHT} * (9 * yy / d - 0.46831096) + 140) * 255 / 262", "s"), True)
_image_query("px_histcolor", "HISTCOLOR_1x1_8F_RGB_2x2x2", _COLORS + _counted("SELECT vec_id, 0 AS z, CAST(r AS BIGINT) // 128 * 4 + CAST(g AS BIGINT) // 128 * 2 + CAST(b AS BIGINT) // 128 AS b FROM c", 8, "count(*) / 256") + _dims("n", "g", "b"), True)
_image_query("px_histcolor_hsv", "HISTCOLOR_1x1_8F_HSV_3x2x2", _COLORS + _SPAN + _counted(f"SELECT vec_id, 0 AS z, least(2, CAST({_HUE} AS BIGINT) * 3 // 180) * 4 + CAST({_BYTE.format('CASE WHEN top > 0 THEN 255 * d / top ELSE 0 END')} AS BIGINT) // 128 * 2 + CAST(top AS BIGINT) // 128 AS b FROM s", 12, "count(*) / 256") + _dims("n", "g", "b"), True)
_image_query("px_histbychannel", "HISTBYCHANNEL_1x1_RGB_4+2+2_8F", _COLORS + _counted("SELECT vec_id, 0 AS z, CAST(r AS BIGINT) // 64 AS b FROM c UNION ALL SELECT vec_id, 0, 4 + CAST(g AS BIGINT) // 128 FROM c UNION ALL SELECT vec_id, 0, 6 + CAST(b AS BIGINT) // 128 FROM c", 8, "count(*) / 256") + _dims("n", "g", "b"), True)
_image_query("px_kf_color", "KF_2x2_YCRCB_1U", _COLORS + ", w AS (SELECT *, 0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b AS l FROM c), o AS (SELECT vec_id, " + _QUARTER + " AS z, " + ", ".join(f"avg({_BYTE.format(v)}) AS c{i}" for i, v in enumerate(("l", "(r - l) * 0.713 + 128", "(b - l) * 0.564 + 128"))) + " FROM w GROUP BY 1, 2), u AS (SELECT vec_id, z * 3 + unnest([0, 1, 2]) AS z, unnest([c0, c1, c2]) AS v FROM o)" + _dims(_BYTE.format("v"), "u"), True)


@query(_PIXELS + ", s AS (SELECT vec_id % 7 AS file, y, x, avg(v) AS mean, var_pop(v) AS variance FROM p GROUP BY 1, 2, 3) SELECT file, y, x, round(mean, 6) AS mean, round(variance, 4) AS variance FROM s")
def px_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and variance of every pixel over the frames of a file (vec_id mod 7)."""
    f = frames(spark, sf_dir).withColumn("file", F.col("vec_id") % 7)
    return pixel_stats(f, "file", "frame").select("file", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"))


_STATIC = _PIXELS + ", s AS (SELECT vec_id % 7 AS file, y, x, CASE WHEN var_pop(v) > 6000 THEN 1 ELSE 0 END AS m FROM p GROUP BY 1, 2, 3), r AS (SELECT file, min(y) AS top, max(y) AS bottom FROM (SELECT file, y FROM s GROUP BY 1, 2 HAVING avg(m) > 0.125) GROUP BY 1), c AS (SELECT file, min(x) AS \"left\", max(x) AS \"right\" FROM (SELECT file, x FROM s GROUP BY 1, 2 HAVING avg(m) > 0.125) GROUP BY 1) SELECT file, top, bottom, \"left\", \"right\" FROM r JOIN c USING (file)"


@query(_STATIC)
def tr_crop_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangle of every file that changes over time."""
    out = static_crop(pixel_stats(frames(spark, sf_dir).withColumn("file", F.col("vec_id") % 7), "file", "frame"), "file", 6000.0)
    return out.select("file", *(F.col(c).cast("long").alias(c) for c in ("top", "bottom", "left", "right")))


@query("WITH k AS (SELECT vec_id, k, k * 11.0 AS d FROM embeddings, range(30) r(k)) SELECT vec_id, count(*) AS matches, count(*) FILTER (k % 3 <> 0 OR abs(d - 5) <= 2) AS inliers FROM k GROUP BY 1")
def ransac_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of keypoints that agree with one shift; keypoints and outliers made from ids."""
    ids = read_table(spark, sf_dir, "embeddings").select("vec_id")
    k = ids.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29))))
    x, y = F.pmod(F.col("k") * 37 + F.col("vec_id"), F.lit(100)).cast("double"), F.pmod(F.col("k") * 53, F.lit(100)).cast("double")
    out = F.when(F.col("k") % 3 == 0, F.col("k") * 11.0).otherwise(F.lit(5.0))
    return spatial_inliers(k.select("vec_id", x.alias("x1"), y.alias("y1"), (x + out).alias("x2"), (y + 2).alias("y2")), ["vec_id"], "translation", 30, 2.0)
