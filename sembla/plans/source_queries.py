"""Queries that write the tables in the formats of files and read them back, and further operators on the results."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.functions import vectors as V
from sembla.operators import cluster as C
from sembla.operators import detect as D
from sembla.operators import fusion as U
from sembla.operators import planner as L
from sembla.operators import search as S
from sembla.operators.dataset import sample_levels
from sembla.operators.stats import histogram
from sembla.operators.text import segment_terms, terms, vocabulary, words
from sembla.plans import media_queries as M
from sembla.plans import vector_queries as Q
from sembla.session import read_table, scratch_path
from sembla.sources import files as R
from sembla.sources.datasource import custom_dataset

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


def _write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


@query("SELECT row_number() OVER (ORDER BY path) - 1 AS id, path AS value FROM (SELECT DISTINCT path FROM media_catalog WHERE path IS NOT NULL AND trim(path) <> '' AND NOT starts_with(path, '#'))")
def io_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of a file, by place."""
    path = scratch_path(spark, "strings")
    paths = read_table(spark, sf_dir, "media_catalog").where("path is not null").select("path").distinct().orderBy("path")
    _write_lines(paths.coalesce(1).sortWithinPartitions("path"), path)
    return R.read_strings(spark, path)


@query(f"WITH u AS (SELECT generate_subscripts(embedding, 1) - 1 AS dim, unnest({Q._DOUBLE}) AS x FROM embeddings WHERE embedding IS NOT NULL) SELECT dim, count(*) AS n, round(sum(x), 4) + 0.0 AS total FROM u GROUP BY dim")
def io_vectors_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as text and read back: sums of every dimension."""
    path = scratch_path(spark, "vectors")
    R.write_vectors_text(Q.vectors(spark, sf_dir), "e", path)
    v = R.read_vectors_text(spark, path).select(F.posexplode("vector").alias("dim", "x"))
    return v.groupBy(F.col("dim").cast("long").alias("dim")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("x"), 4) + 0.0).alias("total"))


@query("SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last, len(embedding) AS width FROM embeddings WHERE embedding IS NOT NULL")
def io_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of descriptors, written and read back, its width from the properties."""
    folder = scratch_path(spark, "descriptors")
    v = read_table(spark, sf_dir, "embeddings").select(F.lit("all").alias("file"), "vec_id", "embedding")
    R.write_descriptors(v, "file", "vec_id", "embedding", folder, "EMBEDDING", text=True)
    rows, properties = R.read_descriptors(spark, folder, v.select("file").distinct())
    return rows.select(F.col("num_segment").alias("vec_id"), F.col("descriptor")[0].cast("double").alias("first"), F.col("descriptor")[63].cast("double").alias("last"), F.lit(int(properties["array_length"])).cast("long").alias("width"))


_VIDEOS = "WITH v AS (SELECT file_id, min(path) AS path, min(filesize) AS filesize, min(width) AS width, round(min(time_end), 3) AS time_end, min(fps) AS fps FROM media_catalog WHERE media_type = 'V' AND path IS NOT NULL GROUP BY file_id)"


def _videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read_table(spark, sf_dir, "media_catalog").where("media_type = 'V' and path is not null")
    return files.groupBy("file_id").agg(F.min("path").alias("path"), F.min("filesize").alias("filesize"), F.min("width").alias("width"), F.round(F.min("time_end"), 3).alias("time_end"), F.min("fps").alias("fps"))


def _catalog_lines(v: DataFrame) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    return v.select(F.concat_ws("\t", F.lit("V"), "file_id", "path", text("filesize"), text("width"), F.lit("240"), F.lit("0"), text("time_end"), text("fps"), F.lit("1"), F.lit("GRAY"), F.lit("null")).alias("value"))


@query(_VIDEOS + " SELECT file_id, path, coalesce(filesize, -1) AS filesize, CAST(coalesce(width, -1) AS BIGINT) AS width, CASE WHEN time_end >= 0 THEN time_end END AS time_end, fps, 'GRAY' AS transform FROM v")
def io_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog of videos as a file."""
    path = scratch_path(spark, "catalog")
    _write_lines(_catalog_lines(_videos(spark, sf_dir)), path)
    return R.read_catalog(spark, path).select("file_id", "path", F.coalesce("filesize", F.lit(-1).cast("long")).alias("filesize"), F.coalesce(F.col("width").cast("long"), F.lit(-1).cast("long")).alias("width"), "time_end", "fps", F.col("transforms")[0]["name"].alias("transform"))


@query(_VIDEOS + " SELECT file_id, row_number() OVER (ORDER BY file_id) - 1 AS pos FROM v QUALIFY pos >= 10 AND pos < 30 AND file_id <> (SELECT min(file_id) FROM v)")
def io_catalog_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty videos of the catalog from the tenth place on, but for one that is excluded."""
    path = scratch_path(spark, "catalog")
    v = _videos(spark, sf_dir)
    _write_lines(_catalog_lines(v.orderBy("file_id").coalesce(1).sortWithinPartitions("file_id")), path)
    first = v.agg(F.min("file_id")).first()[0]
    return R.read_catalog(spark, path, f"start=10;length=20;idExclude={first}").select("file_id", "pos")


_CLEAN = "WITH n AS (SELECT ss_name, name_file, name_query, unnest(nns) AS e FROM query_txt), d AS (SELECT ss_name, name_file, name_query, e.name_nn AS name_nn, min(e.distance) AS distance FROM n WHERE e.distance >= 0 AND NOT isnan(e.distance) AND e.name_nn IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ss_name, name_query ORDER BY distance, name_nn) AS rank FROM d)"


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different neighbours of every list with their rank: ss_name, name_file, name_query, rank, name_nn, distance."""
    lists = read_table(spark, sf_dir, "query_txt").select("ss_name", "name_file", "name_query", F.inline("nns")).where("distance >= 0 and not isnan(distance) and name_nn is not null")
    once = lists.groupBy("ss_name", "name_file", "name_query", "name_nn").agg(F.min("distance").alias("distance"))
    order = F.row_number().over(S.W.partitionBy("ss_name", "name_query").orderBy("distance", "name_nn"))
    return once.withColumn("rank", order)


_ONE = "(SELECT min(ss_name) FROM query_txt)"


def _one(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    return r.join(F.broadcast(r.agg(F.min("ss_name").alias("ss_name"))), "ss_name", "left_semi").withColumn("search_time", F.lit(1.5))


@query(_CLEAN + f" SELECT name_file, name_query, rank, name_nn, distance FROM k WHERE ss_name = {_ONE} AND rank <= 4")
def io_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of one search as text files, four neighbours of each list read back."""
    path = scratch_path(spark, "neighbours")
    R.write_neighbours(_one(spark, sf_dir), path)
    return R.read_neighbours(spark, path, 4).select("name_file", "name_query", F.col("rank").cast("long").alias("rank"), "name_nn", "distance")


@query(_CLEAN + f", f AS (SELECT name_file, name_query, name_nn, distance FROM k WHERE ss_name = {_ONE} AND regexp_replace(name_nn, '@[^@]*$', '') <> regexp_replace(name_query, '@[^@]*$', '')) SELECT name_query, row_number() OVER (PARTITION BY name_query ORDER BY distance, name_nn) AS rank, name_nn FROM f QUALIFY rank <= 3")
def io_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a profile: neighbours of other files, ranked again."""
    path = scratch_path(spark, "profile")
    R.write_neighbours(_one(spark, sf_dir), path)
    return R.load_profile(R.read_neighbours(spark, path), 3).select("name_query", F.col("rank").cast("long").alias("rank"), "name_nn")


@query(_CLEAN + f" SELECT name_query, rank, name_nn, '1.0,2.5,0.500,90.0' AS vector_nn, distance FROM k WHERE ss_name = {_ONE}")
def io_vector_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as results of local vectors (one per frame)."""
    path = scratch_path(spark, "vector_neighbours")
    spot = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(0.5).alias("radius"), F.lit(90.0).alias("angle"))
    R.write_vector_neighbours(_one(spark, sf_dir).withColumns({"vector": spot(0.0, 0.0), "vector_nn": spot(1.0, 2.5)}), path)
    return R.read_vector_neighbours(spark, path).select("name_query", F.col("rank").cast("long").alias("rank"), "name_nn", "vector_nn", "distance")


@query(M._DET + " SELECT score, video_q, round(sec_start_q, 3) AS sec_start_q, round(sec_end_q, 3) AS sec_end_q, video_r FROM k WHERE score > 0 AND num_voters IS NOT NULL AND num_misses IS NOT NULL")
def io_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as lines and back, times to milliseconds."""
    path = scratch_path(spark, "detections")
    R.write_detections(M._spans(spark, sf_dir).where("num_voters is not null and num_misses is not null"), path)
    d = R.read_detections(spark, path)
    return d.select("score", "video_q", F.round("sec_start_q", 3).alias("sec_start_q"), F.round("sec_end_q", 3).alias("sec_end_q"), "video_r")


@query(M._SEG + ", n AS (SELECT file_id, num_segment, start_frame, start_second, row_number() OVER (PARTITION BY file_id ORDER BY num_segment) - 1 AS i FROM g WHERE start_frame IS NOT NULL AND selected_frame IS NOT NULL AND end_frame IS NOT NULL AND start_second IS NOT NULL AND selected_second IS NOT NULL AND end_second IS NOT NULL) SELECT i AS num_segment, count(*) AS files, CAST(sum(start_frame) AS BIGINT) AS frames, round(sum(start_second), 3) AS seconds FROM n GROUP BY 1")
def io_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentations as files and back: sums per number of the segment."""
    path = scratch_path(spark, "segmentation")
    cols = ["start_frame", "selected_frame", "end_frame", "start_second", "selected_second", "end_second"]
    g = read_table(spark, sf_dir, "search_segment").dropDuplicates(["segment_uid"]).select("file_id", "num_segment", *cols).dropna().withColumn("fps", F.lit(25.0))
    R.write_segmentation(g, "file_id", path)
    return R.read_segmentation(spark, path).groupBy("num_segment").agg(F.count(F.lit(1)).alias("files"), F.sum("start_frame").alias("frames"), F.round(F.sum("start_second"), 3).alias("seconds"))


@query(M._SEG + " SELECT file_id AS name, num_segment AS num_shot, start_second, end_second FROM g WHERE end_second > start_second AND num_segment < 2")
def io_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of the first version: a head line per file, a line per shot."""
    path = scratch_path(spark, "shots")
    g = M.segments(spark, sf_dir).where("end_second > start_second and num_segment < 2").select("file_id", "num_segment", F.concat_ws("\t", F.col("num_segment").cast("string"), F.col("start_second").cast("string"), F.col("end_second").cast("string")).alias("t"))
    rows = g.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("num_segment", "t"))).alias("s"))
    _write_lines(rows.select(F.concat(F.col("file_id"), F.lit("\t"), F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform("s", lambda x: x["t"]), "\n"))), path)
    numbers = M.segments(spark, sf_dir).where("end_second > start_second and num_segment < 2").select(F.col("file_id").alias("name"), F.col("num_segment").alias("n"))
    place = F.row_number().over(S.W.partitionBy("name").orderBy("n")) - 1
    return R.read_shots(spark, path).join(numbers.withColumn("num_shot", place), ["name", "num_shot"]).select("name", F.col("n").alias("num_shot"), "start_second", "end_second")


@query(M._DET + " SELECT DISTINCT lower(video_q) AS q_file, round(sec_start_q, 6) AS start_q, lower(video_r) AS r_file, round(sec_end_r, 6) AS end_r FROM k")
def io_truth_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as a truth of segments, names with folder and extension."""
    path = scratch_path(spark, "truth")
    d = M._spans(spark, sf_dir)
    named = lambda c: F.concat(F.lit("/x/y/"), F.upper(c), F.lit(".avi"))
    cols = [named("video_q"), F.col("sec_start_q"), F.col("sec_end_q"), named("video_r"), F.col("sec_start_r"), F.col("sec_end_r")]
    _write_lines(d.select(F.concat_ws("\t", *(c.cast("string") for c in cols))), path)
    return R.read_truth_segments(spark, path).select("q_file", F.round("start_q", 6).alias("start_q"), "r_file", F.round("end_r", 6).alias("end_r")).distinct()


@query(_CLEAN + " SELECT DISTINCT name_query, name_nn AS name_object FROM k WHERE rank = 1")
def io_truth_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest neighbours as a truth of frames."""
    path = scratch_path(spark, "truth")
    _write_lines(_results(spark, sf_dir).where("rank = 1").select(F.concat_ws("\t", "name_query", "name_nn")), path)
    return R.read_truth_frames(spark, path)


@query("SELECT DISTINCT q.vec_id AS name_query, CAST(q.label AS VARCHAR) AS category, r.vec_id AS name_object FROM embeddings q JOIN embeddings r ON q.label = r.label WHERE q.vec_id % 100 = 0")
def io_truth_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as categories: two files, joined."""
    v = read_table(spark, sf_dir, "embeddings").where("label is not null")
    one, two = scratch_path(spark, "categories"), scratch_path(spark, "categories")
    _write_lines(Q.queries_of(v).select(F.concat_ws("\t", F.col("vec_id").cast("string"), F.col("label").cast("string"))), one)
    _write_lines(v.select(F.concat_ws("\t", F.col("label").cast("string"), F.col("vec_id").cast("string"))), two)
    t = R.read_truth_categories(spark, one, two)
    return t.select(F.col("name_query").cast("long").alias("name_query"), "category", F.col("name_object").cast("long").alias("name_object"))


@query(M._TERMS + " SELECT word, df, round(ln((SELECT n FROM n) / df), 6) AS weight FROM v")
def io_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary as a file, with the weights of its words."""
    path = scratch_path(spark, "vocabulary")
    docs = M._docs(spark, sf_dir)
    n = docs.count()
    R.write_vocabulary(vocabulary(terms(docs, "doc_id", "text"), "doc_id", n), n, path)
    return R.read_vocabulary(spark, path).withColumn("weight", F.round("weight", 6))


_LINES = "WITH t AS (SELECT DISTINCT doc_id, regexp_replace(substr(text, 1, 400), '[^A-Za-z0-9 ]', ' ', 'g') AS line FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 0), w AS (SELECT doc_id, regexp_extract_all(lower(line), '[a-z0-9_]+') AS words FROM t)"


def _subtitle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines made of the openings of posts, each at a second of its own."""
    t = M._docs(spark, sf_dir).where("text is not null and doc_id % 50 = 0")
    return t.select("doc_id", F.regexp_replace(F.substring("text", 1, 400), "[^A-Za-z0-9 ]", " ").alias("line")).distinct()


@query(_LINES + " SELECT CAST(doc_id AS DOUBLE) AS start_second, len(words) AS words, words[1] AS first FROM w WHERE len(words) > 0")
def io_subtitles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitles as a file: seconds and words of every line."""
    path = scratch_path(spark, "subtitles")
    t = _subtitle_lines(spark, sf_dir)
    _write_lines(t.select(F.concat_ws("\t", F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"), "line")), path)
    return R.read_subtitles(spark, path).select("start_second", F.size("words").cast("long").alias("words"), F.col("words")[0].alias("first"))


@query(_LINES + ", g AS (SELECT * FROM range(0, 40) r(num_segment)), u AS (SELECT num_segment, unnest(words) AS word FROM w JOIN g ON doc_id <= num_segment * 1000 + 1500 AND doc_id + 1 >= num_segment * 1000) SELECT num_segment, word, count(*) AS f FROM u GROUP BY 1, 2")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the lines that every stretch of 1,500 seconds overlaps."""
    lines = _subtitle_lines(spark, sf_dir).select(F.lit("f").alias("file_id"), F.col("doc_id").cast("double").alias("start_second"), (F.col("doc_id") + 1.0).alias("end_second"), words(F.col("line")).alias("words"))
    g = spark.range(40).select(F.lit("f").alias("file_id"), F.col("id").alias("num_segment"), (F.col("id") * 1000.0).alias("start_second"), (F.col("id") * 1000.0 + 1500).alias("end_second"))
    return segment_terms(lines, g, "file_id", 500.0).select("num_segment", "word", "f")


@query("SELECT i AS id, i * i AS square, CASE WHEN i % 3 = 0 THEN 'third' ELSE 'other' END AS kind FROM range(1000) r(i)")
def ds_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset made by calls."""
    return custom_dataset(spark, 1000, lambda i: (i, i * i, "other" if i % 3 else "third"), "id long, square long, kind string")


@query(Q._PAIRS + " SELECT bin, amount, accumulated, round(accumulated / total, 9) AS accumulated_pct FROM s")
def io_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of distances as a file."""
    path = scratch_path(spark, "histogram")
    L.save_histogram(histogram(Q._distances(spark, sf_dir), "distance", 20, 0.0, 100.0), path)
    return L.load_histogram(spark, path).select("bin", "amount", "accumulated", F.round("accumulated_pct", 9).alias("accumulated_pct"))


@query(Q.SQL["knn_l1"])
def io_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search by a distance and an index that were saved and loaded."""
    path = scratch_path(spark, "search")
    L.save_search(path, "L1", "LINEARSCAN", spark)
    distance, index = L.load_search(spark, path)
    v = Q.vectors(spark, sf_dir)
    return Q._out(L.search(Q.queries_of(v), v, "vec_id", "e", distance, index, 5))


@query(Q._NEAREST + " SELECT count(*) AS elements, round(avg(e[1]), 6) AS x1, round(avg(e[2]), 6) AS x2 FROM n GROUP BY centroid_id")
def io_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after one step from given centroids, saved and loaded."""
    path = scratch_path(spark, "kmeans")
    v = Q.vectors(spark, sf_dir)
    L.save_kmeans(C.kmeans(v, "vec_id", "e", 10, init=Q._first(v), max_steps=1), spark, path)
    state = L.load_kmeans(spark, path)
    return spark.createDataFrame([(int(n), round(float(p[0]), 6), round(float(p[1]), 6)) for n, p in zip(state.counts, state.centroids)], "elements long, x1 double, x2 double")


@query(f"WITH v AS ({Q._V.format(e=Q._DOUBLE)}), u AS (SELECT vec_id, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v), m AS (SELECT i, avg(x) AS m FROM u GROUP BY i) SELECT vec_id, round(sum((x - m) * (x - m)), 5) AS square FROM u JOIN m USING (i) GROUP BY 1")
def pca_isometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On all axes a vector keeps its distance from the mean."""
    v = Q.vectors(spark, sf_dir)
    out = C.pca_apply(v, "vec_id", "e", C.pca_fit(v, "e"), 64)
    return out.select(F.col("id").alias("vec_id"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 5).alias("square"))


@query(Q.SQL["knn_l2"])
def ivf_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of centroids, all of them probed: the exact result."""
    v = Q.vectors(spark, sf_dir)
    return Q._out(S.ivf_join(Q.queries_of(v), v, "vec_id", "e", Q._first(v).tolist(), 5, probe=10))


@query(Q.knn_sql(Q.zipped("abs(z[1] - z[2]) * (CASE WHEN z[1] > 0 THEN 2 ELSE 1 END)")))
def knn_user_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distance given as a function: L1 with double weight where the query is positive."""
    v = Q.vectors(spark, sf_dir)
    return Q._out(S.knn_join(Q.queries_of(v), v, "vec_id", "e", lambda q, r: np.stack([(np.abs(x - r) * np.where(x > 0, 2, 1)).sum(1) for x in q]), 5))


_EMD = "WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings WHERE embedding IS NOT NULL), s AS (SELECT vec_id, list_transform(range(1, 8), lambda i: list_sum(a[1:i]) / list_sum(a)) AS e FROM v), d AS (SELECT q.vec_id AS query_id, r.vec_id AS ref_id, " + Q.L1 + " AS d FROM s q, s r WHERE q.vec_id % 100 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM d) SELECT query_id, rank, ref_id, round(d, 6) AS distance FROM k WHERE rank <= 5"
SQL["knn_emd"] = _EMD


@query(Q._LISTS + ", a AS (SELECT query_id, ref_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS r FROM n WHERE d <= 9.5), l AS (SELECT * FROM a WHERE r <= 4) SELECT query_id, r AS rank, ref_id, round(d, 6) AS distance FROM (SELECT query_id, ref_id, ra AS o, a AS d, row_number() OVER (PARTITION BY query_id ORDER BY a, ref_id) AS r FROM k WHERE ra <= 10 AND a <= 1.2) WHERE r <= 4")
def merge_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list as it is loaded: four at most, none over a distance, merged with itself to the length of the first."""
    near = U.limit_list(Q._two(spark, sf_dir)[0], 4, 1.2)
    return Q._out(U.merge_concatenate([near, near], U.longest_list(near)))


@query("WITH t AS (SELECT DISTINCT ss_name, name_file, coalesce(search_time, 0) AS search_time FROM query_txt), a AS (SELECT name_file, max(search_time) AS s FROM t GROUP BY 1) SELECT name_file, s AS search_time FROM a")
def merge_search_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest search time of every file over all searches."""
    t = read_table(spark, sf_dir, "query_txt").select("ss_name", "name_file", F.coalesce("search_time", F.lit(0.0)).alias("search_time")).distinct()
    every = t.select("name_file", F.lit(0.0).alias("search_time")).distinct()
    return U.fuse_search_times([every, t], "MAX")


@query(Q._EVAL + ", h AS (SELECT rank, sum(c) AS hits, count(*) AS answers FROM f GROUP BY rank), e AS (SELECT sum(expected) AS n FROM t) SELECT rank, round(sum(hits) OVER w / (SELECT n FROM e), 9) AS recall, round(sum(hits) OVER w / sum(answers) OVER w, 9) AS precision FROM h WINDOW w AS (ORDER BY rank)")
def eval_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall and precision up to every rank."""
    answers, truth, _ = Q._judging(spark, sf_dir)
    return U.recall_curve(answers, truth).select(F.col("rank").cast("long").alias("rank"), F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def _single_sql(keys: str) -> str:
    return M._DET + f", r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, video_r, sec_start_q, sec_start_r) AS n FROM k WHERE num_voters IS NOT NULL AND num_misses IS NOT NULL) SELECT video_q, video_r, score FROM r WHERE n = 1"


def _single(spark: SparkSession, sf_dir: str, mode: int) -> DataFrame:
    d = M._spans(spark, sf_dir).where("num_voters is not null and num_misses is not null")
    return D.keep_single(d, mode).select("video_q", "video_r", "score")


@query(_single_sql("video_q"))
def detect_single_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best detection of every query file."""
    return _single(spark, sf_dir, 1)


@query(_single_sql("video_q, video_r"))
def detect_single_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best detection of every pair of files."""
    return _single(spark, sf_dir, 2)


@query()
def detect_single_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of detections that overlap on both sides."""
    return _single(spark, sf_dir, 6)


@query("SELECT vec_id, round(embedding[1] * 2.5::DOUBLE, 6) AS x, round(embedding[2] * 0.4::DOUBLE, 6) AS y, round(3 * sqrt(1.0::DOUBLE), 6) AS radius, CAST(round(CAST(embedding[3] AS DOUBLE) * 1000) AS BIGINT) AS scaled FROM embeddings WHERE embedding IS NOT NULL")
def vec_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key points in another image size, and elements scaled and converted."""
    v = Q.vectors(spark, sf_dir)
    point = F.struct(F.col("e")[0].alias("x"), F.col("e")[1].alias("y"), F.lit(3.0).alias("radius"), F.lit(0.0).alias("angle"))
    moved = V.rescale_keypoints(F.array(point), 2.5, 0.4)[0]
    return v.select("vec_id", F.round(moved["x"], 6).alias("x"), F.round(moved["y"], 6).alias("y"), F.round(moved["radius"], 6).alias("radius"), V.scale_convert(F.col("e"), 1000.0, "bigint")[2].alias("scaled"))


@query("SELECT detection_id FROM (SELECT DISTINCT detection_id, video_q, video_r FROM detection WHERE video_q IS NOT NULL) ")
def ds_sample_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in stages, here with the whole share on every level."""
    d = read_table(spark, sf_dir, "detection").where("video_q is not null").select("detection_id", "video_q", "video_r").distinct()
    return sample_levels(d, [(["video_q"], 1.0), (["video_q", "video_r"], 1.0), (["detection_id"], 1.0)]).select("detection_id")


def _lines_sql(line: str) -> str:
    return M._DET + ", f AS (SELECT file_id, min(path) AS path, min(coalesce(time_start, 0)) AS zero FROM media_catalog WHERE path IS NOT NULL GROUP BY 1), r AS (SELECT k.*, row_number() OVER (PARTITION BY video_q ORDER BY score DESC, video_r, sec_start_q, sec_start_r) AS rank FROM k), z AS (SELECT r.*, a.path AS path_q, b.path AS path_r, a.zero AS zero_q, b.zero AS zero_r FROM r JOIN f a ON a.file_id = video_q JOIN f b ON b.file_id = video_r) SELECT video_q, rank, " + line + " AS line FROM z"


def _printed(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    f = read_table(spark, sf_dir, "media_catalog").where("path is not null").groupBy("file_id").agg(F.min("path").alias("path"), F.min(F.coalesce("time_start", F.lit(0.0))).alias("time_start"))
    return R.detection_lines(M._spans(spark, sf_dir), f, layout).withColumn("rank", F.col("rank").cast("long"))


@query(_lines_sql("'vlc --start-time ' || CAST(CAST(round(sec_start_q + zero_q) AS BIGINT) AS VARCHAR) || ' --stop-time ' || CAST(CAST(round(sec_end_q + zero_q) AS BIGINT) AS VARCHAR) || ' ' || path_q || ' --start-time ' || CAST(CAST(round(sec_start_r + zero_r) AS BIGINT) AS VARCHAR) || ' --stop-time ' || CAST(CAST(round(sec_end_r + zero_r) AS BIGINT) AS VARCHAR) || ' ' || path_r"))
def detect_print_vlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as calls of a player."""
    return _printed(spark, sf_dir, "VLC")


@query(_lines_sql("video_q || ' Q0 ' || video_r || ' ' || CAST(CAST(floor(round(sec_start_r) / 60) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(round(sec_start_r) AS BIGINT) % 60 AS VARCHAR) || ' ' || CAST(CAST(floor(round(sec_end_r) / 60) AS BIGINT) AS VARCHAR) || '.' || CAST(CAST(round(sec_end_r) AS BIGINT) % 60 AS VARCHAR) || ' ' || rank || ' ' || format('{:.4f}', score)"))
def detect_print_lnk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as lines of links."""
    return _printed(spark, sf_dir, "LNK")
