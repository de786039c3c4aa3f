"""Queries that run as streams over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.plans.vector_queries import SQL as VECTOR_SQL
from sembla.session import read_table, shared_dir
from sembla.streaming import streams as S


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    kind = read_table(spark, sf_dir, table).schema
    reader = spark.readStream.schema(kind)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir) if not _folder(spark, f"{sf_dir}/{table}.parquet") else reader.parquet(f"{sf_dir}/{table}.parquet")


def _folder(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of events per day."""
    events = _stream(spark, sf_dir, "events").select("ts", "value")
    name = f"w{uuid.uuid4().hex}"
    out = S.run_to_table(S.windowed_stats(events, "ts", "value", "1 day"), name, f"{shared_dir(spark)}/{name}")
    return out.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "n", "low", "high", F.round("mean", 6).alias("mean"))


def stream_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of a stream of queries."""
    name = f"k{uuid.uuid4().hex}"
    base = f"{shared_dir(spark)}/{name}"
    refs = read_table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    asked = _stream(spark, sf_dir, "embeddings").where("embedding is not null and vec_id % 100 = 0").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))

    def sink(found: DataFrame, number: int) -> None:
        found.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    S.stream_search(asked, refs, "vec_id", "e", "L2", 5, sink, f"{base}/checkpoint").awaitTermination()
    out = spark.read.schema("query_id long, rank int, ref_id long, distance double").parquet(f"{base}/out")
    return out.select("query_id", F.col("rank").cast("long").alias("rank"), "ref_id", (F.round("distance", 6) + 0.0).alias("distance"))


def stream_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running histogram of event values."""
    name = f"h{uuid.uuid4().hex}"
    return S.run_to_table(S.running_histogram(_stream(spark, sf_dir, "events").select("value"), "value", 0.0, 10.0, 12), name, f"{shared_dir(spark)}/{name}")


QUERIES = {"stream_windows": stream_windows, "stream_knn": stream_knn, "stream_histogram": stream_histogram}
SQL = {
    "stream_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(value) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events WHERE ts IS NOT NULL GROUP BY 1",
    "stream_knn": VECTOR_SQL["knn_l2"],
    "stream_histogram": "SELECT greatest(0, least(11, CAST(floor(value / 10) AS BIGINT))) AS bin, count(*) AS amount FROM events WHERE value IS NOT NULL GROUP BY 1",
}
