"""Readers and writers of the text and binary file formats.

Lines that start with ``#`` and blank lines are skipped everywhere. Files whose
records span several lines are read one file per row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sembla.functions.strings import fixed_decimals, format_seconds, parse_fraction, parse_seconds
from sembla.operators.detect import rank_detections
from sembla.operators.ordered import with_positions
from sembla.operators.text import stems, words
from sembla.session import map_pandas

# Element types by name, as NumPy and as Spark types (unsigned ones are widened).
TYPES = {"INT8": ("i1", "tinyint"), "INT16": ("<i2", "smallint"), "INT32": ("<i4", "int"), "INT64": ("<i8", "bigint"), "UINT8": ("u1", "smallint"), "UINT16": ("<u2", "int"), "UINT32": ("<u4", "bigint"), "UINT64": ("<u8", "decimal(20,0)"), "FLOAT": ("<f4", "float"), "DOUBLE": ("<f8", "double")}
# File extensions by media type.
EXTENSIONS = {"V": "avi mpg mpeg mp4 mkv mov wmv flv webm vob ts m4v 3gp".split(), "I": "jpg jpeg png bmp gif tif tiff webp".split(), "A": "mp3 wav ogg flac m4a aac wma".split()}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return text.where((F.trim("value") != "") & ~F.col("value").startswith("#"))


def _placed(df: DataFrame) -> DataFrame:
    """Lines of one or more files with their place: files in name order, lines in file order."""
    tagged = df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__n": F.monotonically_increasing_id()})
    return with_positions(tagged, ["__file", "__block", "__n"]).drop("__file", "__block", "__n")


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """id, value: one string per line, ids by place."""
    return _placed(_lines(spark, path)).select(F.col("pos").alias("id"), "value")


def read_vectors_text(spark: SparkSession, path: str, kind: str = "DOUBLE") -> DataFrame:
    """id, vector: one vector per line, separated by blanks or tabs. A line of another width raises in the task."""
    spark_type = TYPES[kind][1]
    parts = F.split(F.trim("value"), r"[ \t]+")
    rows = _placed(_lines(spark, path)).select(F.col("pos").alias("id"), F.transform(parts, lambda x: x.cast(spark_type)).alias("vector"))
    first = rows.where("id = 0").select(F.size("vector")).first()
    if first is None:
        return rows
    checked = F.when(F.size("vector") == first[0], F.col("vector")).otherwise(F.raise_error(F.lit("vectors of different widths")))
    return rows.select("id", checked.alias("vector"))


def read_vectors_raw(spark: SparkSession, path: str, rows: int, cols: int, kind: str) -> DataFrame:
    """id, vector from packed row-major numbers; the size must be rows * cols elements. Records are read in parallel."""
    code, spark_type = TYPES[kind]
    width = np.dtype(code).itemsize * cols
    size = spark.read.format("binaryFile").load(path).select(F.sum("length")).first()[0]
    if size != rows * width:
        raise ValueError(f"{path} has {size} bytes, not {rows * width}")
    records = spark.sparkContext.binaryRecords(path, width).zipWithIndex().map(lambda r: (r[1], [x.item() for x in np.frombuffer(r[0], code)]))
    element = "double" if spark_type.startswith("decimal") else spark_type
    return spark.createDataFrame(records, f"id long, vector array<{element}>")


def random_vectors(spark: SparkSession, count: int, dims: int, low: float, high: float, kind: str = "DOUBLE", seed: int = 0) -> DataFrame:
    """id, vector: uniform in [low, high); the same for the same seed, whatever the partitions."""
    spark_type = TYPES[kind][1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [np.random.default_rng([seed, int(i)]).uniform(low, high, dims) for i in pdf["id"]]
            yield pdf.assign(vector=[v.tolist() for v in made])

    out = spark.range(count).transform(map_pandas, run, "id long, vector array<double>")
    return out.select("id", F.col("vector").cast(f"array<{spark_type}>").alias("vector"))


def write_vectors_text(df: DataFrame, vector: str, path: str, separator: str = "\t") -> None:
    """One line per vector."""
    df.select(F.array_join(F.transform(vector, lambda x: x.cast("string")), separator).alias("value")).write.mode("overwrite").text(path)


def write_vectors_raw(df: DataFrame, key: str, vector: str, kind: str, path: str) -> None:
    """Packed row-major numbers in order of key, one binary file per partition in a local or mounted folder, in order of name.

    Each task writes a file of its own and puts it in place when it is complete, so a
    task that is run again does no harm.
    """
    import os

    code = TYPES[kind][0]
    os.makedirs(path, exist_ok=True)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        name = f"{path}/part-{TaskContext.get().partitionId():05d}.raw"
        n = 0
        with open(f"{name}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            for pdf in batches:
                for v in pdf["v"]:
                    f.write(np.asarray(v).astype(code).tobytes())
                    n += 1
        os.replace(f.name, name)
        yield pd.DataFrame({"n": [n]})

    df.select(F.col(key).alias("k"), F.col(vector).alias("v")).orderBy("k").transform(map_pandas, write, "n long").collect()


def read_catalog(spark: SparkSession, path: str, options: str = "") -> DataFrame:
    """Media files: media_type, file_id, path, filesize, width, height, time_start, time_end, fps, num_transforms, transforms, pos.

    options: ``start=..;length=..;idInclude=..;idExclude=..;fileInclude=..;fileExclude=..``;
    start skips lines, length limits what is kept. Ids must be unique, and all files of
    one type (ValueError).
    """
    parts = F.split("value", "\t")
    get = lambda i: F.try_element_at(parts, F.lit(i))
    rest = F.slice(parts, 11, F.greatest(F.lit(0), F.size(parts) - 10))
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(-1), (F.size(rest) / 2).cast("int") - 1)), lambda i: F.struct(rest[i * 2].alias("name"), F.when(F.lower(rest[i * 2 + 1]) != "null", rest[i * 2 + 1]).alias("preprocess")))
    rows = _placed(_lines(spark, path)).select(
        get(1).alias("media_type"), get(2).alias("file_id"), get(3).alias("path"), get(4).try_cast("long").alias("filesize"), get(5).try_cast("int").alias("width"), get(6).try_cast("int").alias("height"),
        parse_seconds(get(7)).alias("time_start"), parse_seconds(get(8)).alias("time_end"), parse_fraction(get(9)).alias("fps"), F.coalesce(get(10).try_cast("int"), F.lit(0)).alias("num_transforms"),
        F.when(F.size(rest) > 1, pairs).otherwise(F.array()).alias("transforms"), "pos",
    )
    start, length, include, exclude = 0, None, [], []
    for item in filter(None, options.lstrip("%").split(";")):
        name, _, value = item.partition("=")
        if name == "start":
            start, length = int(value), length or 1
        elif name == "length":
            length = int(value)
        elif name in ("idInclude", "idExclude"):
            (include if name == "idInclude" else exclude).append(spark.createDataFrame([(value,)], "file_id string"))
        elif name in ("fileInclude", "fileExclude"):
            (include if name == "fileInclude" else exclude).append(_lines(spark, value).select(F.col("value").alias("file_id")))
        else:
            raise ValueError(f"unknown option {name}")
    out = rows.where(F.col("pos") >= start)
    for what, how in ((include, "left_semi"), (exclude, "left_anti")):
        if what:
            ids = what[0]
            for more in what[1:]:
                ids = ids.unionByName(more)
            out = out.join(ids.distinct(), "file_id", how)
    if length:
        out = out.orderBy("pos").limit(length)
    n, ids, kinds = out.agg(F.count(F.lit(1)), F.count_distinct("file_id"), F.count_distinct("media_type")).first()
    if ids != n:
        raise ValueError("file ids are repeated")
    if kinds > 1:
        raise ValueError("a catalog holds one media type")
    return out


def new_catalog(spark: SparkSession, folder: str, media_type: str) -> DataFrame:
    """Media files under a folder, by extension: media_type, file_id (path without extension), path, filesize. Contents aren't read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("filesize"))
    kept = listed.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(EXTENSIONS[media_type]))
    relative = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^{folder.rstrip('/')}/", "")
    return kept.select(F.lit(media_type).alias("media_type"), F.regexp_replace(relative, r"\.[^./]+$", "").alias("file_id"), "path", "filesize")


def read_neighbours(spark: SparkSession, path: str, max_nn: int | None = None, max_distance: float | None = None) -> DataFrame:
    """Search results: name_file, search_time, name_query, rank, name_nn, distance.

    A file has, per query file, a line ``query=..<tab>segments=..<tab>search_time=..`` and
    one line per segment with its neighbours and distances. A list ends at the first
    distance that is smaller than the one before, or over max_distance.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                file, seconds = None, 0.0
                for line in text.split("\n"):
                    if not line.strip() or line.startswith("#"):
                        continue
                    parts = line.split("\t")
                    if line.startswith("query="):
                        file, seconds = parts[0].partition("=")[2], float(parts[2].partition("=")[2])
                        continue
                    before, rank = 0.0, 0
                    for name, value in zip(parts[1::2], parts[2::2]):
                        d = float(value)
                        if d < before or (max_distance is not None and d > max_distance) or (max_nn and rank >= max_nn):
                            break
                        before, rank = d, rank + 1
                        out.append((file, seconds, parts[0], rank, name, d))
            yield pd.DataFrame(out, columns=["name_file", "search_time", "name_query", "rank", "name_nn", "distance"])

    return spark.read.text(path, wholetext=True).transform(map_pandas, run, "name_file string, search_time double, name_query string, rank int, name_nn string, distance double")


def load_profile(result: DataFrame, max_nn: int | None = None, max_distance: float | None = None) -> DataFrame:
    """Results without neighbours of the query's own file; ranks are counted again, then the limits apply."""
    from pyspark.sql.window import Window as W

    file = lambda c: F.regexp_replace(c, "@[^@]*$", "")
    kept = result.where(file("name_query") != file("name_nn"))
    out = kept.withColumn("rank", F.row_number().over(W.partitionBy("name_file", "name_query").orderBy("rank")))
    if max_nn:
        out = out.where(F.col("rank") <= max_nn)
    return out.where(F.col("distance") <= max_distance) if max_distance is not None else out


def write_neighbours(result: DataFrame, path: str) -> None:
    """Search results as text, one file per query file (partitioned by its name). A list is bounded by the neighbours asked for."""
    pair = F.concat_ws("\t", "name_nn", F.col("distance").cast("string"))
    lists = result.groupBy("name_file", "search_time", "name_query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", pair.alias("t")))), lambda x: x["t"]), "\t").alias("l"))
    files = lists.groupBy("name_file", "search_time").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.concat_ws("\t", "name_query", "l"))).alias("rows"))
    head = F.concat(F.lit("query="), F.col("name_file"), F.lit("\tsegments="), F.col("n").cast("string"), F.lit("\tsearch_time="), F.col("search_time").cast("string"))
    files.select("name_file", F.concat(head, F.lit("\n"), F.array_join("rows", "\n")).alias("value")).write.mode("overwrite").partitionBy("name_file").text(path)


def write_vector_neighbours(result: DataFrame, path: str) -> None:
    """Results of local vectors as text: per frame a head line and a line per local vector.

    result: name_query (file@segment), search_time, vector and vector_nn (x, y, radius, angle), name_nn, rank, distance.
    """
    spot = lambda v: F.format_string("%.1f,%.1f,%.3f,%.1f", *(F.col(f"{v}.{c}").cast("double") for c in ("x", "y", "radius", "angle")))
    near = F.concat(F.col("name_nn"), F.lit("|"), spot("vector_nn"), F.lit("\t"), F.col("distance").cast("string"))
    lists = result.select("name_query", "search_time", spot("vector").alias("v"), F.struct("rank", near.alias("t")).alias("n")).groupBy("name_query", "search_time", "v").agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda x: x["t"]), "\t").alias("l"))
    # a frame's local vectors are bounded by its key points
    frames = lists.groupBy("name_query", "search_time").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.concat_ws("\t", "v", "l"))).alias("rows"))
    head = F.concat(F.lit("query="), F.col("name_query"), F.lit("\tvectors="), F.col("n").cast("string"), F.lit("\tsearch_time="), F.format_string("%.3f", F.col("search_time").cast("double")))
    frames.select(F.concat(head, F.lit("\n"), F.array_join("rows", "\n")).alias("value")).write.mode("overwrite").text(path)


def read_vector_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """The rows of such a text: name_query, search_time, vector, rank, name_nn, vector_nn, distance; places as x,y,radius,angle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["value"]:
                name, seconds = None, 0.0
                for line in text.split("\n"):
                    parts = line.split("\t")
                    if line.startswith("query="):
                        name, seconds = parts[0].partition("=")[2], float(parts[2].partition("=")[2])
                    elif line.strip() and not line.startswith("#"):
                        for i, (near, d) in enumerate(zip(parts[1::2], parts[2::2])):
                            frame, _, place = near.rpartition("|")
                            out.append((name, seconds, parts[0], i + 1, frame, place, float(d)))
            yield pd.DataFrame(out, columns=["name_query", "search_time", "vector", "rank", "name_nn", "vector_nn", "distance"])

    return spark.read.text(path, wholetext=True).transform(map_pandas, run, "name_query string, search_time double, vector string, rank int, name_nn string, vector_nn string, distance double")


def write_descriptors(df: DataFrame, file: str, segment: str, vector: str, folder: str, descriptor: str, segmentation: str = "", kind: str = "FLOAT", text: bool = False) -> None:
    """A store of descriptors: rows by file in ``data`` (columnar, with text also lines in ``text``), and the properties in ``properties``."""
    spark, (_, element) = df.sparkSession, TYPES[kind]
    rows = df.where(F.col(vector).isNotNull()).select(F.col(file).alias("file"), F.col(segment).cast("long").alias("num_segment"), F.transform(vector, lambda x: x.cast(element)).alias("descriptor"))
    width = rows.agg(F.max(F.size("descriptor"))).first()[0] or 0
    properties = {"descriptor": descriptor, "segmentation": segmentation, "descriptor_type": f"ARRAY_{kind}", "array_length": width, "num_subarrays": 1, "subarray_length": width, "single_file": "false"}
    rows.repartition("file").sortWithinPartitions("file", "num_segment").write.mode("overwrite").parquet(f"{folder}/data")
    if text:
        rows.select(F.concat_ws("\t", "file", "num_segment", F.array_join(F.transform("descriptor", lambda x: x.cast("string")), " ")).alias("value")).write.mode("overwrite").text(f"{folder}/text")
    spark.createDataFrame([(i, f"{k}={v}") for i, (k, v) in enumerate(properties.items())], "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(f"{folder}/properties")


def read_descriptors(spark: SparkSession, folder: str, files: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Rows (file, num_segment, descriptor) and properties of a store; only those of ``files`` (column file) if given."""
    properties = dict(r.value.split("=", 1) for r in _lines(spark, f"{folder}/properties").collect())
    rows = spark.read.parquet(f"{folder}/data")
    return (rows.join(files.select("file").distinct(), "file", "left_semi") if files is not None else rows), properties


_DETECTION = ["score", "video_q", "sec_start_q", "sec_end_q", "video_r", "sec_start_r", "sec_end_r", "num_voters", "num_misses"]


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """Detections with their rank by score within the query video."""
    parts = F.split("value", "\t")
    kinds = {"score": "double", "num_voters": "long", "num_misses": "long"}
    cols = [(parse_seconds(parts[i]) if c.startswith("sec_") else parts[i].cast(kinds.get(c, "string"))).alias(c) for i, c in enumerate(_DETECTION)]
    return rank_detections(_lines(spark, path).select(*cols))


def write_detections(detections: DataFrame, path: str, limit: int | None = None) -> None:
    """Detections with a positive score, best first, at most ``limit`` per query video, times as hh:mm:ss.fff."""
    ranked = rank_detections(detections.where((F.col("score") > 0) & ~F.isnan("score")))
    if limit:
        ranked = ranked.where(F.col("rank") <= limit)
    cols = [format_seconds(F.col(c)) if c.startswith("sec_") else F.col(c).cast("string") for c in _DETECTION]
    ranked.orderBy(F.desc("score"), "video_q", "video_r").select(F.concat_ws("\t", *cols).alias("value")).write.mode("overwrite").text(path)


def detection_lines(detections: DataFrame, catalog: DataFrame, layout: str) -> DataFrame:
    """Detections as lines of a layout: VLC, VIEW, FFMPEG, TXT, LNK, or DB (one line per side).

    catalog: file_id, path, time_start; seconds are shifted by the start of the file.
    """
    side = lambda s: catalog.select(F.col("file_id").alias(f"video_{s}"), F.col("path").alias(f"path_{s}"), F.coalesce("time_start", F.lit(0.0)).alias(f"zero_{s}"))
    d = rank_detections(detections).join(side("q"), "video_q").join(side("r"), "video_r")
    at = lambda s, w: F.col(f"sec_{w}_{s}") + F.col(f"zero_{s}")
    name = lambda s: F.regexp_replace(f"path_{s}", "^.*/", "")
    player = lambda s: F.format_string("--start-time %.0f --stop-time %.0f %s", at(s, "start"), at(s, "end"), f"path_{s}")
    minutes = lambda c: F.concat_ws(".", F.floor(F.round(c) / 60).cast("string"), (F.round(c).cast("long") % 60).cast("string"))
    cut = lambda s: F.concat(F.lit("ffmpeg -y -ss "), format_seconds(at(s, "start")), F.format_string(" -i %s -t %.1f %s_%.0f_%.0f.%s", f"path_{s}", F.col(f"sec_end_{s}") - F.col(f"sec_start_{s}"), F.regexp_extract(name(s), r"^([^.]*)", 1), at(s, "start"), at(s, "end"), F.regexp_extract(name(s), r"([^.]*)$", 1)))
    table = lambda s: F.format_string("%s\t%.1f\t%.1f\t%.1f", name(s), at(s, "start"), at(s, "end"), F.col(f"sec_end_{s}") - F.col(f"sec_start_{s}"))
    entry = lambda s: F.format_string("%s_%.0f_%.0f\t%s", f"video_{s}", at(s, "start"), at(s, "end"), f"path_{s}")
    layouts: dict[str, Column] = {
        "VLC": F.array(F.concat_ws(" ", F.lit("vlc"), player("q"), player("r"))), "VIEW": F.array(F.concat_ws(" ", F.lit("view"), player("q"), player("r"))), "FFMPEG": F.array(cut("r"), cut("q")),
        "TXT": F.array(F.concat_ws("\t", table("q"), table("r"), F.format_string("%.2f", "score"))), "DB": F.array(entry("q"), entry("r")),
        "LNK": F.array(F.concat_ws(" ", "video_q", F.lit("Q0"), "video_r", minutes(F.col("sec_start_r")), minutes(F.col("sec_end_r")), F.col("rank").cast("string"), F.coalesce(fixed_decimals(F.col("score"), 4), F.lit("null")))),
    }
    lines = d.select("video_q", "rank", F.explode(layouts[layout]).alias("line"))
    return lines.distinct() if layout == "DB" else lines


def read_segmentation(spark: SparkSession, path: str) -> DataFrame:
    """Segments of one or more files: file, num_segment, frames and seconds (start, selected, end), fps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for file, text in zip(pdf["file"], pdf["value"]):
                lines = [x.split("\t") for x in text.split("\n") if x.strip() and not x.startswith("#")]
                for i, p in enumerate(lines[1 : 1 + int(lines[0][0])] if lines else []):
                    out.append((file, i, *(int(x) for x in p[:3]), *(float(x) for x in p[3:6]), float(lines[0][1])))
            yield pd.DataFrame(out, columns=["file", "num_segment", "start_frame", "selected_frame", "end_frame", "start_second", "selected_second", "end_second", "fps"])

    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("_metadata.file_path", "^.*/", "").alias("file"), "value")
    return text.transform(map_pandas, run, "file string, num_segment long, start_frame long, selected_frame long, end_frame long, start_second double, selected_second double, end_second double, fps double")


def write_segmentation(segments: DataFrame, key: str, path: str) -> None:
    """Segments (key, num_segment, frames, seconds, fps) in the same form, one folder per file."""
    cols = ["start_frame", "selected_frame", "end_frame", "start_second", "selected_second", "end_second"]
    row = F.concat_ws("\t", *(F.col(c).cast("string") for c in cols))
    rows = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("fps").alias("fps"), F.array_sort(F.collect_list(F.struct("num_segment", row.alias("t")))).alias("r"))
    text = F.concat(F.concat_ws("\t", F.col("n").cast("string"), F.col("fps").cast("string")), F.lit("\n"), F.array_join(F.transform("r", lambda x: x["t"]), "\n"))
    rows.select(key, text.alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def read_shots(spark: SparkSession, path: str, version: int = 1) -> DataFrame:
    """Shots: name, num_shot, start_second, selected_second, end_second.

    Version 1 lists each shot's seconds. Versions 2 and 3 list frames at 25 per second:
    2 the cuts between shots, 3 one frame of every shot, which then ends halfway to the next.
    """

    def shots_of(lines: list[str]) -> Iterator[tuple]:
        at = 0
        while at < len(lines):
            if version == 1:
                name, count = lines[at].split("\t")[0], int(lines[at].split("\t")[1])
                spans = [tuple(map(float, x.split("\t")[1:3])) for x in lines[at + 1 : at + 1 + count]]
                rows = [(a, (a + b) / 2, b) for a, b in spans]
                at += 1 + count
            else:
                name, total = lines[at], int(lines[at + 1]) / 25
                marks = sorted(int(x) / 25 for x in lines[at + 5].split()) if int(lines[at + 4]) else []
                at += 6 if int(lines[at + 4]) or (at + 5 < len(lines) and not lines[at + 5].strip()) else 5
                if version == 2:
                    edges = [0.0, *marks, total]
                    rows = [(a, (a + b) / 2, b) for a, b in zip(edges, edges[1:])]
                else:
                    edges = [0.0, *((a + b) / 2 for a, b in zip(marks, marks[1:])), total]
                    rows = [(a, m, b) for a, m, b in zip(edges, marks, edges[1:])]
            yield from ((name, i, *r) for i, r in enumerate(rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [row for text in pdf["value"] for row in shots_of([x for x in text.split("\n") if x.strip() and not x.startswith("#")])]
            yield pd.DataFrame(out, columns=["name", "num_shot", "start_second", "selected_second", "end_second"])

    return spark.read.text(path, wholetext=True).transform(map_pandas, run, "name string, num_shot long, start_second double, selected_second double, end_second double")


def read_truth_frames(spark: SparkSession, path: str) -> DataFrame:
    """name_query, name_object: pairs of frames (file@segment)."""
    p = F.split("value", "\t")
    return _lines(spark, path).select(p[0].alias("name_query"), p[1].alias("name_object")).distinct()


def read_truth_categories(spark: SparkSession, queries: str, objects: str) -> DataFrame:
    """name_query, category, name_object from (query, category) and (category, object) lines."""
    p = F.split("value", "\t")
    q = _lines(spark, queries).select(p[0].alias("name_query"), p[1].alias("category"))
    o = _lines(spark, objects).select(p[0].alias("category"), p[1].alias("name_object"))
    return q.distinct().join(o.distinct(), "category").select("name_query", "category", "name_object")


def read_truth_segments(spark: SparkSession, path: str) -> DataFrame:
    """q_file, start_q, end_q, r_file, start_r, end_r; names lower-cased without folder and extension; seconds may be fractions a/b."""
    p = F.split("value", "\t")
    name = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, "^.*/", ""), r"\.[^.]*$", ""))
    return _lines(spark, path).select(name(p[0]).alias("q_file"), parse_fraction(p[1]).alias("start_q"), parse_fraction(p[2]).alias("end_q"), name(p[3]).alias("r_file"), parse_fraction(p[4]).alias("start_r"), parse_fraction(p[5]).alias("end_r"))


def read_subtitles(spark: SparkSession, path: str, stem: bool = False) -> DataFrame:
    """start_second, end_second, words: lines without a word are dropped; words are lower-cased first."""
    p = F.split("value", "\t", 3)
    listed = words(F.try_element_at(p, F.lit(3)))
    rows = _lines(spark, path).select(parse_seconds(p[0]).alias("start_second"), parse_seconds(p[1]).alias("end_second"), listed.alias("words")).where(F.size("words") > 0)
    return rows.withColumn("words", stems(F.col("words"))) if stem else rows


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """word, df, weight = ln(documents / df), from a first line ``words<tab>documents`` and one line per word."""
    rows = _placed(_lines(spark, path))
    documents = int(rows.where("pos = 0").first()["value"].split("\t")[1])
    p = F.split("value", "\t")
    return rows.where("pos > 0").select(p[0].alias("word"), p[1].cast("long").alias("df")).withColumn("weight", F.log(F.lit(float(documents)) / F.col("df")))


def write_vocabulary(vocab: DataFrame, documents: int, path: str) -> None:
    """The same format, sorted without regard to case."""
    n = vocab.count()
    head = vocab.sparkSession.createDataFrame([("", f"{n}\t{documents}")], "k string, value string")
    rows = vocab.select(F.lower("word").alias("k"), F.concat_ws("\t", "word", F.col("df").cast("string")).alias("value"))
    head.unionByName(rows).orderBy("k", "value").select("value").write.mode("overwrite").text(path)
