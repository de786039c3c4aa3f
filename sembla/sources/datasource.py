"""Python data sources: datasets that are made by calls instead of read from files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sembla.session import map_pandas, ship_package


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))


def _ranges(count: int, parts: int) -> list[InputPartition]:
    return [_Range(count * i // parts, count * (i + 1) // parts) for i in range(max(1, parts))]


class RandomVectors(DataSource):
    """spark.read.format("random_vectors") with options count, dims, min, max, seed, partitions: id, vector."""

    @classmethod
    def name(cls) -> str:
        return "random_vectors"

    def schema(self) -> str:
        return "id long, vector array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _RandomReader(dict(self.options))


class _RandomReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = lambda k, d: options.get(k, d)
        self.count, self.dims, self.parts, self.seed = (int(get(k, d)) for k, d in (("count", 100), ("dims", 8), ("partitions", 4), ("seed", 0)))
        self.low, self.high = float(get("min", 0)), float(get("max", 1))

    def partitions(self) -> list[InputPartition]:
        return _ranges(self.count, self.parts)

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for i in range(*partition.value):
            yield i, np.random.default_rng([self.seed, i]).uniform(self.low, self.high, self.dims).tolist()


def register_sources(spark: SparkSession) -> None:
    """Makes the sources of this module known to a session."""
    ship_package(spark)
    spark.dataSource.register(RandomVectors)


def custom_dataset(spark: SparkSession, count: int, get: Callable[[int], tuple], schema: str, partitions: int = 8) -> DataFrame:
    """The objects get(0) .. get(count - 1), each a tuple of schema, made in parallel on the executors."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([get(int(i)) for i in pdf["id"]], columns=names)

    names = [part.strip().split(" ")[0].split(":")[0] for part in _split(schema)]
    return spark.range(0, count, 1, partitions).transform(map_pandas, run, schema)


def _split(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for ch in schema:
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]
