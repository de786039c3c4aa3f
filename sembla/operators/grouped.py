"""Sequential functions over many small groups, without the cost of one pandas frame per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sembla.session import map_arrow


def apply_groups(df: DataFrame, keys: list[str], order: list[str], f: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """f of the rows of every group, in order, as rows of schema.

    One shuffle on keys and a sort per partition; rows stream past and are handed
    over group by group. A group must fit into a task, so keys should name small
    units (such as a pair of files). Columns are those of df, in its order.
    """
    columns = df.columns
    at = [columns.index(k) for k in keys]
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        key = None
        out: list[tuple] = []

        def pack() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t.type) for i, t in enumerate(kind)], schema=kind)

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                mine = tuple(row[i] for i in at)
                if group and mine != key:
                    out += f(group)
                    group = []
                    if len(out) > 10_000:
                        yield pack()
                        out = []
                key = mine
                group.append(row)
        if group:
            out += f(group)
        yield pack()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).transform(map_arrow, run, schema)
