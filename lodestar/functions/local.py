"""Small driver-side tables as local relations: no job, no partitions, and the optimizer can fold expressions over them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of a few rows; schema like ``"id long, name string"``."""
    fields = [f.split() for f in schema.split(",")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.table({n: pa.array(list(c), TYPES[t]) for (n, t), c in zip(fields, columns, strict=True)}))


#: Most bytes (by the optimizer's estimate) of a side that is broadcast; beyond, the optimizer picks the join at run time.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint where its estimated size is within BROADCAST_BYTES, else as it is."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
