"""Small helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

#: Rows in an Arrow batch. Texts can be long, so batches stay short.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Lower Spark's default of 10,000 rows a batch, unless the user has set another value."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def unused(df: DataFrame, name: str) -> str:
    """A column name that *df* does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def every(df: DataFrame) -> list[Column]:
    """All columns of *df*, whatever stands in their names."""
    return [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in df.columns]


def map_in_place(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], dropped: int = 0) -> DataFrame:
    """mapInArrow that keeps the columns of *df*, less the last *dropped* ones; inside, columns are known by place.

    Spark resolves the names of what it passes on, so names with dots are set aside meanwhile.
    """
    names = df.columns[: len(df.columns) - dropped]
    plain = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    kept = StructType(plain.schema.fields[: len(names)])
    return plain.mapInArrow(fn, kept).toDF(*names)


def map_batches(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list] | None], schema: str) -> DataFrame:
    """Apply *fn* to each batch as a dict of Python lists; it returns a dict of columns or None."""
    small_batches(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch.to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))
