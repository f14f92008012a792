"""Helpers of the operators: written tables and row numbers in two levels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_dir
from .arrays import text_slices

SMALL_ROWS = 200_000        # tables of at most this many short rows may be broadcast
BATCH_ROWS = 1_000          # rows that Spark hands to Python at once; whole texts are in them


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the folder that all executors share, and read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """Marks a written table of short rows for a broadcast if its count is within the bound."""
    return F.broadcast(df) if df.count() <= most else df


def packed(df: DataFrame) -> DataFrame:
    """All columns as one struct `row`, so columns of an operator cannot clash with those of the table."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], bucket: Column, n_buckets: int,
             out: str) -> DataFrame:
    """Row numbers 0, 1, ... in each group without a task that holds a whole group.

    Rows fall into n_buckets by `bucket`, a hash of the rows; a row number within (group, bucket) plus
    the rows of the group's buckets before it is gapless. Only counts, one per bucket, are summed up
    per group. Repeated rows share a bucket.
    """
    rows = rows.withColumn("_b", F.pmod(bucket, F.lit(n_buckets)).cast("int"))
    counts = rows.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_b").alias("_c"),
                           F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inner = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)))
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group] + [F.col("_b") == F.col("_c")]
    found = inner.join(counts, same)
    return found.withColumn(out, F.col("_first") + F.col("_in") - 1).drop("_b", "_c", "_n", "_first", "_in", *[f"_{g}" for g in group])


def bound_batches(df: DataFrame) -> None:
    """Lowers the session's rows per Arrow batch, so buffers of texts on both sides stay small."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, BATCH_ROWS)


def mapped(df: DataFrame, fn: Callable, schema: T.StructType | str, text: str | None = None) -> DataFrame:
    """mapInArrow with a function of one record batch that gives a dict of columns.

    text names the column whose bytes bound the rows that fn sees at once.
    """
    bound_batches(df)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(schema, prefers_large_types=False)
    at = None if text is None else df.columns.index(text)

    def run(batches):
        for batch in batches:
            for a, b in [(0, batch.num_rows)] if at is None else text_slices(batch.column(at)):
                if b > a:
                    out = fn(batch.slice(a, b - a))
                    yield pa.RecordBatch.from_arrays([_as(out[f.name], f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()      # workers stay for the next stage

    return df.mapInArrow(run, schema)


def _as(values, kind):
    import pyarrow as pa
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if not isinstance(values, pa.Array):
        values = pa.array(values, type=kind)
    return values if values.type == kind else values.cast(kind)
