"""Helpers shared by the operators: table scan, durable materialisation, Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logloom.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of the input folder; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the session's shared checkpoint folder and cut its lineage."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` in one struct ``row``, so that working columns cannot clash with them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def sha_join(parts) -> F.Column:
    """Comma-joined array column of strings; empty string for an empty array."""
    return F.array_join(parts, ",")


SLICE = 1000  # rows turned into Python objects at once


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, without empty ones."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` where ``fn`` maps a record batch of at most SLICE rows to a dict of columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_pydict(fn(batch))

    return df.mapInArrow(run, schema)


def offsets(totals: DataFrame, key: str, value: str) -> DataFrame:
    """``key`` (0, 1, 2, ...) and ``offset``, the sum of ``value`` over all smaller keys.

    Two levels: within runs of 1024 keys, and over the totals of the runs.
    """
    run = (F.col(key) / 1024).cast("long")
    rows = totals.select(F.col(key), F.col(value).alias("__v"), run.alias("__run"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inner = rows.withColumn("__in", F.coalesce(F.sum("__v").over(before(Window.partitionBy("__run").orderBy(key))), F.lit(0)))
    runs = rows.groupBy("__run").agg(F.sum("__v").alias("__v"))
    outer = runs.select("__run", F.coalesce(F.sum("__v").over(before(Window.orderBy("__run"))), F.lit(0)).alias("__out"))
    return inner.join(outer, "__run").select(key, (F.col("__in") + F.col("__out")).alias("offset"))


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` plus ``name``: 0, 1, 2, ... in ``order``; equal rows in any order.

    Ranges of the order are sorted in their own tasks.  Rows that agree in it
    are told apart by their place, so they can be cut into several ranges too.
    ``df`` is read twice and should be a written table.
    """
    cols = df.columns
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("__place", F.monotonically_increasing_id())
    rows = durable(keyed.repartitionByRange(spread, *order, "__place").sortWithinPartitions(*order, "__place")
                   .withColumn("__part", F.spark_partition_id().cast("long"))
                   .withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    return (rows.join(offsets(sizes, "__part", "__n"), "__part")
            .select(*[F.col(f"`{c}`") for c in cols], (F.col("offset") + F.col("__at")).alias(name)))
