"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for intermediate data, which every executor shares, so the rows outlive any executor.

    Only a session on one machine that names none (a test) gets a temporary folder; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewarden-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Spark's switch for deleting a query's shuffle files when it ends; else they stay until the driver's collector finds them.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How much a task hands to Python at once. Spark's default of 64 MB is held several times over, by the task and by its worker.
BATCH_BYTES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session has ``values`` inside, and its own again after that."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


#: Rows for which a file of its own is worth while.
FILE_ROWS = 20_000


def cut(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there. What was shuffled for it is deleted, as nothing reads that again.

    Where it is known to have at most ``rows`` short rows, they are written to no more files, by no more tasks, than those fill.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    with settings(df.sparkSession, BATCH_BYTES | {SHUFFLE_CLEANUP: "true"}):
        return df.select("*").checkpoint(eager=True)  # a new plan, as one made before keeps the old setting


def slices(batch: pa.RecordBatch, column: int, rows: int, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in parts of at most ``rows`` rows and about ``size`` bytes of its text column; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, min(start + rows, int(np.searchsorted(ends, before + size, side="right"))))
        yield batch.slice(start, end - start)
        start = end


#: A key with more than a ten-thousandth of all rows is hot, so there are fewer than this many of them, whatever the table.
HOT_KEYS = 10_000


def hot_limit(rows: int) -> int:
    return max(1000, rows // HOT_KEYS)


def join_counted(rows: DataFrame, single: DataFrame, key: str, limit: int) -> DataFrame:
    """``rows`` with the columns of ``single``, which has one row for each key and, as ``n``, how many of ``rows`` have it.

    Keys with more than ``limit`` rows are broadcast, and their rows stay where they are; with ``hot_limit`` of the number
    of rows there are at most ``HOT_KEYS`` such keys. The others are shuffled, none of them with more than ``limit`` rows.
    """
    hot = single.where(F.col("n") > limit).drop("n")
    cold = single.where(F.col("n") <= limit).drop("n")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def row_key(df: DataFrame) -> Column:
    """128 bits of all columns of a row, as a string: rows with the same key are the same."""
    values = [F.to_json(c) if isinstance(f.dataType, MapType) else c for f, c in ((f, F.col(f"`{f.name}`")) for f in df.schema.fields)]
    nulls = F.concat(*[v.isNull().cast("int").cast("string") for v in values])  # a hash passes over nulls
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), nulls, *values)), 16, "0") for seed in (1, 2)])


def small_side(df: DataFrame, most: int) -> DataFrame:
    """``df``, to be broadcast if it is found to have at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df
