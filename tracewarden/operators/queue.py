"""The delivery queue as a DataFrame: (id, created_at, attempts, next_attempt_at, payload, last_error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import backoff_seconds, retryable

QUEUE = "id long, created_at double, attempts int, next_attempt_at double, payload string, last_error string"
NOT_RETRYABLE_SECONDS = 3600.0


def ready(queue: DataFrame, now: float | Column, limit: int) -> DataFrame:
    """The oldest rows that are due: a top-k, never a full sort."""
    return queue.where(F.col("next_attempt_at") <= now).orderBy("id").limit(limit)


def delivered(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """What is left once ``ids`` (column id) are delivered."""
    return queue.join(ids.select("id").distinct(), "id", "left_anti")


def failed(queue: DataFrame, ids: DataFrame, error: str, now: float, delay: Column | float) -> DataFrame:
    """``queue`` with one more attempt, the next time and the error (1,024 characters of it) on ``ids``."""
    marked = queue.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.col("__hit").isNotNull()
    wait = F.lit(delay) if isinstance(delay, (int, float)) else delay
    changes = {
        "next_attempt_at": F.when(hit, F.lit(now) + wait).otherwise(F.col("next_attempt_at")),
        "last_error": F.when(hit, F.left(F.lit(error), F.lit(1024))).otherwise(F.col("last_error")),
        "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
    }
    return marked.withColumns(changes).select(*queue.columns)


def retry_delay(status: Column, attempts: Column, base: float = 2.0, most: float = 60.0) -> Column:
    """Seconds until the next attempt; an error that isn't retryable waits an hour at least."""
    wait = backoff_seconds(attempts, base, most)
    return F.when(retryable(status), wait).otherwise(F.greatest(wait, F.lit(NOT_RETRYABLE_SECONDS)))


def insert(queue: DataFrame, payloads: DataFrame, now: float, payload_col: str = "payload") -> DataFrame:
    """``queue`` with a row for each row of ``payloads``, due at once, with ids after all that are there.

    Ids go by partition and place, so they are unique and ascending within a partition without a sort or a driver loop.
    """
    last = queue.agg(F.max("id")).first()[0] or 0
    new = payloads.select(F.col(payload_col).cast("string").alias("payload"))
    rows = new.select((F.lit(last + 1) + F.monotonically_increasing_id()).alias("id"), F.lit(float(now)).alias("created_at"), F.lit(0).alias("attempts"), F.lit(float(now)).alias("next_attempt_at"), "payload", F.lit(None).cast("string").alias("last_error"))
    return queue.unionByName(rows)


def size_bytes(queue: DataFrame) -> int:
    """Bytes of the payloads and errors that the queue holds."""
    return queue.agg(F.coalesce(F.sum(F.octet_length(F.coalesce("payload", F.lit(""))) + F.octet_length(F.coalesce("last_error", F.lit("")))), F.lit(0)).alias("n")).first().n


def id_at(queue: DataFrame, rank: int, few: int = 10_000, parts: int = 1024) -> int:
    """The ``rank``-th smallest id (from 1). Counts by ranges of ids narrow it down until ``few`` rows are left to be sorted."""
    rows, skipped = queue.select("id"), 0
    while True:
        lo, hi, n = rows.agg(F.min("id"), F.max("id"), F.count("*")).first()
        if n <= few or lo == hi:
            return rows.orderBy("id").limit(rank - skipped).agg(F.max("id")).first()[0]
        width = -(-(hi - lo + 1) // parts)
        counts = sorted(tuple(r) for r in rows.groupBy(F.floor((F.col("id") - lo) / F.lit(width)).cast("long")).count().collect())
        for part, size in counts:
            if skipped + size >= rank:
                rows = rows.where(F.col("id").between(lo + part * width, lo + (part + 1) * width - 1))
                break
            skipped += size


def retain_rows(queue: DataFrame, max_rows: int) -> DataFrame:
    """The newest ``max_rows`` rows: the id of the oldest that stays is found first, then rows are filtered where they are."""
    if max_rows <= 0:
        return queue.limit(0)
    n = queue.count()
    return queue if n <= max_rows else queue.where(F.col("id") >= id_at(queue, n - max_rows + 1))


def shed_oldest(queue: DataFrame, held_bytes: int | None, max_bytes: int, share: float = 0.1) -> DataFrame:
    """If the queue is larger than ``max_bytes``, without its oldest tenth (one row at least). Its size is measured if it is None."""
    if (size_bytes(queue) if held_bytes is None else held_bytes) <= max_bytes:
        return queue
    n = queue.count()
    return retain_rows(queue, n - max(1, int(n * share)))
