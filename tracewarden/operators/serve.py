"""Reading back delivered events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp_limit, html_escape


def tail(rows: DataFrame, order: str, limit: object, default: int = 5) -> DataFrame:
    """The newest rows: a top-k by ``order``, newest first; the limit is clamped to 1..100."""
    return rows.orderBy(F.desc(order)).limit(clamp_limit(limit, default))


def tail_json(lines: DataFrame, order: str, value: str, limit: object, schema: str, default: int = 5) -> DataFrame:
    """Of the newest ``limit`` lines, those that parse, newest first: fewer than asked for if some don't."""
    newest = tail(lines, order, limit, default)
    parsed = newest.withColumn("record", F.from_json(value, schema, {"mode": "PERMISSIVE"}))
    valid = F.try_parse_json(F.col(value)).isNotNull() if hasattr(F, "try_parse_json") else F.col("record").isNotNull()
    return parsed.where(valid & F.col("record").isNotNull()).select(order, "record.*")


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, value) of the lines of text files; positions grow within a file."""
    return spark.read.text(path).withColumn("position", F.monotonically_increasing_id())


def accept_batch(bodies: DataFrame, body: str, schema: str) -> DataFrame:
    """Posted bodies checked: (status, reason, accepted events). An array of objects is accepted whole."""
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    is_array = parsed.isNotNull() & F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    status = F.when(text == "", 400).when(parsed.isNull(), 400).when(~is_array, 400).otherwise(200)
    reason = F.when(text == "", "empty body").when(parsed.isNull(), "invalid json").when(~is_array, "expected a json array")
    events = F.when(status == 200, F.from_json(text, f"array<{schema}>"))
    return bodies.withColumns({"status": status, "reason": reason, "events": events, "received": F.coalesce(F.size(events), F.lit(0))})


def overview(records: DataFrame) -> DataFrame:
    """Nine escaped columns for a page of events; missing values are empty."""
    text = lambda c: html_escape(F.coalesce(F.col(c).cast("string"), F.lit("")))
    paths = {"received_at": "received_at", "timestamp": "event.`@timestamp`", "action": "event.event.action", "process_name": "event.process.name", "pid": "event.process.pid", "ppid": "event.process.parent.pid", "user_name": "event.user.name"}
    matched = F.when(F.coalesce(F.col("event.edr.detection.matched"), F.lit(False)), "DA").otherwise("NU")
    return records.select(*[text(p).alias(n) for n, p in paths.items()], matched.alias("matched"), text("event.process.command_line").alias("command_line"))
