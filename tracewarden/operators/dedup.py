"""Repeated alerts grouped into gap-based sessions.

Batch form of an operator that is stateful in a stream: an alert opens a group if none of its key is alive, that is, if
at least ``window_seconds`` have passed since the key's last alert (a gap of exactly the window splits). Everything is
window functions over one sort by (key, time, arrival).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import key_hash

DUPLICATE = "same_rule_same_process_within_window"


def check_parameters(window_seconds: float, mode: str, max_groups: int = 1) -> None:
    if not window_seconds > 0:
        raise ValueError("window_seconds must be positive")
    if mode not in ("mark", "drop"):
        raise ValueError("mode must be 'mark' or 'drop'")
    if max_groups <= 0:
        raise ValueError("max_groups must be positive")


def sessions(df: DataFrame, key: Column, time: Column, seq: Column, window_seconds: float, sets: dict[str, Column] | None = None, firsts: dict[str, Column] | None = None, prefix: str = "", keep_key: bool = False) -> DataFrame:
    """``df`` with, for each row, ``session`` (number within its key), ``count`` so far, ``is_duplicate``, and running sorted sets.

    ``time`` is in the unit of ``window_seconds``; ties go by ``seq``. ``sets`` names values to collect over the session so
    far (nulls left out), ``firsts`` values of its first row. All share one shuffle. ``keep_key`` keeps the key as ``key``.
    """
    order = Window.partitionBy("__by").orderBy("__time", "__seq")
    staged = df.withColumns({"__by": key, "__time": time.cast("double"), "__seq": seq})
    gap = F.col("__time") - F.lag("__time").over(order)
    staged = staged.withColumn("__new", F.when(gap < window_seconds, 0).otherwise(1))
    staged = staged.withColumn(f"{prefix}session", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("__by", f"{prefix}session").orderBy("__time", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    columns = {f"{prefix}count": F.count(F.lit(1)).over(within), f"{prefix}is_duplicate": F.col("__new") == 0}
    columns |= {f"{prefix}{name}": F.sort_array(F.collect_set(value).over(within)) for name, value in (sets or {}).items()}
    columns |= {f"{prefix}{name}": F.first(value).over(within) for name, value in (firsts or {}).items()}
    columns |= {f"{prefix}key": F.col("__by")} if keep_key else {}
    return staged.withColumns(columns).drop("__by", "__time", "__seq", "__new")


def alert_key(include_destination_ip: bool = False) -> Column:
    """What makes two alerts the same."""
    listed = lambda c: F.array_join(c, ",")
    parts = [F.col("host.hostname"), F.coalesce("edr.detection.rule_id", F.lit("unknown")), listed("event.category"), listed("event.type"), *[F.col(f"process.{x}") for x in ("pid", "executable", "command_line", "name")], F.col("destination.port")]
    return key_hash(*parts, *([F.col("destination.ip")] if include_destination_ip else []))


def dedup_alerts(documents: DataFrame, time_col: str = "seen_at", seq_col: str = "seq", window_seconds: float = 5.0, mode: str = "mark", enabled: bool = True, include_destination_ip: bool = False) -> DataFrame:
    """``documents`` with ``edr.alert.dedup`` on alerts; mode "drop" leaves duplicates out. Other documents pass as they are.

    The number of live groups has no bound here; the streaming form can evict (see streaming.state).
    """
    check_parameters(window_seconds, mode)
    if not enabled:
        return documents
    alert = F.coalesce(F.col("edr.detection.matched"), F.lit(False))
    ip, port = F.nullif(F.col("destination.ip"), F.lit("")), F.col("destination.port")
    # only alerts are shuffled and sorted; all else, which is most of it, passes by
    found = sessions(documents.where(alert), alert_key(include_destination_ip), F.col(time_col), F.col(seq_col), window_seconds, {"ips": ip, "ports": port}, {"first": F.col("`@timestamp`")}, "__", keep_key=True)
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    dedup = F.struct(
        F.lit(True).alias("enabled"),
        F.lit(mode).alias("mode"),
        F.col("__is_duplicate").alias("is_duplicate"),
        F.col("__key").alias("group_id"),
        F.lit(float(window_seconds)).alias("window_seconds"),
        F.col("__count").alias("count"),
        F.col("__first").alias("first_seen"),
        F.col("@timestamp").alias("last_seen"),
        some("__ips").alias("destination_ips"),
        F.when(F.size("__ips") > 0, F.size("__ips")).alias("unique_destinations"),
        some("__ports").alias("destination_ports"),
        F.when(F.col("__is_duplicate"), F.lit(DUPLICATE)).alias("reason"),
    )
    out = found.withColumn("edr", F.col("edr").withField("alert", F.struct(dedup.alias("dedup"))))
    if mode == "drop":
        out = out.where(~F.col("__is_duplicate"))
    out = out.drop("__session", "__count", "__is_duplicate", "__ips", "__ports", "__key", "__first")
    none = F.lit(None).cast(out.schema["edr"].dataType["alert"].dataType)
    return out.unionByName(documents.where(~alert).withColumn("edr", F.col("edr").withField("alert", none)))
