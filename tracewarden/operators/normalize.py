"""Decoded records to nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nested import prune_empty
from ..functions.scalar import ipv4, iso_millis, port, shell_join, user_struct, wall_time
from ..schema import ACCEPT, AF_INET, CONNECT, DATASET, ECS_VERSION, EXECVE, EXECVEAT, MODULE


def with_user_names(df: DataFrame, users: DataFrame, host_col: str | None = None) -> DataFrame:
    """Left join of the user table (uid, name, and ``host_col`` if given) for uid and auid, as ``user_name`` and ``audit_name``.

    Spark broadcasts the table itself if statistics show that it is small enough.
    """
    keys = [host_col] if host_col else []
    named = users.groupBy(*keys, "uid").agg(F.min("name").alias("name"))
    first = named.select(*keys, "uid", F.col("name").alias("user_name"))
    second = named.select(*keys, F.col("uid").alias("auid"), F.col("name").alias("audit_name"))
    return df.join(first, [*keys, "uid"], "left").join(second, [*keys, "auid"], "left")


def normalize(df: DataFrame, hostname: Column | str, wall_ns: Column | int, mono_ns: Column | int, keep: tuple[str, ...] = ()) -> DataFrame:
    """A document for each record of a known type, without empty fields, and the ``keep`` columns.

    ``wall_ns`` and ``mono_ns`` are both clocks at one moment, so that replays give the same times. Columns ``user_name``
    and ``audit_name`` are used if there.
    """
    host = F.lit(hostname) if isinstance(hostname, str) else hostname
    clock = [F.lit(x) if isinstance(x, int) else x for x in (wall_ns, mono_ns)]
    name = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    kind = F.col("event_type")
    process, connect, network = kind.isin(EXECVE, EXECVEAT), kind == CONNECT, kind.isin(CONNECT, ACCEPT)
    event = F.struct(
        F.lit("event").alias("kind"),
        F.lit(MODULE).alias("module"),
        F.lit(DATASET).alias("dataset"),
        F.when(process, "process_started").when(connect, "network_connection_attempt").otherwise("network_connection_accepted").alias("action"),
        F.array(F.when(process, "process").otherwise("network")).alias("category"),
        F.array(F.when(process, "start").otherwise("connection")).alias("type"),
    )
    argv = F.when(process & (F.size("argv") > 0), F.col("argv"))
    proc = F.struct(
        F.col("pid").alias("pid"),
        F.struct(F.col("ppid").alias("pid")).alias("parent"),
        F.col("comm").alias("name"),
        F.when(process, F.col("filename")).alias("executable"),
        F.when(argv.isNotNull(), shell_join(argv)).alias("command_line"),
        argv.alias("args"),
        F.when(argv.isNotNull(), F.size(argv)).alias("args_count"),
    )
    side = lambda ip, p: F.when(network, F.struct(ipv4(ip).alias("ip"), port(p).alias("port")))
    net = F.struct(F.when(connect, "outbound").otherwise("inbound").alias("direction"), F.lit("tcp").alias("transport"), F.when(F.col("family") == AF_INET, "ipv4").alias("type"))
    documents = df.where(kind.isin(EXECVE, EXECVEAT, CONNECT, ACCEPT)).select(
        iso_millis(wall_time("timestamp_ns", *clock)).alias("@timestamp"),
        F.struct(F.lit(ECS_VERSION).alias("version")).alias("ecs"),
        event.alias("event"),
        F.struct(host.alias("hostname")).alias("host"),
        proc.alias("process"),
        user_struct(F.col("uid"), F.col("auid"), name("user_name"), name("audit_name")).alias("user"),
        F.when(network, net).alias("network"),
        side("saddr", "sport").alias("source"),
        side("daddr", "dport").alias("destination"),
        *[F.col(c) for c in keep],
    )
    return prune_empty(documents)
