"""Process and network events made from the rows of the events table, for queries and benchmarks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import RECORD, UINT32_MAX

#: (name, executable, command line, args); None where a process event has none.
PROCESSES = [
    ("bash", "/usr/bin/bash", "bash -c id", ["bash", "-c", "id"]),
    ("cat", "/usr/bin/cat", "cat /etc/passwd", ["cat", "/etc/passwd"]),
    ("curl", "/usr/bin/curl", "curl http://example.com", ["curl", "http://example.com"]),
    ("tool", "/tmp/tool", "/tmp/tool -x", ["/tmp/tool", "-x"]),
    ("sh", "/home/u/.vscode-server/out/cpuUsage.sh", "sh cpuUsage.sh 12", ["sh", "cpuUsage.sh", "12"]),
    ("node", "/opt/VSCode/node/", "node server", ["node", "server"]),
    ("git", "/usr/bin/git", "git rev-parse HEAD", ["git", "rev-parse", "HEAD"]),
    ("MainThread", "/usr/bin/git", "git worktree list --porcelain", ["git", "worktree", "list", "--porcelain"]),
    ("git", "/usr/bin/git", "git rev-parse --git-dir", ["git", "rev-parse", "HEAD"]),
    ("cat", "/usr/bin/cat", "cat /proc/12/stat", ["cat", "/proc/12/stat"]),
    ("which", "/usr/bin/which", "which ps", ["which", "ps"]),
    ("sleep", "/usr/bin/sleep", "sleep 1", ["sleep", "1"]),
    ("dircolors", "/usr/bin/dircolors", "dircolors -b", ["dircolors", "-b"]),
    ("sh", "/bin/sh", "sh /usr/bin/lesspipe", ["sh", "/usr/bin/lesspipe"]),
    ("python3", "/usr/bin/python3", "python3 event_receiver_server.py", ["python3", "event_receiver_server.py"]),
    ("true", None, None, None),
]


def processes(events: DataFrame, *keep: Column) -> DataFrame:
    """(event_id, the ``keep`` columns, name, executable, command_line, args), one of PROCESSES for each event, in turn."""
    text = lambda v: F.lit(v).cast("string")
    listed = F.array(*[F.struct(text(n).alias("name"), text(x).alias("executable"), text(c).alias("command_line"), (F.array(*map(F.lit, a)) if a else F.lit(None).cast("array<string>")).alias("args")) for n, x, c, a in PROCESSES])
    found = events.select("event_id", *keep, F.get(listed, F.pmod("event_id", F.lit(len(PROCESSES))).cast("int")).alias("p"))
    return found.select(*[c for c in found.columns if c != "p"], "p.*")


def processes_sql() -> str:
    quote = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(n)}, {quote(x)}, {quote(c)}, {'CAST(NULL AS VARCHAR[])' if a is None else '[' + ', '.join(map(quote, a)) + ']'})" for k, (n, x, c, a) in enumerate(PROCESSES))
    return f"SELECT e.event_id, v.name, v.executable, v.command_line, v.args FROM events e JOIN (VALUES {rows}) v(k, name, executable, command_line, args) ON v.k = e.event_id % {len(PROCESSES)}"


def micros() -> Column:
    """Microseconds of ``ts`` since 1970, whatever the session's time zone."""
    return F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")


def records(events: DataFrame) -> DataFrame:
    """(event_id, t, raw): a binary kernel record for each event; every 50th is cut short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, users, times = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1, 2))
            kinds = b.column(3).to_pylist()
            rec = np.zeros(len(ids), RECORD)
            rec["timestamp_ns"] = times * 1000
            rec["event_type"] = 1 + ids % 5
            rec["pid"], rec["ppid"] = users, users % 7
            rec["uid"] = ids % 4
            rec["auid"] = np.where(ids % 3 == 0, UINT32_MAX, ids % 3)
            rec["daddr"], rec["saddr"] = ids, 0
            rec["dport"], rec["sport"] = ids % 3000, 0
            rec["family"] = 2
            for k, kind in enumerate(kinds):
                raw = (kind or "").encode()
                rec["comm"][k] = np.void((raw + b"\0junk").ljust(16, b"\0")[:16])
                rec["filename"][k] = np.void((b"/usr/bin/" + raw).ljust(256, b"\0"))
                for i, a in enumerate((raw, b"it's", b"", b"lost")):
                    rec["argv"][k, i] = np.void(a.ljust(128, b"\0"))
            whole = rec.tobytes()
            n = RECORD.itemsize
            raw = [whole[k * n : k * n + (100 if i % 50 == 0 else n)] for k, i in enumerate(ids.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(times), pa.array(raw, pa.binary())], names=["event_id", "t", "raw"])

    return events.select("event_id", "user_id", micros(), "event_type").mapInArrow(run, "event_id long, t long, raw binary")


def documents(events: DataFrame) -> DataFrame:
    """Documents as after enrichment, with ``seen_at`` (seconds) and ``seq``: every fifth event is an outbound connection of its process."""
    joined = processes(events, F.col("user_id"), micros().alias("t"))
    net = F.col("event_id") % 5 == 0
    port = F.when(F.col("name") == "curl", 80).when(F.col("name") == "tool", 4444).otherwise((F.col("event_id") % 1000).cast("int"))
    return joined.select(
        F.date_format(F.timestamp_micros("t"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("@timestamp"),
        F.struct(
            F.lit("event").alias("kind"),
            F.when(net, "network_connection_attempt").otherwise("process_started").alias("action"),
            F.array(F.when(net, "network").otherwise("process")).alias("category"),
            F.array(F.when(net, "connection").otherwise("start")).alias("type"),
        ).alias("event"),
        F.struct(F.concat(F.lit("h"), F.pmod("user_id", F.lit(3)).cast("string")).alias("hostname")).alias("host"),
        F.struct(F.col("user_id").alias("pid"), F.struct(F.pmod("user_id", F.lit(7)).alias("pid")).alias("parent"), "name", "executable", "command_line", F.when(~net, F.col("args")).alias("args")).alias("process"),
        F.when(net, F.struct(F.lit("outbound").alias("direction"), F.lit("tcp").alias("transport"))).alias("network"),
        F.when(net, F.struct(F.concat(F.lit("10.0.0."), (F.col("event_id") % 250).cast("string")).alias("ip"), port.alias("port"))).alias("destination"),
        (F.col("t") / 1_000_000).alias("seen_at"),
        F.col("event_id").alias("seq"),
    )
