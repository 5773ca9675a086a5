"""Which events belong to a process and its descendants, learned in arrival order."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder; only a session on one machine may go without naming one."""
    sc = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tracewarden-"))
    return df.checkpoint(eager=True)


def learned_at(events: DataFrame, agents: DataFrame, host: str = "host", seq: str = "seq", pid: str = "pid", ppid: str = "ppid") -> DataFrame:
    """(host, pid, t): the arrival number at which a pid became known as an agent (-1) or a descendant of one.

    ``agents`` has columns host and pid. A pid is learned from its first event after its parent was learned. Each round extends what the round before added,
    from the edges alone, read once; so there are as many rounds as generations; a pid's events never meet in one place but for a minimum.
    """
    edges = _cut(events.select(F.col(host).alias("host"), F.col(pid).alias("pid"), F.col(ppid).alias("ppid"), F.col(seq).alias("seq")).where("pid is not null and ppid is not null and pid != ppid"))
    known = agents.select("host", "pid").distinct().withColumn("t", F.lit(-1).cast("long"))
    front, rounds = known, 0
    while True:
        parents = front.select("host", F.col("pid").alias("ppid"), F.col("t").alias("parent_t"))
        found = edges.join(parents, ["host", "ppid"]).where("seq > parent_t").groupBy("host", "pid").agg(F.min("seq").cast("long").alias("t"))
        old = known.select("host", "pid", F.col("t").alias("old"))
        better = _cut(found.join(old, ["host", "pid"], "left").where("old is null or t < old").select("host", "pid", "t"))
        if better.isEmpty():
            return known
        known = known.unionByName(better).groupBy("host", "pid").agg(F.min("t").alias("t"))
        rounds += 1
        if rounds % 4 == 0:  # what is known is small and made of what was cut, so its plan may grow a little
            known = _cut(known)
        front = better


def self_reason(events: DataFrame, agents: DataFrame, host: str = "host", seq: str = "seq", pid: str = "pid", ppid: str = "ppid") -> DataFrame:
    """``events`` with ``drop_reason``: the agent's own events, then those of processes started by what is known by then."""
    t = learned_at(events, agents, host, seq, pid, ppid)
    mine = t.select(F.col("host").alias("__h"), F.col("pid").alias("__p"), F.col("t").alias("__t"))
    parent = t.select(F.col("host").alias("__h2"), F.col("pid").alias("__p2"), F.col("t").alias("__t2"))
    joined = events.join(mine, (F.col(host) == F.col("__h")) & (F.col(pid) == F.col("__p")), "left").join(parent, (F.col(host) == F.col("__h2")) & (F.col(ppid) == F.col("__p2")), "left")
    own = F.concat(F.lit("agent self event pid="), F.col(pid).cast("string"))
    child = F.concat(F.lit("agent child event pid="), F.col(pid).cast("string"), F.lit(" ppid="), F.col(ppid).cast("string"))
    reason = F.when(F.col("__t") < F.col(seq), own).when(F.col("__t2") < F.col(seq), child)
    return joined.withColumn("drop_reason", reason).drop("__h", "__p", "__t", "__h2", "__p2", "__t2")
