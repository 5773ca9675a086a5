"""Alerts that occur together: set containment over a sliding window of each scope.

An observation sees those before it (by time, then arrival) in any of its scopes, not older than the window (an age of
exactly the window counts), at most the newest ``max_per_scope`` of a scope. A correlation rule holds if the rule ids
seen, its own included, contain all that the rule requires.

At scale, a scope is cut into buckets of time as long as the window: every observation is in its own bucket, and once
more, as context, in the next. So a busy scope spreads over tasks, and no frame ever looks back beyond a bucket.
``related`` lists what each observation sees, which grows with the square of a scope's density; ``counted`` gives numbers
and rule ids alone, in one pass over each sorted bucket.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import key_hash

SEVERITIES = ("informational", "low", "medium", "high", "critical")


@dataclass(frozen=True)
class CorrelationRule:
    id: str
    name: str
    severity: str
    required: tuple[str, ...]
    summary: str = ""


# The shipped correlation rules.
CORRELATIONS = [
    CorrelationRule("corr-external-transfer-outbound-http", "External Transfer Followed By Outbound HTTP", "high", ("lab-process-curl-wget-external-url", "lab-network-curl-outbound-http"), "Procesul a fost executat cu URL extern și a inițiat conexiuni outbound HTTP/HTTPS."),
    CorrelationRule("corr-shell-inline-network-activity", "Shell Inline Command With Network Activity", "high", ("lab-process-shell-inline-command", "lab-network-curl-outbound-http"), "O comandă inline prin shell a fost urmată de activitate de rețea outbound HTTP/HTTPS."),
    CorrelationRule("corr-shell-inline-external-transfer", "Shell Inline Command With External Transfer Tool", "high", ("lab-process-shell-inline-command", "lab-process-curl-wget-external-url"), "O comandă inline prin shell a lansat sau a fost asociată cu un utilitar de transfer extern."),
    CorrelationRule("corr-temp-exec-reverse-shell-port", "Temporary Directory Execution With Reverse Shell Port", "critical", ("lab-process-execution-from-writable-tmp", "lab-network-outbound-reverse-shell-port"), "Un proces lansat dintr-un director temporar a inițiat o conexiune către un port asociat frecvent cu reverse shell."),
]


def related(observations: DataFrame, scopes: Column, time: Column, seq: Column, event_key: Column, payload: Column, window_seconds: float, max_per_scope: int = 128) -> DataFrame:
    """(seq, related): for each observation the distinct ones it sees, its own last, as array of (t, seq, key, payload) by time.

    ``seq`` must be unique. Of observations with equal keys, the first counts. Observations without scopes see themselves.
    """
    seen = F.struct(time.cast("double").alias("t"), seq.alias("seq"), event_key.alias("key"), payload.alias("payload"))
    base = observations.select(seen.alias("own"), F.array_distinct(F.coalesce(scopes, F.array().cast("array<string>"))).alias("scopes"))
    bucket = F.floor(F.col("own.t") / window_seconds).cast("long")
    in_scope = base.select("own", F.explode("scopes").alias("scope")).withColumn("bucket", bucket)
    placed = in_scope.select("own", "scope", F.explode(F.array(F.struct("bucket", F.lit(True).alias("asks")), F.struct((F.col("bucket") + 1).alias("bucket"), F.lit(False).alias("asks")))).alias("b")).select("own", "scope", "b.bucket", "b.asks")
    order = Window.partitionBy("scope", "bucket")
    own = F.col("own")
    if max_per_scope <= 1024:  # a frame of rows holds no more than is asked for
        before = F.collect_list("own").over(order.orderBy("own.t", "own.seq").rowsBetween(-max_per_scope, -1))
        alive = F.filter(before, lambda o: o["t"] >= own["t"] - window_seconds)
    else:  # a frame of time holds no more than the window
        before = F.collect_list("own").over(order.orderBy(F.floor(own["t"] * 1_000_000)).rangeBetween(-int(window_seconds * 1_000_000) - 2, 0))  # what is exact follows
        earlier = F.array_sort(F.filter(before, lambda o: (o["t"] >= own["t"] - window_seconds) & ((o["t"] < own["t"]) | (o["seq"] < own["seq"]))))
        alive = F.slice(earlier, F.greatest(F.lit(1), F.size(earlier) - max_per_scope + 1), F.lit(max_per_scope))
    scoped = placed.withColumn("before", alive).where("asks").select("own", "before")
    # one row for each observation again: those of its scopes, and itself
    found = scoped.unionByName(base.where(F.size("scopes") == 0).select("own", F.array().cast(scoped.schema["before"].dataType).alias("before")))
    joined = found.groupBy(own["seq"].alias("seq")).agg(F.flatten(F.collect_list("before")).alias("before"), F.first("own").alias("own"))
    # of equal keys the first: neighbours when sorted by key, then time
    keyed = F.array_sort(F.transform(F.concat("before", F.array("own")), lambda o: F.struct(o["key"].alias("key"), o["t"].alias("t"), o["seq"].alias("seq"), o["payload"].alias("payload"))))
    staged = joined.select("seq", keyed.alias("keyed"))
    first = F.filter("keyed", lambda x, k: (k == 0) | ~F.get("keyed", k - 1)["key"].eqNullSafe(x["key"]))
    return staged.select("seq", F.array_sort(F.transform(first, lambda o: F.struct(o["t"].alias("t"), o["seq"].alias("seq"), o["key"].alias("key"), o["payload"].alias("payload")))).alias("related"))


def _placed(rows: DataFrame, scope: str, window_seconds: float) -> DataFrame:
    """``rows`` sorted by scope, bucket, time and arrival, once to ask (in their own bucket) and once as context. A row without the scope is alone."""
    bucket = F.floor(F.col("t") / window_seconds).cast("long")
    alone = F.concat(F.lit("\0"), F.col("seq").cast("string"))
    twice = F.explode(F.array(F.struct(bucket.alias("bucket"), F.lit(True).alias("asks")), F.struct((bucket + 1).alias("bucket"), F.lit(False).alias("asks")))).alias("b")
    placed = rows.select(F.coalesce(scope, alone).alias("scope"), twice, *rows.columns).select("scope", "b.bucket", "b.asks", *rows.columns)
    return placed.repartition("scope", "bucket").sortWithinPartitions("scope", "bucket", "t", "seq")


def _look_back(batches: Iterator[pa.RecordBatch], schema: pa.Schema, window_seconds: float, cap: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``_placed`` that ask, each with what it sees added to its n, ids, again and since.

    A set seen is a suffix of the scope so far, so its distinct keys are those whose last occurrence is in it. ``mate`` is
    the scope that was looked at before, in which the row sees those from ``since`` on: keys in both count once.
    """
    now = None
    for b in batches:
        out = []
        for row in zip(*(b.column(c).to_pylist() for c in ("scope", "bucket", "asks", "seq", "t", "key", "rule", "pid", "line", "mate", "n", "ids", "again", "since_t", "since_seq")), strict=True):
            scope, bucket, asks, seq, t, key, rule, pid, line, mate, n, ids, again, since_t, since_seq = row
            if (scope, bucket) != now:
                now, places, latest, of_key, of_rule, of_mate = (scope, bucket), [], [], {}, {}, {}
            at = (t, seq)
            if asks and t is not None:
                start = (t - window_seconds,)
                if len(places) >= cap:
                    start = max(start, places[-cap])
                n += len(latest) - bisect_left(latest, start)
                if mate in of_mate:
                    shared = of_mate[mate]
                    n -= len(shared) - bisect_left(shared, max(start, (since_t,) if since_seq is None else (since_t, since_seq)))
                again = again or (key in of_key and of_key[key][0] >= start)
                ids = sorted({*ids, *(r for r, last in of_rule.items() if last >= start)})
                since_t, since_seq = start if len(start) == 2 else (*start, None)
            if asks:
                out.append((seq, t, key, rule, pid, line, scope, n, ids, again, since_t, since_seq))
            if t is None:
                continue
            if key in of_key:
                old, its_mate = of_key[key]
                for held in (latest, of_mate.get(its_mate, [])):
                    if (k := bisect_left(held, old)) < len(held) and held[k] == old:
                        del held[k]
            places.append(at)
            latest.append(at)
            of_key[key], of_rule[rule] = (at, mate), at
            if mate is not None:
                of_mate.setdefault(mate, []).append(at)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def counted(observations: DataFrame, pid: Column, line: Column, time: Column, seq: Column, event_key: Column, rule_id: Column, window_seconds: float, max_per_scope: int = 128) -> DataFrame:
    """(seq, event_count, ids): how many distinct ones each observation sees, itself included, and their sorted rule ids.

    As ``related`` with the scopes ``pid`` and ``line``, without its lists. ``seq`` must be unique. Observations with equal
    keys must agree in both scopes (but for what isn't in a key, and the scopes have in common).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    rows = observations.select(seq.alias("seq"), time.cast("double").alias("t"), F.unhex(event_key).alias("key"), rule_id.alias("rule"), pid.alias("pid"), line.alias("line"))
    kind = rows.schema["seq"].dataType.simpleString()
    form = f"seq {kind}, t double, key binary, rule string, pid string, line string, mate string, n long, ids array<string>, again boolean, since_t double, since_seq {kind}"
    rows = rows.withColumns({"mate": F.lit(None).cast("string"), "n": F.lit(0).cast("long"), "ids": F.array().cast("array<string>"), "again": F.lit(False), "since_t": F.lit(None).cast("double"), "since_seq": F.lit(None).cast(kind)})
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], form).schema)
    for scope in ("line", "pid"):
        rows = _placed(rows, scope, window_seconds).mapInArrow(lambda batches: _look_back(batches, schema, window_seconds, max_per_scope), form)
    ids = F.array_sort(F.array_distinct(F.concat("ids", F.array("rule"))))
    return rows.select("seq", (F.col("n") + F.when(F.col("again"), 0).otherwise(1)).alias("event_count"), ids.alias("ids"))


def severity_rank(severity: str) -> int:
    return SEVERITIES.index(severity.lower()) if severity.lower() in SEVERITIES else 0


def primary_rule(observed: Column, rules: list[CorrelationRule]) -> Column:
    """The number of the severest rule whose requirements are all observed, the earliest of several; null if none is."""
    hits = [F.when(F.size(F.array_except(F.array(*map(F.lit, r.required)), observed)) == 0, F.struct(F.lit(severity_rank(r.severity)).alias("rank"), F.lit(-k).alias("k"))) for k, r in enumerate(rules)]
    return -F.array_max(F.array(*hits))["k"] if rules else F.lit(None).cast("int")


def _scope_pair(exclude_placeholders: bool) -> tuple[Column, Column]:
    host, line = F.coalesce(F.nullif(F.col("host.hostname"), F.lit("")), F.lit("unknown-host")), F.nullif(F.col("process.command_line"), F.lit(""))
    if exclude_placeholders:
        line = F.when(~line.startswith("unknown ("), line)
    pid = F.concat(F.lit("host:"), host, F.lit(":pid:"), F.col("process.pid").cast("string"))
    cmd = F.concat(F.lit("host:"), host, F.lit(":cmd:"), F.sha2(line.cast("binary"), 256))
    return pid, cmd


def alert_scopes(exclude_placeholders: bool = False) -> Column:
    """A scope for the host's process id and one for its command line."""
    return F.filter(F.array(*_scope_pair(exclude_placeholders)), lambda s: s.isNotNull())


def correlate_alerts(documents: DataFrame, rules: list[CorrelationRule] | None = None, time_col: str = "seen_at", seq_col: str = "seq", window_seconds: float = 60.0, ignore_duplicates: bool = True, max_per_scope: int = 128, exclude_placeholder_scopes: bool = False, details: bool = True) -> DataFrame:
    """``documents`` with ``edr.correlation`` on alerts for which a correlation rule holds. ``seq_col`` must be unique.

    Equal to the stateful form while event keys are distinct within a scope, as they are after deduplication. Without
    ``details`` the node lacks what lists all that an alert sees: first_seen, last_seen, related_processes, related_destinations.
    """
    if not window_seconds > 0:
        raise ValueError("window_seconds must be positive")
    rules = CORRELATIONS if rules is None else rules
    if not rules:
        return documents
    rule_id = F.coalesce(F.col("edr.detection.rule_id"), F.col("rule.id"))
    alert = F.coalesce(F.col("edr.detection.matched"), F.lit(False)) & F.coalesce(rule_id != "", F.lit(False))
    if ignore_duplicates and "alert" in documents.select("edr.*").columns:
        alert = alert & ~F.coalesce(F.col("edr.alert.dedup.is_duplicate"), F.lit(False))
    fields = {"ts": F.col("`@timestamp`"), "rule_id": rule_id, "pid": F.col("process.pid"), "ppid": F.col("process.parent.pid"), "name": F.col("process.name"), "executable": F.col("process.executable"), "command_line": F.col("process.command_line"), "ip": F.col("destination.ip"), "port": F.col("destination.port")}
    key = key_hash(*fields.values(), missing="None")
    alerts, time, seq = documents.where(alert), F.col(time_col), F.col(seq_col)
    hit = counted(alerts, *_scope_pair(exclude_placeholder_scopes), time, seq, key, rule_id, window_seconds, max_per_scope).withColumn("k", primary_rule(F.col("ids"), rules)).where("k is not null")
    rule = F.get(F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.name).alias("name"), F.lit(r.severity).alias("severity"), F.lit(r.summary).alias("summary")) for r in rules]), F.col("k"))
    listed = []
    if details:
        payload = F.struct(*[v.alias(k) for k, v in fields.items()])
        hit = hit.join(related(alerts, alert_scopes(exclude_placeholder_scopes), time, seq, key, payload, window_seconds, max_per_scope), "seq")
        times = F.filter(F.transform("related", lambda o: o["payload"]["ts"]), lambda t: t.isNotNull())
        processes = F.array_distinct(F.transform("related", lambda o: F.struct(*[o["payload"][c].alias(c) for c in ("pid", "ppid", "name", "executable", "command_line")])))
        destinations = F.array_distinct(F.filter(F.transform("related", lambda o: F.struct(o["payload"]["ip"].alias("ip"), o["payload"]["port"].alias("port"))), lambda d: d["ip"].isNotNull() | d["port"].isNotNull()))
        listed = [F.array_min(times).alias("first_seen"), F.array_max(times).alias("last_seen"), processes.alias("related_processes"), destinations.alias("related_destinations")]
    node = hit.withColumn("r", rule).select(
        F.col("seq").alias("__seq"),
        F.struct(
            F.lit(True).alias("matched"),
            F.lit("edge_correlator").alias("engine"),
            F.lit(None).cast("string").alias("correlation_id"),
            F.col("r.id").alias("rule_id"),
            F.col("r.name").alias("name"),
            F.col("r.severity").alias("severity"),
            F.col("r.summary").alias("summary"),
            F.lit(float(window_seconds)).alias("window_seconds"),
            F.col("event_count"),
            F.col("ids").alias("related_rules"),
            *listed,
        ).alias("__node"),
    )
    joined = documents.join(node, documents[seq_col] == node["__seq"], "left")
    ident = key_hash(F.col("__node.rule_id"), F.col("host.hostname"), F.col("process.pid"), F.col("process.parent.pid"), F.col("process.command_line"), F.array_join("__node.related_rules", ","), missing="None")
    correlation = F.when(F.col("__seq").isNotNull(), F.col("__node").withField("correlation_id", ident))
    return joined.withColumn("edr", F.col("edr").withField("correlation", correlation)).drop("__seq", "__node")
