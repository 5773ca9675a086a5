"""The whole pipeline on a stream: one shuffle, by host, for everything that remembers.

Decoding, normalising, enrichment, noise filter and rules are a chain of projections and joins with static tables; the
self filter, deduplication and correlation of a host run in one stateful operator, in order of time and arrival within
each micro-batch, so that they agree with each other and with the batch operators.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.enrich import enrich
from ..operators.filters import document_noise
from ..plans.rule_compiler import detect
from ..sources.rules import Rule
from .state import HostStateFactory

#: The flat fields that the stateful operator reads, beside the document itself as JSON.
FIELDS = "host string, seq long, at double, ts string, pid long, ppid long, name string, executable string, command_line string, category array<string>, type array<string>, rule_id string, matched boolean, ip string, port int, drop_reason string"
NODES = (
    "dedup struct<enabled:boolean,mode:string,is_duplicate:boolean,group_id:string,window_seconds:double,count:bigint,first_seen:string,last_seen:string,destination_ips:array<string>,unique_destinations:int,destination_ports:array<int>,reason:string>, "
    "correlation struct<matched:boolean,engine:string,correlation_id:string,rule_id:string,name:string,severity:string,summary:string,window_seconds:double,event_count:bigint,related_rules:array<string>,first_seen:string,last_seen:string,"
    "related_processes:array<struct<pid:bigint,ppid:bigint,name:string,executable:string,command_line:string>>,related_destinations:array<struct<ip:string,port:int>>>"
)


def stateless(documents: DataFrame, rules: list[Rule], snapshot: DataFrame | None = None, enabled: bool = True, **noise: bool) -> DataFrame:
    """Enrichment, the noise filter's reason (column drop_reason) and detection."""
    out = enrich(documents, snapshot) if snapshot is not None else documents
    return detect(out.withColumn("drop_reason", document_noise(**noise)), rules, enabled)


def flat_fields(documents: DataFrame, time_col: str, seq_col: str) -> list[Column]:
    get = F.col
    destination = "destination" in documents.columns
    return [
        F.coalesce("host.hostname", F.lit("")).alias("host"), get(seq_col).cast("long").alias("seq"), get(time_col).cast("double").alias("at"), get("`@timestamp`").alias("ts"), get("process.pid").alias("pid"), get("process.parent.pid").alias("ppid"),
        get("process.name").alias("name"), get("process.executable").alias("executable"), get("process.command_line").alias("command_line"), get("event.category").alias("category"), get("event.type").alias("type"),
        get("edr.detection.rule_id").alias("rule_id"), get("edr.detection.matched").alias("matched"), (get("destination.ip") if destination else F.lit(None).cast("string")).alias("ip"), (get("destination.port") if destination else F.lit(None).cast("int")).alias("port"),
        (get("drop_reason") if "drop_reason" in documents.columns else F.lit(None).cast("string")).alias("drop_reason"),
    ]


def stateful(documents: DataFrame, factory: HostStateFactory, time_col: str = "seen_at", seq_col: str = "seq") -> DataFrame:
    """(host, seq, document as JSON, dedup as JSON, correlation as JSON) of the events that are not dropped; see ``nodes``.

    Works on streams and, with the same result, on batches; there, a host's events meet in one task, so large replays
    should use plans.agent.run_batch. A host's events are taken by time, then ``seq``.
    """
    body = [c for c in documents.columns if c not in ("drop_reason",)]
    rows = documents.select(*flat_fields(documents, time_col, seq_col), F.to_json(F.struct(*[F.col(f"`{c}`") for c in body])).alias("document"))

    def advance(state, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host = factory()
        if state is not None and state.exists:
            host.restore(json.loads(state.get[0]))
        chunk = pd.concat(list(frames), ignore_index=True).sort_values(["at", "seq"], kind="stable")
        out = []
        for e in chunk.astype(object).where(chunk.notna(), None).to_dict("records"):
            for k in ("pid", "ppid", "port", "seq"):
                e[k] = None if e[k] is None else int(e[k])
            for k in ("category", "type"):
                e[k] = None if e[k] is None else list(e[k])
            e["host"] = e["host"] or None
            nodes = host.on_event(e)
            if nodes is not None:
                out.append((e["host"], e["seq"], e["document"], *(None if nodes[k] is None else json.dumps(nodes[k]) for k in ("dedup", "correlation"))))
        if state is not None:
            state.update((json.dumps(host.snapshot()),))
        yield pd.DataFrame(out, columns=["host", "seq", "document", "dedup", "correlation"])

    schema = "host string, seq long, document string, dedup string, correlation string"
    if documents.isStreaming:

        def on_stream(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            yield from advance(state, frames)

        return rows.groupBy("host").applyInPandasWithState(on_stream, schema, "saved string", "append", GroupStateTimeout.NoTimeout)

    def on_batch(frame: pd.DataFrame) -> pd.DataFrame:
        return next(advance(None, iter([frame])))

    return rows.groupBy("host").applyInPandas(on_batch, schema)


def nodes(out: DataFrame) -> DataFrame:
    """``stateful``'s rows with dedup and correlation as structs."""
    kinds = dict(zip(("dedup", "correlation"), NODES.split(", correlation "), strict=True))
    parse = lambda c: F.from_json(c, kinds[c].removeprefix(f"{c} "))
    return out.withColumns({"dedup": parse("dedup"), "correlation": parse("correlation")})


def with_event_id(df: DataFrame, *columns: str) -> DataFrame:
    """``event_id``: a hash of what identifies an event, so that a repeated delivery has the same id."""
    return df.withColumn("event_id", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"), 256))
