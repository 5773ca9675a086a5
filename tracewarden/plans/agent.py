"""All stages in their fixed order, as the settings say: one call for batches, one for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.closure import self_reason
from ..operators.correlate import correlate_alerts
from ..operators.dedup import dedup_alerts
from ..operators.enrich import enrich
from ..operators.filters import document_noise, split_by
from ..operators.normalize import normalize, with_user_names
from ..sources.records import decode
from ..sources.rules import CATALOGUE, Rule
from ..streaming.pipeline import stateful, stateless
from ..streaming.state import Correlator, Deduplicator, HostState
from .rule_compiler import detect

#: Settings of the noise filter and its toggles.
_TOGGLES = {"drop_vscode_noise": "vscode", "drop_proc_polling_noise": "proc_polling", "drop_process_inventory_noise": "process_inventory", "drop_event_receiver_noise": "event_receiver", "drop_known_sleep_polling_noise": "sleep_polling"}


def noise_toggles(config: dict) -> dict[str, bool]:
    noise = config["filters"]["system_noise"]
    if not noise["enabled"]:
        return {k: False for k in ("event_receiver", "vscode", "shell_startup", "git", "proc_polling", "process_inventory", "sleep_polling")}
    return {toggle: bool(noise[name]) for name, toggle in _TOGGLES.items() if name in noise}


def records_stream(spark: SparkSession, path: str, raw_schema: str = "raw binary, seq long, seen_at double", max_files: int = 1000) -> DataFrame:
    """Records that a producer writes as Parquet files, as a stream."""
    return spark.readStream.schema(raw_schema).option("maxFilesPerTrigger", max_files).parquet(path)


def documents_from(raw: DataFrame, hostname: str, wall_ns: int, mono_ns: int, users: DataFrame | None = None, raw_col: str = "raw", time_col: str = "seen_at", seq_col: str = "seq") -> DataFrame:
    """Documents of binary records, with their time and arrival number."""
    decoded = decode(raw, raw_col, (time_col, seq_col))
    return normalize(with_user_names(decoded, users) if users is not None else decoded, hostname, wall_ns, mono_ns, keep=(time_col, seq_col))


def run_batch(documents: DataFrame, config: dict, rules: list[Rule] | None = None, snapshot: DataFrame | None = None, agents: DataFrame | None = None, time_col: str = "seen_at", seq_col: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(documents through all stages, dropped documents with ``drop_reason``)."""
    rules = CATALOGUE if rules is None else rules
    dropped = []
    if agents is not None and config["agent"]["self_filter"]["enabled"]:
        flat = documents.withColumns({"__host": F.col("host.hostname"), "__pid": F.col("process.pid"), "__ppid": F.col("process.parent.pid")})
        marked = self_reason(flat, agents, "__host", seq_col, "__pid", "__ppid").drop("__host", "__pid", "__ppid")
        dropped.append(marked.where("drop_reason is not null"))
        documents = marked.where("drop_reason is null").drop("drop_reason")
    if snapshot is not None and config["enrichment"]["proc_enricher"]["enabled"]:
        documents = enrich(documents, snapshot)
    documents, noise = split_by(documents, document_noise(**noise_toggles(config)))
    dropped.append(noise)
    documents = detect(documents, rules, config["rules"]["sigma"]["enabled"])
    d, c = config["deduplication"], config["correlation"]
    documents = dedup_alerts(documents, time_col, seq_col, d["window_seconds"], d["mode"], d["enabled"], d.get("include_destination_ip", False))
    if c["enabled"]:
        documents = correlate_alerts(documents, None, time_col, seq_col, c["window_seconds"], c["ignore_duplicates"])
    out = dropped[0]
    for more in dropped[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return documents, out


def run_stream(documents: DataFrame, config: dict, rules: list[Rule] | None = None, snapshot: DataFrame | None = None, agents: tuple[int, ...] = (), time_col: str = "seen_at", seq_col: str = "seq") -> DataFrame:
    """The same stages on a stream: rows as ``streaming.pipeline.stateful`` gives them."""
    d, c = config["deduplication"], config["correlation"]
    include = d.get("include_destination_ip", False)

    def factory() -> HostState:
        dedup = Deduplicator(d["window_seconds"], d["mode"]) if d["enabled"] else None
        return HostState(set(agents), dedup, Correlator(c["window_seconds"]) if c["enabled"] else None, c["ignore_duplicates"], include)

    use = snapshot if config["enrichment"]["proc_enricher"]["enabled"] else None
    ready = stateless(documents, CATALOGUE if rules is None else rules, use, config["rules"]["sigma"]["enabled"], **noise_toggles(config))
    return stateful(ready, factory, time_col, seq_col)
