"""Settings: defaults, a YAML file over them, environment variables over both."""

from __future__ import annotations

import os
from collections.abc import Mapping
from copy import deepcopy

# The settings and their defaults.
DEFAULTS = {
    "agent": {"debug_drops": False, "self_filter": {"enabled": True}},
    "output": {"mode": "stdout", "debug": False},
    "enrichment": {"proc_enricher": {"enabled": True, "chunk_size": 4096, "enable_hash_cache": True}},
    "filters": {"system_noise": {"enabled": True, "drop_vscode_noise": True, "drop_proc_polling_noise": True, "drop_process_inventory_noise": True, "drop_event_receiver_noise": True}},
    "rules": {"sigma": {"enabled": True, "rules_dir": "rules"}},
    "deduplication": {"enabled": True, "mode": "mark", "window_seconds": 5.0},
    "correlation": {"enabled": True, "window_seconds": 60.0, "ignore_duplicates": True},
    "http": {"endpoint": "http://127.0.0.1:8080/api/edr/events", "batch_size": 50, "flush_interval_seconds": 1.0, "timeout_seconds": 5.0, "auth_token_env": "EDR_HTTP_AUTH_TOKEN"},
    "sqlite": {"db_path": "data/agent_events.db", "max_rows": 50_000, "max_db_size_mb": 500},
}
#: Environment variable: the setting's path and how its text is read.
ENVIRONMENT = {
    "EDR_OUTPUT_MODE": ("output.mode", str.lower),
    "EDR_OUTPUT_DEBUG": ("output.debug", lambda t: t.lower() in ("1", "true", "yes", "on")),
    "EDR_HTTP_ENDPOINT": ("http.endpoint", str),
    "EDR_HTTP_BATCH_SIZE": ("http.batch_size", int),
    "EDR_HTTP_FLUSH_INTERVAL": ("http.flush_interval_seconds", float),
    "EDR_HTTP_TIMEOUT": ("http.timeout_seconds", float),
    "AGENT_EVENTS_DB": ("sqlite.db_path", str),
    "AGENT_EVENT_DB_MAX_ROWS": ("sqlite.max_rows", int),
    "AGENT_EVENT_DB_MAX_SIZE_MB": ("sqlite.max_db_size_mb", int),
}


def merged(base: dict, over: Mapping) -> dict:
    """``base`` with ``over`` laid over it, maps into maps."""
    out = deepcopy(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), dict) else deepcopy(v)
    return out


def load_config(path: str | None = None, environment: Mapping[str, str] | None = None) -> dict:
    config = deepcopy(DEFAULTS)
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        if not isinstance(data, dict):
            raise ValueError(f"{path} does not hold a map")
        config = merged(config, data)
    env = os.environ if environment is None else environment
    for name, (where, read) in ENVIRONMENT.items():
        if name in env:
            *parents, last = where.split(".")
            node = config
            for p in parents:
                node = node.setdefault(p, {})
            node[last] = read(env[name])
    return config
