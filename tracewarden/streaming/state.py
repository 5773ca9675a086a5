"""Self filter, deduplication and correlation of one host's events in arrival order.

Plain Python over plain rows: the streaming processor keeps these objects' contents as its state, and tests run them
beside the batch operators. Clocks are seconds; the caller gives the time of each event.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from ..operators.correlate import CORRELATIONS, CorrelationRule, severity_rank
from ..operators.dedup import DUPLICATE, check_parameters


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


@dataclass
class SelfFilter:
    """Drops events of an agent and of all that it starts, as far as is known when they arrive."""

    known: set[int]

    def reason(self, pid: int | None, ppid: int | None) -> str | None:
        if pid in self.known:
            return f"agent self event pid={pid}"
        if ppid in self.known and pid is not None:
            self.known.add(pid)
            return f"agent child event pid={pid} ppid={ppid}"
        return None


@dataclass
class Deduplicator:
    window_seconds: float = 5.0
    mode: str = "mark"
    max_groups: int = 4096
    #: group id: [expires at, count, first seen, ips, ports], oldest expiry first
    groups: dict[str, list] = field(default_factory=dict)

    def __post_init__(self):
        check_parameters(self.window_seconds, self.mode, self.max_groups)

    def expire(self, now: float) -> None:
        # time never runs backwards for a host, so groups stand in the order of their expiry
        while self.groups and next(iter(self.groups.values()))[0] <= now:
            del self.groups[next(iter(self.groups))]

    def add(self, key: str, now: float, timestamp: str | None, ip: str | None, port: int | None) -> dict:
        self.expire(now)
        group = self.groups.pop(key, None)
        duplicate = group is not None
        if group is None:
            group = [0.0, 0, timestamp, [], []]
        group[0], group[1] = now + self.window_seconds, group[1] + 1
        for values, value in ((group[3], ip), (group[4], port)):
            if value and value not in values:
                values.append(value)
        self.groups[key] = group
        if len(self.groups) > self.max_groups:
            del self.groups[next(iter(self.groups))]
        ips = sorted(group[3])
        return {
            "enabled": True, "mode": self.mode, "is_duplicate": duplicate, "group_id": key, "window_seconds": self.window_seconds, "count": group[1],
            "first_seen": group[2], "last_seen": timestamp, "destination_ips": ips or None, "unique_destinations": len(ips) or None, "destination_ports": sorted(group[4]) or None,
            "reason": DUPLICATE if duplicate else None,
        }


@dataclass
class Correlator:
    window_seconds: float = 60.0
    max_per_scope: int = 128
    rules: list[CorrelationRule] = field(default_factory=lambda: list(CORRELATIONS))
    #: scope: observations, oldest first
    scopes: dict[str, list[dict]] = field(default_factory=dict)

    def expire(self, now: float) -> None:
        for scope in [s for s, seen in self.scopes.items() if seen[0]["at"] < now - self.window_seconds]:
            left = [o for o in self.scopes[scope] if o["at"] >= now - self.window_seconds]
            if left:
                self.scopes[scope] = left
            else:
                del self.scopes[scope]

    def add(self, scopes: list[str], seen: dict, host: str | None) -> dict | None:
        """The correlation node of an observation (fields as in operators.correlate, plus at and key), if a rule holds."""
        self.expire(seen["at"])
        found = {o["key"]: o for s in reversed(scopes) for o in reversed(self.scopes.get(s, []))}
        order = sorted((o for k, o in found.items() if k != seen["key"]), key=lambda o: (o["at"], o["seq"]))
        # an earlier observation with the same key stands for this one
        order = sorted([*order, found.get(seen["key"], seen)], key=lambda o: (o["at"], o["seq"]))
        ids = sorted({o["rule_id"] for o in order})
        held = [(severity_rank(r.severity), -k) for k, r in enumerate(self.rules) if set(r.required) <= set(ids)]
        for s in scopes:
            bucket = self.scopes.setdefault(s, [])
            if all(o["key"] != seen["key"] for o in bucket):
                bucket.append(seen)
            del bucket[: -self.max_per_scope]
        if not held:
            return None
        rule = self.rules[-max(held)[1]]
        times = [o["ts"] for o in order if o["ts"]]
        unique = lambda rows: [dict(r) for r in dict.fromkeys(tuple(r.items()) for r in rows)]
        pick = lambda o, names: {n: o[n] for n in names}
        ident = "|".join(str(v) for v in (rule.id, host, seen["pid"], seen["ppid"], seen["command_line"], ",".join(ids)))
        return {
            "matched": True, "engine": "edge_correlator", "correlation_id": _sha(ident), "rule_id": rule.id, "name": rule.name, "severity": rule.severity, "summary": rule.summary,
            "window_seconds": self.window_seconds, "event_count": len(order), "related_rules": ids, "first_seen": min(times, default=None), "last_seen": max(times, default=None),
            "related_processes": unique(pick(o, ("pid", "ppid", "name", "executable", "command_line")) for o in order),
            "related_destinations": unique(pick(o, ("ip", "port")) for o in order if o["ip"] is not None or o["port"] is not None),
        }


class HostState:
    """What is remembered of one host, and what becomes of its next event."""

    def __init__(self, agents: set[int], dedup: Deduplicator | None, correlator: Correlator | None, ignore_duplicates: bool = True, include_destination_ip: bool = False):
        self.self_filter, self.dedup, self.correlator = SelfFilter(set(agents)), dedup, correlator
        self.ignore_duplicates, self.include_destination_ip = ignore_duplicates, include_destination_ip

    def snapshot(self) -> dict:
        return {"known": sorted(self.self_filter.known), "groups": self.dedup.groups if self.dedup else {}, "scopes": self.correlator.scopes if self.correlator else {}}

    def restore(self, saved: dict) -> None:
        self.self_filter.known = set(saved["known"])
        if self.dedup:
            self.dedup.groups = saved["groups"]
        if self.correlator:
            self.correlator.scopes = saved["scopes"]

    def on_event(self, e: dict) -> dict | None:
        """``e``: the flat fields of streaming.pipeline.FIELDS. None if it is dropped, else its (dedup, correlation) nodes."""
        if self.self_filter.reason(e["pid"], e["ppid"]) is not None:
            return None
        if e["drop_reason"] is not None:
            return None
        if self.dedup:
            self.dedup.expire(e["at"])
        if not e["matched"]:
            return {"dedup": None, "correlation": None}
        text = lambda v: "" if v is None else str(v)
        node = None
        if self.dedup:
            parts = [e["host"], e["rule_id"] or "unknown", ",".join(e["category"] or []), ",".join(e["type"] or []), e["pid"], e["executable"], e["command_line"], e["name"], e["port"]]
            parts += [e["ip"]] if self.include_destination_ip else []
            node = self.dedup.add(_sha("|".join(map(text, parts))), e["at"], e["ts"], e["ip"], e["port"])
            if node["is_duplicate"] and self.dedup.mode == "drop":
                return None
        correlation = None
        skipped = self.ignore_duplicates and node is not None and node["is_duplicate"]
        if self.correlator and e["rule_id"] and not skipped:
            names = ("ts", "rule_id", "pid", "ppid", "name", "executable", "command_line", "ip", "port")
            host = e["host"] or "unknown-host"
            scopes = [f"host:{host}:pid:{e['pid']}"] if e["pid"] is not None else []
            scopes += [f"host:{host}:cmd:{_sha(e['command_line'])}"] if e["command_line"] else []
            seen = {n: e[n] for n in names} | {"at": e["at"], "seq": e["seq"], "key": _sha("|".join(str(e[n]) for n in names))}
            correlation = self.correlator.add(scopes, seen, e["host"])
        return {"dedup": node, "correlation": correlation}


HostStateFactory = Callable[[], HostState]
