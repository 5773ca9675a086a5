"""Detection rules: YAML files, and the catalogue that comes with the engine."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    level: str = "informational"
    description: str = ""
    tags: tuple[str, ...] = ()
    logsource: dict = field(default_factory=dict)
    detection: dict = field(default_factory=dict)
    path: str = ""


def parse_rule(data: object, path: str = "") -> Rule | None:
    """A rule from a parsed document; None unless it has a detection with a condition."""
    if not isinstance(data, dict) or not isinstance(data.get("detection"), dict):
        return None
    condition = data["detection"].get("condition")
    if not isinstance(condition, str) or not condition.strip():
        return None
    stem, tags = Path(path).stem, data.get("tags") or []
    return Rule(
        id=str(data.get("id") or stem),
        title=str(data.get("title") or stem),
        level=str(data.get("level") or "informational"),
        description=str(data.get("description") or ""),
        tags=tuple(map(str, [tags] if isinstance(tags, str) else tags)),
        logsource=data.get("logsource") if isinstance(data.get("logsource"), dict) else {},
        detection=data["detection"],
        path=path,
    )


def load_rules(folder: str) -> list[Rule]:
    """The rules under a folder: .yml files by path, then .yaml files by path. Files that hold no rule are passed over."""
    import yaml

    out = []
    for pattern in ("*.yml", "*.yaml"):
        for file in sorted(Path(folder).rglob(pattern)):
            try:
                data = yaml.safe_load(file.read_text(encoding="utf-8"))
            except (yaml.YAMLError, OSError, UnicodeDecodeError):
                continue
            if rule := parse_rule(data, str(file)):
                out.append(rule)
    return out


def _process(**more: object) -> dict:
    return {"event.category": "process", "event.type": "start", **more}


# The shipped rules, in evaluation order.
_SHIPPED = [
    Rule(
        "lab-network-curl-outbound-http", "Curl Outbound HTTP Connection", "medium", "Detecteaza conexiuni HTTP outbound initiate de curl.", ("attack.command_and_control", "attack.t1105"),
        {"product": "linux", "category": "network_connection"},
        {"selection": {"event.category|contains": "network", "network.direction": "outbound", "process.name": "curl", "destination.port": [80, 443]}, "condition": "selection"},
    ),
    Rule(
        "lab-network-outbound-reverse-shell-port", "Outbound Connection To Common Reverse Shell Port", "high",
        "Detecteaza conexiuni outbound catre porturi folosite frecvent in teste de reverse shell.", ("attack.command_and_control", "attack.t1095"),
        {"product": "linux", "category": "network_connection"},
        {
            "selection_network": {"event.category": "network", "event.type": "connection", "event.action": "network_connection_attempt", "network.direction": "outbound"},
            "selection_port": {"destination.port": [4444, 4445, 1337, 31337]},
            "condition": "selection_network and selection_port",
        },
    ),
    Rule(
        "lab-process-curl-wget-external-url", "Curl Or Wget External URL Execution", "medium", "Detectează executia curl/wget cu URL HTTP sau HTTPS in linia de comanda.",
        ("attack.command_and_control", "attack.t1105"), {"product": "linux", "category": "process_creation"},
        {"selection_process": _process(**{"process.name": ["curl", "wget"]}), "selection_url": {"process.command_line|contains": ["http://", "https://"]}, "condition": "selection_process and selection_url"},
    ),
    Rule(
        "lab-process-execution-from-writable-tmp", "Execution From World Writable Temporary Directory", "high", "Detecteaza procese lansate din /tmp, /var/tmp sau /dev/shm.",
        ("attack.defense_evasion", "attack.t1036"), {"product": "linux", "category": "process_creation"},
        {"selection_tmp": _process(**{"process.executable|startswith": ["/tmp/", "/var/tmp/", "/dev/shm/"]}), "condition": "selection_tmp"},
    ),
    Rule(
        "lab-process-suspicious-network-utility", "Suspicious Network Utility Execution", "high",
        "Detecteaza executia unor utilitare frecvent folosite pentru transfer, pivotare sau reverse shell.", ("attack.command_and_control", "attack.t1105"),
        {"product": "linux", "category": "process_creation"}, {"selection_tool": _process(**{"process.name": ["nc", "ncat", "netcat", "socat"]}), "condition": "selection_tool"},
    ),
    Rule(
        "lab-process-sensitive-account-file-read", "Sensitive Linux Account File Read", "medium", "Detecteaza citirea fisierelor locale sensibile de conturi.", ("attack.discovery", "attack.t1087"),
        {"product": "linux", "category": "process_creation"},
        {
            "selection_reader": _process(**{"process.name": ["cat", "grep", "sed", "awk", "head", "tail", "less", "more"]}),
            "selection_target": {"process.command_line|contains": ["/etc/passwd", "/etc/shadow", "/etc/sudoers"]},
            "condition": "selection_reader and selection_target",
        },
    ),
    Rule(
        "lab-process-shell-inline-command", "Shell Inline Command Execution", "low", "Detecteaza executia de comenzi inline prin shell, de forma sh/bash -c.", ("attack.execution", "attack.t1059"),
        {"product": "linux", "category": "process_creation"},
        {"selection_shell": _process(**{"process.name": ["sh", "bash", "dash", "zsh"]}), "selection_inline": {"process.args": ["-c"]}, "condition": "selection_shell and selection_inline"},
    ),
]

CATALOGUE = [replace(r, path=f"catalogue/{r.id}") for r in _SHIPPED]
