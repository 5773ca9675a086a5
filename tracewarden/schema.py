"""Schemas of records and documents. A null field is a missing one."""

from __future__ import annotations

import numpy as np

# The record's layout, little-endian with natural alignment.
RECORD = np.dtype(
    [
        ("timestamp_ns", "<u8"),
        ("event_type", "<u4"),
        ("pid", "<u4"),
        ("ppid", "<u4"),
        ("uid", "<u4"),
        ("auid", "<u4"),
        ("comm", "V16"),
        ("filename", "V256"),
        ("argv", "V128", (6,)),
        ("saddr", "<u4"),
        ("daddr", "<u4"),
        ("sport", "<u2"),
        ("dport", "<u2"),
        ("family", "<u2"),
    ],
    align=True,
)
EXECVE, EXECVEAT, CONNECT, ACCEPT = 1, 2, 3, 4
UINT32_MAX = 0xFFFFFFFF
AF_INET = 2
ECS_VERSION = "8.11.0"
MODULE, DATASET = "edr_ebpf", "edr_ebpf.kernel"

DECODED = (
    "timestamp_ns long, event_type long, pid long, ppid long, uid long, auid long, comm string, filename string, "
    "argv array<string>, saddr long, daddr long, sport int, dport int, family int"
)

DOCUMENT = (
    "`@timestamp` string, ecs struct<version:string>, "
    "event struct<kind:string,module:string,dataset:string,action:string,category:array<string>,type:array<string>>, "
    "host struct<hostname:string>, "
    "process struct<pid:long,parent:struct<pid:long>,name:string,executable:string,command_line:string,args:array<string>,args_count:int>, "
    "user struct<id:string,name:string,audit:struct<id:string,name:string>>, "
    "network struct<direction:string,transport:string,type:string>, "
    "source struct<ip:string,port:int>, destination struct<ip:string,port:int>"
)
