"""Conversations as prefix trees: turns that conversations share from the start on are emitted once.

Conversations are sorted by their turns, so that the order of rows is a depth-first walk over the tree of all turns. A
task walks its range with the open path as its only memory and writes sequences: the formatted text of each new turn
once, its place, the position its first unit has on its own path, and the intervals of the sequence that it attends to
(its ancestors). A sequence ends when it is full; the next starts with the open path again. Sorting is by range with the
conversation's id last, so however many conversations start alike or are equal, they spread over tasks.

A unit is a code point. A turn is formatted as ``<s>[INST]role[/INST]text</s>``. Inside roles and texts a backslash, ``<``
and ``[`` are written as ``\\\\``, ``\\l`` and ``\\b``, so none of the control strings can occur there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = re.compile(r"<s>\[INST\]([^<\[]*)\[/INST\]([^<\[]*)</s>")
SCHEMA = (
    "sequence_id long, text string, nodes array<struct<parent:int,start:long,end:long,position:long,loss_start:long,loss_end:long>>, "
    "attention array<array<struct<start:long,end:long>>>, conversations array<struct<conv_id:long,node:int>>"
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([("parent", pa.int32()), *((n, pa.int64()) for n in ("start", "end", "position", "loss_start", "loss_end"))])
_SEQUENCE = pa.schema([("sequence_id", pa.int64()), ("text", pa.string()), ("nodes", pa.list_(_NODE)), ("attention", pa.list_(pa.list_(_SPAN))), ("conversations", pa.list_(pa.struct([("conv_id", pa.int64()), ("node", pa.int32())])))])
_TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"l": "<", "b": "["}.get(m[1], m[1]), text, flags=re.S) if "\\" in text else text


class TreeWriter:
    """Sequences of the tree of conversations that come in sorted order."""

    def __init__(self, base: int, max_units: int, max_conversations: int, learned: frozenset[str]):
        self.base, self.max_units, self.max_conversations, self.learned = base, max_units, max_conversations, learned
        self.written = 0
        self._start()

    def _start(self) -> None:
        self.parts, self.size, self.nodes, self.attention, self.conversations = [], 0, [], [], []
        self.path: list[tuple[tuple[str, str], int]] = []  # open turns and their nodes

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> Iterator[dict]:
        shared = 0
        while shared < min(len(turns), len(self.path)) and self.path[shared][0] == turns[shared]:
            shared += 1
        formatted = [(f"<s>[INST]{escape(role)}[/INST]", escape(text)) for role, text in turns[shared:]]
        more = sum(len(a) + len(b) + 4 for a, b in formatted)
        if self.conversations and (self.size + more > self.max_units or len(self.conversations) >= self.max_conversations):
            yield from self.finish()
            yield from self.add(conv_id, turns)
            return
        del self.path[shared:]
        for turn, (head, text) in zip(turns[shared:], formatted, strict=True):
            parent = self.path[-1][1] if self.path else -1
            start = self.size
            end = start + len(head) + len(text) + 4
            seen: list[dict] = []
            position = 0
            if parent >= 0:
                above = self.nodes[parent]
                position = above["position"] + above["end"] - above["start"]
                seen = [dict(s) for s in self.attention[parent]]
                if seen and seen[-1]["end"] == above["start"]:
                    seen[-1]["end"] = above["end"]
                else:
                    seen.append({"start": above["start"], "end": above["end"]})
            inner = start + len(head)
            loss_end = inner + len(text) if turn[0] in self.learned else inner
            self.nodes.append({"parent": parent, "start": start, "end": end, "position": position, "loss_start": inner, "loss_end": loss_end})
            self.attention.append(seen)
            self.parts.append(f"{head}{text}</s>")
            self.size = end
            self.path.append((turn, len(self.nodes) - 1))
        self.conversations.append({"conv_id": conv_id, "node": self.path[-1][1]})

    def finish(self) -> Iterator[dict]:
        if self.conversations:
            yield {"sequence_id": self.base + self.written, "text": "".join(self.parts), "nodes": self.nodes, "attention": self.attention, "conversations": self.conversations}
            self.written += 1
        self._start()


def format_tree(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_units: int = 16_384, max_conversations: int = 1024, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Packed tree sequences, columns as in SCHEMA.

    A node is a turn: its parent (-1: none), its half-open interval in the sequence, the position id of its first unit
    (the units before it on its path), and the interval under the loss mask (empty unless its role is in ``learned``).
    ``attention`` has each node's ancestors' intervals, neighbours joined. A sequence has at most ``max_units`` units,
    unless one conversation alone has more, and at most ``max_conversations`` conversations.

    Null roles and texts are empty. Rows of a conversation go by turn, then role, then text; repeated rows are turns of
    their own; rows with a null id are one conversation without id. Other columns are ignored; an empty table gives none.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct(F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    whole = conversations.groupBy(F.col(conv_col).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    keyed = whole.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t["role"], t["text"])))
    order = ["path", "conv_id"]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = TreeWriter(TaskContext.get().partitionId() << 36, max_units, max_conversations, frozenset(learned))
        for b in batches:
            rows = []
            for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows.extend(writer.add(conv_id, [(t["role"], t["text"]) for t in turns]))
                if len(rows) >= 64:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SEQUENCE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SEQUENCE)
        if rows := list(writer.finish()):
            yield pa.RecordBatch.from_pylist(rows, schema=_SEQUENCE)

    return ranged.mapInArrow(run, SCHEMA)


def read_tree(sequences: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): each conversation read back from what its last node attends to and the node itself.

    ``loss_text`` is all text under the loss mask, unescaped; ``formatted`` the conversation's own formatted text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("turns", _TURNS), ("loss_text", pa.string()), ("formatted", pa.string())])
        for b in batches:
            for row in b.to_pylist():
                out = []
                for c in row["conversations"]:
                    node, spans = row["nodes"][c["node"]], row["attention"][c["node"]]
                    formatted = "".join(row["text"][s["start"] : s["end"]] for s in [*spans, node])
                    loss, k = [], c["node"]
                    while k >= 0:
                        n = row["nodes"][k]
                        loss.append(unescape(row["text"][n["loss_start"] : n["loss_end"]]))
                        k = n["parent"]
                    turns = [{"role": unescape(m[1]), "text": unescape(m[2])} for m in TURN.finditer(formatted)]
                    out.append({"conv_id": c["conv_id"], "turns": turns, "loss_text": "".join(reversed(loss)), "formatted": formatted})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return sequences.mapInArrow(run, "conv_id long, turns array<struct<role:string,text:string>>, loss_text string, formatted string")
