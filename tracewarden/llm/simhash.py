"""SimHash near-duplicates, linked through deletion-variant signatures.

A document's fingerprint sums up the XXH64 hashes of its word shingles. Two fingerprints link if they differ in at most
``max_bits`` = 4 bits. Cut into three segments, such a pair has a segment that differs in at most one bit. So every
distinct fingerprint is indexed under each segment with each one of its bits taken out (64 variants), equal variants
are brought together, and the whole fingerprints are verified. Only links of a spanning forest leave a bucket, never
all its pairs: a search goes out from a fingerprint and looks only at those not yet reached.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._util import cut, hot_limit, join_counted, row_key, slices, small_side
from .components import components

SEGMENTS = ((0, 22), (22, 43), (43, 64))


def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """Words are runs of bytes other than 0x20 and 0x09 to 0x0D, A-Z lower-cased. Fewer words than a shingle make one; none give 0."""
    words = b" ".join((text or b"").lower().split())
    if not words:
        return 0
    gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(words)]
    if len(starts) <= shingle:
        return xxh64_intdigest(words, 42)
    total, n = np.zeros(64, np.int64), len(starts) - shingle + 1
    for k in range(0, n, 50_000):
        hashes = np.fromiter([xxh64_intdigest(words[s:e], 42) for s, e in zip(starts[k : min(n, k + 50_000)], ends[k + shingle - 1 :], strict=False)], np.uint64)
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint as a signed long), a row for each row of ``docs``. A null text has no words."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1, 2000):
                found = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], names=["doc_id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(compute, "doc_id long, fingerprint long")


def variant_masks() -> list[int]:
    """One for each bit: its segment without that bit, as a signed long."""
    masks = [sum(1 << b for b in range(lo, hi) if b != out) for lo, hi in SEGMENTS for out in range(lo, hi)]
    return np.array(masks, np.uint64).view(np.int64).tolist()


def forest(prints: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the fingerprints of one bucket, under "differ in at most max_bits bits"."""
    left, right, rest = [], [], prints
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                reached = rest[near]
                left.extend([x] * len(reached))
                right.extend(reached)
                front.extend(reached)
                rest = rest[~near]
    return left, right


def bucket_links(prints: np.ndarray, variant: int, max_bits: int, large: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near in one bucket.

    At 100 TB a bucket has thousands of fingerprints that agree in its segment by chance. Two that differ in at most
    max_bits bits agree in one of max_bits + 1 blocks of the other bits too, so a large bucket is searched block by block.
    """
    if len(prints) <= large:
        parts = [forest(prints, max_bits)]
    else:
        lo, hi = next(s for k, s in enumerate(SEGMENTS) if variant < sum(b - a for a, b in SEGMENTS[: k + 1]))
        parts = []
        for block in np.array_split([b for b in range(64) if not lo <= b < hi], max_bits + 1):
            own = prints & np.uint64(sum(1 << int(b) for b in block))
            order = np.argsort(own)
            cuts = np.flatnonzero(np.diff(own[order])) + 1
            parts += [forest(run, max_bits) for run in np.split(prints[order], cuts) if len(run) > 1]
    return tuple(np.array([x for p in parts for x in p[side]], np.uint64) for side in (0, 1))


def _linked(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """From rows (variant, key, fingerprint), sorted, to links. A run of equal (variant, key) may span batches."""
    held: list[np.ndarray] = []

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
        size = np.diff(np.r_[first, len(rows)])
        prints = rows[:, 2].astype(np.int64).view(np.uint64)
        left, right = [], []
        small = np.repeat(np.where(size <= 16, size, 0), size)
        place = np.arange(len(rows)) - np.repeat(first, size)
        for step in range(1, min(16, int(size.max(initial=0)))):  # small runs: all at once, by distance
            i = np.flatnonzero(place + step < small)
            i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= max_bits]
            left.append(prints[i])
            right.append(prints[i + step])
        for f, n in zip(first[size > 16].tolist(), size[size > 16].tolist(), strict=True):
            a, b = bucket_links(prints[f : f + n], int(rows[f, 0]), max_bits)
            left.append(a)
            right.append(b)
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right))
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
        changes = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
        last = int(changes[-1]) if len(changes) else 0
        if held and (len(changes) or (held[-1][-1, :2] != rows[0, :2]).any()):
            yield from links(np.concatenate([*held, rows[:last]]))
            held = [rows[last:]]
        elif held:
            held.append(rows)
        else:
            yield from links(rows[:last])
            held = [rows[last:]]
    if held:
        yield from links(np.concatenate(held))


def near_links(prints: DataFrame, max_bits: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints of column ``fingerprint``, enough to join all that are reachable from each other.

    Buckets hold distinct fingerprints, eight bytes each, so copies of a document never add to one.
    """
    if not 0 <= max_bits < 2 * len(SEGMENTS):
        raise ValueError("three segments with one wildcard find at most 5 differing bits")
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("k")) for v, m in enumerate(variant_masks())])).alias("x")
    rows = prints.select("fingerprint", variants).select("x.v", "x.k", "fingerprint")
    dealt = rows.repartition("v", "k").sortWithinPartitions("v", "k")
    return dealt.mapInArrow(lambda batches: _linked(batches, max_bits), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id): component_id is the least id reachable over links, the document's own included.

    A row for each row of ``docs``. Null and empty texts have fingerprint 0 and link like any other. A null id never is
    a component's id unless nothing else is in it, in which case component_id is null. Repeated rows are kept. Other
    columns are ignored; an empty table gives an empty result.
    """
    each = cut(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut(each.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(near_links(nodes, max_bits))
    rooted = nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    return join_counted(each, _labelled(rooted, "least"), "fingerprint", hot_limit(each.count())).select("doc_id", "fingerprint", "component_id")


def _labelled(rooted: DataFrame, least: str) -> DataFrame:
    """``rooted`` (a row for each node, with its ``root``), and as ``component_id`` the least value in the root's component."""
    rooted = cut(rooted)
    groups = cut(rooted.groupBy("root").agg(F.min(least).alias("component_id"), F.count("*").alias("n")))
    return cut(join_counted(rooted.withColumnRenamed("n", "copies"), groups, "root", hot_limit(rooted.count())).withColumnRenamed("copies", "n"))


#: At most so many row keys, 32 bytes each, are sent to every executor.
BROADCAST_ROWS = 200_000


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies (``jaccard.near_copies``): that with the least id.

    Rows without an id come after all others; among equal ids the least hash of the whole row decides. A row is told by
    its whole content, not by its id, so different documents with one id are not taken for each other, and of rows that
    are equal in everything one stays. Texts stay where they are if the rows that go are few enough to be broadcast,
    which is checked; else they are shuffled once.
    """
    from .jaccard import near_copies  # which needs this module's links

    keyed = docs.withColumn("__row", row_key(docs))
    found = cut(near_copies(keyed, id_col, text_col, keep="__row"))
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__row").alias("row"))).alias("first"))
    kept = first.select(F.col("first.row").alias("__row"), F.lit(True).alias("kept"))
    rows = cut(found.groupBy("__row").agg(F.count("*").alias("n")).join(kept, "__row", "left"))
    out = keyed.join(small_side(rows.where("kept is null").select("__row"), BROADCAST_ROWS), "__row", "left_anti")
    twice = rows.where("kept and n > 1").select("__row")
    if not twice.isEmpty():
        twice = small_side(twice, BROADCAST_ROWS)
        out = out.join(twice, "__row", "left_anti").unionByName(out.join(twice, "__row", "left_semi").dropDuplicates(["__row"]))
    return out.select(docs.columns)
