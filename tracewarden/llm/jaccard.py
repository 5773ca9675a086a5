"""Near copies: SimHash links and, for what those can't reach, MinHash candidates; every link verified by Jaccard similarity.

A text's shingles are five words in a row. Texts of the same words are one node. Nodes whose fingerprints
``simhash.near_links`` joins are the first candidates. Each node also has ``BANDS`` keys, each from the least values of ``ROWS`` hash orders of its
shingles; a pair of similarity 0.8 shares no key in three of a million cases. Nodes that share a key are candidates, and a candidate is a link only if the similarity of the whole sets of
shingles is high enough. A bucket's nodes are first compared with the least of them; after that the buckets
whose nodes aren't one component yet are brought together, in parts of bounded size, and each node is compared with all
others through an index of their shingles. Only links of a spanning forest come out. So no link between candidates is
missed, and neither a large group of copies nor one of texts that are just not alike gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._util import cut, hot_limit, join_counted, slices
from .components import components
from .simhash import fingerprint, near_links

BANDS, ROWS = 32, 5
#: A part of a bucket has about this many nodes and shingles at most (one larger text is a part of its own).
BUCKET, SHINGLES = 4000, 1 << 19
_RNG = np.random.default_rng(11)
_FLIP, _TIMES, _MIX = (_RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) for _ in range(3))
_TIMES |= np.uint64(1)
_MIX = _MIX.reshape(BANDS, ROWS) | np.uint64(1)


def node_and_shingles(text: bytes | None, shingle: int) -> tuple[int, np.ndarray]:
    """A hash of the text's words and the hashes of its distinct shingles, sorted. Words are as in ``simhash.fingerprint``; no words give 0 and none."""
    ws = (text or b"").lower().split()
    if not ws:
        return 0, np.zeros(0, np.uint64)
    joined = b" ".join(ws)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(joined)]
    hashes = [xxh64_intdigest(joined[s:e], 42) for s, e in zip(starts, ends[shingle - 1 :], strict=False)] or [xxh64_intdigest(joined, 42)]
    return xxh64_intdigest(joined, 7), np.unique(np.array(hashes, np.uint64))


def keys(shingles: np.ndarray) -> np.ndarray:
    """One for each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, ((shingles[k : k + 2048, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, keep: str | None) -> DataFrame:
    """(doc_id, kept, node, size, keys, fingerprint), a row for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, 1, 2000)):
            nodes, prints, sizes, found = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64), [], []
            for k, t in enumerate(b.column(1)):
                nodes[k], s = node_and_shingles(t.as_py(), shingle)
                prints[k] = fingerprint(t.as_py())
                sizes.append(len(s))
                found.append(keys(s).view(np.int64) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(nodes.view(np.int64)), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64())), pa.array(prints.view(np.int64))], names=["doc_id", "kept", "node", "size", "keys", "fingerprint"])

    kept = F.col(keep) if keep else F.lit(None).cast("string")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), kept.cast("string")).mapInArrow(run, "doc_id long, kept string, node long, size long, keys array<long>, fingerprint long")


def _sets(docs: DataFrame, text_col: str, shingle: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted``."""

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task gives a text once, however many copies it has
        for b in (part for whole in batches for part in slices(whole, 0, 2000)):
            nodes = [xxh64_intdigest(t, 7) if t else 0 for t in (b" ".join((t.as_py() or b"").lower().split()) for t in b.column(0))]
            new = []
            for n in nodes:
                new.append(n not in seen)
                seen.add(n)
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), b.column(0)], names=["node", "text"]).filter(pa.array(new, pa.bool_()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [node_and_shingles(t.as_py(), shingle)[1].view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    texts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(named, "node long, text binary")
    once = texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return once.mapInArrow(run, "node long, shingles array<long>")


def _simhash_pairs(nodes: DataFrame, limit: int) -> DataFrame:
    """(a, b): the least node of each fingerprint with its other nodes, and with the least nodes of fingerprints linked to it."""
    nodes = nodes.where("size > 0").select("node", "fingerprint")
    prints = cut(nodes.groupBy("fingerprint").agg(F.min("node").alias("rep"), F.count("*").alias("n")))
    shared = join_counted(nodes, prints, "fingerprint", limit).where("node != rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    one, two = (prints.select(F.col("fingerprint").alias(c), F.col("rep").alias(f"{c}_rep")) for c in ("a", "b"))
    linked = cut(near_links(prints)).join(one, "a").join(two, "b").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))
    return shared.unionByName(linked)


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                b = batch.slice(k, 256)
                good = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    x, y = x.values.to_numpy(), y.values.to_numpy()
                    both = np.sort(np.concatenate([x, y]))
                    same = int((both[1:] == both[:-1]).sum())
                    good.append(same >= least * (len(both) - same))
                yield pa.RecordBatch.from_arrays(b.columns[:2], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # the pairs of a hub are dealt to as many parts as keep each of them small, and its set goes to each
    pairs = cut(pairs)
    n_pairs = pairs.count()
    limit = hot_limit(n_pairs)
    counts = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / limit).cast("int")), n_pairs)
    dealt = join_counted(pairs, counts, "a", limit).select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    one = sets.withColumnRenamed("node", "a").join(counts, "a").select("a", F.col("shingles").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return dealt.join(one, ["a", "part"]).join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _forest(nodes: list[int], roots: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that join what is similar in one bucket and isn't joined yet: each node against all, through an index of the shingles."""
    parent = {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        return r

    sizes = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    heads = np.r_[0, np.flatnonzero(np.diff(flat[order])) + 1]
    counts = np.diff(np.r_[heads, len(flat)])
    term = np.empty(len(flat), np.int64)
    term[order] = np.repeat(np.arange(len(heads)), counts)
    owners, ends, out = owner[order], np.cumsum(sizes), []
    for x in range(1, len(sets)):
        mine = term[ends[x] - sizes[x] : ends[x]]
        n = counts[mine]
        stop = np.cumsum(n)
        same = np.bincount(owners[np.arange(stop[-1]) + np.repeat(heads[mine] - (stop - n), n)], minlength=len(sets))[:x]
        for y in np.flatnonzero(same >= least * (sizes[:x] + sizes[x] - same)).tolist():
            r, s = find(roots[x]), find(roots[y])
            if r != s:
                parent[r] = s
                out.append((nodes[x], nodes[y]))
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From rows (k, p, q, node, root, shingles), sorted by the first three, to links; never a bucket's pairs."""
    now, nodes, roots, sets = None, [], [], []

    def links() -> pa.RecordBatch:
        found = _forest(nodes, roots, sets, least) if len(nodes) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([f[side] for f in found], pa.int64()) for side in (0, 1)], names=["a", "b"])

    for b in batches:
        keys = list(zip(*(b.column(c).to_pylist() for c in range(3)), strict=True))
        for key, node, root, x in zip(keys, b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
            if key != now:
                yield links()
                now, nodes, roots, sets = key, [], [], []
            nodes.append(node)
            roots.append(root)
            sets.append(x.values.to_numpy().copy())
    yield links()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, keep: str | None = None) -> DataFrame:
    """(doc_id, component_id, root): component_id is the least id reachable over links, the document's own included.

    A link is a Jaccard similarity of at least ``least``; candidates are SimHash links and MinHash buckets. A row for each row of ``docs``; null ids, repeated rows and
    texts without words are treated as in ``simhash.near_duplicates``. ``root`` names the component, whatever its ids
    are; ``keep`` is a column to be kept, as a string.
    """
    each = cut(_sketches(docs, id_col, text_col, shingle, keep))
    nodes = cut(each.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("fingerprint").alias("fingerprint"), F.count("*").alias("n")))
    n_nodes = nodes.count()
    limit = hot_limit(BANDS * n_nodes)
    rows = nodes.select("node", "size", F.explode("keys").alias("k"))
    hubs = rows.groupBy("k").agg(F.min(F.struct("node", "size")).alias("hub"), F.max("node").alias("last"), F.count("*").alias("n")).where("hub.node != last").drop("last")
    live = cut(join_counted(rows, cut(hubs), "k", limit))
    similar = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)
    prints = cut(_simhash_pairs(nodes, hot_limit(n_nodes)))
    wanted = live.select("node").unionByName(prints.select(F.col("a").alias("node"))).unionByName(prints.select(F.col("b").alias("node")))
    sets = cut(_sets(docs, text_col, shingle, wanted.distinct()))
    hubbed = live.where("node != hub.node").where(similar(F.col("size"), F.col("hub.size"))).select(F.col("hub.node").alias("a"), F.col("node").alias("b"))
    first = prints.unionByName(hubbed).distinct()
    links = cut(_verified(first, sets, least))
    roots = components(links)
    label = F.coalesce("root", "node").alias("root")
    rooted = cut(live.join(roots, "node", "left").select("k", "node", "size", label))
    parts = F.ceil(F.greatest(F.col("n") / BUCKET, F.col("total") / SHINGLES)).cast("int").alias("parts")
    mixed = rooted.groupBy("k").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("size").alias("total")).where("lo != hi").select("k", parts, "n")
    left = join_counted(rooted, cut(mixed), "k", limit)
    # a bucket too large for a task is cut into parts, and every two of them meet
    part = left.withColumn("p", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = part.select("k", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "node", "root")
    dealt = blocks.join(sets, "node").select("k", "p", "q", "node", "root", "shingles").repartition("k", "p", "q").sortWithinPartitions("k", "p", "q", "node")
    across = dealt.mapInArrow(lambda batches: _bucket_links(batches, least), "a long, b long").distinct()
    roots = components(cut(links.unionByName(across)))
    rooted = cut(nodes.join(roots, "node", "left").select("node", "id", "n", label), n_nodes)
    groups = cut(rooted.groupBy("root").agg(F.min("id").alias("component_id"), F.count("*").alias("n")), n_nodes)
    labels = cut(join_counted(rooted.withColumnRenamed("n", "copies"), groups, "root", hot_limit(n_nodes)).withColumnRenamed("copies", "n"), n_nodes)
    out = join_counted(each.select("doc_id", "node", "kept"), labels, "node", hot_limit(each.count()))
    return out.select("doc_id", "component_id", "root", *([F.col("kept").alias(keep)] if keep else []))
