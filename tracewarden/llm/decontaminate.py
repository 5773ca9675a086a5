"""Benchmark passages in training documents, found with a distributed positional inverted index.

``build_index`` stores the postings of every token of the documents. The index is partitioned by document: each segment
of documents has a row for each of its terms with the term's sorted positions, and one that says which documents they
are, so no term's postings, however frequent it is, ever gather in one place. A benchmark item is cut into windows of
consecutive words. Its terms' postings are read from the stored index, which also tells how rare each term is in the
whole corpus, and brought together by segment. There, a window starts from the postings of its rarest term, moved back
by the term's offset, and intersects them with the postings of its other terms, rarer ones first; what is left are the
exact phrase matches. Proximity matches start from postings of a window's rarest terms as well, and count how many of
its terms lie near.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import BATCH_BYTES, cut, settings, shared_folder, slices, small_side

#: Lower-cases A-Z; every other byte below 0x80 but digits and letters parts words.
_FOLD = bytes((c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>"
#: A row for each term of a segment, with its positions there as 32-bit integers, and one with an empty term for its documents.
INDEX = "segment long, term binary, n int, places binary, docs array<struct<doc_id:long,n_words:int,kept:string>>"
_DOCS = pa.list_(pa.struct([("doc_id", pa.int64()), ("n_words", pa.int32()), ("kept", pa.string())]))
_FOUND = "segment long, doc long, kept string, " + SCHEMA
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _SPANS, pa.list_(pa.string()), pa.list_(pa.string())]


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class PhraseSet:
    """The windows of benchmark items, by length, over a dictionary of terms. Items without an id have windows, but own none."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = 10):
        self.terms: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[int]] = {}
        self.items = sorted({i for i, _ in items if i is not None})
        number = {i: k for k, i in enumerate(self.items)}
        for item, text in items:
            ids = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            size = min(window, len(ids))
            for k in range(len(ids) - size + 1 if size else 0):
                own = owners.setdefault(tuple(ids[k : k + size]), set())
                if item is not None:
                    own.add(number[item])
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for w in owners:
            by_size.setdefault(len(w), []).append(w)
        self.windows = []  # of each length: term ids, then the owners as counts, starts and a flat list
        for _, ws in sorted(by_size.items()):
            counts = np.array([len(owners[w]) for w in ws])
            self.windows.append((np.array(ws, np.int32), counts, np.cumsum(counts) - counts, np.array([o for w in ws for o in sorted(owners[w])], np.int64)))
        self.ranked(np.zeros(len(self.terms), np.int64))

    def ranked(self, occurrences: np.ndarray) -> PhraseSet:
        """With each window's places in order of how rare their terms are."""
        self.rare = [np.argsort(occurrences[g[0]], axis=1, kind="stable") for g in self.windows]
        return self


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1] and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def segment_postings(texts: list[bytes | None]) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Words of each text, the distinct terms, how often each occurs, and their positions, term after term. A gap of one parts texts."""
    split = [words(t) for t in texts]
    sizes = np.array([len(ws) for ws in split], np.int64)
    flat = [w for ws in split for w in ws]
    terms = list(set(flat))
    number = dict(zip(terms, range(len(terms)), strict=True))
    ids = np.fromiter(map(number.__getitem__, flat), np.uint16 if len(terms) < 1 << 16 else np.int64, len(flat))  # 16 bits sort by radix
    places = np.arange(len(flat)) + np.repeat(np.arange(len(texts)), sizes)
    return sizes, terms, np.bincount(ids, minlength=len(terms)), places[np.argsort(ids, kind="stable")]


class Segment:
    """The postings of the benchmark's terms in some documents: ``places`` of term after term, and the term at each position (-1: none)."""

    def __init__(self, sizes: np.ndarray, found: list[tuple[int, np.ndarray]], n_terms: int):
        found = sorted(found, key=lambda f: f[0])
        self.sizes = sizes
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.counts = np.zeros(n_terms, np.int64)
        for term, p in found:
            self.counts[term] = len(p)
        self.places = np.concatenate([p for _, p in found]).astype(np.int64) if found else np.zeros(0, np.int64)
        self.heads = np.cumsum(self.counts) - self.counts
        self.ids = np.full(int(sizes.sum()) + len(sizes), -1, np.int32)
        self.ids[self.places] = np.repeat(np.arange(n_terms), self.counts)

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1

    def exact(self, windows: np.ndarray, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, start) of each occurrence."""
        size = windows.shape[1]
        w = np.flatnonzero(self.counts[windows].min(axis=1) > 0)
        first = rare[w, 0]
        term = windows[w, first]
        n = self.counts[term]
        start = self.places[ragged(self.heads[term], n)] - np.repeat(first, n)
        w = np.repeat(w, n)
        keep = (start >= 0) & (start + size <= len(self.ids))
        w, start = w[keep], start[keep]
        for r in range(1, size):
            offset = rare[w, r]
            keep = self.ids[start + offset] == windows[w, offset]
            w, start = w[keep], start[keep]
        return w, start

    def near(self, windows: np.ndarray, rare: np.ndarray, terms: int, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, document) where at least ``terms`` of the window's words occur within ``slop`` words more than its length.

        At most len - terms words are missing, so one of the len - terms + 1 rarest is there to start from. What lies
        within reach of it is a first sieve; then every span around it is tried.
        """
        size = windows.shape[1]
        span = size + slop
        found_w, found_d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(size - terms + 1):
            term = windows[np.arange(len(windows)), rare[:, r]]
            n = self.counts[term]
            places, ws = self.places[ragged(self.heads[term], n)], np.repeat(np.arange(len(windows)), n)
            for k in range(0, len(ws), 50_000):
                w, p = ws[k : k + 50_000], places[k : k + 50_000]
                doc = self.doc_of(p)
                lo, hi = self.starts[doc], self.starts[doc] + self.sizes[doc]
                around = (p - span + 1)[:, None] + np.arange(2 * span - 1)
                seen = np.where((around >= lo[:, None]) & (around < hi[:, None]), self.ids[np.clip(around, 0, len(self.ids) - 1)], -1)
                hits = np.zeros(len(w), np.int64)
                for c in range(size):
                    hits += (seen == windows[w, c][:, None]).any(axis=1)
                left = np.flatnonzero(hits >= terms)
                most = np.zeros((len(left), span), np.int64)
                for c in range(size):
                    until = np.cumsum(np.pad(seen[left] == windows[w[left], c][:, None], ((0, 0), (1, 0))), axis=1)
                    most += until[:, span:] > until[:, :span]
                left = left[most.max(axis=1, initial=0) >= terms]
                found_w.append(w[left])
                found_d.append(doc[left])
        return np.concatenate(found_w), np.concatenate(found_d)


def search(seg: Segment, phrases: PhraseSet, near_terms: int | None, slop: int) -> tuple[list, list, list]:
    """Of each text: merged spans of words in exact matches, items matched exactly, items only near."""
    cover = np.zeros(len(seg.ids) + 1, np.int64)
    pairs: list[np.ndarray] = []
    near: list[np.ndarray] = []
    n_items = max(1, len(phrases.items))

    def owned(windows_of: tuple, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
        _, counts, starts, owners = windows_of
        return np.unique(np.repeat(doc, counts[w]) * n_items + owners[ragged(starts[w], counts[w])])

    for group, rare in zip(phrases.windows, phrases.rare, strict=True):
        w, start = seg.exact(group[0], rare)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + group[0].shape[1], -1)
        pairs.append(owned(group, w, seg.doc_of(start)))
        size = group[0].shape[1]
        if near_terms is not None and size > near_terms:
            w, doc = seg.near(group[0], rare, near_terms, slop)
            near.append(owned(group, w, doc))
    hit = np.r_[False, np.cumsum(cover[:-1]) > 0, False].astype(np.int8)
    begin, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    spans: list[list] = [[] for _ in seg.sizes]
    for d, s, e in zip(seg.doc_of(begin).tolist(), begin.tolist(), end.tolist(), strict=True):
        spans[d].append({"start": s - int(seg.starts[d]), "end": e - int(seg.starts[d])})
    exact = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, int)
    only_near = np.setdiff1d(np.concatenate(near), exact) if near else np.zeros(0, int)
    items: list[list] = [[] for _ in seg.sizes]
    others: list[list] = [[] for _ in seg.sizes]
    for out, found in ((items, exact), (others, only_near)):
        for x in found.tolist():
            out[x // n_items].append(phrases.items[x % n_items])
    return spans, items, others


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None, rows: int = 2000) -> DataFrame:
    """The positional index of all tokens of ``docs``, columns as in INDEX; ``keep`` is a string to be kept for each document.

    A segment has at most ``rows`` documents and about 4 MB of text; a longer text is a segment of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in slices(b, 1, rows):
                sizes, terms, counts, places = segment_postings(part.column(1).to_pylist())
                n = len(terms)
                ends = np.r_[0, np.cumsum(counts)].astype(np.int64) * 4
                stored = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(places.astype("<i4").tobytes())]).cast(pa.binary())
                documents = [dict(zip(("doc_id", "n_words", "kept"), d, strict=True)) for d in zip(part.column(0).to_pylist(), sizes.tolist(), part.column(2).to_pylist(), strict=True)]
                for columns in ([[b""], [0], [b""], [documents]], [terms, counts.astype(np.int32), stored, [None] * n]):
                    here = [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()) if isinstance(columns[2], list) else columns[2], pa.array(columns[3], _DOCS)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here[0]), segment)), *here], names=["segment", "term", "n", "places", "docs"])
                segment += 1

    kept = F.lit(None) if keep is None else keep
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary"), kept.cast("string")).mapInArrow(run, INDEX)


def store_index(index: DataFrame, path: str | None = None) -> DataFrame:
    """``index`` written as Parquet, in the shared folder if no path is given, and read back."""
    spark = index.sparkSession
    path = path or f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    with settings(spark, BATCH_BYTES):
        index.write.option("compression", "zstd").parquet(path)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def _blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, int]:
    """(item, text) and the number of blocks they are dealt to, so that a block has about half of ``block_bytes``."""
    small = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    n_bytes, n_items = small.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)), F.count("*")).first()
    return small, (min(n_items, -(-2 * n_bytes // block_bytes)) if n_bytes > block_bytes else 1)


def _search_block(index: DataFrame, items: list[tuple[str | None, bytes | None]], window: int, near_terms: int | None, slop: int, all_docs: bool) -> DataFrame:
    """Rows as in _FOUND, of all documents or of those with a match."""
    spark = index.sparkSession
    phrases = PhraseSet(items, window)
    terms = F.broadcast(spark.createDataFrame([(bytearray(t),) for t in [b"", *phrases.terms]], "term binary"))
    wanted = index.join(terms, "term", "left_semi")
    occurrences = np.zeros(len(phrases.terms), np.int64)
    for r in wanted.where("n > 0").groupBy("term").agg(F.sum("n").alias("n")).collect():
        occurrences[phrases.terms[bytes(r.term)]] = r.n
    held = spark.sparkContext.broadcast(phrases.ranked(occurrences))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value

        def searched(segment: int, documents: list[dict], found: list) -> pa.RecordBatch:
            seg = Segment(np.array([d["n_words"] for d in documents], np.int64), found, len(phrases.terms))
            spans, exact, near = search(seg, phrases, near_terms, slop)
            at = range(len(documents)) if all_docs else [k for k in range(len(documents)) if spans[k] or near[k]]
            columns = [[segment] * len(at), at, *([documents[k][c] for k in at] for c in ("kept", "doc_id", "n_words")), *([x[k] for k in at] for x in (spans, exact, near))]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=[c.split()[0] for c in _FOUND.split(", ")])

        now, documents, found = None, [], []
        for b in batches:
            for segment, term, places, docs in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if docs is not None:  # the empty term comes first
                    if now is not None:
                        yield searched(now, documents, found)
                    now, documents, found = segment, docs, []
                else:
                    found.append((phrases.terms[term], np.frombuffer(places, "<i4")))
        if now is not None:
            yield searched(now, documents, found)

    dealt = wanted.select("segment", "term", "places", "docs").repartition("segment").sortWithinPartitions("segment", "term")
    return dealt.mapInArrow(run, _FOUND)


def search_index(index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = 10, near_terms: int | None = 9, slop: int = 6, block_bytes: int = 4 << 20, all_docs: bool = True) -> DataFrame:
    """Matches of the items in a stored index, columns ``kept`` and those of SCHEMA, a row for each document (or, not
    ``all_docs``, for each with a match).

    Any items can be sought, whatever the index was built for: it has all terms. They go to the tasks in blocks of at
    most ``block_bytes`` of text (one longer item is its own block), one block after another, so what a task holds has a
    bound however many items there are; a document's results of several blocks are merged by its place in the index.
    """
    small, n_blocks = _blocks(items, item_col, item_text_col, block_bytes)
    if n_blocks == 1:
        return _search_block(index, [(r.item, r.text) for r in small.collect()], window, near_terms, slop, all_docs).drop("segment", "doc")
    whole = None
    for k in range(n_blocks):
        block = [(r.item, r.text) for r in small.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k).collect()]
        found = _search_block(index, block, window, near_terms, slop, False)
        whole = found if whole is None else whole.unionByName(found)
    listed = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    merged = whole.groupBy("segment", "doc").agg(F.flatten(F.collect_list("spans")).alias("s"), listed("items"), listed("near_items"))
    joined = F.aggregate(
        F.array_sort("s"),
        F.array().cast("array<struct<start:long,end:long>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    hits = merged.select("segment", "doc", joined.alias("spans"), "items", F.array_except("near_items", "items").alias("near_items"))
    base = index.where("docs is not null").select("segment", F.posexplode("docs").alias("doc", "d")).select("segment", F.col("doc").cast("long").alias("doc"), "d.kept", "d.doc_id", F.col("d.n_words").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = base.join(hits, ["segment", "doc"], "left" if all_docs else "inner")
    empty = F.array().cast("array<struct<start:long,end:long>>")
    return out.select("kept", "doc_id", "n_words", F.coalesce("spans", empty).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def find_phrases(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, near_terms: int | None = 9, slop: int = 6, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each row of ``docs``, columns as in SCHEMA, by an index that is stored in the shared folder.

    ``spans`` are the merged word ranges inside exact occurrences of any window; ``items`` the sorted ids (as strings)
    of the items with such windows; ``near_items`` those others of which at least ``near_terms`` words of a window lie, in
    any order, within ``slop`` words more than its length (None, or not less than its length: not sought). An item shorter
    than ``window`` is one window, without proximity if it has no more than ``near_terms`` words; of one without words, or
    null, there is none. An item without an id marks spans and adds no id. Null documents have no words. Rows with the same item id
    are one item. Repeated documents are kept, other columns ignored; an empty table on either side gives no match.
    """
    return search_index(store_index(build_index(docs, id_col, text_col)), items, item_col, item_text_col, window, near_terms, slop, block_bytes).drop("kept")


def word_count(spans: str = "spans"):
    """Words inside the spans."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without an exact occurrence of any window of any item.

    Whether a row goes depends on its text alone, so texts that go are told by 128 bits of a hash. Those are broadcast if
    they are found to be few. Null and empty texts, repeated rows and rows with clashing ids are kept as they are.
    """
    key = F.concat(F.hex(F.xxhash64(F.lit(1), F.col(text_col))), F.lit("-"), F.hex(F.xxhash64(F.lit(2), F.col(text_col))))
    index = store_index(build_index(docs.where(F.col(text_col).isNotNull()).select(F.lit(None).cast("long").alias("__id"), text_col), "__id", text_col, key))
    found = search_index(index, items, item_col, item_text_col, window, None, 0, block_bytes, all_docs=False)
    gone = cut(found.where(F.size("spans") > 0).select(F.col("kept").alias("__text")).distinct())
    return docs.withColumn("__text", key).join(small_side(gone, 500_000), "__text", "left_anti").select(docs.columns)
