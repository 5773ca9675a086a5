"""Language of whole texts by a byte convolutional network, trained in numpy.

A text's UTF-8 bytes are cut into windows of fixed length, the last one padded with zeros. Filters of several widths
slide over a window's bytes, each filter keeps its largest value (max pooling), and a softmax over these values gives
the window's languages. A text's probabilities are the mean of its windows', weighted by their bytes, so that in a text
of several languages the one with most of it wins.

The input to a filter is a byte's one-hot vector, so a filter is a table of 256 values for each of its places. To apply
it, pairs of places are summed into tables over byte pairs, and a window is looked up in them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import slices

WIDTHS = (2, 3, 4)
UNKNOWN = "und"


@dataclass
class ByteNet:
    """``tables[w]``: (w, 256, filters) for each width; ``bias``, ``dense`` and ``out`` follow the pooled values."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    dense: np.ndarray
    out: np.ndarray
    window: int = 256

    def __post_init__(self):
        self._pairs: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Largest value of each filter over the rows of ``x`` (windows of bytes)."""
        if self._pairs is None:
            t, pair = self.tables, lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(65536, -1)
            self._pairs = np.ascontiguousarray(np.concatenate([pair(t[2][0], t[2][1]), pair(t[3][0], t[3][1]), pair(t[4][0], t[4][1]), pair(t[4][2], t[4][3])], axis=1).astype(np.float32))
        n = self.tables[2].shape[2]
        found = np.empty((len(x), 3 * n), np.float32)
        for k in range(0, len(x), 64):
            part = x[k : k + 64]
            two = self._pairs[part[:, :-1].astype(np.int32) * 256 + part[:, 1:]]
            f = found[k : k + 64]
            two[:, :, :n].max(axis=1, out=f[:, :n])
            (two[:, :-1, n : 2 * n] + self.tables[3][2][part[:, 2:]]).max(axis=1, out=f[:, n : 2 * n])
            (two[:, :-2, 2 * n : 3 * n] + two[:, 2:, 3 * n :]).max(axis=1, out=f[:, 2 * n :])
        return found

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.dense + self.out
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, and how many each has (one at least)."""
    counts = np.array([max(1, -(-len(t) // size)) for t in texts], np.int64)
    raw = b"".join(t + bytes(int(n) * size - len(t)) for t, n in zip(texts, counts, strict=True))
    return np.frombuffer(raw, np.uint8).reshape(-1, size), counts


def train(samples: list[tuple[str, bytes]], filters: int = 8, window: int = 256, epochs: int = 12, rate: float = 0.02, seed: int = 7) -> ByteNet:
    """Adam on the cross-entropy of the samples' windows, cut to random lengths so that short texts are learned too."""
    rng = np.random.default_rng(seed)
    languages = sorted({c for c, _ in samples})
    number = {c: k for k, c in enumerate(languages)}
    pieces, labels = [], []
    for c, t in samples:
        for cut in (window, int(rng.integers(16, window))):
            pieces.append(t[:cut])
            labels.append(number[c])
    x, _ = windows(pieces, window)
    y = np.array(labels)
    weight = (1 / np.maximum(np.bincount(y, minlength=len(languages)), 1))[y]
    weight /= weight.mean()
    params = [rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
    params += [rng.normal(0, 0.3, (filters * len(WIDTHS), len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    mean, square, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for k in range(0, len(x), 64):
            b = order[k : k + 64]
            xb = x[b]
            tops, where = [], []
            for w, t in zip(WIDTHS, params, strict=False):
                conv = sum(t[i][xb[:, i : window - w + 1 + i]] for i in range(w))
                where.append(conv.argmax(axis=1))
                tops.append(np.take_along_axis(conv, where[-1][:, None, :], 1)[:, 0])
            h = np.concatenate(tops, axis=1)
            z = h @ params[3] + params[4]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(b)), y[b]] -= 1
            p *= (weight[b] / len(b))[:, None].astype(np.float32)
            back = p @ params[3].T
            grads = []
            for j, w in enumerate(WIDTHS):
                g = np.zeros_like(params[j])
                part = back[:, j * filters : (j + 1) * filters]
                for i in range(w):
                    np.add.at(g[i], (np.take_along_axis(xb, where[j] + i, 1), np.arange(filters)[None, :]), part)
                grads.append(g)
            grads += [h.T @ p, p.sum(axis=0)]
            step += 1
            for q, g, m, s in zip(params, grads, mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return ByteNet(languages, dict(zip(WIDTHS, params[:3], strict=True)), params[3], params[4], window)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int, window: int) -> list[tuple[str, bytes]]:
    """Windows of at most ``max_rows`` labelled documents, as many of each language as there are, chosen by a hash of the id."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang_col)).count().orderBy(F.desc("count"), lang_col).limit(max_rows).collect()}
    if not sizes:
        return []
    share = max_rows / len(sizes)
    odds = F.element_at(F.create_map(*[F.lit(v) for c, n in sizes.items() for v in (c, min(1.0, share / n))]), F.col(lang_col))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30)) / odds
    at = lambda seed: F.substring(text_col, F.lit(1) + F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.greatest(F.lit(1), F.length(text_col) - window)).cast("int"), F.lit(window))
    chosen = labelled.select(F.col(lang_col).alias("lang"), draw.alias("draw"), at(1).alias("a"), at(2).alias("b")).where("draw <= 1.3").orderBy("draw", "a").limit(max_rows)
    return [(r.lang, t.encode()[:window]) for r in chosen.collect() for t in (r.a, r.b) if any(c.isalpha() for c in t)]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 3000, window: int = 256, filters: int = 8) -> ByteNet | None:
    """A network learned from a bounded sample of labelled rows: ``max_rows`` documents, two windows of each. None without labels."""
    samples = training_rows(docs, id_col, text_col, lang_col, max_rows, window)
    return train(samples, filters, window) if samples else None


def predict(net: ByteNet | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The language and its probability for each text."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [k for k, t in enumerate(texts) if t is not None and any(c.isalpha() for c in t)] if net else []
    if known:
        raw = [texts[k].encode("utf-8", "replace") for k in known]
        x, counts = windows(raw, net.window)
        first = np.cumsum(counts) - counts
        used = np.full(len(x), net.window, float)
        used[first + counts - 1] = [len(t) - (int(n) - 1) * net.window for t, n in zip(raw, counts, strict=True)]
        p = np.add.reduceat(np.exp(net.log_probabilities(x)) * used[:, None], first, axis=0)
        p /= p.sum(axis=1, keepdims=True)
        for k, best, score in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
            names[k], scores[k] = net.languages[best], score
    return names, scores


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score), a row for each row of ``docs``; only the text is looked at, all of it.

    A null text, one without a letter, and any text if there is no network are ``und`` with score 0. Repeated rows are
    kept, other columns ignored; an empty table gives an empty result. Equal texts get equal results.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 500):
                names, scores = predict(model.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


#: No text of one language scored less where this was measured (10,000 documents: 0.53 at least); equal parts of several languages do.
#: A text of few bytes may say too little, so it is kept however unsure the network is.
MIN_SCORE, SHORT = 0.4, 400


def keep_identified(docs: DataFrame, net: ByteNet | None, text_col: str = "text", min_score: float = MIN_SCORE, wanted: Sequence[str] | None = None) -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in one language: it has a letter, the network gives its likeliest
    language at least ``min_score`` (a text of less than ``SHORT`` characters any), and that is one of ``wanted`` (None: any).

    Without a network, as where nothing is labelled, every text with a letter stays. Null and empty texts go.
    """
    model, place = docs.sparkSession.sparkContext.broadcast(net), docs.columns.index(text_col)
    wanted = None if wanted is None else frozenset(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, place, 500):
                texts = part.column(place).to_pylist()
                if model.value is None:
                    good = [t is not None and any(map(str.isalpha, t)) for t in texts]
                else:
                    names, scores = predict(model.value, texts)
                    good = [n != UNKNOWN and (s >= min_score or len(t) < SHORT) and (wanted is None or n in wanted) for t, n, s in zip(texts, names, scores, strict=True)]
                yield part.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows that no network here learns from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
