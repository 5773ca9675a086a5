"""Documents scored by masked pseudo-likelihood: each word predicted from the words on both sides of it.

The vocabulary is every word of the corpus. The most frequent ones are classes of their own; any other word belongs to
one of a number of classes by its ending. The network embeds the two words before and the two after a place, each side
and distance in its own table, adds them up, and predicts the class in between with a softmax; a word's share of its
class comes from its count in the whole corpus, discounted in favour of unseen words, which are spelled byte by byte. So
log P(word | both sides) = log P(class | both sides) + log P(word | class), and a document's score is their sum. In the
corpus that was counted, a document's own occurrences of a rare word don't count for it.

The network is trained in numpy on every place of the corpus in synchronous rounds: documents are dealt by a hash of
what they are to a number of learners that grows with the corpus, in each round every learner starts from the same
network, takes a share of its documents, and the learners' networks are averaged, weighted by their places, in two
levels of sums. So the result doesn't depend on how the rows are stored, and only one network of fixed size reaches the
driver. The frequent words go to every task (``words``, a bound); counts of all others stay in a table and are joined.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ._util import cut, slices
from .decontaminate import words

OFFSETS = (-2, -1, 1, 2)
REACH = 2
PAD, ENDINGS, CHUNK, DISCOUNT = 0, 62, 1024, 0.75
SCHEMA = "doc_id long, n_tokens long, log_prob double, mean_log_prob double"
NUMBERED = "row long, doc_id long, n_tokens long, ids binary, inner double, rare array<struct<h:long,n:int,ending:int,floor:double>>"
_RARE = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("ending", pa.int32()), ("floor", pa.float64())]))


def ending(word: bytes) -> int:
    """The class of a word that is no class of its own."""
    return 1 + zlib.crc32(word[-3:]) % ENDINGS


class Vocabulary:
    """Classes of words and each word's share of its class.

    ``top``: (word, count), most frequent first. ``totals``: class by ending to (occurrences, distinct words) without the
    first ``own_class`` words of ``top``. ``spelling``: log-probability of each byte and, last, of a word's end.
    """

    def __init__(self, top: list[tuple[bytes, int]], own_class: int, totals: dict[int, tuple[int, int]], spelling: np.ndarray):
        self.args = (top, own_class, totals, spelling)
        own = [w for w, _ in top[:own_class]]
        self.size = 1 + ENDINGS + len(own)
        self.spelling = spelling
        self.number = {w: k for k, (w, _) in enumerate(top)}
        self.totals = np.ones(1 + ENDINGS)
        self.kinds = np.ones(1 + ENDINGS)
        for c, (n, kinds) in totals.items():
            self.totals[c], self.kinds[c] = max(n, 1), max(kinds, 1)
        rest = [w for w, _ in top[own_class:]]
        by_ending = np.array([ending(w) for w in rest], np.int64)
        counts = np.array([n for _, n in top[own_class:]], float)
        seen = (np.maximum(counts - DISCOUNT, 0) + np.exp(self.floors(rest, by_ending))) / self.totals[by_ending]
        # the last row is for words that aren't in ``top``
        self.classes = np.r_[1 + ENDINGS + np.arange(len(own)), by_ending, 0].astype(np.uint8)
        self.shares = np.r_[np.zeros(len(own)), np.log(seen), 0.0]
        self.frequency = np.ones(self.size)
        for c, (n, _) in totals.items():
            self.frequency[c] += n
        self.frequency[1 + ENDINGS :] += [n for _, n in top[:own_class]]

    def __reduce__(self):
        return Vocabulary, self.args

    def floors(self, ws: list[bytes], endings: np.ndarray) -> np.ndarray:
        """log of what the discount leaves to a word however often it occurs, in occurrences."""
        if not ws:
            return np.zeros(0)
        sizes = np.array([len(w) for w in ws])
        letters = self.spelling[np.frombuffer(b"".join(ws), np.uint8)]
        spelled = np.add.reduceat(letters, np.cumsum(sizes) - sizes) + self.spelling[256]
        return spelled + np.log(DISCOUNT * self.kinds[endings])


@dataclass
class WindowNet:
    context: np.ndarray  # (V, 4 H): a word's vectors by where it stands
    hidden: np.ndarray  # (H,)
    out: np.ndarray  # (H, V)
    bias: np.ndarray  # (V,)

    @classmethod
    def fresh(cls, size: int, width: int, frequency: np.ndarray, seed: int) -> WindowNet:
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(normal(size, len(OFFSETS) * width), np.zeros(width, np.float32), normal(width, size), np.log(frequency).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.params()])

    def params(self) -> list[np.ndarray]:
        return [self.context, self.hidden, self.out, self.bias]

    def filled(self, flat: np.ndarray) -> WindowNet:
        parts, at = [], 0
        for p in self.params():
            parts.append(np.ascontiguousarray(flat[at : at + p.size].reshape(p.shape), p.dtype))
            at += p.size
        return WindowNet(*parts)

    def inner(self, ids: np.ndarray) -> np.ndarray:
        """The hidden layer at every place of ``ids``."""
        width = len(self.hidden)
        e = np.take(self.context, ids, axis=0)
        h = np.empty((len(ids), width), self.context.dtype)
        h[:] = self.hidden
        for k, o in enumerate(OFFSETS):
            part = e[:, k * width : (k + 1) * width]
            if o < 0:
                h[-o:] += part[:o]
            else:
                h[:-o] += part[o:]
        return np.tanh(h, out=h)

    def logits(self, h: np.ndarray) -> np.ndarray:
        """Of the classes, for hidden layers ``h``; shifted by each row's greatest only if they might be too large for exp."""
        z = h @ self.out
        z += self.bias
        if np.abs(self.out).sum(axis=0).max() + np.abs(self.bias).max() > 30:  # |h| is at most 1
            z -= z.max(axis=1, keepdims=True)
        return z

    def log_prob(self, ids: np.ndarray) -> np.ndarray:
        """Of the class at each place of ``ids``, given those around it; 0 at pads."""
        out = np.zeros(len(ids))
        for a in range(0, len(ids), 4096):
            part, places = _around(ids, a, a + 4096)
            z = self.logits(self.inner(part)[places])
            own = z[np.arange(len(places)), part[places]]
            out[max(0, a - REACH) + places] = own - np.log(np.exp(z, out=z).sum(axis=1))
        return out


def _around(ids: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What a network sees for the places from ``start`` to ``end``, and where in it those that are words lie."""
    begin = max(0, start - REACH)
    part = ids[begin : end + REACH]
    places = np.flatnonzero(part[: end - begin])
    return part, places[places >= start - begin]


class Trainer:
    """Adam over runs of places, with a falling rate."""

    def __init__(self, net: WindowNet, rate: float = 0.02, half: int = 200):
        self.net, self.rate, self.half, self.steps, self.places = net, rate, half, 0, 0
        self.mean = [np.zeros_like(p) for p in net.params()]
        self.square = [np.zeros_like(p) for p in net.params()]

    def step(self, ids: np.ndarray, places: np.ndarray) -> None:
        net, n, width = self.net, len(places), len(self.net.hidden)
        if not n:
            return
        h = net.inner(ids)[places]
        p = net.logits(h)
        np.exp(p, out=p)
        p *= 1 / (n * p.sum(axis=1, keepdims=True))
        p[np.arange(n), ids[places]] -= 1 / n
        back = np.zeros((len(ids), width), h.dtype)
        back[places] = (p @ net.out.T) * (1 - h * h)
        moved = np.zeros((len(ids), len(OFFSETS) * width), h.dtype)  # by the word that was looked at
        for k, o in enumerate(OFFSETS):
            part = moved[:, k * width : (k + 1) * width]
            if o < 0:
                part[:o] = back[-o:]
            else:
                part[o:] = back[:-o]
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=ids[order[:1]] ^ 1))
        context = np.zeros_like(net.context)
        context[ids[order[first]]] = np.add.reduceat(moved[order], first, axis=0)
        self.steps += 1
        self.places += n
        rate = self.rate / (1 + self.steps / self.half)
        for q, g, m, s in zip(net.params(), [context, back.sum(axis=0), h.T @ p, p.sum(axis=0)], self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            q -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(s / (1 - 0.99**self.steps)) + 1e-6)


@dataclass
class LanguageModel:
    """``counts``: (h, word, n) of all words of the corpus, h a hash of the word; stored, not held."""

    vocabulary: Vocabulary
    net: WindowNet
    counts: DataFrame
    tokens: int = field(default=0)


def padded(documents: list[bytes]) -> np.ndarray:
    """The class numbers of documents with two pads around each."""
    gap = bytes(REACH)
    return np.frombuffer(gap + gap.join(documents) + gap, np.uint8)


def word_counts(texts: DataFrame, held: int = 300_000) -> DataFrame:
    """(h, word, n) over all rows of the single binary column; tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                counts.update(words(t.as_py()))
                if len(counts) > held:
                    yield batch(counts)
                    counts = Counter()
        if counts:
            yield batch(counts)

    found = texts.mapInArrow(run, "word binary, n long").select(F.xxhash64("word").alias("h"), "word", "n")
    return found.groupBy("h").agg(F.min("word").alias("word"), F.sum("n").alias("n"))


def _spelling(counts: DataFrame) -> np.ndarray:
    """log-probability of each byte and of a word's end, over the distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(257, np.int64)
        for b in batches:
            ws = b.column(0).to_pylist()
            seen[:256] += np.bincount(np.frombuffer(b"".join(ws), np.uint8), minlength=256)
            seen[256] += len(ws)
        yield pa.RecordBatch.from_arrays([pa.array(range(257), pa.int32()), pa.array(seen)], names=["byte", "n"])

    total = np.ones(257)
    for r in counts.select("word").mapInArrow(run, "byte int, n long").groupBy("byte").agg(F.sum("n").alias("n")).collect():
        total[r.byte] += r.n
    return np.log(total / total.sum())


def _vocabulary(counts: DataFrame, frequent: int, words_held: int) -> tuple[Vocabulary, int]:
    """The vocabulary of a table of counts, and the number of words in the corpus."""
    if not 0 <= frequent <= 255 - ENDINGS:
        raise ValueError("at most 193 words can be classes of their own")
    # all words that occur often enough, so that no more than ``words_held`` ever leave the tasks
    size = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    enough, held = None, 0
    for r in sorted(counts.groupBy(size.alias("size")).count().collect(), key=lambda r: -r["size"]):
        held += r["count"]
        if held > words_held:
            break
        enough = r["size"]
    often = [] if enough is None else counts.where(F.col("n") >= enough).select("word", "n").collect()
    if len(often) < frequent:
        often = counts.orderBy(F.desc("n"), "word").limit(frequent).select("word", "n").collect()
    top = sorted(((bytes(r.word), r.n) for r in often), key=lambda w: (-w[1], w[0]))
    by_ending = F.crc32(F.substring("word", -3, 3)) % ENDINGS + 1
    totals = {r.c: [r.n, r.kinds] for r in counts.groupBy(by_ending.cast("int").alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect()}
    tokens = sum(n for n, _ in totals.values())
    for w, n in top[:frequent]:
        totals[ending(w)][0] -= n
        totals[ending(w)][1] -= 1
    return Vocabulary(top, frequent, {c: (n, kinds) for c, (n, kinds) in totals.items()}, _spelling(counts)), tokens


def number(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns as in NUMBERED, a row for each row of ``docs``: classes of its words, the shares that frequent words have
    of their classes, summed, and its other words, each once with how often it occurs. Stored, so that ``row`` is fixed."""
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        get, none = v.number.get, len(v.number)
        for b in batches:
            for part in slices(b, 1, 500):
                split = [words(t) for t in part.column(1).to_pylist()]
                sizes = np.array([len(ws) for ws in split], np.int64)
                flat = [w for ws in split for w in ws]
                at = np.fromiter(map(get, flat, repeat(none)), np.int64, len(flat))
                classes, doc = v.classes[at], np.repeat(np.arange(len(split)), sizes)
                inner = np.bincount(doc, v.shares[at], len(split)).astype(float)  # of no words, whole numbers
                places = np.flatnonzero(at == none)
                rare = [flat[k] for k in places.tolist()]
                endings = 1 + np.fromiter(map(zlib.crc32, [w[-3:] for w in rare]), np.int64, len(rare)) % ENDINGS  # as in ``ending``
                classes[places] = endings
                hashes = np.fromiter(map(xxh64_intdigest, rare, repeat(42)), np.uint64, len(rare)).view(np.int64)
                order = np.lexsort((hashes, doc[places]))
                same = (hashes[order][1:] == hashes[order][:-1]) & (doc[places][order][1:] == doc[places][order][:-1])
                first = np.flatnonzero(np.r_[True, ~same]) if len(rare) else np.zeros(0, np.int64)
                one = order[first]
                times = np.diff(np.r_[first, len(rare)])
                floors = v.floors([rare[k] for k in one.tolist()], endings[one])
                ends = np.r_[0, np.cumsum(np.bincount(doc[places][one], minlength=len(split)))]
                items = pa.StructArray.from_arrays([pa.array(hashes[one]), pa.array(times.astype(np.int32)), pa.array(endings[one].astype(np.int32)), pa.array(floors)], fields=list(_RARE.value_type))
                raw, stop = classes.tobytes(), np.cumsum(sizes)
                ids = [raw[e - n : e] for e, n in zip(stop.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(inner), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), items)], names=["doc_id", "n_tokens", "ids", "inner", "rare"]
                )

    schema = NUMBERED.removeprefix("row long, ")
    found = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(run, schema)
    return cut(found.select(F.monotonically_increasing_id().alias("row"), "*"))


def train(rows: DataFrame, net: WindowNet, learners: int, rounds: int = 4, batch: int = 2048) -> WindowNet:
    """``net`` after learning from every place of ``rows`` (columns as in NUMBERED) once, in ``rounds`` rounds."""
    deal = F.xxhash64("doc_id", "ids")
    dealt = cut(rows.where("n_tokens > 0").select(deal.alias("deal"), "ids").repartition(learners, "deal").sortWithinPartitions("deal", "ids"))
    sc = rows.sparkSession.sparkContext
    schema = "chunk int, branch int, weight double, total array<double>"

    def added(table: pa.Table) -> pa.Table:
        total = np.sum(table.column("total").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1), axis=0)
        weight = float(np.sum(table.column("weight").to_numpy()))
        return pa.table({"chunk": table.column("chunk")[:1], "branch": table.column("branch")[:1], "weight": [weight], "total": pa.array([total], pa.list_(pa.float64()))})

    for r in range(rounds):
        start = sc.broadcast(net)

        def learn(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(start.value.filled(start.value.flat().copy()), 0.02 / (1 + r))
            for b in batches:
                for part in slices(b, 0, 2000):
                    ids = padded(part.column(0).to_pylist())
                    for a in range(0, len(ids), batch):
                        trainer.step(*_around(ids, a, a + batch))
            if trainer.places:
                flat = trainer.net.flat() * np.float64(trainer.places)
                parts = [flat[i : i + CHUNK] for i in range(0, len(flat), CHUNK)]
                task = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(parts)), pa.int32()), pa.array([task % 64] * len(parts), pa.int32()), pa.array([float(trainer.places)] * len(parts)), pa.array(parts, pa.list_(pa.float64()))],
                    names=["chunk", "branch", "weight", "total"],
                )

        # the learner is chosen by the hash, so the round takes other bits of it
        sums = dealt.where(F.pmod(F.shiftright("deal", 40), F.lit(rounds)) == r).select("ids").mapInArrow(learn, schema)
        for keys in (["chunk", "branch"], ["chunk"]):
            sums = sums.groupBy(*keys).applyInArrow(added, schema)
        parts = sums.orderBy("chunk").collect()
        if parts:
            net = net.filled(np.concatenate([np.array(p.total) / p.weight for p in parts]))
    return net


def _fit(docs: DataFrame, id_col: str, text_col: str, frequent: int, words_held: int, width: int, rounds: int, per_learner: int, seed: int) -> tuple[LanguageModel, DataFrame]:
    counts = cut(word_counts(docs.select(F.col(text_col).cast("binary").alias("text"))))
    vocabulary, tokens = _vocabulary(counts, frequent, words_held)
    rows = number(docs, vocabulary, id_col, text_col)
    net = WindowNet.fresh(vocabulary.size, width, vocabulary.frequency / vocabulary.frequency.sum(), seed)
    net = train(rows, net, max(1, min(4096, -(-tokens // per_learner))), rounds)
    return LanguageModel(vocabulary, net, counts, tokens), rows


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = 128, words_held: int = 131_072, width: int = 16, rounds: int = 4, per_learner: int = 2_000_000, seed: int = 5) -> LanguageModel:
    """A model of the corpus, all of it. An empty one gives a model that knows no word.

    ``frequent`` words are classes of their own, counts of the most frequent words, ``words_held`` at most, go to every task, a learner takes about
    ``per_learner`` places (4,096 learners at most).
    """
    return _fit(docs, id_col, text_col, frequent, words_held, width, rounds, per_learner, seed)[0]


def _scored(rows: DataFrame, model: LanguageModel, own: bool) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(model.net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = held.value
        for b in batches:
            for part in slices(b, 3, 500):
                documents = part.column(3).to_pylist()
                sizes = np.array([len(d) for d in documents], np.int64)
                ends = np.r_[0.0, np.cumsum(net.log_prob(padded(documents)))]
                start = REACH + np.cumsum(sizes + REACH) - sizes - REACH
                total = ends[start + sizes] - ends[start] + part.column(4).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(total)], names=["row", "doc_id", "n_tokens", "total"])

    base = rows.select("row", "doc_id", "n_tokens", "ids", "inner").mapInArrow(run, "row long, doc_id long, n_tokens long, total double")
    totals = F.element_at(F.array(*map(F.lit, model.vocabulary.totals[1:].tolist())), F.col("ending"))
    rare = rows.select("row", F.inline("rare")).join(model.counts.select("h", F.col("n").alias("all")), "h", "left")
    others = F.coalesce("all", F.lit(0)) - (F.col("n") if own else F.lit(0))
    share = F.log((F.greatest(others - F.lit(DISCOUNT), F.lit(0.0)) + F.exp("floor")) / totals)
    shares = rare.select("row", (F.col("n") * share).alias("s")).groupBy("row").agg(F.sum("s").alias("s"))
    log_prob = (F.col("total") + F.coalesce("s", F.lit(0.0))).alias("log_prob")
    out = base.join(shares, "row", "left").select("doc_id", "n_tokens", log_prob)
    return out.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")))


def score(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", own: bool = False) -> DataFrame:
    """A row for each row of ``docs``, columns as in SCHEMA; higher is likelier.

    ``own``: ``docs`` is what the model was fitted to, so a document's own occurrences of a word that isn't frequent are
    taken off that word's count. A text without words, or null, has log_prob 0 and a null mean. Whole texts count.
    Repeated rows are kept, other columns ignored; an empty table gives an empty result.
    """
    return _scored(number(docs, model.vocabulary, id_col, text_col), model, own)


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score(docs, fit(docs), own=True)``, with the words numbered once."""
    model, rows = _fit(docs, id_col, text_col, 128, 131_072, 16, 4, 2_000_000, 5)
    return _scored(rows, model, True)
