from collections import Counter

import numpy as np
import pytest

from tracewarden.llm import lm_score
from tracewarden.llm.decontaminate import words
from tracewarden.llm.lm_score import DISCOUNT, LanguageModel, Trainer, Vocabulary, WindowNet, _around, _fit, _scored, ending, fit, number, padded, score, word_counts
from tracewarden.llm.queries import op3_lm_score


def slow_classes(vocabulary, own_class, ws):
    own = {w: 63 + k for k, (w, _) in enumerate(vocabulary.args[0][:own_class])}
    return [own.get(w) or ending(w) for w in ws]


def slow_class_scores(net, ids):
    width, ids = len(net.hidden), [0, 0, *ids, 0, 0]
    out = []
    for p in range(2, len(ids) - 2):
        h = np.tanh(sum(net.context[ids[p + o]].astype(float)[k * width : (k + 1) * width] for k, o in enumerate((-2, -1, 1, 2))) + net.hidden)
        z = h @ net.out.astype(float) + net.bias
        out.append(z[ids[p]] - np.log(np.exp(z).sum()))
    return out


def slow_scores(texts, net, own_class, own):
    """Every text's sum, from counts of whole words kept in a dictionary."""
    counts = Counter(w for t in texts for w in words(t))
    top = sorted(counts, key=lambda w: (-counts[w], w))[:own_class]
    numbers = {w: 63 + k for k, w in enumerate(top)}
    total, kinds = Counter(), Counter()
    for w, n in counts.items():
        if w not in numbers:
            total[ending(w)] += n
            kinds[ending(w)] += 1
    letters = np.ones(257)
    for w in counts:
        letters[256] += 1
        for b in w:
            letters[b] += 1
    letters = np.log(letters / letters.sum())
    out = []
    for t in texts:
        ws = words(t)
        mine = Counter(ws)
        s = sum(slow_class_scores(net, [numbers.get(w) or ending(w) for w in ws]))
        for w in ws:
            if w not in numbers:
                c = ending(w)
                floor = DISCOUNT * kinds[c] * np.exp(sum(letters[b] for b in w) + letters[256])
                s += np.log((max(counts[w] - own * mine[w] - DISCOUNT, 0) + floor) / total[c])
        out.append(s)
    return out


@pytest.mark.parametrize("own", [False, True])
def test_scores_against_plain_sums(spark, sf, own):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(25)
    model, rows = _fit(docs, "doc_id", "text", 20, 20, 8, 2, 2_000, 5)
    texts = [(r.doc_id, None if r.text is None else r.text.encode()) for r in docs.collect()]
    want = dict(zip((d for d, _ in texts), slow_scores([t for _, t in texts], model.net, 20, own)))
    for got in (_scored(rows, model, own), score(docs, model, own=own)):
        found = {r.doc_id: r.log_prob for r in got.collect()}
        assert found.keys() == want.keys()
        assert all(np.isclose(found[d], want[d], rtol=1e-4) for d in want)


def test_better_than_single_words_whatever_the_partitions(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores = []
    for n in (4, 16, 64):
        model, rows = _fit(base.repartition(n), "doc_id", "text", 128, 5_000, 16, 4, 100_000, 5)
        ids = padded([bytes(r.ids) for r in rows.select("ids").collect()])
        alone = np.log(model.vocabulary.frequency / model.vocabulary.frequency.sum())
        assert np.mean(model.net.log_prob(ids)[ids > 0]) > np.mean(alone[ids[ids > 0]]) + 0.1
        scores.append({r.doc_id: r.mean_log_prob for r in _scored(rows, model, True).where("n_tokens > 0").collect()})
    assert all(abs(scores[0][d] - s[d]) < 1e-3 for s in scores[1:] for d in s)


def test_query_ranks_texts_above_their_mixture(spark, sf):
    """Two texts in two languages hold the same words as the two taking turns, which no context predicts as well."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = [(r.lang, words(r.text.encode())) for r in docs.collect() if r.text]
    english, german = ([ws for c, ws in rows if c == lang and len(ws) > 60] for lang in ("en", "de"))
    texts = {}
    for k, (a, b) in enumerate(zip(english, german)):
        n = min(len(a), len(b))
        texts[3 * k], texts[3 * k + 1] = a[:n], b[:n]
        texts[3 * k + 2] = [w for pair in zip(a[:n], b[:n]) for w in pair]
    frame = spark.createDataFrame([(d, b" ".join(ws).decode()) for d, ws in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in score(frame, model).collect()}
    assert len(got) > 30 and np.mean([got[d] + got[d + 1] > got[d + 2] for d in got if d % 3 == 0]) > 0.9
    out = op3_lm_score(spark, sf).collect()
    assert len(out) == docs.count() and all(r.log_prob < 0 for r in out if r.n_tokens)


def test_rare_words_that_occur_elsewhere_are_likelier(spark):
    rows = [(k, f"aa bb cc q{k}x aa bb cc r{k}x") for k in range(40)] + [(100, "aa bb cc q7x aa bb cc r7x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    model, numbered = _fit(frame, "doc_id", "text", 3, 3, 4, 1, 1000, 5)
    got = {r.doc_id: r.log_prob for r in _scored(numbered, model, True).collect()}
    assert got[7] == got[100] > max(s for d, s in got.items() if d not in (7, 100))


def test_counts_cover_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter(w for r in docs.collect() for w in words((r.text or "").encode()))
    got = {bytes(r.word): r.n for r in word_counts(docs.selectExpr("cast(text as binary)"), held=1000).collect()}
    assert got == want


def test_every_place_is_learned_from_once():
    """Runs of places overlap only in what is looked at."""
    ids = padded([bytes([1, 2, 3, 4, 5]), b"", bytes([6, 7])])
    seen = []
    for a in range(0, len(ids), 3):
        part, places = _around(ids, a, a + 3)
        seen += part[places].tolist()
        assert all(part[p - 2 : p + 3].tolist() == ids[q - 2 : q + 3].tolist() for p, q in zip(places, places + max(0, a - 2)))
    assert seen == [1, 2, 3, 4, 5, 6, 7]


def test_gradients():
    """Of every parameter, against differences of the loss."""
    rng = np.random.default_rng(0)
    net = WindowNet.fresh(9, 3, np.full(9, 1 / 9), 1)
    net = WindowNet(*[p.astype(np.float64) for p in net.params()])
    ids = np.r_[0, 0, rng.integers(1, 9, 30), 0, 0].astype(np.uint8)
    places = np.flatnonzero(ids)
    loss = lambda n: -np.sum(n.log_prob(ids)) / len(places)
    trainer = Trainer(net.filled(net.flat().copy()), rate=1e-6)
    trainer.step(ids, places)
    gradient = np.concatenate([m.ravel() for m in trainer.mean]) * 10
    for k in rng.choice(gradient.size, 40, replace=False):
        near = []
        for e in (1e-5, -1e-5):
            flat = net.flat().copy()
            flat[k] += e
            near.append(loss(net.filled(flat)))
        assert np.isclose((near[0] - near[1]) / 2e-5, gradient[k], rtol=1e-3, atol=1e-7)


def test_shares_of_a_class_add_up_to_less_than_one():
    counts = {b"the": 50, b"of": 40, b"xing": 9, b"ying": 3, b"zing": 1}
    spelling = np.log(np.full(257, 1 / 257))
    c = ending(b"xing")
    assert ending(b"ying") == c
    v = Vocabulary(sorted(counts.items(), key=lambda x: -x[1])[:4], 2, {c: (13, 3)}, spelling)
    assert v.classes.tolist() == [63, 64, c, c, 0] and v.shares[:2].tolist() == [0, 0]
    assert 0 < np.exp(v.shares[2:4]).sum() < 12.1 / 13 and v.frequency[c] == 14


def test_numbering(spark):
    v = Vocabulary([(b"a", 5), (b"b", 3)], 1, {ending(b"b"): (3, 1)}, np.zeros(257))
    rows = number(spark.createDataFrame([(4, "a b zz a zz y"), (5, None)], "doc_id long, text string"), v).orderBy("doc_id").collect()
    assert bytes(rows[0].ids) == bytes([63, ending(b"b"), ending(b"zz"), 63, ending(b"zz"), ending(b"y")])
    assert sorted(r.n for r in rows[0].rare) == [1, 2] and rows[1].rare == [] and rows[1].n_tokens == 0


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a b " * 50_000, 1), (3, "a b", 1), (None, "a", 1), (4, "x" * 100_000, 1)], "doc_id long, text string, log_prob int")
    model = fit(docs)
    got = sorted((str(r.doc_id), r.n_tokens, r.mean_log_prob is None) for r in score(docs, model).collect())
    assert got == [("1", 0, True), ("2", 0, True), ("3", 2, False), ("3", 100_000, False), ("4", 1, False), ("None", 1, False)]
    assert all(np.isfinite(r.log_prob) for r in score(docs, model, own=True).collect())
    empty = fit(docs.limit(0))
    assert isinstance(empty, LanguageModel) and score(docs.limit(0), empty).count() == 0
    assert [r.n_tokens for r in score(docs.where("doc_id = 3 and length(text) = 3"), empty).collect()] == [2]


def test_step_is_the_gradient_of_a_softmax():
    """One step, against sums over a matrix of which class stands where; large weights are shifted before exp."""
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 20, 300).astype(np.uint8)
    for scale in (1.0, 400.0):
        net = lm_score.WindowNet.fresh(20, 4, np.ones(20) / 20, 1)
        net.out *= np.float32(scale)
        h = net.inner(ids)
        z = (h @ net.out + net.bias).astype(float)
        assert np.allclose(np.exp(net.logits(h[:5])) / np.exp(net.logits(h[:5])).sum(axis=1, keepdims=True), np.exp(z[:5] - z[:5].max(axis=1, keepdims=True)) / np.exp(z[:5] - z[:5].max(axis=1, keepdims=True)).sum(axis=1, keepdims=True), atol=1e-4)
        part, places = lm_score._around(ids, 0, 300)
        p = np.exp(z[places] - z[places].max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(places)), part[places]] -= 1
        p /= len(places)
        back = np.zeros((300, 4))
        back[places] = (p @ net.out.T) * (1 - h[places] ** 2)
        moved = np.zeros((300, 16))
        for k, o in enumerate(lm_score.OFFSETS):
            moved[slice(0, o) if o < 0 else slice(o, None), k * 4 : k * 4 + 4] = back[-o:] if o < 0 else back[:-o]
        want = np.stack([moved[part == c].sum(axis=0) for c in range(20)])
        trainer = lm_score.Trainer(net)
        trainer.step(part, places)
        assert np.allclose(trainer.mean[0], 0.1 * want, rtol=1e-3, atol=1e-5 * scale)
