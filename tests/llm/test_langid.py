import zlib

import numpy as np

from tracewarden.llm.langid import fit, held_out, identify, keep_identified, predict, train
from tracewarden.llm.queries import op7_langid


def test_query_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op7_langid(spark, sf).collect()
    assert len(got) == len(docs)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    assert np.mean(right) > 0.97


def test_pooled_values_match_a_plain_convolution():
    net = train([("a", b"some english text here"), ("b", "größe über öl".encode())] * 4, epochs=2)
    x = np.random.default_rng(0).integers(0, 256, (3, net.window)).astype(np.uint8)
    slow = np.concatenate([np.stack([sum(t[i][x[:, p + i]] for i in range(w)) for p in range(net.window - w + 1)], 1).max(1) for w, t in net.tables.items()], 1)
    assert np.allclose(slow, net.pooled(x), atol=1e-4)


def test_nulls_letters_lengths_and_clashing_columns(spark):
    rows = [(k, t, c, 1.0) for k, (t, c) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    net = fit(docs)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "12 ... ?", 1), (4, "der hund und die katze " * 5000, 1), (None, "the cat", 1), (6, "the cat", 1), (6, "the cat", 1)], "doc_id long, text string, lang_pred int")
    got = {(r.doc_id, r.lang_pred) for r in identify(odd, net).collect()}
    assert got == {(1, "und"), (2, "und"), (3, "und"), (4, "de"), (None, "en"), (6, "en")}
    assert sorted(str(r.doc_id) for r in keep_identified(odd, net).collect()) == ["4", "6", "6", "None"]
    assert identify(odd.limit(0), net).count() == 0
    assert fit(docs.where("lang is null")) is None
    assert predict(None, ["text"]) == (["und"], [0.0])
    assert docs.where(held_out()).count() < docs.count()


def test_stage_rule(spark):
    """The prediction decides; without labels every text with a letter stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = fit(docs.where(~held_out()), max_rows=1500)
    texts = {r.lang: r.text for r in docs.where("length(text) between 1500 and 4000 and lang is not null").orderBy("doc_id").collect()}
    mixed = "".join(t[k : k + 256].ljust(256) for k in range(0, 1024, 256) for t in texts.values())
    rows = [(k, t, c) for k, (c, t) in enumerate(sorted(texts.items()))] + [(10, mixed, None), (11, "12 ...", None), (12, None, None), (13, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score string")
    everything = {k for k, _, c in rows if c}
    assert {r.doc_id for r in keep_identified(frame, net).collect()} == everything
    assert {r.doc_id for r in keep_identified(frame, net, wanted=["de"]).collect()} == {k for k, _, c in rows if c == "de"}
    assert {r.doc_id for r in keep_identified(frame, None).collect()} == everything | {10}
    assert keep_identified(frame, net).columns == frame.columns and keep_identified(frame.limit(0), net).count() == 0
    kept = keep_identified(docs, net).count()
    assert kept == docs.where("text rlike '[\\\\p{L}]'").count()
