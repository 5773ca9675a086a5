"""The pipeline against a brute-force version of each stage, on the smallest tables."""

import re
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_decontaminate import slow
from tests.llm.test_jaccard import slow_groups
from tracewarden.llm.queries import tokenizer_path

OWN = re.compile(r"[a-z]+\.\d\d@mail\d\.example\.com|\+1 \(\d{3}\) \d{3}-\d{4}|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b\d{16}\b|AKIA[A-Z0-9]{16}|\b[0-9a-f]{40}\b|(?<=password=)[0-9a-f]+")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10_001, "12 34 ...", "en", "s", 9), (10_002, None, None, "s", 0)], docs.schema)
    start = docs.unionByName(extra).cache()
    stages = [f for _, f in corpus_pipeline.STAGES]
    texts = lambda frame: {r.doc_id: r.text for r in frame.collect()}

    one = stages[0](spark, start, sf)
    assert one.columns == docs.columns and texts(one) == texts(docs)

    two = stages[1](spark, start, sf)
    groups = slow_groups(texts(start))
    assert two.columns == docs.columns and set(texts(two)) == set(groups.values()) and two.count() == len(set(groups.values()))

    three = stages[2](spark, start, sf)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(texts(three)) == {d for d, _, hit, _ in slow(texts(start).items(), items) if not hit}

    four = stages[3](spark, start, sf)
    assert four.columns == docs.columns
    before, after = texts(start), {r.doc_id: r for r in four.collect()}
    assert set(after) == set(before) and after[10_002].text is None
    for d, t in before.items():
        if t is not None:
            assert OWN.split(after[d].text) == OWN.split(t) and after[d].n_chars == len(after[d].text)
            assert not set(OWN.findall(t)) & set(OWN.findall(after[d].text))


def test_run(spark, sf):
    pieces = corpus_pipeline.run(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    groups = slow_groups(docs)
    left = {d: docs[d] for d in set(groups.values())}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {d for d, _, hit, _ in slow(left.items(), items) if not hit}
    tokenizer, found = Tokenizer.from_file(tokenizer_path()), defaultdict(list)
    for r in pieces:
        found[r.doc_id].append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert set(found) == kept and 0 < len(kept) < len(left) < len(docs)
    for d in kept:
        if not OWN.search(docs[d]):
            ids = [i for _, part in sorted(found[d]) for i in part]
            assert ids == tokenizer.encode(docs[d], add_special_tokens=False).ids + [1]


def test_nothing_labelled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.identify_language(spark, docs.selectExpr("doc_id", "text", "cast(null as string) as lang", "source", "n_chars"), sf).count() == docs.where("text rlike '[\\\\p{L}]'").count()


def test_key_is_the_sessions(spark, sf):
    docs = spark.createDataFrame([(1, "call +1 (202) 555-0187 now", "en", "s", 26)], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.replace_personal_data(spark, docs, sf).first().text
    spark.conf.set("spark.tracewarden.surrogateKey", "another")
    try:
        assert corpus_pipeline.replace_personal_data(spark, docs, sf).first().text != one
    finally:
        spark.conf.unset("spark.tracewarden.surrogateKey")
