import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewarden.llm import jaccard
from tracewarden.llm.jaccard import near_copies, node_and_shingles
from tracewarden.llm.simhash import fingerprint, near_duplicates


def slow_sets(texts):
    out = {}
    for d, t in texts.items():
        ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        out[d] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))}
    return out


def slow_groups(texts, least=0.8):
    """{doc: least doc reachable} by comparing all pairs."""
    sets, root = slow_sets(texts), {}
    for d in sorted(texts):
        root[d] = d
        for e in [e for e in root if e < d]:
            if len(sets[d] & sets[e]) >= least * len(sets[d] | sets[e]):
                lo, hi = sorted((root[d], root[e]))
                root = {k: lo if r == hi else r for k, r in root.items()}
    return root


def test_stage_drops_what_all_pairs_drop(spark, sf):
    """One copy of these tables is 9 bits off its original, out of reach of op2's four."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = slow_groups({r.doc_id: r.text for r in docs.collect()})
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf).collect()}
    assert kept == set(want.values())
    assert kept != {r.component_id for r in near_duplicates(docs).collect()}


@pytest.mark.parametrize("edits", [1, 4])
def test_groups_of_copies_against_all_pairs(spark, edits):
    """Chains, in which a copy is like its neighbours and unlike the first; all in few buckets."""
    texts = {}
    for g in range(4):
        ws = [f"w{g}x{k}" for k in range(120)]
        for c in range(25):
            for e in range(edits):
                ws[(c * 7 + e * 31) % 120] = f"e{g}x{c}x{e}"
            texts[100 * g + c] = " ".join(ws)
    texts |= {900: "a b c", 901: "A  b\tc", 902: "a b", 903: None, 904: " "}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(frame).collect()} == slow_groups(texts)


def test_shingles():
    assert node_and_shingles(None, 5)[0] == 0 and len(node_and_shingles(b"a b", 5)[1]) == 1
    assert len(node_and_shingles(b"a b c d e f a b c d e", 5)[1]) == 6


def test_simhash_links_without_minhash(spark, monkeypatch):
    """Near copies within four bits are joined by their fingerprints alone, and only if the sets of shingles are alike."""
    words = [f"w{k}" for k in range(600)]
    texts = [" ".join(words), " ".join([*words[:300], "new", *words[301:]]), " ".join(reversed(words)), " ".join(words).upper()]
    assert (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() <= 4
    sketches = jaccard._sketches
    monkeypatch.setattr(jaccard, "_sketches", lambda *a: sketches(*a).withColumn("keys", F.array().cast("array<long>")))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies(frame).collect()} == {0: 0, 1: 0, 2: 2, 3: 0}
    assert {r.doc_id: r.component_id for r in near_copies(frame, least=0.999).collect()} == {0: 0, 1: 1, 2: 2, 3: 0}
