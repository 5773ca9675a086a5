import zlib
from array import array
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from tracewarden.llm.packing import ChunkEncoder, TierPacker, pack_documents
from tracewarden.llm.queries import op1_packing, tokenizer_path

ODD = ["it's 'S don't. ab'.x d's.", "İstanbul ΣΑΣ. ς", "á.b c d\x1ce \t\r\n x", "日本語、テスト。", "1.5,2 x.,y ..", "<|endoftext|> q", "a <|endoftext|> B", "x<|startoftext|>Y. <|ENDOFTEXT|> É", "<|endoftext|><|endoftext|>.", "End<|", "Ω <|endoftext|>Σ ", "é. ́ .́ ,", "A" * 100 + ". b", "", "   \n", "Ḱ., 'll.", "x&&& y%%% z!!", "a" * 5000, "".join(chr(c) for c in range(0xA0, 0x100)), " ".join(f"x{chr(c)}y" for c in range(0x80, 0x180))]


def plain():
    return Tokenizer.from_file(tokenizer_path())


def test_ids_are_the_tokenizers_own(spark, sf):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [None]
    encoder = ChunkEncoder(tokenizer_path(), keep=500)
    for _ in range(2):
        for t, found in zip(texts, encoder.encode(texts)):
            assert found == array("I", plain().encode(t or "", add_special_tokens=False).ids).tobytes()


def test_special_tokens_are_as_in_a_plain_call():
    found = ChunkEncoder(tokenizer_path()).encode(["a <|endoftext|> b"])[0]
    assert list(array("I", found)) == [320, 49407, 321]


def check(rows, docs, tiers):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc_id, start, length, ids, total, seq, offset, tier, group in rows:
        assert length > 0 and len(ids) == 4 * length
        pieces[doc_id].append((start, bytes(ids), total))
        sequences[seq].append((offset, length, tier, group))
    for doc_id, ids in docs.items():
        got = sorted(pieces[doc_id])
        assert b"".join(p[1] for p in got) == ids and {p[2] for p in got} == {len(ids) // 4}
        assert [p[0] for p in got] == [sum(len(q[1]) // 4 for q in got[:k]) for k in range(len(got))]
    for parts in sequences.values():
        at = 0
        for offset, length, tier, group in sorted(parts):
            assert offset == at and (tier, group) == parts[0][2:]
            at += length
        assert at == parts[0][2] <= tiers[-1] and at & (at - 1) == 0  # a full window, nothing padded


@pytest.mark.parametrize("sizes", [[], [1], [2048], [2047, 1], [5000] * 7, list(range(1, 700, 3)), [1] * 3000, [255, 256, 257] * 100])
def test_windows_are_full(sizes):
    packer = TierPacker(0, pool=16)
    docs = {k: array("I", range(k, k + n)).tobytes() for k, n in enumerate(sizes)}
    rows = [r for k, ids in docs.items() for r in packer.add(k, ids)]
    rows += packer.finish()
    check(rows, docs, packer.tiers)


def test_step_groups_are_balanced():
    packer = TierPacker(0)
    rows = []
    for k in range(4000):
        rows += packer.add(k, bytes(4 * (50 + k * 37 % 1500)))
    rows += packer.finish()
    tokens = defaultdict(int)
    for r in rows:
        tokens[r[8]] += r[2]
    full = [tokens[g] for g in range(8)]
    assert max(full) < 1.2 * min(full)


def test_bad_tiers():
    with pytest.raises(ValueError):
        TierPacker(0, tiers=(100, 200))


def test_nulls_ties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, 9, 9), (2, "", 9, 9), (2, "", 9, 9), (None, "a b", 9, 9)], "doc_id long, text string, start long, tier long")
    rows = pack_documents(docs, tokenizer_path()).collect()
    assert sorted((str(r.doc_id), r.doc_tokens) for r in rows if r.start == 0) == [("1", 1), ("2", 1), ("2", 1), ("None", 3)]
    assert sum(r.length for r in rows) == 6
    assert pack_documents(docs.limit(0), tokenizer_path()).count() == 0


def test_query(spark, sf):
    rows = op1_packing(spark, sf).collect()
    docs = {r.doc_id: plain().encode(r.text or "", add_special_tokens=False).ids + [1] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = defaultdict(int)
    for r in rows:
        assert zlib.crc32(array("I", docs[r.doc_id][r.start : r.start + r.length]).tobytes()) == r.ids_crc32
        assert r.doc_tokens == len(docs[r.doc_id])
        seen[r.doc_id] += r.length
    assert seen == {d: len(i) for d, i in docs.items()}


def test_a_chunk_is_encoded_once():
    encoder = ChunkEncoder(tokenizer_path())
    asked, once = [], encoder.chunk
    encoder.known.missing = lambda c: asked.append(c) or once(c)
    texts = ["the Cat, the cat\nÉté! 12 the", None, "cat, 12 été " + "7" * 70] * 2
    assert encoder.encode(texts) == [array("I", encoder.tokenizer.encode(t or "", add_special_tokens=False).ids).tobytes() for t in texts]
    assert sorted(asked) == sorted(["the", "cat,", "12", "été!", "7" * 70, "7" * 70])  # but for long ones
