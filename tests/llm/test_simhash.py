import random
import re

import pytest
import xxhash

from tracewarden.llm.components import components
from tracewarden.llm.queries import op2_simhash
from tracewarden.llm.simhash import bucket_links, fingerprint, keep_one, near_duplicates, near_links


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """{doc: least doc reachable} by comparing all pairs."""
    root = {d: d for d in prints}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    docs = sorted(prints)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in docs}


@pytest.mark.parametrize("text", [None, "", " \n", "A", "Ein  Wort\tÄÖ b", "a b c d", "a b c d e f g", "x " * 3000, " a b c d e"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == slow_print(text)


def test_query_against_all_pairs(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    prints = {d: slow_print(t) for d, t in docs.items()}
    wanted = slow_components(prints)
    got = op2_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {d: (f"{prints[d]:016x}", wanted[d]) for d in docs}
    assert len(got) == len(docs) and len(set(wanted.values())) < len(docs)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_reach_as_far_as_all_pairs(spark, seed):
    rng = random.Random(seed)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(500):  # chains and dense clusters, some just too far
        x = rng.choice(prints[-60:] if rng.random() < 0.5 else prints[:3])
        for b in rng.sample(range(64), rng.randint(1, 6)):
            x ^= 1 << b
        prints.append(x)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(3)
    links = near_links(frame)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links.collect())
    roots = {r.node: r.root for r in components(links).collect()}
    wanted = slow_components(dict(enumerate(prints)))
    groups = {}
    for k, s in enumerate(signed):
        groups.setdefault(roots.get(s, s), set()).add(k)
    expected = {}
    for k, g in wanted.items():
        expected.setdefault(g, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (500, 500), (400, 500)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 500: 400}
    assert components(edges.limit(0)).count() == 0


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(5, None, 1), (3, "", 1), (3, "", 1), (None, " ", 1), (9, "one two three four five", 1), (7, "ONE two three four five", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = sorted((r.doc_id is None, r.doc_id, r.component_id) for r in near_duplicates(docs).collect())
    assert got == [(False, 3, 3), (False, 3, 3), (False, 5, 3), (False, 7, 7), (False, 9, 7), (True, None, 3)]
    kept = sorted((r.doc_id is None, r.doc_id) for r in keep_one(docs).collect())
    assert kept == [(False, 3), (False, 7)]  # the null id is a copy of 3 and 5
    assert near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_tells_rows_by_content(spark):
    """Not by the id: a document isn't dropped because another one with its id is a copy of something."""
    a, b = "one two three four five six", "ten eleven twelve thirteen fourteen fifteen"
    schema = "doc_id long, text string, n map<string,int>"
    cases = [
        ([(5, a), (5, b), (3, b)], [(3, b), (5, a)]),
        ([(5, a), (5, b)], [(5, a), (5, b)]),
        ([(5, a), (5, a), (5, a)], [(5, a)]),
        ([(5, a), (5, a.upper())], 1),
        ([(None, a), (None, b), (None, b), (7, b)], [(7, b), (None, a)]),
    ]
    for rows, want in cases:
        kept = [(r.doc_id, r.text) for r in keep_one(spark.createDataFrame([(*r, {"x": 1}) for r in rows], schema)).collect()]
        assert len(kept) == want if isinstance(want, int) else sorted(kept, key=str) == sorted(want, key=str)
    assert keep_one(spark.createDataFrame([], schema)).count() == 0


def test_large_buckets_lose_no_link():
    rng = random.Random(4)
    for variant, (lo, hi) in ((0, (0, 22)), (30, (22, 43)), (63, (43, 64))):
        same = rng.getrandbits(64) & sum(1 << b for b in range(lo, hi))
        prints = [same | rng.getrandbits(64) & ~sum(1 << b for b in range(lo, hi)) for _ in range(300)]
        for _ in range(300):
            x = rng.choice(prints)
            for b in rng.sample(range(64), 4):
                x ^= 1 << b
            prints.append(x)
        prints = sorted(set(prints))
        import numpy as np

        from tracewarden.llm.simhash import forest

        def groups(links):
            root = {p: p for p in prints}
            for x, y in zip(*map(list, links)):
                lo_, hi_ = sorted((root[int(x)], root[int(y)]))
                root = {k: lo_ if r == hi_ else r for k, r in root.items()}
            return root

        assert groups(bucket_links(np.array(prints, np.uint64), variant, 4, large=100)) == groups(forest(np.array(prints, np.uint64), 4))


def test_hubs_stay_where_they_are(spark):
    """A hub of more neighbours than a hot key has, and a group of copies as large."""
    edges = spark.range(1, 4001).selectExpr("0L as a", "id as b").unionByName(spark.range(5000, 5010).selectExpr("id as a", "id + 1 as b"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 4001)}, **{k: 5000 for k in range(5001, 5011)}}
    docs = spark.range(3000).selectExpr("id + 10 as doc_id", "'some words that are the same' as text").unionByName(spark.range(3).selectExpr("id as doc_id", "concat('other words here ', id) as text"))
    assert near_duplicates(docs).where("doc_id >= 10").select("component_id").distinct().collect() == [(10,)]
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [0, 1, 2, 10]
