import hashlib
import random
import re

from tracewarden.llm.decontaminate import build_index, drop_contaminated, find_phrases, open_index, search_index, store_index, word_count
from tracewarden.llm.queries import op9_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, window=10):
    wins = {}
    for item, text in items:
        ws = split(text)
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if size else 0):
            wins.setdefault(tuple(ws[k : k + size]), set()).add(str(item))
    sizes = {len(w) for w in wins}
    out = []
    for d, text in docs:
        ws, hit, found = split(text), set(), set()
        for s in sizes:
            for k in range(len(ws) - s + 1):
                if (w := tuple(ws[k : k + s])) in wins:
                    hit.update(range(k, k + s))
                    found |= wins[w]
        out.append((d, len(ws), len(hit), sorted(found)))
    return sorted(out)


def test_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in op9_decontaminate(spark, sf).collect())
    wanted = [(d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in slow(docs, items)]
    assert got == wanted and any(w[5] for w in wanted)


def random_tables(spark):
    rng = random.Random(3)
    vocabulary = ["a", "b", "C", "dé", "e9", "x"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    docs = [(k, text(rng.choice([0, 1, 5, 60, 300]))) for k in range(60)] + [(60, None), (61, "")]
    items = [(k, text(rng.choice([1, 4, 6, 10, 14]))) for k in range(10, 30)] + [(30, None), (31, "..."), (11, "x x x x")]
    docs[5] = (5, (docs[5][1] or "") + " " + items[3][1])
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_random_texts_in_one_block_and_in_many(spark):
    docs, items, d, i = random_tables(spark)
    wanted = slow(docs, items)
    for block in (1 << 20, 150):
        got = sorted((r.doc_id, r.n_words, r.n, r["items"]) for r in find_phrases(d, i, block_bytes=block).withColumn("n", word_count()).collect())
        assert got == wanted
        clean = {r.doc_id for r in drop_contaminated(d, i, block_bytes=block).collect()}
        assert clean == {w[0] for w in wanted if not w[2]}


def test_stored_index(spark, tmp_path):
    """An index that was stored before there were items, of rows that come out of a shuffle."""
    docs, items, d, i = random_tables(spark)
    path = str(tmp_path / "index")
    index = store_index(build_index(d.repartition(5), rows=7), path)
    held = index.where("n > 0").selectExpr("sum(n) as n", "sum(length(places)) as b", "count(distinct segment) as s").first()
    assert held.n == sum(w[1] for w in slow(docs, [])) and held.b == 4 * held.n and held.s > 5
    want = slow(docs, items)
    for block, everything in ((150, True), (1 << 20, False)):
        found = search_index(open_index(spark, path), i, near_terms=None, block_bytes=block, all_docs=everything).withColumn("n", word_count())
        assert sorted((r.doc_id, r.n_words, r.n, r["items"]) for r in found.collect()) == [w for w in want if everything or w[2]]
    nothing = build_index(d.limit(0))
    assert nothing.count() == 0 and search_index(nothing, i).count() == 0 and search_index(index, i.limit(0), all_docs=False).count() == 0


def test_proximity_in_one_block_and_in_many(spark):
    items = [(k, " ".join(f"w{(k + j) % 30}" for j in range(11))) for k in range(4)]
    docs = [(k, " ".join(f"w{(2 * k + j + (j > 5)) % 30}" for j in range(14))) for k in range(30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r.doc_id: (r["items"], r.near_items) for r in find_phrases(d.repartition(3), i, block_bytes=b).collect()} for b in (1 << 20, 100))
    assert one == many and any(n for _, n in one.values())


def test_rows_that_go(spark):
    """Told by their text, not by their id; nulls, repeats and clashing columns."""
    text = "a b c d e f g h i j"
    rows = [(1, text, 1), (1, "clean", 1), (2, f"x {text} y", 1), (2, f"x {text} y", 1), (3, None, 1), (4, "", 1), (4, "", 1), (None, text, 1), (None, "b a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    items = spark.createDataFrame([(None, text)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in drop_contaminated(docs, items).collect()), key=str)
    assert got == sorted([(1, "clean"), (3, None), (4, ""), (4, ""), (None, "b a")], key=str)
    assert drop_contaminated(docs, items.limit(0)).count() == len(rows) and drop_contaminated(docs.limit(0), items).count() == 0
    assert drop_contaminated(docs, items).columns == docs.columns


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, item), (2, "xx alpha beta gamma delta yy epsilon zeta eta theta iota kappa"), (3, "kappa beta gamma delta epsilon zeta eta theta iota alpha"), (4, "alpha beta gamma delta epsilon zeta eta theta"), (5, "alpha beta gamma delta epsilon zeta eta theta x iota")]
    got = {r.doc_id: (r["items"], r.near_items) for r in find_phrases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert got == {1: (["7"], []), 2: ([], ["7"]), 3: ([], ["7"]), 4: ([], []), 5: ([], ["7"])}


def slow_near(text, items, terms, slop, window=10):
    ws, out = split(text), set()
    for item, t in items:
        words = split(t)
        for k in range(len(words) - window + 1):
            w = words[k : k + window]
            if any(sum(x in ws[s : s + window + slop] for x in w) >= terms for s in range(len(ws))):
                out.add(str(item))
    return out


def test_proximity_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.sample(vocabulary, 12))) for k in range(25)] + [(30, "w1 w1 w2 w2 w3 w3 w4 w4 w5 w5")]
    docs = []
    for d in range(60):
        base = rng.choice(items)[1].split()[: rng.randint(8, 12)]
        rng.shuffle(base)
        for _ in range(rng.randint(0, 7)):
            base.insert(rng.randrange(len(base)), rng.choice(vocabulary + ["zz"]))
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(20)] + base)))
    found = find_phrases(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), near_terms=8, slop=3).collect()
    exact = {d: set(i) for d, _, _, i in slow(docs, items)}
    want = {d: slow_near(t, items, 8, 3) - exact[d] for d, t in docs}
    assert {r.doc_id: set(r.near_items) for r in found} == want and sum(map(len, want.values())) > 10


def test_nulls_repeats_empties_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, None, "s"), (1, "a b", "s"), (1, "a b", "s"), (None, "A b!", "s")], "doc_id long, text string, spans string")
    items = spark.createDataFrame([(None, "a b", 1), (4, "a B", 1), (None, "q", 1)], "item_id long, text string, words int")
    only = find_phrases(spark.createDataFrame([(1, "p q")], "doc_id long, text string"), items).first()
    assert (only["items"], [tuple(s) for s in only.spans]) == ([], [(1, 2)])  # an item without id
    got = [(r.doc_id, r.n_words, r["items"]) for r in find_phrases(docs, items).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, []), (1, 2, ["4"]), (1, 2, ["4"]), (None, 2, ["4"])], key=str)
    assert find_phrases(docs.limit(0), items).count() == 0
    assert {tuple(r["items"]) for r in find_phrases(docs, items.limit(0)).collect()} == {()}
