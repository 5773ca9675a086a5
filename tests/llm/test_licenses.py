import random
import re
import time
from collections import Counter
from difflib import SequenceMatcher

from tracewarden.llm.licenses import TEMPLATES, Scanner, align, increasing, scan_licenses, words
from tracewarden.llm.queries import op8_licenses


def test_query_finds_every_planted_notice(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = sorted((d, name) for d, t in docs.items() for name, notice in TEMPLATES.items() if notice.endswith(".") and len(notice) < 90 for _ in re.finditer(re.escape(notice), t or ""))
    rows = op8_licenses(spark, sf).collect()
    assert sorted((r.doc_id, r.license) for r in rows) == want and want
    for r in rows:
        assert r.coverage == 1 and words(docs[r.doc_id])[r.start : r.end] == words(TEMPLATES[r.license])


def test_longest_increasing_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        values = rng.sample(range(12), rng.randint(0, 9))
        best = max((bin(m).count("1") for m in range(1 << len(values)) if (s := [v for k, v in enumerate(values) if m >> k & 1]) == sorted(s)), default=0)
        got = increasing(list(enumerate(values)))
        assert len(got) == best and got == sorted(got) and [b for _, b in got] == sorted(b for _, b in got)


def test_alignment_is_increasing_and_of_equal_words():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = align(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    same = "one two three two one".split()
    assert align(same, same) == [(k, k) for k in range(5)]


def test_edited_texts_are_covered_about_as_a_diff_says():
    rng = random.Random(6)
    scanner = Scanner(TEMPLATES, 0.75)
    for name in ("mit", "bsd-3-clause", "apache-2.0-header", "isc"):
        ws = TEMPLATES[name].split()
        for k in rng.sample(range(len(ws)), len(ws) // 12):
            ws[k] = "changed"
        text = "Some words before, under the terms of a license. " * 40 + " ".join(ws) + " and after." * 50
        found = [f for f in scanner.scan(text) if f[0] == name]
        assert len(found) == 1
        diff = sum(m.size for m in SequenceMatcher(None, words(" ".join(ws)), words(TEMPLATES[name]), autojunk=False).get_matching_blocks())
        assert found[0][4] >= 0.95 * diff


def test_several_copies_in_one_text():
    scanner = Scanner(TEMPLATES, 0.75)
    text = " filler words here ".join([TEMPLATES["mit-notice"]] * 5 + [TEMPLATES["gpl-3.0-notice"]])
    assert [f[0] for f in scanner.scan(text)] == ["mit-notice"] * 5 + ["gpl-3.0-notice"]


def test_nulls_repeats_clashing_columns_and_long_texts(spark):
    text = "x y z " * 200_000 + TEMPLATES["mit"]
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, text, 1), (3, text, 1), (4, "license " * 20_000, 1), (None, TEMPLATES["unlicense"], 1)], "doc_id long, text string, coverage int")
    assert sorted((str(r.doc_id), r.license) for r in scan_licenses(docs).collect()) == [("3", "mit"), ("3", "mit"), ("None", "unlicense")]
    assert scan_licenses(docs.limit(0)).count() == 0


def test_whichever_words_are_changed():
    """At most a quarter of the words missing or replaced, the rarest ones first or any: whatever aligns well enough is found."""
    rng = random.Random(8)
    scanner = Scanner(TEMPLATES, 0.75)
    prose = [f"w{k}" for k in range(50)] + ["the", "of", "and", "to", "license", "software"]
    spread = Counter(w for t in scanner.templates.values() for w in set(t))
    for name, template in scanner.templates.items():
        n = len(template)
        for trial in range(12):
            changed = sorted(range(n), key=lambda k: (spread[template[k]], -len(template[k])))[:4] if trial == 0 and n > 20 else rng.sample(range(n), rng.randint(0, n - scanner._needed(n)))
            ws = [rng.choice(prose) if k in changed and rng.random() < 0.5 else w for k, w in enumerate(template) if k not in changed or rng.random() < 0.5]
            pairs = align(ws, template)
            around = [[rng.choice(prose) for _ in range(rng.randint(0, 300))] for _ in range(2)]
            found = [f for f in scanner.scan("\n".join(around[0] + ws + around[1])) if f[0] == name]
            if len(pairs) >= scanner._needed(n):
                assert found or any(f[4] >= len(pairs) for f in scanner.scan(" ".join(ws))), (name, trial)


def test_many_seeds_take_no_more_than_their_length():
    scanner = Scanner(TEMPLATES, 0.75)
    seconds = []
    for text in ("the software " * 16_000, "permission notice " * 16_000, "license or " * 16_000, "in the software or the use " * 4_000):
        began = time.perf_counter()
        scanner.scan(text)
        seconds.append(time.perf_counter() - began)
    assert max(seconds) < 3
