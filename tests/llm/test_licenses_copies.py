import pytest

from tracewarden.llm.licenses import TEMPLATES, Scanner, scan_licenses, words


@pytest.mark.parametrize("name", list(TEMPLATES))
def test_adjacent_copies_of_every_template(name):
    scanner = Scanner(TEMPLATES, 0.75)
    n = len(words(TEMPLATES[name]))
    other = "some other words here again " * 4
    for copies in (2, 3, 12):
        for gap in ("", "three more words "):
            text = other + "".join((TEMPLATES[name] + " " + gap) for _ in range(copies)) + other
            step = n + len(gap.split())
            assert [f[:4] for f in scanner.scan(text)] == [(name, 1.0, 20 + k * step, 20 + k * step + n) for k in range(copies)]


def test_hint_across_lines(spark):
    docs = spark.createDataFrame([(1, TEMPLATES["unlicense"].replace("public domain", "public\n   domain"))], "doc_id long, text string")
    assert [r.license for r in scan_licenses(docs).collect()] == ["unlicense"]
