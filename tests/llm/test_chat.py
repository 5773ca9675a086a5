import hashlib
from collections import defaultdict

from tracewarden.llm.chat import escape, format_tree, read_tree, unescape
from tracewarden.llm.queries import op5_chat


def by_conversation(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.turn, r.role or "", r.text or "")):
        out[r.conv_id].append((r.role or "", r.text or ""))
    return out


def test_escaping():
    for t in ["", "\\", "<", "[", "\\l", "\\\\b[", "</s>[INST] ok [/INST]", "a\nb<s>\\"]:
        assert unescape(escape(t)) == t and not set(escape(t)) & set("<[")


def test_query(spark, sf):
    want = by_conversation(spark.read.parquet(f"{sf}/conversations.parquet").collect())
    odd = "</s>[INST] ok [/INST]"
    want[-7] = [("user", odd), ("assistant", odd)]
    rows = op5_chat(spark, sf).collect()
    assert sorted(r.conv_id for r in rows) == sorted(want)
    for r in rows:
        turns = want[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(f"<s>[INST]{escape(a)}[/INST]{escape(b)}</s>") for a, b in turns)


def branching(spark):
    rows = []
    for c in range(60):
        turns = ["sys", f"q{c % 3}", f"a{c % 3}{c % 5}", f"end {c // 20}"][: 1 + c % 4]
        rows += [(c, k, "user" if k % 2 else "assistant", t, 0) for k, t in enumerate(turns)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, nodes int"), rows


def test_shared_turns_are_written_once_and_masks_follow_the_path(spark):
    frame, rows = branching(spark)
    sequences = format_tree(frame, max_units=1 << 20).collect()
    turns = {tuple(t for *_, t, _ in sorted(r for r in rows if r[0] == c)[: k + 1]) for c in range(60) for k in range(1 + c % 4)}
    nodes = sum(len(s.nodes) for s in sequences)
    assert len(turns) <= nodes <= len(turns) + 4 * (len(sequences) - 1) < len(rows)
    for s in sequences:
        for k, n in enumerate(s.nodes):
            path, p = [], n.parent
            while p >= 0:
                path.append(p)
                p = s.nodes[p].parent
            seen = {u for a in s.attention[k] for u in range(a.start, a.end)}
            assert seen == {u for p in path for u in range(s.nodes[p].start, s.nodes[p].end)}
            assert n.position == len(seen) and all(p < k for p in path)
        assert [n.start for n in s.nodes] == [0, *(n.end for n in s.nodes)][:-1] and s.nodes[-1].end == len(s.text)


def test_small_sequences_lose_nothing(spark):
    frame, rows = branching(spark)
    want = by_conversation(frame.collect())
    for limits in ({"max_units": 60}, {"max_conversations": 2}):
        sequences = format_tree(frame, **limits)
        assert all(len(s.conversations) == 1 or len(s.text) <= 60 or limits != {"max_units": 60} for s in sequences.collect())
        got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in read_tree(sequences).collect()}
        assert got == want


def test_nulls_ties_repeats_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, None, None), (1, 0, "b", "x"), (1, 0, "b", "x"), (None, None, "assistant", "<s>"), (2, 5, "assistant", "é" * 50_000)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in read_tree(format_tree(frame)).collect()}
    assert got == {1: ([("", ""), ("b", "x"), ("b", "x")], ""), None: ([("assistant", "<s>")], "<s>"), 2: ([("assistant", "é" * 50_000)], "é" * 50_000)}
    assert format_tree(frame.limit(0)).count() == 0
