"""Documents from records to correlation, on hand-made rows."""

import hashlib
import random
import re
import time
from fnmatch import fnmatch

import pytest
from pyspark.sql import functions as F

from tracewarden.functions import nested, scalar
from tracewarden.operators import closure, correlate, dedup, enrich, filters, normalize, pairing, queue, serve
from tracewarden.plans.rule_compiler import ConditionError, detect, parse_condition, rule_predicate, with_matches
from tracewarden.schema import RECORD, UINT32_MAX
from tracewarden.sources.config import load_config
from tracewarden.sources.records import decode, encode
from tracewarden.sources.rules import CATALOGUE, Rule, load_rules, parse_rule

DOC = (
    "`@timestamp` string, event struct<kind:string,category:array<string>,type:array<string>,action:string>, host struct<hostname:string>, "
    "process struct<pid:long,parent:struct<pid:long>,name:string,executable:string,command_line:string,args:array<string>>, "
    "network struct<direction:string,transport:string,type:string>, destination struct<ip:string,port:int>, seen_at double, seq long"
)


def doc(name="bash", executable=None, args=None, line=None, pid=123, host="host-1", at=0.0, seq=0, ip=None, port=None, ts="2026-01-01T00:00:00.000Z", ppid=1):
    net = port is not None
    line = line if line is not None else (" ".join(args) if args else None)
    event = ("event", ["network"] if net else ["process"], ["connection"] if net else ["start"], "network_connection_attempt" if net else "process_started")
    return (ts, event, (host,), (pid, (ppid,), name, executable or f"/usr/bin/{name}", line, args), ("outbound", "tcp", "ipv4") if net else None, (ip, port) if net else None, float(at), seq)


def frame(spark, rows):
    return spark.createDataFrame(rows, DOC)


# ---- records and documents


def test_record_layout():
    assert RECORD.itemsize == 1088 and RECORD.fields["comm"][1] == 28 and RECORD.fields["argv"][1] == 300 and RECORD.fields["family"][1] == 1080


def test_records_become_documents(spark):
    a = int.from_bytes(bytes([8, 8, 8, 8]), "little")
    base = {"pid": 1234, "ppid": 1000, "uid": 0, "auid": UINT32_MAX}
    rows = encode(
        [
            {**base, "event_type": 1, "comm": b"bash\0garbage", "filename": "/usr/bin/bash", "argv": ["bash", "-c", "id x"]},
            {**base, "event_type": 3, "comm": "curl", "daddr": a, "dport": 53, "family": 2},
            {**base, "event_type": 4, "comm": "python3", "saddr": int.from_bytes(bytes([127, 0, 0, 1]), "little"), "sport": 43122, "family": 2},
            {**base, "event_type": 9, "comm": "x"},
            {**base, "event_type": 2, "comm": b"\0\0", "argv": ["", "lost"]},
        ]
    )
    raw = spark.createDataFrame([(k, bytearray(r)) for k, r in enumerate(rows)] + [(8, bytearray(100)), (9, None), (10, bytearray(rows[0] + b"more"))], "k long, raw binary")
    users = spark.createDataFrame([(0, "root")], "uid long, name string")
    docs = {r.k: r for r in normalize.normalize(normalize.with_user_names(decode(raw, "raw", ("k",)), users), "node1", 10**18, 5 * 10**17, keep=("k",)).collect()}
    assert sorted(docs) == [0, 1, 2, 4, 10]
    p = docs[0]
    assert (p.process.name, p.process.executable, p.process.args, p.process.args_count, p.process.command_line) == ("bash", "/usr/bin/bash", ["bash", "-c", "id x"], 3, "bash -c 'id x'")
    assert (p.event.kind, p.event.category, p.event.type, p.event.action) == ("event", ["process"], ["start"], "process_started")
    assert (p.user.id, p.user.name, p.user.audit.id, p.user.audit.name) == ("0", "root", "-1", "unset")
    assert p.host.hostname == "node1" and p.network is None and p.source is None and p["@timestamp"] == "2001-09-09T01:46:40.000Z"
    assert (docs[1].destination.ip, docs[1].destination.port, docs[1].network.direction, docs[1].source) == ("8.8.8.8", 53, "outbound", None)
    assert (docs[2].source.ip, docs[2].source.port, docs[2].network.direction, docs[2].destination) == ("127.0.0.1", 43122, "inbound", None)
    assert docs[4].process.name is None and docs[4].process.args is None and docs[10].process.name == "bash"


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.clean_text(F.lit("bash\0garbage")).alias("a"), scalar.clean_text(F.lit("\0\0")).alias("b"), scalar.ipv4(F.lit(0)).alias("c"), scalar.port(F.lit(0)).alias("d"), scalar.port(F.lit(65535)).alias("e"), scalar.port(F.lit(70000)).alias("f"),
        scalar.basename(F.lit("/usr/bin/")).alias("g"), scalar.basename(F.lit("")).alias("h"), scalar.basename(F.lit(None).cast("string")).alias("i"), scalar.backoff_seconds(F.lit(100)).alias("j"), scalar.backoff_seconds(F.lit(3), jitter=F.lit(0.1)).alias("k"),
        scalar.shell_join(F.array(F.lit("a"), F.lit(""), F.lit("it's"), F.lit("é"), F.lit("x\n"))).alias("l"),
    ).first()
    assert tuple(row)[:11] == ("bash", None, None, None, 65535, None, "bin", "", None, 60.0, 17.6)
    import shlex

    assert row.l == shlex.join(["a", "", "it's", "é", "x\n"])
    assert [scalar.clamp_limit(v, 5) for v in ("7", 0, 1000, None, "x")] == [7, 1, 100, 5, 5]


def test_pruning_and_paths(spark):
    df = spark.createDataFrame([(1, ("", [""], (None,), 0)), (2, (None, [], (None,), None)), (3, ("a", ["", "b"], ("c",), 5))], "k int, d struct<s:string,l:array<string>,n:struct<x:string>,i:int>")
    got = {r.k: r.d for r in nested.prune_empty(df).collect()}
    assert got[1].asDict(True) == {"s": None, "l": None, "n": None, "i": 0} and got[2] is None and got[3].asDict(True) == {"s": "a", "l": ["b"], "n": {"x": "c"}, "i": 5}
    assert nested.flatten(df).columns == ["k", "d.s", "d.l", "d.n.x", "d.i"]
    assert [r[0] for r in df.select(nested.get(df, "d.n.x").alias("v")).collect()] == [None, None, "c"] and df.select(nested.get(df, "d.q.x")).first()[0] is None


# ---- filters


def test_self_filter(spark):
    rows = [("h", 0, 7001, 5001), ("h", 1, 5000, 1000), ("h", 2, 5001, 5000), ("h", 3, 5002, 5001), ("h", 4, 6000, 1000), ("h", 5, 5001, 1), ("i", 6, 5001, 5000), ("h", 7, 7001, 5001)]
    events = spark.createDataFrame(rows, "host string, seq long, pid long, ppid long")
    out = {r.seq: r.drop_reason for r in closure.self_reason(events, spark.createDataFrame([("h", 5000)], "host string, pid long")).collect()}
    assert out == {0: None, 1: "agent self event pid=5000", 2: "agent child event pid=5001 ppid=5000", 3: "agent child event pid=5002 ppid=5001", 4: None, 5: "agent self event pid=5001", 6: None, 7: "agent child event pid=7001 ppid=5001"}


def test_self_filter_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [("h", k, rng.randrange(40), rng.randrange(40)) for k in range(400)]
    known, want = {3}, {}
    for _, k, pid, ppid in rows:
        want[k] = f"agent self event pid={pid}" if pid in known else f"agent child event pid={pid} ppid={ppid}" if ppid in known else None
        if want[k]:
            known.add(pid)
    got = closure.self_reason(spark.createDataFrame(rows, "host string, seq long, pid long, ppid long"), spark.createDataFrame([("h", 3)], "host string, pid long"))
    assert {r.seq: r.drop_reason for r in got.collect()} == want


NOISE = [
    (("sh", "/home/ubuntu/.vscode-server/server/out/cpuUsage.sh", None, ["/home/ubuntu/.vscode-server/server/out/cpuUsage.sh", "1234"]), "vscode"),
    (("cpuUsage.sh", "/usr/bin/cat", None, ["cat", "/proc/1234/stat"]), "proc_polling"),
    (("x", "/usr/bin/sed", None, ["sed", "-n", r"s/^cpu\s//p", "/proc/stat"]), "proc_polling"),
    (("cat", "/usr/bin/cat", None, ["cat", "/proc/12/stat\n"]), "proc_polling"),
    (("sh", "/usr/bin/which", None, ["which", "ps"]), "process_inventory"),
    (("sh", "/bin/sh", "/bin/sh -c 'which ps'", None), "process_inventory"),
    (("MainThread", "/usr/bin/git", None, ["git", "worktree", "list", "--porcelain"]), "git"),
    (("git", None, None, ["git", "for-each-ref", "x"]), "git"),
    (("git", None, "git rev-parse --git-dir", ["git", "rev-parse", "HEAD"]), None),
    (("git", None, "git rev-parse --git-dir", None), "git"),
    (("dircolors", None, "lesspipe", None), None),
    (("dash", None, "lesspipe", None), "shell_startup"),
    (("node", "/x/node", "VSCODE y", None), "vscode"),
    (("python3", None, "python3 event_receiver_server.py", None), "event_receiver"),
    (("bash", "/usr/bin/cat", None, ["cat", "/etc/passwd"]), None),
    (("sleep", None, "sleep 1", None), None),
    ((None, None, None, None), None),
]


def test_noise(spark):
    df = spark.createDataFrame([(k, *row) for k, (row, _) in enumerate(NOISE)], "k int, n string, x string, c string, a array<string>")
    cols = [F.col(c) for c in "nxca"]
    got = {r.k: r.r for r in df.select("k", filters.noise_reason(*cols).alias("r")).collect()}
    assert got == {k: filters.REASONS.get(want) for k, (_, want) in enumerate(NOISE)}
    on = df.where("n = 'sleep'").select(filters.noise_reason(*cols, sleep_polling=True)).first()[0]
    assert on == "known sleep polling noise"
    assert df.where("k = 0").select(filters.noise_reason(*cols, vscode=False)).first()[0] == "procfs polling noise"
    with pytest.raises(ValueError):
        filters.noise_reason(*cols, no_such=True)


# ---- rules


def test_shipped_rules(spark):
    rows = [
        (doc("curl", args=["curl", "http://example.com"]), "lab-process-curl-wget-external-url"),
        (doc("true", args=["/usr/bin/true"]), None),
        (doc("cat", args=["cat", "/etc/passwd"]), "lab-process-sensitive-account-file-read"),
        (doc("bash", ip="10.10.10.10", port=4444), "lab-network-outbound-reverse-shell-port"),
        (doc("bash", args=["bash", "-c", "id"]), "lab-process-shell-inline-command"),
        (doc("CURL", ip="104.20.23.154", port=80), "lab-network-curl-outbound-http"),
        (doc("x", "/TMP/x"), "lab-process-execution-from-writable-tmp"),
        (doc("nc", "/tmp/nc"), "lab-process-execution-from-writable-tmp"),
    ]
    df = frame(spark, [(*d[:7], k) for k, (d, _) in enumerate(rows)])
    out = {r.seq: r for r in detect(df, CATALOGUE).collect()}
    assert {k: r.edr.detection.rule_id for k, r in out.items()} == {k: want for k, (_, want) in enumerate(rows)}
    hit = out[7]
    assert hit.event.kind == "alert" and hit.rule.level == "high" and [m.rule_id for m in hit.edr.detection.matches][1] == "lab-process-suspicious-network-utility" and hit.edr.detection.engine == "sigma_edge"
    assert out[1].event.kind == "event" and out[1].rule is None and out[1].edr.detection.matched is False
    off = detect(df, CATALOGUE, enabled=False).first()
    assert not off.edr.detection.matched and off.edr.detection.reason == "sigma engine disabled"


def test_rule_files(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b/z.yml").write_text("title: Z\nid: z\ntags: one\ndetection:\n  s:\n    a: 1\n  condition: s\n")
    (tmp_path / "a.yaml").write_text("detection:\n  s: {}\n  condition: s\n")
    (tmp_path / "bad.yml").write_text("a: [1")
    (tmp_path / "none.yml").write_text("title: x\ndetection:\n  s: {}\n  condition: '  '\n")
    rules = load_rules(str(tmp_path))
    assert [(r.id, r.title, r.level, r.tags) for r in rules] == [("z", "Z", "informational", ("one",)), ("a", "a", "informational", ())]
    assert parse_rule([]) is None and len(CATALOGUE) == 7


def plain(detection, row, compat):
    """An evaluator of our own, over a flat dict."""

    def test(value, expected, mods):
        a, b = str(value).lower(), str(expected).lower()
        if "contains" in mods:
            return b in a
        if "startswith" in mods:
            return a.startswith(b)
        if "endswith" in mods:
            return a.endswith(b)
        return bool(re.search(str(expected), str(value), re.I)) if "re" in mods else a == b

    def field(name, expected):
        path, *mods = name.split("|")
        value = row.get(path)
        if value is None:
            return False
        values = expected if isinstance(expected, list) else [expected]
        items = value if isinstance(value, list) else [value]
        tests = [any(test(i, v, mods) for i in items if i is not None) for v in values]
        return all(tests) if "all" in mods else any(tests)

    def selection(s):
        if isinstance(s, dict):
            return all(field(k, v) for k, v in s.items())
        return isinstance(s, list) and any(selection(x) for x in s if isinstance(x, (dict, list)))

    of = {k: selection(s) for k, s in detection.items() if k != "condition"}
    tokens = re.findall(r"[()]|[^\s()]+", detection["condition"])

    class Stop(Exception):
        pass

    def parse(tokens):
        def primary():
            t = tokens.pop(0)
            if t == "(":
                v = chain_or()
                if not tokens or tokens.pop(0) != ")":
                    raise Stop
                return v
            if tokens and tokens[0] == "of":
                tokens.pop(0)
                found = [v for k, v in of.items() if fnmatch(k, tokens[0])]
                tokens.pop(0)
                return bool(found) and (all(found) if t == "all" else any(found))
            return of.get(t, False)

        def negation():
            if tokens[0] == "not":
                tokens.pop(0)
                return not negation()
            return primary()

        def chain(word, below, stop):
            v = below()
            while tokens and tokens[0] == word:
                tokens.pop(0)
                if compat and v == stop:  # the right side is never read
                    continue
                w = below()
                v = (v or w) if word == "or" else (v and w)
            return v

        def chain_and():
            return chain("and", negation, False)

        def chain_or():
            return chain("or", chain_and, True)

        v = chain_or()
        if tokens:
            raise Stop
        return v

    try:
        return parse(tokens)
    except Stop:
        return False


@pytest.mark.parametrize("compat", [False, True])
def test_random_rules_against_a_plain_evaluator(spark, compat):
    rng = random.Random(7)
    data = [{"a": rng.choice(["Ab", "b", "abc", None, ""]), "n": rng.choice([1, 12, None]), "l": rng.choice([["x", "Ay"], [], None, [None, "b"]])} for _ in range(60)]
    df = spark.createDataFrame([(k, (r["a"], r["n"]), r["l"]) for k, r in enumerate(data)], "k int, d struct<a:string,n:int>, l array<string>")
    flat = [{"d.a": r["a"], "d.n": r["n"], "l": r["l"]} for r in data]

    def selection(depth=0):
        if depth < 2 and rng.random() < 0.2:
            return [selection(depth + 1) for _ in range(rng.randint(0, 2))] + (["word"] if rng.random() < 0.3 else [])
        out = {}
        for _ in range(rng.randint(0, 2)):
            mods = rng.choice(["", "|contains", "|startswith", "|endswith", "|re", "|contains|all"])
            values = [rng.choice(["a", "B", "ab", "1", 12, "x", "y"]) for _ in range(rng.randint(0, 2))]
            out[rng.choice(["d.a", "d.n", "l", "gone.x"]) + mods] = values if rng.random() < 0.6 else rng.choice(["a", "b", 1, "^a"])
        return out

    def condition(depth=0):
        if depth > 2 or rng.random() < 0.3:
            return rng.choice(["s1", "s2", "t1", "nope", "1 of s*", "all of s*", "1 of q*"])
        return rng.choice(["({} or {})", "{} and {}", "({} and {})", "{} or {}", "not {}"]).format(condition(depth + 1), condition(depth + 1))

    rules = [Rule(f"r{k}", "t", detection={"s1": selection(), "s2": selection(), "t1": selection(), "condition": condition()}) for k in range(60)]
    got = {r.k: {m.rule_id for m in r.matches} for r in with_matches(df, rules, compat, per_step=25).collect()}
    want = {k: {r.id for r in rules if plain(r.detection, row, compat)} for k, row in enumerate(flat)}
    assert got == want


def test_conditions_and_odd_rules(spark):
    for bad in ("", "a and", "(a", "a b", "and a", "2 of a", "a )"):
        with pytest.raises(ConditionError):
            parse_condition(bad, ["a"])
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.warns(UserWarning):
        assert df.where(rule_predicate(df.schema, Rule("r", "r", detection={"s": {"a|cidr": "X"}, "condition": "s"}))).count() == 1
    with pytest.raises(ValueError):
        rule_predicate(df.schema, Rule("r", "r", detection={"s": {"a|cidr": "X"}, "condition": "s"}), strict=True)


# ---- enrichment


def test_enrichment(spark):
    docs = frame(spark, [doc("bash", "/bin/old", ["bash"], pid=p, seq=p, at=p) for p in (123, 5, 6, 7, 0)] + [(*doc(pid=None)[:7], 9)])
    docs = docs.withColumn("process", F.when(F.col("seq") == 6, F.col("process").withField("command_line", F.lit(None).cast("string")).withField("executable", F.lit(None).cast("string"))).otherwise(F.col("process")))
    snap = spark.createDataFrame([("host-1", 123, bytearray(b"curl\0-s\0\0http://e \0"), None, "/usr/bin/curl", None, "a" * 64, None), ("host-1", 5, bytearray(b""), None, None, "permission_denied", None, "os_error")], enrich.SNAPSHOT)
    out = {r.seq: r for r in enrich.enrich(docs, snap).collect()}
    p, s = out[123].process, out[123].edr.enrichment.proc
    assert (p.name, p.executable, p.command_line, p.hash.sha256) == ("curl", "/usr/bin/curl", "curl -s http://e", "a" * 64) and s.enriched and s.reason is None
    p, s = out[5].process, out[5].edr.enrichment.proc
    assert (p.name, p.executable, p.command_line, p.hash) == ("old", "/bin/old", "bash", None) and not s.enriched
    assert (s.command_line_status, s.executable_status, s.hash_status, s.reason) == ("empty", "permission_denied", "os_error", "executable=permission_denied; hash=os_error")
    p, s = out[6].process, out[6].edr.enrichment.proc
    assert (p.command_line, p.executable, p.name) == ("unknown (short-lived process)", "unknown (short-lived process)", "bash") and s.reason == "command_line=short_lived; executable=short_lived; hash=short_lived"
    for k in (0, 9):
        assert out[k].edr.enrichment.proc.command_line_status == "skipped" and out[k].edr.enrichment.proc.reason == "missing or invalid process.pid"


def test_as_of(spark):
    left = spark.createDataFrame([("a", 1, 5), ("a", 2, 10), ("b", 3, 1)], "k string, id int, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("a", 11, "z"), ("b", 2, "w")], "k string, s int, v string")
    assert sorted(map(tuple, enrich.as_of(left, right, ["k"], "t", "s", ["v"]).select("id", "v").collect())) == [(1, "x"), (2, "y"), (3, None)]


def test_pairing(spark):
    rows = [(1, 1, "in", 0), (1, 2, "out", 0), (1, 3, "out", 0), (2, 1, "in", 0), (2, 2, "in", 0), (2, 3, "out", 0), (3, 1, "in", 0), (3, 2, "out", -1), (3, 3, "out", 0)]
    df = spark.createDataFrame(rows, "k int, t int, kind string, ret int")
    out = pairing.pair(df, "k", ["t"], F.col("kind") == "in", F.col("kind") == "out", ["t"], F.col("ret") >= 0)
    assert sorted((r.k, r.t, r.enter_t) for r in out.collect()) == [(1, 2, 1), (2, 3, 2)]


# ---- sessions


def alerts(spark, rows):
    return detect(frame(spark, rows), CATALOGUE)


CURL = dict(name="curl", executable="/usr/bin/curl", line="curl http://example.com")


def test_dedup(spark):
    def run(rows, **kw):
        return {r.seq: r.edr.alert.dedup if r.edr.alert else None for r in dedup.dedup_alerts(alerts(spark, rows), **kw).collect()}

    net = lambda at, seq, ip="104.20.23.154", ts="t0": doc(**CURL, at=at, seq=seq, ip=ip, port=80, ts=ts)
    out = run([net(0, 1, ts="t1"), net(0, 2, "172.66.147.243", "t2"), net(4, 3, ts="t3"), net(8, 4), net(13, 5), doc("true", seq=6), net(0, 7)[:2] + (("other",),) + net(0, 7)[3:]])
    assert [(out[k].is_duplicate, out[k]["count"]) for k in (1, 2, 3, 4, 5)] == [(False, 1), (True, 2), (True, 3), (True, 4), (False, 1)]
    assert out[6] is None and out[7]["count"] == 1 and out[7].group_id != out[1].group_id == out[5].group_id
    assert (out[2].destination_ips, out[2].unique_destinations, out[2].destination_ports, out[2].first_seen, out[2].last_seen, out[2].reason) == (["104.20.23.154", "172.66.147.243"], 2, [80], "t1", "t2", dedup.DUPLICATE)
    parts = ["host-1", "lab-network-curl-outbound-http", "network", "connection", "123", "/usr/bin/curl", "curl http://example.com", "curl", "80"]
    assert out[1].group_id == hashlib.sha256("|".join(parts).encode()).hexdigest()
    assert sorted(run([net(0, 1), net(1, 2)], mode="drop")) == [1]
    split = run([net(0, 1), net(1, 2, "9.9.9.9")], include_destination_ip=True)
    assert not split[2].is_duplicate
    for bad in (dict(window_seconds=0), dict(mode="x")):
        with pytest.raises(ValueError):
            dedup.dedup_alerts(alerts(spark, [net(0, 1)]), **bad)
    assert "alert" not in dedup.dedup_alerts(alerts(spark, [net(0, 1)]), enabled=False).select("edr.*").columns


# ---- correlation

SHELL = dict(name="bash", executable="/usr/bin/bash", args=["bash", "-c", "id"])


def test_correlation(spark):
    def run(rows, dup=None, **kw):
        d = alerts(spark, rows)
        if dup is not None:
            d = d.withColumn("edr", F.col("edr").withField("alert", F.struct(F.struct(F.col("seq").isin(dup).alias("is_duplicate")).alias("dedup"))))
        return {r.seq: r.edr.correlation for r in correlate.correlate_alerts(d, **kw).collect()}

    process = lambda **k: doc(**CURL, **k)
    net = lambda **k: doc(**CURL, ip="1.2.3.4", port=80, **k)
    out = run([process(seq=1, ts="t1"), net(seq=2, at=60, ts="t2")])
    c = out[2]
    assert out[1] is None and (c.rule_id, c.severity, c.event_count, c.first_seen, c.last_seen) == ("corr-external-transfer-outbound-http", "high", 2, "t1", "t2")
    assert c.related_rules == ["lab-network-curl-outbound-http", "lab-process-curl-wget-external-url"] and [p.name for p in c.related_processes] == ["curl"] and [(d.ip, d.port) for d in c.related_destinations] == [("1.2.3.4", 80)]
    ident = "|".join([c.rule_id, "host-1", "123", "1", "curl http://example.com", ",".join(c.related_rules)])
    assert c.correlation_id == hashlib.sha256(ident.encode()).hexdigest()
    assert run([process(seq=1), net(seq=2, at=60.1)])[2] is None  # older than the window
    assert run([net(seq=1), process(seq=2, at=1)])[2].rule_id == "corr-external-transfer-outbound-http"  # order is free
    third = run([process(seq=1), net(seq=2), doc("nc", "/x/nc", line="curl http://example.com", seq=3, at=3)])
    assert third[3].event_count == 3  # any later alert in the scope
    assert run([process(seq=1, pid=1), net(seq=2, pid=2)])[2] is not None  # same command line
    assert run([doc("x", "/tmp/a", line="a", seq=1, pid=500), doc("y", line="b", seq=2, pid=600, ip="1.1.1.1", port=4444)])[2] is None
    tmp = run([doc("x", "/tmp/a", line="a", seq=1), doc("x", line="b", seq=2, ip="1.1.1.1", port=4444)])
    assert tmp[2].severity == "critical"
    assert run([doc(**SHELL, seq=1), net(seq=2)])[2].rule_id == "corr-shell-inline-network-activity"
    assert run([process(seq=1), net(seq=2)], dup=[2])[2] is None and run([process(seq=1), net(seq=2)], dup=[2], ignore_duplicates=False)[2] is not None
    assert run([process(seq=1, host=None), net(seq=2, host=None)])[2] is not None
    with pytest.raises(ValueError):
        run([process()], window_seconds=0)


def test_scope_keeps_the_newest(spark):
    rows = [(k, k // 4, "s", str(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "seq long, t long, scope string, v string")
    for cap in (3, 100):
        got = {r.seq: [o.seq for o in r.related] for r in correlate.related(df, F.array("scope"), F.col("t"), F.col("seq"), F.col("v"), F.col("v"), 2.0, cap).collect()}
        want = {k: [j for j in range(max(0, k - cap), k) if j // 4 >= k // 4 - 2] + [k] for k in range(30)}
        assert got == want


def test_numbers_without_lists(spark):
    rng = random.Random(5)
    rows = [doc("curl", "/usr/bin/curl", line=rng.choice(["curl http://a", "curl http://b", None]), pid=rng.choice([1, 2, None]), seq=k, at=float(rng.randrange(40)), ts=f"t{k}", **rng.choice([{}, {"ip": "1.1.1.1", "port": 80}])) for k in range(200)]
    rows += [(*r[:-1], 1000 + r[-1]) for r in rng.sample(rows, 40)]  # the same events once more
    d = alerts(spark, rows).where("edr.detection.matched")
    pid, line = correlate._scope_pair(False)
    rule = F.col("edr.detection.rule_id")
    key = scalar.key_hash(F.col("@timestamp"), rule, F.col("process.pid"), F.col("process.command_line"))
    for window, cap in ((9.0, 1000), (9.0, 2000), (30.0, 7)):
        seen = correlate.related(d, correlate.alert_scopes(), F.col("seen_at"), F.col("seq"), key, rule, window, cap).collect()
        want = {r.seq: (len(r.related), sorted({o.payload for o in r.related})) for r in seen}
        found = correlate.counted(d, pid, line, F.col("seen_at"), F.col("seq"), key, rule, window, cap).collect()
        assert len(want) > 100 and {r.seq: (r.event_count, r.ids) for r in found} == want


def test_dense_scope_in_linear_time(spark):
    """An observation's lists aren't made where only their number is asked for: 20,000 alerts of one scope within one window."""
    base = alerts(spark, [doc(**CURL, seq=1), doc(**CURL, seq=2, ip="1.2.3.4", port=80)])
    many = base.crossJoin(spark.range(10_000).withColumnRenamed("id", "k")).withColumn("seq", F.col("k") * 2 + F.col("seq")).withColumn("@timestamp", F.col("seq").cast("string")).drop("k")
    begun = time.monotonic()
    found = correlate.correlate_alerts(many, max_per_scope=100_000, details=False).where("edr.correlation.matched").agg(F.count("*"), F.max("edr.correlation.event_count")).first()
    assert tuple(found) == (19_999, 20_000) and time.monotonic() - begun < 60


# ---- queue and serving


def test_queue(spark):
    q = spark.createDataFrame([(k, float(k), k, 10.0 * k, f"p{k}", None) for k in range(1, 6)], queue.QUEUE)
    assert [r.id for r in queue.ready(q, 30.0, 2).collect()] == [1, 2]
    ids = q.where("id in (2, 3)").select("id")
    assert sorted(r.id for r in queue.delivered(q, ids).collect()) == [1, 4, 5]
    f = {r.id: r for r in queue.failed(q, ids, "x" * 2000, 100.0, 7.0).collect()}
    assert (f[2].attempts, f[2].next_attempt_at, len(f[2].last_error)) == (3, 107.0, 1024) and f[1].attempts == 1 and f[1].last_error is None
    assert sorted(r.id for r in queue.retain_rows(q, 2).collect()) == [4, 5] and queue.retain_rows(q, 0).count() == 0
    assert sorted(r.id for r in queue.shed_oldest(q, 10, 5).collect()) == [2, 3, 4, 5] and queue.shed_oldest(q, 5, 5) is q
    held = queue.size_bytes(q)
    assert held > 0 and queue.shed_oldest(q, None, held) is q and queue.shed_oldest(q, None, held - 1).count() == 4
    more = queue.insert(q, q.select("payload").limit(2), 9.0)
    assert more.count() == 7 and more.select("id").distinct().count() == 7 and {r.id > 5 for r in queue.ready(more.where("created_at = 9.0"), 9.0, 5).collect()} == {True}
    many = q.sparkSession.range(0, 50_000).selectExpr("id * 7 - 1000 as id")
    assert [queue.id_at(many, k, few=10, parts=16) for k in (1, 2, 25_000, 50_000)] == [-1000, -993, 24_999 * 7 - 1000, 49_999 * 7 - 1000]


def test_serving(spark, tmp_path):
    (tmp_path / "log").write_text('{"received_at": "1", "event": {}}\nbroken\n{"received_at": "2"}\n')
    lines = serve.read_json_lines(spark, str(tmp_path / "log"))
    assert [r.received_at for r in serve.tail_json(lines, "position", "value", 2, "received_at string").collect()] == ["2"]
    bodies = spark.createDataFrame([("",), ("{",), ("{}",), ('[{"a": 1}, {}]',), (None,)], "b string")
    assert [(r.status, r.received) for r in serve.accept_batch(bodies, "b", "struct<a:int>").collect()] == [(400, 0), (400, 0), (400, 0), (200, 2), (400, 0)]


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("deduplication:\n  window_seconds: 9\n")
    c = load_config(str(tmp_path / "c.yml"), {"EDR_OUTPUT_MODE": "HTTP", "EDR_HTTP_BATCH_SIZE": "10", "EDR_OUTPUT_DEBUG": "yes"})
    assert c["deduplication"] == {"enabled": True, "mode": "mark", "window_seconds": 9} and c["output"] == {"mode": "http", "debug": True} and c["http"]["batch_size"] == 10
    (tmp_path / "bad.yml").write_text("- 1\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "bad.yml"), {})
    with pytest.raises(FileNotFoundError):
        load_config(str(tmp_path / "none.yml"), {})
