"""All stages together, as the settings say."""

from tests.test_engine import CURL, doc, frame
from tracewarden.plans.agent import documents_from, noise_toggles, run_batch, run_stream
from tracewarden.sources.config import load_config
from tracewarden.sources.records import encode
from tracewarden.streaming.pipeline import nodes

CONFIG = load_config(None, {})


def rows():
    data = [doc(**CURL, pid=20, seq=1, at=1), doc(**CURL, pid=20, seq=2, at=2), doc(**CURL, pid=20, seq=3, at=3, ip="1.2.3.4", port=443)]
    data += [doc("which", "/tmp/which", args=["which", "ps"], pid=21, seq=4, at=4)]  # noise goes before any rule sees it
    data += [doc("x", "/tmp/x", pid=31, ppid=30, seq=5, at=5), doc("y", "/tmp/y", pid=32, ppid=31, seq=6, at=6), doc("true", pid=40, seq=7, at=7)]
    return data


def test_batch(spark):
    agents = spark.createDataFrame([("host-1", 30)], "host string, pid long")
    kept, dropped = run_batch(frame(spark, rows()), CONFIG, agents=agents)
    out = {r.seq: r for r in kept.collect()}
    assert sorted(out) == [1, 2, 3, 7]
    assert [out[k].edr.alert.dedup.is_duplicate for k in (1, 2, 3)] == [False, True, False] and out[7].edr.alert is None
    assert out[3].edr.correlation.rule_id == "corr-external-transfer-outbound-http" and out[3].edr.correlation.event_count == 2 and out[2].edr.correlation is None
    assert {r.seq: r.drop_reason for r in dropped.collect()} == {4: "process inventory polling noise", 5: "agent child event pid=31 ppid=30", 6: "agent child event pid=32 ppid=31"}


def test_stream_form_gives_the_same(spark):
    out = {r.seq: r for r in nodes(run_stream(frame(spark, rows()), CONFIG, agents=(30,))).collect()}
    assert sorted(out) == [1, 2, 3, 7] and out[2].dedup.is_duplicate and out[3].correlation.event_count == 2 and out[7].dedup is None


def test_settings(spark):
    off = load_config(None, {})
    off["filters"]["system_noise"]["enabled"] = off["deduplication"]["enabled"] = off["correlation"]["enabled"] = False
    kept, _ = run_batch(frame(spark, rows()), off)
    assert kept.count() == 7 and "alert" not in kept.select("edr.*").columns and "correlation" not in kept.select("edr.*").columns
    assert noise_toggles(CONFIG)["vscode"] and not any(noise_toggles(off).values())
    drop = load_config(None, {})
    drop["deduplication"]["mode"] = "drop"
    assert 2 not in {r.seq for r in run_batch(frame(spark, rows()), drop)[0].collect()}


def test_from_records(spark):
    raw = [(bytearray(r), k, float(k)) for k, r in enumerate(encode([{"event_type": 1, "pid": 5, "ppid": 1, "comm": "nc", "filename": "/bin/nc", "argv": ["nc", "-l"]}, {"event_type": 1, "pid": 6, "ppid": 1, "comm": "ls", "argv": ["ls"]}]))]
    docs = documents_from(spark.createDataFrame(raw, "raw binary, seq long, seen_at double"), "h", 10**18, 10**17)
    kept, _ = run_batch(docs, CONFIG)
    assert {r.seq: r.rule and r.rule.id for r in kept.collect()} == {0: "lab-process-suspicious-network-utility", 1: None}
