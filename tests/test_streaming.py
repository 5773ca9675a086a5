"""Batch and stream give the same rows; sinks deliver at least once."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tests.test_engine import CURL, DOC, SHELL, doc, frame
from tracewarden.operators import correlate, dedup
from tracewarden.plans.rule_compiler import detect
from tracewarden.sources.rules import CATALOGUE
from tracewarden.streaming import sinks
from tracewarden.streaming.pipeline import nodes, stateful, stateless, with_event_id
from tracewarden.streaming.state import Correlator, Deduplicator, HostState


def make():
    return HostState(set(), Deduplicator(), Correlator())


def rows(n=160, seed=3):
    rng = random.Random(seed)
    out, at = [], 0.0
    for k in range(n):
        at += rng.choice([0, 0, 1, 2.5, 5, 20])
        host, pid, ts = f"h{rng.randrange(3)}", rng.randrange(4), f"t{k:05d}"
        kind = rng.randrange(5)
        common = dict(host=host, pid=pid, at=at, seq=k, ts=ts)
        if kind == 0:
            out.append(doc(**CURL, **common))
        elif kind == 1:
            out.append(doc(**CURL, ip=f"1.1.1.{rng.randrange(3)}", port=80, **common))
        elif kind == 2:
            out.append(doc(**SHELL, **common))
        elif kind == 3:
            out.append(doc("x", "/tmp/a", line="a", **common))
        else:
            out.append(doc("true", line="true", **common))
    return out


def shown(df):
    return {r.seq: (r.dedup and r.dedup.asDict(True), r.correlation and r.correlation.asDict(True)) for r in nodes(df).collect()}


def test_window_form_and_state_form_agree(spark):
    docs = detect(frame(spark, rows()), CATALOGUE)
    batch = correlate.correlate_alerts(dedup.dedup_alerts(docs))
    want = {r.seq: (r.edr.alert and r.edr.alert.dedup.asDict(True), r.edr.correlation and r.edr.correlation.asDict(True)) for r in batch.collect()}
    got = shown(stateful(docs, make))
    assert got == want and sum(v[1] is not None for v in want.values()) > 10 and sum(bool(v[0] and v[0]["is_duplicate"]) for v in want.values()) >= 3


def test_stream_and_batch_agree(spark, tmp_path):
    data = rows()
    for k in range(4):
        frame(spark, data[40 * k : 40 * k + 40]).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    want = shown(stateful(stateless(frame(spark, data), CATALOGUE), make))
    source = spark.readStream.schema(spark.createDataFrame([], DOC).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = stateful(stateless(source, CATALOGUE), make)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    assert shown(spark.read.parquet(str(tmp_path / "out"))) == want


def test_self_filter_noise_and_drop_mode(spark):
    data = [doc("true", pid=9, ppid=1, seq=1, host="h"), doc("true", pid=10, ppid=9, seq=2, host="h"), doc("true", pid=11, ppid=10, seq=3, at=1, host="h"), doc("which", args=["which", "ps"], pid=12, ppid=1, seq=4, host="h")]
    data += [doc(**CURL, seq=5, at=2, host="h", pid=20), doc(**CURL, seq=6, at=3, host="h", pid=20)]
    factory = lambda: HostState({9}, Deduplicator(mode="drop"), None)
    assert sorted(shown(stateful(stateless(frame(spark, data), CATALOGUE), factory))) == [5]


def test_eviction():
    d = Deduplicator(max_groups=2)
    for k, key in enumerate("abc"):
        d.add(key, float(k), "t", None, None)
    assert list(d.groups) == ["b", "c"]
    assert d.add("b", 3.0, "t", None, None)["count"] == 2 and d.add("a", 3.5, "t", None, None)["count"] == 1
    with pytest.raises(ValueError):
        Deduplicator(max_groups=0)


class Receiver(BaseHTTPRequestHandler):
    answers: list = []
    got: list = []

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        code = self.answers.pop(0) if self.answers else 200
        if code == 200:
            self.got.append((json.loads(body), self.headers.get("Authorization")))
        self.send_response(code)
        self.end_headers()

    def log_message(self, *args):
        pass


@pytest.fixture
def receiver():
    Receiver.answers, Receiver.got = [], []
    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/"
    server.shutdown()


def test_http_sink(spark, receiver, tmp_path):
    df = with_event_id(spark.range(7).select(F.to_json(F.struct("id")).alias("document"), F.col("id")), "id").coalesce(1)
    Receiver.answers = [503]
    sinks.HttpSink(receiver, batch_size=3, token="t", base=0.01).write(df)
    assert sorted(e["id"] for body, _ in Receiver.got for e in body) == list(range(7)) and {a for _, a in Receiver.got} == {"Bearer t"} and len(Receiver.got) == 3
    Receiver.answers, Receiver.got = [400, 200, 500, 500], []
    sinks.HttpSink(receiver, batch_size=3, tries=2, base=0.01, undelivered=str(tmp_path / "left")).write(df)
    left = spark.read.parquet(str(tmp_path / "left")).collect()
    assert sorted((r.attempts, r.retryable, r.last_error) for r in left) == [(1, False, "HTTP 400")] * 3 + [(2, True, "HTTP 500")]
    Receiver.answers = [404]
    with pytest.raises(Exception, match="delivery failed"):
        sinks.HttpSink(receiver, tries=1).write(df)
    ids = [r.event_id for r in df.collect()]
    assert ids == [r.event_id for r in df.collect()] and len(set(ids)) == 7


def test_console(spark, capsys):
    sinks.ConsoleSink()(spark.createDataFrame([('{"a":1}',)], "document string"), 0)
    assert capsys.readouterr().out == '{"a":1}\n'


def test_delivery_rules(spark, tmp_path):
    assert [sinks.is_retryable(s) for s in (None, 408, 429, 500, 404, 200)] == [True, True, True, True, False, False]
    rng = random.Random(1)
    assert all(8 <= sinks.backoff(2, 2, 60, rng) <= 8.8 for _ in range(50)) and sinks.backoff(9, 2, 60, rng) == 60
    answer, attempts = sinks.deliver(["{}"], "http://127.0.0.1:9/", 0.5, None, 2, 0, 0, rng)
    assert not answer.success and answer.retryable and attempts == 2
    sinks.JsonLinesSink(str(tmp_path / "log")).write(spark.createDataFrame([('{"a":1}', "i")], "document string, event_id string"))
    line = json.loads(spark.read.text(str(tmp_path / "log")).first().value)
    assert line["event"] == {"a": 1} and line["received_at"].endswith("Z")
    assert sinks.compact({"a": "é"}) == '{"a":"é"}' and sinks.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first().value == '{"a":1}'
