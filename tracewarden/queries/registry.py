"""Each operator on the driver's tables, and the same rows in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested, scalar
from ..operators import closure, correlate, dedup, enrich, filters, normalize, pairing, queue, serve
from ..plans.rule_compiler import detect, with_matches
from ..sources.records import decode
from ..sources.rules import CATALOGUE, Rule
from . import fixtures
from .fixtures import micros

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HOUR = 3_600_000_000
DAY = 24 * HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- rules


def rule_query(name: str, table: str, key: str, detection: dict, where: str, compat: bool = False, prepare=lambda df: df) -> None:
    """Keys of the rows that a rule matches."""
    rule = Rule(name, name, detection=detection if "condition" in detection else {"s": detection, "condition": "s"})

    def run(spark: SparkSession, d: str) -> DataFrame:
        return with_matches(prepare(_t(spark, d, table)), [rule], compat).where(F.size("matches") > 0).select(key)

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT {key} FROM {table} WHERE {where}"


rule_query("rule_equals", "events", "event_id", {"event_type": "ERROR"}, "lower(event_type) = 'error'")
rule_query("rule_in_list", "events", "event_id", {"event_type": ["error", "Purchase"]}, "event_type IN ('error', 'purchase')")
rule_query("rule_number", "events", "event_id", {"user_id": [7, "8"]}, "user_id IN (7, 8)")
rule_query("rule_contains", "documents", "doc_id", {"text|contains": "LICENSED"}, "contains(lower(text), 'licensed')")
rule_query("rule_startswith", "pages", "page_id", {"url|startswith": "HTTPS://www."}, "starts_with(lower(url), 'https://www.')")
rule_query("rule_endswith", "documents", "doc_id", {"text|endswith": "."}, "text LIKE '%.'")
rule_query("rule_regex", "pages", "page_id", {"url|re": r"/(EN|de)/[0-9]+\Z"}, "regexp_matches(url, '/(en|de)/[0-9]+$', 'i')")
rule_query("rule_bad_regex", "pages", "page_id", {"url|re": "(unclosed"}, "false")
rule_query("rule_all_modifier", "documents", "doc_id", {"text|contains|all": ["the", "and"]}, "contains(lower(text), 'the') AND contains(lower(text), 'and')")
rule_query("rule_modifier_precedence", "pages", "page_id", {"url|endswith|contains": "example"}, "contains(lower(url), 'example')")
rule_query("rule_unknown_modifier", "events", "event_id", {"event_type|cidr": "Error"}, "event_type = 'error'")
rule_query("rule_array_any", "documents", "doc_id", {"words": ["license.", "LICENSE,"]}, "len(list_filter(str_split(text, ' '), lambda x: lower(x) IN ('license.', 'license,'))) > 0", prepare=lambda df: df.withColumn("words", F.split("text", " ")))
_E, _P, _N = {"event_type": "error"}, {"event_type": "purchase"}, {"props|contains": "9"}
_SQL = {"e": "event_type = 'error'", "p": "event_type = 'purchase'", "n": "contains(props, '9')"}


def condition_query(name: str, condition: str, where: str, compat: bool = False, **more: object) -> None:
    rule_query(name, "events", "event_id", {"e": _E, "p": _P, "n": _N, "x_1": _E, "x_2": _N, **more, "condition": condition}, where.format(**_SQL), compat)


condition_query("rule_and", "e and n", "{e} AND {n}")
condition_query("rule_or", "e or n", "{e} OR {n}")
condition_query("rule_not", "NOT e and n", "NOT {e} AND {n}")
condition_query("rule_nested", "(e or p) and not (n and p)", "({e} OR {p}) AND NOT ({n} AND {p})")
condition_query("rule_one_of", "1 of x_*", "{e} OR {n}")
condition_query("rule_all_of", "all of x_*", "{e} AND {n}")
condition_query("rule_of_nothing", "not 1 of y_*", "true")
condition_query("rule_missing_field", "e and not gone", "{e}", gone={"no.such|contains": "x"})
condition_query("rule_unknown_selection", "e or nowhere", "{e}")
condition_query("rule_bad_condition", "(e and n", "false")
condition_query("rule_list_of_maps", "either", "({e} AND {n}) OR ({p} AND NOT {e})", either=[{**_E, **_N}, _P, "keyword"])
condition_query("rule_empty_map", "empty and e", "{e}", empty={})
condition_query("rule_or_compat", "e or n", "NOT {e} AND {n}", compat=True)
condition_query("rule_and_compat", "(e or p) and n", "(NOT {e} AND {p}) AND {n}", compat=True)
_RULES = [
    Rule("r1", "Errors with 9", "low", detection={"e": _E, "n": _N, "condition": "e and n"}),
    Rule("r2", "Money", "high", detection={"p": _P, "condition": "p"}),
    Rule("r3", "Any 9", "medium", detection={"n": _N, "condition": "n"}),
    Rule("r4", "All errors", "critical", detection={"e": _E, "condition": "e"}),
]
_HITS = "SELECT event_id, [x FOR x IN [CASE WHEN event_type = 'error' AND contains(props, '9') THEN 'r1' END, CASE WHEN event_type = 'purchase' THEN 'r2' END, CASE WHEN contains(props, '9') THEN 'r3' END, CASE WHEN event_type = 'error' THEN 'r4' END] IF x IS NOT NULL] AS hits FROM events"


@query(f"SELECT event_id, hits[1] AS rule_id, array_to_string(hits, ',') AS all_rules FROM ({_HITS}) WHERE len(hits) > 0")
def multi_rule_primary(spark, d):
    found = with_matches(_t(spark, d, "events"), _RULES).where(F.size("matches") > 0)
    return found.select("event_id", F.get("matches", 0)["rule_id"].alias("rule_id"), F.array_join(F.transform("matches", lambda m: m["rule_id"]), ",").alias("all_rules"))


@query(f"SELECT hits[1] AS rule_id, count(*) AS n FROM ({_HITS}) WHERE len(hits) > 0 GROUP BY 1")
def rule_match_counts(spark, d):
    found = with_matches(_t(spark, d, "events"), _RULES).where(F.size("matches") > 0)
    return found.groupBy(F.get("matches", 0)["rule_id"].alias("rule_id")).agg(F.count("*").alias("n"))


_PROC = fixtures.processes_sql()
_DOC = f"SELECT p.*, e.user_id, e.ts, e.event_id % 5 = 0 AS net, CASE WHEN p.name = 'curl' THEN 80 WHEN p.name = 'tool' THEN 4444 ELSE e.event_id % 1000 END AS port FROM ({_PROC}) p JOIN events e USING (event_id)"
_SHIPPED = f"""SELECT *, CASE
  WHEN net AND name = 'curl' AND port IN (80, 443) THEN 'lab-network-curl-outbound-http'
  WHEN net AND port IN (4444, 4445, 1337, 31337) THEN 'lab-network-outbound-reverse-shell-port'
  WHEN net THEN NULL
  WHEN name IN ('curl', 'wget') AND (contains(command_line, 'http://') OR contains(command_line, 'https://')) THEN 'lab-process-curl-wget-external-url'
  WHEN starts_with(executable, '/tmp/') OR starts_with(executable, '/var/tmp/') OR starts_with(executable, '/dev/shm/') THEN 'lab-process-execution-from-writable-tmp'
  WHEN name IN ('nc', 'ncat', 'netcat', 'socat') THEN 'lab-process-suspicious-network-utility'
  WHEN name IN ('cat', 'grep', 'sed', 'awk', 'head', 'tail', 'less', 'more') AND (contains(command_line, '/etc/passwd') OR contains(command_line, '/etc/shadow') OR contains(command_line, '/etc/sudoers')) THEN 'lab-process-sensitive-account-file-read'
  WHEN name IN ('sh', 'bash', 'dash', 'zsh') AND list_contains(args, '-c') THEN 'lab-process-shell-inline-command' END AS rule_id
FROM ({_DOC})"""


@query(f"SELECT event_id AS seq, coalesce(rule_id, '-') AS rule_id, rule_id IS NOT NULL AS matched FROM ({_SHIPPED})")
def detect_shipped_rules(spark, d):
    found = detect(fixtures.documents(_t(spark, d, "events")), CATALOGUE)
    return found.select("seq", F.coalesce("rule.id", F.lit("-")).alias("rule_id"), F.col("edr.detection.matched").alias("matched"))


# ---- filters

_NOISE = f"""SELECT event_id, CASE
  WHEN contains(txt, 'event_receiver_server.py') THEN 'event receiver server operational noise'
  WHEN contains(txt, '.vscode-server') OR (base = 'node' AND contains(lower(txt), 'vscode')) THEN 'vscode server operational noise'
  WHEN (name = 'dircolors' OR base = 'dircolors') AND (args = ['dircolors', '-b'] OR command_line = 'dircolors -b') THEN 'shell startup helper noise'
  WHEN NOT (name = 'dircolors' OR base = 'dircolors') AND contains(txt, 'lesspipe') AND (name IN ('dash', 'sh', 'basename', 'dirname') OR base IN ('dash', 'sh', 'basename', 'dirname')) THEN 'shell startup helper noise'
  WHEN (name = 'git' OR base = 'git') AND (args = ['git', 'worktree', 'list', '--porcelain'] OR (args[2] <> 'rev-parse' AND command_line = 'git rev-parse --git-dir')) THEN 'development git background query noise'
  WHEN name = 'cpuUsage.sh' OR contains(executable, 'cpuUsage.sh') OR contains(command_line, 'cpuUsage.sh') OR (base = 'cat' AND len(args) = 2 AND regexp_full_match(args[2], '/proc/[0-9]+/stat')) THEN 'procfs polling noise'
  WHEN args = ['which', 'ps'] OR command_line = 'which ps' THEN 'process inventory polling noise'
  WHEN name = 'sleep' AND args = ['sleep', '1'] THEN 'known sleep polling noise' ELSE 'keep' END AS reason
FROM (SELECT *, regexp_extract(coalesce(executable, ''), '([^/]*)/*$', 1) AS base, concat_ws(' ', name, executable, command_line, array_to_string(args, ' ')) AS txt FROM ({_PROC}))"""


@query(_NOISE)
def noise_first_reason(spark, d):
    p = fixtures.processes(_t(spark, d, "events"))
    reason = filters.noise_reason(*[F.col(c) for c in ("name", "executable", "command_line", "args")], sleep_polling=True)
    return p.select("event_id", F.coalesce(reason, F.lit("keep")).alias("reason"))


@query(f"SELECT reason, count(*) AS n FROM ({_NOISE}) WHERE reason NOT IN ('keep', 'known sleep polling noise') GROUP BY 1")
def noise_dropped_counts(spark, d):
    p = fixtures.processes(_t(spark, d, "events"))
    _, dropped = filters.split_by(p, filters.noise_reason(*[F.col(c) for c in ("name", "executable", "command_line", "args")]), "reason")
    return dropped.groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT event_id, 'agent telemetry connection 10.0.0.' || (event_id % 250) || ':' || (event_id % 1000) AS reason FROM events WHERE event_id % 5 = 0 AND event_id % 16 NOT IN (2, 3) AND ((event_id % 250 = 5 AND event_id % 1000 = 255) OR (event_id % 250 = 0 AND event_id % 1000 = 500))")
def endpoint_filter(spark, d):
    e = _t(spark, d, "events")
    docs = fixtures.documents(e)
    reason = filters.endpoint_reason(F.col("destination.ip"), F.col("destination.port"), F.col("network.direction") == "outbound", [("10.0.0.5", 255), ("10.0.0.0", 500)])
    return docs.withColumn("reason", reason).where("reason is not null").select(F.col("seq").alias("event_id"), "reason")


_EDGES = "SELECT event_id AS seq, user_id AS pid, (event_id * 7 + user_id) % 151 AS ppid FROM events WHERE event_type = 'click'"
_CLOSURE = f"WITH RECURSIVE e AS ({_EDGES}), t(pid, t) AS (SELECT CAST(5 AS BIGINT), CAST(-1 AS BIGINT) UNION SELECT e.pid, e.seq FROM t JOIN e ON e.ppid = t.pid AND e.seq > t.t AND e.pid <> e.ppid), m AS (SELECT pid, min(t) AS t FROM t GROUP BY 1) "


def _edges(spark, d):
    return _t(spark, d, "events").where("event_type = 'click'").select(F.lit("h").alias("host"), F.col("event_id").alias("seq"), F.col("user_id").alias("pid"), ((F.col("event_id") * 7 + F.col("user_id")) % 151).alias("ppid"))


def _agent(spark):
    return spark.createDataFrame([("h", 5)], "host string, pid long")


@query(_CLOSURE + "SELECT pid, t FROM m")
def self_filter_closure(spark, d):
    return closure.learned_at(_edges(spark, d), _agent(spark)).select("pid", "t")


@query(_CLOSURE + "SELECT seq, CASE WHEN a.t < seq THEN 'agent self event pid=' || e.pid WHEN b.t < seq THEN 'agent child event pid=' || e.pid || ' ppid=' || e.ppid ELSE 'keep' END AS reason FROM e LEFT JOIN m a ON a.pid = e.pid LEFT JOIN m b ON b.pid = e.ppid")
def self_filter_reasons(spark, d):
    return closure.self_reason(_edges(spark, d), _agent(spark)).select("seq", F.coalesce("drop_reason", F.lit("keep")).alias("reason"))


# ---- scalars and documents


@query("SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS base FROM pages")
def basename_path(spark, d):
    return _t(spark, d, "pages").select("page_id", scalar.basename("url").alias("base"))


@query("""SELECT page_id, array_to_string(list_transform([url, '', 'plain', 'it''s'], lambda a: CASE WHEN a = '' THEN '''''' WHEN regexp_full_match(a, '[a-zA-Z0-9_@%+=:,./-]+') THEN a ELSE '''' || replace(a, '''', '''"''"''') || '''' END), ' ') AS line FROM pages""")
def shell_quote(spark, d):
    return _t(spark, d, "pages").select("page_id", scalar.shell_join(F.array("url", F.lit(""), F.lit("plain"), F.lit("it's"))).alias("line"))


@query("SELECT event_id, CASE WHEN v = 0 THEN '-' ELSE (v & 255) || '.' || ((v >> 8) & 255) || '.' || ((v >> 16) & 255) || '.' || ((v >> 24) & 255) END AS ip FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS v FROM events)")
def ipv4_from_u32(spark, d):
    v = (F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)
    return _t(spark, d, "events").select("event_id", F.coalesce(scalar.ipv4(v), F.lit("-")).alias("ip"))


@query("SELECT o_orderkey, CASE WHEN p BETWEEN 1 AND 65535 THEN p ELSE -1 END AS port FROM (SELECT o_orderkey, CAST(o_orderkey * 37 % 131072 - 1000 AS INTEGER) AS p FROM orders)")
def port_normalize(spark, d):
    p = (F.col("o_orderkey") * 37 % 131072 - 1000).cast("int")
    return _t(spark, d, "orders").select("o_orderkey", F.coalesce(scalar.port(p), F.lit(-1)).alias("port"))


@query("SELECT event_id, sha256(concat_ws('|', event_type, CAST(user_id AS VARCHAR), '', 'x')) AS k, sha256(concat_ws('|', event_type, 'None')) AS k2 FROM events")
def sha256_key(spark, d):
    gone = F.lit(None).cast("string")
    return _t(spark, d, "events").select("event_id", scalar.key_hash(F.col("event_type"), F.col("user_id"), gone, F.lit("x")).alias("k"), scalar.key_hash(F.col("event_type"), gone, missing="None").alias("k2"))


@query("SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM events")
def iso_ms(spark, d):
    return _t(spark, d, "events").select("event_id", scalar.iso_millis("ts").alias("iso"))


@query("SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def wall_clock(spark, d):
    """Monotonic times, as long before a reference moment as the event was, come back as the event's own time."""
    wall, mono = 1_800_000_000_000_000_000, 900_000_000_000_000_000
    ns = F.lit(mono) - (F.lit(wall) - micros() * 1000)
    return _t(spark, d, "events").select("event_id", F.unix_millis(scalar.wall_time(ns, F.lit(wall), F.lit(mono))).alias("ms"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", scalar.html_escape("html").alias("escaped"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ab' WHEN event_id % 3 = 1 THEN '-' ELSE 'é x' END AS clean FROM events")
def clean_strings(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.lit(" a\tb\0junk")).when(F.col("event_id") % 3 == 1, F.lit("\0\0")).otherwise(F.lit("​é x "))
    return _t(spark, d, "events").select("event_id", F.coalesce(scalar.clean_text(raw), F.lit("-")).alias("clean"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a,b' ELSE 'a,b,c' END AS args FROM events")
def args_until_gap(spark, d):
    gap = lambda k, v: F.when(F.col("event_id") % 4 != k, v)
    args = F.array(gap(0, "a"), gap(1, "b"), gap(2, "c"))
    return _t(spark, d, "events").select("event_id", F.array_join(scalar.until_null(args), ",").alias("args"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '-' ELSE event_type END AS kind, CASE WHEN event_type = 'error' THEN 'gone' ELSE 'kept' END AS node, CASE WHEN user_id = 0 THEN 'zero' ELSE 'other' END AS number FROM events")
def prune_documents(spark, d):
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type"))
    doc = e.select("event_id", F.struct(F.struct(kind.alias("kind"), F.array(F.lit("")).alias("tags")).alias("event")).alias("doc"), F.col("user_id"))
    p = nested.prune_empty(doc)
    return p.select("event_id", F.coalesce("doc.event.kind", F.lit("-")).alias("kind"), F.when(F.col("doc").isNull(), "gone").otherwise("kept").alias("node"), F.when(F.col("user_id") == 0, "zero").otherwise("other").alias("number"))


@query(f"SELECT event_id AS seq, name AS process_name, CASE WHEN net THEN port ELSE -1 END AS destination_port, 'h' || (user_id % 3) AS hostname FROM ({_DOC})")
def flatten_documents(spark, d):
    flat = nested.flatten(fixtures.documents(_t(spark, d, "events")))
    return flat.select("seq", F.col("`process.name`").alias("process_name"), F.coalesce("`destination.port`", F.lit(-1)).cast("long").alias("destination_port"), F.col("`host.hostname`").alias("hostname"))


_DECODED = "SELECT event_id, 1 + event_id % 5 AS event_type, user_id AS pid, user_id % 7 AS ppid, event_type AS comm, '/usr/bin/' || event_type AS filename, event_type || ',it''s' AS argv, event_id AS daddr, event_id % 3000 AS dport FROM events WHERE event_id % 50 <> 0"


@query(_DECODED)
def decode_records(spark, d):
    found = decode(fixtures.records(_t(spark, d, "events")), "raw", ("event_id",))
    return found.select("event_id", "event_type", "pid", "ppid", "comm", "filename", F.array_join("argv", ",").alias("argv"), "daddr", F.col("dport").cast("long").alias("dport"))


@query(
    """SELECT e.event_id, CASE WHEN k IN (1, 2) THEN 'process_started' WHEN k = 3 THEN 'network_connection_attempt' ELSE 'network_connection_accepted' END AS action,
    CASE WHEN k IN (1, 2) THEN e.event_type || ' ''it''"''"''s''' ELSE '-' END AS command_line, CASE WHEN k IN (1, 2) THEN 2 ELSE 0 END AS args_count,
    CASE WHEN k > 2 AND event_id % 3000 > 0 THEN event_id % 3000 ELSE -1 END AS dport, CASE WHEN k > 2 THEN (event_id & 255) || '.' || ((event_id >> 8) & 255) || '.' || ((event_id >> 16) & 255) || '.0' ELSE '-' END AS dip,
    coalesce(n.n_name, '-') AS user_name, CASE WHEN event_id % 3 = 0 THEN '-1' ELSE CAST(event_id % 3 AS VARCHAR) END AS audit_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso
    FROM (SELECT *, 1 + event_id % 5 AS k FROM events WHERE event_id % 50 <> 0) e LEFT JOIN nation n ON n.n_nationkey = e.event_id % 4 AND n.n_nationkey <> 2 WHERE k < 5"""
)
def normalize_records(spark, d):
    decoded = decode(fixtures.records(_t(spark, d, "events")), "raw", ("event_id",))
    users = _t(spark, d, "nation").where("n_nationkey != 2").select(F.col("n_nationkey").cast("long").alias("uid"), F.col("n_name").alias("name"))
    wall = 1_800_000_000_000_000_000
    docs = normalize.normalize(normalize.with_user_names(decoded, users), "h", wall, wall, keep=("event_id",))
    text = lambda c: F.coalesce(F.col(c), F.lit("-"))
    return docs.select(
        "event_id", F.col("event.action").alias("action"), text("process.command_line").alias("command_line"), F.coalesce("process.args_count", F.lit(0)).alias("args_count"),
        F.coalesce("destination.port", F.lit(-1)).cast("long").alias("dport"), text("destination.ip").alias("dip"), text("user.name").alias("user_name"), F.col("user.audit.id").alias("audit_id"), F.col("`@timestamp`").alias("iso"),
    )


# ---- enrichment


@query("SELECT c_custkey, coalesce(n_name, 'none') AS nation, CASE WHEN n_name IS NULL THEN 'missing' ELSE 'ok' END AS status FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON c_nationkey = n_nationkey")
def uid_name_join(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("uid"), F.lit(0).cast("long").alias("auid"))
    users = _t(spark, d, "nation").where("n_nationkey % 3 > 0").select(F.col("n_nationkey").cast("long").alias("uid"), F.col("n_name").alias("name"))
    named = normalize.with_user_names(c, users)
    return named.select("c_custkey", F.coalesce("user_name", F.lit("none")).alias("nation"), F.when(F.col("user_name").isNull(), "missing").otherwise("ok").alias("status"))


@query(
    f"""SELECT event_id AS seq, CASE WHEN c = 'ok' THEN 'run me' WHEN command_line IS NOT NULL THEN command_line WHEN c = 'short_lived' THEN 'unknown (short-lived process)' WHEN c = 'permission_denied' THEN 'unknown (permission denied)' WHEN c = 'skipped' THEN '-' ELSE 'unknown (unavailable)' END AS command_line,
    CASE WHEN c = 'skipped' THEN coalesce(name, '-') WHEN x = 'ok' THEN 'prog' WHEN executable IS NOT NULL THEN regexp_extract(executable, '([^/]*)/*$', 1) ELSE name END AS name, c = 'ok' OR x = 'ok' OR h = 'ok' AS enriched,
    CASE WHEN c = 'skipped' THEN 'missing or invalid process.pid' ELSE coalesce(nullif(concat_ws('; ', CASE WHEN c NOT IN ('ok', 'empty') THEN 'command_line=' || c END, CASE WHEN x NOT IN ('ok', 'empty') THEN 'executable=' || x END, CASE WHEN h NOT IN ('ok', 'empty') THEN 'hash=' || h END), ''), '-') END AS reason
    FROM (SELECT *, CASE WHEN pid <= 0 THEN 'skipped' WHEN k IS NULL THEN 'short_lived' WHEN k % 5 = 1 THEN 'permission_denied' WHEN k % 5 = 2 THEN 'empty' ELSE 'ok' END AS c,
      CASE WHEN pid <= 0 THEN 'skipped' WHEN k IS NULL THEN 'short_lived' WHEN k % 5 IN (1, 3) THEN 'os_error' ELSE 'ok' END AS x, CASE WHEN pid <= 0 THEN 'skipped' WHEN k IS NULL THEN 'short_lived' WHEN k % 5 = 4 THEN 'empty' WHEN k % 5 = 1 THEN 'permission_denied' ELSE 'ok' END AS h
    FROM (SELECT d.*, user_id - 1 AS pid, s.c_custkey AS k FROM ({_DOC}) d LEFT JOIN customer s ON s.c_custkey = d.user_id - 1 AND s.c_custkey % 4 > 0))"""
)
def enrich_status(spark, d):
    docs = fixtures.documents(_t(spark, d, "events"))
    docs = docs.withColumn("process", F.col("process").withField("pid", F.col("process.pid") - 1))
    k = F.col("c_custkey") % 5
    one = _t(spark, d, "customer").where("c_custkey % 4 > 0").select(
        F.col("c_custkey").alias("pid"),
        F.when(k.isin(0, 3, 4), F.encode(F.lit("run\0\0me\0"), "UTF-8")).otherwise(F.encode(F.lit(""), "UTF-8")).alias("cmdline"),
        F.when(k == 1, "permission_denied").alias("cmdline_status"),
        F.when(k.isin(0, 2, 4), "/opt/prog").alias("exe"),
        F.when(k.isin(1, 3), "os_error").alias("exe_status"),
        F.when(~k.isin(1, 4), F.repeat(F.lit("a"), F.lit(64))).alias("sha256"),
        F.when(k == 1, "permission_denied").alias("hash_status"),
    )
    snapshot = one.withColumn("host", F.explode(F.array(*[F.lit(f"h{i}") for i in range(3)])))
    out = enrich.enrich(docs, snapshot)
    text = lambda c: F.coalesce(F.col(c), F.lit("-"))
    return out.select("seq", text("process.command_line").alias("command_line"), text("process.name").alias("name"), F.col("edr.enrichment.proc.enriched").alias("enriched"), text("edr.enrichment.proc.reason").alias("reason"))


@query("SELECT e.event_id, coalesce(o.o_orderkey, -1) AS o_orderkey FROM (SELECT *, ts - INTERVAL 26 YEAR AS at FROM events) e ASOF LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS o_orderkey, o_orderdate FROM orders GROUP BY 1, 3) o ON o.o_custkey = e.user_id AND o.o_orderdate <= e.at")
def snapshot_as_of(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", F.expr("ts - INTERVAL 26 YEAR").alias("at"))
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), "o_orderdate").agg(F.max("o_orderkey").alias("o_orderkey"))
    return enrich.as_of(e, o, ["user_id"], "at", "o_orderdate", ["o_orderkey"]).select("event_id", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"))


@query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1")
def file_hash_cache(spark, d):
    """Each distinct content is hashed once and joined back."""
    docs = _t(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), F.xxhash64("text").alias("inode"), F.length("text").alias("size"))
    hashes = enrich.hash_files(docs, ("inode", "size"))
    return docs.drop("content").join(hashes, ["inode", "size"]).groupBy("sha256").agg(F.count("*").alias("n"))


@query("SELECT event_id, value_before FROM (SELECT *, lag(event_type) OVER w AS before, lag(event_id) OVER w AS value_before FROM events WHERE event_type IN ('click', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type = 'purchase' AND before = 'click' AND value >= 20")
def enter_exit_pairing(spark, d):
    e = _t(spark, d, "events")
    out = pairing.pair(e, "user_id", ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", ["event_id"], F.col("value") >= 20)
    return out.select("event_id", F.col("enter_event_id").alias("value_before"))


# ---- sessions and correlation


def _sessions_sql(key: str, columns: str, where: str = "true") -> str:
    return f"""WITH a AS (SELECT *, epoch_us(ts) AS t, {key} AS k FROM events), b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY k ORDER BY t, event_id) < {12 * HOUR} THEN 0 ELSE 1 END AS brk FROM a),
    c AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b),
    s AS (SELECT *, count(*) OVER w AS n, array_to_string(list_sort(list_distinct(list(event_type) OVER w)), ',') AS kinds FROM c WINDOW w AS (PARTITION BY k, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)) SELECT {columns} FROM s WHERE {where}"""


def _sessions(spark, d, *keys, sets=None):
    e = _t(spark, d, "events")
    return dedup.sessions(e, scalar.key_hash(*[F.col(k) for k in keys]), micros(), F.col("event_id"), 12 * HOUR, sets)


_KEY = "user_id || '|' || event_type"


@query(_sessions_sql(_KEY, "event_id, CAST(session AS BIGINT) AS session, n, brk = 0 AS is_duplicate"))
def dedup_mark(spark, d):
    return _sessions(spark, d, "user_id", "event_type").select("event_id", F.col("session").cast("long").alias("session"), F.col("count").alias("n"), "is_duplicate")


@query(_sessions_sql(_KEY, "event_id", "brk = 1"))
def dedup_drop(spark, d):
    return _sessions(spark, d, "user_id", "event_type").where(~F.col("is_duplicate")).select("event_id")


@query(_sessions_sql("user_id", "event_id, n, kinds"))
def dedup_dest_sets(spark, d):
    out = _sessions(spark, d, "user_id", sets={"kinds": F.col("event_type")})
    return out.select("event_id", F.col("count").alias("n"), F.array_join("kinds", ",").alias("kinds"))


@query(_sessions_sql(_KEY + " || '|' || (event_id % 3)", "event_id, n"))
def dedup_include_dest(spark, d):
    e = _t(spark, d, "events").withColumn("dest", F.col("event_id") % 3)
    return dedup.sessions(e, scalar.key_hash(F.col("user_id"), F.col("event_type"), F.col("dest")), micros(), F.col("event_id"), 12 * HOUR).select("event_id", F.col("count").alias("n"))


_ALERT_WINDOW = 48 * 3600.0
_ALERT_SESSIONS = f"""WITH a AS (SELECT *, epoch_us(ts) AS t, concat_ws('|', 'h' || (user_id % 3), rule_id, CASE WHEN net THEN 'network' ELSE 'process' END, CASE WHEN net THEN 'connection' ELSE 'start' END, user_id, coalesce(executable, ''), coalesce(command_line, ''), name, CASE WHEN net THEN CAST(port AS VARCHAR) ELSE '' END) AS k
    FROM ({_SHIPPED}) WHERE rule_id IS NOT NULL), b AS (SELECT *, CASE WHEN t / 1000000 - lag(t) OVER (PARTITION BY k ORDER BY t, event_id) / 1000000 < {_ALERT_WINDOW} THEN 0 ELSE 1 END AS brk FROM a),
    c AS (SELECT *, sum(brk) OVER (PARTITION BY k ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM b)"""


@query(_ALERT_SESSIONS + " SELECT event_id AS seq, sha256(k) AS group_id, brk = 0 AS is_duplicate, count(*) OVER (PARTITION BY k, session ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS n FROM c")
def dedup_alerts(spark, d):
    docs = detect(fixtures.documents(_t(spark, d, "events")), CATALOGUE)
    out = dedup.dedup_alerts(docs, window_seconds=_ALERT_WINDOW).where("edr.detection.matched")
    return out.select("seq", F.col("edr.alert.dedup.group_id").alias("group_id"), F.col("edr.alert.dedup.is_duplicate").alias("is_duplicate"), F.col("edr.alert.dedup.count").alias("n"))


_CORR = [
    correlate.CorrelationRule("c1", "Errors and purchases", "high", ("error", "purchase")),
    correlate.CorrelationRule("c2", "Three kinds", "critical", ("view", "click", "signup")),
    correlate.CorrelationRule("c3", "Click and view", "high", ("view", "click")),
]
_SEEN = f"SELECT a.event_id, a.event_type, list_sort(list_distinct(list(b.event_type))) AS ids, count(*) AS n, min(b.event_id) AS first_id FROM events a JOIN events b ON a.user_id = b.user_id AND epoch_us(b.ts) >= epoch_us(a.ts) - {DAY} AND (b.ts < a.ts OR (b.ts = a.ts AND b.event_id <= a.event_id)) GROUP BY 1, 2"


def _seen(spark, d):
    e = _t(spark, d, "events")
    r = correlate.related(e, F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))), micros(), F.col("event_id"), F.col("event_id").cast("string"), F.col("event_type"), DAY)
    return r.withColumn("ids", F.array_sort(F.array_distinct(F.transform("related", lambda o: o["payload"]))))


@query(f"SELECT event_id, n, first_id FROM ({_SEEN})")
def correlate_pairs(spark, d):
    first = F.array_min(F.transform("related", lambda o: o["seq"]))
    return _seen(spark, d).select(F.col("seq").alias("event_id"), F.size("related").cast("long").alias("n"), first.alias("first_id"))


@query(f"SELECT event_id, array_to_string(ids, ',') AS rules FROM ({_SEEN})")
def correlate_related_rules(spark, d):
    return _seen(spark, d).select(F.col("seq").alias("event_id"), F.array_join("ids", ",").alias("rules"))


@query(f"SELECT * FROM (SELECT event_id, CASE WHEN list_has_all(ids, ['view', 'click', 'signup']) THEN 'c2' WHEN list_has_all(ids, ['error', 'purchase']) THEN 'c1' WHEN list_has_all(ids, ['view', 'click']) THEN 'c3' END AS corr FROM ({_SEEN})) WHERE corr IS NOT NULL")
def correlate_primary(spark, d):
    k = correlate.primary_rule(F.col("ids"), _CORR)
    out = _seen(spark, d).withColumn("k", k).where("k is not null")
    return out.select(F.col("seq").alias("event_id"), F.get(F.array(*[F.lit(r.id) for r in _CORR]), F.col("k")).alias("corr"))


@query(
    _ALERT_SESSIONS
    + f""", o AS (SELECT event_id, t, rule_id, unnest(list_distinct(['p' || (user_id % 3) || ':' || user_id, 'c' || (user_id % 3) || ':' || coalesce(command_line, '')])) AS scope FROM c WHERE brk = 1),
    s AS (SELECT a.event_id, list_sort(list_distinct(list(b.rule_id))) AS ids, count(DISTINCT b.event_id) AS n FROM o a JOIN o b ON a.scope = b.scope AND b.t / 1000000 >= a.t / 1000000 - {30 * 3600.0} AND (b.t < a.t OR (b.t = a.t AND b.event_id <= a.event_id)) GROUP BY 1)
    SELECT * FROM (SELECT event_id AS seq, n, array_to_string(ids, ',') AS rules, CASE WHEN list_has_all(ids, ['lab-process-execution-from-writable-tmp', 'lab-network-outbound-reverse-shell-port']) THEN 'corr-temp-exec-reverse-shell-port'
      WHEN list_has_all(ids, ['lab-process-curl-wget-external-url', 'lab-network-curl-outbound-http']) THEN 'corr-external-transfer-outbound-http'
      WHEN list_has_all(ids, ['lab-process-shell-inline-command', 'lab-network-curl-outbound-http']) THEN 'corr-shell-inline-network-activity'
      WHEN list_has_all(ids, ['lab-process-shell-inline-command', 'lab-process-curl-wget-external-url']) THEN 'corr-shell-inline-external-transfer' END AS corr FROM s) WHERE corr IS NOT NULL"""
)
def correlate_alerts(spark, d):
    docs = detect(fixtures.documents(_t(spark, d, "events")), CATALOGUE)
    marked = dedup.dedup_alerts(docs, window_seconds=_ALERT_WINDOW)
    out = correlate.correlate_alerts(marked, window_seconds=30 * 3600.0, max_per_scope=100_000, details=False).where("edr.correlation.matched")
    c = F.col("edr.correlation")
    return out.select("seq", c["event_count"].alias("n"), F.array_join(c["related_rules"], ",").alias("rules"), c["rule_id"].alias("corr"))


# ---- queue, delivery, serving

_QUEUE = "(SELECT o_orderkey AS id, CAST(o_orderkey % 9 AS INTEGER) AS attempts, o_totalprice AS next_attempt_at, o_orderpriority AS payload FROM orders)"


def _queue(spark, d):
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9).cast("int").alias("attempts"), F.col("o_totalprice").alias("next_attempt_at"), F.col("o_orderpriority").alias("payload"), F.lit(None).cast("string").alias("last_error"))


@query(f"SELECT id, attempts FROM {_QUEUE} WHERE next_attempt_at <= 100000 ORDER BY id LIMIT 50")
def queue_ready_topk(spark, d):
    return queue.ready(_queue(spark, d), 100000.0, 50).select("id", "attempts")


@query(f"SELECT id FROM {_QUEUE} ORDER BY id DESC LIMIT 1000")
def queue_retention(spark, d):
    return queue.retain_rows(_queue(spark, d), 1000).select("id")


@query(f"SELECT id FROM {_QUEUE} ORDER BY id DESC LIMIT (SELECT count(*) - greatest(1, count(*) // 10) FROM orders)")
def queue_shed_oversize(spark, d):
    return queue.shed_oldest(_queue(spark, d), 600 << 20, 500 << 20).select("id")


@query(f"SELECT id FROM {_QUEUE} WHERE id % 3 > 0")
def queue_delete_delivered(spark, d):
    q = _queue(spark, d)
    return queue.delivered(q, q.where("id % 3 = 0")).select("id")


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN id % 3 = 0 THEN 1024 ELSE 0 END AS error_length, CASE WHEN id % 3 = 0 THEN CAST(500 + least(60, 2 * pow(2, attempts)) AS BIGINT) ELSE -1 END AS next_at FROM {_QUEUE}")
def queue_mark_failed(spark, d):
    q = _queue(spark, d)
    out = queue.failed(q, q.where("id % 3 = 0"), "e" * 3000, 500.0, scalar.backoff_seconds("attempts"))
    at = F.when(F.col("last_error").isNotNull(), F.col("next_attempt_at").cast("long")).otherwise(F.lit(-1))
    return out.select("id", "attempts", F.coalesce(F.length("last_error"), F.lit(0)).alias("error_length"), at.alias("next_at"))


@query(f"SELECT attempts, CAST(least(60, 2 * pow(2, attempts)) AS BIGINT) AS seconds, count(*) AS n FROM {_QUEUE} GROUP BY 1, 2")
def queue_backoff(spark, d):
    q = _queue(spark, d).withColumn("seconds", scalar.backoff_seconds("attempts").cast("long"))
    return q.groupBy("attempts", "seconds").agg(F.count("*").alias("n"))


@query("SELECT id, s IS NULL OR s IN (408, 429) OR s BETWEEN 500 AND 599 AS retryable, CAST(CASE WHEN s IS NULL OR s IN (408, 429) OR s BETWEEN 500 AND 599 THEN least(60, 2 * pow(2, id % 9)) ELSE 3600 END AS BIGINT) AS delay FROM (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 408 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 400 ELSE 429 END AS s FROM orders)")
def retry_class(spark, d):
    k = F.col("id") % 6
    s = F.when(k == 1, 408).when(k == 2, 404).when(k == 3, 503).when(k == 4, 400).when(k == 5, 429)
    return _queue(spark, d).select("id", scalar.retryable(s).alias("retryable"), queue.retry_delay(s, F.col("attempts")).cast("long").alias("delay"))


@query("SELECT count(*) AS n, max(o_orderkey % 9) AS max_attempts FROM orders")
def queue_stats(spark, d):
    return _queue(spark, d).agg(F.count("*").alias("n"), F.max("attempts").cast("long").alias("max_attempts"))


@query("SELECT event_id, props FROM events ORDER BY event_id DESC LIMIT 100")
def tail_n(spark, d):
    return serve.tail(_t(spark, d, "events"), "event_id", 1000).select("event_id", "props")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 20) WHERE event_id % 2 = 1")
def tail_json_lines(spark, d):
    """Broken lines count towards the limit, then they are left out."""
    lines = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 1, F.col("props")).otherwise(F.lit("{broken")).alias("value"))
    return serve.tail_json(lines, "event_id", "value", 20, "k long")


@query("SELECT event_id, CASE event_id % 4 WHEN 1 THEN 200 ELSE 400 END AS status, CASE event_id % 4 WHEN 0 THEN 'empty body' WHEN 1 THEN '-' WHEN 2 THEN 'invalid json' ELSE 'expected a json array' END AS reason, CASE event_id % 4 WHEN 1 THEN 2 ELSE 0 END AS received FROM events")
def receiver_accept(spark, d):
    k = F.col("event_id") % 4
    body = F.when(k == 1, F.concat(F.lit("["), "props", F.lit(", {}]"))).when(k == 2, F.lit("[{")).when(k == 3, F.col("props")).otherwise(F.lit(""))
    out = serve.accept_batch(_t(spark, d, "events").select("event_id", body.alias("body")), "body", "struct<k:long>")
    return out.select("event_id", "status", F.coalesce("reason", F.lit("-")).alias("reason"), "received")


@query(f"SELECT '' AS received_at, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS timestamp, CASE WHEN net THEN 'network_connection_attempt' ELSE 'process_started' END AS action, name AS process_name, CAST(user_id AS VARCHAR) AS pid, CAST(user_id % 7 AS VARCHAR) AS ppid, '' AS user_name, CASE WHEN rule_id IS NULL THEN 'NU' ELSE 'DA' END AS matched, coalesce(command_line, '') AS command_line FROM (SELECT * FROM ({_SHIPPED}) ORDER BY event_id DESC LIMIT 20)")
def ui_projection(spark, d):
    docs = detect(fixtures.documents(_t(spark, d, "events")), CATALOGUE)
    newest = serve.tail(docs, "seq", "x", default=20)
    records = newest.select(F.lit(None).cast("string").alias("received_at"), F.struct("`@timestamp`", "event", F.col("process"), F.struct(F.lit(None).cast("string").alias("name")).alias("user"), "edr").alias("event"))
    return serve.overview(records)


@query(f"SELECT rule_id, count(*) AS alerts, CAST(count(*) FILTER (brk = 0) AS BIGINT) AS duplicates FROM (SELECT * FROM ({_ALERT_SESSIONS} SELECT * FROM c)) GROUP BY 1")
def alert_summary(spark, d):
    """Detection and deduplication from end to end: alerts and duplicates of each shipped rule."""
    docs = detect(fixtures.documents(_t(spark, d, "events")), CATALOGUE)
    out = dedup.dedup_alerts(docs, window_seconds=_ALERT_WINDOW).where("edr.detection.matched")
    return out.groupBy(F.col("rule.id").alias("rule_id")).agg(F.count("*").alias("alerts"), F.count_if(F.col("edr.alert.dedup.is_duplicate")).alias("duplicates"))
