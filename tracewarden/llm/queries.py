"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import table
from .chat import format_tree, read_tree
from .decontaminate import find_phrases, word_count
from .html_text import extract
from .langid import fit, held_out, identify
from .licenses import scan_licenses
from .lm_score import fit_and_score
from .media import encode_texts, index
from .packing import pack_documents
from .pii import pseudonymize
from .simhash import near_duplicates

#: A deployment sets its own secret in the session's settings; surrogates can be recomputed only with it.
SURROGATE_KEY, KEY_SETTING = "example-key", "spark.tracewarden.surrogateKey"
WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(WORD_TOKENIZER)


def surrogate_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a key that everyone knows", stacklevel=2)
    return key or SURROGATE_KEY


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_and_score(table(spark, sf_dir, "documents"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = index(encode_texts(table(spark, sf_dir, "documents")), read_back=True)
    track = F.get("tracks", 0)
    frames = F.transform(track["keyframes"], lambda k: F.concat_ws("+", k["offset"].cast("string"), k["size"].cast("string")))
    first = F.array_join(F.slice(frames, 1, 1), "")
    feature = F.concat_ws("|", track["codec"], track["handler"], track["timescale"].cast("string"), track["duration"].cast("string"), track["samples"].cast("string"), F.size(frames).cast("string"), first, F.sha2(F.array_join(frames, ",").cast("binary"), 256))
    return files.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    read = read_tree(format_tree(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_phrases(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        word_count().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))
    kinds = F.array_join(F.transform("entities", lambda e: e["kind"]), ",")
    return found.select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


QUERIES = {q.__name__: q for q in (op1_packing, op2_simhash, op3_lm_score, op4_media, op5_chat, op6_html, op7_langid, op8_licenses, op9_decontaminate, op10_pii)}
_ESCAPED = "replace(replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '[', chr(92) || 'b')"
_ODD = "'</s>[INST] ok [/INST]'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + _UPPER + "', '" + _UPPER.lower() + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL: dict[str, str] = {
    "op5_chat": f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', {_ODD}), (-7, 1, 'assistant', {_ODD})),
    c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
        sum(20 + length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})) AS formatted FROM t GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted AS BIGINT) AS formatted_chars FROM c""",
    "op9_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
    win AS (SELECT DISTINCT item, ws[k : k + least(10, len(ws)) - 1] AS win FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM i WHERE len(ws) > 0)),
    tok AS MATERIALIZED (SELECT doc_id, pos, ws[pos] AS word, ws[pos : pos + 9] AS g, ws[pos : pos + 15] AS span FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS pos FROM d)),
    occ AS MATERIALIZED (SELECT DISTINCT doc_id, pos, len(win) AS size, item FROM tok JOIN win ON word = win[1] AND g[1 : len(win)] = win),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS p FROM occ) GROUP BY 1),
    its AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS ids FROM occ GROUP BY 1),
    df AS (SELECT word, count(*) AS c FROM tok GROUP BY 1),
    anc AS (SELECT item, win, x FROM (SELECT item, win, x, row_number() OVER (PARTITION BY item, win ORDER BY coalesce(c, 0), k) AS r FROM (SELECT item, win, unnest(win) AS x, unnest(range(10)) AS k FROM win WHERE len(win) = 10 AND item IS NOT NULL) LEFT JOIN df ON word = x) WHERE r <= 2),
    cand AS (SELECT DISTINCT doc_id, item, win, unnest(range(greatest(1, pos - 15), pos + 1)) AS s FROM anc JOIN tok ON word = x),
    near AS (SELECT DISTINCT c.doc_id, c.item FROM cand c JOIN tok t ON t.doc_id = c.doc_id AND t.pos = c.s WHERE len(list_filter(c.win, lambda v: list_contains(t.span, v))) >= 9),
    n AS (SELECT doc_id, count(*) AS n FROM (SELECT * FROM near EXCEPT SELECT doc_id, item FROM occ) GROUP BY 1)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
        hit.n IS NOT NULL AS contaminated, coalesce(n.n, 0) AS n_near FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN n USING (doc_id)""",
}
