"""Scalar expressions. All are built from Spark's own functions and never raise on odd input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import UINT32_MAX


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Up to the first NUL, without unprintable characters, trimmed; null if nothing is left."""
    text = F.substring_index(_col(c), "\0", 1)
    return F.nullif(F.trim(F.regexp_replace(text, r"[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]", "")), F.lit(""))


def basename(c: Column | str) -> Column:
    """Last part of a path, whether or not slashes follow it; empty for an empty path."""
    parts = F.filter(F.split(_col(c), "/"), lambda x: (x != "") & (x != "."))
    return F.coalesce(F.get(parts, F.size(parts) - 1), F.when(_col(c).isNotNull(), F.lit("")))


def ipv4(c: Column | str) -> Column:
    """Dotted address of an unsigned 32-bit number whose lowest byte comes first; null for 0."""
    v = _col(c).cast("long")
    parts = [F.shiftright(v, k).bitwiseAND(255).cast("string") for k in (0, 8, 16, 24)]
    return F.when(v.isNull() | (v == 0), None).otherwise(F.concat_ws(".", *parts))


def port(c: Column | str) -> Column:
    return F.when(_col(c).between(1, 65535), _col(c).cast("int"))


def iso_millis(c: Column | str) -> Column:
    """ISO-8601 in UTC, cut (not rounded) to milliseconds. The session's time zone must be UTC."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def wall_time(ns: Column | str, wall_ns: Column, mono_ns: Column) -> Column:
    """Timestamp of a monotonic clock's ``ns``, given both clocks at one moment. Zero, negative and future values mean that moment."""
    ago = F.when((_col(ns) > 0) & (_col(ns) <= mono_ns), mono_ns - _col(ns)).otherwise(F.lit(0))
    return F.timestamp_micros(F.call_function("div", wall_ns - ago, F.lit(1_000_000)) * 1000)


def shell_join(c: Column | str) -> Column:
    """Arguments joined by spaces, quoted for a POSIX shell where needed."""
    quoted = lambda a: F.when(a == "", F.lit("''")).when(a.rlike(r"^[a-zA-Z0-9_@%+=:,./-]+\z"), a).otherwise(F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("'\"'\"'")), F.lit("'")))
    return F.array_join(F.transform(_col(c), quoted), " ")


def until_null(c: Column | str) -> Column:
    """An array up to its first null."""
    a = _col(c)
    at = F.array_position(F.transform(a, lambda x: x.isNull()), True)
    return F.when(at > 0, F.slice(a, F.lit(1), (at - 1).cast("int"))).otherwise(a)


def key_hash(*parts: Column, missing: str = "") -> Column:
    """SHA-256, in hex, of the parts as text joined by ``|``; nulls are written as ``missing``."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts]).cast("binary"), 256)


def html_escape(c: Column | str) -> Column:
    out = _col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def user_struct(uid: Column, auid: Column, name: Column, audit_name: Column) -> Column:
    """User fields. The audit id alone writes the unset value as -1."""
    unset = auid == UINT32_MAX
    audit = F.struct(F.when(unset, "-1").otherwise(auid.cast("string")).alias("id"), F.when(unset, "unset").otherwise(audit_name).alias("name"))
    return F.struct(uid.cast("string").alias("id"), F.when(uid == UINT32_MAX, "unset").otherwise(name).alias("name"), audit.alias("audit"))


def clamp_limit(value: object, default: int, low: int = 1, high: int = 100) -> int:
    """A caller's limit as a number from low to high; the default if it is no number."""
    try:
        return max(low, min(high, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def backoff_seconds(attempts: Column | str, base: float = 2.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """min(most, base * 2^attempts), plus a share ``jitter`` (0 to 0.1) of it, capped again."""
    delay = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(_col(attempts), F.lit(60))))
    return delay if jitter is None else F.least(F.lit(most), delay * (1 + jitter))


def retryable(status: Column | str) -> Column:
    """Whether a delivery may be tried again soon: no answer (null), 408, 429 and 5xx."""
    s = _col(status)
    return s.isNull() | s.isin(408, 429) | s.between(500, 599)
