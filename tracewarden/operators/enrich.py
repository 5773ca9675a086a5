"""Process snapshots joined to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import basename

# What stands for a value that could not be read, by status.
PLACEHOLDERS = {"short_lived": "unknown (short-lived process)", "permission_denied": "unknown (permission denied)", "empty": "unknown (unavailable)", "os_error": "unknown (unavailable)"}
SNAPSHOT = "host string, pid long, cmdline binary, cmdline_status string, exe string, exe_status string, sha256 string, hash_status string"


def _placeholder(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, text in PLACEHOLDERS.items():
        out = F.when(status == name, text).otherwise(out)
    return out


def command_line(raw: Column) -> Column:
    """Arguments between NULs, empty ones left out, joined by spaces without quotes."""
    parts = F.filter(F.split(F.make_valid_utf8(raw.cast("string")), "\0"), lambda x: x != "")
    return F.nullif(F.trim(F.array_join(parts, " ")), F.lit(""))


def hash_files(files: DataFrame, key_cols: tuple[str, ...] = ("dev", "inode", "size", "mtime_ns"), content_col: str = "content") -> DataFrame:
    """SHA-256 of each distinct file, read once however often it occurs."""
    return files.dropDuplicates(list(key_cols)).select(*key_cols, F.sha2(content_col, 256).alias("sha256"))


def enrich(documents: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Left join on (host, pid): command line, executable, file hash, the name that the executable gives, and statuses.

    ``snapshot`` has columns as in SNAPSHOT, at most one row for each (host, pid). A process that isn't in it was short-lived;
    a missing or non-positive pid is skipped. A value that was read replaces the document's; a placeholder only fills a gap.
    """
    # nothing is known of a process that isn't there, so no row is matched for pids that are skipped
    right = snapshot.select(F.col("host").alias("__host"), F.col("pid").alias("__pid"), *[c for c in ("cmdline", "cmdline_status", "exe", "exe_status", "sha256", "hash_status")]).withColumn("__there", F.lit(True))
    joined = documents.join(right, (F.col("host.hostname") == F.col("__host")) & (F.col("process.pid") == F.col("__pid")), "left")
    skipped = F.coalesce(F.col("process.pid") <= 0, F.lit(True))
    line = command_line(F.col("cmdline"))

    def status(given: str, value: Column) -> Column:
        found = F.when(F.col("__there").isNull(), "short_lived").otherwise(F.coalesce(given, F.when(value.isNull(), "empty").otherwise("ok")))
        return F.when(skipped, "skipped").otherwise(F.when((found == "ok") & value.isNull(), "empty").otherwise(found))

    staged = joined.withColumns({"__line": line}).withColumns({"__c": status("cmdline_status", F.col("__line")), "__e": status("exe_status", F.col("exe")), "__h": status("hash_status", F.col("sha256"))})
    filled = lambda s, new, old: F.when(F.col(s) == "ok", new).otherwise(F.coalesce(old, _placeholder(F.col(s))))
    staged = staged.withColumns({"__line": filled("__c", F.col("__line"), F.col("process.command_line")), "__exe": filled("__e", F.col("exe"), F.col("process.executable"))})
    real = F.nullif(basename("__exe"), F.lit(""))
    name = F.when(~skipped & F.col("__exe").isNotNull() & ~F.col("__exe").startswith("unknown"), F.coalesce(real, F.col("process.name"))).otherwise(F.col("process.name"))
    process = F.col("process").withField("command_line", F.col("__line")).withField("executable", F.col("__exe")).withField("name", name).withField("hash", F.when(F.col("__h") == "ok", F.struct(F.col("sha256").alias("sha256"))))
    failed = lambda label, s: F.when(~F.col(s).isin("ok", "empty"), F.concat(F.lit(f"{label}="), F.col(s)))
    reason = F.when(skipped, "missing or invalid process.pid").otherwise(F.nullif(F.concat_ws("; ", failed("command_line", "__c"), failed("executable", "__e"), failed("hash", "__h")), F.lit("")))
    enriched = F.array_contains(F.array("__c", "__e", "__h"), "ok")
    proc = F.struct(enriched.alias("enriched"), F.col("__c").alias("command_line_status"), F.col("__e").alias("executable_status"), F.col("__h").alias("hash_status"), reason.alias("reason"))
    edr = F.struct(F.struct(proc.alias("proc")).alias("enrichment"))
    return staged.withColumns({"process": process, "edr": edr}).select(*documents.columns, *([] if "edr" in documents.columns else ["edr"]))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the latest row of ``right`` for the same keys, not later than itself (null: none).

    One sort over both sides by key and time; no join, so a key's rows never multiply.
    """
    types = dict(left.dtypes) | dict(right.dtypes)
    event = left.withColumns({v: F.lit(None).cast(types[v]) for v in values} | {"__t": F.col(left_time), "__left": F.lit(1)})
    state = right.select(*keys, *values, F.col(right_time).alias("__t")).withColumns({c: F.lit(None).cast(types[c]) for c in left.columns if c not in keys} | {"__left": F.lit(0)})
    order = Window.partitionBy(*keys).orderBy("__t", "__left").rowsBetween(Window.unboundedPreceding, 0)
    packed = F.last(F.when(F.col("__left") == 0, F.struct(*values)), ignorenulls=True).over(order)
    both = event.select(*left.columns, *values, "__t", "__left").unionByName(state.select(*left.columns, *values, "__t", "__left"))
    return both.withColumn("__s", packed).where("__left = 1").select(*left.columns, *[F.col("__s").getField(v).alias(v) for v in values])
