"""Request and response rows joined into one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pair(events: DataFrame, key: str, order: list[str], is_enter: Column, is_exit: Column, carry: list[str], ok: Column | None = None) -> DataFrame:
    """Exits with the ``carry`` columns (as enter_...) of the last unanswered enter of the same key before them.

    Each enter is answered once: a second exit without a new enter has no partner and is left out, as are exits for
    which ``ok`` (over the exit's columns) is false; such an exit still uses its enter up. One sort, no join.
    """
    by = Window.partitionBy(key).orderBy(*order)
    rows = events.where(is_enter | is_exit).withColumns({"__exit": is_exit, "__ok": F.lit(True) if ok is None else F.coalesce(ok, F.lit(False))})
    rows = rows.withColumns({"__before": F.lag("__exit").over(by)} | {f"enter_{c}": F.lag(c).over(by) for c in carry})
    # the row before an exit is its enter, or another exit, which has used up any enter before it
    return rows.where(F.col("__exit") & ~F.col("__before") & F.col("__ok")).drop("__exit", "__before", "__ok")
