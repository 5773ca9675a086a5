import pyarrow as pa
import pytest

from tracewarden.llm._util import SHUFFLE_CLEANUP, cut, slices


@pytest.mark.parametrize("texts", [[], ["a"], [None, "", None], ["x" * 30] * 7, ["x" * 500, "a", "b" * 99, None, "c" * 100, "d"]])
def test_parts_are_bounded_and_whole(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "text"])
    parts = [p.column(1).to_pylist() for p in slices(batch, 1, 3, 100)]
    assert [t for p in parts for t in p] == texts
    assert all(1 <= len(p) <= 3 and (len(p) == 1 or sum(len(t or "") for t in p) <= 100) for p in parts)


@pytest.mark.parametrize("setting", [None, "false"])
def test_cut_keeps_rows_and_the_setting(spark, setting):
    if setting:
        spark.conf.set(SHUFFLE_CLEANUP, setting)
    before = spark.conf.get(SHUFFLE_CLEANUP)
    counted = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    done = cut(counted)
    rows = [(k, len(range(k, 1000, 7))) for k in range(7)]
    assert sorted(map(tuple, done.collect())) == sorted(map(tuple, done.collect())) == rows
    assert sorted(map(tuple, cut(counted).collect())) == rows  # what was cut once can be computed again
    assert spark.conf.get(SHUFFLE_CLEANUP) == before
    spark.conf.unset(SHUFFLE_CLEANUP)
