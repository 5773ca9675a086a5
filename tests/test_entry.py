import os
import subprocess
import sys

import __spark_entry__
from tracewarden.queries import ORACLE_SQL, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_query_has_sql_of_the_same_name():
    assert set(ORACLE_SQL) == set(QUERIES)
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_optional_parts():
    code = "import sys; sys.modules['tracewarden.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) == len(e.oracle_sql()) > 50"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_workers_find_the_package_from_any_folder(tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
import __spark_entry__ as e
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert e.queries()["decode_records"](spark, "/root/testdata/sf0.001").count() > 0
"""
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=environment)


def test_nothing_else_imports_the_optional_parts():
    for folder, _, files in os.walk(os.path.join(ROOT, "tracewarden")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "llm" not in text.read(), f
