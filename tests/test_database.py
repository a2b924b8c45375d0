import os
import subprocess
import sys
from datetime import date, datetime
from pathlib import Path

import pytest

from sparkoire.sources import sinks, tables

SF = "/root/testdata/sf0.001"
ROWS = [
    (1, 'a "quoted" word, and a comma', 1.5, True, date(2024, 2, 29), datetime(2024, 1, 2, 3, 4, 5, 678901)),
    (2, "two\nlines\r\nand\rmore", -0.1, False, None, None),
    (3, "", 1e-300, None, date(1969, 12, 31), datetime(1969, 12, 31, 23, 59, 59)),
    (4, None, None, None, None, None),
    (5, "  blanks around  ", 123456789.125, True, date(9999, 1, 1), datetime(2024, 1, 1)),
    (None, 'back\\slash \\" é 漢 😀 ""', 1e300, False, None, None),
    (5, '"', 0.0, False, None, None),
]


@pytest.mark.parametrize("rows", [250_000, 2])
def test_embedded_database_keeps_odd_values(spark, tmp_path, rows):
    df = spark.createDataFrame(ROWS, "id long, text string, x double, flag boolean, day date, at timestamp").repartition(3)
    sinks.embedded(df, f"{tmp_path}/db", "odd", createTableColumnTypes="text VARCHAR(64)")
    url = sinks.packed_database(spark, f"{tmp_path}/db")
    assert os.listdir(tmp_path) == ["db.jar"]
    read = tables.database_table(spark, url, "odd", "id", rows)
    assert read.rdd.getNumPartitions() == (1 if rows > 7 else 4)
    assert sorted(map(tuple, read.collect()), key=str) == sorted(ROWS, key=str)


def test_embedded_database_without_rows(spark, tmp_path):
    sinks.embedded(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/db", "nothing")
    assert tables.database_table(spark, sinks.packed_database(spark, f"{tmp_path}/db"), "nothing", "id").collect() == []


CLUSTER = f"""
from pyspark.sql import SparkSession
conf = {{"spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.executor.memory": "600m"}}
import sys
spark = SparkSession.builder.master("local-cluster[2,1,600]").config(map=conf | {{"spark.checkpoint.dir": "file://" + sys.argv[1]}}).getOrCreate()
from sparkoire.plans import layouts
got = layouts.database_load(spark, "{SF}").repartition(3).collect()
part = spark.read.parquet("{SF}/part.parquet").select("p_partkey", "p_brand", "p_retailprice").collect()
assert sorted(map(tuple, got)) == sorted(map(tuple, part)) and got
"""


def test_database_load_where_executors_are_other_processes(tmp_path):
    repo = str(Path(__file__).resolve().parents[1])
    run = subprocess.run([sys.executable, "-c", CLUSTER, str(tmp_path / "shared")], cwd=tmp_path, env=os.environ | {"PYTHONPATH": repo}, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
