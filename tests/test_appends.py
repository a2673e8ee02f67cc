"""Appends that are seen whole or not at all, and whose files do not follow their number."""

import os

import pytest
from pyspark.sql import functions as F

from duskwatch.sinks import appends, commits, generations, tables


def files_in_use(spark, path):
    return len(appends.read(spark, path).inputFiles())


def test_many_appends_make_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(10):
        appends.append(spark.range(10 * i, 10 * i + 10), path)
    assert sorted(r.id for r in appends.read(spark, path).collect()) == list(range(100))
    assert appends.read(spark, path, 3).count() == 30
    assert files_in_use(spark, path) <= 4
    written = sum(n.endswith(".parquet") for _, _, names in os.walk(path + "/data") for n in names)
    assert written > files_in_use(spark, path)


def test_a_failed_append_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "t")
    appends.append(spark.range(5), path)
    broken = spark.range(100).select(F.when(F.col("id") < 99, F.col("id")).otherwise(
        F.raise_error(F.lit("broken")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="broken"):
        appends.append(broken, path)
    assert appends.read(spark, path).count() == 5
    with pytest.raises(ValueError, match="columns"):
        appends.append(spark.range(5).withColumn("more", F.lit(1)), path)
    appends.append(spark.range(5, 6), path)
    assert appends.read(spark, path).count() == 6


def test_two_writers_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    appends.append(spark.range(1), path)
    publish, done = generations.publish, []

    def slow(*args):
        if not done:
            done.append(1)
            appends.append(spark.range(1, 2), path)  # another writer is faster
        return publish(*args)

    monkeypatch.setattr(generations, "publish", slow)
    appends.append(spark.range(2, 3), path)
    assert sorted(r.id for r in appends.read(spark, path).collect()) == [0, 1, 2]
    assert commits.latest(spark, f"{path}/manifest") == 3


def test_results_of_a_task(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(40).selectExpr("concat('t', id % 4) as task_id", "concat('r', id % 8) as run_id", "id")
    tables.save_all(rows, path)
    tables.save_all(rows.where("id < 4"), path)
    assert tables.results(spark, path).count() == 44
    one = tables.results(spark, path, "t1")
    assert {(r.task_id, r.run_id) for r in one.collect()} == {("t1", "r1"), ("t1", "r5")} and one.count() == 11
    assert tables.results(spark, path, "t1", "r5").count() == 5
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="reserved"):
        tables.save_all(rows.withColumn("task_id", F.lit("logs")), path)
    assert tables.results(spark, path).count() == 44


def test_nothing_stored(spark, tmp_path):
    assert not appends.exists(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="nothing is stored"):
        appends.read(spark, str(tmp_path / "none"))
    appends.append(spark.range(0), str(tmp_path / "empty"))
    assert appends.read(spark, str(tmp_path / "empty")).count() == 0
