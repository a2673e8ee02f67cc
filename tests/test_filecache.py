"""A cache that follows its files: what is read again, what is seen, and what two writers do."""

import json
import os

import pytest
from pyspark.sql import functions as F

from duskwatch.sinks import commits, filecache
from duskwatch.sources import eve


class Log:
    """A folder of logs, a cache over it, and the files that were read each time."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.cache = spark, folder / "a log", str(folder / "cache")
        self.folder.mkdir()
        self.read = []

    def write(self, name, *flow_ids, kind="dns"):
        lines = [json.dumps({"event_type": kind, "flow_id": i}) for i in flow_ids]
        (self.folder / name).write_text("\n".join(lines))
        # A file of the same size needs another time to be seen as another.
        self.clock = getattr(self, "clock", 1_700_000_000) + 10
        os.utime(self.folder / name, (self.clock, self.clock))

    def build(self, files):
        self.read.append(sorted(f.rsplit("/", 1)[1] for f in files))
        return eve.read_eve(self.spark, files).select("event_type", "flow_id", "_file")

    def ids(self):
        rows = filecache.follow(self.spark, self.build, self.cache, str(self.folder), ("event_type",))
        assert set(rows.columns) == {"event_type", "flow_id", "_file"}
        return sorted(r.flow_id for r in rows.collect())


@pytest.fixture
def log(spark, tmp_path):
    return Log(spark, tmp_path)


def test_only_new_and_changed_files_are_read(log):
    log.write("a.json", 1, 2)
    log.write("b b.json", 3)
    assert log.ids() == [1, 2, 3] and log.ids() == [1, 2, 3]
    assert log.read == [["a.json", "b b.json"]]
    log.write("c.json", 4, kind="tls")
    assert log.ids() == [1, 2, 3, 4] and log.read[1:] == [["c.json"]]
    log.write("a.json", 7, 8)
    assert log.ids() == [3, 4, 7, 8] and log.read[2:] == [["a.json"]]
    (log.folder / "b b.json").unlink()
    assert log.ids() == [4, 7, 8] and len(log.read) == 3
    log.write("b b.json", 9)
    assert log.ids() == [4, 7, 8, 9] and log.read[3:] == [["b b.json"]]
    assert {r.file.rsplit("/", 1)[1] for r in filecache.manifest(log.spark, log.cache).collect()} == {
        "a.json", "b%20b.json", "c.json"}
    for name in ("a.json", "b b.json", "c.json"):
        (log.folder / name).unlink()
    assert log.ids() == [] and log.ids() == []
    log.write("a.json", 1)
    assert log.ids() == [1]


def test_stored_files_are_the_ones_scanned(log):
    log.write("a.json", 1, 2)
    log.ids()
    log.write("b.json", 3)
    rows = filecache.follow(log.spark, log.build, log.cache, str(log.folder), ("event_type",))
    assert all("/cache/data/" in f for f in rows.inputFiles()) and len(rows.inputFiles()) == 2
    plan = rows.where("event_type = 'dns'").select("flow_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_type" in plan and "ReadSchema: struct<flow_id:bigint>" in plan


def test_generations_are_merged(log):
    for i in range(10):
        log.write(f"{i}.json", i)
        if i == 5:
            log.write("0.json", 100)
        assert log.ids() == sorted([*range(1, i + 1), 100] if i >= 5 else range(i + 1))
    names = {r.generation for r in filecache.manifest(log.spark, log.cache).collect()}
    assert len(names) < 10 and any(n.endswith("-merged") for n in names)
    assert all(len(files) <= 2 for files in log.read)


def test_a_broken_build_is_not_seen(log):
    log.write("a.json", 1)
    log.ids()
    log.write("b.json", 2)
    good, log.build = log.build, lambda files: good(files).withColumn(
        "flow_id", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(Exception, match="broken"):
        log.ids()
    log.build = good
    assert log.ids() == [1, 2] and commits.latest(log.spark, f"{log.cache}/manifest") == 2


def test_the_later_of_two_writers_starts_over(log):
    log.write("a.json", 1)
    log.ids()
    log.write("b.json", 2)
    first = log.build

    def meanwhile(files):
        log.build = first
        assert log.ids() == [1, 2]  # another session is faster
        return first(files)

    log.build = meanwhile
    assert log.ids() == [1, 2] and commits.latest(log.spark, f"{log.cache}/manifest") == 2


def test_refusals(log):
    with pytest.raises(ValueError, match="no input files"):
        log.ids()
    log.write("a.json", 1)
    log.ids()
    log.write("b.json", 2)
    good, log.build = log.build, lambda files: good(files).withColumn("more", F.lit(1))
    with pytest.raises(ValueError, match="columns"):
        log.ids()
    log.build = lambda files: good(files).drop("_file")
    with pytest.raises(ValueError, match="_file"):
        log.ids()


def test_publishing_twice_conflicts(spark, tmp_path):
    folder = str(tmp_path / "m")
    write = lambda place: spark.range(1).write.parquet(place)
    assert commits.latest(spark, folder) is None
    commits.publish(spark, folder, 1, write)
    with pytest.raises(commits.Conflict):
        commits.publish(spark, folder, 1, write)
    commits.publish(spark, folder, 2, write)
    assert commits.latest(spark, folder) == 2
    assert spark.read.parquet(commits.place(folder, 2)).count() == 1
