"""Small logs collected into large files, exports in order of time, and state by bucket."""

import glob
import gzip
import json
import os

from pyspark.sql import functions as F

from duskwatch.plans import raw, stream_queries
from duskwatch.sources import audit, corpus, eve, lines
from duskwatch.streaming import stateful, streams

SF = "/root/testdata/sf0.001"
RUN = "0123456789abcdef0123456789abcdef"


def test_collected_lines(spark, tmp_path):
    name = f"runner-a-b-{RUN}.jsonl"
    (tmp_path / "all.log").write_text("\n".join([
        f'{name}\t7\t{{"ts": "2026-01-06T00:00:00+00:00", "event":\t"prompt"}}', f"{name}\t8\t", f"{name}\t9\tbroken",
        f'{name}\t6\t{{"ts": "2026-01-06T00:00:00+00:00", "event": "run_start"}}', '{"event":\t1\t}']))
    rows = audit.read_collected(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.task_id, r.run_id, r.seq, r.event) for r in rows if r.run_id] == [
        ("a-b", RUN, 6, "run_start"), ("a-b", RUN, 7, "prompt")]
    assert [r.event for r in rows if not r.run_id] == ["1"]
    assert lines.collected(lines.read_lines(spark, str(tmp_path))).where("_place is null").count() == 1


def test_collected_reports(spark, tmp_path):
    spark.createDataFrame([("analyst_log-26-01-06_10-00-00.md", "a\nb\n"), ("x", None)], "path string, text string").write.parquet(
        str(tmp_path / "in"))
    got = {r.kind: (str(r.stamp), r.text) for r in corpus.read_collected(spark, str(tmp_path / "in")).collect()}
    assert got == {"report": ("2026-01-06 10:00:00", "a\nb\n"), "other": ("None", None)}


def test_trails_lie_in_few_files_one_after_the_other(spark):
    files = glob.glob(raw.audit(spark, SF) + "/log=*/part-*")
    runs = audit.read_collected(spark, raw.audit(spark, SF)).select("run_id").distinct().count()
    assert len(files) < 40 and runs == 60  # a file for each run before, so as many files as runs
    newest = None
    for file in sorted(files, key=os.path.getmtime):
        with gzip.open(file, "rt") as f:
            times = [json.loads(line.split("\t", 2)[2])["ts"] for line in f]
        assert len(times) <= raw.LINES and (newest is None or newest <= min(times))
        newest = max(times)


def test_exports_are_compressed(spark):
    for folder in (raw.eve(spark, SF), raw.eve_overlap(spark, SF), raw.osquery(spark, SF), raw.audit(spark, SF)):
        parts = glob.glob(folder + "/**/part-*", recursive=True)
        assert parts and all(p.endswith(".gz") for p in parts)


def test_state_is_kept_by_bucket(spark, tmp_path):
    flow = {"event_type": "flow", "dest_ip": "1.1.1.1", "dest_port": 443, "proto": "TCP", "flow": {"bytes_toserver": 5}}
    (tmp_path / "a").write_text("\n".join(json.dumps(
        {**flow, "timestamp": f"2026-01-06T00:00:{s:02d}+00:00", "flow_id": i, "src_ip": f"10.0.{i // 250}.{i % 250}"})
        for i in range(1000) for s in (0, 7, 14)))
    table, query = streams.drain(stateful.beacons(eve.stream_eve(spark, str(tmp_path)), buckets=16))
    assert query.recentProgress[0]["stateOperators"][0]["numRowsTotal"] <= 16  # one for each tuple before
    scores = stateful.beacon_scores(table, 2)
    assert scores.count() == 1000 and {(r.gaps, r.score) for r in scores.collect()} == {(2, 1.0)}


def _records(folder, name, *records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(
        {"timestamp": f"2026-01-{day:02d}T00:00:00+00:00", "event_type": "flow", "flow_id": 1, "src_port": port})
        for day, port in records))
    at = 1_700_000_000 + len(list(folder.iterdir()))
    os.utime(folder / name, (at, at))


def _stream(spark, folder):
    rows = eve.stream_eve(spark, str(folder), 1)
    return rows.select("event_ts", "src_port", F.md5("_raw").alias("line"))


def test_a_stream_that_is_ahead_does_not_make_rows_of_another_late(spark, tmp_path):
    for day in (6, 8, 10, 12):
        _records(tmp_path / "log", f"{day}", (day, 1), (day, 2))
    _records(tmp_path / "rotated", "all", (6, 1), (12, 1))
    a, b = _stream(spark, tmp_path / "log"), _stream(spark, tmp_path / "rotated")
    table, query = streams.drain(streams.dedupe(a, ["line"], "1 day", b))
    assert sorted((r.event_ts.day, r.src_port) for r in table.collect()) == [
        (day, port) for day in (6, 8, 10, 12) for port in (1, 2)]
    assert streams.late_rows(query) == 0


def test_records_of_one_flow_and_time_are_no_copies(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(40)
    # Four records in a row share flow, time and type here.
    grown = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn(
        "event_id", F.expr("event_id * 4 + k")).drop("k")
    grown.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    want = grown.count()
    assert stream_queries.stream_dedupe(spark, str(tmp_path)).count() == want
    assert stream_queries.backlog_dedupe(spark, str(tmp_path)).count() == want


def test_names_of_a_catalogue_are_not_broadcast(spark):
    from duskwatch.plans import source_queries
    plan = source_queries.alias_resolve(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert plan.count("SortAggregate") <= 2 and plan.rindex("SortAggregate") < plan.rindex("REPARTITION")


def test_lines_of_trails_are_made_after_their_rows_are_dealt_out(spark):
    from duskwatch.plans import adapters
    rows = adapters.run(spark, SF, raw._by_day("audit-"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("RepartitionByExpression")
    assert "repeat(" in above and "repeat(" not in below
    for file in glob.glob(raw.audit(spark, SF) + "/log=*/part-*"):
        with gzip.open(file, "rt") as f:
            times = [json.loads(line.split("\t", 2)[2])["ts"] for line in f]
        assert times == sorted(times)


def test_a_line_is_taken_apart_once(spark, tmp_path):
    (tmp_path / "a").write_text("x\t1\t{}")
    plan = audit.read_collected(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("FileScan")[0]
    # Once for the columns and once for the test on blank lines that stands below them.
    assert plan.count(r"regexp_extract(value") <= 2 and "regexp_replace" not in plan


def test_what_counts_as_an_object(spark):
    import itertools
    from duskwatch.functions.json import with_object
    ends = ["", " ", "\t\n", "\r", "\x0b", "x", "}", "{", "\xa0"]
    texts = [a + body + b for a, b in itertools.product(ends, ends) for body in ('{"a": 1}', '{"a":\n1}', "")]
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "line string")
    whole = F.col("line").rlike(r"(?s)^\s*\{.*\}\s*$")
    got = with_object(rows, "line", "a int", "o").select("line", whole.alias("whole"), "o.a").collect()
    assert sum(r.a == 1 for r in got) > 20
    assert all(r.whole for r in got if r.a is not None)
    assert {r.line for r in got if r.a == 1} == {
        a + body + b for a, b in itertools.product(ends[:4], ends[:4]) for body in ('{"a": 1}', '{"a":\n1}')}


def test_only_the_fields_asked_for_are_made_of_a_line(spark, tmp_path):
    name = f"runner-a-{RUN}.jsonl"
    (tmp_path / "all.log").write_text("\n".join([
        f'{name}\t1\t{{"ts": "2026-01-06T00:00:00+00:00", "event": "prompt", "content": {{"a": [1]}}, "max_turns": "x"}}',
        f'{name}\t2\t{{"ts": 5, "event": null, "content": "a\\qb"}}', f'{name}\t3\t{{"event": "error"}} tail', f"{name}\t4",
        f'{name}\t5\t  {{"event": "run_end", "content": "z"}} ', f"{name}\t6\t   ", f"x{name}\t7\t[]"]))
    read = lines.collected(lines.read_lines(spark, str(tmp_path)))
    some = audit.events(read, ("event", "tool_call_id"))
    names = ["task_id", "run_id", "ts", "seq", "event", "tool_call_id"]
    want = sorted(map(tuple, audit.events(read).select(*names).collect()), key=repr)
    assert sorted(map(tuple, some.select(*names).collect()), key=repr) == want and {r[3] for r in want} == {1, 5}
    assert "content" not in some.columns and "content" not in some._jdf.queryExecution().executedPlan().toString()


def test_a_label_is_looked_for_before_the_second_tab_only(spark, tmp_path):
    (tmp_path / "a").write_text("x\t1\t{}\nx\t1\n{\t2\t\nx\tq\t{}\n\t1\t{}\nx\t-3\t\t{}")
    got = lines.collected(lines.read_lines(spark, str(tmp_path)))
    assert sorted((r._raw, r._place or 0) for r in got.collect()) == [
        ("\t1\t{}", 0), ("\t{}", -3), ("x\t1", 0), ("x\tq\t{}", 0), ("{\t2\t", 0), ("{}", 1)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract(concat(substring_index(" in plan and "regexp_extract(value" not in plan


def test_lines_of_events_are_made_after_their_rows_are_dealt_out(spark):
    rows = raw.net_lines(spark, SF, raw._by_day("eve-", ".json"), ("log",))
    above, below = rows._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")
    assert "StructsToJson" in above and "StructsToJson" not in below
    newest, n = "", 0
    for file in sorted(glob.glob(raw.eve(spark, SF) + "/log=eve-*.json/part-*"), key=os.path.getmtime):
        with gzip.open(file, "rt") as f:
            found = f.read().split("\n")[:-1]
        times = [json.loads(line)["timestamp"] for line in found if line.startswith("{") and line.endswith("}")]
        assert len(found) <= raw.LINES and times == sorted(times) and newest <= times[0]
        newest, n = times[-1], n + len(found)
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert n == events.count() + events.where("event_id % 101 = 0").count()
