"""Streams fed file by file: in order, late within the watermark, too late."""

import json

import pytest
from pyspark.sql import functions as F

from duskwatch.plans import hunts
from duskwatch.session import scratch
from duskwatch.sources import audit, eve, lines, osquery
from duskwatch.streaming import stateful, streams

RUN = "0123456789abcdef0123456789abcdef"


def stamp(minute):
    return f"2026-01-06T{minute // 60:02d}:{minute % 60:02d}:00+00:00"


class Feed:
    """A folder that gains one file per step, and a stream that is drained after each."""

    def __init__(self, spark, folder, source, build):
        self.spark, self.folder = spark, folder
        self.folder.mkdir()
        self.source, self.build = source, build
        self.path, self.checkpoint = scratch(spark, "out"), scratch(spark, "cp")
        self.step, self.late = 0, 0

    def add(self, records, name="part"):
        self.step += 1
        (self.folder / f"{name}-{self.step}").mkdir()
        (self.folder / f"{name}-{self.step}" / f"runner-t-{RUN}.jsonl").write_text(
            "\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))
        table, query = streams.drain(
            self.build(self.source(self.spark, str(self.folder))), self.path, self.checkpoint)
        self.late += streams.late_rows(query)
        return table


def ev(minute, kind="dns", flow_id=0, **more):
    return {"timestamp": stamp(minute), "event_type": kind, "flow_id": flow_id, **more}


def test_windows_and_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", eve.stream_eve, lambda e: streams.event_counts(e, "1 hour", "10 minutes"))
    feed.add([ev(5), ev(30), ev(62)])
    feed.add([ev(55), ev(75), ev(131)])  # 00:55 is late but within ten minutes of 01:02
    table = feed.add([ev(20), ev(200)])  # 00:20 is too late
    got = {(r.start_ts.hour, r.n) for r in table.collect()}
    assert got == {(0, 3), (1, 2), (2, 1)}
    assert feed.late == 1


def test_egress_updates(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    path, checkpoint = scratch(spark, "up"), scratch(spark, "cp")

    def run():
        hot = streams.egress(eve.stream_eve(spark, str(folder)), 100, "1 hour", "30 minutes")
        return {(r.start_ts.hour * 60 + r.start_ts.minute, r.up) for r in
                streams.drain_updates(hot, ["start_ts", "src_ip"], path, checkpoint).collect()}

    def flow(minute, sent, dest="8.8.8.8"):
        return json.dumps(ev(minute, "flow", src_ip="10.0.0.1", dest_ip=dest, flow={"bytes_toserver": sent}))

    (folder / "a").write_text("\n".join([flow(65, 80), flow(70, 500, "10.0.0.9")]))
    assert run() == set()
    (folder / "b").write_text(flow(95, 50))
    assert run() == {(60, 130)}
    (folder / "c").write_text(flow(96, 60))
    assert run() == {(60, 190), (90, 110)}


def test_dedupe_across_files(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", eve.stream_eve,
                lambda e: streams.dedupe(e.select("event_ts", "flow_id"), ["event_ts", "flow_id"], "1 hour"))
    feed.add([ev(1, flow_id=1), ev(1, flow_id=1), ev(2, flow_id=2)])
    table = feed.add([ev(1, flow_id=1), ev(2, flow_id=3)])
    assert sorted(r.flow_id for r in table.collect()) == [1, 2, 3]


def au(minute, event, **more):
    return {"ts": stamp(minute), "event": event, **more}


def test_run_states_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", audit.stream_audit, stateful.run_states)
    feed.add([au(2, "prompt"), au(0, "run_start")])
    feed.add([au(3, "run_code_call", tool_call_id="a"), au(4, "model_text", content="x"), au(5, "prompt")])
    table = feed.add([au(6, "prompt"), au(7, "interrupted"), au(8, "run_end", status="failed")])
    got = [(r.event, r.before, r.state, r.illegal) for r in table.orderBy("us").collect()]
    assert got == [
        ("run_start", "none", "ready", False), ("prompt", "ready", "running", False),
        ("model_text", "running", "active", False), ("prompt", "active", "running", False),
        ("prompt", "running", "running", True), ("interrupted", "running", "interrupted", False),
        ("run_end", "interrupted", "failed", False)]


def test_calls_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", audit.stream_audit, lambda a: stateful.call_results(a, 3600, "10 minutes"))
    feed.add([au(0, "run_code_call", tool_call_id="a"), au(1, "tool_call", tool_call_id="b"),
              au(2, "tool_call", tool_call_id="d")])
    feed.add([au(5, "run_code_return", tool_call_id="a"), au(6, "tool_result", tool_call_id="c"),
              au(7, "tool_call", tool_call_id="d")])
    table = feed.add([au(200, "tool_call", tool_call_id="z")])
    got = {(r.tool_call_id, r.status) for r in table.collect()}
    assert got == {("a", "answered"), ("c", "unmatched"), ("b", "pending_late"), ("d", "pending"), ("d", "pending_late")}


def test_silences_across_batches(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in", audit.stream_audit, lambda a: stateful.stall_watch(a, 1800, "5 minutes"))
    feed.add([au(0, "run_start"), au(1, "prompt")])
    first = feed.add([au(45, "model_text"), au(46, "prompt")])
    assert [(r.event, r.since_us % 3_600_000_000 // 60_000_000) for r in first.collect()] == [("prompt", 1)]
    table = feed.add([au(47, "run_end", status="completed")])
    assert table.count() == 1


def test_beacon_sums_equal_the_batch_form(spark, tmp_path):
    from duskwatch.operators import net

    def flow(i, minute):
        return ev(minute, "flow", flow_id=i, src_ip="10.0.0.1", dest_ip="1.1.1.1", dest_port=443, proto="TCP",
                  flow={"bytes_toserver": 100 + i % 3})

    times = [0, 3, 5, 11, 12, 20, 22, 31, 40, 41]
    feed = Feed(spark, tmp_path / "in", eve.stream_eve, stateful.beacons)
    for a, b in ((0, 4), (4, 5), (5, 10)):
        running = feed.add([flow(i, times[i]) for i in range(a, b)])
    got = stateful.beacon_scores(running).first()
    want = net.beacons(eve.read_eve(spark, str(tmp_path / "in"))).first()
    assert got.gaps == want.gaps == 9
    assert got.score == pytest.approx(want.score) and got.cv_bytes == pytest.approx(want.cv_bytes)


def test_quarantine_and_rules(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a").write_text('{"event_type":"alert","alert":{"signature":"s"}}\nbroken\n\n[]\n'
                              '{"event_type":"tls","tls":{"version":"TLSv1"}}\n{"event_type":"tls","tls":{"version":"TLS 1.3"}}\n')
    good, bad = streams.drain_quarantine(lines.stream_lines(spark, str(folder)), scratch(spark, "q"))
    assert good.count() == 3 and {r._raw for r in bad.collect()} == {"broken", "[]"}
    hits, _ = streams.drain(streams.net_rules(eve.stream_eve(spark, str(folder))))
    assert {(r.rule, r.detail) for r in hits.collect()} == {("alert", "s"), ("old_tls", "TLSv1")}
    hosts = tmp_path / "hosts"
    hosts.mkdir()
    (hosts / "a").write_text(
        '{"name":"shell_history","columns":{"command":"wget x"}}\n{"name":"shell_history","columns":{"command":"ls"}}\n'
        '{"name":"suspicious_process_envs","columns":{"key":"LD_PRELOAD"}}\n')
    found, _ = streams.drain(streams.host_rules(osquery.stream_osquery(spark, str(hosts))))
    assert {(r.rule, r.detail) for r in found.collect()} == {("fetch", "wget x"), ("env_hijack", "LD_PRELOAD")}


def test_hunts_are_found_by_name(spark):
    assert [n for n, _ in hunts.find_hunts("lineage")] == ["host_process_lineage"]
    with pytest.raises(KeyError, match="known hunts"):
        hunts.run_hunt("nothing")
    with pytest.raises(ValueError, match="exists already"):
        hunts.hunt("beacons", "net")(len)
    df = spark.createDataFrame([("tls", ("a",))], "event_type string, tls struct<sni: string>")
    assert hunts.run_hunt("net_rare_names", df).select(F.col("sni")).first().sni == "a"


def test_backlog_dedupe_by_keys_without_time(spark, tmp_path):
    from duskwatch.streaming import backlog
    schema = "event_ts timestamp, id int"
    rows = [("2026-01-06 10:00:00", 1), ("2026-01-07 10:00:00", 1), ("2026-01-07 11:00:00", 2)]
    data = spark.createDataFrame(rows, "t string, id int").select(F.to_timestamp("t").alias("event_ts"), "id")
    for i, part in enumerate((data.limit(2), data)):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    once = backlog.dedupe(events, ["id"], scratch(spark, "once"))
    assert sorted(r.id for r in once.collect()) == [1, 2]
