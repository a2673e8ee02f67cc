"""Online streams whose rows come in any order within the delay, against the batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import net
from duskwatch.session import scratch
from duskwatch.sources import eve
from duskwatch.streaming import backlog, machines, online, stateful, streams

AUDIT = "run_id string, us bigint, seq bigint, event string, status string, tool_call_id string"
HOUR = 3600


class Shuffled:
    """Records in files that are up to ``delay_s`` out of order, three files for each batch."""

    def __init__(self, spark, folder, rows, schema, ts="ts", delay_s=2 * HOUR, files=24, seed=1):
        self.spark, self.folder, self.schema, self.ts = spark, folder, schema, ts
        folder.mkdir()
        rng = random.Random(seed)
        # A row may be passed by rows of up to the delay later.
        order = sorted(rows, key=lambda r: r["us"] + rng.uniform(0, 0.9) * delay_s * 1e6)
        for i in range(files):
            own = order[i * len(order) // files : (i + 1) * len(order) // files]
            rng.shuffle(own)
            (folder / f"{i:03d}.json").write_text("\n".join(map(json.dumps, own)))
            import os
            os.utime(folder / f"{i:03d}.json", (1_700_000_000 + i, 1_700_000_000 + i))

    def stream(self):
        rows = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 3).json(str(self.folder))
        return rows.withColumn(self.ts, F.timestamp_micros("us"))

    def batch(self):
        return self.spark.read.schema(self.schema).json(str(self.folder)).withColumn(self.ts, F.timestamp_micros("us"))


def trail(seed, runs=6, hours=40):
    """Runs that end, stall, go on after their end, or never end; ids called again; a last mark."""
    rng, rows, seq = random.Random(seed), [], 0
    start = 1_767_225_600_000_000
    kinds = ["prompt", "model_text", "run_code_call", "run_code_return", "tool_call", "tool_result", "error", "note"]
    for r in range(runs):
        at = start + rng.randint(0, 5 * HOUR) * 1_000_000
        rows.append({"run_id": f"r{r}", "us": at, "event": "run_start"})
        for _ in range(60):
            at += rng.choice([0, 1, 30, 400, 5000]) * 1_000_000
            kind = rng.choice(kinds)
            rows.append({"run_id": f"r{r}", "us": at, "event": kind,
                         "tool_call_id": f"c{rng.randint(0, 9)}" if "call" in kind or "re" in kind else None})
        if r % 3:
            rows.append({"run_id": f"r{r}", "us": at + 1, "event": "run_end", "status": "completed"})
        if r == 4:
            rows.append({"run_id": f"r{r}", "us": at + 2, "event": "prompt"})
    for row in rows:
        seq += 1
        row["seq"] = seq
    end = max(r["us"] for r in rows) + 400 * HOUR * 1_000_000
    return rows, [{"run_id": "mark", "us": end, "event": "run_start", "seq": 0, "tool_call_id": "m"},
                  {"run_id": "mark", "us": end, "event": "tool_call", "seq": 1, "tool_call_id": "m"}]


def left_in_state(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


@pytest.fixture(scope="module", params=[1, 2])
def feed(spark, tmp_path_factory, request):
    rows, mark = trail(request.param)
    return Shuffled(spark, tmp_path_factory.mktemp("trail") / "in", rows + mark, AUDIT, seed=request.param)


def but_mark(df):
    return sorted((tuple(r) for r in df.where("run_id <> 'mark'").collect()), key=repr)


DELAY = "2 hours"


@pytest.mark.parametrize("slot_s", [60, 1800])
def test_run_states(spark, feed, slot_s):
    table, query = streams.drain(online.run_states(feed.stream(), DELAY, slot_s, 100 * HOUR))
    want = but_mark(backlog.run_moves(feed.batch()))
    assert but_mark(table) == want and len(want) > 100 and any(r[-1] for r in want)
    assert streams.late_rows(query) == 0
    assert left_in_state(query) <= 6  # what is kept is of the mark, which waits for its slot


def test_calls(spark, feed):
    table, query = streams.drain(online.call_results(feed.stream(), HOUR, DELAY, 600, 100 * HOUR))
    want = but_mark(backlog.call_moves(feed.batch(), HOUR))
    assert but_mark(table) == want and {r[-1] for r in want} == {"answered", "pending", "pending_late", "unmatched"}
    assert left_in_state(query) <= 6


def test_silences(spark, feed):
    table, query = streams.drain(online.stall_watch(feed.stream(), HOUR, DELAY, 600, 100 * HOUR))
    want = but_mark(backlog.stall_moves(feed.batch(), HOUR))
    assert but_mark(table) == want and len(want) > 10
    assert left_in_state(query) <= 6


def test_a_run_that_goes_on_after_it_was_forgotten_begins_anew(spark, tmp_path):
    start = 1_767_225_600_000_000
    at = lambda h: start + h * HOUR * 1_000_000
    rows = [(0, "run_start"), (1, "prompt"), (50, "model_text"), (100, "note")]
    rows = [{"run_id": "a", "us": at(h), "seq": h, "event": e} for h, e in rows if e != "note"]
    rows += [{"run_id": "b", "us": at(h), "seq": h, "event": "error"} for h in (0, 3, 20, 49, 90, 99)]
    feed = Shuffled(spark, tmp_path / "in", rows, AUDIT, delay_s=1, files=9)
    table, _ = streams.drain(online.run_states(feed.stream(), "1 second", 600, 10 * HOUR))
    assert [tuple(r) for r in table.where("run_id = 'a'").orderBy("us").select("before", "illegal").collect()] == [
        ("none", False), ("ready", False), ("none", True)]


def test_beacons(spark, tmp_path):
    rng, rows = random.Random(7), []
    at = 1_767_225_600_000_000
    for i in range(400):
        at += rng.choice([0, 7, 60, 61, 300]) * 1_000_000
        rows.append({"us": at, "flow_id": i, "src_ip": f"10.0.0.{i % 3}", "dest_ip": "1.1.1.1", "dest_port": 443,
                     "proto": "TCP", "event_type": "flow" if i % 9 else "dns", "flow": {"bytes_toserver": 100 + i % 7}})
    rows.append({**rows[0], "us": at + 50 * HOUR * 1_000_000, "src_ip": "mark", "event_type": "flow"})
    schema = ("us bigint, flow_id bigint, src_ip string, dest_ip string, dest_port int, proto string, event_type string, "
              "flow struct<bytes_toserver: bigint>")
    feed = Shuffled(spark, tmp_path / "in", rows, schema, ts="event_ts")
    table, query = streams.drain(online.beacons(feed.stream(), DELAY, 600, 20 * HOUR))
    got = {r.src_ip: r for r in stateful.beacon_scores(table).collect()}
    want = {r.src_ip: r for r in net.beacons(feed.batch()).collect()}
    assert set(got) == set(want) == {"10.0.0.0", "10.0.0.1", "10.0.0.2"}
    for ip, r in want.items():
        assert got[ip].gaps == r.gaps and got[ip].score == pytest.approx(r.score)
    assert left_in_state(query) <= 6


def test_late_rows_are_counted_over_all_reports(spark, tmp_path):
    start = 1_767_225_600
    folder = tmp_path / "in"
    folder.mkdir()
    import os
    for i in range(12):
        stamps = [start + i * HOUR] + [start] * (i % 3)
        lines = [json.dumps({"timestamp": f"{s}", "event_type": "dns", "us": s * 1_000_000}) for s in stamps]
        (folder / f"{i:02d}").write_text("\n".join(lines))
        os.utime(folder / f"{i:02d}", (start + i, start + i))
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    spark.conf.set(kept, "3")
    try:
        rows = spark.readStream.schema("event_type string, us bigint").option("maxFilesPerTrigger", 1).json(str(folder))
        counts = streams.event_counts(rows.withColumn("event_ts", F.timestamp_micros("us")), "10 minutes", "10 minutes")
        _, query = streams.drain(counts)
    finally:
        spark.conf.unset(kept)
    # Rows of one window and type fold before they are counted, and a batch is held against the
    # watermark that the batch before it began with.
    assert streams.late_rows(query) == sum(i % 3 > 0 for i in range(3, 12)) == 6
    seen = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert seen < streams.late_rows(query)


def test_dedupe_state_is_taken_up_again(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", scratch(spark, "once"), scratch(spark, "cp")
    folder.mkdir()

    def add(name, *ids):
        lines = [json.dumps({"timestamp": "2026-01-06T00:00:00+00:00", "event_type": "dns", "flow_id": i}) for i in ids]
        (folder / name).write_text("\n".join(lines))
        rows = eve.stream_eve(spark, str(folder)).select("event_ts", "flow_id")
        return sorted((r.flow_id for r in backlog.dedupe(rows, ["flow_id"], path, checkpoint=checkpoint).collect()), key=repr)

    assert add("a", 1, 2, 1, None, None) == [1, 2, None]
    assert add("b", 2, 3, None) == [1, 2, 3, None]
    assert add("c", 3, 1) == [1, 2, 3, None]


def test_dedupe_reads_nothing_of_the_store(spark, tmp_path):
    """Batches of one size read and write as much late as early."""
    import os
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(8):
        (folder / f"{i}").write_text("\n".join(json.dumps({"us": i, "id": i * 500 + j}) for j in range(500)))
        os.utime(folder / f"{i}", (1_700_000_000 + i, 1_700_000_000 + i))
    rows = spark.readStream.schema("us bigint, id bigint").option("maxFilesPerTrigger", 1).json(str(folder))
    events = rows.withColumn("event_ts", F.timestamp_micros("us"))
    _, query = streams.drain(events.dropDuplicates(["id"]))
    batches = [p for p in query.recentProgress if p["numInputRows"]]
    assert [p["numInputRows"] for p in batches] == [500] * 8
    updated = [p["stateOperators"][0]["numRowsUpdated"] for p in batches]
    assert updated == [500] * 8
    plan = events.dropDuplicates(["id"])._jdf.queryExecution().analyzed().toString()
    assert "Join" not in plan


def test_what_waits_is_kept_by_batch_and_not_by_slot(spark, tmp_path):
    start = 1_767_225_600_000_000
    rows = [{"run_id": "a", "us": start + m * 60_000_000, "seq": m, "event": "prompt"} for m in range(300)]
    feed = Shuffled(spark, tmp_path / "in", rows, AUDIT, files=3)
    _, query = streams.drain(online.run_states(feed.stream(), "10 hours", 60))
    assert left_in_state(query) <= 5  # two for each slot before, of which there are 300


def test_pieces_hold_whole_slots_and_rows_come_once(spark, tmp_path, monkeypatch):
    rows, mark = trail(3)
    feed = Shuffled(spark, tmp_path / "in", rows + mark, AUDIT, seed=3)
    machine = online.machines.Moves()
    own = online._Ordered(machine, 600, 100 * HOUR)
    import pandas as pd
    frame = feed.batch().drop("ts").toPandas()
    kept = {(i, int(f["us"].min()), int(f["us"].max())): (machines.encoded(f),)
            for i, f in enumerate(frame.iloc[j::3] for j in range(3))}

    class Parts:
        keys = staticmethod(lambda: list(kept))
        getValue = staticmethod(kept.get)
        removeKey = staticmethod(kept.pop)

    own.parts, edge, got, released = Parts(), frame["us"].min() // 600_000_000 * 600_000_000, [], None
    monkeypatch.setattr(online, "ROWS", 7)
    while kept:
        edge += 40 * 600_000_000
        pieces, waiting = own._due(released, edge)
        slots = [set(p["us"] // 600_000_000) for p in pieces]
        assert all(max(a) < min(b) for a, b in zip(slots, slots[1:]))
        assert all(p["us"].is_monotonic_increasing and p["us"].max() < edge for p in pieces)
        assert all(w >= edge for w in waiting) and bool(waiting) == bool(kept)
        got, released = got + pieces, edge
    assert sorted(pd.concat(got)["seq"]) == sorted(frame["seq"])


def test_state_lies_in_few_partitions(spark, feed):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "300")
    try:
        most = streams.state_partitions(spark)
        assert most == max(16, 2 * spark.sparkContext.defaultParallelism)
        _, query = streams.drain(feed.stream().select("run_id").dropDuplicates())
        assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == most
        assert spark.conf.get("spark.sql.shuffle.partitions") == "300"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_files_are_written_in_one_pass_and_dated_by_stretch(spark):
    import glob
    import os
    from duskwatch.plans import adapters, raw
    rows = adapters.run(spark, "/root/testdata/sf0.001").select("run_id", "ts", "seq")
    late = rows.unionByName(rows.limit(3).withColumn("ts", F.lit(None).cast("timestamp")))
    folder, delay = raw.shuffled(spark, "/root/testdata/sf0.001", "one-pass", late, "ts")
    files = sorted(glob.glob(folder + "/part-*"), key=os.path.getmtime)
    assert len(files) <= raw.GROUPS * raw.SHARES and len({f.split("part-")[1].split("-", 1)[1] for f in files}) == 1  # six writes before
    assert len({os.path.getmtime(f) for f in files}) == len(files)
    spans = [spark.read.parquet(f).agg(F.unix_seconds(F.min("ts")), F.unix_seconds(F.max("ts"))).first() for f in files]
    assert all(high - low <= delay for low, high in spans)
    newest = [max(high for _, high in spans[: i + 1]) for i in range(len(spans))]
    assert all(low >= top - delay for (low, _), top in zip(spans, newest))
    assert sorted(map(tuple, spark.read.parquet(folder).collect())) == sorted(map(tuple, rows.collect()))
