import json

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import common, net
from duskwatch.plans import adapters
from duskwatch.sinks import results, tables
from duskwatch.sources import audit, catalogue, corpus, eve, lines, osquery

# Line and whether a strict reader of one object per line takes it (None: blank).
LINES = [
    ('{"event_type": "dns", "flow_id": 7}', True),
    ("", None),
    ("  \t ", None),
    ('{"event_type": null}', True),
    ('{"flow_id": 3}', True),
    ('{"event_type": "dns", "flow_id"', False),
    ("123", False),
    ("[]", False),
    ("[{},{}]", False),
    ("null", False),
    ('"s"', False),
    ('{"flow_id": 1, "flow_id": 2, "event_type": "dup"}', True),
    ('{"flow": {"age": NaN}, "event_type": "nan"}', True),
    ('{"event_type": "a"} tail', False),
    ('{"event_type": "a"}{"event_type": "b"}', False),
    ('{"event_type": "a"},{"event_type": "b"}', False),
    ('  {"event_type": "pad"}  ', True),
    ('{"flow_id": "text", "event_type": "typed"}', True),
]


@pytest.fixture
def dirty(tmp_path):
    path = tmp_path / "eve-2026-01-21-01.json"
    path.write_text("\n".join(line for line, _ in LINES) + "\n")
    return str(path)


def test_dirty_lines_are_judged_as_json_loads_does(spark, dirty):
    for line, ok in LINES:
        try:
            good = isinstance(json.loads(line), dict)
        except ValueError:
            good = False
        assert good == bool(ok), line
    stats = lines.line_stats(lines.read_lines(spark, dirty)).first()
    assert (stats.lines, stats.blank, stats.malformed, stats.parsed) == (18, 2, 9, 7)
    assert stats.parsed + stats.blank + stats.malformed == stats.lines
    bad = {r._raw for r in lines.quarantine(lines.read_lines(spark, dirty)).collect()}
    assert bad == {line for line, ok in LINES if ok is False}


def test_absent_and_null_types_differ(spark, dirty):
    counts = {r.event_type: r.n for r in net.event_type_counts(eve.read_eve(spark, dirty)).collect()}
    assert counts == {"dns": 1, None: 1, "unknown": 1, "dup": 1, "nan": 1, "pad": 1, "typed": 1}
    rows = {r.event_type: r for r in eve.read_eve(spark, dirty).collect()}
    assert rows["dup"].flow_id == 2
    assert rows["typed"].flow_id is None
    assert net.drop_noise(eve.read_eve(spark, dirty)).count() == 7


def test_one_parse_per_line(spark, dirty):
    plan = eve.read_eve(spark, dirty).select("event_ts", "src_ip")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_reader_and_view_share_a_schema(spark):
    seen = eve.events(spark.createDataFrame([], "_raw string, _file string"))
    view = adapters.net(spark, "/root/testdata/sf0.001")
    kinds = {f.name: f.dataType.simpleString() for f in seen.schema}
    for f in view.schema:
        assert kinds[f.name] == f.dataType.simpleString(), f.name


@pytest.fixture
def rotated(tmp_path):
    def event(i):
        return json.dumps({"timestamp": f"2026-01-21T0{i // 60}:{i % 60:02d}:00.000000+0000",
                           "flow_id": i, "event_type": "flow", "extra": {"deep": [1, {"x": None}]}})

    (tmp_path / "eve-2026-01-21-01.json").write_text("\n".join(event(i) for i in range(0, 60)))
    (tmp_path / "eve-2026-01-21-02.json").write_text("\n".join(event(i) for i in range(50, 90)))
    (tmp_path / "eve.json").write_text("\n".join(event(i) for i in range(200, 210)))
    return tmp_path


def test_rotated_files(spark, rotated):
    both = eve.read_eve(spark, str(rotated / "eve-*.json"))
    assert both.count() == 100
    once = common.dedupe(both.drop("stats"))
    assert once.count() == 90
    assert once.where("flow_id = 55").first()._file.endswith("01.json")
    assert common.dedupe(both.drop("stats"), ["flow_id"]).count() == 90
    files = lines.inventory(spark, str(rotated)).select("name", "lines").collect()
    assert [tuple(r) for r in files] == [
        ("eve-2026-01-21-01.json", 60), ("eve-2026-01-21-02.json", 40), ("eve.json", 10)]
    assert [r.flow_id for r in common.sample(both.where("flow_id < 50")).collect()] == [0, 1, 2, 3, 4]
    assert net.mentions_raw(both, '"flow_id": 7,').count() == 1


def test_splitting_a_file_changes_nothing(spark, tmp_path, rotated, rows):
    whole = (rotated / "eve-2026-01-21-01.json").read_text().split("\n")
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a").write_text("\n".join(reversed(whole[:20])))
    (folder / "b").write_text("\n".join(whole[20:]))
    a = net.log_summary(eve.read_eve(spark, str(rotated / "eve-2026-01-21-01.json")))
    assert rows(a) == rows(net.log_summary(eve.read_eve(spark, str(folder))))


def test_field_profile(spark, tmp_path):
    path = tmp_path / "eve.json"
    path.write_text('{"event_type":"tls","tls":{"sni":"a"}}\n{"event_type":"tls","flow_id":1}\n')
    got = {(r.path, r.type): r.presence for r in net.field_profile(eve.read_eve(spark, str(path))).collect()}
    assert got == {("event_type", "STRING"): 1.0, ("tls", "OBJECT"): 0.5, ("tls.sni", "STRING"): 0.5,
                   ("flow_id", "BIGINT"): 0.5}


def test_stats_rollup(spark, tmp_path):
    path = tmp_path / "eve.json"
    path.write_text(
        '{"event_type":"stats","stats":{"uptime":10,"capture":{"kernel":{"drops":4,"name":"x"}}}}\n'
        '{"event_type":"stats","stats":{"uptime":30}}\n{"event_type":"dns"}\n'
        '{"event_type":"stats","stats":{"a":{"b":{"c":{"d":{"e":{"f":{"g":[1,[2,{"h":5}]]}}}}}},"z":[]}}\n')
    got = {r.path: (r.n, r.low, r.high, r["mean"]) for r in net.stats_rollup(eve.read_eve(spark, str(path))).collect()}
    assert got == {"uptime": (2, 10.0, 30.0, 20.0), "capture.kernel.drops": (1, 4.0, 4.0, 4.0),
                   "a.b.c.d.e.f.g[]": (1, 1.0, 1.0, 1.0), "a.b.c.d.e.f.g[][]": (1, 2.0, 2.0, 2.0),
                   "a.b.c.d.e.f.g[][].h": (1, 5.0, 5.0, 5.0)}


def test_host_records(spark, tmp_path):
    def record(name, columns, **more):
        return json.dumps({"name": name, "hostIdentifier": "h", "unixTime": "1776161472", "action": "added",
                           "columns": columns, "decorations": {"username": "u"}, **more})

    path = tmp_path / "osqueryd-results-2026-04-14.log"
    path.write_text("\n".join([
        record("all_processes", {"pid": "12", "parent": "x", "cmdline": "a b", "start_time": "1776161000"}),
        record("net_processes", {"pid": 12, "remote_port": "443"}, unixTime=1776161472),
        record("custom_pack", {"a": "1"}),
        record("all_processes", {}, unixTime=None, calendarTime="Tue Apr 14 10:11:12 2026 UTC"),
        '{"hostIdentifier": "h"}', '{"name": "all_pro'
    ]))
    rows = osquery.read_osquery(spark, str(path))
    assert {r.name: r.n for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()} == {
        "all_processes": 2, "net_processes": 1, "custom_pack": 1, "unknown": 1}
    proc = osquery.typed(rows, "all_processes").orderBy("pid").collect()
    assert proc[1].pid == 12 and proc[1].parent is None and proc[1].start_time.minute == 3
    assert proc[0].seen_ts == proc[1].seen_ts
    sock = osquery.typed(rows, "net_processes").first()
    assert (sock.pid, sock.remote_port, sock.remote_address) == (12, 443, None)
    assert {r.name for r in osquery.other_queries(rows).collect()} == {"custom_pack", "unknown"}


def test_audit_ids_come_from_the_file_name(spark, tmp_path):
    run = "0123456789abcdef0123456789abcdef"
    path = tmp_path / f"runner-my-task-2-{run}.jsonl"
    path.write_text("\n".join([
        json.dumps({"ts": "2026-07-19T10:00:00.000001+00:00", "event": "prompt", "prompt": "p"}),
        json.dumps({"ts": "2026-07-19T10:00:01+00:00", "event": "tool_result", "tool_call_id": "c",
                    "content": {"a": [1, 2]}, "overflow_bytes": 24000000}),
        json.dumps({"ts": "2026-07-19T10:00:02+00:00", "event": "tool_result", "content": 5})]))
    rows = audit.read_audit(spark, str(path)).orderBy("ts").collect()
    assert {(r.task_id, r.run_id) for r in rows} == {("my-task-2", run)}
    assert rows[0].ts.microsecond == 1
    assert [r.content for r in rows] == [None, '{"a":[1,2]}', "5"]
    assert rows[1].overflow_bytes == 24000000


def test_corpus_names(spark, tmp_path):
    (tmp_path / "analyst_log-26-07-19_16-51-22.md").write_text("# R\nx\n")
    (tmp_path / "26-07-19_16-51-22-07.py").write_text("print(1)\n")
    (tmp_path / "net_sni.py").write_text("x")
    got = {r.kind: (str(r.stamp), r.seq, r.text) for r in corpus.read_corpus(spark, str(tmp_path)).collect()}
    assert got["report"] == ("2026-07-19 16:51:22", None, "# R\nx\n")
    assert got["program"] == ("2026-07-19 16:51:22", 7, "print(1)\n")
    assert got["other"] == ("None", None, "x")


def test_catalogue(spark):
    df = catalogue.catalogue(spark, {
        "default_model": "x", "providers": {
            "p": {"models": [{"id": "p:one", "alias": "one", "description": "d"}, {"alias": "noid"}, "text"]},
            "q": "not a mapping", "r": {"models": "not a list"}},
        "models": [{"id": "old:two"}, {"id": "bare", "alias": "one"}, {"id": ""}]})
    dim = catalogue.model_dim(df)
    assert [tuple(r)[1:] for r in dim.orderBy("pos").collect()] == [
        ("p:one", "one", "d", "p"), ("old:two", "old:two", "", "old"), ("bare", "one", "", "")]
    from duskwatch.operators import runs
    asked = spark.createDataFrame([("one",), ("bare",), ("old:two",), ("onne",)], "model string")
    assert {r.model: r.resolved for r in runs.resolve_models(asked, dim).collect()} == {
        "one": "p:one", "bare": "bare", "old:two": "old:two", "onne": "onne"}
    missing = runs.unknown_models(asked, dim).collect()
    assert [tuple(r) for r in missing] == [("onne", 1, "one", 1)]
    assert catalogue.model_dim(catalogue.catalogue(spark, {})).count() == 0
    with pytest.raises(Exception, match="catalogue too large"):
        runs.unknown_models(asked, dim, max_models=1).collect()


def test_cache_is_built_once_per_input_state(spark, tmp_path):
    data = tmp_path / "in"
    data.mkdir()
    (data / "a.json").write_text('{"event_type":"dns"}\n')
    built = []

    def build():
        built.append(1)
        return eve.read_eve(spark, str(data)).select("event_type", "flow_id")

    for _ in range(2):
        assert tables.cached(spark, build, str(tmp_path / "c"), str(data), ("event_type",)).count() == 1
    assert len(built) == 1
    (data / "b.json").write_text('{"event_type":"tls"}\n')
    assert tables.cached(spark, build, str(tmp_path / "c"), str(data), ("event_type",)).count() == 2
    assert len(built) == 2


def test_task_results(spark, tmp_path):
    df, base = spark.range(3), str(tmp_path / "tasks")
    for bad in ("Bad", "data", "default", "a/b", "../x", ""):
        with pytest.raises(ValueError):
            tables.save(df, base, bad, "r1")
    tables.save(df, base, "t", "r1")
    tables.save(df, base, "t", "r1")
    tables.save(df, base, "t", "r2")
    assert spark.read.parquet(base).groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 6), ("r2", 3)]
    with pytest.raises(ValueError, match="exists"):
        tables.save(df, base, "t", "r3", fresh=True)
    tables.save(df, base, "t2", "r1", fresh=True)
    with pytest.raises(Exception, match="reserved"):
        tables.save_all(df.selectExpr("'logs' as task_id", "'r' as run_id", "id"), base)


def test_bounded_results(spark, tmp_path):
    text = {9_999: "a" * 9_999, 10_000: "b\n" * 5_000, 10_001: "c" * 10_001}
    df = spark.createDataFrame(list(text.items()), "id int, text string")
    path = str(tmp_path / "store")
    got = {r.handle: r for r in results.bounded(df, path, "id").collect()}
    assert [(k, r.stored, len(r.shown)) for k, r in sorted(got.items())] == [
        (9999, False, 9999), (10000, True, 1000), (10001, True, 1000)]
    part = results.read_slice(spark, path, 10000, 4999, 10).collect()
    assert [(r.line_no, r.line) for r in part] == [(4999, "b"), (5000, "b"), (5001, "")]
    plan = results.read_slice(spark, path, 10000, 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(line_no,5)" in plan
    blocked = tmp_path / "file"
    blocked.write_text("x")
    with pytest.raises(Exception, match="(?i)file"):
        results.bounded(df, str(blocked), "id")
    results.bounded(df, path, "id")
    results.bounded(df, path, "id", run="other")
    assert results.read_slice(spark, path, 10000, 1, 10_000).count() == 2 * 5001


def test_unknown_models_of_a_large_catalogue(spark):
    from duskwatch.operators import runs
    dim = spark.range(12_000).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("alias"),
                                     F.lit("x").alias("id"))
    asked = spark.createDataFrame([("m11999q",), ("k42",), ("m7",)], "model string")
    assert sorted(tuple(r) for r in runs.unknown_models(asked, dim).collect()) == [
        ("k42", 1, "m42", 1), ("m11999q", 1, "m11999", 1)]
    assert [tuple(r) for r in runs.unknown_models(asked, dim.limit(0)).orderBy("model").collect()] == [
        ("k42", 1, None, None), ("m11999q", 1, None, None), ("m7", 1, None, None)]


def test_field_profile_parses_a_line_once(spark, tmp_path):
    (tmp_path / "eve").write_text("\n".join([
        '{"event_type": "a", "x": 1.5, "y": {}, "z": [], ".d": {".e": {"f": {"g": {"h": [{"i": [1, "s", null]}]}}}}}',
        '  {"x": 10.25, "y": {"a": null}, "z": [[1], {"b": true}]} ', '{"event_type": 5, "x": "t"}', "[1]", '{"x": 1} {}', "", "nope"]))
    records = eve.read_records(spark, str(tmp_path))
    assert sorted(r._raw for r in records.collect()) == sorted(r._raw for r in eve.read_eve(spark, str(tmp_path)).collect())
    profile = net.field_profile(records)
    got = {(r.event_type, r.path, r.type): (r.n, r.presence) for r in profile.collect()}
    deep = [".d", ".d..e", ".d..e.f", ".d..e.f.g", ".d..e.f.g.h", ".d..e.f.g.h[]", ".d..e.f.g.h[].i"]
    kinds = ["OBJECT"] * 4 + ["ARRAY", "OBJECT", "ARRAY"]
    leaves = [("a", f"{deep[-1]}[]", k) for k in ("BIGINT", "STRING", "VOID")]
    want = [("a", p, k) for p, k in zip(deep, kinds)] + leaves + [
        ("a", "event_type", "STRING"), ("a", "x", "DECIMAL"), ("a", "y", "OBJECT"), ("a", "z", "ARRAY"),
        ("unknown", "x", "DECIMAL"), ("unknown", "y", "OBJECT"), ("unknown", "y.a", "VOID"), ("unknown", "z", "ARRAY"),
        ("unknown", "z[]", "ARRAY"), ("unknown", "z[]", "OBJECT"), ("unknown", "z[][]", "BIGINT"), ("unknown", "z[].b", "BOOLEAN"),
        ("5", "event_type", "BIGINT"), ("5", "x", "STRING")]
    assert got == {w: (1, 1.0) for w in want}
    # In each read of the lines, three of them, before.
    assert "parsejson" not in profile._jdf.queryExecution().optimizedPlan().toString().lower().replace("_", "")
