"""Registered queries that drain a stream over log files and return its table.

The oracle gives what the batch form gives, up to the watermark the drained stream ends with.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import net
from duskwatch.plans import raw
from duskwatch.plans.adapters import oracle_cte
from duskwatch.plans.registry import ORACLES, query, us
from duskwatch.session import scratch
from duskwatch.sources import audit, eve, lines, osquery
from duskwatch.streaming import backlog, stateful, streams

E = oracle_cte("net")
R = oracle_cte("run")


@query("stream_scan", E + "select us, flow_id, event_type, src_ip from net")
def stream_scan(spark, sf):
    rows = eve.stream_eve(spark, raw.eve(spark, sf)).select(
        us("event_ts").alias("us"), "flow_id", "event_type", "src_ip")
    return streams.drain(rows)[0]


@query("stream_audit_scan", R + "select run_id, us, event, tool_call_id from run")
def stream_audit_scan(spark, sf):
    rows = audit.stream_collected(spark, raw.audit(spark, sf)).select(
        "run_id", us("ts").alias("us"), "event", "tool_call_id")
    return streams.drain(rows)[0]


@query("stream_event_counts", E + """select us // 3600000000 * 3600000000 as start_us, event_type,
    count(*) as n from net group by 1, 2
    having start_us + 3600000000 <= (select max(us) - 600000000 from net)""")
def stream_event_counts(spark, sf):
    counts = streams.event_counts(eve.stream_eve(spark, raw.eve(spark, sf)))
    return streams.drain(counts)[0].select(us("start_ts").alias("start_us"), "event_type", "n")


@query("stream_egress", E + """, w as (select us // 600000000 * 600000000 - k * 600000000 as start_us,
    src_ip, bytes_toserver from net, range(0, 6) r(k) where event_type = 'flow' and dest_ip not like '10.%'
    and dest_ip not like 'fe80:%' and dest_ip <> 'unknown')
    select start_us, src_ip, cast(sum(bytes_toserver) as bigint) as up from w group by 1, 2
    having sum(bytes_toserver) > 2000""")
def stream_egress(spark, sf):
    hot = streams.egress(eve.stream_eve(spark, raw.eve(spark, sf)), 2000)
    rows = streams.drain_updates(hot, ["start_ts", "src_ip"], scratch(spark, "updates"))
    return rows.select(us("start_ts").alias("start_us"), "src_ip", "up")


@query("run_state", R + """, m as (select run_id, us, seq, event, case event when 'run_start' then 'ready'
    when 'prompt' then 'running' when 'model_text' then 'active' when 'interrupted' then 'interrupted'
    when 'run_end' then status else 'failed' end as state from run where event in ('run_start', 'prompt',
    'model_text', 'error', 'setup_error', 'interrupted', 'run_end')),
    b as (select *, coalesce(lag(state) over (partition by run_id order by us, seq), 'none') as before from m)
    select run_id, us, event, before, state, case event
    when 'prompt' then before in ('running', 'completed', 'interrupted')
    when 'model_text' then before not in ('running', 'active')
    when 'run_start' then before <> 'none' else false end as illegal from b""")
def run_state(spark, sf):
    return streams.drain(stateful.run_states(audit.stream_collected(spark, raw.audit(spark, sf))))[0]


@query("stream_call_result", R + """, c as (select run_id, tool_call_id, us, seq,
        event in ('run_code_call', 'tool_call') as is_call from run where tool_call_id is not null),
    b as (select *, lag(us) over w as p_us, lag(is_call) over w as p_call,
        lead(us) over w as n_us, lead(is_call) over w as n_call from c
        window w as (partition by run_id, tool_call_id order by us, seq))
    select run_id, tool_call_id, case when p_call and us - p_us <= 86400000000 then p_us end as call_us,
        us as result_us, case when p_call and us - p_us <= 86400000000 then 'answered' else 'unmatched' end as status
        from b where not is_call
    union all select run_id, tool_call_id, us, null,
        case when n_us is null or n_us - us > 86400000000 then 'pending_late' else 'pending' end
        from b where is_call and case when n_us is null then us + 86400000000 <= (select max(us) - 600000000 from c)
            else n_us - us > 86400000000 or n_call end""")
def stream_call_result(spark, sf):
    trail = audit.stream_collected(spark, raw.audit(spark, sf), only=("event", "tool_call_id"))
    calls = stateful.call_results(trail, 86400)
    return streams.drain(calls)[0]


@query("stall_watch", R + """, b as (select run_id, us, event,
    lead(us) over (partition by run_id order by us, seq) as n_us from run)
    select run_id, us as since_us, event from b where event not in ('run_end', 'interrupted')
    and case when n_us is null then us + 43200000000 <= (select max(us) - 600000000 from run)
        else n_us - us > 43200000000 end""")
def stall_watch(spark, sf):
    stalls = stateful.stall_watch(audit.stream_collected(spark, raw.audit(spark, sf)), 43200)
    return streams.drain(stalls)[0]


@query("stream_dedupe", E + "select us, flow_id, event_type from net")
def stream_dedupe(spark, sf):
    rows, again = (
        eve.stream_eve(spark, log(spark, sf)).select("event_ts", "flow_id", "event_type", F.md5("_raw").alias("line"))
        for log in (raw.eve, raw.eve_overlap))
    once = streams.dedupe(rows, ["line"], "1 day", again)
    return streams.drain(once)[0].select(us("event_ts").alias("us"), "flow_id", "event_type")


@query("stream_beacon", E + """, gaps as (select *, (us - lag(us) over (partition by src_ip, dest_ip,
    dest_port, proto order by us, flow_id)) / 1000000.0::double as gap_s from net where event_type = 'flow'),
    t as (select src_ip, dest_ip, dest_port, proto, count(gap_s) as gaps,
    stddev_pop(gap_s) / nullif(avg(gap_s), 0) as cv_gap,
    stddev_pop(bytes_toserver) / nullif(avg(bytes_toserver), 0) as cv_bytes
    from gaps group by 1, 2, 3, 4 having count(gap_s) >= 2)
    select src_ip, dest_ip, dest_port, proto, gaps, round(1 - least(1.0::double, (cv_gap + cv_bytes) / 2), 6)
    as score from t""")
def stream_beacon(spark, sf):
    running = streams.drain(stateful.beacons(eve.stream_eve(spark, raw.eve(spark, sf))))[0]
    return stateful.beacon_scores(running, 2).select(
        "src_ip", "dest_ip", "dest_port", "proto", "gaps", F.round("score", 6).alias("score"))


@query("stream_quarantine", E + """select event_type as kind, count(*) as n from net group by 1
    union all select 'malformed', count(*) from net where event_no % 101 = 0
    and cast(floor(event_no / 101) as bigint) % 7 > 1""")
def stream_quarantine(spark, sf):
    rows = lines.stream_lines(spark, raw.eve(spark, sf))
    good, bad = streams.drain_quarantine(rows, scratch(spark, "marked"))
    kinds = good.select(F.col("event_type").alias("kind")).unionByName(
        bad.select(F.lit("malformed").alias("kind")))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("stream_rules", oracle_cte("net", "shell", "environ") + """
    select 'alert' as rule, signature as detail, count(*) as n from net where event_type = 'alert' group by 2
    union all select 'old_tls', tls_version, count(*) from net
        where event_type = 'tls' and tls_version = 'TLSv1' group by 2
    union all select 'env_hijack', key, count(*) from environ where key <> 'PATH' group by 2
    union all select rule, command, count(*) from (select command, unnest(
        case when command like 'curl%' or command like 'wget%' then ['fetch']
        when command like '%/etc/hosts' then ['hosts_edit'] when command like '%base64 -d%' then ['encoded_shell']
        when command like '%/etc/passwd' or command like '%/etc/shadow' then ['account_files'] else [] end) as rule
        from shell) group by 1, 2""")
def stream_rules(spark, sf):
    nets = streams.drain(streams.net_rules(eve.stream_eve(spark, raw.eve(spark, sf))))[0]
    hosts = streams.drain(streams.host_rules(osquery.stream_osquery(spark, raw.osquery(spark, sf))))[0]
    return nets.select("rule", "detail").unionByName(hosts.select("rule", "detail")).groupBy(
        "rule", "detail").agg(F.count(F.lit(1)).alias("n"))


@query("stream_append", R + """select strftime(make_timestamp(us), '%Y-%m-%d') as day, count(*) as n
    from run group by 1""")
def stream_append(spark, sf):
    from duskwatch.sinks.tables import stream_events

    path = scratch(spark, "appended")
    rows = audit.stream_collected(spark, raw.audit(spark, sf)).select("run_id", "ts", "event")
    stream_events(rows, path, scratch(spark, "checkpoint")).awaitTermination()
    return spark.read.parquet(path).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


# --- the same questions over a backlog of many batches, newest files first ------------------------

def eve_backlog(spark, sf):
    return eve.stream_eve(spark, raw.eve(spark, sf), files_per_trigger=4, newest_first=True)


def audit_backlog(spark, sf):
    return audit.stream_collected(spark, raw.audit(spark, sf), files_per_trigger=16, newest_first=True)


@query("backlog_event_counts", E + """select us // 3600000000 * 3600000000 as start_us, event_type,
    count(*) as n, start_us + 3600000000 <= (select max(us) - 600000000 from net) as closed
    from net group by 1, 2""")
def backlog_event_counts(spark, sf):
    counts, _ = backlog.event_counts(eve_backlog(spark, sf), scratch(spark, "counts"))
    return counts.select(us("start_ts").alias("start_us"), "event_type", "n", "closed")


@query("backlog_egress", ORACLES["stream_egress"])
def backlog_egress(spark, sf):
    sums, _ = backlog.egress(eve_backlog(spark, sf), scratch(spark, "egress"), 2000)
    return sums.select(us("start_ts").alias("start_us"), "src_ip", "up")


@query("backlog_dedupe", ORACLES["stream_dedupe"])
def backlog_dedupe(spark, sf):
    both = eve_backlog(spark, sf).unionByName(eve.stream_eve(spark, raw.eve_overlap(spark, sf), 4, True))
    rows = both.select("event_ts", "flow_id", "event_type", F.md5("_raw").alias("line"))
    once = backlog.dedupe(rows, ["line"], scratch(spark, "once"))
    return once.select(us("event_ts").alias("us"), "flow_id", "event_type")


def _kept_trail(spark, sf):
    rows = audit_backlog(spark, sf).select("run_id", "ts", "seq", "event", "status", "tool_call_id")
    return backlog.keep(rows, scratch(spark, "trail"))


@query("backlog_run_state", ORACLES["run_state"])
def backlog_run_state(spark, sf):
    return backlog.run_moves(_kept_trail(spark, sf))


@query("backlog_call_result", ORACLES["stream_call_result"])
def backlog_call_result(spark, sf):
    return backlog.call_moves(_kept_trail(spark, sf), 86400)


@query("backlog_stalls", ORACLES["stall_watch"])
def backlog_stalls(spark, sf):
    return backlog.stall_moves(_kept_trail(spark, sf), 43200)


@query("backlog_beacon", ORACLES["stream_beacon"])
def backlog_beacon(spark, sf):
    flows = net.of_type(eve_backlog(spark, sf), "flow").select(
        *net.TUPLE, "event_type", "event_ts", "flow_id", F.struct("flow.bytes_toserver").alias("flow"))
    rows = backlog.keep(flows, scratch(spark, "flows"))
    return net.beacons(rows, 2).select(
        *net.TUPLE[:2], F.col("dest_port").cast("bigint").alias("dest_port"), "proto", "gaps",
        F.round("score", 6).alias("score"))
