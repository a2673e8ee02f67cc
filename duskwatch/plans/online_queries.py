"""Registered queries of streams whose files come out of order within a delay.

The oracle gives the batch form of all rows before the horizon that the drained stream ends with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskwatch.plans import adapters, raw
from duskwatch.plans.adapters import oracle_cte
from duskwatch.plans.registry import query
from duskwatch.streaming import online, stateful, streams

SLOT_S = 21_600
KEEP_S = 365 * 86_400
LIMIT_S, BUDGET_S = 86_400, 43_200

MOVES = "event in ('run_start', 'prompt', 'model_text', 'error', 'setup_error', 'interrupted', 'run_end')"


def known(view: str, where: str) -> str:
    """Rows of a view before the horizon, and the horizon: the last slot edge that the watermark,
    the newest row less the delay, has reached."""
    slot = SLOT_S * 1_000_000
    return f"""all_rows as (select * from {view} where {where}),
        late as (select (max(us) - min(us)) // {raw.GROUPS} + 1 as span from {view} where {{whole}}),
        edge as (select ((select max(us) from all_rows) // 1000 - (span // 1000000 + 1) * 1000) * 1000
            // {slot} * {slot} as horizon from late),
        known as (select * from all_rows where us < (select horizon from edge))"""


def _stream(spark, sf: str, name: str, rows: DataFrame, ts: str) -> tuple[DataFrame, str]:
    """The rows as a stream of shuffled files, three at a time, and the delay to allow for."""
    folder, delay = raw.shuffled(spark, sf, name, rows, ts)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(folder)
    return stream, f"{delay} seconds"


def _trail(spark, sf: str) -> tuple[DataFrame, str]:
    rows = adapters.run(spark, sf).select("run_id", "ts", "seq", "event", "status", "tool_call_id")
    return _stream(spark, sf, "trail", rows, "ts")


R = oracle_cte("run").rstrip() + ", "


@query("online_run_state", R + known("run", MOVES).format(whole="true") + """,
    m as (select run_id, us, seq, event, case event when 'run_start' then 'ready'
    when 'prompt' then 'running' when 'model_text' then 'active' when 'interrupted' then 'interrupted'
    when 'run_end' then status else 'failed' end as state from known),
    b as (select *, coalesce(lag(state) over (partition by run_id order by us, seq), 'none') as before from m)
    select run_id, us, event, before, state, case event
    when 'prompt' then before in ('running', 'completed', 'interrupted')
    when 'model_text' then before not in ('running', 'active')
    when 'run_start' then before <> 'none' else false end as illegal from b""")
def online_run_state(spark, sf):
    audit, delay = _trail(spark, sf)
    return streams.drain(online.run_states(audit, delay, SLOT_S, KEEP_S))[0]


@query("online_call_result", R + known("run", """tool_call_id is not null and event in ('run_code_call',
        'tool_call', 'run_code_return', 'tool_result')""").format(whole="true") + f""",
    c as (select run_id, tool_call_id, us, seq, event in ('run_code_call', 'tool_call') as is_call from known),
    b as (select *, lag(us) over w as p_us, lag(is_call) over w as p_call,
        lead(us) over w as n_us, lead(is_call) over w as n_call from c
        window w as (partition by run_id, tool_call_id order by us, seq))
    select run_id, tool_call_id, case when p_call and us - p_us <= {LIMIT_S}000000 then p_us end as call_us,
        us as result_us, case when p_call and us - p_us <= {LIMIT_S}000000 then 'answered' else 'unmatched' end as status
        from b where not is_call
    union all select run_id, tool_call_id, us, null,
        case when n_us is null or n_us - us > {LIMIT_S}000000 then 'pending_late' else 'pending' end
        from b where is_call and case when n_us is null then us + {LIMIT_S}000000 < (select horizon from edge)
            else n_us - us > {LIMIT_S}000000 or n_call end""")
def online_call_result(spark, sf):
    audit, delay = _trail(spark, sf)
    return streams.drain(online.call_results(audit, LIMIT_S, delay, SLOT_S, KEEP_S))[0]


@query("online_stalls", R + known("run", "true").format(whole="true") + f""",
    b as (select run_id, us, event, lead(us) over (partition by run_id order by us, seq) as n_us from known)
    select run_id, us as since_us, event from b where event not in ('run_end', 'interrupted')
    and case when n_us is null then us + {BUDGET_S}000000 < (select horizon from edge)
        else n_us - us > {BUDGET_S}000000 end""")
def online_stalls(spark, sf):
    audit, delay = _trail(spark, sf)
    return streams.drain(online.stall_watch(audit, BUDGET_S, delay, SLOT_S, KEEP_S))[0]


@query("online_beacon", oracle_cte("net").rstrip() + ", " + known("net", "event_type = 'flow'").format(
    whole="event_type = 'flow'") + """,
    gaps as (select *, (us - lag(us) over (partition by src_ip, dest_ip,
    dest_port, proto order by us, flow_id)) / 1000000.0::double as gap_s from known),
    t as (select src_ip, dest_ip, dest_port, proto, count(gap_s) as gaps,
    stddev_pop(gap_s) / nullif(avg(gap_s), 0) as cv_gap,
    stddev_pop(bytes_toserver) / nullif(avg(bytes_toserver), 0) as cv_bytes
    from gaps group by 1, 2, 3, 4 having count(gap_s) >= 2)
    select src_ip, dest_ip, dest_port, proto, gaps, round(1 - least(1.0::double, (cv_gap + cv_bytes) / 2), 6)
    as score from t""")
def online_beacon(spark, sf):
    flows = adapters.net(spark, sf).where("event_type = 'flow'").select(
        "src_ip", "dest_ip", "dest_port", "proto", "event_type", "event_ts", "flow_id",
        F.struct("flow.bytes_toserver").alias("flow"))
    events, delay = _stream(spark, sf, "flows", flows, "event_ts")
    running = streams.drain(online.beacons(events, delay, SLOT_S, KEEP_S))[0]
    return stateful.beacon_scores(running, 2).select(
        "src_ip", "dest_ip", "dest_port", "proto", "gaps", F.round("score", 6).alias("score"))
