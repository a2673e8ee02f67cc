"""Registered queries over network events."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.functions import addresses as A
from duskwatch.functions import json as J
from duskwatch.functions import values as V
from duskwatch.operators import common, net
from duskwatch.plans import adapters
from duskwatch.plans.adapters import oracle_cte
from duskwatch.plans.registry import query, us

E = oracle_cte("net")

# Address ranges as the oracle can test them on the view's well-formed addresses.
PRIVATE = "(({0}) like '10.%' or ({0}) like '192.168.%' or ({0}) like 'fe80:%')"
EXT = "(dest_ip not like '10.%' and dest_ip not like 'fe80:%' and dest_ip <> 'unknown')"
FLOWS = E + ", flow as (select * from net where event_type = 'flow')"
SERVICE = """case when proto = 'UDP' and dest_port = 3478 then 'stun'
    when proto = 'UDP' and dest_port = 41641 then 'overlay_vpn'
    when proto = 'TCP' and dest_port = 8883 then 'mqtt'
    when proto = 'UDP' and dest_port = 5353 then 'mdns' end"""


def ev(spark, sf):
    return adapters.net(spark, sf)


@query("sample_events", E + """select flow_id, us, event_type, src_ip, dest_ip from net
    order by us, flow_id limit 5""")
def sample_events(spark, sf):
    return common.sample(ev(spark, sf)).select(
        "flow_id", us("event_ts").alias("us"), "event_type", "src_ip", "dest_ip")


@query("field_profile", """with r as (select event_type, count(*) as records from events group by 1),
    f as (select event_type, unnest(json_keys(props)) as path, props from events)
    select f.event_type, f.path,
        case when json_type(props, '$.' || f.path) like '%BIGINT' then 'BIGINT'
            else json_type(props, '$.' || f.path) end as type,
        count(*) as n, round(count(*) * 1.0 / max(records), 6)::double as presence
    from f join r using (event_type) group by 1, 2, 3""")
def field_profile(spark, sf):
    events = adapters.table(spark, sf, "events")
    return net.profile_variant(
        events.select("event_type", F.try_parse_json("props").alias("v")), "event_type", "v")


# --- filters ---------------------------------------------------------------------------------

def _ids(df):
    return df.select("flow_id", us("event_ts").alias("us"), "event_type")


IDS = "select flow_id, us, event_type from net where "


@query("by_event_type", E + IDS + "event_type = 'tls'")
def by_event_type(spark, sf):
    return _ids(net.of_type(ev(spark, sf), "tls"))


@query("drop_noise_net", E + IDS + "event_type <> 'stats'")
def drop_noise_net(spark, sf):
    return _ids(net.drop_noise(ev(spark, sf)))


@query("external_dest", E + IDS + EXT)
def external_dest(spark, sf):
    return _ids(net.external_dest(ev(spark, sf)))


@query("drop_internal", E + IDS + f"not ({PRIVATE.format('src_ip')} and {PRIVATE.format('dest_ip')})")
def drop_internal(spark, sf):
    return _ids(net.drop_internal(ev(spark, sf)))


@query("dest_kinds", E + f"""select case when dest_ip = 'unknown' then 'none' when {EXT} then 'external'
    else 'private' end as kind, count(*) as n from net group by 1""")
def dest_kinds(spark, sf):
    return net.dest_kinds(ev(spark, sf))


@query("multicast_dest", E + IDS + "dest_ip like '224.%'")
def multicast_dest(spark, sf):
    return _ids(net.multicast_dest(ev(spark, sf)))


@query("port_signature", E + f"""select {SERVICE} as service, proto, dest_port, count(*) as n
    from net group by 1, 2, 3""")
def port_signature(spark, sf):
    return net.tag_service(ev(spark, sf)).groupBy(
        "service", "proto", F.col("dest_port").cast("bigint").alias("dest_port")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("decode_failed", E + IDS + "app_proto = 'failed'")
def decode_failed(spark, sf):
    return _ids(net.decode_failed(ev(spark, sf)))


@query("old_tls", E + """select flow_id, us, sni, tls_version as version from net
    where event_type = 'tls' and tls_version = 'TLSv1'""")
def old_tls(spark, sf):
    return net.old_tls(ev(spark, sf)).select(
        "flow_id", us("event_ts").alias("us"), F.col("tls.sni").alias("sni"),
        F.col("tls.version").alias("version"))


@query("name_suffix", E + """select flow_id, us, event_type from net where
    (event_type in ('tls', 'quic') and (sni = 'h7.example.net' or sni like '%.h7.example.net'))
    or (event_type = 'dns' and rrname like '%.example.org')""")
def name_suffix(spark, sf):
    return _ids(net.name_suffix(ev(spark, sf), ["h7.example.net", "Example.org"]))


@query("time_range", E + IDS + """us >= epoch_us(timestamp '2024-01-10 00:00:00')
    and us < epoch_us(timestamp '2024-01-12 06:00:00')""")
def time_range(spark, sf):
    return _ids(common.between(ev(spark, sf), "2024-01-10 00:00:00", "2024-01-12 06:00:00"))


@query("started_before_window", FLOWS + """select flow_id, us, age from flow
    where us - age * 1000000 < (select min(us) from net)""")
def started_before_window(spark, sf):
    return net.predates_window(ev(spark, sf)).select(
        "flow_id", us("event_ts").alias("us"), F.col("flow.age").alias("age"))


@query("project_default", E + """select case when event_type = 'tls' then sni else 'none' end as sni,
    count(*) as n from net group by 1""")
def project_default(spark, sf):
    return net.field(ev(spark, sf), "tls.sni", "none", "sni").groupBy("sni").agg(
        F.count(F.lit(1)).alias("n"))


@query("exact_lookup", E + """select flow_id, us, event_type from net
    where src_ip = '192.168.0.7' or dest_ip = '192.168.0.7'""")
def exact_lookup(spark, sf):
    return _ids(net.mentions(ev(spark, sf), "192.168.0.7"))


# --- joins -----------------------------------------------------------------------------------

NAMED = FLOWS + """, names as (select flow_id, arg_min(sni, (us, sni)) as sni from net
    where event_type in ('tls', 'quic') group by 1),
    named as (select f.* exclude (sni), n.sni from flow f left join names n using (flow_id))"""


@query("flow_sni", NAMED + """select flow_id, us, src_ip, dest_ip, bytes_toserver, sni from named""")
def flow_sni(spark, sf):
    return net.flows_with_name(ev(spark, sf)).select(
        "flow_id", us("event_ts").alias("us"), "src_ip", "dest_ip", "bytes_toserver", "sni")


@query("triangulate", E + f"""select src_ip, bool_or(coalesce({SERVICE} = 'stun', false)) as stun,
    bool_or(coalesce({SERVICE} = 'mqtt', false)) as mqtt,
    bool_or(event_type = 'dns' and rrname = 'd9.example.org') as dns_name,
    bool_or(event_type in ('tls', 'quic') and sni = 'h7.example.net') as tls_name,
    cast(stun as bigint) + cast(mqtt as bigint) + cast(dns_name as bigint)
        + cast(tls_name as bigint) as signals
    from net group by src_ip""")
def triangulate(spark, sf):
    return net.triangulate(
        ev(spark, sf), net.default_signals(["d9.example.org", "h7.example.net"]))


HALVES = E + """, a as (select dest_ip, count(*) as n, cast(sum(bytes_toserver) as bigint) as up
    from net where event_type = 'flow' and us < 1705276800000000 group by 1),
    b as (select dest_ip, count(*) as n, cast(sum(bytes_toserver) as bigint) as up
    from net where event_type = 'flow' and us >= 1705276800000000 group by 1)"""


def _halves(spark, sf):
    flows = net.of_type(ev(spark, sf), "flow")
    edge = F.lit("2024-01-15 00:00:00").cast("timestamp")

    def per_dest(part):
        return part.groupBy("dest_ip").agg(
            F.count(F.lit(1)).alias("n"), F.sum("flow.bytes_toserver").alias("up"))

    return per_dest(flows.where(F.col("event_ts") < edge)), per_dest(
        flows.where(F.col("event_ts") >= edge))


@query("condition_compare", HALVES + """select coalesce(a.dest_ip, b.dest_ip) as dest_ip,
    a.n as n_a, b.n as n_b, a.up as up_a, b.up as up_b, b.n - a.n as n_diff,
    round(b.n / nullif(a.n, 0)::double, 6) as n_ratio, b.up - a.up as up_diff,
    round(b.up / nullif(a.up, 0)::double, 6) as up_ratio
    from a full outer join b on a.dest_ip = b.dest_ip""")
def condition_compare(spark, sf):
    a, b = _halves(spark, sf)
    return common.compare(a, b, ["dest_ip"], ["n", "up"])


@query("suppress_known", FLOWS + """, known as (select dest_ip from flow group by 1
    having count(distinct src_ip) > 20)
    select src_ip, dest_ip, count(*) as n from flow where dest_ip not in (select dest_ip from known)
    group by 1, 2""")
def suppress_known(spark, sf):
    flows = net.of_type(ev(spark, sf), "flow")
    known = flows.groupBy("dest_ip").agg(F.count_distinct("src_ip").alias("hosts")).where("hosts > 20")
    pairs = flows.groupBy("src_ip", "dest_ip").agg(F.count(F.lit(1)).alias("n"))
    return common.suppress(pairs, known, ["dest_ip"])


WEEKS = E + """, w as (select distinct sni, cast(floor((us - 1704067200000000) / 864000000000.0) as bigint)
    as part from net where event_type = 'tls')"""


def _parts(spark, sf):
    tls = net.of_type(ev(spark, sf), "tls")
    part = F.floor((us("event_ts") - 1704067200000000) / 864000000000)
    rows = tls.select(F.col("tls.sni").alias("sni"), part.alias("part"))
    return [rows.where(F.col("part") == i).select("sni") for i in range(3)]


@query("novel_entity", WEEKS + """select sni from w where part = 2 except
    select sni from w where part < 2""")
def novel_entity(spark, sf):
    a, b, c = _parts(spark, sf)
    return common.novel(c, a.union(b), ["sni"])


@query("corroborated", WEEKS + """select sni from w where part in (0, 1, 2) group by 1
    having count(distinct part) = 3""")
def corroborated(spark, sf):
    return common.corroborated(_parts(spark, sf), ["sni"])


@query("findings_intersect", WEEKS + """select sni from w where part = 0 intersect
    select sni from w where part = 1""")
def findings_intersect(spark, sf):
    a, b, _ = _parts(spark, sf)
    return common.findings_intersect(a, b)


@query("findings_except", WEEKS + """select sni from w where part = 0 except
    select sni from w where part = 1""")
def findings_except(spark, sf):
    a, b, _ = _parts(spark, sf)
    return common.findings_except(a, b)


# --- aggregates --------------------------------------------------------------------------------

@query("event_type_counts", E + "select event_type, count(*) as n from net group by 1")
def event_type_counts(spark, sf):
    return net.event_type_counts(ev(spark, sf))


@query("type_share", E + """select event_type, count(*) as n,
    round(100.0 * count(*) / sum(count(*)) over (), 2)::double as pct from net group by 1""")
def type_share(spark, sf):
    return net.type_share(ev(spark, sf))


@query("log_summary", E + """select count(*) as records, cast(0 as bigint) as malformed, min(us) as first_us,
    max(us) as last_us, max(us) // 1000000 - min(us) // 1000000 as span_s from net""")
def log_summary(spark, sf):
    return net.log_summary(ev(spark, sf)).select(
        "records", "malformed", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"),
        "span_s")


@query("top_talkers", E + """select src_ip, count(*) as records,
    cast(sum(case when event_type = 'flow' then bytes_toserver else 0 end) as bigint) as bytes
    from net group by 1 order by 2 desc, 1 limit 5""")
def top_talkers(spark, sf):
    return net.top_talkers(ev(spark, sf))


@query("top_k", E + """select src_ip, count(*) as records,
    cast(sum(case when event_type = 'flow' then bytes_toserver else 0 end) as bigint) as bytes
    from net group by 1 order by 3 desc, 1 limit 10""")
def top_k(spark, sf):
    return net.top_talkers(ev(spark, sf), 10, "bytes")


@query("port_proto_mix", E + "select proto, dest_port, count(*) as n from net group by 1, 2")
def port_proto_mix(spark, sf):
    return net.port_proto_mix(ev(spark, sf)).select(
        "proto", F.col("dest_port").cast("bigint").alias("dest_port"), "n")


@query("rare_sni", E + """select sni, count(*) as n from net where event_type = 'tls' group by 1
    having count(*) < 3""")
def rare_sni(spark, sf):
    return net.rare_sni(ev(spark, sf))


@query("rare_quic_sni", E + """select sni, count(*) as n from net where event_type = 'quic' group by 1
    having count(*) < 3""")
def rare_quic_sni(spark, sf):
    return net.rare_sni(ev(spark, sf), kind="quic")


@query("rare_domain", E + """select rrname, count(*) as n from net where event_type = 'dns' group by 1
    having count(*) < 5""")
def rare_domain(spark, sf):
    return net.rare_domain(ev(spark, sf), below=5)


@query("nxdomain_by_host", E + """select src_ip, rrname, count(*) as lookups,
    count(*) filter (rcode = 'NXDOMAIN') as failed,
    round(count(*) filter (rcode = 'NXDOMAIN') / count(*)::double, 6) as failed_share
    from net where event_type = 'dns' group by 1, 2""")
def nxdomain_by_host(spark, sf):
    return net.nxdomain(ev(spark, sf))


@query("ja3_counts", E + """select ja3, count(*) as n, count(distinct src_ip) as hosts,
    count(distinct sni) as names from net where event_type = 'tls' group by 1""")
def ja3_counts(spark, sf):
    return net.fingerprints(ev(spark, sf))


@query("http_profile", E + """, h as (select * from net where event_type = 'http')
    select 'hostname' as part, hostname as value, count(*) as n from h group by 2 union all
    select 'url', url, count(*) from h group by 2 union all
    select 'user_agent', user_agent, count(*) from h group by 2""")
def http_profile(spark, sf):
    return net.http_profile(ev(spark, sf))


@query("alert_summary", E + """select signature, severity, count(*) as n,
    count(distinct src_ip) as hosts from net where event_type = 'alert' group by 1, 2""")
def alert_summary(spark, sf):
    return net.alerts(ev(spark, sf))


@query("alert_coverage", E + """select count(*) filter (event_type = 'alert') as alerts,
    count(*) filter (event_type in ('flow', 'tls', 'dns', 'http', 'quic')) as protocol_records,
    alerts = 0 and protocol_records > 0 as gap from net""")
def alert_coverage(spark, sf):
    return net.alert_coverage(ev(spark, sf))


EGRESS = FLOWS + f""", egress as (select src_ip, cast(sum(bytes_toserver) as bigint) as up,
    cast(sum(bytes_toclient) as bigint) as down, count(*) as flows from flow where {EXT} group by 1)"""


@query("egress_by_source", EGRESS + "select * from egress")
def egress_by_source(spark, sf):
    return net.egress(ev(spark, sf))


@query("pcr", EGRESS + """select *, round((up - down) / nullif(up + down, 0)::double, 6) as pcr
    from egress""")
def pcr(spark, sf):
    return net.pcr(ev(spark, sf))


@query("egress_pairs", FLOWS + f"""select src_ip, dest_ip, cast(sum(bytes_toserver) as bigint) as up,
    cast(sum(bytes_toclient) as bigint) as down, count(*) as flows from flow where {EXT} group by 1, 2""")
def egress_pairs(spark, sf):
    return net.egress_pairs(ev(spark, sf))


@query("egress_by_name", NAMED + f"""select src_ip, sni, cast(sum(bytes_toserver) as bigint) as up,
    cast(sum(bytes_toclient) as bigint) as down, count(*) as flows from named where {EXT} group by 1, 2""")
def egress_by_name(spark, sf):
    return net.egress_pairs(ev(spark, sf), by="sni")


@query("egress_ratio", FLOWS + """select src_ip, dest_ip, cast(sum(bytes_toserver) as bigint) as up,
    cast(sum(bytes_toclient) as bigint) as down,
    round(sum(bytes_toserver)::double / nullif(sum(bytes_toclient), 0)::double, 6) as ratio
    from flow group by 1, 2""")
def egress_ratio(spark, sf):
    return net.egress_ratio(ev(spark, sf))


@query("protocol_ratio", E + """select count(*) filter (event_type = 'quic') as a,
    count(*) filter (event_type = 'tls') as b, count(*) as records,
    round(a / b::double, 6) as ratio, round((a + b) / records::double, 6) as share from net""")
def protocol_ratio(spark, sf):
    return net.protocol_ratio(ev(spark, sf))


@query("fan_out", FLOWS + f"""select src_ip, {SERVICE} as service, count(distinct dest_ip) as peers,
    count(*) as flows from flow group by 1, 2""")
def fan_out(spark, sf):
    return net.fan_out(ev(spark, sf))


@query("fan_out_uniformity", FLOWS + """, p as (select src_ip, dest_ip, count(*) as flows from flow
    group by 1, 2) select src_ip, count(*) as peers, cast(sum(flows) as bigint) as flows,
    round(stddev_pop(flows) / avg(flows), 6) as spread from p group by 1""")
def fan_out_uniformity(spark, sf):
    return net.fan_out_spread(ev(spark, sf))


@query("service_share", FLOWS + f"""select src_ip, count(*) as n,
    round(100.0 * count(*) / sum(count(*)) over (), 2)::double as pct
    from flow where {SERVICE} = 'stun' group by 1""")
def service_share(spark, sf):
    return net.service_share(ev(spark, sf))


@query("long_flows", FLOWS + """select flow_id, us, src_ip, dest_ip, age, age as spanned_s,
    true as consistent from flow where age >= 7000""")
def long_flows(spark, sf):
    return net.long_flows(ev(spark, sf), 7000).select(
        "flow_id", us("event_ts").alias("us"), "src_ip", "dest_ip", "age", "spanned_s",
        "consistent")


@query("one_way", FLOWS + """select src_ip, dest_ip, dest_port,
    cast(sum(bytes_toserver) as bigint) as up, cast(sum(bytes_toclient) as bigint) as down,
    count(*) as flows from flow group by 1, 2, 3
    having sum(bytes_toclient) = 0 and sum(bytes_toserver) > 0""")
def one_way(spark, sf):
    return net.one_way(ev(spark, sf)).withColumn("dest_port", F.col("dest_port").cast("bigint"))


GAPS = FLOWS + """, gaps as (select *, (us - lag(us) over (partition by src_ip, dest_ip, dest_port,
    proto order by us, flow_id)) / 1000000.0::double as gap_s from flow)"""


@query("beacon_score", GAPS + """, t as (select src_ip, dest_ip, dest_port, proto, count(gap_s) as gaps,
    avg(gap_s) as mean_gap, stddev_pop(gap_s) / nullif(avg(gap_s), 0) as cv_gap,
    stddev_pop(bytes_toserver) / nullif(avg(bytes_toserver), 0) as cv_bytes
    from gaps group by 1, 2, 3, 4 having count(gap_s) >= 2)
    select src_ip, dest_ip, dest_port, proto, gaps, round(mean_gap, 3) as mean_gap,
    round(cv_gap, 6) as cv_gap, round(cv_bytes, 6) as cv_bytes,
    case when cv_gap is not null and cv_bytes is not null
        then round(1 - least(1.0::double, (cv_gap + cv_bytes) / 2), 6) end as score from t""")
def beacon_score(spark, sf):
    return net.beacons(ev(spark, sf), min_gaps=2).select(
        "src_ip", "dest_ip", F.col("dest_port").cast("bigint").alias("dest_port"), "proto", "gaps",
        F.round("mean_gap", 3).alias("mean_gap"), F.round("cv_gap", 6).alias("cv_gap"),
        F.round("cv_bytes", 6).alias("cv_bytes"), F.round("score", 6).alias("score"))


@query("top_with_rest", FLOWS + """, p as (select src_ip, dest_ip, cast(sum(bytes_toserver) as bigint) as up
    from flow group by 1, 2), r as (select *, row_number() over (order by up desc, src_ip, dest_ip) as k
    from p) select src_ip, dest_ip, up, cast(1 as bigint) as members from r where k <= 50 union all
    select 'other', null, cast(sum(up) as bigint), count(*) from r where k > 50 having count(*) > 0""")
def top_with_rest(spark, sf):
    pairs = net.of_type(ev(spark, sf), "flow").groupBy("src_ip", "dest_ip").agg(
        F.sum("flow.bytes_toserver").alias("up"))
    return common.top_with_rest(pairs, ["src_ip", "dest_ip"], "up")


@query("window_vs_full", E + """select event_type,
    count(*) filter (us >= 1704067200000000 and us < 1704153600000000) as in_window,
    count(*) as in_full, round(count(*) / nullif(count(*) filter (us >= 1704067200000000
    and us < 1704153600000000), 0)::double, 6) as full_over_window from net group by 1""")
def window_vs_full(spark, sf):
    return net.window_vs_full(ev(spark, sf), "2024-01-01 00:00:00", "2024-01-02 00:00:00")


@query("name_groups", E + """select src_ip, 'example.net' as suffix, count(*) as connections,
    count(distinct sni) as names from net where event_type in ('tls', 'quic') group by 1""")
def name_groups(spark, sf):
    return net.name_groups(ev(spark, sf))


@query("peer_subnets", FLOWS + f"""select src_ip, case when dest_ip like 'fe80:%' then 'fe80:0:0:0'
    when dest_ip like '2001:%' then split_part(dest_ip, '::', 1) when dest_ip <> 'unknown'
    then regexp_replace(dest_ip, '[.][0-9]+$', '') end as subnet,
    {EXT} as external, count(distinct dest_ip) as peers, count(*) as flows from flow group by 1, 2, 3""")
def peer_subnets(spark, sf):
    return net.peer_subnets(ev(spark, sf))


# --- ordered -----------------------------------------------------------------------------------

@query("inter_arrival", GAPS + """select flow_id, us, src_ip, dest_ip, dest_port,
    round(gap_s, 6) as gap_s from gaps""")
def inter_arrival(spark, sf):
    flows = net.of_type(ev(spark, sf), "flow").select("flow_id", "event_ts", *net.TUPLE)
    return net.inter_arrival(flows).select(
        "flow_id", us("event_ts").alias("us"), "src_ip", "dest_ip",
        F.col("dest_port").cast("bigint").alias("dest_port"), F.round("gap_s", 6).alias("gap_s"))


@query("inter_arrival_sliced", FLOWS + """select flow_id, us, proto, round((us - lag(us) over (partition by proto
    order by us, flow_id)) / 1000000.0::double, 6) as gap_s from flow""")
def inter_arrival_sliced(spark, sf):
    """Gaps by protocol: two keys hold all rows, so both are cut into slices."""
    flows = net.of_type(ev(spark, sf), "flow").select("flow_id", "event_ts", "proto")
    return net.inter_arrival(flows, ["proto"], hot_rows=500).select(
        "flow_id", us("event_ts").alias("us"), "proto", F.round("gap_s", 6).alias("gap_s"))


@query("top_peers_per_host", FLOWS + """, p as (select src_ip, dest_ip,
    cast(sum(bytes_toserver) as bigint) as bytes from flow group by 1, 2),
    r as (select *, row_number() over (partition by src_ip order by bytes desc, dest_ip) as rank from p)
    select * from r where rank <= 3""")
def top_peers_per_host(spark, sf):
    return net.top_peers(ev(spark, sf)).withColumn("rank", F.col("rank").cast("bigint"))


@query("host_rank", EGRESS + """select src_ip, up, rank() over (order by up desc) as rank,
    dense_rank() over (order by up desc) as dense_rank,
    round(percent_rank() over (order by up desc), 6) as percent_rank from egress""")
def host_rank(spark, sf):
    return net.rank_hosts(ev(spark, sf)).withColumn("percent_rank", F.round("percent_rank", 6))


@query("first_seen", E + """select sni, min(us) as first_us, max(us) as last_us, count(*) as n
    from net where event_type in ('tls', 'quic') group by 1""")
def first_seen(spark, sf):
    return common.first_seen(ev(spark, sf), net.server_name(), "sni").select(
        "sni", us("first_ts").alias("first_us"), us("last_ts").alias("last_us"), "n")


@query("sort_count_desc", E + """select dest_ip, count(*) as n from net group by 1
    order by 2 desc, 1""")
def sort_count_desc(spark, sf):
    return common.counts(ev(spark, sf), "dest_ip", "dest_ip")


@query("detail_limit", FLOWS + """select flow_id, us, (select count(*) from flow) as total_rows
    from flow order by us, flow_id limit 50""")
def detail_limit(spark, sf):
    flows = net.of_type(ev(spark, sf), "flow").select("flow_id", us("event_ts").alias("us"))
    return common.detail_limit(flows, ["us", "flow_id"])


# --- scalar functions ----------------------------------------------------------------------------

@query("json_path", """select event_id, cast(json_extract_string(props, '$.k') as bigint) as k,
    cast(null as varchar) as missing from events""")
def json_path(spark, sf):
    return adapters.table(spark, sf, "events").select(
        "event_id", J.json_path(F.col("props"), "$.k", "bigint").alias("k"),
        J.json_path(F.col("props"), "$.none").alias("missing"))


@query("ipv4_num", E + """select dest_ip, try_cast(split_part(dest_ip, '.', 1) as bigint) * 16777216
    + try_cast(split_part(dest_ip, '.', 2) as bigint) * 65536
    + try_cast(split_part(dest_ip, '.', 3) as bigint) * 256
    + try_cast(split_part(dest_ip, '.', 4) as bigint) as num,
    case when dest_ip like '%.%' then dest_ip like '203.0.113.%' end as in_range, count(*) as n from net group by 1, 2, 3""")
def ipv4_num(spark, sf):
    return ev(spark, sf).groupBy("dest_ip").agg(F.count(F.lit(1)).alias("n")).select(
        "dest_ip", A.ipv4_num(F.col("dest_ip")).alias("num"),
        A.in_cidr(F.col("dest_ip"), "203.0.113.0/24").alias("in_range"), "n")


@query("in_cidr", E + """select case when dest_ip like '%.%' then dest_ip like '10.%' end as inside,
    case when dest_ip like '%.%' then dest_ip like '224.0.0.%' end as local_multicast,
    count(*) as n from net group by 1, 2""")
def in_cidr(spark, sf):
    dest = F.col("dest_ip")
    return ev(spark, sf).groupBy(
        A.in_cidr(dest, "10.0.0.0/8").alias("inside"),
        A.in_cidr(dest, "224.0.0.0/24").alias("local_multicast")).agg(F.count(F.lit(1)).alias("n"))


@query("run_stamp", E + """select us, strftime(event_ts, '%y-%m-%d_%H-%M-%S') as stamp,
    us // 1000000 as back_s from net""")
def run_stamp(spark, sf):
    stamped = ev(spark, sf).select(
        us("event_ts").alias("us"), V.run_stamp(F.col("event_ts")).alias("stamp"))
    return stamped.withColumn("back_s", F.unix_seconds(V.parse_stamp(F.col("stamp"))))


@query("string_keys", FLOWS + """select distinct src_ip, dest_port,
    '{"' || cast(dest_port as string) || '":"' || proto || '"}' as as_json from flow""")
def string_keys(spark, sf):
    keyed = net.of_type(ev(spark, sf), "flow").select(
        "src_ip", F.col("dest_port").cast("bigint").alias("dest_port"), "proto").distinct()
    result = V.string_keys(F.create_map("dest_port", "proto"))
    return keyed.select("src_ip", "dest_port", F.to_json(result).alias("as_json"))


@query("bytes_label", EGRESS + """select src_ip, up, round(up / 1e6, 1) as mb,
    round(up / 1048576.0::double, 1) as mib from egress""")
def bytes_label(spark, sf):
    label = V.bytes_label(F.col("up"))
    return net.egress(ev(spark, sf)).select(
        "src_ip", "up", label["mb"].alias("mb"), label["mib"].alias("mib"))


@query("duration_s", FLOWS + "select flow_id, us, age as seconds from flow")
def duration_s(spark, sf):
    spanned = V.duration_s(F.col("flow.start").try_cast("timestamp"),
                           F.col("flow.end").try_cast("timestamp"))
    return net.of_type(ev(spark, sf), "flow").select(
        "flow_id", us("event_ts").alias("us"), spanned.alias("seconds"))


@query("name_labels", E + """select distinct sni, 'example.net' as suffix, cast(3 as bigint) as labels,
    length(sni) as length from net where event_type = 'tls'""")
def name_labels(spark, sf):
    tls = net.of_type(ev(spark, sf), "tls").select(F.col("tls.sni").alias("sni")).distinct()
    return tls.select("sni", A.name_labels(F.col("sni")).alias("l")).select(
        "sni", "l.suffix", F.col("l.labels").cast("bigint").alias("labels"),
        F.col("l.length").cast("bigint").alias("length"))
