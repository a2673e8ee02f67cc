"""Hunting over network events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import addresses as A
from duskwatch.operators import common, ordered
from duskwatch.session import materialize

TUPLE = ["src_ip", "dest_ip", "dest_port", "proto"]

# Deprecated protocol versions as the sensor writes them.
OLD_TLS = ("SSLv2", "SSLv3", "TLSv1", "TLS 1.0", "TLS 1.1", "TLSv1.0", "TLSv1.1")


# --- filters and projections ----------------------------------------------------------------

def of_type(df: DataFrame, event_type: str) -> DataFrame:
    return df.where(F.col("event_type") == event_type)


def drop_noise(df: DataFrame) -> DataFrame:
    """Without sensor telemetry; records without a type are kept."""
    return df.where((F.col("event_type") != "stats") | F.col("event_type").isNull())


def external_dest(df: DataFrame) -> DataFrame:
    return df.where(A.is_external(F.col("dest_ip")))


def dest_kinds(df: DataFrame) -> DataFrame:
    """Records with a destination by its kind; those that are no address are counted, too."""
    return df.where("dest_ip is not null").groupBy(
        A.address_kind(F.col("dest_ip")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def drop_internal(df: DataFrame) -> DataFrame:
    """Without traffic whose both ends are private."""
    return df.where(~(A.is_private(F.col("src_ip")) & A.is_private(F.col("dest_ip"))))


def multicast_dest(df: DataFrame) -> DataFrame:
    return df.where(A.is_multicast(F.col("dest_ip")))


def tag_service(df: DataFrame, services=A.KNOWN_SERVICES) -> DataFrame:
    return df.withColumn("service", A.service_of(F.col("proto"), F.col("dest_port"), services))


def decode_failed(df: DataFrame) -> DataFrame:
    return df.where(F.col("app_proto") == "failed")


def old_tls(df: DataFrame, versions=OLD_TLS) -> DataFrame:
    return df.where(F.col("tls.version").isin(*versions))


def server_name() -> Column:
    """Name asked for in a TLS or QUIC handshake."""
    return F.coalesce(F.col("tls.sni"), F.col("quic.sni"))


def name_suffix(df: DataFrame, suffixes: list[str]) -> DataFrame:
    """Events whose server or query name lies under one of the suffixes."""
    return df.where(
        A.under_suffix(server_name(), suffixes) | A.under_suffix(F.col("dns.rrname"), suffixes))


def predates_window(df: DataFrame) -> DataFrame:
    """Flows that began before the first record of the log."""
    first = df.agg(F.min("event_ts").alias("t")).scalar()
    started = F.col("flow.start").try_cast("timestamp")
    return of_type(df, "flow").where(started < first)


def field(df: DataFrame, path: str, default: str, name: str) -> DataFrame:
    """A nested field as a column, with a default where it is missing."""
    return df.withColumn(name, F.coalesce(F.col(path).cast("string"), F.lit(default)))


def mentions(df: DataFrame, term: str) -> DataFrame:
    """Events that carry the exact term as an address or a name."""
    at = ["src_ip", "dest_ip", "tls.sni", "quic.sni", "dns.rrname", "http.hostname"]
    hit = F.lit(False)
    for column in at:
        hit = hit | F.coalesce(F.col(column) == term, F.lit(False))
    return df.where(hit)


def mentions_raw(df: DataFrame, term: str) -> DataFrame:
    """Lines that hold the term anywhere, read from the kept raw text."""
    return df.where(F.col("_raw").contains(term))


# --- joins --------------------------------------------------------------------------------

def flows_with_name(df: DataFrame) -> DataFrame:
    """Flows with the first server name seen for the same flow id, if any."""
    names = (
        df.where(F.col("event_type").isin("tls", "quic") & server_name().isNotNull()
                 & F.col("flow_id").isNotNull())
        .groupBy("flow_id")
        .agg(F.min(F.struct(F.col("event_ts"), server_name().alias("n")))["n"].alias("sni"))
    )
    flows = of_type(df, "flow").select(
        "flow_id", "event_ts", *TUPLE,
        F.col("flow.bytes_toserver").alias("bytes_toserver"),
        F.col("flow.bytes_toclient").alias("bytes_toclient"))
    return common.left_join(flows, names, ["flow_id"])


def default_signals(suffixes: list[str]) -> dict[str, Column]:
    service = A.service_of(F.col("proto"), F.col("dest_port"))
    return {
        "stun": service == "stun",
        "mqtt": service == "mqtt",
        "dns_name": A.under_suffix(F.col("dns.rrname"), suffixes),
        "tls_name": A.under_suffix(server_name(), suffixes),
    }


def triangulate(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Per host, which independent signals were seen and how many agree; one pass."""
    flags = df.groupBy("src_ip").agg(
        *[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in signals.items()])
    agree = sum((F.col(n).cast("bigint") for n in signals), F.lit(0).cast("bigint"))
    return flags.withColumn("signals", agree)


# --- aggregates -----------------------------------------------------------------------------

def event_type_counts(df: DataFrame) -> DataFrame:
    return common.counts(df, "event_type", "event_type")


def type_share(df: DataFrame) -> DataFrame:
    return common.share(df, "event_type", "event_type")


def log_summary(df: DataFrame) -> DataFrame:
    """Records, malformed lines, first and last time, span in seconds."""
    bad = F.count_if("_bad") if "_bad" in df.columns else F.lit(0).cast("bigint")
    out = df.agg(
        F.count(F.lit(1)).alias("records"), bad.alias("malformed"),
        F.min("event_ts").alias("first_ts"), F.max("event_ts").alias("last_ts"))
    return out.withColumn(
        "span_s", F.unix_seconds("last_ts") - F.unix_seconds("first_ts"))


def top_talkers(df: DataFrame, n: int = 5, by: str = "records") -> DataFrame:
    """The busiest sources by number of records, or by bytes sent."""
    sent = F.coalesce(F.sum("flow.bytes_toserver"), F.lit(0).cast("bigint"))
    per = df.groupBy("src_ip").agg(F.count(F.lit(1)).alias("records"), sent.alias("bytes"))
    return common.top_k(per, n, F.desc(by), "src_ip")


def port_proto_mix(df: DataFrame) -> DataFrame:
    return df.groupBy("proto", "dest_port").agg(F.count(F.lit(1)).alias("n"))


def rare_sni(df: DataFrame, below: int = 3, kind: str = "tls") -> DataFrame:
    return common.rare(of_type(df, kind), f"{kind}.sni", "sni", below)


def rare_domain(df: DataFrame, below: int = 3) -> DataFrame:
    return common.rare(of_type(df, "dns"), "dns.rrname", "rrname", below)


def nxdomain(df: DataFrame) -> DataFrame:
    """Look-ups and failed look-ups per host and name, and the failed share."""
    failed = F.count_if(F.col("dns.rcode") == "NXDOMAIN")
    return (
        of_type(df, "dns")
        .groupBy("src_ip", F.col("dns.rrname").alias("rrname"))
        .agg(F.count(F.lit(1)).alias("lookups"), failed.alias("failed"))
        .withColumn("failed_share",
                    F.round(F.try_divide(F.col("failed").cast("double"), F.col("lookups")), 6))
    )


def fingerprints(df: DataFrame) -> DataFrame:
    """Client fingerprints: connections, distinct hosts, distinct names."""
    return (
        of_type(df, "tls").where(F.col("tls.ja3.hash").isNotNull())
        .groupBy(F.col("tls.ja3.hash").alias("ja3"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("hosts"),
             F.count_distinct("tls.sni").alias("names"))
    )


def http_profile(df: DataFrame) -> DataFrame:
    """Counts of host names, of paths and of agents in clear web traffic, one pass."""
    part = F.explode(F.array(
        F.struct(F.lit("hostname").alias("part"), F.col("http.hostname").alias("value")),
        F.struct(F.lit("url").alias("part"), F.col("http.url").alias("value")),
        F.struct(F.lit("user_agent").alias("part"), F.col("http.user_agent").alias("value")),
    )).alias("p")
    return (
        of_type(df, "http").select(part).where("p.value is not null")
        .groupBy("p.part", "p.value").agg(F.count(F.lit(1)).alias("n"))
    )


def alerts(df: DataFrame) -> DataFrame:
    return of_type(df, "alert").groupBy(
        F.col("alert.signature").alias("signature"),
        F.col("alert.severity").cast("bigint").alias("severity"),
    ).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src_ip").alias("hosts"))


def alert_coverage(df: DataFrame) -> DataFrame:
    """Alert and protocol record counts, and whether only the latter exist."""
    protocol = F.col("event_type").isin("flow", "tls", "dns", "http", "quic")
    return df.agg(
        F.count_if(F.col("event_type") == "alert").alias("alerts"),
        F.count_if(protocol).alias("protocol_records"),
    ).withColumn("gap", (F.col("alerts") == 0) & (F.col("protocol_records") > 0))


def _volumes() -> list[Column]:
    return [F.sum("flow.bytes_toserver").alias("up"), F.sum("flow.bytes_toclient").alias("down")]


def egress(df: DataFrame) -> DataFrame:
    """Bytes sent to and received from outside addresses, by source."""
    flows = external_dest(of_type(df, "flow"))
    return flows.groupBy("src_ip").agg(*_volumes(), F.count(F.lit(1)).alias("flows"))


def pcr_of(up: Column, down: Column) -> Column:
    """(sent - received) / (sent + received): 1 is a pure producer, -1 a pure consumer."""
    return F.round(F.try_divide((up - down).cast("double"), up + down), 6)


def pcr(df: DataFrame) -> DataFrame:
    return egress(df).withColumn("pcr", pcr_of(F.col("up"), F.col("down")))


def egress_pairs(df: DataFrame, by: str = "dest_ip") -> DataFrame:
    """Outside volume by source and destination address, or by source and server name."""
    if by == "dest_ip":
        flows = external_dest(of_type(df, "flow"))
        return flows.groupBy("src_ip", "dest_ip").agg(
            *_volumes(), F.count(F.lit(1)).alias("flows"))
    flows = external_dest(flows_with_name(df))
    return flows.groupBy("src_ip", "sni").agg(
        F.sum("bytes_toserver").alias("up"), F.sum("bytes_toclient").alias("down"),
        F.count(F.lit(1)).alias("flows"))


def egress_ratio(df: DataFrame) -> DataFrame:
    """Upload to download ratio by host and peer; null when nothing came back."""
    pairs = of_type(df, "flow").groupBy("src_ip", "dest_ip").agg(*_volumes())
    return pairs.withColumn(
        "ratio", F.round(F.try_divide(F.col("up").cast("double"), F.col("down")), 6))


def protocol_ratio(df: DataFrame, a: str = "quic", b: str = "tls") -> DataFrame:
    """One record type against another, and the share of both in all records."""
    out = df.agg(
        F.count_if(F.col("event_type") == a).alias("a"),
        F.count_if(F.col("event_type") == b).alias("b"),
        F.count(F.lit(1)).alias("records"))
    return out.withColumns({
        "ratio": F.round(F.try_divide(F.col("a").cast("double"), F.col("b")), 6),
        "share": F.round(F.try_divide((F.col("a") + F.col("b")).cast("double"),
                                      F.col("records")), 6),
    })


def fan_out(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct peers per source and service."""
    peers = F.approx_count_distinct("dest_ip") if approximate else F.count_distinct("dest_ip")
    flows = tag_service(of_type(df, "flow"))
    return flows.groupBy("src_ip", "service").agg(
        peers.alias("peers"), F.count(F.lit(1)).alias("flows"))


def fan_out_spread(df: DataFrame) -> DataFrame:
    """How evenly a source's flows lie over its peers: 0 is perfectly even."""
    per_peer = of_type(df, "flow").groupBy("src_ip", "dest_ip").agg(
        F.count(F.lit(1)).alias("flows"))
    return per_peer.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("peers"),
        F.sum("flows").alias("flows"),
        F.round(F.try_divide(F.stddev_pop("flows"), F.avg("flows")), 6).alias("spread"))


def service_share(df: DataFrame, service: str = "stun") -> DataFrame:
    """Share of one service's flows that each host owns, in percent."""
    hits = tag_service(of_type(df, "flow")).where(F.col("service") == service)
    return common.share(hits, "src_ip", "src_ip")


def long_flows(df: DataFrame, min_s: int = 86400) -> DataFrame:
    """Connections at least that old, with the age recomputed from their start and end."""
    from duskwatch.functions.values import duration_s

    spanned = duration_s(F.col("flow.start").try_cast("timestamp"),
                         F.col("flow.end").try_cast("timestamp"))
    return of_type(df, "flow").where(F.col("flow.age") >= min_s).select(
        "flow_id", "event_ts", *TUPLE, F.col("flow.age").alias("age"),
        spanned.alias("spanned_s"), (spanned == F.col("flow.age")).alias("consistent"))


def one_way(df: DataFrame) -> DataFrame:
    """Host, peer and port with bytes sent and none received."""
    pairs = of_type(df, "flow").groupBy("src_ip", "dest_ip", "dest_port").agg(
        *_volumes(), F.count(F.lit(1)).alias("flows"))
    return pairs.where((F.col("down") == 0) & (F.col("up") > 0))


def inter_arrival(
    df: DataFrame, keys: list[str] = TUPLE, hot_rows: int = ordered.HOT_ROWS
) -> DataFrame:
    """Each event with the seconds since the previous one of its key."""
    out = ordered.neighbours(
        df, keys, ["event_ts", "flow_id"],
        prev={"prev_ts": "event_ts"}, hot_rows=hot_rows)
    return out.withColumn(
        "gap_s", (F.unix_micros("event_ts") - F.unix_micros("prev_ts")) / F.lit(1e6))


def beacons(
    df: DataFrame, min_gaps: int = 5, hot_rows: int = ordered.HOT_ROWS
) -> DataFrame:
    """Flow tuples by regular timing and constant size: 1 is a perfect beacon.

    score = 1 - min(1, (cv(gap) + cv(bytes)) / 2), where cv is deviation over mean; null when
    a mean is zero.
    """
    flows = of_type(df, "flow").select(
        *TUPLE, "event_ts", "flow_id", F.col("flow.bytes_toserver").alias("sent"))
    gaps = inter_arrival(flows, hot_rows=hot_rows)
    per = gaps.groupBy(*TUPLE).agg(
        F.count("gap_s").alias("gaps"),
        F.avg("gap_s").alias("mean_gap"),
        F.try_divide(F.stddev_pop("gap_s"), F.avg("gap_s")).alias("cv_gap"),
        F.try_divide(F.stddev_pop("sent"), F.avg("sent")).alias("cv_bytes"),
    )
    score = F.lit(1.0) - F.least(F.lit(1.0), (F.col("cv_gap") + F.col("cv_bytes")) / 2)
    score = F.when(F.col("cv_gap").isNotNull() & F.col("cv_bytes").isNotNull(), score)
    return per.where(F.col("gaps") >= min_gaps).withColumn("score", score)


def rank_beacons(df: DataFrame, n: int = 10, min_gaps: int = 5) -> DataFrame:
    return common.top_k(
        beacons(df, min_gaps), n, F.desc_nulls_last("score"), F.desc("gaps"), *TUPLE)


def window_vs_full(df: DataFrame, start: str, end: str) -> DataFrame:
    """Records of each type in a sample period against the whole log."""
    inside = (F.col("event_ts") >= F.lit(start).cast("timestamp")) & (
        F.col("event_ts") < F.lit(end).cast("timestamp"))
    return df.groupBy("event_type").agg(
        F.count_if(inside).alias("in_window"), F.count(F.lit(1)).alias("in_full")
    ).withColumn("full_over_window", F.round(
        F.try_divide(F.col("in_full").cast("double"), F.col("in_window")), 6))


def name_groups(df: DataFrame) -> DataFrame:
    """Per host and name suffix: connections and distinct names."""
    found = df.where(F.col("event_type").isin("tls", "quic") & server_name().isNotNull())
    return found.groupBy("src_ip", A.name_suffix(server_name()).alias("suffix")).agg(
        F.count(F.lit(1)).alias("connections"), F.count_distinct(server_name()).alias("names"))


def peer_subnets(df: DataFrame) -> DataFrame:
    """A host's peers by /24 or, for IPv6, by /64, inside and outside apart."""
    return of_type(df, "flow").groupBy(
        "src_ip", A.subnet(F.col("dest_ip")).alias("subnet"),
        A.is_external(F.col("dest_ip")).alias("external"),
    ).agg(F.count_distinct("dest_ip").alias("peers"), F.count(F.lit(1)).alias("flows"))


def top_peers(df: DataFrame, n: int = 3) -> DataFrame:
    """The peers each source sends most to."""
    pairs = of_type(df, "flow").groupBy("src_ip", "dest_ip").agg(
        F.sum("flow.bytes_toserver").alias("bytes"))
    return common.top_per(pairs, "src_ip", n, F.desc("bytes"), "dest_ip")


def rank_hosts(df: DataFrame, exact_slices: int | None = None) -> DataFrame:
    """Every host's rank by bytes sent outside, ties explicit."""
    return ordered.global_rank(egress(df).select("src_ip", "up"), "up", exact_slices)


def field_profile(lines: DataFrame, raw: str = "_raw") -> DataFrame:
    """Which top-level and nested fields occur per event type, how often, and as which type.

    Lines are parsed once and stored as variants, which are read for the counts and for each walk.
    """
    parsed = lines.select(F.explode(F.array(F.try_parse_json(raw))).alias("v"))
    kind = F.try_variant_get("v", "$.event_type", "string")
    records = materialize(parsed.select(F.coalesce(kind, F.lit("unknown")).alias("event_type"), "v"), "records")
    return profile_variant(records, "event_type", "v")


def _undotted(path: str) -> Column:
    return F.when(F.startswith(path, F.lit(".")), F.substr(path, F.lit(2))).otherwise(F.col(path))


_LEVELS = 4  # of nesting that one pass walks


def walk_variant(df: DataFrame, key: str, variant: str) -> DataFrame:
    """Every field of a variant object to its real depth: k, path, value, leaf.

    A path is the names from the top, joined by dots; elements of an array are told one by one
    under ``[]``. ``leaf`` is false for objects and arrays that hold something. A pass walks
    four levels; what lies deeper is stored and walked by the next one, until nothing is left.
    """
    inside = "case when schema_of_variant({0}) rlike '^(OBJECT|ARRAY)' then {0} end"
    level = df.select(F.col(key).alias("k"), F.lit("").alias("path"), F.col(variant).alias("value"))
    level = level.where(F.schema_of_variant("value").startswith("OBJECT"))
    out = None
    while True:
        laterals = " ".join(
            f", lateral variant_explode{'_outer' if i > 1 else ''}("
            f"{f'l{i - 1}' if i > 1 else 'd'}.value) l{i}" for i in range(1, _LEVELS + 1))
        columns = ", ".join(f"l{i}.key as k{i}, l{i}.value as v{i}, l{i}.pos as p{i}"
                            for i in range(1, _LEVELS + 1))
        rows = df.sparkSession.sql(f"select d.k, d.path, {columns} from {{d}} d {laterals}", d=level)
        told, path = [], F.col("path")
        for i in range(1, _LEVELS + 1):
            name = F.coalesce(F.concat(F.lit("."), f"k{i}"), F.lit("[]"))
            path = F.concat(path, name)
            # A field comes once for everything below it; it is told with the first of that.
            first = F.lit(True)
            for j in range(i + 1, _LEVELS + 1):
                first = first & (F.coalesce(F.col(f"p{j}"), F.lit(0)) == 0)
            leaf = F.col(f"p{i + 1}").isNull() if i < _LEVELS else ~F.expr(inside.format(f"v{i}")).isNotNull()
            told.append(F.when(F.col(f"p{i}").isNotNull() & first, F.struct(
                path.alias("path"), F.col(f"v{i}").alias("value"), leaf.alias("leaf"))))
        found = rows.select("k", F.explode(F.array(*told)).alias("f")).where("f is not null").select(
            "k", _undotted("f.path").alias("path"), "f.value", "f.leaf")
        out = found if out is None else out.unionByName(found)
        last = rows.select("k", path.alias("path"), F.expr(inside.format(f"v{_LEVELS}")).alias("value"))
        level = materialize(last.where("value is not null"), "deeper")
        if level.isEmpty():
            return out


def profile_variant(df: DataFrame, key: str, variant: str) -> DataFrame:
    """Presence and type of each field of a variant object, at any depth.

    Elements of an array count each, so their presence may pass 1.
    """
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("records"))
    # The pattern is looked for in the few schemas that differ before their brackets, not in every field.
    outer = F.substring_index(F.substring_index(F.schema_of_variant("value"), "<", 1), "(", 1)
    found = walk_variant(df, key, variant).groupBy(
        F.col("k").alias(key), "path", outer.alias("outer")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.regexp_extract("outer", r"^[A-Z]+", 0)
    found = found.groupBy(key, "path", kind.alias("type")).agg(F.sum("n").alias("n"))
    return found.join(totals, key).select(
        key, "path", "type", "n",
        F.round(F.col("n").cast("double") / F.col("records"), 6).alias("presence"))


def stats_rollup(df: DataFrame) -> DataFrame:
    """Smallest, largest and mean value of every numeric leaf of the sensor telemetry.

    ``stats`` is a variant; leaves are read at any depth, array elements under ``[]``.
    """
    view = of_type(df, "stats").select(F.lit(0).alias("one"), "stats")
    leaves = walk_variant(view, "one", "stats").where("leaf").select(
        "path", F.try_variant_get("value", "$", "double").alias("x"))
    return leaves.where("x is not null").groupBy("path").agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
        F.round(F.avg("x"), 6).alias("mean"))
