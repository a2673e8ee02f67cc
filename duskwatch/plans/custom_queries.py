"""Registered queries with user code, and those run by hunt name."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from duskwatch.operators import custom, net
from duskwatch.plans import adapters, hunts
from duskwatch.plans.adapters import oracle_cte
from duskwatch.plans.registry import query

E = oracle_cte("net")


def _flows(spark, sf):
    return net.of_type(adapters.net(spark, sf), "flow").select(
        "flow_id", "src_ip", "dest_ip", F.col("flow.bytes_toserver").alias("sent"))


@query("hunt_registry", E + """select sni, count(*) as n from net where event_type = 'tls' group by 1
    having count(*) < 2""")
def hunt_registry(spark, sf):
    return hunts.run_hunt("net_rare_names", adapters.net(spark, sf), below=2)


@query("custom_rows", E + """select flow_id, src_ip, dest_ip, bytes_toserver as sent,
    length(cast(bytes_toserver as varchar)) as digits from net where event_type = 'flow'""")
def custom_rows(spark, sf):
    def digits(rows):
        return rows.assign(digits=rows["sent"].astype(str).str.len())

    return custom.apply_rows(
        _flows(spark, sf), digits,
        "flow_id bigint, src_ip string, dest_ip string, sent bigint, digits bigint")


@query("custom_groups", E + """, d as (select src_ip, length(cast(bytes_toserver as varchar)) as digits, count(*) as n
    from net where event_type = 'flow' group by 1, 2)
    select src_ip, cast(sum(n) as bigint) as flows, arg_max(digits, (n, -digits)) as digits from d group by 1""")
def custom_groups(spark, sf):
    """Commonest number of digits in a host's transfer sizes."""
    keys = ["src_ip", "digits"]

    def partial(rows):
        return rows.assign(digits=rows["sent"].astype(str).str.len()).groupby(
            keys, as_index=False).size().rename(columns={"size": "n"})

    def merge(state):
        return state.groupby(keys, as_index=False)["n"].sum()

    def finish(state):
        state = state.assign(flows=state.groupby("src_ip")["n"].transform("sum"))
        best = state.sort_values(["src_ip", "n", "digits"], ascending=[True, False, True])
        return best.drop_duplicates("src_ip")[["src_ip", "flows", "digits"]]

    return custom.apply_group(
        _flows(spark, sf), ["src_ip"], partial, merge, "digits bigint, n bigint", finish,
        "flows bigint, digits bigint")


@query("custom_agg", E + """select src_ip, round(exp(avg(ln(1 + bytes_toserver))), 3) as typical
    from net where event_type = 'flow' group by 1""")
def custom_agg(spark, sf):
    """Geometric mean of a host's transfer sizes."""
    sums = {"n": lambda rows: rows["sent"] * 0 + 1, "logs": lambda rows: np.log1p(rows["sent"])}
    out = custom.custom_agg(
        _flows(spark, sf), ["src_ip"], sums, lambda s: np.exp(s["logs"] / s["n"]), "typical")
    return out.withColumn("typical", F.round("typical", 3))
