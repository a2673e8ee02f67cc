"""Registered queries over host telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskwatch.operators import host
from duskwatch.plans import adapters
from duskwatch.plans.adapters import oracle_cte
from duskwatch.plans.registry import query, us

P = oracle_cte("process")
S = oracle_cte("socket")
PS = oracle_cte("process", "socket")
H = oracle_cte("shell")


def _like(column):
    """The command rules as the oracle spells them."""
    return f"""concat_ws(',',
        case when regexp_matches({column}, '\\b(curl|wget)\\b') then 'fetch' end,
        case when regexp_matches({column}, '>.*/etc/hosts') then 'hosts_edit' end,
        case when regexp_matches({column}, 'base64 -d [|] sh') then 'encoded_shell' end,
        case when regexp_matches({column}, '/etc/(passwd|shadow)') then 'account_files' end)"""


@query("drop_noise_host", P + """select seq, host, name, path from process
    where not (name in ('x', 'nginx') and path like '/usr/bin/%')""")
def drop_noise_host(spark, sf):
    return host.drop_expected(adapters.process(spark, sf), ["x", "nginx"]).select(
        "seq", "host", "name", "path")


@query("shell_suspicious", H + f""", r as (select seq, uid, command, {_like('command')} as rules
    from shell) select * from r where rules <> ''""")
def shell_suspicious(spark, sf):
    return host.suspicious_commands(adapters.shell(spark, sf)).select(
        "seq", "uid", "command", F.array_join("rules", ",").alias("rules"))


@query("cmdline_pattern", P + f""", r as (select seq, host, cmdline, {_like('cmdline')} as rules
    from process) select * from r where rules <> ''""")
def cmdline_pattern(spark, sf):
    return host.suspicious_cmdlines(adapters.process(spark, sf)).select(
        "seq", "host", "cmdline", F.array_join("rules", ",").alias("rules"))


@query("env_hijack", oracle_cte("environ") + """select seq, host, pid, key, value from environ
    where key in ('LD_PRELOAD', 'LD_LIBRARY_PATH')""")
def env_hijack(spark, sf):
    return host.env_hijack(adapters.environ(spark, sf)).select("seq", "host", "pid", "key", "value")


@query("elevated", P + "select seq, uid, euid from process where euid = 0 or euid <> uid")
def elevated(spark, sf):
    return host.elevated(adapters.process(spark, sf)).select(
        "seq", F.col("uid").cast("bigint").alias("uid"), F.col("euid").cast("bigint").alias("euid"))


@query("by_action", P + "select seq, host, pid from process where action = 'removed'")
def by_action(spark, sf):
    return host.changes(adapters.process(spark, sf), "removed").select("seq", "host", "pid")


@query("external_socket", S + """select seq, host, pid, remote_address from socket
    where state = 'ESTABLISHED' and remote_address not like '10.%' and remote_address not like 'fd00:%'""")
def external_socket(spark, sf):
    return host.external_sockets(adapters.socket(spark, sf)).select(
        "seq", "host", "pid", "remote_address")


@query("socket_process", PS + """, owner as (select host, pid, arg_max(path, (start_us, seq)) as path,
    arg_max(cmdline, (start_us, seq)) as cmdline, arg_max(parent, (start_us, seq)) as parent
    from process group by 1, 2)
    select s.seq, s.host, s.pid, s.remote_address, o.path, o.cmdline, o.parent
    from socket s left join owner o using (host, pid)""")
def socket_process(spark, sf):
    out = host.sockets_with_process(adapters.socket(spark, sf), adapters.process(spark, sf))
    return out.select("seq", "host", "pid", "remote_address", "path", "cmdline", "parent")


@query("socket_process_asof", PS + """, p as (select host, pid, start_us,
    max(seq) as process_seq from process group by 1, 2, 3)
    select s.seq, s.host, s.pid, p.start_us, p.process_seq, q.cmdline
    from socket s asof left join p on s.host = p.host and s.pid = p.pid and s.seen_us >= p.start_us
    left join process q on q.seq = p.process_seq""")
def socket_process_asof(spark, sf):
    out = host.sockets_asof(adapters.socket(spark, sf), adapters.process(spark, sf))
    return out.select(
        "seq", "host", "pid", us("start_time").alias("start_us"), "process_seq", "cmdline")


@query("process_lineage", P + """, tree as (select distinct host, pid, parent from process),
    line as (select t.host, t.pid, t.pid as root, 0 as depth, cast(t.pid as varchar) as path
        from tree t left join tree u on t.host = u.host and t.parent = u.pid
        where t.pid = t.parent or u.pid is null
    ), walk as (with recursive w as (select * from line union all
        select t.host, t.pid, w.root, w.depth + 1, w.path || '>' || cast(t.pid as varchar)
        from tree t join w on t.host = w.host and t.parent = w.pid and t.pid <> t.parent) select * from w)
    select host, pid, root, cast(depth as bigint) as depth, path, false as cyclic from walk""")
def process_lineage(spark, sf):
    tree = adapters.process(spark, sf).select("host", "pid", "parent").distinct()
    return host.lineage(tree, within=("host",)).select(
        "host", "pid", "root", "depth",
        F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"), "cyclic")


@query("process_lineage_asof", P + """, holder as (select host, pid, start_us, max(seq) as seq
    from process group by 1, 2, 3),
    linked as (select c.host, c.seq, h.seq as up from process c asof left join holder h
        on c.host = h.host and h.pid = case when c.parent <> c.pid then c.parent end
        and c.start_us >= h.start_us),
    walk as (with recursive w as (select host, seq, seq as root, 0 as depth,
            cast(seq as varchar) as path from linked where up is null union all
        select l.host, l.seq, w.root, w.depth + 1, w.path || '>' || cast(l.seq as varchar)
        from linked l join w on l.host = w.host and l.up = w.seq) select * from w)
    select host, seq, root, cast(depth as bigint) as depth, path from walk""")
def process_lineage_asof(spark, sf):
    return host.lineage_asof(adapters.process(spark, sf)).select(
        "host", "seq", "root", "depth",
        F.array_join(F.transform("path", lambda p: p.cast("string")), ">").alias("path"))


@query("suspicious_child", P + """, holder as (select host, pid, start_us, max(seq) as seq
    from process group by 1, 2, 3),
    linked as (select c.*, h.seq as up from process c asof join holder h
        on c.host = h.host and h.pid = case when c.parent <> c.pid then c.parent end
        and c.start_us >= h.start_us)
    select l.seq, l.host, l.name, p.name as parent_name from linked l join process p on p.seq = l.up
    where p.name = 'nginx' and l.name = 'sh'""")
def suspicious_child(spark, sf):
    return host.child_pairs(adapters.process(spark, sf)).select(
        "seq", "host", "name", "parent_name")


@query("query_name_counts", P + "select name, count(*) as n from process group by 1")
def query_name_counts(spark, sf):
    return host.query_name_counts(adapters.process(spark, sf))


@query("current_state", P + """, last as (select host, pid, arg_max(action, (start_us, seq)) as action,
    arg_max(cmdline, (start_us, seq)) as cmdline
    from process group by 1, 2) select host, pid, cmdline from last where action = 'added'""")
def current_state(spark, sf):
    rows = adapters.process(spark, sf).select("host", "pid", "action", "cmdline", "start_time", "seq")
    return host.current_state(rows, ["host", "pid"], ["start_time", "seq"]).select("host", "pid", "cmdline")


@query("command_frequency", H + """select uid, history_file, command, count(*) as n from shell
    group by 1, 2, 3""")
def command_frequency(spark, sf):
    return host.commands(adapters.shell(spark, sf))


@query("listening_ports", S + """select host, local_address as address, local_port as port, name,
    count(*) as n from socket where state = 'LISTEN' group by 1, 2, 3, 4""")
def listening_ports(spark, sf):
    return host.listeners(adapters.socket(spark, sf))


@query("net_top_processes", PS + """, owner as (select host, pid,
    arg_max(cmdline, (start_us, seq)) as cmdline from process group by 1, 2),
    best as (select host, pid, count(*) as connections, count(distinct remote_address) as peers
    from socket group by 1, 2 order by 3 desc, 4 desc, 1, 2 limit 10)
    select b.*, o.cmdline from best b left join owner o using (host, pid)""")
def net_top_processes(spark, sf):
    return host.net_top_processes(adapters.socket(spark, sf), adapters.process(spark, sf))


@query("runtime_inventory", P + """, r as (select host,
    regexp_extract(cmdline, '(?:^|/)node\\s+(\\S+)', 1) as node,
    regexp_extract(cmdline, '(?:^|/)python3\\s+-m\\s+(\\S+)', 1) as py from process)
    select 'node' as runtime, node as app, count(*) as processes, count(distinct host) as hosts
    from r where node <> '' group by 2 union all
    select 'python', py, count(*), count(distinct host) from r where py <> '' group by 2""")
def runtime_inventory(spark, sf):
    return host.runtimes(adapters.process(spark, sf))


@query("package_inventory", oracle_cte("package") + """select name, source,
    count(distinct host) as hosts, count(distinct version) as versions, min(version) as lowest,
    max(version) as highest from package group by 1, 2""")
def package_inventory(spark, sf):
    return host.packages(adapters.package(spark, sf))


@query("host_inventory", oracle_cte("system") + """select host, max(seen) as seen,
    arg_max(hostname, (seen, seq)) as hostname, arg_max(cpu_brand, (seen, seq)) as cpu_brand,
    arg_max(physical_memory, (seen, seq)) as physical_memory, arg_max(seq, (seen, seq)) as seq
    from system group by 1""")
def host_inventory(spark, sf):
    return host.hosts(adapters.system(spark, sf))
