"""Host telemetry: processes, sockets, shell commands, packages, process trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duskwatch.functions import addresses as A
from duskwatch.operators import common, ordered
from duskwatch.session import materialize

# Environment keys that change which libraries a process loads.
HIJACK_KEYS = ("LD_PRELOAD", "LD_LIBRARY_PATH", "LD_AUDIT", "DYLD_INSERT_LIBRARIES")

# Command patterns worth a look.
COMMAND_RULES = (
    ("fetch", r"\b(curl|wget)\b"),
    ("hosts_edit", r"(>|\btee\b|\bsed\b|\bvim?\b|\bnano\b).*/etc/hosts\b"),
    ("encoded_shell", r"base64\s+(-d|-D|--decode)\b.*\|\s*(ba|z|da|k)?sh\b"),
    ("account_files", r"/etc/(passwd|shadow)\b"),
)

# Parent and child programs that should not meet.
CHILD_RULES = ((r"^(nginx|apache2|httpd|webserver)$", r"^(sh|bash|dash|zsh)$"),)

# Language runtimes, and where the application stands on the command line.
RUNTIME_RULES = (
    ("node", r"(?:^|/)node(?:js)?\s+(\S+)"),
    ("python", r"(?:^|/)python[0-9.]*\s+(?:-m\s+)?(\S+)"),
    ("java", r"(?:^|/)java\s.*?-jar\s+(\S+)"),
)

STANDARD_PATHS = r"^/(usr/)?(s?bin|lib|lib64|libexec|local/s?bin)/"


# --- filters ------------------------------------------------------------------------------------

def query_rows(df: DataFrame, name: str) -> DataFrame:
    """Rows of one logged query."""
    return df.where(F.col("name") == name)


def drop_expected(df: DataFrame, names: list[str], standard: str = STANDARD_PATHS) -> DataFrame:
    """Without the listed system processes, but keeping those run from an odd path."""
    expected = F.col("name").isin(*names) & F.col("path").rlike(standard)
    return df.where(~F.coalesce(expected, F.lit(False)))


def rule_hits(text: Column, rules=COMMAND_RULES) -> Column:
    """Ids of the rules a text matches, in rule order."""
    found = [F.when(text.rlike(pattern), F.lit(rule)) for rule, pattern in rules]
    return F.filter(F.array(*found), lambda hit: hit.isNotNull())


def suspicious(df: DataFrame, column: str, rules=COMMAND_RULES) -> DataFrame:
    """Rows whose text matches a rule, with the ids of the rules."""
    any_rule = "|".join(f"(?:{pattern})" for _, pattern in rules)
    return df.where(F.col(column).rlike(any_rule)).withColumn(
        "rules", rule_hits(F.col(column), rules))


def suspicious_commands(df: DataFrame, rules=COMMAND_RULES) -> DataFrame:
    return suspicious(df, "command", rules)


def suspicious_cmdlines(df: DataFrame, rules=COMMAND_RULES) -> DataFrame:
    return suspicious(df, "cmdline", rules)


def env_hijack(df: DataFrame, keys=HIJACK_KEYS) -> DataFrame:
    return df.where(F.col("key").isin(*keys))


def elevated(df: DataFrame) -> DataFrame:
    """Effective user is root, or is not the user."""
    return df.where((F.col("euid") == 0) | (F.col("euid") != F.col("uid")))


def changes(df: DataFrame, action: str) -> DataFrame:
    return df.where(F.col("action") == action)


def external_sockets(df: DataFrame) -> DataFrame:
    return df.where((F.col("state") == "ESTABLISHED") & A.is_external(F.col("remote_address")))


# --- processes and their sockets ------------------------------------------------------------------

PROCESS_KEY = ["host", "pid"]
PROCESS_ORDER = ["start_time", "seq"]


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; rows fold together before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*df.columns)


def process_directory(proc: DataFrame) -> DataFrame:
    """One row per host and pid: the process that took the pid last."""
    return latest(proc, PROCESS_KEY, PROCESS_ORDER)


_OWNER = ["path", "cmdline", "parent"]


def sockets_with_process(net: DataFrame, proc: DataFrame) -> DataFrame:
    """Sockets with path, command line and parent of the last process of their pid."""
    owners = process_directory(proc.select(*PROCESS_KEY, *PROCESS_ORDER, *_OWNER))
    return common.left_join(net, owners.select(*PROCESS_KEY, *_OWNER), PROCESS_KEY)


def sockets_asof(net: DataFrame, proc: DataFrame, seen: str = "seen_ts") -> DataFrame:
    """Sockets with the process that held their pid when they were seen."""
    owners = proc.select(*PROCESS_KEY, *PROCESS_ORDER, *_OWNER)
    out = ordered.asof(net, owners, PROCESS_KEY, seen, "start_time", ["seq"], "owner")
    return out.select(
        *net.columns, *[F.col(f"owner.{c}").alias(c) for c in _OWNER],
        F.col("owner.start_time").alias("start_time"), F.col("owner.seq").alias("process_seq"))


def with_parent(proc: DataFrame, held: tuple = ("name", "path", "cmdline")) -> DataFrame:
    """Each process with the process that held its parent's pid when it started, as ``holder``.

    A process that names itself as parent has none. ``held`` names what to keep of the holder.
    """
    child = proc.withColumnsRenamed({"pid": "_pid"}).withColumn(
        "pid", F.when(F.col("parent") != F.col("_pid"), F.col("parent")))
    holders = proc.select(*PROCESS_KEY, *PROCESS_ORDER, *held)
    orphan = child.where("pid is null").withColumn("holder", F.lit(None).cast(
        holders.select(F.struct(*holders.columns).alias("s")).schema["s"].dataType))
    placed = ordered.asof(child.where("pid is not null"), holders, PROCESS_KEY, "start_time",
                          "start_time", ["seq"], "holder")
    both = placed.unionByName(orphan)
    return both.drop("pid").withColumnRenamed("_pid", "pid").select(*proc.columns, "holder")


def child_pairs(proc: DataFrame, rules=CHILD_RULES) -> DataFrame:
    """Parent and child processes whose names match a rule."""
    pairs = with_parent(proc, held=("name",)).withColumn("parent_name", F.col("holder.name"))
    hit = F.lit(False)
    for parent, child in rules:
        hit = hit | (F.col("parent_name").rlike(parent) & F.col("name").rlike(child))
    return pairs.where(hit)


# --- the process tree -----------------------------------------------------------------------------

def lineage(
    edges: DataFrame, node: str = "pid", parent: str = "parent", within: tuple = (),
    parents_exist: bool = False, paths: bool = True,
) -> DataFrame:
    """Root, depth and path (root first) of every node, by pointer doubling.

    Every round joins each open node to the node its pointer has reached and takes over that
    node's chain, so a tree of depth d needs about log2(d) rounds. A node whose parent is
    missing, is null, or is itself is a root. Nodes on a cycle, or leading into one, are
    marked ``cyclic`` and have no root; their path ends where it would repeat.

    ``edges`` holds one row per node; ``within`` names columns, such as the host, that part
    separate trees. Each round is written to the shared folder. With ``parents_exist`` every
    parent is known to be a node and is not looked up first. Without ``paths`` a round carries
    two numbers for each open node and no chains, and the result has no path.
    """
    keys = list(within)
    base = edges.select(*keys, F.col(node).alias("node"), F.col(parent).alias("up"))
    if not parents_exist:
        base = materialize(base, "edges")
        nodes = base.select(*keys, F.col("node").alias("up"), F.lit(True).alias("known"))
        base = base.join(nodes, [*keys, "up"], "left").withColumn(
            "up", F.when(F.col("known"), F.col("up")))
    if not paths:
        return _depths(base, keys, node)
    none = F.array().cast(f"array<{base.schema['node'].dataType.simpleString()}>")
    state = base.select(
        *keys, "node", F.when(F.col("up") != F.col("node"), F.col("up")).alias("ptr"),
    ).withColumns({
        "chain": F.when(F.col("ptr").isNull(), none).otherwise(F.array("ptr")),
        "cyclic": F.lit(False),
    })
    active = materialize(state, "lineage")
    done: list[DataFrame] = []
    while active.where("ptr is not null").limit(1).count():
        done.append(active.where("ptr is null"))
        active = active.where("ptr is not null")
        target = active
        for part in done:
            target = target.unionByName(part)
        target = target.select(
            *keys, F.col("node").alias("ptr"), F.col("ptr").alias("next"),
            F.col("chain").alias("more"), F.col("cyclic").alias("bad"))
        chain = F.concat("chain", "more")
        looped = F.array_contains(chain, F.col("node"))
        stop = looped | F.col("bad")
        moved = active.join(target, [*keys, "ptr"]).select(
            *keys, "node",
            F.when(~stop, F.col("next")).alias("ptr"),
            F.when(stop, F.array_distinct(chain)).otherwise(chain).alias("chain"),
            stop.alias("cyclic"))
        # Only nodes that moved are written again.
        active = materialize(moved, "lineage")
    state = active
    for part in done:
        state = state.unionByName(part)
    depth = F.size("chain")
    return state.select(
        *keys, F.col("node").alias(node),
        F.when(~F.col("cyclic"), F.when(depth > 0, F.element_at("chain", -1))
               .otherwise(F.col("node"))).alias("root"),
        F.when(~F.col("cyclic"), depth.cast("bigint")).alias("depth"),
        F.concat(F.reverse("chain"), F.array("node")).alias("path"),
        "cyclic")


def _depths(base: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Root and depth of every node by doubling (pointer, hops), for ``base`` (keys, node, up).

    A round in which no node arrives at a root leaves only nodes on or before a cycle: of a
    deeper tree, the ancestor half as deep would have arrived.
    """
    start = base.select(
        *keys, "node", F.when(F.col("up") != F.col("node"), F.col("up")).alias("ptr"),
    ).withColumn("hops", F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("bigint"))
    start = materialize(start, "depths")
    # Roots have arrived: they point at themselves.
    arrived = [start.where("ptr is null").select(*keys, "node", F.col("node").alias("ptr"), "hops")]
    active, left = start.where("ptr is not null"), None
    while (now := active.count()) and now != left:
        left = now
        known = arrived[0]
        for part in arrived[1:]:
            known = known.unionByName(part)
        target = known.withColumn("there", F.lit(True)).unionByName(active.withColumn("there", F.lit(False)))
        target = target.select(*keys, F.col("node").alias("ptr"), F.col("ptr").alias("next"),
                               F.col("hops").alias("more"), "there")
        moved = materialize(active.join(target, [*keys, "ptr"]).select(
            *keys, "node", F.col("next").alias("ptr"), (F.col("hops") + F.col("more")).alias("hops"), "there"), "depths")
        arrived.append(moved.where("there").drop("there"))
        active = moved.where("not there").drop("there")
    parts = [part.select(*keys, "node", F.col("ptr").alias("root"), F.col("hops").alias("depth"), F.lit(False).alias("cyclic"))
             for part in arrived]
    parts.append(active.select(*keys, "node", F.lit(None).alias("root"), F.lit(None).alias("depth"), F.lit(True).alias("cyclic")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumnRenamed("node", name)


def lineage_asof(proc: DataFrame, paths: bool = True) -> DataFrame:
    """Lineage of every process start, with parents resolved by start time.

    Pids are reused, so the nodes are process starts (``seq``) and not pids.
    """
    narrow = proc.select("host", "pid", "parent", *PROCESS_ORDER)
    linked = with_parent(narrow, held=()).select("host", "seq", F.col("holder.seq").alias("up"))
    return lineage(linked, "seq", "up", within=("host",), parents_exist=True, paths=paths)


# --- state and counts -------------------------------------------------------------------------------

def current_state(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows present after all additions and removals."""
    return latest(df, keys, order).where(F.col("action") == "added")


def query_name_counts(df: DataFrame) -> DataFrame:
    return common.counts(df, "name", "name")


def commands(df: DataFrame) -> DataFrame:
    """How often each command was run, by user and history file."""
    return df.groupBy("uid", "history_file", "command").agg(F.count(F.lit(1)).alias("n"))


def listeners(df: DataFrame) -> DataFrame:
    """Processes bound to each address and port, one row each."""
    return df.where(F.col("state") == "LISTEN").groupBy(
        "host", F.col("local_address").alias("address"), F.col("local_port").alias("port"), "name",
    ).agg(F.count(F.lit(1)).alias("n"))


def net_top_processes(net: DataFrame, proc: DataFrame, n: int = 10) -> DataFrame:
    """The processes with most connections, with their number of distinct peers.

    Sockets are counted by pid before they meet the processes.
    """
    per_pid = net.groupBy(*PROCESS_KEY).agg(
        F.count(F.lit(1)).alias("connections"), F.count_distinct("remote_address").alias("peers"))
    best = common.top_k(per_pid, n, F.desc("connections"), F.desc("peers"), *PROCESS_KEY)
    owners = process_directory(proc.select(*PROCESS_KEY, *PROCESS_ORDER, *_OWNER))
    return best.join(owners.select(*PROCESS_KEY, "cmdline"), PROCESS_KEY, "left")


def runtimes(proc: DataFrame, rules=RUNTIME_RULES) -> DataFrame:
    """Applications by language runtime, with processes and hosts."""
    found = F.array(*[
        F.struct(F.lit(name).alias("runtime"),
                 F.regexp_extract("cmdline", pattern, 1).alias("app"))
        for name, pattern in rules])
    hits = F.filter(found, lambda s: s["app"] != "")
    apps = proc.select("host", F.explode_outer(hits).alias("h")).where("h is not null")
    return apps.groupBy("h.runtime", "h.app").agg(
        F.count(F.lit(1)).alias("processes"), F.count_distinct("host").alias("hosts"))


def packages(df: DataFrame) -> DataFrame:
    """Hosts and versions of each package."""
    return df.groupBy("name", "source").agg(
        F.count_distinct("host").alias("hosts"), F.count_distinct("version").alias("versions"),
        F.min("version").alias("lowest"), F.max("version").alias("highest"))


def hosts(df: DataFrame, order: tuple = ("seen", "seq")) -> DataFrame:
    """The newest inventory row of each host."""
    return latest(df, ["host"], list(order))
