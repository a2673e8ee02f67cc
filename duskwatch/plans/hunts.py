"""Named, reusable analyses: look one up by name before writing a new one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from duskwatch.operators import common, host, net, runs

HUNTS: dict[str, Callable[..., DataFrame]] = {}


def hunt(name: str, prefix: str):
    """Register a function from DataFrames to a DataFrame as ``prefix_name``."""

    def add(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        full = f"{prefix}_{name}"
        if full in HUNTS:
            raise ValueError(f"hunt {full} exists already: {HUNTS[full].__doc__}")
        HUNTS[full] = fn
        return fn

    return add


def find_hunts(words: str = "") -> list[tuple[str, str]]:
    """Names and first lines of the hunts that mention every word."""
    wanted = words.lower().split()
    found = []
    for name, fn in sorted(HUNTS.items()):
        line = (fn.__doc__ or "").strip().split("\n")[0]
        if all(w in f"{name} {line}".lower() for w in wanted):
            found.append((name, line))
    return found


def run_hunt(name: str, *frames: DataFrame, **params) -> DataFrame:
    if name not in HUNTS:
        near = ", ".join(n for n, _ in find_hunts()) or "none"
        raise KeyError(f"no hunt {name!r}; known hunts: {near}")
    return HUNTS[name](*frames, **params)


hunt("rare_names", "net")(net.rare_sni)
hunt("egress_volume", "net")(net.pcr)
hunt("beacons", "net")(net.rank_beacons)
hunt("fan_out", "net")(net.fan_out_spread)
hunt("one_way", "net")(net.one_way)
hunt("new_names", "net")(common.novel)
hunt("network_connections", "host")(host.sockets_asof)
hunt("process_lineage", "host")(host.lineage_asof)
hunt("shell_audit", "host")(host.suspicious_commands)
hunt("stalls", "run")(runs.stalls)
