"""Registered queries, their inputs derived from the given tables, and their oracle SQL."""

import importlib

FAMILIES = ("net_queries", "host_queries", "run_queries", "source_queries", "stream_queries",
            "online_queries", "custom_queries")


def load():
    """The registry with every family of queries in it."""
    for family in FAMILIES:
        importlib.import_module(f"duskwatch.plans.{family}")
    return importlib.import_module("duskwatch.plans.registry")
