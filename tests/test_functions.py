import math
import textwrap

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from duskwatch.functions import addresses as A
from duskwatch.functions import text as T
from duskwatch.functions import values as V


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(column(F.col("x")).alias("y")).first().y


ADDRESSES = {
    "9.255.255.255": (False, True), "10.0.0.0": (True, False), "10.255.255.255": (True, False),
    "11.0.0.0": (False, True), "172.15.255.255": (False, True), "172.16.0.0": (True, False),
    "172.31.255.255": (True, False), "172.32.0.0": (False, True), "192.167.255.255": (False, True),
    "192.168.0.0": (True, False), "192.168.255.255": (True, False), "192.169.0.0": (False, True),
    "fe80::1": (True, False), "FEBF::1%eth0": (True, False), "fec0::1": (False, True), "::1": (True, False),
    "fd12:3456::9": (True, False), "2001:db8::1": (False, True), "1:2:3:4:5:6:7:8": (False, True),
    "1:2:3:4:5:6:7": (False, False), "1:2:3:4:5:6:7:8:9": (False, False), "1::2::3": (False, False),
    "::": (True, False), "::ffff:10.0.0.1": (True, False), "::ffff:9.9.9.9": (False, True), ":1::2": (False, False),
    "1:2:3:4:5:6:9.9.9.9": (False, True), "12345::": (False, False), "g::1": (False, False), "1::": (False, True),
    "1:": (False, False), "ff02::fb": (False, True), "12:30": (False, False), None: (False, False), "300.1.1.1": (False, False),
    "10.0.0": (False, False), "10.0.0.1x": (False, False), "": (False, False),
    "010.0.0.1": (False, False), "224.0.0.251": (False, True),
}


def test_private_and_external(spark):
    df = spark.createDataFrame([(a,) for a in ADDRESSES], "a string")
    got = {r.a: (r.p, r.e) for r in df.select(
        "a", A.is_private(F.col("a")).alias("p"), A.is_external(F.col("a")).alias("e")).collect()}
    assert got == ADDRESSES


def test_subnets(spark):
    want = {"10.1.2.3": "10.1.2", "2001:db8::1": "2001:db8:0:0", "2001:0DB8:00a0:1:2:3:4:5": "2001:db8:a0:1",
            "::1": "0:0:0:0", "fe80::1%eth0": "fe80:0:0:0", "::ffff:9.9.9.9": "0:0:0:0", "1:2:3::": "1:2:3:0",
            "x": None, None: None}
    df = spark.createDataFrame([(a,) for a in want], "a string")
    assert {r.a: r.s for r in df.select("a", A.subnet(F.col("a")).alias("s")).collect()} == want


def test_ipv4_num_and_ranges(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("255.255.255.255",), ("fe80::1",)], "a string")
    got = [tuple(r) for r in df.select(
        A.ipv4_num(F.col("a")), A.in_cidr(F.col("a"), "10.0.0.0/8"),
        A.is_multicast(F.col("a"))).collect()]
    assert got == [(167772161, True, False), (4294967295, False, False), (None, None, False)]
    for a, hit in {"223.255.255.255": False, "224.0.0.0": True, "239.1.1.1": True, "240.0.0.0": False}.items():
        assert one(spark, A.is_multicast, a) is hit


def test_suffixes_and_services(spark):
    assert one(spark, lambda c: A.under_suffix(c, [".Example.net"]), "a.EXAMPLE.net")
    assert one(spark, lambda c: A.under_suffix(c, ["example.net"]), "example.net")
    assert not one(spark, lambda c: A.under_suffix(c, ["example.net"]), "badexample.net")
    assert not one(spark, lambda c: A.under_suffix(c, ["example.net"]), None)
    assert tuple(one(spark, A.name_labels, "A.b.Example.org.")) == ("example.org", 4, 16)
    assert one(spark, lambda c: A.service_of(F.lit("udp"), c), 41641, "int") == "overlay_vpn"
    assert one(spark, lambda c: A.service_of(F.lit("TCP"), c), 3478, "int") is None


def test_excerpts_say_what_is_cut(spark):
    assert one(spark, T.report_excerpt, "x" * 1000) == "x" * 1000
    assert one(spark, T.report_excerpt, "x" * 1001) == "x" * 1000 + "\n... (truncated)"
    assert one(spark, T.cell_excerpt, "x" * 301) == "x" * 300 + "…"
    assert one(spark, T.echo_excerpt, " " + "x" * 407 + "\n").startswith("x" * 400 + "... (7 more chars")


def test_replies(spark):
    assert tuple(one(spark, T.reply_kind, "  STOP ")) == ("stop", None)
    assert tuple(one(spark, T.reply_kind, "Continue")) == ("continue", None)
    assert tuple(one(spark, T.reply_kind, "focus on dns ")) == ("focus", "dns")
    assert tuple(one(spark, T.reply_kind, "   ")) == ("focus", None)


def test_block_quote_and_comments(spark):
    assert one(spark, T.block_quote, "\n a\nb \n") == "> a\n> b"
    assert one(spark, T.block_quote, "  \n") is None
    assert one(spark, T.strip_comments, "a # b\nc#\n#d") == "a \nc\n"


def test_error_key(spark):
    first = one(spark, T.error_key, "cannot open /data/a/b.json line 12 id 0a1b2c3d4e5f")
    assert first == one(spark, T.error_key, "cannot open /x.json line 7 id ffffffffff")


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=" \t\nxy#", max_size=25), min_size=20, max_size=40))
def test_dedent_is_that_of_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    for r in df.select("x", T.dedent(F.col("x")).alias("y")).collect():
        assert r.y == textwrap.dedent(r.x)


def test_main_guard(spark):
    text = "a = 1\nif __name__ == '__main__':  # run\n    b = 2\n\n    if b:\n        c()\n"
    assert one(spark, T.drop_main_guard, text) == "a = 1\nb = 2\n\nif b:\n    c()\n"
    assert one(spark, T.drop_main_guard, "x = 1\n") == "x = 1\n"
    quoted = "# if __name__ == '__main__':\n" + "if __name__ == '__main__':\n    b = 2\n"
    assert one(spark, T.drop_main_guard, quoted) == "# if __name__ == '__main__':\nb = 2\n"


@pytest.mark.parametrize("wait,seconds", [
    ("45", 30.0), ("2", 2.0), ("x", 1.0), (None, 1.0), ("Infinity", 1.0), ("-3", 0.1), ("NaN", 1.0),
    (" 5 ", 5.0), ("0", 0.1)])
def test_clamp_delay(spark, wait, seconds):
    assert one(spark, V.clamp_delay, wait) == seconds


def test_task_ids(spark):
    for task, ok in {"a": True, "default": False, "memory": False, "A": False, "-a": False,
                     "a" * 64: True, "a" * 65: False, "a/b": False, "": False, None: False}.items():
        assert one(spark, V.valid_task_id, task) is ok


def test_stamps_and_times(spark):
    assert one(spark, V.run_stamp, "2026-07-19 16:51:22", "string") == "26-07-19_16-51-22"
    back = one(spark, lambda c: F.unix_seconds(V.parse_stamp(c)), "26-07-19_16-51-22")
    assert back == 1784479882
    assert one(spark, lambda c: F.unix_seconds(V.parse_eve_ts(c)), "2026-01-06T01:32:49.000001+0000") == 1767663169
    assert one(spark, V.parse_eve_ts, "yesterday") is None
    calendar = "Tue Apr 14 10:11:12 2026 UTC"
    assert one(spark, lambda c: F.unix_seconds(V.parse_osquery_time(F.lit(None).cast("bigint"), c)),
               calendar) == 1776161472
    assert one(spark, lambda c: F.unix_seconds(V.parse_osquery_time(F.lit(5).cast("bigint"), c)), calendar) == 5


def test_known_answers(spark):
    assert one(spark, lambda c: V.duration_s(c, F.lit("2026-01-06T01:31:44").cast("timestamp")),
               "2026-01-03T20:05:58") == 192346
    label = one(spark, V.bytes_label, 629368521, "bigint")
    assert (label.mb, label.mib) == (629.4, 600.2)
    assert one(spark, V.provider_of, "a:b:c") == "a"
    assert one(spark, V.provider_of, "abc") == ""
    assert one(spark, V.string_keys, {3478: 2}, "map<int,int>") == {"3478": 2}
    assert math.isclose(76449 / 31024, 2.464, abs_tol=1e-3)
