"""Order-dependent operators against plain windows, on data where one key holds most rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duskwatch.operators import common, ordered


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(7)
    data = []
    for i in range(3000):
        key = "hot" if random.random() < 0.6 else random.choice(["a", "b", "c", None])
        data.append((key, random.randrange(0, 200_000), i, random.choice([None, "p", "q", "r"])))
    df = spark.createDataFrame(data, "k string, t bigint, id bigint, v string")
    return df.withColumn("ts", F.timestamp_seconds("t"))


def w():
    return Window.partitionBy("k").orderBy("ts", "id")


@pytest.mark.parametrize("hot", [0, 500, 10**6])
@pytest.mark.parametrize("seconds", [10, 10**5])
def test_neighbours(skewed, rows, seconds, hot):
    got = ordered.neighbours(skewed, ["k"], ["ts", "id"], ordered.time_bucket("ts", seconds),
                             prev={"p": "v", "pt": "t"}, following={"n": "t"}, hot_rows=hot)
    want = skewed.withColumns({"p": F.lag("v").over(w()), "pt": F.lag("t").over(w()), "n": F.lead("t").over(w())})
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot", [0, 500, 10**6])
@pytest.mark.parametrize("seconds", [10, 10**5])
def test_numbered(skewed, rows, seconds, hot):
    got = ordered.numbered(skewed, ["k"], ["ts", "id"], ordered.time_bucket("ts", seconds), "n", hot)
    assert rows(got) == rows(skewed.withColumn("n", F.row_number().over(w())))


@pytest.mark.parametrize("hot", [0, 500, 10**6])
@pytest.mark.parametrize("seconds", [10, 10**5])
def test_carry_forward(skewed, rows, seconds, hot):
    got = ordered.carry_forward(skewed, ["k"], ["ts", "id"], ordered.time_bucket("ts", seconds), F.col("v"), "last", hot)
    want = skewed.withColumn("last", F.last("v", ignorenulls=True).over(w().rowsBetween(Window.unboundedPreceding, 0)))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("hot", [0, 500, 10**6])
@pytest.mark.parametrize("seconds", [50, 10**7])
def test_asof(spark, skewed, rows, seconds, hot):
    left, right = skewed.where("id % 3 = 0 and k is not null"), skewed.where("id % 3 <> 0 and k is not null")
    got = ordered.asof(left, right, ["k"], "ts", "ts", ["id"], "r", bucket_seconds=seconds, hot_rows=hot)
    pairs = left.alias("l").join(right.alias("r"), (F.col("l.k") == F.col("r.k")) & (F.col("r.ts") <= F.col("l.ts")), "left")
    want = pairs.groupBy("l.id").agg(F.max(F.struct("r.ts", "r.id"))["id"].alias("rid"))
    assert rows(got.select("id", "r.id")) == rows(want)


def test_asof_matches_no_null_keys_or_times(spark):
    t = "timestamp'2024-01-01'"
    left = spark.sql(f"select * from values (1, null, {t}), (2, 'a', {t}), (3, 'a', null) as v(id, k, ts)")
    right = spark.sql(f"select * from values (7, null, {t}), (8, 'a', {t}), (9, 'a', null) as v(id, k, ts)")
    got = ordered.asof(left, right, ["k"], "ts", "ts", ["id"], "r")
    assert sorted((r.id, r.r and r.r.id) for r in got.collect()) == [(1, None), (2, 8), (3, None)]


@pytest.mark.parametrize("slices", [2, 7, 200])
def test_global_rank(spark, rows, slices):
    random.seed(3)
    data = [(i, random.choice([0, 0, 0, 5, None] + list(range(60)))) for i in range(700)]
    df = spark.createDataFrame(data, "id int, m bigint")
    w = Window.orderBy(F.desc_nulls_last("m"))
    want = df.withColumns({"rank": F.rank().over(w), "dense_rank": F.dense_rank().over(w),
                           "percent_rank": F.round(F.percent_rank().over(w), 9)})
    got = ordered.global_rank(df, "m", slices).withColumn("percent_rank", F.round("percent_rank", 9))
    assert rows(got.select("id", "m", "rank", "dense_rank", "percent_rank")) == rows(want)


def test_plain_windows_over_a_hot_key_are_not_used(skewed):
    out = ordered.neighbours(skewed, ["k"], ["ts", "id"], ordered.time_bucket("ts", 60), prev={"p": "v"}, hot_rows=500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(k" in plan and "_bucket" in plan.split("hashpartitioning(k")[1][:40]


def test_rest_keeps_the_total(spark):
    df = spark.createDataFrame([(f"k{i}", i) for i in range(100)], "k string, n bigint")
    out = common.top_with_rest(df, ["k"], "n", 10)
    assert out.agg(F.sum("n"), F.sum("members")).first()[:] == (4950, 100)
    assert out.where("k = 'other'").first().members == 90
    assert common.top_with_rest(df.limit(5), ["k"], "n", 10).where("k = 'other'").count() == 0


def test_novel_and_corroborated_are_disjoint(spark):
    a = spark.createDataFrame([(1,), (2,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    new = {r.k for r in common.novel(b, a, ["k"]).collect()}
    both = {r.k for r in common.corroborated([a, b], ["k"]).collect()}
    assert new == {3} and both == {2}


def test_shares_add_up(spark):
    df = spark.createDataFrame([(i % 4,) for i in range(80)], "k int")
    assert common.share(df, "k", "k").agg(F.sum("pct")).first()[0] == 100.0
    counted = [tuple(r) for r in common.counts(df.where("k < 2").union(df.where("k = 3").limit(5)), "k", "k").collect()]
    assert counted == [(0, 20), (1, 20), (3, 5)]


def test_detail_limit_says_how_many_there_are(spark):
    df = spark.range(120)
    out = common.detail_limit(df, ["id"])
    assert out.count() == 50 and out.first().total_rows == 120
