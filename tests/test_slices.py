"""Slices by rows, also where a hot key has one time; scans of the input; ranks; user groups."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from duskwatch.operators import custom, ordered


@pytest.fixture(scope="module")
def one_time(spark, tmp_path_factory):
    """9,000 rows of one key at one time, and a few of others."""
    rng = random.Random(3)
    rows = [("hot", 5, i, rng.choice([None, "p", "q"])) for i in range(9_000)]
    rows += [(rng.choice(["a", "b", None]), rng.randrange(9), i, "r") for i in range(9_000, 9_500)]
    path = str(tmp_path_factory.mktemp("rows"))
    spark.createDataFrame(rows, "k string, ts bigint, id bigint, v string").repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def w():
    return Window.partitionBy("k").orderBy("ts", "id")


def test_a_slice_of_one_time_is_cut(one_time, rows):
    cut = ordered._cut(one_time, ["k"], ["ts", "id"], 1_500)
    sizes = [r["count"] for r in cut.where("_bucket is not null").groupBy("_bucket").count().collect()]
    assert sum(sizes) == 9_000 and len(sizes) >= 5 and max(sizes) < 3 * 1_500
    assert {r.k for r in cut.where("_bucket is null").select("k").distinct().collect()} == {"a", "b", None}
    got = ordered.neighbours(one_time, ["k"], ["ts", "id"], prev={"p": "id"}, following={"n": "v"}, hot_rows=1_500)
    assert rows(got) == rows(one_time.withColumns({"p": F.lag("id").over(w()), "n": F.lead("v").over(w())}))
    summed = ordered.numbered(one_time, ["k"], ["ts", "id"], name="n", hot_rows=1_500, step=F.col("id"))
    assert rows(summed) == rows(one_time.withColumn("n", F.sum("id").over(w().rowsBetween(Window.unboundedPreceding, 0))))
    carried = ordered.carry_forward(one_time, ["k"], ["ts", "id"], value=F.col("v"), name="c", hot_rows=1_500)
    want = F.last("v", ignorenulls=True).over(w().rowsBetween(Window.unboundedPreceding, 0))
    assert rows(carried) == rows(one_time.withColumn("c", want))


def scans_of(df, path):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and path in line for line in plan.split("\n"))


@pytest.mark.parametrize("hot", [1_500, 10**6])
def test_the_input_is_scanned_once_in_the_plan(one_time, hot):
    path = one_time.inputFiles()[0].split("/")[-2]
    out = ordered.neighbours(one_time, ["k"], ["ts", "id"], prev={"p": "id"}, hot_rows=hot)
    assert scans_of(out, path) == 1  # and once before, for the counts


def test_slices_of_a_skewed_metric(spark):
    rng = random.Random(5)
    values = {rng.randrange(50) if rng.random() < 0.7 else int(10 ** rng.uniform(0, 15)) for _ in range(40_000)}
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "m bigint")
    sizes = [r["count"] for r in ordered.value_slices(df, "m", 16).where("m is not null").groupBy("_slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    ordered.VALUES_A_SLICE, before = 1_000, ordered.VALUES_A_SLICE
    try:
        got = ordered.global_rank(df, "m").select("m", "rank").collect()
    finally:
        ordered.VALUES_A_SLICE = before
    order = sorted(values, reverse=True)
    assert {r.m: r["rank"] for r in got} == {**{v: i + 1 for i, v in enumerate(order)}, None: len(values) + 1}
    assert ordered.global_rank(df.limit(0), "m").count() == 0


@pytest.mark.parametrize("batch, state_rows", [(10_000, 200_000), (7, 20), (64, 1)])
def test_groups_are_merged_one_after_the_other(spark, batch, state_rows):
    rng = random.Random(batch)
    rows = [(rng.choice(["a", "b", None, f"g{i % 700}"]), rng.choice([1, None, 2]), i) for i in range(4_000)]
    df = spark.createDataFrame(rows, "k string, j bigint, v bigint")
    most = []

    def partial(f):
        return f.assign(n=1)[["k", "j", "v", "n"]]

    def merge(f):
        return f.groupby(["k", "j"], dropna=False, as_index=False)[["v", "n"]].sum()

    def finish(f):
        assert not f.duplicated(["k", "j"]).any()
        return pd.DataFrame({"k": f["k"], "j": f["j"], "total": f["v"], "n": f["n"]})

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(batch))
    try:
        out = custom.apply_group(df, ["k", "j"], partial, merge, "v bigint, n bigint", finish, "total bigint, n bigint",
                                 state_rows=state_rows)
        got = {(r.k, r.j): (r.total, r.n) for r in out.collect()}
        assert out.count() == len(got)
    finally:
        spark.conf.set(name, before)
    want = {}
    for k, j, v in rows:
        t, n = want.get((k, j), (0, 0))
        want[k, j] = t + v, n + 1
    assert got == want and not most
