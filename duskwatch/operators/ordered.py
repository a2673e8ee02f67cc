"""Order-dependent work inside a key that stays spread out when one key holds most rows.

A plain window sends a whole key to one task. Here the few keys that hold a large share of the
rows are stored apart, once, and cut along their order into slices of about equal numbers of rows, also
where they share one time. The window runs per key and slice, and what crosses the edge of a slice
comes from a small table with one row per hot key and slice. That row is added to the slice as an
extra line, so that the data itself is never joined back. All other keys take the plain window.

``order`` must order the rows of a key totally. Callers need not give a ``bucket`` any more: slices
follow the rows alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from duskwatch.session import materialize

_BEFORE, _ROW, _AFTER = 0, 1, 2

# A key is hot when it has more than HOT_ROWS rows and more than 1 / HOT_PARTS of all rows.
HOT_ROWS = 1_000_000
HOT_PARTS = 10_000
# A slice has HOT_ROWS rows, and no fewer than that.
LEAST_SLICE = 1_000


def time_bucket(ts: str | Column, seconds: int = 600) -> Column:
    """Number of the time slice a timestamp falls into."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(column.cast("timestamp")) / seconds)


def _struct(columns: list[str]) -> Column:
    return F.struct(*[F.col(c) for c in columns])


def _same_key(df: DataFrame, hot: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [df[k].eqNullSafe(hot[f"_hot_{k}"]) for k in keys])


def _cut(df: DataFrame, keys: list[str], order: list[str], hot_rows: int) -> DataFrame:
    """Rows with ``_bucket``: the number of their slice for hot keys, null for all others.

    One pass counts the rows of each key and stores the hot ones. Fewer than HOT_PARTS keys can be
    hot, whatever the size of the data, so their list is safe to broadcast. Only if there are any,
    their rows are stored, and again by slice; range partitioning samples them for the edges.
    """
    none = F.lit(None).cast("bigint")
    seen = Observation()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.sum("_n").alias("rows"))
    large = materialize(counts.where(F.col("_n") > hot_rows), "large-keys")
    hot = large.where(F.col("_n") > (seen.get.get("rows") or 0) / HOT_PARTS)
    total = hot.agg(F.sum("_n")).first()[0]
    if not total:
        return df.withColumn("_bucket", none)
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    rows = materialize(df.join(hot, _same_key(df, hot, keys), "left_semi"), "hot-rows")
    slices = -(-total // max(hot_rows, LEAST_SLICE))
    cut = rows.repartitionByRange(slices, *keys, *order).withColumn(
        "_bucket", F.spark_partition_id().cast("bigint"))
    rest = df.join(hot, _same_key(df, hot, keys), "left_anti").withColumn("_bucket", none)
    return rest.unionByName(materialize(cut, "hot-slices"))


def neighbours(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    bucket: Column | None = None,
    prev: dict[str, str] | None = None,
    following: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add values of the previous and the following row of the same key.

    ``prev`` and ``following`` map new column names to the columns they are taken from.
    """
    prev, following = prev or {}, following or {}
    taken = sorted({*prev.values(), *following.values()})
    rows = _cut(df, keys, order, hot_rows).withColumns(
        {"_value": _struct(taken), "_place": F.lit(_ROW)})

    per_key = Window.partitionBy(*keys).orderBy("_bucket")
    ends = rows.where("_bucket is not null").groupBy(*keys, "_bucket").agg(
        F.min_by("_value", _struct(order)).alias("_first"),
        F.max_by("_value", _struct(order)).alias("_last"),
    )
    ends = ends.withColumns(
        {"_first": F.lead("_first").over(per_key), "_last": F.lag("_last").over(per_key)}
    )
    edges = F.filter(
        F.array(
            F.struct(F.lit(_BEFORE).alias("_place"), F.col("_last").alias("_value")),
            F.struct(F.lit(_AFTER).alias("_place"), F.col("_first").alias("_value")),
        ),
        lambda e: e["_value"].isNotNull(),
    )
    extra = ends.select(*keys, "_bucket", F.inline(edges))
    rows = rows.unionByName(extra, allowMissingColumns=True)

    here = Window.partitionBy(*keys, "_bucket").orderBy("_place", *order)
    if prev:
        rows = rows.withColumn("_before", F.lag("_value").over(here))
    if following:
        rows = rows.withColumn("_after", F.lead("_value").over(here))
    return rows.where(F.col("_place") == _ROW).select(
        *df.columns,
        *[F.col(f"_before.{source}").alias(name) for name, source in prev.items()],
        *[F.col(f"_after.{source}").alias(name) for name, source in following.items()],
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None, name: str = "number",
    hot_rows: int = HOT_ROWS, step: Column | None = None,
) -> DataFrame:
    """Number the rows of each key from 1 along the order, or add ``step`` up to and including each."""
    rows = _cut(df, keys, order, hot_rows).withColumns(
        {"_place": F.lit(_ROW), "_step": (F.lit(1) if step is None else step).cast("bigint")})
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        rows.where("_bucket is not null")
        .groupBy(*keys, "_bucket").agg(F.sum("_step").alias("_step"))
        .withColumn("_step", F.sum("_step").over(before))
        .where("_step is not null")
        .withColumn("_place", F.lit(_BEFORE))
    )
    here = Window.partitionBy(*keys, "_bucket").orderBy("_place", *order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rows.unionByName(offsets, allowMissingColumns=True)
        .withColumn(name, F.sum("_step").over(here))
        .where(F.col("_place") == _ROW)
        .select(*df.columns, name)
    )


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], bucket: Column | None = None, value: Column | None = None,
    name: str = "carried", hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The latest non-null ``value`` of the key up to and including each row."""
    rows = _cut(df, keys, order, hot_rows).withColumns(
        {"_value": value, "_place": F.lit(_ROW)})
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (
        rows.where("_bucket is not null")
        .groupBy(*keys, "_bucket")
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), _struct(order)))
             .alias("_value"))
        .withColumn("_value", F.last("_value", ignorenulls=True).over(before))
        .where("_value is not null")
        .withColumn("_place", F.lit(_BEFORE))
    )
    here = Window.partitionBy(*keys, "_bucket").orderBy("_place", *order).rowsBetween(
        Window.unboundedPreceding, 0)
    return (
        rows.unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.last("_value", ignorenulls=True).over(here))
        .where(F.col("_place") == _ROW)
        .select(*df.columns, name)
    )


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    left_ts: str,
    right_ts: str,
    right_order: list[str],
    name: str,
    bucket_seconds: int | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left rows with the latest right row of the same key at or before their time, as a struct.

    Both sides are laid along one time line, so no pair of rows is built that is not kept.
    Ties at one time go to the largest ``right_order``. Rows with a null key or time match
    nothing; left ones keep their place with a null struct.
    """
    complete = lambda df, ts: reduce(
        lambda a, b: a & b, [df[c].isNotNull() for c in [*keys, ts]])
    nowhere = left.where(~complete(left, left_ts))
    left, right = left.where(complete(left, left_ts)), right.where(complete(right, right_ts))
    ties = {f"_tie{i}": c for i, c in enumerate(right_order)}
    r = right.select(
        *keys, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
        *[F.col(c).alias(t) for t, c in ties.items()],
        F.struct(*[F.col(c) for c in right.columns]).alias("_right"),
    )
    l = left.select(
        *keys, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in left.columns]).alias("_left"),
    )
    line = l.unionByName(r, allowMissingColumns=True)
    line = carry_forward(
        line, keys, ["_t", "_side", *ties], value=F.col("_right"), name=name, hot_rows=hot_rows)
    return line.where("_side = 1").select("_left.*", name).unionByName(
        nowhere, allowMissingColumns=True)


# Distinct values that a slice of a global rank has.
VALUES_A_SLICE = 1_000_000


def value_slices(values: DataFrame, metric: str, slices: int) -> DataFrame:
    """``values`` with ``_slice``, from 0 for the largest ones on; null metrics have one of their own.

    The edges are quantiles from a mergeable sketch, so fine that a slice is off by an eighth at most.
    """
    number = F.col(metric).cast("double")
    accuracy = min(65_535, max(200, 16 * slices))
    ranks = F.array(*[F.lit(i / slices) for i in range(1, slices)]) if slices > 1 else F.array().cast("array<double>")
    sketch = F.kll_sketch_agg_double(number, F.lit(accuracy))
    edges = values.where(F.col(metric).isNotNull()).agg(
        F.when(F.count(metric) > 0, F.kll_sketch_get_quantile_double(sketch, ranks)).alias("e")).first()[0] if slices > 1 else []
    above = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges or []]).cast("array<double>"), lambda e: e > number))
    return values.withColumn("_slice", F.when(F.col(metric).isNull(), slices).otherwise(above))


def global_rank(df: DataFrame, metric: str, slices: int | None = None) -> DataFrame:
    """Rank, dense rank and percent rank of every row by a metric, largest first.

    Equal metrics are counted before anything is ordered, distinct values are cut into as many
    slices as their number asks for, and only the totals of the slices meet in one place. Null
    metrics rank last.
    """
    values = materialize(df.groupBy(metric).agg(F.count(F.lit(1)).alias("_n")), "rank-values")
    total, distinct = values.agg(F.sum("_n"), F.count(F.lit(1))).first()
    slices = slices or max(1, -(-distinct // VALUES_A_SLICE))
    cut = value_slices(values, metric, slices)
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy("_slice").agg(
        F.sum("_n").alias("_rows"), F.count(F.lit(1)).alias("_values"))
    offsets = totals.select(
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows0"),
        F.coalesce(F.sum("_values").over(before), F.lit(0)).alias("_values0"),
    )
    inside = Window.partitionBy("_slice").orderBy(F.desc_nulls_last(metric))
    ranked = cut.join(F.broadcast(offsets), "_slice").select(
        metric,
        (F.col("_rows0") + F.coalesce(
            F.sum("_n").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ) + 1).alias("rank"),
        (F.col("_values0") + F.row_number().over(inside)).alias("dense_rank"),
    )
    out = df.join(ranked, df[metric].eqNullSafe(ranked[metric]), "left").drop(ranked[metric])
    return out.withColumn(
        "percent_rank",
        F.coalesce(F.try_divide((F.col("rank") - 1).cast("double"), F.lit((total or 0) - 1)), F.lit(0.0)))
