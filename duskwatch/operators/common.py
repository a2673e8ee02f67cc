"""Counting, filtering and comparing that every log family shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def counts(df: DataFrame, key: str | Column, name: str) -> DataFrame:
    """Rows per key, largest first, ties by key."""
    out = df.groupBy(as_column(key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), name)


def share(df: DataFrame, key: str | Column, name: str) -> DataFrame:
    """Rows per key with their share of all rows in percent."""
    per_key = df.groupBy(as_column(key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.sum("n").alias("total")).scalar()
    return per_key.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / total, 2))


def top_k(df: DataFrame, n: int, *order) -> DataFrame:
    """First ``n`` rows by an order; each task keeps only its own first ``n``."""
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, key: str | list[str], n: int, *order) -> DataFrame:
    """First ``n`` rows of each key; rows past ``n`` are dropped before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def rare(df: DataFrame, key: str | Column, name: str, below: int = 3) -> DataFrame:
    """Values seen fewer than ``below`` times; rows without the value are left out."""
    found = df.where(as_column(key).isNotNull())
    out = found.groupBy(as_column(key).alias(name)).agg(F.count(F.lit(1)).alias("n"))
    return out.where(F.col("n") < below)


def top_with_rest(df: DataFrame, keys: list[str], metric: str, n: int = 50) -> DataFrame:
    """The ``n`` largest rows, and one row ``other`` with the sum and number of all others.

    The total of the metric is that of the input.
    """
    best = top_k(df.select(*keys, metric), n, F.desc(metric), *keys)
    best = best.withColumn("members", F.lit(1).cast("bigint"))
    # The rest is the whole minus the best, so no second ordering of the data is needed.
    whole = df.agg(F.sum(metric).alias("s"), F.count(F.lit(1)).alias("c"))
    kept = best.agg(F.coalesce(F.sum(metric), F.lit(0)).alias("s"), F.count(F.lit(1)).alias("c"))
    rest = whole.select(
        *[F.lit("other" if k == keys[0] else None).alias(k) for k in keys],
        (F.col("s") - kept.select("s").scalar()).alias(metric),
        (F.col("c") - kept.select("c").scalar()).alias("members"),
    )
    return best.unionByName(rest.where("members > 0"))


def detail_limit(df: DataFrame, order: list, n: int = 50) -> DataFrame:
    """At most ``n`` rows to show, each with the number of rows there are in all."""
    total = df.agg(F.count(F.lit(1)).alias("c")).scalar()
    return df.orderBy(*order).limit(n).withColumn("total_rows", total)


def sample(df: DataFrame, n: int = 5, order: tuple = ("event_ts", "flow_id")) -> DataFrame:
    """The first records, for a look at the fields."""
    return df.orderBy(*order).limit(n)


def between(df: DataFrame, start: str, end: str, ts: str = "event_ts") -> DataFrame:
    """Rows from ``start`` (included) to ``end`` (left out)."""
    kind = df.schema[ts].dataType.simpleString()
    return df.where((F.col(ts) >= F.lit(start).cast(kind)) & (F.col(ts) < F.lit(end).cast(kind)))


def compare(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The same groups under two conditions, with the difference and ratio of each metric.

    Both inputs hold one row per key.
    """
    left = a.select(*keys, *[F.col(m).alias(f"{m}_a") for m in metrics])
    right = b.select(*keys, *[F.col(m).alias(f"{m}_b") for m in metrics])
    out = left.join(right, keys, "full_outer")
    for m in metrics:
        x, y = F.col(f"{m}_a"), F.col(f"{m}_b")
        out = out.withColumns({f"{m}_diff": y - x, f"{m}_ratio": F.round(F.try_divide(y, x), 6)})
    return out


def suppress(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the list of known ones."""
    return df.join(known.select(*keys), keys, "left_anti")


def novel(df: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Entities of one run or window that the baseline does not have."""
    return df.select(*keys).distinct().join(baseline.select(*keys), keys, "left_anti")


def corroborated(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Entities that every run or window has."""
    tagged = [p.select(*keys, F.lit(i).alias("_part")) for i, p in enumerate(parts)]
    rows = tagged[0]
    for part in tagged[1:]:
        rows = rows.unionByName(part)
    found = rows.groupBy(*keys).agg(F.count_distinct("_part").alias("_parts"))
    return found.where(F.col("_parts") == len(parts)).drop("_parts")


def findings_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows both reports have."""
    return a.intersect(b)


def findings_except(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows only the first report has."""
    return a.subtract(b)


def first_seen(df: DataFrame, key: str | Column, name: str, ts: str = "event_ts") -> DataFrame:
    """First time, last time and number of rows of each value."""
    found = df.where(as_column(key).isNotNull())
    return found.groupBy(as_column(key).alias(name)).agg(
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count(F.lit(1)).alias("n"))


def dedupe(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Each record once, by keys or by its whole line.

    Lines are grouped by a 64-bit hash next to the line itself, so equal hashes of different
    lines stay apart; copies fold together before the shuffle.
    """
    if keys:
        return df.dropDuplicates(keys)
    rest = [c for c in df.columns if c != "_raw"]
    return (
        df.groupBy(F.xxhash64("_raw").alias("_h"), "_raw")
        .agg(*[(F.min(c) if c == "_file" else F.first(c)).alias(c) for c in rest])
        .select(*df.columns)
    )


def left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which rows with a null key, which match nothing, are not shuffled to one place."""
    known = F.lit(True)
    for k in keys:
        known = known & left[k].isNotNull()
    joined = left.where(known).join(right, keys, "left").select(
        *[left[c] for c in left.columns], *[right[c] for c in right.columns if c not in keys])
    return joined.unionByName(left.where(~known), allowMissingColumns=True)
