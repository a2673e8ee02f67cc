"""The nearest of many names by edit distance, joined on shared pieces.

A name within distance d of an alias shares one of the d + 1 pieces the alias is cut into, at
nearly the same place: d edits cannot touch all of them. So a radius turns the search into an equi
join on (length of the alias, number of the piece, piece). The radius is doubled for the names
that have no alias within it, and ends where a name has nothing in common with any alias: two
texts without an equal letter are as far apart as the longer of them is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duskwatch.session import materialize


def _pieces(length: Column, radius: int) -> Column:
    """The pieces of an alias of that length: number, start from 0 and size, without empty ones."""
    size, more = F.floor(length / (radius + 1)), length % (radius + 1)
    plain = F.lit(radius + 1) - more  # pieces before that one have ``size`` letters, then one more
    each = F.transform(F.sequence(F.lit(0), F.lit(radius)), lambda i: F.struct(
        i.alias("piece"), (i * size + F.greatest(i - plain, F.lit(0))).cast("int").alias("start"),
        (size + F.when(i >= plain, 1).otherwise(0)).cast("int").alias("size")))
    return F.filter(each, lambda p: p["size"] > 0)


def _indexed(aliases: DataFrame, radius: int) -> DataFrame:
    """alias, its length, and one row for each of its pieces."""
    each = aliases.select("alias", F.length("alias").alias("alias_length")).where("alias_length > 0")
    each = each.select("alias", "alias_length", F.explode(_pieces(F.col("alias_length"), radius)).alias("p"))
    return each.select("alias", "alias_length", "p.piece",
                       F.substring("alias", F.col("p.start") + 1, F.col("p.size")).alias("letters"))


def _probes(names: DataFrame, lengths: DataFrame, radius: int) -> DataFrame:
    """The stretches of each name that a piece of an alias within the radius can be.

    With d + 1 pieces, one of them is met with at most as many edits to its left as pieces are on
    its left, and likewise to its right. That bounds its shift from both ends. Aliases no longer
    than the radius have pieces of one letter, which may be shifted by the whole radius.
    """
    size, shift = F.length("name"), F.length("name") - F.col("alias_length")
    near = names.where("name != ''").select("name", F.explode(F.sequence(
        F.greatest(F.length("name") - radius, F.lit(1)), F.length("name") + radius)).alias("alias_length"))
    near = near.join(lengths, "alias_length")
    each = near.select("name", "alias_length", F.explode(_pieces(F.col("alias_length"), radius)).alias("p"))
    left, right, start = F.col("p.piece"), F.lit(radius) - F.col("p.piece"), F.col("p.start")
    tight = F.col("alias_length") > radius
    low = F.when(tight, F.greatest(start - left, start + shift - right)).otherwise(start - radius)
    high = F.when(tight, F.least(start + left, start + shift + right)).otherwise(start + radius)
    each = each.select("name", "alias_length", "p.piece", "p.size",
                       F.greatest(low, F.lit(0)).alias("low"), F.least(high, size - F.col("p.size")).alias("high"))
    each = each.where("low <= high").withColumn("at", F.explode(F.sequence("low", "high")))
    return each.select("name", "alias_length", "piece", F.substring("name", F.col("at") + 1, F.col("size")).alias("letters"))


def candidates(names: DataFrame, aliases: DataFrame, radius: int) -> DataFrame:
    """Pairs of name and alias that share a piece: all within the radius, but for those without
    an equal letter. A pair can appear once for each piece it shares."""
    lengths = aliases.select(F.length("alias").alias("alias_length")).distinct()
    return _probes(names, lengths, radius).join(
        _indexed(aliases, radius), ["alias_length", "piece", "letters"]).select("name", "alias")


def _strangers(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """For each name, the alias that is nearest if no alias has a letter in common with it.

    That distance is the length of the name if an alias is no longer, else of the shortest alias.
    """
    marks = aliases.groupBy(F.length("alias").alias("size")).agg(F.min("alias").alias("alias")).withColumn("asks", F.lit(0))
    sizes = names.select(F.length("name").alias("size"), F.lit(None).cast("string").alias("alias"), F.lit(1).alias("asks"))
    # Along the lengths, a few thousand at most, not along names and aliases.
    line = Window.orderBy("size", "asks")
    shorter = F.min("alias").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    shortest = F.first(F.when(F.col("alias").isNotNull(), F.struct("size", "alias")), ignorenulls=True).over(
        line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = marks.unionByName(sizes.distinct()).withColumns({"shorter": shorter, "shortest": shortest}).where("asks = 1")
    best = known.select("size", F.struct(
        F.greatest("size", "shortest.size").alias("distance"),
        F.coalesce("shorter", "shortest.alias").alias("alias")).alias("best"))
    return names.join(best, F.length("name") == F.col("size")).select("name", "best")


def nearest(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """Columns name, alias and distance: the nearest alias, of equally near ones the first.

    ``names`` has ``name`` and ``aliases`` has ``alias``; repeats of either count once. A null name,
    or any name when there are no aliases, has a null alias and distance. Each round compares only
    the names that are left with aliases that share a piece with them.
    """
    names = materialize(names.select("name").distinct(), "names")
    aliases = materialize(aliases.select("alias").where(F.col("alias").isNotNull()).distinct(), "aliases")
    if aliases.isEmpty():
        return names.select("name", F.lit(None).cast("string").alias("alias"), F.lit(None).cast("int").alias("distance"))
    left, found, radius = names.where(F.col("name").isNotNull()), [], 1
    while not left.isEmpty():
        distance = F.levenshtein("name", "alias", radius)
        near = candidates(left, aliases, radius).select("name", F.struct(
            distance.alias("distance"), "alias").alias("best")).where("best.distance >= 0")
        both = near.unionByName(_strangers(left, aliases).where(F.col("best.distance") <= radius))
        found.append(materialize(both.groupBy("name").agg(F.min("best").alias("best")), "nearest"))
        left, radius = left.join(found[-1], "name", "left_anti"), 2 * radius
    schema = "name string, best struct<distance: int, alias: string>"
    all_found = names.sparkSession.createDataFrame([], schema)
    for best in found:
        all_found = all_found.unionByName(best)
    return names.join(all_found, "name", "left").select("name", "best.alias", "best.distance")
