"""The nearest alias by shared pieces, against every pair in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from duskwatch.operators import nearest


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def edited(rng, word, letters, edits):
    for _ in range(edits):
        at, kind = rng.randint(0, len(word)), rng.randint(0, 2)
        new = rng.choice(letters) if kind else ""
        word = word[:at] + new + word[at + (kind != 1):]
    return word


def frames(spark, names, aliases):
    return (spark.createDataFrame([(n,) for n in names], "name string"),
            spark.createDataFrame([(a,) for a in aliases], "alias string"))


@pytest.mark.parametrize("letters", ["ab", "abcdefgh", "aé你\U0001f600-:"])
def test_random_names(spark, letters):
    rng = random.Random(len(letters))
    word = lambda most: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    aliases = [word(14) for _ in range(150)] + [word(3) for _ in range(5)]
    names = [edited(rng, rng.choice(aliases), letters, rng.randint(0, 6)) for _ in range(120)]
    names += [word(20) for _ in range(40)] + ["zzz", "z" * 30, "", "z"]
    found = nearest.nearest(*frames(spark, names + names[:9] + [None], aliases + aliases[:9] + [None])).collect()
    assert len(found) == len(set(names)) + 1
    for r in found:
        if r.name is None:
            assert (r.alias, r.distance) == (None, None)
        else:
            assert (r.distance, r.alias) == min((distance(r.name, a), a) for a in aliases), r.name


def test_long_aliases_and_strangers(spark):
    names, aliases = ["xyz", "q" * 9], ["abcdefghijkl", "abcdefg", "abcdefh"]
    found = nearest.nearest(*frames(spark, names, aliases)).collect()
    assert sorted(map(tuple, found)) == [("q" * 9, "abcdefg", 9), ("xyz", "abcdefg", 7)]
    assert nearest.nearest(*frames(spark, names, [])).collect() == [("xyz", None, None), ("q" * 9, None, None)] or \
        sorted(map(tuple, nearest.nearest(*frames(spark, names, [])).collect())) == [("q" * 9, None, None), ("xyz", None, None)]
    assert nearest.nearest(*frames(spark, [], aliases)).collect() == []


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_pairs_within_the_radius_are_met_and_others_share_a_piece(spark, radius):
    rng = random.Random(radius)
    aliases = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(120)]
    names = [edited(rng, rng.choice(aliases), "abcd", rng.randint(0, radius)) for _ in range(80)]
    names_df, aliases_df = frames(spark, names, aliases)
    met = {tuple(r) for r in nearest.candidates(names_df, aliases_df, radius).collect()}
    for n in set(names) - {""}:
        for a in set(aliases):
            if distance(n, a) <= radius and set(n) & set(a):
                assert (n, a) in met or distance(n, a) >= max(len(n), len(a)), (n, a)
    pieces = {}
    for r in nearest._indexed(aliases_df, radius).collect():
        pieces.setdefault(r.alias, set()).add(r.letters)
    assert all(any(p in n for p in pieces[a]) for n, a in met)
    assert len(met) < 0.9 * len(set(names)) * len(set(aliases))


def test_a_hundred_thousand_aliases(spark):
    """Each name meets few of the aliases; the nearest is the one it was made from."""
    aliases = spark.range(100_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24).alias("alias"))
    chosen = aliases.where("crc32(alias) % 500 = 0")
    names = chosen.select(F.concat(F.substring("alias", 1, 9), F.lit("xx"), F.substring("alias", 11, 14)).alias("name"), "alias")
    found = nearest.nearest(names, aliases).join(names.withColumnRenamed("alias", "made_from"), "name")
    wrong = found.where("alias <> made_from or distance > 2")
    assert found.count() > 100 and wrong.count() == 0
    pairs = nearest.candidates(names.select("name"), aliases, 2).count()
    assert pairs < 20 * found.count()
