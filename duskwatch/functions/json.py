"""JSON lines: one parse per line, judged as a strict reader of single objects would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def opens(line: str) -> Column:
    """Whether an object begins there. A pattern alone would have every long line decoded for it."""
    return F.col(line).startswith("{") | F.col(line).rlike(r"^\s*\{")


def with_object(df: DataFrame, line: str, ddl: str, name: str) -> DataFrame:
    """Add the line as one struct of the given fields; null unless it is exactly one JSON object.

    The line is parsed as the only element of an array, so that text after the object, a
    second object, or a bare value does not pass. A field of another type becomes null and
    leaves the rest of the record in place. The parse stands in a generator, so that a later
    test on its outcome is not pushed below it and does not parse the line again.
    """
    items = F.from_json(
        F.concat(F.lit("["), F.col(line), F.lit("]")),
        f"array<struct<{ddl}>>",
        {"allowNonNumericNumbers": "true", "allowSingleQuotes": "false"},
    )
    # Long lines are looked at from their ends; only those with white space there are searched.
    closed = F.col(line).endswith("}") | F.col(line).rlike(r"\}\s*$")
    whole = opens(line) & closed
    one = F.transform(F.array(items), lambda x: F.when(whole & (F.size(x) == 1), x[0]))
    return df.select("*", F.explode_outer(one).alias(name))


def default_if_absent(line: Column, value: Column, key: str, default: str) -> Column:
    """``value``, or the default when the key is absent; an explicit null stays null."""
    absent = ~F.coalesce(F.array_contains(F.json_object_keys(line), key), F.lit(False))
    return F.when(value.isNull(), F.when(absent, F.lit(default))).otherwise(value)


def json_path(line: Column, path: str, kind: str = "string") -> Column:
    """One nested value of a line, null when it is missing, mistyped or the line is bad."""
    return F.try_variant_get(F.try_parse_json(line), path, kind)
