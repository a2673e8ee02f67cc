"""The model catalogue: nested by provider, or an older flat list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.functions.values import provider_of

_MODEL = "struct<id: string, alias: string, description: string>"
SCHEMA = f"providers map<string, array<{_MODEL}>>, models array<{_MODEL}>"


def catalogue(spark: SparkSession, mapping: dict) -> DataFrame:
    """One loaded catalogue file as a one-row frame; entries of another shape are passed over."""

    def entries(value):
        rows = value if isinstance(value, list) else []
        return [
            tuple(None if m.get(k) is None else str(m[k]) for k in ("id", "alias", "description"))
            for m in rows if isinstance(m, dict)
        ]

    providers = mapping.get("providers")
    providers = providers if isinstance(providers, dict) else {}
    nested = {str(name): entries(info.get("models")) for name, info in providers.items()
              if isinstance(info, dict)}
    return spark.createDataFrame([(nested, entries(mapping.get("models")))], SCHEMA)


def _entries(model: Column, provider: Column) -> list[Column]:
    return [
        model["id"].alias("id"),
        F.coalesce(model["alias"], model["id"]).alias("alias"),
        F.coalesce(model["description"], F.lit("")).alias("description"),
        provider.alias("provider"),
    ]


def model_dim(df: DataFrame, keep: tuple = ()) -> DataFrame:
    """Catalogue rows as models: id, alias, description, provider, in catalogue order ``pos``.

    Entries without an id are skipped; the alias falls back to the id; an entry of the flat
    list takes its provider from the id. Entries that occur twice stay twice.
    """
    kept = list(keep)
    nested = df.select(*kept, F.posexplode("providers").alias("p", "provider", "ms")).select(
        *kept, "p", "provider", F.posexplode("ms").alias("m", "model"))
    nested = nested.select(
        *kept, F.struct(F.lit(0).alias("list"), "p", "m").alias("pos"),
        *_entries(F.col("model"), F.col("provider")))
    flat = df.select(*kept, F.posexplode("models").alias("m", "model")).select(
        *kept, F.struct(F.lit(1).alias("list"), F.lit(0).alias("p"), "m").alias("pos"),
        *_entries(F.col("model"), provider_of(F.col("model.id"))))
    return nested.unionByName(flat).where(F.coalesce("id", F.lit("")) != "")
