"""Hubs, links and satellites loaded from lake tables (Data Vault 2.0 conventions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators.ranking import previous_value


def _joined(texts: list[Column]) -> Column:
    """Each text behind its length, a null as ``n``: no two lists of texts give the same result."""
    return F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("n")) for t in texts])


def hash_key(*columns: str) -> Column:
    """Hash of trimmed, upper-cased business keys; null and empty text differ."""
    return F.md5(_joined([F.upper(F.trim(F.col(c).cast("string"))) for c in columns]))


def hash_diff(*columns: str) -> Column:
    """Hash of descriptive values; null and empty text differ."""
    return F.md5(_joined([F.col(c).cast("string") for c in columns]))


def _new_only(df: DataFrame, existing: DataFrame | None, key: str) -> DataFrame:
    return df if existing is None else df.join(existing.select(key), key, "left_anti")


def load_hub(df: DataFrame, business_key: str, source: str, existing: DataFrame | None = None, load: Column | None = None):
    """New business keys with their hash key. Keys are made distinct before they are hashed."""
    keys = df.select(F.col(business_key).alias("business_key")).filter(F.col("business_key").isNotNull()).distinct()
    hashed = keys.select(
        hash_key("business_key").alias("hub_hash"),
        "business_key",
        (F.current_timestamp() if load is None else load).alias("load_ts"),
        F.lit(source).alias("record_source"),
    )
    # spellings that differ in case or padding share a hash key; the smallest one is kept
    hashed = hashed.groupBy("hub_hash", "load_ts", "record_source").agg(F.min("business_key").alias("business_key"))
    return _new_only(hashed, existing, "hub_hash")


def load_link(df: DataFrame, keys: list[str], source: str, existing: DataFrame | None = None, load: Column | None = None):
    """New combinations of business keys with the hash of the link and of each hub."""
    # Spellings that differ in case or padding share all hashes: what is hashed is made distinct, once, and hashes are only
    # made of that. Hub hashes are left to the rows that are new.
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    texts = [F.col(f"`{k}`") if k in whole else F.upper(F.trim(F.col(f"`{k}`").cast("string"))) for k in keys]
    combos = df.dropna(subset=keys).select(*[t.alias(f"_k{n}") for n, t in enumerate(texts)]).distinct()
    parts = [F.col(f"_k{n}").cast("string") for n in range(len(keys))]
    fresh = _new_only(combos.withColumn("link_hash", F.md5(_joined(parts))), existing, "link_hash")
    return fresh.select("link_hash", *[F.md5(_joined([t])).alias(f"{k}_hash") for k, t in zip(keys, parts)]).withColumns(
        {"load_ts": F.current_timestamp() if load is None else load, "record_source": F.lit(source)}
    )


def load_satellite(
    df: DataFrame,
    business_key: str,
    attributes: list[str],
    order: str,
    source: str,
    existing: DataFrame | None = None,
    bucket: int | None = None,
) -> DataFrame:
    """Rows whose descriptive values differ from the row before them of the same key.

    ``existing`` rows of the satellite (hub_hash, hash_diff, load_seq) count as earlier; only
    the newest one per key is read.
    """
    rows = df.select(
        hash_key(business_key).alias("hub_hash"),
        F.col(order).cast("bigint").alias("load_seq"),
        hash_diff(*attributes).alias("hash_diff"),
        *attributes,
    )
    lagged = previous_value(rows, ["hub_hash"], "load_seq", "hash_diff", "_before", bucket)
    if existing is not None:
        newest = existing.groupBy("hub_hash").agg(F.max_by("hash_diff", "load_seq").alias("_stored"))
        lagged = lagged.join(newest, "hub_hash", "left").withColumn("_before", F.coalesce("_before", "_stored"))
    changed = lagged.filter(F.col("_before").isNull() | (F.col("_before") != F.col("hash_diff")))
    return changed.select("hub_hash", "load_seq", "hash_diff", *attributes, F.lit(source).alias("record_source"))


def vault_structures(parts: DataFrame) -> DataFrame:
    """Evidence rows (hub, links, satellites) from rows (dataset_id, hub, kind, name)."""

    def named(kind):
        return F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))

    return parts.groupBy("dataset_id", "hub").agg(named("link").alias("links"), named("satellite").alias("satellites"))
