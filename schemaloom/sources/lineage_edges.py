"""Lineage edges: JSON lines or any SQL table in, appended parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.types import LINEAGE_EDGE

# Downstream types by reporting class; other types are only passed through.
ARTIFACT_CLASSES = {
    "lake": ["lake_table", "lake_view", "table", "view"],
    "vault": ["vault_hub", "vault_link", "vault_satellite", "vault_object"],
    "transformation": ["transformation", "job", "report", "dashboard"],
}


def normalize_edges(df: DataFrame) -> DataFrame:
    """Missing attribute lists become empty ones, missing metadata an empty map."""
    return df.withColumns(
        {
            "via_attributes": F.coalesce("via_attributes", F.array().cast("array<string>")),
            "metadata": F.coalesce("metadata", F.create_map().cast("map<string,string>")),
        }
    )


def read_edges_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One edge per line; only blank and undecodable lines and those that are no object are skipped.

    Fields are read one by one: a missing or odd one does not cost the edge. A single attribute counts as a list
    of one; metadata that is no object is kept under the key ``value``, nested values as JSON texts.
    """
    doc = spark.read.text(path).select(F.try_parse_json(F.trim("value")).alias("_doc"))
    doc = doc.where(F.schema_of_variant("_doc").startswith("OBJECT"))

    def field(name: str, kind: str):
        return F.try_variant_get("_doc", f"$.{name}", kind)

    single = F.when(field("via_attributes", "string").isNotNull(), F.array(field("via_attributes", "string")))
    kind = F.schema_of_variant(field("metadata", "variant"))
    parts = F.when(kind.startswith("OBJECT"), field("metadata", "map<string,variant>"))
    texts = F.transform_values(parts, lambda _, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
    other = F.when(
        kind.isNotNull() & ~kind.startswith("OBJECT") & (kind != "VOID"),
        F.create_map(F.lit("value"), F.coalesce(field("metadata", "string"), F.to_json(field("metadata", "variant")))),
    )
    plain = [f.name for f in LINEAGE_EDGE if isinstance(f.dataType, T.StringType)]
    return normalize_edges(
        doc.select(
            *[field(c, "string").alias(c) for c in plain],
            F.coalesce(field("via_attributes", "array<string>"), single).alias("via_attributes"),
            F.coalesce(texts, other).alias("metadata"),
        )
    )


def read_edges_jdbc(spark: SparkSession, url: str, table: str, bounds: tuple[str, int, int, int] | None = None, **options):
    """Edges of a database table; ``bounds`` = (column, lower, upper, partitions) splits the read."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if bounds:
        column, lower, upper, parts = bounds
        reader = reader.options(
            partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts
        )
    return reader.load()


def append_edges(edges: DataFrame, path: str) -> None:
    """Append edges with their time of storage; repeated edges are kept."""
    normalize_edges(edges).withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(path)


def artifact_class(downstream_type):
    """Reporting class of a downstream type, null for types that are not reported."""
    t = F.lower(F.coalesce(downstream_type, F.lit("")))
    out = None
    for name, types in ARTIFACT_CLASSES.items():
        out = F.when(t.isin(types), name) if out is None else out.when(t.isin(types), name)
    return out
