"""Row shapes shared by the sources and operators."""

from __future__ import annotations

from pyspark.sql import types as T

ATTRIBUTE = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("logical_type", T.StringType()),
        T.StructField("physical_type", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("nullable", T.BooleanType()),
    ]
)

HEADER = T.StructType(
    [
        T.StructField("attributes", T.ArrayType(ATTRIBUTE)),
        T.StructField("primary_key", T.ArrayType(T.StringType())),
        T.StructField("schema_fingerprint", T.StringType()),
    ]
)

NOTIFICATION = T.StructType(
    [
        T.StructField("event_type", T.StringType()),
        T.StructField(
            "dataset",
            T.StructType(
                [
                    T.StructField("id", T.StringType()),
                    T.StructField("source", T.StringType()),
                    T.StructField("zone", T.StringType()),
                ]
            ),
        ),
        T.StructField("header", HEADER),
        T.StructField("ingestion", T.StructType([T.StructField("observed_at", T.StringType())])),
        T.StructField("previous_schema_version", T.IntegerType()),
        T.StructField("correlation_id", T.StringType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

LINEAGE_EDGE = T.StructType(
    [
        T.StructField("upstream_type", T.StringType()),
        T.StructField("upstream_id", T.StringType()),
        T.StructField("downstream_type", T.StringType()),
        T.StructField("downstream_id", T.StringType()),
        T.StructField("via_attributes", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

POLICY = T.StructType(
    [
        T.StructField("policy_name", T.StringType()),
        T.StructField("allow_drop", T.BooleanType()),
        T.StructField("change_mode", T.StringType()),
        T.StructField("obligations_on_additive", T.ArrayType(T.StringType())),
        T.StructField("compatibility_for_drop", T.StringType()),
        T.StructField("compatibility_for_change_type", T.StringType()),
        T.StructField("compatibility_for_change_type_widening", T.StringType()),
        T.StructField("impact_mode", T.StringType()),
        T.StructField("max_impacted_total", T.LongType()),
        T.StructField("max_impacted_lake_tables", T.LongType()),
        T.StructField("max_impacted_vault_objects", T.LongType()),
        T.StructField("max_impacted_transformations", T.LongType()),
        T.StructField("block_on_any_impact", T.BooleanType()),
    ]
)

ATOM_DDL = "struct<kind:string,attribute:string,from_type:string,to_type:string>"

# Operation status codes of the handler contract (fixed values).
STATUS_OK = 1
STATUS_ALREADY_APPLIED = 2
STATUS_TRANSIENT_ERROR = 3
STATUS_PERMANENT_ERROR = 4

# Spark types used when a planned change is applied to a table.
SPARK_TYPES = {
    "string": T.StringType(),
    "integer": T.IntegerType(),
    "bigint": T.LongType(),
    "float": T.DoubleType(),
    "numeric": T.DecimalType(38, 18),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
    "timestamptz": T.TimestampType(),
}
