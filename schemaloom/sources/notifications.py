"""Schema notifications: parsing, validation and the split of rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.operators.barrier import kept
from schemaloom.types import NOTIFICATION

# Fixed value: the one event type that is accepted.
EVENT_TYPE = "schema.notification"


def read_values(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None) -> DataFrame:
    """Raw notification texts of JSON-lines files as ``value``, one message per line."""
    if streaming:
        reader = spark.readStream.format("text")
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.load(path)
    return spark.read.text(path)


def read_kafka_values(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """The same stream from a broker, earliest offset first (needs the Kafka connector)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select(
        F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"), "partition", "offset"
    )


def _loose(kind: T.DataType) -> T.DataType:
    """The type with texts for numbers and truth values, which keep whatever was sent."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType))
    return kind if isinstance(kind, T.MapType) else T.StringType()


def parse(values: DataFrame, value: str = "value") -> DataFrame:
    """Typed notification columns next to the raw text.

    Numbers and truth values that came as texts ("3", "yes") are converted; ``validate`` rejects what cannot be.
    """
    names = [f.name for f in NOTIFICATION]
    loose = values.withColumn("_n", F.from_json(value, _loose(NOTIFICATION))).select(*values.columns, "_n.*")
    attributes = F.transform(
        "header.attributes", lambda a: F.when(a.isNotNull(), a.withField("nullable", a["nullable"].try_cast("boolean")))
    )
    header = F.when(F.col("header").isNotNull(), F.col("header").withField("attributes", attributes))
    typed = {"header": header, "previous_schema_version": F.col("previous_schema_version").try_cast("int")}
    return loose.select(*values.columns, *[typed.get(c, F.col(c)).alias(c) for c in names])


def _mistyped(doc: Column) -> Column:
    """Whether a number or truth value is given that is none, nor a text of one."""
    version = F.try_variant_get(doc, "$.previous_schema_version", "string")
    flags = F.try_variant_get(doc, "$.header.attributes", "array<struct<nullable:string>>")
    return (version.isNotNull() & version.try_cast("int").isNull()) | F.coalesce(
        F.exists(flags, lambda a: a["nullable"].isNotNull() & a["nullable"].try_cast("boolean").isNull()), F.lit(False)
    )


def read_notifications(spark: SparkSession, path: str, streaming: bool = False, max_files: int | None = None):
    return parse(read_values(spark, path, streaming, max_files))


def validate(values: DataFrame, value: str = "value") -> DataFrame:
    """Add ``error``: the first broken rule of a raw notification, or null.

    The rules ask whether a key is present, so an explicit null passes; typed columns
    cannot tell the two apart, hence the test on the text, which is parsed once.
    """
    doc = F.col("_doc")

    def present(path):
        return F.try_variant_get(doc, path, "variant").isNotNull()

    error = (
        F.when(doc.isNull(), "Undecodable message")
        .when(
            ~F.try_variant_get(doc, "$.event_type", "string").eqNullSafe(F.lit(EVENT_TYPE)),
            "Unsupported event_type",
        )
        .when(~present("$.dataset.id"), "Missing dataset.id")
        .when(~present("$.header.attributes"), "Missing header.attributes")
        .when(~present("$.ingestion.observed_at"), "Missing ingestion.observed_at")
        .when(_mistyped(doc), "Wrongly typed field")
    )
    return values.withColumn("_doc", F.try_parse_json(value)).withColumn("error", error).drop("_doc")


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). Rejects are kept as data instead of holding up their partition."""
    return kept(validated, F.col("error").isNull()).drop("error"), kept(validated, F.col("error").isNotNull())
