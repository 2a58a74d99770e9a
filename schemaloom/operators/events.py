"""Outcome events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.operators.plan import full_operations

# Event types and failure reasons.
EVOLVED = "schema.evolved"
FAILED = "schema.evolution.failed"
POLICY_DENIED = "policy_denied"
VERIFICATION_FAILED = "verification_failed"

DEFAULT_EMITTER = "schemaloom"


def _now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.now(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def success_event(df: DataFrame, emitter: str = DEFAULT_EMITTER, now: Column | None = None) -> DataFrame:
    """Add ``event`` (struct) to rows of an allowed, executed and verified notification.

    Needs dataset_id, source, correlation_id, previous_version, new_version, compatibility,
    plan_id, operations, successful, status, issues and evidence_snapshot_refs. Both handler
    results repeat the one execution flag. Each operation carries its key, target, parameters and ids.
    """
    at = _now() if now is None else now
    flag = F.when(F.col("successful"), "success").otherwise("failed")
    event = F.struct(
        F.lit(EVOLVED).alias("event_type"),
        F.struct(F.col("dataset_id").alias("id"), F.coalesce("source", F.lit("")).alias("source")).alias("dataset"),
        F.col("correlation_id"),
        F.col("previous_version"),
        F.col("new_version"),
        F.col("compatibility"),
        F.struct(
            F.col("plan_id"),
            F.col("dataset_id"),
            F.col("correlation_id"),
            at.alias("executed_at"),
            F.expr(full_operations()).alias("operations"),
            F.struct(flag.alias("lake"), flag.alias("vault")).alias("handler_results"),
        ).alias("plan"),
        F.struct(
            F.col("status"),
            at.alias("checked_at"),
            F.col("evidence_snapshot_refs"),
            F.col("issues"),
        ).alias("verification"),
        F.struct(F.lit(emitter).alias("emitted_by"), at.alias("emitted_at")).alias("metadata"),
    )
    return df.withColumn("event", event)


def failure_event(df: DataFrame, emitter: str = DEFAULT_EMITTER, now: Column | None = None) -> DataFrame:
    """Add ``event`` to denied (``reasons``) or unverified (``issues``) rows."""
    at = _now() if now is None else now
    denied = F.col("decision") != "allow"
    event = F.struct(
        F.lit(FAILED).alias("event_type"),
        F.struct(F.col("dataset_id").alias("id")).alias("dataset"),
        F.col("correlation_id"),
        F.when(denied, POLICY_DENIED).otherwise(VERIFICATION_FAILED).alias("reason"),
        F.array_join(F.when(denied, F.col("reasons")).otherwise(F.col("issues")), "; ").alias("details"),
        F.struct(F.lit(emitter).alias("emitted_by"), at.alias("emitted_at")).alias("metadata"),
    )
    return df.withColumn("event", event)


def as_messages(df: DataFrame) -> DataFrame:
    """``event_type``, ``key`` (dataset id) and ``value`` (JSON text), ready for a sink."""
    return df.select(
        F.col("event.event_type").alias("event_type"),
        F.col("event.dataset.id").alias("key"),
        F.to_json("event", {"ignoreNullFields": "false"}).alias("value"),
    )
