"""Sinks for the two outcome streams."""

from __future__ import annotations

from pyspark.sql import DataFrame

from schemaloom.operators.events import EVOLVED, FAILED

# Sink name per event type.
ROUTES = {EVOLVED: EVOLVED, FAILED: FAILED}


def write_outcomes(messages: DataFrame, root: str) -> None:
    """Append messages below ``root``, one folder per event type, in one pass over the rows."""
    messages.filter(messages["event_type"].isin(*ROUTES)).write.mode("append").partitionBy("event_type").json(
        f"{root.rstrip('/')}/outcomes"
    )


def write_outcomes_kafka(messages: DataFrame, servers: str) -> None:
    """Send messages to the topic named by their event type (needs the Kafka connector)."""
    (
        messages.filter(messages["event_type"].isin(*ROUTES))
        .withColumnRenamed("event_type", "topic")
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .save()
    )
