"""Micro-batches through the whole path: replay, plans, registry rows and outcome events.

Every output row carries the run and batch it came from, in a folder of its own per batch that a
repeated batch overwrites. A batch that runs again after a failure therefore leaves each
row once. A run is a checkpoint: another stream over the same registry has folders of its own and
continues from the newest state that any run has committed.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions.keys import correlation_id, plan_id
from schemaloom.operators import diff, events, plan, policy
from schemaloom.operators.barrier import kept
from schemaloom.operators.lineage import impact_for
from schemaloom.operators.replay import replay
from schemaloom.functions.headers import resolve_previous_version
from schemaloom.sources.bucket_table import BucketTable
from schemaloom.sources.notifications import split_valid
from schemaloom.sources.policies import select_policy
from schemaloom.streaming.replay_stream import check_log, log_to_notifications
from schemaloom.types import HEADER
from schemaloom.workspace import exists, stored

#: What the registry knows of a dataset: its last accepted header, whole.
LATEST = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("version", T.LongType()),
        *HEADER.fields,
        T.StructField("correlation_id", T.StringType()),
        T.StructField("stored_seq", T.LongType()),
    ]
)


def replay_details(
    notifications: DataFrame, results: DataFrame, config: dict, edges: DataFrame | None, latest: DataFrame
) -> DataFrame:
    """Atoms, policy outcome and plan of every replayed notification.

    The header compared with is that of ``previous_seq`` or, for the first ones, the registry's.
    """
    seen = notifications.select("dataset_id", F.col("seq").alias("previous_seq"), F.col("attributes").alias("_seen"))
    df = (
        notifications.join(results, ["dataset_id", "seq"])
        .join(seen, ["dataset_id", "previous_seq"], "left")
        .join(latest.select("dataset_id", F.col("attributes").alias("_stored")), "dataset_id", "left")
        .withColumn("prev_attributes", F.coalesce("_seen", "_stored"))
        .drop("_seen", "_stored")
    )
    df = select_policy(policy.policy_flags(diff.with_atoms(df)), config)
    zero = F.lit(0).cast("bigint")
    if edges is None:
        df = df.withColumns({c: zero for c in policy.IMPACT_COLUMNS})
    else:
        df = stored(df.withColumn("changed", F.expr(diff.changed_attributes("atoms"))))
        found = impact_for(df.filter("has_atoms").select("dataset_id", "changed"), edges)
        df = df.join(found, ["dataset_id", "changed"], "left")
        df = df.withColumns({c: F.coalesce(c, zero) for c in policy.IMPACT_COLUMNS}).drop("changed")
    df = plan.build_plan(policy.policy_decision(df))
    return df.withColumns(
        {
            "correlation_id": F.expr(correlation_id("dataset_id", "seq")),
            "plan_id": F.expr(plan_id("dataset_id", "seq")),
            # What the producer says comes first.
            "previous_version": F.expr(resolve_previous_version("producer_version", "previous_version")),
        }
    )


def outcome_messages(details: DataFrame) -> DataFrame:
    """Messages for accepted and failed notifications; ``verified`` false is a failed verification."""
    text = F.array().cast("array<string>")
    failed_check = F.array(F.lit("Evidence does not match the expected header"))
    df = details.withColumns(
        {
            "successful": F.lit(True),
            "status": F.when(F.col("accepted"), "passed").otherwise("failed"),
            "issues": F.when(F.col("allowed") & ~F.col("accepted"), failed_check).otherwise(text),
            "evidence_snapshot_refs": text,
        }
    )
    good = events.success_event(kept(df, F.col("accepted")))
    bad = events.failure_event(kept(df, ~F.col("accepted")))
    return events.as_messages(good).unionByName(events.as_messages(bad))


COMMIT = "position bigint"


class RegistrySink:
    """``foreachBatch`` target: write(log batch, batch id) persists everything below ``root``.

    The latest headers are a ``BucketTable``: a batch reads and rewrites only the buckets of its datasets. The last write of a
    batch is its commit, its position in the order of all commits. One stream at a time may write to a registry; ``run`` names it
    and must stay the same when the stream restarts from its checkpoint.
    """

    def __init__(self, root: str, config: dict, edges: DataFrame | None = None, run: str = "first", buckets: int = 16, compact_after: int = 8):
        self.root, self.config, self.edges, self.run = root.rstrip("/"), config, edges, run
        self.buckets, self.compact_after = buckets, compact_after

    def _folder(self, table: str, batch_id: int) -> str:
        return f"{self.root}/{table}/run={self.run}/batch_id={batch_id}"

    def latest(self, spark: SparkSession) -> BucketTable:
        return BucketTable(spark, f"{self.root}/latest", "dataset_id", LATEST, self.buckets, self.compact_after)

    def _position(self, spark: SparkSession, batch_id: int) -> int:
        """The batch's position: its own if it was committed before, else the next."""
        folder = f"{self.root}/commits"
        if not exists(spark, folder):
            return 0
        rows = spark.read.schema(f"{COMMIT}, run string, batch_id int").option("basePath", folder).parquet(folder)
        own = (F.col("run") == self.run) & (F.col("batch_id") == batch_id)
        found = rows.agg(F.min(F.when(own, F.col("position"))).alias("own"), F.max("position").alias("last")).head()
        return found.own if found.own is not None else (-1 if found.last is None else found.last) + 1

    def _save(self, df: DataFrame, table: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(self._folder(table, batch_id))

    def write(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        position, table = self._position(spark, batch_id), self.latest(spark)
        checked = stored(check_log(batch))
        valid, rejected = split_valid(checked)
        self._save(rejected, "rejects", batch_id)
        notifications = stored(log_to_notifications(valid))
        known = stored(table.read(position, notifications.select("dataset_id").distinct()))
        results = stored(replay(notifications, self.config, self.edges, initial=known))
        details = stored(replay_details(notifications, results, self.config, self.edges, known))
        allowed = details.filter("allowed")
        ops = plan.explode_operations(allowed, "plan_id", "correlation_id")
        self._save(ops, "plans", batch_id)
        self._save(
            allowed.select("plan_id", "correlation_id", "dataset_id", F.size("operations").alias("operations"), "accepted"),
            "verifications",
            batch_id,
        )
        header = [f.name for f in HEADER.fields]
        versions = details.filter("accepted").select("dataset_id", F.col("new_version").alias("version"), *header, "correlation_id", "seq")
        self._save(versions, "versions", batch_id)
        rest = F.struct(*header, "correlation_id", F.col("seq").alias("stored_seq"))
        newest = versions.groupBy("dataset_id").agg(F.max("version").alias("version"), F.max_by(rest, "version").alias("_row"))
        table.write(newest.select("dataset_id", "version", "_row.*"), position)
        outcome_messages(details).write.mode("overwrite").partitionBy("event_type").json(
            self._folder("outcomes", batch_id)
        )
        self._save(spark.createDataFrame([(position,)], COMMIT), "commits", batch_id)


def run_registry(log: DataFrame, sink: RegistrySink, checkpoint: str) -> None:
    """Drain the log through the sink. The checkpoint names the run."""
    sink.run = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()
    query = (
        log.writeStream.foreachBatch(sink.write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
