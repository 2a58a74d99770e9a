"""Downstream impact of a change over an attribute-filtered lineage graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.sources.lineage_edges import artifact_class
from schemaloom.workspace import stored

# Hops after which the visited and found sets are written out anew as one table each.
_COMPACT_EVERY = 8


def with_request_ids(requests: DataFrame) -> DataFrame:
    """Distinct (dataset_id, changed) pairs with a content-based ``req_id``.

    ``changed`` must be a sorted array, so that equal requests are walked once.
    """
    return (
        requests.select("dataset_id", "changed")
        .distinct()
        .withColumn("req_id", F.sha2(F.to_json(F.struct("dataset_id", "changed")), 256))
    )


def walk(requests: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, reached) for many requests in one breadth-first traversal.

    requests: req_id, dataset_id, changed (array). edges: upstream_id, downstream_id,
    downstream_type, via_attributes.
    hits: distinct (req_id, artifact_class, artifact_id) of reported types.
    reached: distinct (req_id, node), the start included.

    An edge is usable if it lists no attributes, the request lists none, or they share one;
    the same changed set holds at every hop. Targets are reported for each usable edge,
    also when the node was reached before, so a cycle can report its own start.

    Each hop is one equi-join of the frontier with the edges; the driver only learns whether
    the next frontier is empty. Edges of one very large node are split by the adaptive skew
    join, since they are shuffled rather than kept in a fixed partition. All joins ask for a merge: a broadcast of
    each hop's frontier would pass through the driver.
    """
    e = edges.select(
        F.col("upstream_id").alias("node"),
        F.col("downstream_id").alias("target"),
        artifact_class(F.col("downstream_type")).alias("artifact_class"),
        F.coalesce("via_attributes", F.array().cast("array<string>")).alias("via"),
    ).distinct()
    e = stored(e)
    frontier = stored(requests.select("req_id", F.col("dataset_id").alias("node"), "changed"))
    changed = frontier.select("req_id", "changed")
    reached = frontier.select("req_id", "node")
    usable = F.expr("size(via) = 0 OR size(changed) = 0 OR coalesce(arrays_overlap(via, changed), false)")
    hits = None
    hop = 0
    while True:
        step = frontier.join(e.hint("merge"), "node").filter(usable).select("req_id", F.col("target").alias("node"), "artifact_class")
        known = reached.withColumn("known", F.lit(True))
        # one job per hop: targets found, and which of them are new
        step = stored(step.distinct().join(known.hint("merge"), ["req_id", "node"], "left"))
        found = step.filter(F.col("artifact_class").isNotNull()).select("req_id", "artifact_class", "node")
        hits = found if hits is None else hits.unionByName(found)
        fresh = step.filter(F.col("known").isNull()).select("req_id", "node")
        if fresh.isEmpty():
            break
        fresh = fresh.distinct()
        reached = reached.unionByName(fresh)
        hop += 1
        if hop % _COMPACT_EVERY == 0:
            reached, hits = stored(reached), stored(hits.distinct())
        frontier = fresh.join(changed.hint("merge"), "req_id")
    return hits.distinct().withColumnRenamed("node", "artifact_id"), reached


def impact_counts(hits: DataFrame) -> DataFrame:
    """Counts per request and class. ``hits`` rows are distinct, so plain counts suffice."""
    one = F.lit(1)

    def of(name):
        return F.count(F.when(F.col("artifact_class") == name, one))

    return hits.groupBy("req_id").agg(
        of("lake").alias("impacted_lake"),
        of("vault").alias("impacted_vault"),
        of("transformation").alias("impacted_transformations"),
    )


def impact_for(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset_id, changed, impacted_*) for every distinct request, zero counts included."""
    ids = stored(with_request_ids(requests))
    hits, _ = walk(ids, edges)
    zero = F.lit(0).cast("bigint")
    return ids.join(impact_counts(hits).hint("merge"), "req_id", "left").select(
        "dataset_id",
        "changed",
        F.coalesce("impacted_lake", zero).alias("impacted_lake"),
        F.coalesce("impacted_vault", zero).alias("impacted_vault"),
        F.coalesce("impacted_transformations", zero).alias("impacted_transformations"),
    )
