"""A last-write-wins table as a log: delta files by hash bucket, a list of commits, and compaction of touched buckets only.

A write adds the new rows as one delta in each bucket that they fall into; nothing else is rewritten. Once a bucket has more
than ``compact_after`` files to merge, the write that touches it also leaves one new base for that bucket. What a reader needs
of a bucket is its last base and the deltas after it, a bounded number of folders, and of them only the buckets in which its keys
lie. A position that is written again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.workspace import exists

_COMMIT = "bucket int, kind string, position bigint"


class BucketTable:
    """Rows of ``schema`` below ``root``, one per ``key``; a null key belongs to no bucket and is left out."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: T.StructType, buckets: int = 16, compact_after: int = 8) -> None:
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        self.buckets, self.compact_after = buckets, compact_after

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _live(self, before: int) -> dict[int, list[tuple[str, int]]]:
        """Folders (kind, position) to merge for each bucket, as of the commits before a position."""
        folder = f"{self.root}/commits"
        if not exists(self.spark, folder):
            return {}
        # The folder of a commit names its position, so that no commit has to be rewritten.
        commits = self.spark.read.schema(_COMMIT).option("basePath", folder).parquet(folder).where(F.col("position") < before)
        own = W.partitionBy("bucket")
        base = F.coalesce(F.max(F.when(F.col("kind") == "base", F.col("position"))).over(own), F.lit(-1))
        live = commits.withColumn("_base", base).where("position > _base OR (position = _base AND kind = 'base')")
        found: dict[int, list[tuple[str, int]]] = {}
        for row in live.select("bucket", "kind", "position").orderBy("position").collect():
            found.setdefault(row.bucket, []).append((row.kind, row.position))
        return found

    def _folder(self, kind: str, position: int) -> str:
        return f"{self.root}/{kind}/position={position}"

    def _merged(self, live: dict[int, list[tuple[str, int]]]) -> DataFrame:
        """The newest row of each key in some buckets, with its bucket."""
        folders = sorted({f"{self._folder(kind, p)}/bucket={b}" for b, own in live.items() for kind, p in own})
        fields = self.schema.fields + [T.StructField("bucket", T.IntegerType())]
        if not folders:
            return self.spark.createDataFrame([], T.StructType(fields))
        read = self.spark.read.schema(self.schema).parquet(*folders).withColumn("_path", F.input_file_name())
        placed = read.withColumns(
            {
                "bucket": F.regexp_extract("_path", "/bucket=([0-9]+)/", 1).cast("int"),
                "_at": F.regexp_extract("_path", "/position=([0-9]+)/", 1).cast("bigint"),
            }
        )
        names = [f.name for f in self.schema.fields]
        newest = placed.groupBy("bucket", self.key).agg(F.max_by(F.struct(*[c for c in names if c != self.key]), "_at").alias("_row"))
        return newest.select(*[F.col(c) if c == self.key else F.col("_row").getField(c).alias(c) for c in names], "bucket")

    def read(self, before: int, keys: DataFrame | None = None) -> DataFrame:
        """The table as the writes before a position left it; with ``keys``, at least the rows of these, from their buckets alone."""
        live = self._live(before)
        if keys is not None and live:
            wanted = {r.bucket for r in self._with_bucket(keys.select(self.key)).select("bucket").distinct().collect()}
            live = {b: own for b, own in live.items() if b in wanted}
        return self._merged(live).drop("bucket")

    def write(self, rows: DataFrame, position: int) -> None:
        """Add rows, one per key, as the write at ``position``; positions count up from 0."""
        own = self._with_bucket(rows.where(F.col(self.key).isNotNull()).select(*[f.name for f in self.schema.fields]))
        delta = self._folder("delta", position)
        own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(delta)
        touched = [r.bucket for r in self.spark.read.schema("bucket int").option("basePath", delta).parquet(delta).select("bucket").distinct().collect()]
        entries = [(b, "delta") for b in touched]
        live = self._live(position)
        full = {b: [*live.get(b, []), ("delta", position)] for b in touched if len(live.get(b, [])) >= self.compact_after}
        if full:
            self._merged(full).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._folder("base", position))
            entries += [(b, "base") for b in full]
        commits = self.spark.createDataFrame(entries, "bucket int, kind string").coalesce(1)
        commits.write.mode("overwrite").parquet(f"{self.root}/commits/position={position}")
