"""The bucketed log against a dictionary: last write wins, only touched buckets change, writes can be repeated."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.sources.bucket_table import BucketTable

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("x", T.ArrayType(T.StringType()))])


def rows(spark, values):
    return spark.createDataFrame([(k, v, [k, None] if k else None) for k, v in values.items()], SCHEMA)


def read(table, before=1 << 40, keys=None):
    return {r.k: r.v for r in table.read(before, keys).collect()}


def files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in Path(root).rglob("part-*.parquet")}


@pytest.mark.parametrize("compact_after", [1, 3, 100])
def test_last_write_wins(spark, tmp_path, compact_after):
    table = BucketTable(spark, str(tmp_path / "t"), "k", SCHEMA, buckets=4, compact_after=compact_after)
    draw, want, states = random.Random(compact_after), {}, []
    for position in range(6):
        own = {f"key{draw.randrange(9)}": draw.randrange(1000) for _ in range(draw.randrange(4))}
        states.append(dict(want))
        table.write(rows(spark, own), position)
        want |= own
    assert read(table) == want
    assert [read(table, p) for p in range(6)] == states
    live = table._live(1 << 40)
    assert all(len(own) <= compact_after + 1 for own in live.values())


def test_a_write_leaves_other_buckets_alone(spark, tmp_path):
    root = tmp_path / "t"
    table = BucketTable(spark, str(root), "k", SCHEMA, buckets=8, compact_after=2)
    for position in range(4):
        table.write(rows(spark, {f"key{n}": n + position for n in range(40)}), position)
    before, one = files(root), rows(spark, {"key7": -1})
    (bucket,) = {r.bucket for r in table._with_bucket(one).collect()}
    for position in (4, 5, 6):
        table.write(one, position)
    after = files(root)
    assert all(after[f] == at for f, at in before.items())
    new = {f for f in after if f not in before and not f.startswith("commits")}
    assert new and all(f"bucket={bucket}/" in f for f in new)
    assert any(f.startswith("base") for f in new)
    assert read(table)["key7"] == -1 and len(read(table)) == 40
    # A reader of one key opens its bucket only.
    plan = table.read(1 << 40, one.select("k")).inputFiles()
    assert plan and all(f"bucket={bucket}/" in f for f in plan)


def test_repeated_and_empty_writes(spark, tmp_path):
    table = BucketTable(spark, str(tmp_path / "t"), "k", SCHEMA, buckets=2, compact_after=1)
    assert read(table) == {}
    table.write(rows(spark, {"a": 1}), 0)
    table.write(rows(spark, {"a": 2, "b": 2}), 1)
    table.write(rows(spark, {"c": 3, "b": 3}), 1)
    table.write(rows(spark, {}), 2)
    table.write(rows(spark, {None: 9}).where(F.lit(True)), 3)
    assert read(table) == {"a": 1, "b": 3, "c": 3}
