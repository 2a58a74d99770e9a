"""WARC files and their fixity audit by Merkle trees.

Records are hashed where they lie; ordered ranges of offsets are hashed from their records; sixteen neighbours are hashed
into one parent, within files and on over files, up to one root. Two replicas are compared from the root down, and only
children of nodes that differ are looked at, until the damaged records are known.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.workspace import written

#: Bytes of a leaf range, children of a node, and leaf ranges that one file can have (4 GiB; a power of FAN).
RANGE, FAN, RANGES = 1 << 16, 16, 1 << 16
_MAGIC = re.compile(rb"\r\n\r\n(?=WARC/1\.)")
_NAME = re.compile(rb"\r\nWARC-Record-ID: *<([^>\r\n]*)>", re.IGNORECASE)
_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.IGNORECASE)


def record(record_id: Column, uri: Column, payload: Column, content_type: str = "text/html", date: str = "2024-01-01T00:00:00Z") -> Column:
    """A WARC 1.1 resource record as text. Null payloads are empty, null URIs are named by the record; line breaks in a URI are escaped."""
    body = F.coalesce(payload, F.lit(""))
    target = F.replace(F.replace(F.coalesce(uri, record_id), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <"), record_id,
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), target,
        F.lit(f"\r\nContent-Type: {content_type}\r\nWARC-Block-Digest: sha256:"), F.sha2(body, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def write_files(records: DataFrame, folder: str) -> None:
    """Write (file, place, record) as gzipped WARC files ``file=N/``, records in the order of ``place``.

    Records are text or bytes. One task writes one file, so the caller numbers files such that each stays small (some MB).
    The line feed that ends a row of a text file is the last byte of a record.
    """
    whole = F.expr("substring(CAST(record AS BINARY), 1, octet_length(record) - 1)").cast("string").alias("value")
    placed = records.repartition("file").sortWithinPartitions("file", "place")
    placed.select("file", whole).write.partitionBy("file").option("compression", "gzip").text(folder)


def split_records(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records of a file. Where a header cannot be read, the record goes on to the next magic line."""
    at = 0
    while at < len(raw):
        end = 0
        head = raw.find(b"\r\n\r\n", at)
        if raw.startswith(b"WARC/1.", at) and head >= 0 and (size := _LENGTH.search(raw, at, head + 2)):
            end = head + 8 + int(size[1])
            if end > len(raw) or raw[end - 4 : end] != b"\r\n\r\n":
                end = 0
        if not end:
            found = _MAGIC.search(raw, at)
            end = found.end() if found else len(raw)
        yield at, raw[at:end]
        at = end


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, content) of the files ``file=N/`` of a folder, also of an empty one."""
    number = F.regexp_extract("path", r"/file=(-?\d+)/[^/]*$", 1).cast("bigint")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(number.alias("file"), "content")


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file, record_offset, record): offsets in the uncompressed file. A file that cannot be unpacked gives what can be read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["file"], batch["content"]):
                raw = _unpacked(content)
                rows = [(number, at, own) for at, own in split_records(raw)]
                yield pd.DataFrame(rows, columns=["file", "record_offset", "record"])

    return _files(spark, folder).mapInPandas(run, "file bigint, record_offset bigint, record binary")


_LEAF = "file bigint, record_offset bigint, length bigint, record_id string, digest string"


def read_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Leaves of a tree: (file, record_offset, length, record_id, digest), hashed where the files are read.

    The id may stand anywhere in the header; it is empty where there is none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["file"], batch["content"]):
                rows = [(number, at, len(own), record_id(own), hashlib.sha256(own).hexdigest()) for at, own in split_records(_unpacked(content))]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LEAF.split(", ")])

    return _files(spark, folder).mapInPandas(run, _LEAF)


def record_id(raw: bytes) -> str:
    head = raw.find(b"\r\n\r\n")
    found = _NAME.search(raw, 0, head if head >= 0 else len(raw))
    return found[1].decode("ISO-8859-1") if found else ""


def _unpacked(content: bytes) -> bytes:
    out = io.BytesIO()
    try:
        with gzip.open(io.BytesIO(content)) as f:
            while part := f.read(1 << 20):
                out.write(part)
    except (OSError, EOFError):
        pass
    return out.getvalue()


def hashed(records: DataFrame) -> DataFrame:
    """The same leaves from records (file, record_offset, record)."""
    head = F.substring_index(F.decode("record", "ISO-8859-1"), "\r\n\r\n", 1)
    name = F.regexp_extract(head, r"(?i)\r\nWARC-Record-ID: *<([^>\r\n]*)>", 1)
    return records.select(
        "file", "record_offset", F.octet_length("record").cast("bigint").alias("length"), name.alias("record_id"), F.sha2("record", 256).alias("digest")
    )


class Tree:
    """``levels[k]``: (node, digest) with node = leaf range div FAN^k, written to the work folder; the last has one node at most."""

    def __init__(self, leaves: DataFrame, top: int | None = None) -> None:
        self.leaves = written(leaves.withColumn("node", position()), "leaves")
        entry = F.concat_ws(" ", "record_offset", "length", "digest")
        content = F.sort_array(F.collect_list(F.struct("record_offset", entry.alias("entry"))))
        level = self.leaves.groupBy("node").agg(F.sha2(F.array_join(F.transform(content, lambda c: c["entry"]), "\n"), 256).alias("digest"))
        self.levels = [written(level, "ranges")]
        last = self.levels[0].agg(F.max(F.abs("node"))).head()[0] or 0
        self.height = max(1, len(_digits(last)))
        self.grow(top or self.height)

    def grow(self, height: int) -> None:
        """Add levels up to ``height``: two trees are compared at the same one."""
        while len(self.levels) <= height:
            below = self.levels[-1]
            children = F.sort_array(F.collect_list(F.struct("node", "digest")))
            joined = F.array_join(F.transform(children, lambda c: F.concat_ws(" ", c["node"], c["digest"])), "\n")
            self.levels.append(written(below.groupBy(F.expr(f"node div {FAN}").alias("parent")).agg(F.sha2(joined, 256).alias("digest")).withColumnRenamed("parent", "node"), "nodes"))


def position() -> Column:
    return F.col("file") * RANGES + F.least(F.expr(f"record_offset div {RANGE}"), F.lit(RANGES - 1))


def _digits(n: int) -> list[int]:
    out = []
    while n:
        out.append(n % FAN)
        n //= FAN
    return out


def audit(original: Tree, replica: Tree) -> DataFrame:
    """Records that differ: (file, record_offset, length, record_id, status), as the original has them.

    status: ``altered`` (both have a record there, with other bytes), ``missing`` (the replica has none there), ``extra``
    (only the replica has one; length and id are then the replica's). Equal roots, two empty replicas
    included, give no rows. A shift of all later bytes of a file shows as missing and extra records from there on.
    """
    height = max(original.height, replica.height)
    original.grow(height)
    replica.grow(height)
    wrong = None
    for level in range(height, -1, -1):
        a, b = (t.levels[level].select("node", F.col("digest").alias(n)) for t, n in ((original, "a"), (replica, "b")))
        if wrong is not None:
            below = F.expr(f"node div {FAN}") == F.col("_parent")
            a, b = (x.join(wrong.withColumnRenamed("node", "_parent"), below, "left_semi") for x in (a, b))
        # Written, since both sides of the next level read it: else the plan would double at each level.
        wrong = written(a.join(b, "node", "full").where("NOT a <=> b").select("node"), "differing")
        if level == height and wrong.isEmpty():
            break
    names = ("file", "record_offset", "length", "record_id", "digest")
    a, b = (t.leaves.join(wrong, "node", "left_semi").select(*[F.col(c).alias(f"{n}_{c}") for c in names]) for t, n in ((original, "a"), (replica, "b")))
    same = (a["a_file"] == b["b_file"]) & (a["a_record_offset"] == b["b_record_offset"])
    status = F.when(F.col("b_digest").isNull(), "missing").when(F.col("a_digest").isNull(), "extra").otherwise("altered")
    return (
        a.join(b, same, "full")
        .where("NOT a_digest <=> b_digest")
        .select(*[F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in names[:-1]], status.alias("status"))
    )


def damaged_copy(spark: SparkSession, folder: str, copy: str, change: Callable[[int, list[bytes]], list[bytes]]) -> None:
    """Write a replica of WARC files; ``change`` gets the number and the records of a file and returns those of the copy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, content in zip(batch["file"], batch["content"]):
                records = change(number, [own for _, own in split_records(_unpacked(content))])
                yield pd.DataFrame({"file": number, "place": range(len(records)), "record": records})

    files = _files(spark, folder)
    # Each file is in one row already, so its copy is written where it was read.
    rows = files.mapInPandas(run, "file bigint, place int, record binary").sortWithinPartitions("file", "place")
    whole = F.expr("substring(record, 1, octet_length(record) - 1)").cast("string").alias("value")
    rows.select("file", whole).write.partitionBy("file").option("compression", "gzip").text(copy)
