"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends where the hash of the last bytes has a given
pattern. Boundaries depend on nearby bytes only, so an insertion moves the chunks around it and no others. Chunks are
compared by digest across all documents: the first occurrence of a chunk stays, later ones that form long enough runs go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.spans import cut_out, keyed
from schemaloom.workspace import written

#: Bytes that the rolling hash sees, bits that make a boundary (a chunk in 2^bits bytes), bounds of a chunk.
WINDOW, BITS, SHORTEST, LONGEST = 16, 5, 8, 96
#: Bytes of a run of repeated chunks that is removed; shorter runs are chance.
RUN = 120

_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """Gear hash at each byte: sum of the last ``WINDOW`` gears, each shifted by its distance. By doubling: log2(WINDOW) passes."""
    total = _GEAR[data]
    reach = 1
    while reach < WINDOW:
        shifted = np.zeros_like(total)
        shifted[reach:] = total[:-reach] << np.uint32(reach)
        total = total + shifted
        reach *= 2
    return total


def chunk_ends(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of a text, ascending; none for no bytes.

    A boundary lies behind a byte whose hash has ``BITS`` low-window bits zero. Chunks below ``SHORTEST`` grow into
    the next one; above ``LONGEST`` they are cut.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    mask = np.uint32(((1 << BITS) - 1) << (WINDOW - BITS))
    marks = np.nonzero((rolling(data) & mask) == 0)[0] + 1
    ends, begin = [], 0
    for mark in [*marks.tolist(), n]:
        while mark - begin > LONGEST:
            begin += LONGEST
            ends.append(begin)
        if mark - begin >= SHORTEST or mark == n:
            if mark > begin:
                ends.append(mark)
                begin = mark
    return np.array(ends, np.int64)


def chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per chunk: (id, hash of the text, begin, end, high, low); high and low are the digest's 128 bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin in range(0, len(batch), 64):
                part, out = batch.iloc[begin : begin + 64], []
                for doc_id, text_hash, t in zip(part["id"], part["hash"], part["text"]):
                    raw = t.encode("utf-8", "surrogatepass") if t else b""
                    ends = chunk_ends(np.frombuffer(raw, np.uint8))
                    if not len(ends):
                        continue
                    begins = np.concatenate([[0], ends[:-1]])
                    digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist()))
                    pairs = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
                    out.append(pd.DataFrame({"id": doc_id, "hash": text_hash, "begin": begins, "end": ends, "high": pairs[:, 0], "low": pairs[:, 1]}))
                if out:
                    yield pd.concat(out)

    rows = keyed(docs, id_column, text).select(F.col("id").cast("string").alias("id"), "hash", "text")
    found = rows.mapInPandas(run, "id string, hash bigint, begin int, end int, high bigint, low bigint")
    return found.withColumn("id", F.col("id").cast("bigint"))


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, begin, end, remove) of every chunk whose digest occurs at another place, in any document.

    ``remove`` is false for the first occurrence: that of the smallest (id, hash, begin), null ids first. Rows of
    the same id and text count once.
    """
    found = written(chunks(docs, id_column, text), "chunks")
    # Digests are counted map-side, in short rows; only places of those that occur twice go on, and the joins can split
    # a hot digest.
    twice = found.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("high", "low")
    met = written(found.join(written(twice, "repeated"), ["high", "low"]), "places")
    here = F.struct("id", "hash", "begin")
    ends = met.groupBy("high", "low").agg(F.min(here).alias("first_at"), F.max(here).alias("last_at"))
    first = ends.where("first_at <> last_at").select("high", "low", "first_at")
    return met.join(first, ["high", "low"]).select("id", "hash", "begin", "end", (~here.eqNullSafe(F.col("first_at"))).alias("remove"))


def deduplicated(docs: DataFrame, *, run: int = RUN, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_covered, n_removed, n_spans, kept_bytes``.

    Consecutive repeated chunks of at least ``run`` bytes together are covered; of these, all but first
    occurrences are removed. Null and empty texts have no bytes. Input columns of these names are replaced.
    """
    places = repeated_chunks(docs, id_column, text)
    return cut_out(docs, places, shortest=run, id_column=id_column, text=text)
