"""Token ids as compressed, checksummed block files.

Documents are put in ascending order of their ids, encoded by a public tokenizer, and the ids of each shard
(one task's range of documents) are coded by ``range_coder`` into blocks. A block file is a Parquet folder with
one row for a few consecutive blocks: where they lie, the pieces of documents in them, the order-0 shares that all start from, and
the blocks themselves. Each block can be decoded without the others.
"""

from __future__ import annotations

import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from schemaloom.llm import range_coder
from schemaloom.llm.tables import packed, released

#: Words whose ids a worker remembers at most; beyond, it forgets all.
REMEMBERED = 200_000
#: Ids that are gathered before they are coded: as many as the lanes take.
GATHERED = range_coder.BLOCK * range_coder.LANES

#: Blocks of one row: consecutive, with one prior.
GROUP = 64

BLOCKS = (
    "shard bigint, block bigint, first_id bigint, n_ids bigint, first_document bigint, "
    "doc_ids array<bigint>, ends array<bigint>, prior binary, data array<binary>"
)


def _arrow_schema() -> pa.Schema:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in BLOCKS.split(", "))])


class Encoder:
    """Ids of whole texts, as bytes of little-endian unsigned 32-bit integers.

    A tokenizer that drops white space and never joins what it parts is asked word by word, and a word that a worker
    has seen (also in an earlier task) is not encoded again. Any other gets whole texts.
    """

    def __init__(self, path: str) -> None:
        # A module of this name outlives the task, unlike this code, which travels with each one.
        memory = sys.modules.setdefault("_words_of_worker", types.ModuleType("_words_of_worker"))
        if getattr(memory, "path", None) != path:
            memory.path, memory.tokenizer, memory.ids = path, Tokenizer.from_file(path), {}
            memory.by_word = drops_white_space(memory.tokenizer)
        self.tokenizer, self.ids, self.by_word = memory.tokenizer, memory.ids, memory.by_word

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        split = [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]
        known = self.ids.__getitem__
        try:
            return [b"".join(map(known, words)) for words in split]
        except KeyError:
            pass
        if len(self.ids) > REMEMBERED:
            self.ids.clear()
        fresh = list(set().union(*split) - self.ids.keys())
        for begin in range(0, len(fresh), 4096):
            words = fresh[begin : begin + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
            for word, e in zip(words, found):
                self.ids[word] = array("I", e.ids).tobytes()
        return [b"".join(map(known, words)) for words in split]


#: White space between, before and after words of several kinds, alone and repeated.
_PROBES = ("a b", " a", "a ", "a  b", "\ta\nb\r\n c", "It's 12 o'clock,  isn't it?\n\n", "x \x0b\x0c y", "é è\n日本 語 🙂 !? ..")


def drops_white_space(tokenizer: Tokenizer) -> bool:
    """Whether a tokenizer gives the words of each probe, alone, the ids that it gives them in the probe."""

    def ids(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    return all(ids(p) == [i for w in p.encode().split() for i in ids(w.decode())] for p in _PROBES)


def write_blocks(docs: DataFrame, folder: str, *, tokenizer: str | None = None, end_id: int = 2, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the block file of ``docs`` to ``folder``: ids of each whole text, then ``end_id``.

    Order: by id (null first), then by text hash, so that repeated ids may spread over shards. A null or empty
    text has the end id only; an empty table gives an empty file. Other columns are not looked at.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = Encoder(path), TaskContext.get().partitionId()
        tail = np.array([end_id], "<u4").tobytes()
        held: list[bytes] = []
        doc_ids: list[int | None] = []  # of documents that have ids in what is held
        ends: list[int] = []  # where these end, from the first id held
        size = first_id = block = document = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, doc_ids, ends, size, first_id, block, document
            ids = np.frombuffer(b"".join(held), "<u4")
            held = []
            edges, rows = range_coder.cuts(len(ids)), []
            stops = np.array(ends, np.int64)
            prior, blocks = range_coder.encode_with_prior(ids)
            for k in range(0, len(blocks), GROUP):
                data, begin, end = blocks[k : k + GROUP], edges[k], edges[min(k + GROUP, len(blocks))]
                a, b = np.searchsorted(stops, [begin + 1, end])
                last = min(b + 1, len(stops))
                rows.append((
                    shard, block, first_id + begin, end - begin, document + int(a), doc_ids[a:last],
                    (np.minimum(stops[a:last], end) - begin).tolist(), prior, data,
                ))
                block += len(data)
            document, first_id = document + len(doc_ids), first_id + len(ids)
            held, doc_ids, ends, size = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            # Few texts at once become Python's; the batch itself may hold very long ones.
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                for doc_id, ids in zip(part.column("id").to_pylist(), encoder.encode(part.column("text").to_pylist())):
                    held.append(ids + tail)
                    size += len(held[-1]) // 4
                    doc_ids.append(None if doc_id is None else int(doc_id))
                    ends.append(size)
                    # Blocks are cut at ids, but what is coded at once ends with a document.
                    if size >= GATHERED:
                        yield flush()
        if size:
            yield flush()
        released()

    rows = packed(docs, id=id_column, text=text, _h=F.xxhash64(F.col(f"`{text}`"))).drop("_row")
    order = ["id", "_h"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = placed.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, BLOCKS)
    blocks.write.parquet(folder)


def read_blocks(blocks: DataFrame) -> DataFrame:
    """Decode blocks: (shard, block, position, n_ids, document, doc_id, ids) for each piece of a document.

    ``document`` numbers the documents of a shard, ``position`` the ids of a shard, ``ids`` are little-endian
    unsigned 32-bit integers. A damaged block is an error.
    """
    schema = "shard bigint, block bigint, position bigint, n_ids bigint, document bigint, doc_id bigint, ids binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[tuple] = []

        def done() -> pd.DataFrame:
            rows = []
            decoded = iter(range_coder.decode_with_priors([b for w in waiting for b in w[-1]], [w[-2] for w in waiting for _ in w[-1]]))
            for shard, block, first, document, doc_ids, ends, _, data in waiting:
                ids, begin = np.concatenate([next(decoded) for _ in range(len(data))]), 0
                for n, (doc_id, end) in enumerate(zip(doc_ids, ends)):
                    own = ids[begin:end].astype("<u4").tobytes()
                    rows.append((shard, block, first + begin, end - begin, document + n, doc_id, own))
                    begin = end
            waiting.clear()
            return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({"doc_id": "Int64"})

        for batch in batches:
            for row in zip(*(batch[c] for c in ("shard", "block", "first_id", "first_document", "doc_ids", "ends", "prior", "data"))):
                waiting.append(row)
                if len(waiting) * GROUP >= range_coder.LANES:
                    yield done()
        if waiting:
            yield done()
        released()

    named = blocks.select("shard", "block", "first_id", "first_document", F.transform("doc_ids", lambda d: d.cast("string")).alias("doc_ids"), "ends", "prior", "data")
    return named.mapInPandas(_with_numbers(run), schema)


def _with_numbers(run):
    """``doc_ids`` come as text, since pandas would make doubles of whole numbers beside nulls."""

    def wrapped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def numbered() -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.assign(doc_ids=[[None if d is None else int(d) for d in x] for x in batch["doc_ids"]])

        return run(numbered())

    return wrapped


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of crc32; bit 31 is the constant term."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = (b >> 1) ^ (_POLYNOMIAL if b & 1 else 0)
    return product


def joined_crc32(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings together, from their own and the second's length in bytes."""
    shift, power, n = 1 << 31, 1 << 30, 8 * length
    while n:
        if n & 1:
            shift = _times(shift, power)
        power = _times(power, power)
        n >>= 1
    return _times(shift, first) ^ second


def document_checksums(blocks: DataFrame) -> DataFrame:
    """One row per document, read from the blocks: doc_id, start, n_tokens, ids_crc32.

    Pieces of a document are checked where they are decoded; their checksums are joined, so no shuffle carries ids.
    """

    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(x) for x in ids], dtype="int64")

    def join(pieces: pd.Series) -> pd.Series:
        out = []
        for own in pieces:
            total = int(own[0]["crc"])
            for piece in own[1:]:
                total = joined_crc32(total, int(piece["crc"]), 4 * int(piece["n_ids"]))
            out.append(total)
        return pd.Series(out, dtype="int64")

    crc_of, join_of = (F.pandas_udf(f, "bigint", F.PandasUDFType.SCALAR) for f in (crc, join))
    pieces = read_blocks(blocks).select("shard", "document", "doc_id", "position", "n_ids", crc_of("ids").alias("crc"))
    whole = pieces.groupBy("shard", "document").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("position").alias("position"),
        F.sum("n_ids").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("position", "n_ids", "crc"))).alias("pieces"),
    )
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = sizes.select(F.col("shard").alias("_s"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    one = F.size("pieces") == 1
    summed = whole.withColumn("ids_crc32", F.when(one, F.col("pieces")[0]["crc"]).otherwise(join_of("pieces")))
    return summed.join(bases, F.col("shard") == F.col("_s")).select(
        "doc_id", (F.col("base") + F.col("position")).alias("start"), "n_tokens", "ids_crc32"
    )
