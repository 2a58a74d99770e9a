"""Hard-negative mining with Kronecker-packed products.

Components become whole numbers. Several candidates' components are biased to be non-negative and put into separated
fields of one wide integer; one multiplication by an anchor's (also biased) component then multiplies all of
them, the sums of the fields never run into each other, and what the biases add is known and taken off. So one
matrix product over packed words gives the exact scores of several candidates per word.

Anchors are a stated query set: blocks of anchors meet blocks of rows, each block in one row of a table, and
only the best few of each meeting go on.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.workspace import written

#: Whole numbers up to this many bits are exact in a double, the word that a matrix product multiplies fastest.
WORD = 53
#: Rows of a candidate block and anchors of an anchor block, about.
ROWS, ANCHORS = 8192, 256
#: No score is larger than this: vectors that could have a larger one with themselves take no part.
LONGEST = 1 << 62
#: An id that is null sorts after all others.
_NO_ID = np.iinfo(np.int64).max


def packed_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products (anchors x rows) of integer-valued matrices of doubles.

    Fields are as wide as the largest sum of this block needs; as many as fit into a word share one. Where not even one
    fits, Python's own integers are multiplied (an array of objects).
    """
    n, dims = rows.shape
    if not n or not len(anchors) or not dims:
        return np.zeros((len(anchors), n), np.int64)
    low_a, low_r = anchors.min(), rows.min()
    most = dims * int(anchors.max() - low_a) * int(rows.max() - low_r)
    width = max(1, most.bit_length())
    if width > WORD or dims * int(np.abs(anchors).max()) * int(np.abs(rows).max()) >= 1 << 60:
        whole = [[int(x) for x in r] for r in rows]
        return np.array([[sum(map(int.__mul__, map(int, a), r)) for r in whole] for a in anchors], object)
    fields = WORD // width
    biased = np.zeros((-(-n // fields) * fields, dims))
    biased[:n] = rows - low_r
    words = biased.reshape(-1, fields, dims)
    packed = sum(words[:, k] * float(1 << (k * width)) for k in range(fields))
    product = ((anchors - low_a) @ packed.T).astype(np.int64)
    parts = [(product >> (k * width)) & ((1 << width) - 1) for k in range(fields)]
    raw = np.stack(parts, -1).reshape(len(anchors), -1)[:, :n]
    # sum (a - la)(r - lr) = sum a r - lr sum a - la sum r + n la lr
    la, lr = int(low_a), int(low_r)
    return raw + lr * anchors.sum(1).astype(np.int64)[:, None] + la * rows.sum(1).astype(np.int64)[None, :] - dims * la * lr


def best(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` highest scores, ties by smaller id, in that order."""
    if len(scores) > most:
        least = np.sort(scores)[-most] if scores.dtype == object else np.partition(scores, len(scores) - most)[len(scores) - most]
        some = np.nonzero(scores >= least)[0]
    else:
        some = np.arange(len(scores))
    order = sorted(some.tolist(), key=lambda k: (-int(scores[k]), int(ids[k]))) if len(some) <= 64 or scores.dtype == object else some[np.lexsort((ids[some], -scores[some]))].tolist()
    return np.array(order[:most], np.int64)


def prepared(rows: DataFrame, *, id_column: str, label: Column, vector: str, scale: float) -> DataFrame:
    """(row, vec_id, label, dims, q): rows that take part; ``q`` are the bytes of floor(scale * x) as doubles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vec_id, own, vector in zip(batch["vec_id"], batch["label"], batch["vector"]):
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(scale * np.array(vector, np.float64))
                if (np.abs(q) <= math.sqrt(LONGEST / max(len(q), 1))).all():
                    out.append((vec_id, own, len(q), (q + 0.0).tobytes()))
            yield pd.DataFrame(out, columns=["vec_id", "label", "dims", "q"])

    named = rows.select(F.col(f"`{id_column}`").cast("string").alias("vec_id"), label.cast("bigint").alias("label"), F.col(f"`{vector}`").alias("vector"))
    whole = named.where("label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)")
    found = whole.mapInPandas(run, "vec_id string, label bigint, dims int, q binary")
    return written(found.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"), "label", "dims", "q"), "vectors")


_BLOCK = "block bigint, dims int, rows binary, ids binary, labels binary, q binary"


def _blocks(rows: DataFrame, size: int, more: str = "") -> DataFrame:
    """About ``size`` rows of one length in one row each, dealt by a hash; ``more``: a binary column that goes along, joined."""
    counts = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / size).alias("blocks"))
    dealt = rows.join(counts, "dims").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")))

    def pack(own: pd.DataFrame) -> pd.DataFrame:
        ids = [_NO_ID if x is None else int(x) for x in own["vec_id"]]
        columns = {
            "block": [int(own["block"].iloc[0])], "dims": [int(own["dims"].iloc[0])], "rows": [own["row"].to_numpy("<i8").tobytes()],
            "ids": [np.array(ids, "<i8").tobytes()], "labels": [own["label"].to_numpy("<i8").tobytes()], "q": [b"".join(own["q"])],
        }
        if more:
            columns |= {more: [b"".join(own[more])]}
        return pd.DataFrame(columns)

    wide = dealt.select("block", "dims", "row", F.col("vec_id").cast("string").alias("vec_id"), "label", "q", *([more] if more else []))
    return wide.groupBy("dims", "block").applyInPandas(pack, _BLOCK + (f", {more} binary" if more else ""))


def _met(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block of anchors beside every block of rows of the same length. Anchors, the small side, go to all blocks."""
    counts = blocks.groupBy("dims").agg(F.max("block").alias("_last")).withColumnRenamed("dims", "_dims")
    own = anchors.withColumnsRenamed({c: f"a_{c}" for c in anchors.columns})
    sent = own.join(counts, F.col("a_dims") == F.col("_dims")).withColumn("_to", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))))
    return sent.join(blocks, (F.col("a_dims") == F.col("dims")) & (F.col("_to") == F.col("block"))).drop("_dims", "_last", "_to")


def _read(batch: pd.DataFrame, at: int, prefix: str = "") -> tuple[np.ndarray, ...]:
    rows, ids, labels = (np.frombuffer(batch[f"{prefix}{c}"].iloc[at], "<i8") for c in ("rows", "ids", "labels"))
    return rows, ids, labels, np.frombuffer(batch[f"{prefix}q"].iloc[at], "<f8").reshape(len(rows), -1)


_FOUND = "anchor bigint, which int, id bigint, score bigint"


def _frame(out: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in _FOUND.split(", ")]
    rows = [(a, w, None if i == _NO_ID else int(i), int(s)) for a, w, i, s in out]
    return pd.DataFrame(rows, columns=names).astype({"anchor": "int64", "which": "int32", "id": "Int64", "score": "int64"})


def _first(found: DataFrame, most: int, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mine(
    rows: DataFrame,
    *,
    label: Column,
    anchor: Column,
    id_column: str = "vec_id",
    vector: str = "embedding",
    scale: float = 256.0,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A row's score is its integer inner product with the anchor after each component became floor(``scale`` * x). An anchor's
    positives are its best other rows of its label; each positive's negatives are the best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score. Ties go to the smaller id.

    ``label`` and ``anchor`` are expressions over ``rows`` and over (vec_id, label). Rows with a null label, a null vector,
    or a component that is null, or not finite, take no part; nor do components whose products could exceed 62 bits. Null ids come last
    among ties. Vectors of another length than the anchor's are not compared with it. Rows that repeat an id are rows of their
    own. No rows or anchors: no result.

    Scores of a meeting of two blocks stay in its task; its best few per anchor go on, so no label or
    common vector is gathered anywhere.
    """
    taking = prepared(rows, id_column=id_column, label=label, vector=vector, scale=scale)
    blocks = written(_blocks(taking, ROWS), "blocks")
    own = taking.where(anchor)

    def same_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                numbers, ids, labels, q = _read(batch, at)
                a_rows, _, a_labels, a_q = _read(batch, at, "a_")
                scores, out = packed_scores(a_q, q), []
                for k, (row, own) in enumerate(zip(a_rows, a_labels)):
                    some = np.nonzero((labels == own) & (numbers != row))[0]
                    out += [(row, 0, ids[some[j]], scores[k, some[j]]) for j in best(scores[k, some], ids[some], positives)]
                yield _frame(out)

    first = _met(written(_blocks(own, ANCHORS), "anchors"), blocks).mapInPandas(same_label, _FOUND)
    chosen = written(_first(first, positives, "anchor").select("anchor", F.col("rank").alias("which"), "id", "score"), "positives")
    bound = chosen.groupBy("anchor").agg(F.collect_list(F.struct("which", "score")).alias("asked")).withColumnRenamed("anchor", "_row")
    wanted = own.join(bound, F.col("row") == F.col("_row")).withColumn("bounds", _bounds("asked", positives))

    def other_label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                _, ids, labels, q = _read(batch, at)
                a_rows, _, a_labels, a_q = _read(batch, at, "a_")
                asked = np.frombuffer(batch["a_bounds"].iloc[at], ">i8").reshape(len(a_rows), positives, 2)
                scores, out = packed_scores(a_q, q), []
                for k, (row, own) in enumerate(zip(a_rows, a_labels)):
                    other = labels != own
                    for which, positive in asked[k].tolist():
                        # 100 * score >= low * positive and 100 * score <= high * positive, in whole numbers
                        least, top = -(-low * positive // 100), high * positive // 100
                        if which and least <= top:
                            some = np.nonzero(other & (scores[k] >= least) & (scores[k] <= top))[0]
                            out += [(row, which, ids[some[j]], scores[k, some[j]]) for j in best(scores[k, some], ids[some], negatives)]
                yield _frame(out)

    second = _met(written(_blocks(wanted, ANCHORS, "bounds"), "asked"), blocks).mapInPandas(other_label, _FOUND)
    mined = _first(second, negatives, "anchor", "which")
    names = taking.select(F.col("row").alias("_row"), F.col("vec_id").alias("anchor_id"))
    pairs = chosen.select(F.col("anchor").alias("_a"), F.col("which").alias("_w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return (
        mined.join(pairs, (F.col("anchor") == F.col("_a")) & (F.col("which") == F.col("_w")))
        .join(names, F.col("anchor") == F.col("_row"))
        .select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    )


def _bounds(asked: str, positives: int) -> Column:
    """Which positives an anchor has and their scores, as bytes of big-endian numbers: ``positives`` pairs, 0 where there is none."""

    def pair(n: int) -> Column:
        own = F.get(F.sort_array(asked), F.lit(n))
        return F.concat(*[F.to_binary(F.lpad(F.hex(F.coalesce(own[c].cast("bigint"), F.lit(0).cast("bigint"))), 16, "0"), F.lit("hex")) for c in ("which", "score")])

    return F.concat(*[pair(n) for n in range(positives)])
