"""Filter interaction audit: what each filter of a chain removes in every order, from the potentials of a removal game.

A coalition is a set of filters; its worth is the number of documents that at least one of its filters fails. With the worth
of all coalitions known, the documents are not needed again: the step that adds filter i after the filters S removes
``worth(S + i) - worth(S)`` of them. The Hart-Mas-Colell potential is 0 for no filter and

    P(S) = (worth(S) + sum of P(S without i) over i in S) / |S|

so P(all) - P(all without i) is the Shapley value of filter i: the mean of what it removes over all orders.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.workspace import written

COUNTED = ("n", "good", "toxic")

STEP = (
    "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def worths(counts: np.ndarray) -> np.ndarray:
    """Worth of every coalition (bit set) from (..., 2^k) counts of rows by the exact set of filters that they fail."""
    sets = np.arange(counts.shape[-1])
    meets = (sets[:, None] & sets[None, :]) != 0
    return counts @ meets.astype(counts.dtype)


def potentials(worth: np.ndarray) -> np.ndarray:
    """k! times the potential of every coalition of k filters, in whole numbers, from coalitions of one filter less.

    The potential of s filters is a sum of worths over s!, so every division here leaves no rest.
    """
    size = worth.shape[-1]
    filters = size.bit_length() - 1
    scale = factorial(filters)
    found = np.zeros_like(worth)
    for s in sorted(range(1, size), key=int.bit_count):
        below = sum(found[..., s & ~(1 << i)] for i in range(filters) if s >> i & 1)
        found[..., s] = (scale * worth[..., s] + below) // s.bit_count()
    return found


def shapley_sums(worth: np.ndarray) -> np.ndarray:
    """(..., k): what each filter removes, summed over all k! orders: k! times its Shapley value."""
    potential = potentials(worth)
    everything = potential.shape[-1] - 1
    filters = everything.bit_length()
    return np.stack([potential[..., everything] - potential[..., everything & ~(1 << i)] for i in range(filters)], -1)


def steps(part: str, counts: np.ndarray, names: Sequence[str]) -> pd.DataFrame:
    """All orders of one part, step by step; ``counts``: (3, 2^k) rows, good and toxic ones by the filters that they fail."""
    worth = worths(counts)
    everything, total = counts.shape[1] - 1, int(counts[0].sum())
    shapley = shapley_sums(worth[0])
    rows = []
    for order in permutations(range(len(names))):
        label, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good, toxic = (worth[:, after] - worth[:, before]).tolist()
            rows.append((
                part, label, step, total - int(worth[0, after]), removed, int(worth[0, 1 << i]) - removed,
                int(worth[0, everything] - worth[0, everything & ~(1 << i)]), good, toxic, int(shapley[i]),
            ))
            before = after
    return pd.DataFrame(rows, columns=[c.split()[0] for c in STEP.split(", ")])


def audit(judged: DataFrame, names: Sequence[str], *, part: str = "part", good: str = "good", toxic: str = "toxic") -> DataFrame:
    """One row per part, order of the filters and step; see ``STEP``.

    ``judged``: the part (null counts as empty text), one boolean column per name (null: passes), and two
    booleans. Rows are counted by part and the set of filters that they fail, map-side first; only
    these counts, 2^k a part, reach the potentials. A table without rows has no parts.
    """
    cells = 1 << len(names)
    fails = sum((F.coalesce(F.col(f"`{n}`"), F.lit(False)).cast("int") * F.lit(1 << i) for i, n in enumerate(names)), F.lit(0))
    marked = judged.select(
        F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"),
        fails.alias("cell"),
        *[F.coalesce(F.col(f"`{c}`"), F.lit(False)).cast("bigint").alias(n) for c, n in ((good, "good"), (toxic, "toxic"))],
    )
    counted = marked.groupBy("part", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("cell", *COUNTED)).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in zip(batch["part"], batch["cells"]):
                counts = np.zeros((len(COUNTED), cells), np.int64)
                for cell in own:
                    counts[:, cell["cell"]] = [cell[c] for c in COUNTED]
                yield steps(name, counts, names)

    return parts.mapInPandas(run, STEP)


SPACES = "[\\x20\\x09-\\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def verdicts(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """(id, part, A, B, C, D, E): which of five filters each whole text fails; null texts are empty.

    A: under 200 words. B: under half of the words distinct. C: more than 3% of the characters are A-Z. D: holds one of
    ``#$%&*|``. E: a row of a smaller id has this text. A null id is neither smaller nor larger than another, so such rows
    pass E; rows that repeat an id are not smaller than each other.

    Texts are read once. For E, rows without their texts meet the least id of their text's digest; a text that a third of
    all rows share is an ordinary shuffled join, whose hot partition the adaptive skew join splits.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.array_remove(F.split(whole, SPACES), "")
    first = docs.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{part}`").alias("part"),
        words.alias("words"),
        F.length(whole).alias("chars"),
        (F.length(whole) - F.length(F.translate(whole, CAPITALS, ""))).alias("capitals"),
        whole.rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2(whole, 256)).alias("digest"),
    )
    rows = written(
        first.select(
            "id",
            "part",
            "digest",
            (F.size("words") < 200).alias("A"),
            (100 * F.size(F.array_distinct("words")) < 50 * F.size("words")).alias("B"),
            (100 * F.col("capitals").cast("bigint") > 3 * F.col("chars").cast("bigint")).alias("C"),
            "D",
        ),
        "verdicts",
    )
    least = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = rows.join(least.select("digest", "least"), "digest", "left")
    return found.select("id", "part", "A", "B", "C", "D", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("E"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (id, ...) with ``good`` and ``toxic``: whether any label of the id says so. Ids without labels, and null ids, have neither."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    return rows.join(known, F.col("id") == F.col("_id"), "left").drop("_id")
