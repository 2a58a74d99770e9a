"""Quality rules: decision lists learned from labelled statistics by sequential covering.

Texts are read once, for their statistics. A list of rules, each a conjunction of thresholds on ratios of
these statistics, is learned from a bounded sample of labelled rows; it becomes one Spark expression of ordered
conditions, so its application is a projection and anyone can read it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.workspace import written

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks")

#: What rules may look at: name -> expression of the counts. Texts without words have ratios of 0. All but the
#: last stay the same when a text goes on in the same way, so long texts are not held against themselves.
FEATURES = {
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0D)",
    "repeated_share": "coalesce(try_divide(n_repeat_words, n_words), 0D)",
    "upper_share": "coalesce(try_divide(n_upper, word_chars), 0D)",
    "marks_per_word": "coalesce(try_divide(n_marks, n_words), 0D)",
    "duplicate_lines_per_word": "coalesce(try_divide(n_dup_lines, n_words), 0D)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0D)",
    "words": "CAST(n_words AS DOUBLE)",
}

#: Too short or repetitive texts fail whatever the rules say, so rules learn from the others only.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def text_counts(text: str | None) -> list[int]:
    """The counts of one whole text, in the order of ``COUNTS``; null counts as empty."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    n = len(words)
    if not n:
        return [0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0]
    spaces = len(raw) - len(raw.translate(None, SPACE))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4 and len(number) < n:
        pair = ids[:-1] * len(number) + ids[1:]
        if len(number) > 1 << 20:
            pair = np.unique(pair, return_inverse=True)[1]
        _, place, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        twice = times[place] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
    return [
        n,
        len(text) - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        sum(map(str.isupper, text)) if not text.islower() else 0,
        raw.count(b"!") + raw.count(b"?"),
    ]


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_id, counts ...) for every row: base statistics of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([text_counts(t) for t in batch["text"]], np.int64).reshape(-1, len(COUNTS))
            yield pd.DataFrame({"id": batch["id"], **{c: found[:, k] for k, c in enumerate(COUNTS)}})

    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    counted = rows.mapInPandas(run, "id string, " + ", ".join(f"{c} bigint" for c in COUNTS))
    return counted.withColumn("doc_id", F.col("id").cast("bigint")).select("doc_id", *COUNTS)


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    limit: float

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] > self.limit if self.above else data[self.feature] <= self.limit

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.limit if self.above else value <= self.limit


Rule = tuple[Test, ...]


def _covered(rule: Rule, data: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    for test in rule:
        rows = rows & test.holds(data)
    return rows


def _grow(data: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, cuts: int, longest: int) -> Rule:
    """Add the test of the largest information gain until no good row is covered or nothing gains."""
    rule: Rule = ()
    while len(rule) < longest:
        p, n = int((rows & bad).sum()), int((rows & ~bad).sum())
        if not p or not n:
            break
        before, best, gain = np.log2(p / (p + n)), None, 1e-9
        for feature, values in data.items():
            limits = np.unique(np.quantile(values[rows], np.linspace(0, 1, cuts + 2)[:-1]))
            order = np.argsort(values[rows], kind="stable")
            ranked, flags = values[rows][order], bad[rows][order]
            at = np.searchsorted(ranked, limits, "right")
            low_p = np.concatenate([[0], np.cumsum(flags)])[at]
            for above in (True, False):
                hit_p = p - low_p if above else low_p
                hit_n = (n - (at - low_p)) if above else at - low_p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(hit_p > 0, hit_p * (np.log2(hit_p / (hit_p + hit_n)) - before), 0.0)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    best, gain = Test(feature, above, float(limits[k])), float(gains[k])
        if best is None:
            break
        rule, rows = (*rule, best), rows & best.holds(data)
    return rule


def _prune(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[Rule, float, int]:
    """The beginning of the rule that does best on rows it was not grown on; its precision there and the bad rows it catches."""
    best: tuple = (-2.0, 0, (), 0.0, 0)
    for k in range(1, len(rule) + 1):
        hit = _covered(rule[:k], data, rows)
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        best = max(best, (worth, p, rule[:k], p / max(p + n, 1), p), key=lambda b: b[:2])
    tightest = {}
    for test in best[2]:
        other = tightest.setdefault((test.feature, test.above), test)
        if (test.limit > other.limit) == test.above:
            tightest[test.feature, test.above] = test
    return tuple(tightest.values()), best[3], best[4]


def learn(
    data: dict[str, np.ndarray],
    bad: np.ndarray,
    *,
    seed: int = 0,
    precision: float = 0.95,
    support: int = 3,
    cuts: int = 64,
    longest: int = 4,
    most: int = 32,
) -> list[Rule]:
    """Sequential covering: grow on two thirds of what is left, prune on the rest, keep rules that stay precise.

    Rules catch low quality; what no rule catches is kept. A rule needs ``precision`` on the pruning rows and on all rows that
    are left, and ``support`` bad rows among these. One that fails is set aside with the bad rows that it covers, and
    covering goes on with the others.
    """
    rules: list[Rule] = []
    left, aside, draw = np.ones(len(bad), bool), np.zeros(len(bad), bool), np.random.default_rng(seed)
    while (left & bad & ~aside).any() and len(rules) < most:
        growing = draw.random(len(bad)) < 2 / 3
        rule = _grow(data, bad, left & growing & ~aside, cuts, longest)
        if not rule:
            break
        pruned, right, caught = _prune(rule, data, bad, left & ~growing & ~aside)
        hit = _covered(pruned, data, left)
        hits = int((hit & bad).sum())
        if caught and right >= precision and hits >= max(support, precision * hit.sum()):
            rules.append(pruned)
            left &= ~hit
            continue
        fresh = _covered(rule, data, left & bad & ~aside)
        if not fresh.any():
            break
        aside |= fresh
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, null if none: one ordered Spark conditional."""
    column = F.lit(None).cast("int")
    for n, rule in reversed(list(enumerate(rules, 1))):
        condition = F.lit(True)
        for test in rule:
            condition = condition & test.column()
        column = F.when(condition, n).otherwise(column)
    return column


def fit(counts: DataFrame, labels: DataFrame, *, sample: int = 60_000, seed: int = 0, **how: float) -> list[Rule]:
    """Learn from at most ``sample`` labelled rows that pass the base test, taken in the order of a hash of their ids.

    Only rows of statistics come to the driver (7 numbers and a flag each). Rows without a label, or with null, teach
    nothing; without any labelled row of low quality there are no rules.
    """
    names = list(FEATURES)
    # One label per id: a document that any row calls bad is bad.
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    rows = (
        counts.where(~F.expr(BASE_FAILED))
        .join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", *COUNTS)
        .limit(sample)
        .select(*[F.expr(FEATURES[f]).alias(f) for f in names], (F.col("_quality") == 0).alias("_bad"))
        .toPandas()
    )
    if not len(rows) or not rows["_bad"].any():
        return []
    return learn({f: rows[f].to_numpy(float) for f in names}, rows["_bad"].to_numpy(bool), seed=seed, **how)


def apply_rules(counts: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds ``base_failed, rule, kept``: too short or repetitive texts fail first, then the learned list decides."""
    return counts.withColumns({"base_failed": F.expr(BASE_FAILED), "rule": verdict(rules)}).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", **how: float) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts, base_failed, rule, kept.

    Null texts count as empty: no words, base_failed. Empty tables give no rows; without labels no rule
    is learned and the base alone decides. Extra columns of either table are not looked at.
    """
    counts = written(with_counts(docs, text), "quality")
    return apply_rules(counts, fit(counts, labels, **how))
