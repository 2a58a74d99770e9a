"""Quality rules, toxicity, mixing, decontamination: odd rows, empty tables, brute force, held-out accuracy."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import decontamination, mixing, quality_rules, toxicity
from tests.llm.conftest import SF


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)]


def test_counts_of_whole_texts(odd, some):
    for docs in (odd, some):
        texts = [r.text for r in docs.select("text").collect()]
        for t in texts:
            assert quality_rules.text_counts(t)[:5] == brute_counts(t)


def test_quality_rules_on_odd_and_empty_tables(spark, odd, none):
    labels = spark.createDataFrame([(1, 0, None), (5, None, 1), (None, 0, 0), (7, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, rule int")
    judged = quality_rules.judge(odd, labels)
    assert judged.count() == odd.count()
    assert judged.where("n_words < 50 AND (kept OR NOT base_failed)").count() == 0
    assert quality_rules.judge(none, labels).count() == 0
    assert quality_rules.judge(odd, labels.limit(0)).where("rule IS NOT NULL").count() == 0


def test_learned_list_finds_thresholds():
    draw = np.random.default_rng(1)
    data = {f: draw.random(4000) for f in quality_rules.FEATURES}
    bad = (data["symbols_per_word"] > 0.9) | ((data["upper_share"] > 0.5) & (data["word_length"] <= 0.2))
    rules = quality_rules.learn(data, bad)
    caught = np.zeros(4000, bool)
    for rule in rules:
        caught |= quality_rules._covered(rule, data, np.ones(4000, bool))
    assert (caught & bad).sum() > 0.9 * bad.sum() and (caught & ~bad).sum() < 0.02 * (~bad).sum()


def test_list_is_one_ordered_conditional(spark):
    rules = [(quality_rules.Test("words", True, 10.0),), (quality_rules.Test("words", True, 5.0), quality_rules.Test("upper_share", False, 0.5))]
    rows = spark.createDataFrame([(12, 5, 0), (7, 10, 0), (7, 10, 9), (1, 1, 0)], "n_words int, word_chars int, n_upper int")
    assert [r[0] for r in rows.select(quality_rules.verdict(rules)).collect()] == [1, 2, None, None]


def test_toxicity_learns_and_keeps_clean(spark, odd, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(docs, labels)
    known = toxicity.scored(docs, model).join(labels, "doc_id").where(~toxicity.learning_fold())
    rows = known.select("toxic", (F.col("toxicity") >= 0.5).alias("p")).collect()
    assert sum(r.p == (r.toxic == 1) for r in rows) >= 0.95 * len(rows)
    assert not sum(r.p for r in rows if r.toxic == 0) > 1
    scores = toxicity.scored(odd, model)
    assert scores.columns == [*odd.columns, "toxicity", "toxic_threshold"]
    assert scores.where("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0 and scores.count() == odd.count()
    assert toxicity.scored(none, model).count() == 0
    assert toxicity.accepted(odd, model).columns == odd.columns


def test_toxicity_learns_from_every_row(spark):
    ids = [i for i in range(8000) if zlib.crc32(str(i).encode()) % 5 and zlib.crc32(f"calibrate {i}".encode()) % 5]
    # Each rare word stands in two texts, far apart.
    rows = [(i, f"rare{n % (len(ids) // 2)} {'you idiot' if n % 10 == 0 else 'fine day'}", "en") for n, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(i, int(n % 10 == 0)) for n, i in enumerate(ids)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels, shard_rows=1500)
    words = {toxicity.parts_of(f"rare{n}".encode())[0] for n in range(len(ids) // 2)}
    assert words <= set(model.known.tolist())
    a, b = (toxicity.logits(model, [toxicity.buckets(t)])[0] - model.cut for t in ("you idiot", "fine day"))
    assert a > 0 > b


def test_toxicity_without_labels(spark, odd):
    model = toxicity.fit(odd, spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, toxic int"))
    assert toxicity.scored(odd, model).where("toxicity >= 0.5").count() == 0


def test_score_ignores_other_columns(spark):
    model = toxicity.train([toxicity.buckets(t) for t in ("you idiot", "fine day", "an idiot", "a day") * 5], np.array([1, 0, 1, 0] * 5))
    rows = spark.createDataFrame([(1, "an idiot", "en", "a"), (2, "an idiot", None, "b")], "doc_id bigint, text string, lang string, source string")
    a, b = toxicity.scored(rows, model).collect()
    assert a.toxicity == b.toxicity


def test_mixing_odd_and_empty(odd, none):
    mixed = mixing.mix(odd)
    assert mixed.columns == [*[c for c in odd.columns if c != "mix_size"], "mix_size", "mix_source_size", "mix_target", "mix_repeats"]
    rows = mixed.collect()
    assert len(rows) == odd.count() and all(0 <= r.mix_repeats <= 2 for r in rows)
    by = {r.source: (r.mix_source_size, r.mix_target) for r in rows}
    assert abs(sum(t for _, t in by.values()) - 1.5 * sum(s for s, _ in by.values())) < 1e-6
    assert all(t <= 2 * s + 1e-9 for s, t in by.values())
    assert mixing.mix(none).count() == 0
    assert mixing.repeated(mixed, odd.columns[:5]).count() == sum(r.mix_repeats for r in rows)


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1000, 1], [0, 5, 7, 9], [100], [0, 0], [3, 1, 4, 1, 5, 9, 2, 6]])
def test_water_level_equals_rounds_of_clamping(spark, sizes):
    rows = spark.createDataFrame([(f"s{n}", s) for n, s in enumerate(sizes)], "source string, source_size bigint")
    got = {r.source: r.target for r in mixing.water_fill(rows, (3, 1, 2), 1.5, 2.0).collect()}
    weight, open_, want = [(3, 1, 2)[n % 3] for n in range(len(sizes))], set(range(len(sizes))), {}
    left = 1.5 * sum(sizes)
    while open_:
        total = sum(weight[n] for n in open_)
        full = [n for n in open_ if left * weight[n] / total > 2 * sizes[n]]
        if not full:
            want |= {n: left * weight[n] / total for n in open_}
            break
        for n in full:
            want[n] = 2.0 * sizes[n]
        left, open_ = left - sum(want[n] for n in full), open_ - set(full)
    assert all(abs(got[f"s{n}"] - want[n]) < 1e-6 for n in range(len(sizes)))


def test_mix_comes_near_its_targets(some):
    rows = mixing.mix(some).collect()
    taken, target, longest = collections.Counter(), {}, collections.Counter()
    for r in rows:
        taken[r.source] += r.mix_size * r.mix_repeats
        target[r.source] = r.mix_target
        longest[r.source] = max(longest[r.source], r.mix_size)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in target)


def test_decontamination_odd_and_empty(spark, odd, none):
    items = spark.createDataFrame(
        [(1, "same3 same4 same5"), (2, None), (3, ""), (None, "One two"), (4, " ".join(f"SAME{n}" for n in range(20, 40))), (4, "x"), (5, "missing word")],
        "item_id bigint, text string",
    )
    rows = decontamination.contamination(odd, items).collect()
    assert len(rows) == odd.count()
    whole = [r for r in rows if r.doc_id == 8]
    assert whole[0].n_hit == 23 and whole[0].hit_items == ["1", "4"] and whole[0].contaminated
    assert {r.n_hit for r in rows if r.doc_id in (1, 2, 3, 4)} == {0}
    assert [r.n_hit for r in rows if r.doc_id == 6] == [2]
    assert decontamination.contamination(none, items).count() == 0
    assert decontamination.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontamination.clean(odd, items).columns == odd.columns


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "a x x x x x x b c"), (3, None)], "doc_id bigint, text string")
    terms = spark.createDataFrame([("a",), ("b",), ("c",)], "term string").withColumn("with_near", F.lit(False))
    index = decontamination.postings(docs, terms, 2)
    queries = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "a"), (3, "nowhere")], "query int, term string")
    got = {(r.query, r._id) for r in decontamination.proximity_matches(index, queries, 3).collect()}
    assert got == {(1, 1), (2, 1), (2, 2)}


def test_smallest_tables_exist(spark):
    assert spark.read.parquet(f"{SF}/documents.parquet").count() == 200
