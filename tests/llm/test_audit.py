"""The filter interaction audit against its definitions."""

from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from schemaloom.llm import filter_audit


def test_potentials_give_the_mean_over_all_orders():
    draw = np.random.default_rng(0)
    for filters in (1, 2, 3, 5):
        counts = draw.integers(0, 50, 1 << filters)
        sums = np.zeros(filters, np.int64)
        for order in permutations(range(filters)):
            before = 0
            for i in order:
                sums[i] += sum(n for cell, n in enumerate(counts) if cell >> i & 1 and not cell & before)
                before |= 1 << i
        assert filter_audit.shapley_sums(filter_audit.worths(counts)).tolist() == sums.tolist()


def test_potential_of_one_filter_is_its_worth():
    worth = filter_audit.worths(np.array([3, 4]))
    assert filter_audit.potentials(worth).tolist() == [0, 4]


def failing(rows):
    """The five filters by their text, row by row."""
    out = []
    for doc_id, text in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        same = [i for i, t in rows if (t or "") == text and i is not None]
        out.append(fails + "E" * (doc_id is not None and min(same) < doc_id))
    return out


def test_verdicts_of_odd_texts(spark, odd):
    given = [(r.doc_id, r.text) for r in odd.collect()]
    found = filter_audit.verdicts(odd.withColumn("digest", F.lit(1))).collect()
    want = sorted(zip([str(i) for i, _ in given], failing(given)))
    assert sorted((str(r.id), "".join(f for f in "ABCDE" if r[f])) for r in found) == want


def test_audit_by_definition(spark, odd):
    labels = spark.createDataFrame([(5, 1, 0), (8, 1, 1), (8, 0, 0), (9, 1, None), (None, 1, 1), (11, None, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = filter_audit.labelled(filter_audit.verdicts(odd), labels)
    found = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(rows, "ABCDE").collect()}
    given = odd.collect()
    docs = [(r.lang or "", r.doc_id, f) for r, f in zip(given, failing([(r.doc_id, r.text) for r in given]))]
    parts = {p for p, _, _ in docs}
    assert len(found) == 600 * len(parts)
    for (part, order, step), r in found.items():
        filter_, before = order[step - 1], order[: step - 1]
        mine = [(i, f) for p, i, f in docs if p == part]
        removed = [i for i, f in mine if filter_ in f and not set(f) & set(before)]
        assert r.kept == sum(not set(f) & set(before + filter_) for _, f in mine)
        assert r.removed == len(removed)
        assert r.redundant == sum(filter_ in f for _, f in mine) - len(removed)
        assert r.unique_fails == sum(f == filter_ for _, f in mine)
        assert r.good_lost == sum(i in (5, 8, 9) for i in removed)
        assert r.toxic_lost == sum(i in (8, 11) for i in removed)
        assert r.shapley == sum(q.removed for (p, o, s), q in found.items() if p == part and o[s - 1] == filter_)


def test_no_documents_no_labels(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(filter_audit.verdicts(none), labels), "ABCDE").collect() == []
    some = filter_audit.audit(filter_audit.labelled(filter_audit.verdicts(odd), labels), "ABCDE")
    assert some.agg(F.sum("good_lost") + F.sum("toxic_lost")).head()[0] == 0
