"""Operators on embeddings against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from schemaloom.llm import embedding_dedup, hard_negatives

NAN, INF = float("nan"), float("inf")


def planted(seed=0, dims=24, groups=6, alone=150):
    """Random vectors, copies, near copies around several directions, one large group, and pairs close to the threshold."""
    draw = np.random.default_rng(seed)
    rows = [draw.standard_normal(dims) for _ in range(alone)]
    for g in range(groups):
        middle = draw.standard_normal(dims)
        noise = 0.05 + 0.04 * g
        rows += [middle + noise * draw.standard_normal(dims) for _ in range(20 if g else 150)]
        rows += [middle * 3.0] * 4
    for k in range(60):
        a, b = (x / np.linalg.norm(x) for x in draw.standard_normal((2, dims)))
        b -= (a @ b) * a
        angle = np.arccos(0.95) + (0.002 + 0.0005 * k) * (-1) ** k
        rows += [a, np.cos(angle) * a + np.sin(angle) * b / np.linalg.norm(b)]
    return np.array(rows)


def brute(vectors, ids, cosine=0.95):
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = units @ units.T >= cosine
    np.fill_diagonal(near, False)
    root = np.arange(len(ids))
    for _ in range(len(ids)):
        least = np.array([min([root[k], *root[near[k]]]) for k in range(len(ids))])
        if (least == root).all():
            break
        root = least
    smallest = {r: min(ids[root == r].tolist()) for r in set(root.tolist())}
    return {int(i): (int(near[k].sum()), smallest[root[k]]) for k, i in enumerate(ids)}, near


def test_links_equal_brute_force(spark, monkeypatch):
    vectors = planted()
    ids = np.random.default_rng(1).permutation(len(vectors)) * 3 - 100
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>").repartition(5)
    want, _ = brute(vectors, ids)
    found = {r.id: (r.n_links, r.component) for r in embedding_dedup.linked(df, recall=0.9999).collect()}
    assert found == want


@pytest.mark.parametrize("crowd", [8, 10**9])
def test_pieces_and_crowds_change_nothing(spark, monkeypatch, crowd):
    """Buckets cut into many pieces, with and without crowded directions, give the same rows."""
    vectors = planted(2, dims=16, groups=3, alone=40)
    ids = np.arange(len(vectors))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>")
    monkeypatch.setattr(embedding_dedup, "PIECE", 8)
    monkeypatch.setattr(embedding_dedup, "CROWD", crowd)
    monkeypatch.setattr(embedding_dedup.crowded_directions, "__defaults__", (crowd,))
    found = {r.id: (r.n_links, r.component) for r in embedding_dedup.linked(df, recall=0.9999).collect()}
    assert found == brute(vectors, ids)[0]


def test_crowded_directions_are_within_half_the_angle():
    vectors = planted()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    middles = embedding_dedup.crowded_directions(units, 0.95)
    assert len(middles)
    half = np.cos(np.arccos(0.95) / 2)
    for m in middles:
        inside = units[units @ m >= half]
        assert len(inside) >= embedding_dedup.CROWD
        assert (inside @ inside.T >= 0.95 - 1e-12).all()


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(3)
    a, b = draw.standard_normal((2, 400, 64))
    b[:200] = a[:200] + 0.3 * b[:200]
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    exact, errors = (a * b).sum(1), []
    for seed in range(12):
        value, bound = embedding_dedup.Codes.of(a, seed=seed).estimate(embedding_dedup.Codes.of(b, seed=seed))
        assert (np.abs(value - exact) <= bound).all()
        errors.append(value - exact)
    assert abs(np.mean(errors)) < 0.003
    assert np.std(errors) < 0.1
    records = embedding_dedup.Codes.of(a).records()
    again = embedding_dedup.Codes.read(records, 64)
    assert np.allclose(again.estimate(embedding_dedup.Codes.of(b))[0], embedding_dedup.Codes.of(a).estimate(embedding_dedup.Codes.of(b))[0])


def test_recall_of_blocks_at_the_threshold():
    plan = embedding_dedup.Plan.of(10_000, 0.95, 0.995)
    draw = np.random.default_rng(4)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in draw.standard_normal((2, 3000, 64)))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    shared = (embedding_dedup.block_keys(a, plan) == embedding_dedup.block_keys(b, plan)).any(1)
    assert shared.mean() > 0.985


ODD = [
    (None, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (1, [1.0, 0.01], None), (2, [0.0, 0.0], 2), (3, [1.0, None], 2), (4, [NAN, 1.0], 1),
    (5, None, 1), (6, [], 3), (7, [INF, 1.0], 3), (8, [1.0], 3), (9, [-1.0, 0.0], 3), (10, [1e200, 1e198], 1), (11, [1e-200, 0.0], 1),
    (100, [1.0, 0.0], 1), (100, [1.0, 0.0], 1), (200, [0.9, 0.1], 2), (None, [0.8, 0.1], 2),
]


def odd_vectors(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "vec_id bigint, embedding array<double>, label int, node string, core int").repartition(3)


def test_odd_vectors_link(spark):
    found = sorted(((r.id is None, r.id or 0, r.n_links, r.component, r.kept) for r in embedding_dedup.linked(odd_vectors(spark)).collect()), key=str)
    alone = [(False, k, 0, k, True) for k in (2, 3, 4, 5, 6, 7, 8, 9)]
    group = [(True, 0, 8, 1, False)] * 2 + [(False, 1, 8, 1, True)] * 2 + [(False, k, 8, 1, False) for k in (10, 11, 100, 100, 200)]
    assert found == sorted(alone + group, key=str)
    assert embedding_dedup.linked(odd_vectors(spark).limit(0)).collect() == []


def scores_by_definition(a, r):
    return [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in r] for p in a]


@pytest.mark.parametrize("low, high, dims", [(-256, 255, 64), (-3, 4, 5), (0, 1, 1), (-(1 << 21), 1 << 21, 7), (-(1 << 40), 1 << 40, 3), (5, 5, 4)])
def test_packed_scores_are_exact(low, high, dims):
    draw = np.random.default_rng(5)
    a, r = (draw.integers(low, high, (n, dims), endpoint=True).astype(float) for n in (9, 31))
    a[0], r[0], r[-1] = low, high, low
    assert hard_negatives.packed_scores(a, r).tolist() == scores_by_definition(a, r)


def mined_by_definition(rows):
    taking = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        q = [float(256 * x) for x in vector]
        if all(abs(x) <= 2**30 for x in q):
            taking.append((vec_id, label, [int(np.floor(x)) for x in q]))
    out = []
    for k, (anchor, label, q) in enumerate(taking):
        if anchor is None or anchor % 100:
            continue
        met = [(sum(x * y for x, y in zip(q, p)), i, own == label) for j, (i, own, p) in enumerate(taking) if j != k and len(p) == len(q)]
        met.sort(key=lambda m: (-m[0], m[1] is None, m[1] or 0))
        for score, positive, _ in [m for m in met if m[2]][:5]:
            near = [m for m in met if not m[2] and 80 * score <= 100 * m[0] <= 100 * score][:5]
            out += [(anchor, positive, n, i, score, s) for n, (s, i, _) in enumerate(near, 1)]
    return sorted(out, key=str)


def mined(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, row string, block int").repartition(3)
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = hard_negatives.mine(df, label=label, anchor=F.expr("vec_id % 100 = 0"), **how)
    return sorted((tuple(r[c] for c in names) for r in found.collect()), key=str)


def test_mining_equals_brute_force(spark, monkeypatch):
    draw = np.random.default_rng(6)
    middle = draw.standard_normal((4, 12))
    rows = [(k, (middle[k % 4] + 0.5 * draw.standard_normal(12)).tolist(), int(draw.integers(0, 3))) for k in range(700)]
    rows += [(700 + k, middle[0].tolist(), k % 2) for k in range(60)]  # one common vector
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    assert mined(spark, rows) == mined_by_definition(rows)


def test_odd_vectors_are_mined(spark):
    rows = [*ODD, (300, [3e6, -3e6], 1), (301, [2.9e6, -3e6], 1), (303, [2.8e6, -3e6], 2), (304, [1e30, 1.0], 1), (14, [1.0, 0.0], 5), (400, [], 3), (401, [], 4)]
    rows = [r for r in rows if r[0] not in (10,)]
    assert mined(spark, rows) == mined_by_definition(rows)
    assert mined(spark, rows[:1]) == []
