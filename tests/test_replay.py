"""Replay against a sequential fold, with segments, lineage, initial state and streams."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from schemaloom.operators.lineage import walk, with_request_ids
from schemaloom.operators.replay import replay
from schemaloom.plans import inputs
from schemaloom.plans.catalog import QUERIES
from schemaloom.sources.policies import STANDARD_POLICIES
from schemaloom.streaming.registry_sink import RegistrySink, run_registry
from schemaloom.streaming.replay_stream import log_to_notifications, run_replay
from schemaloom.types import ATTRIBUTE
from schemaloom.workspace import new_folder

TYPES = ["integer", "bigint", "float", "string"]
LAKE = {"lake_table", "view"}


def headers(seed, datasets=3, length=120, stuck=False):
    """dataset, seq, {column: type}, policy, verified; one dataset is far larger than the others."""
    rnd = random.Random(seed)
    rows = []
    for d in range(datasets):
        cols = {"a": 0, "b": 0}
        for k in range(length if d == 0 else length // 10):
            move = rnd.random()
            if move < 0.15:
                cols[rnd.choice("cdefgh")] = 0
            elif move < 0.35:
                c = rnd.choice(list(cols))
                cols[c] = min(cols[c] + 1, 3) if rnd.random() < 0.8 else max(cols[c] - 1, 0)
            elif move < 0.42 and len(cols) > 2:
                cols.pop(rnd.choice(list(cols)))
            if stuck and k == 10:
                cols.pop("a", None)
            policy = "sandbox" if rnd.random() < 0.1 and not stuck else None
            rows.append((f"ds{d}", d * 10_000 + k, {c: TYPES[t] for c, t in cols.items()}, policy, rnd.random() < 0.9))
    return rows


def frame(spark, rows):
    data = [(d, s, [(n, t, None, None, True) for n, t in h.items()], p, v) for d, s, h, p, v in rows]
    return spark.createDataFrame(
        data, f"dataset_id string, seq bigint, attributes array<{ATTRIBUTE.simpleString()}>, requested_policy string, verified boolean"
    ).repartition(5)


def impacted(edges, start, changed):
    seen, queue, hits = {start}, deque([start]), set()
    while queue:
        at = queue.popleft()
        for up, kind, down, via in edges:
            if up == at and (not via or not changed or set(via) & changed):
                if kind in LAKE or kind in ("vault_hub", "job"):
                    hits.add((kind, down))
                if down not in seen:
                    seen.add(down)
                    queue.append(down)
    return hits


def sequential(rows, edges=None, start=None):
    out, state = set(), dict(start or {})
    for d, s, h, p, v in sorted(rows, key=lambda r: (r[0], r[1])):
        prev, seq, version = state.get(d, ({}, None, 0))
        added, dropped = h.keys() - prev.keys(), prev.keys() - h.keys()
        changed = {c for c in h.keys() & prev.keys() if h[c] != prev[c]}
        ok = True
        if p != "sandbox":
            ok = not dropped and all(TYPES.index(h[c]) > TYPES.index(prev[c]) for c in changed)
            if ok and changed and edges is not None:
                ok = not impacted(edges, d, added | changed)
        accepted = ok and v
        out.add((d, s, ok, accepted, seq, version + 1 if accepted else None))
        if accepted:
            state[d] = (h, s, version + 1)
    return out


def results(df):
    return {tuple(r) for r in df.select("dataset_id", "seq", "allowed", "accepted", "previous_seq", "new_version").collect()}


EDGES = [
    ("ds0", "topic", "t1", ["a"]), ("t1", "lake_table", "x", ["a", "c"]), ("x", "topic", "ds0", []), ("ds1", "job", "j", []),
    ("ds0", "topic", "t2", ["d", "e"]), ("t2", "vault_hub", "h", ["e"]), ("h", "view", "v", ["b"]),
]


def edge_frame(spark, edges=EDGES):
    return spark.createDataFrame(edges, "upstream_id string, downstream_type string, downstream_id string, via_attributes array<string>")


@pytest.mark.parametrize("stuck", [False, True])
@pytest.mark.parametrize("segment_rows", [7, 1000])
def test_segments_do_not_change_the_fold(spark, segment_rows, stuck):
    rows = headers(1, stuck=stuck)
    assert results(replay(frame(spark, rows), STANDARD_POLICIES, segment_rows=segment_rows)) == sequential(rows)


@pytest.mark.parametrize("segment_rows", [25, 1000])
def test_lineage_blocks_like_the_fold(spark, segment_rows):
    rows = headers(12)
    got = results(replay(frame(spark, rows), STANDARD_POLICIES, edge_frame(spark), segment_rows=segment_rows))
    want = sequential(rows, EDGES)
    assert got == want
    assert want != sequential(rows)


def test_initial_headers_continue(spark):
    rows = headers(5)
    cut = [r for r in rows if r[1] % 10_000 < 50]
    rest = [r for r in rows if r[1] % 10_000 >= 50]
    last = {}
    for d, s, _, accepted, _, version in sequential(cut):
        if accepted and version > last.get(d, (0, 0))[1]:
            last[d] = (s, version)
    by_seq = {(r[0], r[1]): r[2] for r in rows}
    initial = spark.createDataFrame(
        [(d, [(n, t, None, None, True) for n, t in by_seq[d, s].items()], v) for d, (s, v) in last.items()],
        f"dataset_id string, attributes array<{ATTRIBUTE.simpleString()}>, version bigint",
    )
    want = sequential(rest, start={d: (by_seq[d, s], None, v) for d, (s, v) in last.items()})
    for size in (9, 1000):
        assert results(replay(frame(spark, rest), STANDARD_POLICIES, initial=initial, segment_rows=size)) == want


def test_known_totals_at_small_scale(spark):
    counts = dict(QUERIES["replay_production"](spark, "/root/testdata/sf0.01").groupBy("allowed").count().collect())
    assert counts == {True: 9224, False: 776}


def test_walk_reports_cycles_and_hidden_types(spark):
    asked = [("ds0", ["a"]), ("ds0", ["e"]), ("ds0", []), ("x", ["b"]), ("none", ["a"])]
    requests = with_request_ids(spark.createDataFrame(asked, "dataset_id string, changed array<string>"))
    hits, _ = walk(requests, edge_frame(spark))
    got = {}
    for r in requests.join(hits, "req_id", "left").collect():
        got.setdefault((r.dataset_id, tuple(r.changed)), set())
        if r.artifact_id:
            got[r.dataset_id, tuple(r.changed)].add(r.artifact_id)
    assert got == {(d, tuple(c)): {x for _, x in impacted(EDGES, d, set(c))} for d, c in asked}


def _write_log(spark, path, low, high):
    n = inputs.message_values(spark, "/root/testdata/sf0.001").select(
        F.col("event_id").alias("offset"), "value", (F.col("event_id") % 19 != 0).alias("verified")
    )
    n.filter(F.col("offset").between(low, high)).coalesce(1).write.mode("append").parquet(path)


def _log(spark, path):
    return spark.readStream.schema("offset bigint, value string, verified boolean").option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_restart_and_registry_agree_with_batch(spark):
    path, out, chk, root = (new_folder(spark, n) for n in ("log", "out", "chk", "reg"))
    sink = RegistrySink(root, STANDARD_POLICIES)
    for low, high in ((0, 399), (400, 10_000)):
        _write_log(spark, path, low, high)
        run_replay(log_to_notifications(_log(spark, path)), STANDARD_POLICIES, out, chk)
        run_registry(_log(spark, path), sink, chk + "-registry")
    batch = log_to_notifications(spark.read.parquet(path))
    want = results(replay(batch, STANDARD_POLICIES))
    assert results(spark.read.parquet(out)) == want
    versions = {(r.dataset_id, r.version, r.seq) for r in spark.read.parquet(f"{root}/versions").collect()}
    assert versions == {(d, v, s) for d, s, _, accepted, _, v in want if accepted}
    # a batch that is delivered again leaves the registry as it was
    again = spark.read.parquet(path).filter(F.col("offset") >= 400)
    sink.write(again, 1)
    assert {(r.dataset_id, r.version, r.seq) for r in spark.read.parquet(f"{root}/versions").collect()} == versions
    rejects = {r.error for r in spark.read.parquet(f"{root}/rejects").collect()}
    assert rejects == {
        "Unsupported event_type", "Missing dataset.id", "Missing header.attributes", "Missing ingestion.observed_at",
        "Undecodable message", "Null dataset.id",
    }
    assert spark.read.json(f"{root}/outcomes").count() == len(want)
