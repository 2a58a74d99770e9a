"""Sources, sinks, ranking and table operators on small inputs."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.operators import execution, plan, tables, vault
from schemaloom.operators.diff import with_atoms
from schemaloom.operators.link_probe import probe_links
from schemaloom.operators.ranking import previous_value, running_index
from schemaloom.sources import evidence, lineage_edges, notifications, outcomes, registry
from schemaloom.types import ATTRIBUTE


def test_bucketed_ranking_equals_windows(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else f"k{i % 7}", i * 3, rnd.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string").repartition(4)
    w = W.partitionBy("k").orderBy("o")
    want = {tuple(r) for r in df.select("k", "o", F.row_number().over(w).cast("bigint"), F.lag("v").over(w)).collect()}
    for bucket in (10, 64, None):
        got = previous_value(running_index(df, ["k"], "o", "n", bucket), ["k"], "o", "v", "p", bucket)
        assert {tuple(r) for r in got.select("k", "o", "n", "p").collect()} == want


def test_edges_skip_bad_lines(spark, tmp_path):
    file = tmp_path / "edges.jsonl"
    file.write_text('{"upstream_id":"a","downstream_id":"b"}\n\n{oops\n{"upstream_id":"b","downstream_id":"c","via_attributes":["x"]}\n')
    rows = lineage_edges.read_edges_jsonl(spark, str(file)).orderBy("upstream_id").collect()
    assert [(r.upstream_id, r.via_attributes, r.metadata) for r in rows] == [("a", [], {}), ("b", ["x"], {})]


def test_notification_files(spark, tmp_path):
    file = tmp_path / "n.jsonl"
    file.write_text('{"event_type":"schema.notification","dataset":{"id":"d"},"header":{"attributes":[{"name":"a","nullable":false}]}}\n')
    r = notifications.read_notifications(spark, str(file)).first()
    assert (r.dataset.id, r.header.attributes[0].name, r.header.attributes[0].nullable) == ("d", "a", False)


def test_versions_continue_and_ids_are_path_safe(spark, tmp_path):
    stored = spark.createDataFrame([("a/b:c", 4)], "dataset_id string, version bigint")
    accepted = spark.createDataFrame([("a/b:c", 10), ("a/b:c", 7), ("new", 1)], "dataset_id string, seq bigint")
    rows = registry.next_versions(accepted, stored)
    assert {tuple(r) for r in rows.select("dataset_id", "seq", "version").collect()} == {("a/b:c", 7, 5), ("a/b:c", 10, 6), ("new", 1, 1)}
    registry.store_versions(rows, str(tmp_path / "v"))
    assert (tmp_path / "v" / "dataset_key=a_b_c").exists()


def test_outcomes_are_split_by_type(spark, tmp_path):
    rows = [("schema.evolved", "d", "{}"), ("schema.evolution.failed", "e", "{}"), ("other", "f", "{}")]
    outcomes.write_outcomes(spark.createDataFrame(rows, "event_type string, key string, value string"), str(tmp_path))
    got = spark.read.json(str(tmp_path / "outcomes"))
    assert {(r.event_type, r.key) for r in got.collect()} == {("schema.evolved", "d"), ("schema.evolution.failed", "e")}


def test_attempt_outcomes(spark):
    rows = [
        ("p", 1, 1, 3), ("p", 1, 2, 1), ("p", 1, 3, 4),  # transient, then success
        ("p", 2, 1, None), ("p", 2, 2, 3), ("p", 2, 3, None),  # exhausted, last answer transient
        ("p", 3, 1, 2),
        ("q", 1, 1, None), ("q", 1, 2, None), ("q", 1, 3, None),  # never answered
        ("r", 1, 1, 0), ("r", 1, 2, 4),
    ]
    log = spark.createDataFrame(rows, "plan_id string, op_seq int, attempt int, status int")
    out = execution.op_outcome(log, max_attempts=3)
    got = {(r.plan_id, r.op_seq): (r.status, r.attempt, r.error_code, r.attempts_used) for r in out.collect()}
    assert got == {
        ("p", 1): (1, 2, None, 2), ("p", 2): (3, 2, None, 3), ("p", 3): (2, 1, None, 1),
        ("q", 1): (4, None, "RETRIES_EXHAUSTED", 3), ("r", 1): (4, 2, None, 2),
    }
    assert {(r.plan_id, r.op_seq) for r in execution.abort_cutoff(out).collect()} == {("p", 1), ("p", 2), ("q", 1), ("r", 1)}
    plans = spark.createDataFrame([("p",), ("q",), ("empty",)], "plan_id string")
    assert {tuple(r) for r in execution.execution_result(plans, out).collect()} == {("p", 2, False), ("q", 1, False), ("empty", 0, True)}


def test_operations_on_a_table(spark):
    df = spark.createDataFrame([(1, "x", 1.5)], "a int, b string, c double")
    ops = [
        ("ADD_COLUMN", {"column_name": "d", "logical_type": "numeric(10,2)"}), ("ADD_COLUMN", {"column_name": "a", "logical_type": "text"}),
        ("CHANGE_TYPE", {"column_name": "a", "to_logical_type": "int8"}), ("DROP_COLUMN", {"column_name": "zz"}),
        ("RENAME_COLUMN", {"column_name": "b", "new_name": "bb"}), ("DROP_COLUMN", {"column_name": "c"}),
        ("CHANGE_TYPE", {"column_name": "gone", "to_logical_type": "text"}), ("DROP_COLUMN", {"column_name": "a"}),
    ]
    out, statuses = tables.apply_operations(df, [{"kind": k, "params": p} for k, p in ops])
    assert statuses == [1, 2, 1, 2, 1, 1, 4]
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [("a", "bigint"), ("bb", "string"), ("d", "decimal(10,2)")]


def test_widening_fails_loudly_and_narrowing_gives_null(spark):
    df = spark.createDataFrame([("12",), ("x",)], "v string")
    assert [r.v for r in tables.change_type(df, "v", "integer").collect()] == [12, None]
    report = tables.lossy_cast_report(df, {"v": "integer"}).first()
    assert (report.lossy_rows, report.total_rows) == (1, 2)


def test_atoms_lead_from_old_to_new_header(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        old, new = ({c: rnd.choice(["integer", "bigint", "string"]) for c in rnd.sample("abcdefgh", rnd.randint(0, 6))} for _ in "12")
        shape = lambda h: [(n, t, None, None, None) for n, t in h.items()]
        rows.append((i, shape(old), shape(new)))
    attrs = f"array<{ATTRIBUTE.simpleString()}>"
    df = with_atoms(spark.createDataFrame(rows, f"i int, prev_attributes {attrs}, attributes {attrs}"))
    for r in df.collect():
        state = {a.name: a.logical_type for a in r.prev_attributes}
        for atom in r.atoms:
            if atom.kind == "DROP_COLUMN":
                assert state.pop(atom.attribute) == atom.from_type
            elif atom.kind == "ADD_COLUMN":
                assert atom.attribute not in state
                state[atom.attribute] = atom.to_type
            else:
                assert state[atom.attribute] == atom.from_type != atom.to_type
                state[atom.attribute] = atom.to_type
        assert state == {a.name: a.logical_type for a in r.attributes}
        assert [k for k in (a.kind == "DROP_COLUMN" for a in r.atoms)] == sorted(a.kind == "DROP_COLUMN" for a in r.atoms)
    same = with_atoms(df.select("i", "prev_attributes", F.col("prev_attributes").alias("attributes")))
    assert same.filter(F.size("atoms") > 0).isEmpty()


def test_satellite_continues_from_stored_rows(spark):
    rows = [("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("m", 4, None), ("m", 5, ""), ("k", 6, "b"), ("k", 7, "a")]
    df = spark.createDataFrame(rows, "key string, o bigint, v string")
    whole = {(r.hub_hash, r.load_seq) for r in vault.load_satellite(df, "key", ["v"], "o", "s").collect()}
    first = vault.load_satellite(df.filter("o <= 3"), "key", ["v"], "o", "s")
    second = vault.load_satellite(df.filter("o > 3"), "key", ["v"], "o", "s", existing=first, bucket=2)
    assert {(r.hub_hash, r.load_seq) for r in first.union(second).collect()} == whole
    assert sorted(s for _, s in whole) == [1, 3, 4, 5, 7]


def test_link_probe_needs_a_unique_parent(spark):
    parent = spark.createDataFrame([(1,), (2,), (3,)], "p_key bigint")
    loose = spark.createDataFrame([(1,), (1,)], "l_key bigint")
    child = spark.createDataFrame([(1, 9), (1, 9), (3, 9)], "c_key bigint, c_other bigint")
    found = probe_links({"parent": parent, "loose": loose, "child": child}, targets=["child"]).collect()
    assert [(r.parent_table, r.key_column, r.distinct_values) for r in found] == [("parent", "c_key", 2)]
    assert probe_links({"parent": parent, "child": child}, fk_filter="nothing").isEmpty()
    with pytest.raises(KeyError):
        probe_links({"parent": parent}, targets=["absent"])


def test_evidence_shows_observed_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    rows = {r.column_name: (r.pos, r.physical_type, r.nullable) for r in evidence.lake_evidence({"t": df}).collect()}
    assert rows == {"a": (0, "int", False), "b": (1, "string", True)}
    nested = evidence.as_lake_tables(evidence.lake_evidence({"t": df})).first()
    assert [a.name for a in nested.attributes] == ["a", "b"]


def test_untyped_columns_are_reported(spark):
    ops = spark.createDataFrame([("ADD_COLUMN", None), ("ADD_COLUMN", "integer"), ("DROP_COLUMN", None)], "kind string, to_type string")
    assert plan.untyped_columns(ops).count() == 1
