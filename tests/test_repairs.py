"""Cases that once lost rows or fields."""

import warnings

import pytest

from schemaloom import workspace
from schemaloom.operators import lineage, plan, tables, vault
from schemaloom.sources import lineage_edges, notifications, policies, registry
from schemaloom.workspace import stored


def test_links_that_differ_in_a_separator_are_two(spark):
    df = spark.createDataFrame([("a||b", "c"), ("a", "b||c"), ("A ", "b||c"), ("", "x"), (None, "x")], "a string, b string")
    assert vault.load_link(df, ["a", "b"], "s").count() == 3
    assert df.select(vault.hash_key("a", "b").alias("h")).distinct().count() == 4


def test_satellite_sees_a_moved_separator_and_a_null(spark):
    rows = [(1, 1, "a||b", "c"), (1, 2, "a", "b||c"), (1, 3, "a", None), (1, 4, "a", "")]
    df = spark.createDataFrame(rows, "k bigint, o bigint, a string, b string")
    assert vault.load_satellite(df, "k", ["a", "b"], "o", "s").count() == 4


def test_every_decodable_edge_is_kept(spark, tmp_path):
    file = tmp_path / "edges.jsonl"
    file.write_text(
        '{"upstream_id":"a","metadata":"text","via_attributes":["x"]}\n'
        '{"upstream_id":"b","metadata":{"n":1,"m":{"k":[1]}},"via_attributes":"y"}\n'
        '{"upstream_id":"c","metadata":[1,2],"via_attributes":[1,"z"]}\n  \nbroken\n[1]\n'
        '{"upstream_id":7,"metadata":null}\n'
    )
    rows = {r.upstream_id: (r.via_attributes, r.metadata) for r in lineage_edges.read_edges_jsonl(spark, str(file)).collect()}
    assert rows == {
        "a": (["x"], {"value": "text"}),
        "b": (["y"], {"n": "1", "m": '{"k":[1]}'}),
        "c": (["1", "z"], {"value": "[1,2]"}),
        "7": ([], {}),
    }


def test_texts_of_numbers_are_kept_and_others_rejected(spark):
    head = '{"event_type":"schema.notification","dataset":{"id":"d"},"ingestion":{"observed_at":"t"},'
    values = [
        head + '"previous_schema_version":"3","header":{"attributes":[{"name":"a","nullable":"yes"},null]}}',
        head + '"previous_schema_version":3,"header":{"attributes":[{"name":"a","nullable":false}]}}',
        head + '"previous_schema_version":"three","header":{"attributes":[]}}',
        head + '"header":{"attributes":[{"name":"a","nullable":"perhaps"}]}}',
    ]
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, value string")
    rows = notifications.parse(notifications.validate(df)).orderBy("n").collect()
    assert [r.error for r in rows] == [None, None, "Wrongly typed field", "Wrongly typed field"]
    assert [(r.previous_schema_version, r.header.attributes[0].nullable) for r in rows[:2]] == [(3, True), (3, False)]


def test_unusable_policy_files_warn(tmp_path):
    with pytest.warns(UserWarning, match="cannot be used"):
        assert policies.read_config("hdfs://nowhere.invalid:1/p.yaml") is policies.FALLBACK_POLICIES
    (tmp_path / "p.yaml").write_text("a: [1\n")
    with pytest.warns(UserWarning, match="not YAML"):
        assert policies.read_config(str(tmp_path / "p.yaml")) is policies.FALLBACK_POLICIES
    (tmp_path / "q.yaml").write_text("team:\n  allow_drop: true\n  max_impacted_total: ' 5 '\n")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        config = policies.read_config(f"file:{tmp_path}/q.yaml")
    assert policies.policy_row("team", config["team"])[8] == 5


@pytest.mark.parametrize("value,cap", [(None, None), ("", None), (False, None), (True, 1), (0, 0), ("7", 7), ("x", None), (2.9, 2), ([1], None)])
def test_caps(value, cap):
    assert policies._cap(value) == cap


def test_many_policies(spark):
    config = {"default": {}, **{f"p{n}": {"allow_drop": True} for n in range(20_000)}}
    df = spark.range(300).selectExpr("id", "CASE WHEN id % 3 = 0 THEN concat('p', id) WHEN id % 3 = 1 THEN 'unknown' END AS requested_policy")
    rows = policies.select_policy(df, config).collect()
    assert len(rows) == 300
    for r in rows:
        assert r.policy.policy_name == (f"p{r.id}" if r.id % 3 == 0 else "default") and r.policy.allow_drop == (r.id % 3 == 0)


def test_a_real_plan_is_applied(spark):
    atoms = "array(named_struct('kind','ADD_COLUMN','attribute','n','from_type',CAST(NULL AS STRING),'to_type','string'))"
    one = spark.range(1).selectExpr("'d' AS dataset_id", f"{atoms} AS atoms", "array('NEW_HUB') AS obligations")
    rows = plan.explode_operations(plan.build_plan(one), "dataset_id").orderBy("op_seq").collect()
    assert {r.layer for r in rows} == {"lake", "vault"}
    out, statuses = tables.apply_operations(spark.range(2), rows)
    assert out.columns == ["id", "n"] and statuses == [tables.STATUS_OK]


def test_work_folder_is_removed(spark):
    kept = workspace.written(spark.range(3), "test")
    assert kept.count() == 3 and workspace.exists(spark, workspace.work_folder(spark))
    folder = workspace.new_folder(spark, "one")
    spark.range(1).write.parquet(folder)
    workspace.remove(spark, folder)
    assert not workspace.exists(spark, folder)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_split_parses_a_message_once(spark):
    values = spark.createDataFrame([(1, '{"a":1}'), (2, "x")], "offset bigint, value string")
    valid, rejected = notifications.split_valid(notifications.validate(values))
    assert [_plan(df).lower().count("parsejson") for df in (valid, rejected)] == [1, 1]
    assert valid.count() == 0 and rejected.count() == 2


def test_lineage_walk_broadcasts_nothing(spark, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df)
        return stored(df)

    monkeypatch.setattr(lineage, "stored", seen)
    requests = spark.createDataFrame([("r", "a", [])], "req_id string, dataset_id string, changed array<string>")
    edges = spark.createDataFrame(
        [("a", "b", "lake_table", []), ("b", "c", "job", []), ("c", "a", "job", [])],
        "upstream_id string, downstream_id string, downstream_type string, via_attributes array<string>",
    )
    hits, reached = lineage.walk(requests, edges)
    assert {r.node for r in reached.collect()} == {"a", "b", "c"} and hits.count() == 3
    found = [df._jdf.queryExecution().executedPlan().toString() for df in [*plans, hits, reached]]
    assert not any("Broadcast" in p for p in found)


def test_upsert_of_fixed_width_rows_sorts_nothing(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", None, 7), ("c", 1, None)], "plan_id string, status int, stored_at int")
    new = spark.createDataFrame([("a", None, 6), ("b", 2, 6)], "plan_id string, status int, stored_at int")
    out = registry.upsert(old, new)
    assert {tuple(r) for r in out.collect()} == {("a", None, 6), ("b", None, 7), ("c", None, None)}
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_links_are_made_distinct_once(spark):
    df = spark.createDataFrame([(1, "a "), (1, "A"), (2, "a"), (2, None)], "k bigint, t string")
    known = vault.load_link(df.where("k = 2"), ["k", "t"], "s")
    out = vault.load_link(df, ["k", "t"], "s", known)
    (row,) = out.collect()
    expected = spark.createDataFrame([(1, "A")], "k bigint, t string").select(vault.hash_key("k", "t"), vault.hash_key("k"), vault.hash_key("t")).head()
    assert (row.link_hash, row.k_hash, row.t_hash) == tuple(expected)
    assert vault.load_link(df, ["k", "t"], "s")._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
