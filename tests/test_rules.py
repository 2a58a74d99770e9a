"""Hand-written rule tables for the expressions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from schemaloom.functions import headers, identifiers, keys, triage, typenames
from schemaloom.operators import policy, verify
from schemaloom.sources import policies


def evaluate(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", F.expr(expression("x")).alias("y")).orderBy("i").collect()]


def test_canonical_type(spark):
    cases = {
        "text": "string", " VarChar ": "string", "CHARACTER VARYING": "string", "bpchar": "string", "int4": "integer",
        "INT8": "bigint", "double precision": "float", "real": "float", "bool": "boolean",
        "timestamp without time zone": "timestamp", "\ttimestamptz\n": "timestamptz", "timestamp with time zone": "timestamptz",
        "varchar(20)": "varchar(20)", "LONG": "long", "numeric": "numeric", "date": "date", "float4": "float4",
        " int ": "integer", "": None, "  ": None, None: None,
    }
    assert evaluate(spark, list(cases), typenames.canonical_type) == list(cases.values())


def test_type_family(spark):
    cases = {
        "interval": "integer", "point": "integer", "smallint": "integer", "array<int>": "integer", "longtext": "bigint",
        "timestamptz": "timestamp", "time": "string", "uuid": "string", "binary": "string", "date": "date", " DATE ": "date",
        "datetime": "timestamp", "mydate": "date", "decimal(12,2)": "numeric", "Boolean": "boolean", "": "string", None: "string",
    }
    assert evaluate(spark, list(cases), typenames.type_family) == list(cases.values())


@pytest.mark.parametrize(
    "a,b,expected",
    [
        ("int", "bigint", True), ("bigint", "int", False), ("decimal(12,2)", "decimal(10,2)", True), ("varchar(20)", "varchar(5)", True),
        ("bool", "text", True), ("bool", "int", False), ("date", "timestamp", True), ("timestamp", "date", False), ("float", "numeric", True),
        ("numeric", "float", False), ("text", "int", False), ("timestamp", "timestamptz", True),
    ],
)
def test_widening(spark, a, b, expected):
    assert spark.range(1).select(F.expr(typenames.is_widening(f"'{a}'", f"'{b}'")).alias("w")).first().w is expected


def test_physical_identifier(spark):
    cases = {
        "lake.Click-3": "click_3", "a.b.c-d": "b_c_d", 'public."Orders"': "orders", "  plain  ": "plain", None: "", "": "",
        "x." + "y" * 80: "y" * 63,
    }
    assert evaluate(spark, list(cases), identifiers.physical_identifier) == list(cases.values())
    assert evaluate(spark, ["x." + "y" * 80], lambda x: identifiers.physical_identifier(x, rdbms=False)) == ["y" * 80]


def test_identifier_candidates(spark):
    got = evaluate(spark, ["HUB_orders", "lake/raw.sat_x", "hub_", None], identifiers.identifier_candidates)
    assert set(got[0]) == {"hub_orders", "orders"}
    assert set(got[1]) == {"lake/raw.sat_x", "raw.sat_x", "sat_x", "x"}
    assert set(got[2]) == {"hub_"}
    assert got[3] == []


def test_json_text_equals_json_dumps(spark):
    texts = ["plain", "", 'quote " back \\ slash', "tab\tnl\ncr\r\b\f", "é ü", "漢字", "emoji \U0001f600 end", "\x01\x7f", "a'b", None]
    assert evaluate(spark, texts, keys.json_ascii_string) == [json.dumps(t) for t in texts]


def test_idempotency_key_is_the_hash_of_sorted_json(spark):
    payload = {
        "dataset_id": "lake.é", "layer": "lake", "kind": "ADD_COLUMN", "target": "lake.é",
        "params": {"column_name": "c", "logical_type": None},
    }
    params = keys.json_ascii_object(
        {"column_name": keys.json_ascii_string("'c'"), "logical_type": keys.json_ascii_string("cast(NULL AS string)")}
    )
    quoted = [keys.json_ascii_string(f"'{payload[k]}'") for k in ("dataset_id", "layer", "kind", "target")]
    got = spark.range(1).select(F.expr(keys.idempotency_key(*quoted, params)).alias("k")).first().k
    assert got == hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()


def test_header_shapes(spark):
    attrs = '{"attributes":[{"name":"a"}]}'
    cases = [
        (f'{{"header":{attrs}}}', "direct", 1), (f'{{"header":{{"header":{attrs}}}}}', "wrapped_header", 1), (attrs, "latest_is_header", 1),
        ('{"header":{"attributes":5}}', "invalid_shape", None), ('{"header":null,"version":2}', "invalid_shape", None),
        ("{}", "no_latest", None), (None, "no_latest", None), ("[1]", "no_latest", None), ("{bad", "no_latest", None),
        ('{"header":{"attributes":[]}}', "direct", 0),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, latest string")
    rows = headers.header_shape(df, "latest").orderBy("i").collect()
    assert [(r["shape"], None if r.attributes is None else len(r.attributes)) for r in rows] == [c[1:] for c in cases]


def test_duplicate_names_keep_first_place_and_last_value(spark):
    df = spark.sql(
        "SELECT array(named_struct('name','a','logical_type','int','physical_type',null,'type',null,'nullable',true),"
        "named_struct('name','b','logical_type','text','physical_type',null,'type',null,'nullable',true),"
        "named_struct('name','a','logical_type','bigint','physical_type',null,'type',null,'nullable',true)) AS attributes"
    )
    got = df.select(F.expr(headers.signature("attributes")).alias("s")).first().s
    assert [(s.name, s.ctype) for s in got] == [("a", "bigint"), ("b", "string")]


def test_transient(spark):
    df = spark.createDataFrame(
        [(0, "UNAVAILABLE", None), (1, "INTERNAL", "Connection refused"), (2, "INTERNAL", "nope"), (3, None, None)], "i int, c string, m string"
    )
    got = [r.t for r in df.select("i", F.expr(triage.is_transient("c", "m")).alias("t")).orderBy("i").collect()]
    assert got == [True, True, False, False]


GUARD_CASES = [
    # configuration, only_additive, counts, reasons
    ({"impact_mode": False, "max_impacted_total": 0}, False, (1, 0, 0), 0),
    ({"impact_mode": "breaking_only", "max_impacted_total": 0}, True, (1, 0, 0), 0),
    ({"impact_mode": "breaking_only", "max_impacted_total": 0}, False, (1, 0, 0), 1),
    ({"impact_mode": "whatever", "max_impacted_total": "0"}, True, (1, 0, 0), 1),
    ({"impact_mode": "always", "max_impacted_total": ""}, False, (9, 9, 9), 0),
    ({"impact_mode": "always", "max_impacted_total": False}, False, (9, 9, 9), 0),
    ({"impact_mode": "always", "max_impacted_total": "many"}, False, (9, 9, 9), 0),
    ({"impact_mode": "always", "max_impacted_lake_tables": 1, "max_impacted_vault_objects": 1, "max_impacted_transformations": 1}, False, (2, 2, 2), 3),
    ({"impact_mode": "always", "block_on_any_impact": True}, False, (0, 0, 1), 1),
    ({"impact_mode": "always", "block_on_any_impact": True, "max_impacted_total": 0}, False, (0, 0, 1), 1),
    ({"impact_mode": "always", "block_on_any_impact": True}, False, (0, 0, 0), 0),
]


def test_impact_guards(spark):
    config = {f"p{i}": c[0] for i, c in enumerate(GUARD_CASES)}
    rows = [(f"p{i}", c[1], *c[2]) for i, c in enumerate(GUARD_CASES)]
    df = spark.createDataFrame(rows, "requested_policy string, only_additive boolean, impacted_lake bigint, impacted_vault bigint, impacted_transformations bigint")
    df = policies.select_policy(df, config).select("policy_name", F.expr(policy.impact_reasons("policy")).alias("r"))
    got = {r.policy_name: len(r.r) for r in df.collect()}
    assert got == {f"p{i}": c[3] for i, c in enumerate(GUARD_CASES)}


def test_destructive_compatibility_of_drop_is_overridden_by_widening(spark):
    config = {"default": {"allow_drop": True, "allow_change_type": "yes", "compatibility_for_drop": "forward"}}
    atoms = "array(named_struct('kind','DROP_COLUMN','attribute','a','from_type','integer','to_type',cast(null as string)){})"
    change = ", named_struct('kind','CHANGE_TYPE','attribute','b','from_type','{}','to_type','{}')"
    df = spark.range(3).select(
        "id", F.lit(None).cast("string").alias("requested_policy"),
        F.expr(
            f"CASE id WHEN 0 THEN {atoms.format('')} WHEN 1 THEN {atoms.format(change.format('integer', 'bigint'))} "
            f"ELSE {atoms.format(change.format('string', 'integer'))} END"
        ).alias("atoms"),
        *[F.lit(0).cast("bigint").alias(c) for c in policy.IMPACT_COLUMNS],
    )
    out = policy.policy_decision(policies.select_policy(policy.policy_flags(df), config)).orderBy("id").collect()
    assert [(r.decision, r.compatibility) for r in out] == [("allow", "forward"), ("allow", "backward"), ("allow", "forward")]


def test_policy_files(tmp_path):
    good = tmp_path / "p.yaml"
    good.write_text("a: &a\n  allow_drop: true\nb:\n  <<: *a\n  impact_mode: off\n")
    config = policies.read_config(str(good))
    assert config["b"]["allow_drop"] is True
    assert policies.policy_row("b", config["b"])[7] == "off"
    assert policies.read_config(str(tmp_path / "absent.yaml")) is policies.FALLBACK_POLICIES
    (tmp_path / "list.json").write_text("[1]")
    assert policies.read_config(str(tmp_path / "list.json")) is policies.FALLBACK_POLICIES
    assert policies.policy_row("production", policies.FALLBACK_POLICIES["production"])[2] == "none"


def test_unknown_policy_falls_to_default_or_first(spark):
    df = spark.createDataFrame([("x",), ("",), (None,), ("b",)], "requested_policy string")
    names = lambda config: {r.policy_name: r.policy.policy_name for r in policies.select_policy(df, config).collect()}
    assert names({"a": {}, "b": {}}) == {"x": "a", "production": "a", "b": "b"}
    assert names({"a": {}, "default": {}, "b": {}}) == {"x": "default", "production": "default", "b": "b"}


def test_list_text_matches_python(spark):
    names = [["a", "it's"], [], ['q"', "'\""]]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n array<string>")
    got = [r.t for r in df.select("i", F.expr(verify._python_list("n")).alias("t")).orderBy("i").collect()]
    assert got[:2] == [str(n) for n in names[:2]]
