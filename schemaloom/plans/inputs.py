"""Inputs derived from the given tables.

The tables hold no schema notifications, so headers, evidence, lineage and attempt logs are
computed from their columns by plain arithmetic. Every row of a table takes part. The same
rules are stated in SQL in ``oracles``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from schemaloom.functions.headers import strip_technical
from schemaloom.functions.keys import correlation_id, plan_id
from schemaloom.functions.text import empty, struct
from schemaloom.operators.barrier import kept
from schemaloom.operators.diff import with_atoms
from schemaloom.operators.plan import build_plan, explode_operations
from schemaloom.operators.policy import policy_decision, policy_flags
from schemaloom.operators.ranking import running_index
from schemaloom.sources.policies import STANDARD_POLICIES, select_policy
from schemaloom.types import ATTRIBUTE

_ATTRS = f"array<{ATTRIBUTE.simpleString()}>"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    """One notification per event; ``n`` is its position within the dataset."""
    events = table(spark, sf, "events").select(
        "event_id",
        "user_id",
        "ts",
        F.concat(F.lit("lake."), "event_type", F.lit("_"), (F.col("user_id") % 20).cast("string")).alias("dataset_id"),
    )
    return running_index(events, ["dataset_id"], "event_id", "n")


_LEVEL = "floor((n + _i * 3) / 40)"
_NARROWED = "(event_id % 31 = 0 AND _i = 1)"
_ATTRIBUTE = struct(
    name="concat('col_', cast(_i AS string))",
    logical_type=f"""CASE WHEN {_NARROWED} THEN 'int'
      WHEN {_LEVEL} <= 0 THEN CASE WHEN event_id % 2 = 0 THEN 'int4' ELSE 'INTEGER' END
      WHEN {_LEVEL} = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'int8' ELSE 'bigint' END
      WHEN {_LEVEL} = 2 THEN 'double precision'
      ELSE CASE WHEN event_id % 3 = 0 THEN 'varchar' ELSE 'text' END END""",
    physical_type=f"""CASE WHEN (event_id + _i) % 23 = 0 THEN NULL
      WHEN {_NARROWED} OR {_LEVEL} <= 0 THEN 'integer'
      WHEN {_LEVEL} = 1 THEN 'bigint' WHEN {_LEVEL} = 2 THEN 'float' ELSE 'string' END""",
    type="cast(NULL AS string)",
    nullable="_i > 0",
)
_SLOTS = "filter(sequence(0, 7), _i -> _i < 3 + least(floor(n / 15), 5) AND NOT (event_id % 17 = 0 AND _i = 2))"
_TECHNICAL = struct(
    name="'ingestion_timestamp'", logical_type="'timestamp'", physical_type="cast(NULL AS string)",
    type="cast(NULL AS string)", nullable="true",
)


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    """base plus header and envelope fields; columns appear, widen, narrow and vanish over n."""
    raw = (
        f"concat(transform({_SLOTS}, _i -> {_ATTRIBUTE}), "
        f"CASE WHEN event_id % 5 = 0 THEN array({_TECHNICAL}) ELSE cast(array() AS {_ATTRS}) END)"
    )
    return (
        base(spark, sf)
        .selectExpr(
            "event_id",
            "user_id",
            "dataset_id",
            "n",
            "event_id AS seq",
            f"cast({raw} AS {_ATTRS}) AS raw_attributes",
            "concat('src_', cast(user_id % 3 AS string)) AS source",
            """date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'") AS observed_at""",
            "CASE WHEN event_id % 6 = 0 THEN n END AS producer_version",
            "CASE event_id % 4 WHEN 0 THEN 'sandbox' WHEN 1 THEN concat('team_', cast(event_id % 7 AS string)) END"
            " AS requested_policy",
            "event_id % 19 <> 0 AS verified",
        )
        .withColumn("attributes", F.expr(strip_technical("raw_attributes")))
    )


def with_previous(notifs: DataFrame) -> DataFrame:
    """Add the attributes of the notification before, by an equi-join on (dataset, n)."""
    prev = notifs.select("dataset_id", (F.col("n") + 1).alias("n"), F.col("attributes").alias("prev_attributes"))
    return notifs.join(prev, ["dataset_id", "n"], "left")


def diffed(spark: SparkSession, sf: str) -> DataFrame:
    return with_atoms(with_previous(notifications(spark, sf)))


def without_impact(df: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return df.withColumns(
        {"impacted_lake": zero, "impacted_vault": zero, "impacted_transformations": zero}
    )


def decided(spark: SparkSession, sf: str, forced_policy: str | None = None, config=None) -> DataFrame:
    """Policy outcome of each notification against the one before it, without lineage."""
    df = policy_flags(diffed(spark, sf))
    if forced_policy:
        df = df.withColumn("requested_policy", F.lit(forced_policy))
    return policy_decision(without_impact(select_policy(df, config or STANDARD_POLICIES)))


def planned(spark: SparkSession, sf: str, outcomes: DataFrame | None = None) -> DataFrame:
    """Plans of the allowed notifications; ``outcomes``: rows of ``decided``, if they are at hand."""
    df = build_plan(kept(decided(spark, sf) if outcomes is None else outcomes, F.col("decision") == "allow"))
    return df.withColumns(
        {
            "correlation_id": F.expr(correlation_id("dataset_id", "seq")),
            "plan_id": F.expr(plan_id("dataset_id", "seq")),
        }
    )


def operations(spark: SparkSession, sf: str) -> DataFrame:
    return explode_operations(planned(spark, sf), "event_id", "plan_id", "correlation_id")


_TAIL = "substr(dataset_id, 6)"
_SLOT = "cast(substr(_a.name, 5) AS int)"
_NO_TEXT = "cast(NULL AS string)"


def with_evidence(df: DataFrame) -> DataFrame:
    """Add lake_tables, vault_structures and successful, off the header in various ways."""
    seen = struct(
        name="CASE WHEN event_id % 3 = 0 THEN upper(_a.name) ELSE _a.name END",
        logical_type=_NO_TEXT,
        physical_type=f"CASE WHEN (event_id * 7 + {_SLOT}) % 97 = 0 THEN 'json' ELSE coalesce(_a.physical_type, _a.logical_type) END",
        type=_NO_TEXT,
        nullable=f"CASE WHEN (event_id + {_SLOT}) % 61 = 0 THEN NOT _a.nullable ELSE _a.nullable END",
    )
    extra = struct(name="'extra_col'", logical_type=_NO_TEXT, physical_type="'text'", type=_NO_TEXT, nullable="true")
    none = f"cast(array() AS {_ATTRS})"
    columns = (
        f"concat(transform(filter(attributes, _a -> (event_id + {_SLOT}) % 53 <> 0), _a -> {seen}), "
        f"CASE WHEN event_id % 41 = 0 THEN array({extra}) ELSE {none} END)"
    )

    def tables(**named):
        return "array(" + ", ".join(struct(name=n, attributes=a) for n, a in named.values()) + ")"

    other = ("'other_a'", none)
    lake = f"""CASE WHEN event_id % 43 = 0 THEN NULL WHEN event_id % 47 = 0 THEN array()
      WHEN event_id % 59 = 0 THEN {tables(a=("'other_a'", "_seen"), b=("'other_b'", none))}
      WHEN event_id % 4 = 0 THEN {tables(a=("dataset_id", "_seen"))}
      WHEN event_id % 4 = 1 THEN {tables(a=other, b=(f"concat('HUB_', upper({_TAIL}))", "_seen"))}
      WHEN event_id % 4 = 2 THEN {tables(a=("'only_one'", "_seen"))}
      ELSE {tables(a=other, b=(f"concat('public.\"', {_TAIL}, '\"')", "_seen"))} END"""
    structure = struct(
        hub=f"CASE WHEN event_id % 19 = 0 THEN 'hub_other' ELSE concat('hub_', {_TAIL}) END",
        links=f"CASE WHEN event_id % 23 = 0 THEN {empty()} ELSE array('link_orders_parts') END",
        satellites=f"CASE WHEN event_id % 3 = 0 THEN array(concat('sat_', {_TAIL})) ELSE {empty()} END",
    )
    vault = f"CASE WHEN event_id % 67 = 0 THEN NULL WHEN event_id % 71 = 0 THEN array() ELSE array({structure}) END"
    vault_type = "array<struct<hub:string,links:array<string>,satellites:array<string>>>"
    return (
        df.withColumn("_seen", F.expr(f"cast({columns} AS {_ATTRS})"))
        .withColumns(
            {
                "lake_tables": F.expr(f"cast({lake} AS array<struct<name:string,attributes:{_ATTRS}>>)"),
                "vault_structures": F.expr(f"cast({vault} AS {vault_type})"),
                "successful": F.expr("event_id % 29 <> 0"),
            }
        )
        .drop("_seen")
    )


def message_values(spark: SparkSession, sf: str) -> DataFrame:
    """Notifications as JSON texts (event_id, value); some break one of the input rules."""
    ev = F.col("event_id")
    kind = ev % 101
    quote = '"'

    def text(c):
        return F.concat(F.lit(quote), c, F.lit(quote))

    df = notifications(spark, sf)
    event_type = F.when(kind == 0, "schema.other").otherwise("schema.notification")
    dataset = (
        F.when(kind == 1, F.concat(F.lit('{"source":'), text(F.col("source")), F.lit("}")))
        .when(kind == 4, F.lit('{"id":null}'))
        .otherwise(F.concat(F.lit('{"id":'), text(F.col("dataset_id")), F.lit(',"source":'), text(F.col("source")), F.lit("}")))
    )
    header = F.when(kind == 2, '{"primary_key":["col_0"]}').otherwise(
        F.concat(F.lit('{"attributes":'), F.to_json("raw_attributes"), F.lit(',"primary_key":["col_0"]}'))
    )
    ingestion = F.when(kind == 3, "{}").otherwise(
        F.concat(F.lit('{"observed_at":'), text(F.col("observed_at")), F.lit("}"))
    )
    version = F.coalesce(F.col("producer_version").cast("string"), F.lit("null"))
    metadata = F.when(F.col("requested_policy").isNull(), "null").otherwise(
        F.concat(F.lit('{"policy":'), text(F.col("requested_policy")), F.lit("}"))
    )
    value = F.concat(
        F.lit('{"event_type":'), text(event_type),
        F.when(kind == 5, "").otherwise(F.concat(F.lit(',"dataset":'), dataset)),
        F.lit(',"header":'), header,
        F.lit(',"ingestion":'), ingestion,
        F.lit(',"previous_schema_version":'), version,
        F.lit(',"metadata":'), metadata,
        F.when(kind == 6, "").otherwise("}"),
    )
    return df.select("event_id", "dataset_id", value.alias("value"))


# One part in this many hangs directly below a dataset, so that what is reached grows with the table.
ENTRY_EVERY = 20


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """A tree over the parts, back edges that close cycles, and entry edges from the datasets."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("z"))

    def obj(c):
        return F.concat(F.lit("obj_"), c.cast("bigint").cast("string"))

    kinds = ["click", "error", "purchase", "signup", "view"]
    which = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.floor(F.col("p") / ENTRY_EVERY) % 5 + 1).cast("int"))
    root = F.concat(F.lit("lake."), which, F.lit("_"), (F.floor(F.col("p") / (5 * ENTRY_EVERY)) % 20).cast("bigint").cast("string"))
    p = F.col("p")
    ends = F.array_compact(
        F.array(
            F.when(p >= 1, F.struct(obj(F.floor(p / 3)).alias("up"), obj(p).alias("down"))),
            F.when((p > 0) & (p % 50 == 0), F.struct(obj(p).alias("up"), obj(F.floor(p / 9)).alias("down"))),
            F.when((p > 0) & (p % ENTRY_EVERY == 1), F.struct(root.alias("up"), obj(p).alias("down"))),
        )
    )
    types = ["lake_table", "lake_view", "TABLE", "vault_hub", "vault_link", "vault_satellite", "job", "report", "dashboard", "topic"]
    kind = F.element_at(F.array(*[F.lit(t) for t in types]), (p % 10 + 1).cast("int"))
    via = F.when(p % 3 == 0, F.lit(None)).otherwise(
        F.array(
            F.concat(F.lit("col_"), (p % 8).cast("string")), F.concat(F.lit("col_"), (F.col("z") % 8).cast("string"))
        )
    )
    return part.select(F.explode(ends).alias("e"), kind.alias("downstream_type"), via.alias("via_attributes")).select(
        F.lit("dataset").alias("upstream_type"),
        F.col("e.up").alias("upstream_id"),
        "downstream_type",
        F.col("e.down").alias("downstream_id"),
        F.coalesce("via_attributes", F.array().cast("array<string>")).alias("via_attributes"),
    )


ATTEMPTS = 5


def plan_orders(spark: SparkSession, sf: str) -> DataFrame:
    """One plan per customer, one operation per order."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("plan_no"), "o_orderkey")
    return running_index(orders, ["plan_no"], "o_orderkey", "op_seq")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempt log of those operations; a null status is an attempt that raised."""
    k = (F.col("o_orderkey") * 7 + F.col("attempt") * 13 + F.col("op_seq") * F.col("attempt")) % 10
    status = (
        F.when(k <= 4, 1)
        .when(k == 5, 2)
        .when((k == 6) & (F.col("o_orderkey") % 7 == 0), 4)
        .when(k != 9, 3)
    )
    return (
        plan_orders(spark, sf)
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))))
        .withColumn("status", status)
    )
