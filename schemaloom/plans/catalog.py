"""Registered queries: one small program per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from schemaloom.functions import headers as H
from schemaloom.functions import identifiers as ids
from schemaloom.functions import keys, triage
from schemaloom.functions import typenames as tn
from schemaloom.operators import diff, events, execution, lineage, plan, policy, tables, vault, verify
from schemaloom.operators.barrier import kept
from schemaloom.operators.link_probe import probe_links
from schemaloom.operators.replay import replay
from schemaloom.plans import inputs
from schemaloom.sources import evidence, lineage_edges, notifications, policies, registry
from schemaloom.streaming.registry_sink import RegistrySink, run_registry
from schemaloom.streaming.replay_stream import RESULT as STREAM_RESULT
from schemaloom.streaming.replay_stream import log_to_notifications, run_replay
from schemaloom.workspace import new_folder, stored, written

QUERIES = {}


def _plain(df: DataFrame) -> DataFrame:
    """All whole-number columns as bigint, so that results do not depend on literal widths."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else F.col(f.name) for f in df.schema])


def query(fn):
    name = fn.__name__.removeprefix("run_")

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _plain(fn(spark, sf))

    run.__doc__ = fn.__doc__
    run.__name__ = name
    QUERIES[name] = run
    return run


def joined(column, sep: str = ","):
    return F.array_join(column, sep)


# --- sources -----------------------------------------------------------------------------


@query
def notification_scan(spark, sf):
    parsed = notifications.parse(inputs.message_values(spark, sf).select("event_id", "value"))
    a = F.col("header.attributes")
    return parsed.select(
        "event_id",
        "event_type",
        F.col("dataset.id").alias("dataset_id"),
        F.col("dataset.source").alias("source"),
        F.coalesce(F.size(a), F.lit(-1)).alias("attribute_count"),
        joined(F.transform(a, lambda x: x["logical_type"])).alias("logical_types"),
        F.col("ingestion.observed_at").alias("observed_at"),
        "previous_schema_version",
        F.col("metadata")["policy"].alias("requested_policy"),
    )


@query
def notification_validate(spark, sf):
    checked = notifications.validate(inputs.message_values(spark, sf))
    return checked.select("event_id", F.coalesce("error", F.lit("ok")).alias("outcome"))


@query
def notification_rejects(spark, sf):
    checked = notifications.validate(inputs.message_values(spark, sf)).select("dataset_id", "error")
    valid, rejected = notifications.split_valid(stored(checked))
    both = valid.select("dataset_id", F.lit("valid").alias("outcome")).unionByName(
        rejected.select("dataset_id", F.col("error").alias("outcome"))
    )
    return both.groupBy("dataset_id", "outcome").agg(F.count(F.lit(1)).alias("messages"))


@query
def policy_table(spark, sf):
    used = policies.select_policy(inputs.notifications(spark, sf), policies.STANDARD_POLICIES)
    counts = used.groupBy(F.col("policy.policy_name").alias("policy_name")).agg(F.count(F.lit(1)).alias("notifications"))
    table = policies.load_policies(spark)
    return table.join(counts, "policy_name", "left").select(
        "policy_name",
        "allow_drop",
        "change_mode",
        joined("obligations_on_additive").alias("obligations"),
        "compatibility_for_drop",
        "compatibility_for_change_type",
        "compatibility_for_change_type_widening",
        "impact_mode",
        "max_impacted_total",
        F.coalesce("notifications", F.lit(0)).alias("notifications"),
    )


@query
def policy_select(spark, sf):
    df = policies.select_policy(inputs.notifications(spark, sf), policies.STANDARD_POLICIES)
    return df.select(
        "event_id", "policy_name", F.col("policy.policy_name").alias("used_policy"), F.col("policy.allow_drop").alias("allow_drop"),
        F.col("policy.change_mode").alias("change_mode"),
    )


@query
def run_lineage_edges(spark, sf):
    e = lineage_edges.normalize_edges(
        inputs.edges(spark, sf).withColumn("metadata", F.lit(None).cast("map<string,string>"))
    )
    return e.select(
        "upstream_id",
        "downstream_id",
        F.coalesce(lineage_edges.artifact_class(F.col("downstream_type")), F.lit("none")).alias("artifact_class"),
        joined("via_attributes").alias("via"),
        F.size("metadata").alias("metadata_size"),
    )


@query
def lineage_append(spark, sf):
    """Edges appended twice: both copies are kept."""
    e = inputs.edges(spark, sf).withColumn("metadata", F.create_map().cast("map<string,string>"))
    path = new_folder(spark, "edges")
    lineage_edges.append_edges(e, path)
    lineage_edges.append_edges(e, path)
    stored = spark.read.parquet(path).filter(F.col("created_at").isNotNull())
    return stored.groupBy("downstream_type").agg(F.count(F.lit(1)).alias("edges"))


def _versions(spark, sf):
    n = inputs.notifications(spark, sf)
    return n.select(
        "dataset_id",
        F.col("n").alias("version"),
        F.to_json("attributes").alias("header_json"),
        F.size("attributes").alias("attribute_count"),
        F.col("event_id").alias("stored_seq"),
    )


@query
def latest_schema(spark, sf):
    return registry.latest_schema(_versions(spark, sf)).select("dataset_id", "version", "attribute_count", "stored_seq")


@query
def previous_header(spark, sf):
    """Each notification next to the newest version stored for its dataset."""
    latest = registry.latest_schema(_versions(spark, sf)).select(
        "dataset_id", F.col("version").alias("current_version"), F.col("attribute_count").alias("current_attributes")
    )
    return inputs.notifications(spark, sf).join(latest, "dataset_id", "left").select(
        "event_id", "dataset_id", "current_version", "current_attributes", F.size("attributes").alias("new_attributes")
    )


@query
def next_version(spark, sf):
    """Verified notifications numbered after the versions stored for failed ones."""
    n = inputs.notifications(spark, sf)
    stored = n.filter(~F.col("verified")).select("dataset_id", F.col("n").alias("version"))
    accepted = n.filter(F.col("verified")).select("dataset_id", "seq")
    return registry.next_versions(accepted, stored)


@query
def dataset_path_key(spark, sf):
    return inputs.table(spark, sf, "pages").select("page_id", F.expr(ids.dataset_path_key("url")).alias("path_key"))


@query
def upsert_plans(spark, sf):
    o = inputs.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("plan_id"), F.col("o_orderpriority").alias("plan"), "o_orderstatus",
        F.col("o_orderkey").alias("stored_at"),
    )
    old = o.filter(F.col("o_orderstatus") == "F")
    new = o.filter(F.col("o_orderstatus") != "F")
    return registry.upsert(old, new)


@query
def upsert_executions(spark, sf):
    a = inputs.attempts(spark, sf)
    rows = a.select(
        F.concat_ws("-", F.col("plan_no"), F.col("op_seq")).alias("plan_id"), "status", F.col("attempt").alias("stored_at")
    )
    return registry.upsert(rows.filter(F.col("status") == 3), rows.filter(~F.col("status").eqNullSafe(3)))


@query
def upsert_verifications(spark, sf):
    n = inputs.notifications(spark, sf).select(
        F.col("dataset_id").alias("plan_id"), F.when(F.col("verified"), "passed").otherwise("failed").alias("status"),
        F.col("seq").alias("stored_at"),
    )
    return registry.upsert(n.filter(F.col("status") == "failed"), n.filter(F.col("status") == "passed"))


_STAR = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


@query
def lake_evidence_scan(spark, sf):
    found = evidence.lake_evidence({t: inputs.table(spark, sf, t) for t in _STAR})
    return found.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("columns"), F.max("total_rows").alias("rows"),
        F.count_if("nullable").alias("nullable_columns"),
    )


@query
def nullability_profile(spark, sf):
    n = inputs.notifications(spark, sf).select("event_id", "dataset_id", "producer_version", "requested_policy")
    a = inputs.attempts(spark, sf).select("plan_no", "op_seq", "attempt", "status")
    given = {t: inputs.table(spark, sf, t) for t in _STAR}
    return evidence.nullability_profile({"notifications": n, "attempts": a, **given})


@query
def vault_evidence_scan(spark, sf):
    parts = inputs.with_evidence(inputs.notifications(spark, sf)).select("dataset_id", F.explode("vault_structures").alias("s"))
    kind = F.array(
        F.struct(F.lit("link").alias("kind"), F.col("s.links").alias("names")),
        F.struct(F.lit("satellite").alias("kind"), F.col("s.satellites").alias("names")),
    )
    named = parts.select("dataset_id", F.col("s.hub").alias("hub"), F.explode(kind).alias("k")).select(
        "dataset_id", "hub", "k.kind", F.explode("k.names").alias("name")
    )
    out = vault.vault_structures(named)
    return out.select("dataset_id", "hub", joined("links").alias("links"), joined("satellites").alias("satellites"))


# --- projections and scalar functions ----------------------------------------------------

SPELLINGS = [
    "  VARCHAR ", "Character Varying", "long", "numeric(10,2)", "date", "Timestamp Without Time Zone", "",
    "timestamptz", "float4", "smallint", "longtext", "interval", "datetime", "uuid", "array<int>",
    "double precision", "REAL", "bool", "decimal(12,2)", "time", "timestamp with time zone", "bpchar", "int8",
]


def spelled(spark, sf):
    """Three type spellings per event and slot."""
    names = F.array(*[F.lit(s) for s in SPELLINGS])

    def pick(a, b, c):
        k = (F.col("event_id") * a + F.col("i") * b + c) % len(SPELLINGS)
        return F.element_at(names, (k + 1).cast("int"))

    rows = inputs.table(spark, sf, "events").select("event_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("i"))
    return rows.withColumns({"logical_type": pick(5, 3, 0), "physical_type": pick(11, 7, 1), "type": pick(2, 5, 4)})


@query
def canonical_type(spark, sf):
    return (
        spelled(spark, sf)
        .groupBy(F.col("logical_type").alias("spelling"), F.expr(tn.canonical_type("logical_type")).alias("canonical"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


@query
def effective_type(spark, sf):
    s = spelled(spark, sf)
    shaped = s.withColumn("attr", F.struct(
        F.when((F.col("event_id") + F.col("i")) % 3 != 0, F.col("logical_type")).alias("logical_type"),
        F.when((F.col("event_id") + F.col("i")) % 2 != 0, F.col("physical_type")).alias("physical_type"),
        F.col("type"),
    ))
    return shaped.groupBy(F.expr(tn.effective_type("attr")).alias("effective")).agg(F.count(F.lit(1)).alias("uses"))


@query
def type_family(spark, sf):
    return (
        spelled(spark, sf)
        .groupBy(F.col("logical_type").alias("spelling"), F.expr(tn.type_family("logical_type")).alias("family"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


@query
def widening_check(spark, sf):
    a, b = "logical_type", "physical_type"
    return (
        spelled(spark, sf)
        .groupBy(F.col(a).alias("from_type"), F.col(b).alias("to_type"), F.expr(tn.is_widening(a, b)).alias("widening"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


@query
def strip_technical(spark, sf):
    n = inputs.notifications(spark, sf)
    return n.select(
        "event_id", F.size("raw_attributes").alias("before"), F.size("attributes").alias("after"),
        joined(F.transform("attributes", lambda a: a["name"])).alias("names"),
    )


def _latest_json():
    ev = F.col("event_id")
    head = F.concat(F.lit('{"attributes":'), F.to_json("raw_attributes"), F.lit("}"))
    return (
        F.when(ev % 7 == 0, F.concat(F.lit('{"version":1,"header":'), head, F.lit("}")))
        .when(ev % 7 == 1, F.concat(F.lit('{"version":1,"header":{"header":'), head, F.lit("}}")))
        .when(ev % 7 == 2, head)
        .when(ev % 7 == 3, '{"version":1,"header":{"attributes":"none"}}')
        .when(ev % 7 == 4, "{}")
        .when(ev % 7 == 5, F.concat(F.lit('{"header":'), head))
    )


@query
def header_shape(spark, sf):
    n = inputs.notifications(spark, sf).select("event_id", _latest_json().alias("latest"))
    shaped = H.header_shape(n, "latest")
    return shaped.select("event_id", "shape", F.coalesce(F.array_size("attributes"), F.lit(-1)).alias("attributes"))


@query
def header_profile(spark, sf):
    return inputs.notifications(spark, sf).select(
        "event_id",
        F.size(F.expr(H.attribute_names("raw_attributes"))).alias("columns"),
        joined(F.expr(H.attribute_names("raw_attributes"))).alias("names"),
    )


# version of the notification before, as the registry would hold it
_CURRENT = "CASE WHEN n > 1 THEN n - 1 END"


@query
def resolve_prev_version(spark, sf):
    n = inputs.notifications(spark, sf)
    return n.select("event_id", F.expr(H.resolve_previous_version("producer_version", _CURRENT)).alias("previous_version"))


@query
def change_context(spark, sf):
    n = inputs.with_previous(inputs.notifications(spark, sf))
    return n.select(
        "event_id", "dataset_id", F.coalesce("source", F.lit("")).alias("source"),
        F.expr(keys.correlation_id("dataset_id", "seq")).alias("correlation_id"),
        F.coalesce(F.array_size("prev_attributes"), F.lit(-1)).alias("previous_attributes"),
        F.size("attributes").alias("new_attributes"), F.col("observed_at").alias("ingestion_ts"),
    )


def _identifiers(spark, sf):
    pages = inputs.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("url").alias("value"))
    sup = inputs.table(spark, sf, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.concat(F.lit(' Lake."Sat_'), F.col("s_name"), F.lit('-x.y" ')).alias("value")
    )
    part = inputs.table(spark, sf, "part").select(
        F.concat(F.lit("q"), F.col("p_partkey")).alias("id"), F.concat(F.lit("HUB_"), F.col("p_type"), F.lit("/Link_"), F.col("p_brand")).alias("value")
    )
    return pages.unionByName(sup).unionByName(part)


@query
def physical_identifier(spark, sf):
    return _identifiers(spark, sf).select(
        "id", F.expr(ids.physical_identifier("value")).alias("rdbms_name"), F.expr(ids.physical_identifier("value", rdbms=False)).alias("file_name")
    )


@query
def identifier_candidates(spark, sf):
    return _identifiers(spark, sf).select("id", F.explode(F.expr(ids.identifier_candidates("value"))).alias("candidate"))


@query
def type_preference(spark, sf):
    p = inputs.planned(spark, sf).select("event_id", F.explode(F.expr(verify.type_preferences("operations"))).alias("t"))
    return p.select("event_id", "t.column_name", "t.preference")


@query
def idempotency_key(spark, sf):
    """Keys of operations whose column name is a whole document, with every script it holds."""
    d = inputs.table(spark, sf, "documents")
    params = keys.json_ascii_object(
        {
            "column_name": keys.json_ascii_string("text"),
            "logical_type": keys.json_ascii_string("(CASE WHEN doc_id % 3 <> 0 THEN lang END)"),
        }
    )
    target = keys.json_ascii_string("concat('doc/', source)")
    layer, kind = keys.json_ascii_string("'lake'"), keys.json_ascii_string("'ADD_COLUMN'")
    key = keys.idempotency_key(target, layer, kind, target, params)
    return d.select("doc_id", F.expr(key).alias("idempotency_key"))


ERROR_CODES = ["UNAVAILABLE", "INTERNAL", "DEADLINE_EXCEEDED", "NOT_FOUND", "RESOURCE_EXHAUSTED"]
ERROR_TEXTS = ["Connection refused by peer", "column exists", "Service Temporarily Unavailable", "StatusCode.UNAVAILABLE: x", "bad type",
               "failed to connect to all addresses", "timeout"]


@query
def error_triage(spark, sf):
    a = inputs.attempts(spark, sf).filter(F.col("status").isNull() | (F.col("status") > 2))

    def pick(values, k):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))

    a = a.select(
        pick(ERROR_CODES, F.col("o_orderkey") + F.col("attempt")).alias("code"),
        pick(ERROR_TEXTS, F.col("o_orderkey") * 3 + F.col("attempt")).alias("message"),
    )
    return a.groupBy("code", "message", F.expr(triage.is_transient("code", "message")).alias("transient")).agg(
        F.count(F.lit(1)).alias("errors")
    )


# --- diff, policy, plan ------------------------------------------------------------------


@query
def schema_diff(spark, sf):
    atoms = diff.explode_atoms(inputs.diffed(spark, sf), "dataset_id", "n")
    return atoms.select("dataset_id", "n", "kind", "attribute", "from_type", "to_type")


@query
def schema_diff_ordered(spark, sf):
    return diff.explode_atoms(inputs.diffed(spark, sf), "event_id").select("event_id", "atom_seq", "kind", "attribute")


@query
def atom_counts(spark, sf):
    a = "atoms"
    return inputs.diffed(spark, sf).select(
        "event_id",
        diff.atom_count(a, "ADD_COLUMN").alias("added"),
        diff.atom_count(a, "CHANGE_TYPE").alias("changed"),
        diff.atom_count(a, "DROP_COLUMN").alias("dropped"),
    )


@query
def column_set_ops(spark, sf):
    n = inputs.with_previous(inputs.notifications(spark, sf)).select(
        "event_id",
        F.expr(H.attribute_names("prev_attributes")).alias("p"),
        F.expr(H.attribute_names("attributes")).alias("c"),
    )
    out = diff.column_set_ops(n, "p", "c")
    return out.select("event_id", *[joined(F.sort_array(c)).alias(c) for c in ("added", "removed", "kept")])


@query
def policy_flags(spark, sf):
    df = policy.policy_flags(inputs.diffed(spark, sf))
    return df.select("event_id", "has_drop", "has_change", "only_additive", "widening_only", "offenders")


def _guarded(mode="always", **extra):
    return dict(policies.STANDARD_POLICIES["sandbox"], impact_mode=mode, **extra)


GUARDS = {
    "default": _guarded(max_impacted_total=4),
    "lake_cap": _guarded(max_impacted_lake_tables=1, max_impacted_vault_objects=0),
    "strict": _guarded("breaking_only", max_impacted_total=0, max_impacted_transformations=2),
    "any": _guarded(block_on_any_impact=True),
    "off": _guarded(False, max_impacted_total=0),
}


def _guard_input(spark, sf):
    ev = F.col("event_id")
    names = F.array(*[F.lit(g) for g in GUARDS])
    df = policy.policy_flags(inputs.diffed(spark, sf)).withColumns(
        {
            "impacted_lake": (ev % 4).cast("bigint"),
            "impacted_vault": (ev % 3).cast("bigint"),
            "impacted_transformations": (F.floor(ev / 4) % 5).cast("bigint"),
            "requested_policy": F.element_at(names, (F.floor(ev / 2) % len(GUARDS) + 1).cast("int")),
        }
    )
    return policies.select_policy(df, GUARDS)


@query
def impact_guard(spark, sf):
    reasons = F.expr(policy.impact_reasons("policy"))
    return _guard_input(spark, sf).select("event_id", "policy_name", joined(reasons, "; ").alias("reasons"))


def _outcome(df):
    return df.select(
        "event_id", "policy_name", "decision", "compatibility", joined("obligations").alias("obligations"), joined("reasons", "; ").alias("reasons")
    )


@query
def policy_decision_production(spark, sf):
    return _outcome(inputs.decided(spark, sf, "production"))


@query
def policy_decision_sandbox(spark, sf):
    return _outcome(inputs.decided(spark, sf, "sandbox"))


@query
def policy_decision_requested(spark, sf):
    return _outcome(inputs.decided(spark, sf))


@query
def policy_decision_guarded(spark, sf):
    return _outcome(policy.policy_decision(_guard_input(spark, sf)))


@query
def build_plan(spark, sf):
    return inputs.operations(spark, sf).select(
        "event_id", "op_seq", "layer", "kind", "target", "column_name",
        F.col("params")["logical_type"].alias("logical_type"),
        F.col("params")["from_logical_type"].alias("from_logical_type"),
        F.col("params")["to_logical_type"].alias("to_logical_type"),
        F.col("params")["table_name"].alias("table_name"),
        "idempotency_key",
    )


@query
def op_summary(spark, sf):
    p = inputs.planned(spark, sf).select("event_id", F.explode(F.expr(plan.operation_summary("operations"))).alias("op", "operations"))
    return p


@query
def plan_checkpoints(spark, sf):
    c = F.col("checkpoints")
    return inputs.planned(spark, sf).select("event_id", F.size(c).alias("checkpoints"), F.coalesce(F.array_max(c), F.lit(0)).alias("last"))


def _probes(spark, sf):
    return (
        inputs.base(spark, sf)
        .groupBy("dataset_id")
        .agg(F.max("event_id").alias("m"), F.count(F.lit(1)).alias("c"))
        .select("dataset_id", F.when(F.col("m") % 5 == 0, "DV_UNAVAILABLE").alias("error_code"), (F.col("c") % 3).alias("candidate_count"))
    )


@query
def prune_link_ops(spark, sf):
    kept = plan.prune_link_ops(inputs.operations(spark, sf), _probes(spark, sf))
    return kept.select("event_id", "op_seq", "layer", "kind")


@query
def already_applied(spark, sf):
    ops = written(inputs.operations(spark, sf).select("event_id", "op_seq", "layer", "kind", "idempotency_key"), "operations")
    ledger = ops.filter((F.col("layer") == "lake") | (F.col("kind") == "NEW_HUB")).select("idempotency_key")
    return plan.flag_already_applied(ops, ledger).select("event_id", "op_seq", "already_applied")


# --- lineage -----------------------------------------------------------------------------


def _impact_requests(spark, sf):
    d = kept(inputs.diffed(spark, sf), F.size("atoms") > 0)
    return d.select("dataset_id", F.expr(diff.changed_attributes("atoms")).alias("changed"))


def _walk(spark, sf):
    ids_ = stored(lineage.with_request_ids(_impact_requests(spark, sf)))
    hits, reached = lineage.walk(ids_, inputs.edges(spark, sf))
    named = ids_.select("req_id", "dataset_id", joined("changed").alias("changed"))
    return named, hits, reached


@query
def lineage_impact(spark, sf):
    named, hits, _ = _walk(spark, sf)
    return named.join(hits.hint("merge"), "req_id").select("dataset_id", "changed", "artifact_class", "artifact_id")


@query
def lineage_reach(spark, sf):
    named, _, reached = _walk(spark, sf)
    return named.join(reached.hint("merge"), "req_id").select("dataset_id", "changed", "node")


@query
def impact_counts(spark, sf):
    out = lineage.impact_for(_impact_requests(spark, sf), inputs.edges(spark, sf))
    total = F.col("impacted_lake") + F.col("impacted_vault") + F.col("impacted_transformations")
    return out.withColumn("changed", joined("changed")).withColumn("impacted_total", total)


@query
def policy_decision_lineage(spark, sf):
    """Decisions with the impact found in the lineage graph; only changes that a guard looks at are walked."""
    df = policies.select_policy(policy.policy_flags(inputs.diffed(spark, sf)), policies.STANDARD_POLICIES)
    df = df.withColumn("changed", F.expr(diff.changed_attributes("atoms")))
    df = stored(df)
    asked = kept(
        df,
        F.col("has_atoms") & (F.col("policy.impact_mode") != "off")
        & ~((F.col("policy.impact_mode") == "breaking_only") & F.col("only_additive")),
    )
    found = lineage.impact_for(asked.select("dataset_id", "changed"), inputs.edges(spark, sf))
    df = df.join(found, ["dataset_id", "changed"], "left")
    zero = F.lit(0).cast("bigint")
    counts = ("impacted_lake", "impacted_vault", "impacted_transformations")
    return _outcome(policy.policy_decision(df.withColumns({c: F.coalesce(c, zero) for c in counts})))


# --- execution and verification ----------------------------------------------------------


def _op_outcomes(spark, sf):
    return execution.op_outcome(inputs.attempts(spark, sf), ("plan_no",), inputs.ATTEMPTS)


@query
def op_outcome(spark, sf):
    return _op_outcomes(spark, sf)


@query
def abort_cutoff(spark, sf):
    return execution.abort_cutoff(_op_outcomes(spark, sf), ("plan_no",)).select("plan_no", "op_seq", "status")


@query
def execution_result(spark, sf):
    plans = inputs.table(spark, sf, "customer").select(F.col("c_custkey").alias("plan_no"))
    return execution.execution_result(plans, _op_outcomes(spark, sf), ("plan_no",))


def _verified(spark, sf, outcomes=None):
    df = inputs.with_evidence(inputs.planned(spark, sf, outcomes))
    return verify.verify_vault(verify.verify_lake(df))


@query
def select_target_table(spark, sf):
    df = inputs.with_evidence(inputs.notifications(spark, sf))
    df = df.withColumn("target", F.expr(verify.select_target_table("lake_tables")))
    columns = F.coalesce(F.array_size("target.attributes"), F.lit(-1))
    return df.select("event_id", F.col("target.name").alias("target_table"), columns.alias("columns"))


@query
def verify_lake(spark, sf):
    return _verified(spark, sf).select("event_id", joined("lake_issues", "; ").alias("issues"))


@query
def verify_vault(spark, sf):
    return _verified(spark, sf).select("event_id", joined("vault_issues", "; ").alias("issues"))


def _results(spark, sf, outcomes=None):
    """Verification outcome per plan, with the evidence ids that its operations reported."""
    df = verify.verification_result(_verified(spark, sf, outcomes))
    snapshots = (
        "transform(operations, (_o, _i) -> named_struct('op_seq', _i + 1, 'evidence_snapshot_id', "
        "CASE WHEN (event_id + _i) % 3 <> 0 THEN concat_ws('-', 'snap', event_id, _i + 1) END))"
    )
    return df.withColumn("evidence_snapshot_refs", F.expr(verify.evidence_refs(snapshots)))


@query
def verification_result(spark, sf):
    return _results(spark, sf).select(
        "event_id", "status", joined("issues", "; ").alias("issues"), joined("evidence_snapshot_refs").alias("refs")
    )


def _success_rows(results):
    df = kept(results, F.col("status") == "passed")
    previous = F.expr(H.resolve_previous_version("producer_version", _CURRENT))
    return df.withColumns({"previous_version": previous, "new_version": F.col("n")})


@query
def success_event(spark, sf):
    e = events.success_event(_success_rows(_results(spark, sf)))
    v = F.col("event")
    operation = (
        "concat_ws('|', _o.idempotency_key, _o.layer, _o.kind, _o.target, coalesce(_o.params['column_name'], _o.params['table_name']),"
        " coalesce(_o.params['logical_type'], '-'), _o.plan_id = event.plan.plan_id, _o.correlation_id = event.correlation_id)"
    )
    return e.select(
        F.md5(F.expr(f"concat_ws(',', transform(event.plan.operations, _o -> {operation}))")).alias("operations_md5"),
        "event_id",
        v["event_type"].alias("event_type"), v["dataset"]["id"].alias("dataset_id"), v["dataset"]["source"].alias("source"),
        v["correlation_id"].alias("correlation_id"), v["previous_version"].alias("previous_version"), v["new_version"].alias("new_version"),
        v["compatibility"].alias("compatibility"), v["plan"]["plan_id"].alias("plan_id"), F.size(v["plan"]["operations"]).alias("operations"),
        v["plan"]["handler_results"]["lake"].alias("lake_result"), v["plan"]["handler_results"]["vault"].alias("vault_result"),
        v["verification"]["status"].alias("status"), joined(v["verification"]["evidence_snapshot_refs"]).alias("refs"),
    )


def _outcomes(spark, sf):
    """Decided notifications as a table, since denied ones and plans are both read from it; without what only the diff needs."""
    needed = ["event_id", "dataset_id", "n", "seq", "source", "producer_version", "attributes", "atoms"]
    return written(inputs.decided(spark, sf).select(*needed, "decision", "compatibility", "obligations", "reasons"), "decided")


def _failures(outcomes, results):
    denied = outcomes.filter(F.col("decision") != "allow").withColumn(
        "correlation_id", F.expr(keys.correlation_id("dataset_id", "seq"))
    )
    shape = ["event_id", "dataset_id", "correlation_id", "decision", "reasons"]
    failed = kept(results, F.col("status") == "failed").select(*shape, "issues")
    none = F.array().cast("array<string>")
    return events.failure_event(denied.select(*shape).withColumn("issues", none).unionByName(failed))


@query
def failure_event(spark, sf):
    v = F.col("event")
    outcomes = _outcomes(spark, sf)
    return _failures(outcomes, _results(spark, sf, outcomes)).select(
        "event_id", v["event_type"].alias("event_type"), v["dataset"]["id"].alias("dataset_id"),
        v["correlation_id"].alias("correlation_id"), v["reason"].alias("reason"), v["details"].alias("details"),
    )


@query
def outcome_route(spark, sf):
    """Messages per sink and key, read back from their JSON text."""
    outcomes = _outcomes(spark, sf)
    columns = ["event_id", "dataset_id", "n", "source", "producer_version", "correlation_id", "plan_id", "decision", "compatibility", "reasons"]
    results = _results(spark, sf, outcomes).select(*columns, "operations", "successful", "status", "issues", "evidence_snapshot_refs")
    results = written(results, "results")
    both = events.as_messages(events.success_event(_success_rows(results))).unionByName(events.as_messages(_failures(outcomes, results)))
    reason = F.get_json_object("value", "$.reason")
    return both.groupBy("event_type", "key", F.coalesce(reason, F.lit("none")).alias("reason")).agg(F.count(F.lit(1)).alias("messages"))


# --- replay ------------------------------------------------------------------------------


def _replay(df, **kw):
    return replay(df, policies.STANDARD_POLICIES, **kw).select("dataset_id", "seq", "allowed", "accepted", "previous_seq", "new_version")


@query
def replay_production(spark, sf):
    """Every notification under the production rules, each allowed one verified."""
    n = inputs.notifications(spark, sf).withColumns({"requested_policy": F.lit("production"), "verified": F.lit(True)})
    return _replay(n)


@query
def replay_sandbox(spark, sf):
    return _replay(inputs.notifications(spark, sf).withColumn("requested_policy", F.lit("sandbox")))


@query
def replay_requested(spark, sf):
    """Policies as requested and verification failures as given."""
    return _replay(inputs.notifications(spark, sf))


@query
def replay_with_lineage(spark, sf):
    n = inputs.notifications(spark, sf)
    return _replay(n, edges=inputs.edges(spark, sf))


@query
def replay_hot_dataset(spark, sf):
    """All notifications as those of one dataset, in many segments."""
    n = inputs.notifications(spark, sf).withColumn("dataset_id", F.lit("lake.all"))
    return _replay(n, segment_rows=2000)


@query
def version_history(spark, sf):
    """Registry rows that a replay leaves: one per accepted notification, unchanged headers included."""
    n = inputs.notifications(spark, sf)
    r = replay(n, policies.STANDARD_POLICIES).filter("accepted")
    rows = r.join(n.select("dataset_id", "seq", F.size("attributes").alias("attribute_count")), ["dataset_id", "seq"])
    return rows.select("dataset_id", F.col("new_version").alias("version"), F.col("seq").alias("stored_seq"), "attribute_count")


# --- tables and vault --------------------------------------------------------------------


@query
def lake_add_column(spark, sf):
    return tables.add_column(inputs.table(spark, sf, "orders"), "o_channel", "varchar").select("o_orderkey", "o_custkey", "o_channel")


@query
def lake_drop_column(spark, sf):
    return tables.drop_column(tables.drop_column(inputs.table(spark, sf, "part"), "p_size"), "not_there")


@query
def lake_rename_column(spark, sf):
    return tables.rename_column(inputs.table(spark, sf, "customer"), "c_acctbal", "c_balance")


@query
def lake_change_type(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    wide = tables.change_type(tables.change_type(li, "l_linenumber", "int8"), "l_partkey", "text")
    return tables.change_type(wide, "l_returnflag", "integer")


@query
def lossy_cast_report(spark, sf):
    li = inputs.table(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag", "l_orderkey")
    return tables.lossy_cast_report(
        li, {"l_quantity": "integer", "l_extendedprice": "bigint", "l_returnflag": "integer", "l_orderkey": "integer"}
    )


_OPS = [
    {"kind": "ADD_COLUMN", "params": {"column_name": "o_channel", "logical_type": "text"}},
    {"kind": "CHANGE_TYPE", "params": {"column_name": "o_custkey", "to_logical_type": "varchar"}},
    {"kind": "DROP_COLUMN", "params": {"column_name": "o_totalprice"}},
    {"kind": "RENAME_COLUMN", "params": {"column_name": "o_orderstatus", "new_name": "o_status"}},
    {"kind": "CHANGE_TYPE", "params": {"column_name": "o_channel", "to_logical_type": "int8"}},
    {"kind": "ADD_COLUMN", "params": {"column_name": "o_status", "logical_type": "text"}},
]


@query
def apply_plan(spark, sf):
    return tables.apply_operations(inputs.table(spark, sf, "orders"), _OPS)[0]


@query
def compat_view(spark, sf):
    evolved, _ = tables.apply_operations(inputs.table(spark, sf, "orders"), _OPS[:3])
    old = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "numeric"), ("o_orderpriority", "text")]
    return tables.create_compat_view(evolved, old, "orders_v1").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").isNull().alias("price_missing"), "o_orderpriority"
    )


@query
def multi_version_read(spark, sf):
    """Three groups of files with older and newer headers, read under the newest one."""
    o = inputs.table(spark, sf, "orders")

    def part(status):
        return o.filter(F.col("o_orderstatus") == status)

    v1 = part("F").select("o_orderkey", F.col("o_custkey").cast("int").alias("o_custkey"), "o_orderstatus")
    v2 = part("O").select("o_orderstatus", "o_custkey", "o_orderkey", "o_orderpriority")
    v3 = tables.change_type(part("P").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus"), "o_custkey", "text")
    header = [("o_orderkey", "bigint"), ("o_custkey", "text"), ("o_orderstatus", "varchar"), ("o_orderpriority", "text")]
    return tables.multi_version_read([v1, v2, v3], header)


@query
def vault_hub(spark, sf):
    """Suppliers and part keys seen in line items that the hub does not hold yet."""
    known = inputs.table(spark, sf, "part").filter(F.col("p_size") > 25)
    existing = vault.load_hub(known, "p_partkey", "part")
    new = vault.load_hub(inputs.table(spark, sf, "lineitem"), "l_partkey", "lineitem", existing)
    return new.select("hub_hash", "business_key", "record_source")


@query
def vault_link(spark, sf):
    li = inputs.table(spark, sf, "lineitem")
    returned = vault.load_link(li.filter(F.col("l_returnflag") == "R"), ["l_orderkey", "l_suppkey"], "returns")
    new = vault.load_link(li, ["l_orderkey", "l_suppkey"], "lineitem", returned)
    return new.select("link_hash", "l_orderkey_hash", "l_suppkey_hash", "record_source")


@query
def vault_satellite(spark, sf):
    return vault.load_satellite(inputs.table(spark, sf, "events"), "user_id", ["event_type"], "event_id", "events")


def _barred(spark, sf):
    """Keys from texts of documents with ``||`` at their end or at the begin of the next one."""
    a = F.concat(F.substring(F.md5("text"), 1, 20), F.lit("||"))
    bar = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, "||")
    return inputs.table(spark, sf, "documents").select("doc_id", a.alias("a"), F.concat(bar, F.substring("lang", 1, 1)).alias("b"))


def _recut(df):
    return df.withColumns({"a": F.expr("left(a, length(a) - 2)"), "b": F.concat(F.lit("||"), F.col("b"))})


@query
def vault_link_text(spark, sf):
    """Links over text keys that differ only in where a separator stands."""
    rows = _barred(spark, sf)
    new = vault.load_link(rows.unionByName(_recut(rows)), ["a", "b"], "documents")
    return new.select("link_hash", "a_hash", "b_hash")


@query
def vault_satellite_text(spark, sf):
    """Changes that only move a separator from one column to the next."""
    rows = _barred(spark, sf).withColumns({"lang": F.col("doc_id") % 7, "load": F.col("doc_id") * 2})
    moved = _recut(rows).withColumn("load", F.col("load") + 1)
    out = vault.load_satellite(rows.unionByName(moved), "lang", ["a", "b"], "load", "documents")
    return out.select("hub_hash", "load_seq", "hash_diff")


@query
def vault_satellite_evolved(spark, sf):
    """The satellite after a column was added and another one widened to text."""
    e = inputs.table(spark, sf, "events").select(
        "event_id", "user_id", "event_type", F.when(F.col("value") >= 10, F.floor("value").cast("int")).alias("level")
    )
    e = tables.change_type(e, "level", "text")
    return vault.load_satellite(e, "user_id", ["event_type", "level"], "event_id", "events_v2")


@query
def link_probe(spark, sf):
    return probe_links({t: inputs.table(spark, sf, t) for t in _STAR}, same_name=True)


@query
def link_probe_any_name(spark, sf):
    """Every whole-number column whose values all occur in a unique column of another table, whatever the names."""
    found = probe_links({t: inputs.table(spark, sf, t) for t in _STAR})
    return found.select("table_name", "key_column", "parent_table", "parent_key", "distinct_values")


# --- streaming ---------------------------------------------------------------------------

# Files of one offset range of the log, which are one trigger.
LOG_FILES = 4
_LOG = "offset bigint, value string, verified boolean"


def _log_folder(spark, sf, batches: int = 3) -> str:
    """The messages as a log of parquet files, written one offset range after the other."""
    n = inputs.message_values(spark, sf).select(
        F.col("event_id").alias("offset"), "value", (F.col("event_id") % 19 != 0).alias("verified")
    )
    path = new_folder(spark, "log")
    n = stored(n)
    low, high = n.agg(F.min("offset"), F.max("offset")).first()
    step = (high - low) // batches + 1
    for i in range(batches):
        start = low + i * step
        part = n.filter(F.col("offset").between(start, start + step - 1))
        part.repartition(LOG_FILES).write.mode("append").parquet(path)
    return path


def _read_log(spark, path):
    return spark.readStream.schema(_LOG).option("maxFilesPerTrigger", LOG_FILES).parquet(path)


@query
def replay_stream(spark, sf):
    """Stateful streaming replay of the message log, one file per trigger."""
    path, out = _log_folder(spark, sf), new_folder(spark, "replayed")
    run_replay(log_to_notifications(_read_log(spark, path)), policies.STANDARD_POLICIES, out, new_folder(spark, "chk"))
    done = spark.read.schema(STREAM_RESULT).parquet(out)
    return done.select("dataset_id", "seq", "allowed", "accepted", "previous_seq", "new_version")


@query
def stream_registry_resumed(spark, sf):
    """Two streams, each with its own log and checkpoint, one after the other into one registry."""
    root, log = new_folder(spark, "registry"), inputs.message_values(spark, sf).select(
        F.col("event_id").alias("offset"), "value", (F.col("event_id") % 19 != 0).alias("verified")
    )
    low, high = log.agg(F.min("offset"), F.max("offset")).first()
    for n, part in enumerate((F.col("offset") <= (low + high) // 2, F.col("offset") > (low + high) // 2)):
        path = new_folder(spark, f"log-{n}")
        log.filter(part).repartition(LOG_FILES).write.parquet(path)
        run_registry(_read_log(spark, path), RegistrySink(root, policies.STANDARD_POLICIES), new_folder(spark, "chk"))
    return spark.read.parquet(f"{root}/versions").select("dataset_id", "version", F.col("seq").alias("stored_seq"))


@query
def lineage_edges_file(spark, sf):
    """Edges written as JSON lines, with metadata and attribute lists of every shape, and read back."""
    e = inputs.edges(spark, sf).select("*", F.regexp_extract("downstream_id", "([0-9]+)$", 1).cast("bigint").alias("p"))
    line = F.to_json(F.struct("upstream_type", "upstream_id", "downstream_type", "downstream_id", "via_attributes"))
    body = F.expr("substring(line, 1, length(line) - 1)")
    odd = (
        F.when(F.col("p") % 6 == 0, F.concat(body, F.lit(', "metadata": "plain text"}')))
        .when(F.col("p") % 6 == 1, F.concat(body, F.lit(', "metadata": {"n": 1, "deep": {"a": [1, 2]}}}')))
        .when(F.col("p") % 6 == 2, F.regexp_replace("line", r'"via_attributes":\[.*\]', '"via_attributes": "col_1"'))
        .when(F.col("p") % 6 == 3, F.concat(F.lit("  "), F.col("line"), F.lit(" ")))
        .when(F.col("p") % 6 == 4, F.concat(F.lit("{broken "), F.col("line")))
        .otherwise(F.col("line"))
    )
    path = new_folder(spark, "edge-lines")
    e.withColumn("line", line).select(odd.alias("value")).write.text(path)
    read = lineage_edges.read_edges_jsonl(spark, path)
    return read.select("upstream_id", "downstream_id", joined("via_attributes").alias("via"), joined(F.sort_array(F.map_keys("metadata"))).alias("metadata_keys"))


@query
def apply_plan_rows(spark, sf):
    """The operations of a real plan, as ``explode_operations`` gives them, applied to a table."""
    header = F.expr(
        "from_json(concat('[', concat_ws(',', "
        "'{\"kind\":\"ADD_COLUMN\",\"attribute\":\"o_channel\",\"to_type\":\"string\"}', "
        "'{\"kind\":\"CHANGE_TYPE\",\"attribute\":\"o_custkey\",\"from_type\":\"bigint\",\"to_type\":\"string\"}', "
        "'{\"kind\":\"DROP_COLUMN\",\"attribute\":\"o_totalprice\",\"from_type\":\"double\"}'"
        "), ']'), 'array<struct<kind:string,attribute:string,from_type:string,to_type:string>>')"
    )
    orders = inputs.table(spark, sf, "orders")
    one = orders.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("lake.orders").alias("dataset_id"), header.alias("atoms"), F.array(F.lit("NEW_HUB"), F.lit("NEW_LINK")).alias("obligations")
    )
    rows = plan.explode_operations(plan.build_plan(one), "dataset_id").orderBy("op_seq").collect()
    return tables.apply_operations(orders, rows)[0]


@query
def stream_registry(spark, sf):
    """Versions that the micro-batch path leaves in its registry."""
    root = new_folder(spark, "registry")
    run_registry(_read_log(spark, _log_folder(spark, sf)), RegistrySink(root, policies.STANDARD_POLICIES), new_folder(spark, "chk"))
    return spark.read.parquet(f"{root}/versions").select("dataset_id", "version", F.col("seq").alias("stored_seq"))


@query
def registry_latest(spark, sf):
    """The last accepted header of each dataset as the registry's bucketed log has it, compacted on the way."""
    root = new_folder(spark, "registry")
    sink = RegistrySink(root, policies.STANDARD_POLICIES, compact_after=2)
    run_registry(_read_log(spark, _log_folder(spark, sf)), sink, new_folder(spark, "chk"))
    found = sink.latest(spark).read(before=1 << 40)
    return found.select("dataset_id", "version", "stored_seq", F.size("attributes").alias("attribute_count"), joined("primary_key").alias("primary_key"))
