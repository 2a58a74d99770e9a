"""Expansion of allowed changes into ordered lake and vault operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.functions.keys import idempotency_key, json_ascii_object, json_ascii_string
from schemaloom.functions.text import empty, let, lit, struct
from schemaloom.operators.barrier import unnest

_OP_PARAMS = {
    "ADD_COLUMN": ["column_name", "logical_type"],
    "CHANGE_TYPE": ["column_name", "logical_type", "to_logical_type", "from_logical_type"],
    "DROP_COLUMN": ["column_name", "logical_type", "from_logical_type"],
}


def _demands(obligations: str, name: str) -> str:
    return f"exists({obligations}, _o -> upper(_o) IN ('{name}', 'CREATE_{name}'))"


def plan_operations(atoms: str = "atoms", obligations: str = "obligations") -> str:
    """Operations of one plan as an array in execution order, without keys."""
    null = "cast(NULL AS string)"

    def op(layer, kind, attribute, from_type, to_type):
        return struct(layer=f"'{layer}'", kind=kind, column_name=attribute, from_type=from_type, to_type=to_type)

    structural = ", ".join(
        f"CASE WHEN {_demands(obligations, k)} THEN {op('vault', lit(k), null, null, null)} END"
        for k in ("NEW_HUB", "NEW_LINK")
    )
    both = ", ".join(op(layer, "_a.kind", "_a.attribute", "_a.from_type", "_a.to_type") for layer in ("lake", "vault"))
    return f"concat(array_compact(array({structural})), flatten(transform({atoms}, _a -> array({both}))))"


def build_plan(df: DataFrame) -> DataFrame:
    """Add ``operations`` (array in order) and ``checkpoints`` (1..n) to allowed rows."""
    df = df.withColumn("operations", F.expr(plan_operations()))
    return df.withColumn("checkpoints", F.expr(plan_checkpoints("size(operations)")))


def plan_checkpoints(n: str) -> str:
    return f"CASE WHEN {n} > 0 THEN sequence(1, {n}) ELSE {empty('int')} END"


def _params(op: str, values: dict[str, str]) -> dict[str, str]:
    """Parameters of one kind of operation; a dropped column keeps its old type."""
    if op not in _OP_PARAMS:
        return {"table_name": values["target"]}
    source = {
        "column_name": values["column_name"],
        "logical_type": values["from_type" if op == "DROP_COLUMN" else "to_type"],
        "to_logical_type": values["to_type"],
        "from_logical_type": values["from_type"],
    }
    return {name: source[name] for name in _OP_PARAMS[op]}


def _per_kind(build, kind: str = "kind") -> str:
    whens = " ".join(f"WHEN '{op}' THEN {build(op)}" for op in _OP_PARAMS)
    return f"CASE {kind} {whens} ELSE {build('STRUCTURE')} END"


def full_operations(operations: str = "operations", dataset: str = "dataset_id") -> str:
    """The operations of one plan in its row, each with all that a handler or reader of an event needs:
    idempotency_key, layer, kind, target, params, correlation_id and plan_id.
    """
    plain = {c: f"_o.{c}" for c in ("column_name", "from_type", "to_type")} | {"target": dataset}
    # The target is one for all operations, and is quoted once.
    quoted = {c: f"_q.{c}" for c in plain} | {"target": "_target"}
    kind = "_o.kind"
    params = _per_kind(lambda op: "map(" + ", ".join(f"'{k}', {v}" for k, v in _params(op, plain).items()) + ")", kind)
    key = idempotency_key(
        quoted["target"],
        json_ascii_string("_o.layer"),
        json_ascii_string(kind),
        quoted["target"],
        _per_kind(lambda op: json_ascii_object(_params(op, quoted)), kind),
    )
    texts = struct(**{c: json_ascii_string(v) for c, v in plain.items() if c != "target"})
    whole = struct(
        idempotency_key=let(texts, "_q", key),
        layer="_o.layer",
        kind=kind,
        target=dataset,
        params=params,
        correlation_id="correlation_id",
        plan_id="plan_id",
    )
    return let(json_ascii_string(dataset), "_target", f"transform({operations}, _o -> {whole})")


def explode_operations(df: DataFrame, *keys: str, dataset: str = "dataset_id") -> DataFrame:
    """One row per operation: op_seq, layer, kind, target, params, idempotency_key.

    Keys are hashed after the explode, so hashing runs in generated code per operation.
    """
    kept = list(dict.fromkeys([*keys, dataset]))
    out = unnest(df, kept, "operations", "op_pos", "op").select(
        *kept, (F.col("op_pos") + 1).alias("op_seq"), "op.*", F.col(dataset).alias("target")
    )
    plain = {c: c for c in ("column_name", "from_type", "to_type", "target")}
    quoted = {c: f"_q_{c}" for c in plain}
    params = _per_kind(lambda op: "map(" + ", ".join(f"'{k}', {v}" for k, v in _params(op, plain).items()) + ")")
    key = idempotency_key(
        quoted["target"],
        json_ascii_string("layer"),
        json_ascii_string("kind"),
        quoted["target"],
        _per_kind(lambda op: json_ascii_object(_params(op, quoted))),
    )
    # every text is escaped once, in a projection of its own
    return (
        out.withColumns({quoted[c]: F.expr(json_ascii_string(c)) for c in plain})
        .withColumns({"params": F.expr(params), "idempotency_key": F.expr(key)})
        .drop(*quoted.values())
    )


def operation_summary(operations: str = "operations") -> str:
    """``layer::kind -> count`` of one plan, as a map in the plan's row."""
    entry = struct(key="_n", value="cast(size(filter(_names, _m -> _m = _n)) AS bigint)")
    names = f"transform({operations}, _o -> concat_ws('::', _o.layer, _o.kind))"
    return f"map_from_entries({let(names, '_names', f'transform(array_distinct(_names), _n -> {entry})')})"


def prune_link_ops(operations: DataFrame, probes: DataFrame) -> DataFrame:
    """Drop NEW_LINK operations of datasets without a usable link candidate.

    ``probes``: dataset_id, error_code, candidate_count. A probe that failed, found
    nothing or is absent removes the operation; the plan's checkpoints stay as they are.
    """
    usable = (
        probes.filter(F.coalesce(F.col("error_code"), F.lit("")) == "")
        .filter(F.col("candidate_count") > 0)
        .select(F.col("dataset_id").alias("_probe_id"))
        .distinct()
    )
    is_link = (F.col("layer") == "vault") & (F.col("kind") == "NEW_LINK") & (F.col("target") == F.col("dataset_id"))
    links, rest = operations.filter(is_link), operations.filter(~is_link)
    kept = links.join(usable, links["dataset_id"] == usable["_probe_id"], "left_semi")
    return rest.unionByName(kept)


def flag_already_applied(operations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Add ``already_applied``: whether the operation's key is in the ledger of applied keys."""
    seen = ledger.select("idempotency_key").distinct().withColumn("_seen", F.lit(True))
    return (
        operations.join(seen, "idempotency_key", "left")
        .withColumn("already_applied", F.coalesce("_seen", F.lit(False)))
        .drop("_seen")
    )


def untyped_columns(operations: DataFrame) -> DataFrame:
    """ADD_COLUMN operations whose type is unknown; a handler cannot apply these."""
    return operations.filter((F.col("kind") == "ADD_COLUMN") & F.col("to_type").isNull())
