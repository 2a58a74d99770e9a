"""Stateful replay: the last accepted header per dataset lives in the stream's state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from schemaloom.functions.headers import strip_technical
from schemaloom.functions.headers import signature, signature_json
from schemaloom.functions.typenames import WIDENING_PAIRS
from schemaloom.sources.notifications import parse, split_valid, validate
from schemaloom.sources.policies import select_policy

RESULT = (
    "dataset_id string, seq bigint, allowed boolean, accepted boolean, previous_seq bigint, "
    "previous_version bigint, new_version bigint"
)
STATE = "sig string, seq bigint, version bigint"


_POLICY_FIELDS = [
    "allow_drop",
    "change_mode",
    "impact_mode",
    "max_impacted_total",
    "max_impacted_lake_tables",
    "max_impacted_vault_objects",
    "max_impacted_transformations",
    "block_on_any_impact",
]
_WIDENING = frozenset(WIDENING_PAIRS)


class Transitions:
    """Decides single steps "header a accepted, header b arrives", remembering each answer."""

    def __init__(self, impacts: dict[str, list[int]] | None):
        self.impacts = impacts
        self._headers: dict[str | None, dict] = {None: {}}
        self._known: dict[tuple, bool | str] = {}

    def _header(self, sig):
        if sig not in self._headers:
            self._headers[sig] = {a["n"]: (a.get("t"), a["f"]) for a in json.loads(sig)}
        return self._headers[sig]

    def __call__(self, prev: str | None, new: str, policy: str) -> bool | str:
        """True or False, or the key of an impact that must be known first."""
        at = (prev, new, policy)
        if at not in self._known:
            self._known[at] = self._decide(self._header(prev), self._header(new), json.loads(policy))
        return self._known[at]

    def _decide(self, prev, new, p):
        added, dropped = new.keys() - prev.keys(), prev.keys() - new.keys()
        changed = [
            n for n in new.keys() & prev.keys() if prev[n][0] and new[n][0] and prev[n][0] != new[n][0]
        ]
        if not (added or dropped or changed):
            return True
        if dropped and not p["allow_drop"]:
            return False
        if changed and p["change_mode"] == "none":
            return False
        if changed and p["change_mode"] == "widen":
            for n in changed:
                a, b = prev[n][1], new[n][1]
                if a != b and f"{a}>{b}" not in _WIDENING:
                    return False
        if self.impacts is None or p["impact_mode"] == "off":
            return True
        if p["impact_mode"] == "breaking_only" and not dropped and not changed:
            return True
        key = json.dumps(sorted({*added, *dropped, *changed}), ensure_ascii=False)
        if key not in self.impacts:
            return key
        lake, vault, xforms = self.impacts[key]
        total = lake + vault + xforms
        if total <= 0:
            return True
        caps = [
            ("max_impacted_total", total),
            ("max_impacted_lake_tables", lake),
            ("max_impacted_vault_objects", vault),
            ("max_impacted_transformations", xforms),
        ]
        over = any(p.get(c) is not None and n > p[c] for c, n in caps)
        return not (over or p["block_on_any_impact"])


def fold_rows(rows: pd.DataFrame, sig, seq, version: int, decide: Transitions) -> tuple[pd.DataFrame, tuple]:
    """Run the fold over rows in order; returns one result per row and the end state."""
    out = []
    for r in rows.sort_values("seq").itertuples(index=False):
        allowed = decide(sig, r.sig, r.policy)
        if not isinstance(allowed, bool):
            raise ValueError(f"impact of {allowed} is not known")
        accepted = allowed and bool(r.verified)
        out.append((r.dataset_id, r.seq, allowed, accepted, seq, version))
        if accepted:
            sig, seq, version = r.sig, r.seq, version + 1
    columns = ["dataset_id", "seq", "allowed", "accepted", "previous_seq", "previous_accepted"]
    frame = pd.DataFrame(out, columns=columns).astype({"previous_seq": "Int64"})
    return frame, (sig, seq, version)


def policy_json(policy: Column) -> Column:
    return F.to_json(F.struct(*[policy[c].alias(c) for c in _POLICY_FIELDS]))


def fold_input(notifications: DataFrame, config: dict) -> DataFrame:
    """dataset_id, seq, sig, policy, verified: all that the fold needs of a notification."""
    df = notifications
    if "verified" not in df.columns:
        df = df.withColumn("verified", F.lit(True))
    df = select_policy(df, config)
    return df.select(
        "dataset_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.expr(signature_json(signature("attributes"))).alias("sig"),
        policy_json(F.col("policy")).alias("policy"),
        F.coalesce("verified", F.lit(True)).alias("verified"),
    )


def check_log(log: DataFrame) -> DataFrame:
    """Validation plus a rejection of null dataset ids, which cannot be replayed."""
    checked = validate(log)
    null_id = F.get_json_object("value", "$.dataset.id").isNull()
    return checked.withColumn("error", F.when(F.col("error").isNull() & null_id, "Null dataset.id").otherwise(F.col("error")))


def log_to_notifications(log: DataFrame) -> DataFrame:
    """Valid notifications of a message log (offset, value) in the shape that the replay takes.

    An optional boolean column ``verified`` of the log is kept. An id that is present but null
    passes validation, yet belongs to no dataset; see ``check_log`` for where it goes.
    """
    valid, _ = split_valid(check_log(log))
    verified = [c for c in log.columns if c == "verified"]
    return parse(valid).select(
        F.col("dataset.id").alias("dataset_id"),
        F.col("offset").cast("bigint").alias("seq"),
        F.coalesce("dataset.source", F.lit("")).alias("source"),
        F.expr(strip_technical("header.attributes")).alias("attributes"),
        F.col("header.primary_key").alias("primary_key"),
        F.col("header.schema_fingerprint").alias("schema_fingerprint"),
        F.col("previous_schema_version").cast("bigint").alias("producer_version"),
        F.col("metadata")["policy"].alias("requested_policy"),
        *verified,
    )


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    sig, seq, version = state.get if state.exists else (None, None, 0)
    # one trigger's rows of one dataset; the source's rate limit bounds them
    rows = pd.concat(list(batches), ignore_index=True)
    out, end = fold_rows(rows, sig, seq, version, Transitions(None))
    state.update(end)
    base = out.pop("previous_accepted")
    out["previous_version"] = base.where(base > 0).astype("Int64")
    out["new_version"] = (base + 1).where(out["accepted"]).astype("Int64")
    yield out


def replay_stream(notifications: DataFrame, config: dict) -> DataFrame:
    """Decisions of a stream of notifications, in log order per dataset, without lineage.

    State is one header per dataset. Each trigger's rows of a dataset are sorted by offset, so
    the source must deliver a dataset's messages in order across triggers, as a log partition
    keyed by dataset does; the rate limit of the source bounds the rows held at once.
    """
    rows = fold_input(notifications, config)
    return rows.groupBy("dataset_id").applyInPandasWithState(
        _step, RESULT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def run_replay(notifications: DataFrame, config: dict, out: str, checkpoint: str) -> None:
    """Process all input available now and append the decisions to ``out`` as parquet."""
    query = (
        replay_stream(notifications, config)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
