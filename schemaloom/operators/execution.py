"""Outcome of operations and plans, read from a log of attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.types import STATUS_ALREADY_APPLIED, STATUS_OK, STATUS_PERMANENT_ERROR

# Fixed value: attempts after which an operation is given up.
MAX_ATTEMPTS = 20

_SUCCESS = (STATUS_OK, STATUS_ALREADY_APPLIED)
_TERMINAL = (*_SUCCESS, STATUS_PERMANENT_ERROR)


def op_outcome(attempts: DataFrame, keys=("plan_id",), max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Final status per operation: keys, op_seq, status, attempt, error_code, attempts_used.

    The first OK, ALREADY_APPLIED or PERMANENT attempt decides. Otherwise the retries are
    exhausted: the last attempt that answered (status not null) counts, and if none did the
    operation fails as RETRIES_EXHAUSTED. Only whole numbers are aggregated, so the
    map-side combine runs as a hash aggregate and a hot plan shuffles one row per task
    and operation.
    """
    used = attempts.filter(F.col("attempt").between(1, max_attempts))
    # attempt and status share one number, so the status travels with the chosen attempt
    packed = F.col("attempt").cast("bigint") * 16 + F.col("status")
    grouped = used.groupBy(*keys, "op_seq").agg(
        F.min(F.when(F.col("status").isin(*_TERMINAL), packed)).alias("_first"),
        F.max(F.when(F.col("status").isNotNull(), packed)).alias("_last"),
    )
    chosen = F.coalesce("_first", "_last")
    return grouped.select(
        *keys,
        "op_seq",
        F.coalesce(F.pmod(chosen, F.lit(16)), F.lit(STATUS_PERMANENT_ERROR)).cast("int").alias("status"),
        F.when(chosen.isNotNull(), F.floor(chosen / 16)).cast("int").alias("attempt"),
        F.when(chosen.isNull(), F.lit("RETRIES_EXHAUSTED")).alias("error_code"),
        F.coalesce(F.floor(F.col("_first") / 16), F.lit(max_attempts)).cast("int").alias("attempts_used"),
    )


def first_failures(outcomes: DataFrame, keys=("plan_id",)) -> DataFrame:
    """Position of the first failed operation of each plan that has one."""
    failed = outcomes.filter(~F.col("status").isin(*_SUCCESS))
    return failed.groupBy(*keys).agg(F.min("op_seq").alias("first_failed"))


def abort_cutoff(outcomes: DataFrame, keys=("plan_id",)) -> DataFrame:
    """Keep operations up to and including the first failure of their plan.

    An aggregate and a join instead of a running window: a plan with very many operations
    is combined map-side and its join partition can be split.
    """
    cut = first_failures(outcomes, keys)
    return (
        outcomes.join(cut, list(keys), "left")
        .filter(F.col("first_failed").isNull() | (F.col("op_seq") <= F.col("first_failed")))
        .drop("first_failed")
    )


def execution_result(plans: DataFrame, outcomes: DataFrame, keys=("plan_id",)) -> DataFrame:
    """Per plan: operations with a result, and whether all of them succeeded.

    Plans without operations succeed. Takes uncut outcomes: the number of results follows
    from the position of the first failure.
    """
    per_plan = outcomes.groupBy(*keys).agg(
        F.min(F.when(~F.col("status").isin(*_SUCCESS), F.col("op_seq"))).alias("_failed_at"),
        F.count(F.lit(1)).alias("_n"),
    )
    return plans.join(per_plan, list(keys), "left").select(
        *plans.columns,
        F.coalesce(F.least(F.col("_failed_at").cast("bigint"), F.col("_n")), F.lit(0).cast("bigint")).alias("results"),
        F.col("_failed_at").isNull().alias("successful"),
    )
