"""Ordered replay of notifications against the last accepted header of their dataset.

The header a notification is compared with is not the previous one but the last one that was
allowed and verified, so a dataset's notifications form a fold whose state is one header. The
work is split into what Spark can do for all rows at once and what must go in order:

* Distinct headers get ids. Which (previous, new, policy) steps are allowed is decided once per
  distinct triple, by the same expressions as everywhere else (``diff``, ``policy``).
* A dataset's notifications are cut into segments of ``segment_rows`` positions. A segment is a
  function from the header it starts with to the one it ends with; all of them are computed at once.
* These functions are composed by a parallel prefix scan, a few joins per doubling, which gives
  every segment its true start.
* Each segment is then folded once, on ids, and counts of the segments before it are added.

There is one path, whatever the number of rows. With lineage, some steps depend on the impact of
a change. The same scan, with such steps open both ways, tells which headers each segment may
start with; only impacts that a step can then ask for are looked up, in one traversal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.functions.headers import signature, signature_json
from schemaloom.operators import diff
from schemaloom.operators.lineage import impact_for
from schemaloom.operators.policy import BLOCKED, IMPACT_COLUMNS, guard_looks, policy_case, policy_flags
from schemaloom.sources.policies import policies_frame, select_policy
from schemaloom.workspace import written

SEGMENT_ROWS = 50_000
#: The id of "no header yet"; no header has it.
NO_HEADER = 0


def fold_input(notifications: DataFrame, config: dict) -> DataFrame:
    """dataset_id, seq, raw, attributes, p, verified: all that the replay needs of a notification.

    ``raw`` is an id of the attributes as they are written, ``p`` one of the policy that answers the request. What follows from
    either is worked out once per distinct value.
    """
    df = notifications
    if "verified" not in df.columns:
        df = df.withColumn("verified", F.lit(True))
    return select_policy(df, config).select(
        "dataset_id",
        F.col("seq").cast("bigint").alias("seq"),
        F.xxhash64(F.to_json("attributes")).alias("raw"),
        "attributes",
        F.xxhash64("policy.policy_name").alias("p"),
        F.coalesce("verified", F.lit(True)).alias("verified"),
    )


def dictionary(headers: DataFrame) -> DataFrame:
    """(raw, h, sig) of distinct headers (raw, attributes): ``h`` is the same for headers that no diff tells apart."""
    own = headers.distinct().withColumn("sig", F.expr(f"sort_array({signature('attributes')})"))
    text = F.xxhash64(F.expr(signature_json("sig")))
    own = own.select("raw", "sig", F.when(text == NO_HEADER, F.lit(1).cast("bigint")).otherwise(text).alias("h"))
    # An id of 64 bits that two different headers share would mix them up: an error, not a wrong answer.
    for key in ("raw", "h"):
        one = W.partitionBy(key)
        same = F.min("sig").over(one).eqNullSafe(F.max("sig").over(one))
        own = own.withColumn("sig", F.when(same, F.col("sig")).otherwise(F.raise_error(F.lit("two headers share an id"))))
    return own.distinct()


def decision_table(steps: DataFrame, headers: DataFrame, policies: DataFrame, impact_matters: bool) -> DataFrame:
    """(prev, new, p, answer, changed) for distinct ``steps`` (prev, new, p).

    answer: ``yes`` (allowed), ``ask`` (allowed unless the impact of ``changed`` is in the way) or ``no``. Headers
    are diffed once per distinct pair, whatever the number of datasets and policies.
    """
    shapes = steps.select("prev", "new").distinct()
    prev = headers.select(F.col("h").alias("prev"), F.col("sig").alias("_prev"))
    new = headers.select(F.col("h").alias("new"), F.col("sig").alias("_new"))
    atoms = shapes.join(prev, "prev", "left").join(new, "new").withColumn("atoms", F.expr(diff.diff_signatures("_prev", "_new")))
    flagged = policy_flags(atoms).withColumn("changed", F.expr(diff.changed_attributes("atoms"))).drop("_prev", "_new", "atoms")
    zero = F.lit(0).cast("bigint")
    judged = policy_case(steps.join(flagged, ["prev", "new"]).join(policies, "p").withColumns({c: zero for c in IMPACT_COLUMNS}))
    open_ = F.expr(f"has_atoms AND {guard_looks('policy')}") if impact_matters else F.lit(False)
    answer = F.when(F.col("_case").isin(*BLOCKED), "no").when(open_, "ask").otherwise("yes")
    return judged.select("prev", "new", "p", answer.alias("answer"), F.when(answer == "ask", F.col("changed")).alias("changed"))


def _answered(asked: DataFrame, edges: DataFrame, headers: DataFrame, policies: DataFrame) -> DataFrame:
    """(dataset_id, prev, new, p) of the asked steps that the impact guards let pass. ``asked``: these and ``changed``."""
    found = impact_for(asked.select("dataset_id", "changed"), edges)
    steps = asked.join(found, ["dataset_id", "changed"])
    prev = headers.select(F.col("h").alias("prev"), F.col("sig").alias("_prev"))
    new = headers.select(F.col("h").alias("new"), F.col("sig").alias("_new"))
    shapes = steps.select("prev", "new").distinct().join(prev, "prev", "left").join(new, "new")
    flagged = policy_flags(shapes.withColumn("atoms", F.expr(diff.diff_signatures("_prev", "_new")))).drop("_prev", "_new", "atoms")
    judged = policy_case(steps.join(flagged, ["prev", "new"]).join(policies, "p"))
    return judged.where(~F.col("_case").isin(*BLOCKED)).select("dataset_id", "prev", "new", "p")


def _rules(steps: DataFrame) -> DataFrame:
    """One row per (dataset_id, new, p): the headers from which it is allowed, and those from which it depends on an impact."""
    lists = {n: F.collect_list(F.when(F.col("answer") == n, F.col("prev"))) for n in ("yes", "ask")}
    return steps.groupBy("dataset_id", "new", "p").agg(*[c.alias(n) for n, c in lists.items()])


# --- what runs in tasks: steps on ids ----------------------------------------------------


def _steps(rows: pd.DataFrame, rules: pd.DataFrame) -> Iterator[tuple[int, int, set, set, bool]]:
    """(seq, header, headers from which it is allowed, headers from which that depends on an impact, verified) in order."""
    lists = zip(*(rules[c].tolist() for c in ("raw", "p", "new")), rules["yes"], rules["ask"])
    known = {(raw, p): (new, set(map(int, yes)), set(map(int, ask))) for raw, p, new, yes, ask in lists}
    ordered = rows.sort_values("seq")
    for seq, raw, p, verified in zip(*(ordered[c].tolist() for c in ("seq", "raw", "p", "verified"))):
        yield seq, *known[raw, p], verified


def _named(rules: pd.DataFrame) -> set[int]:
    """Headers that the rules of a segment name; any other stays as it is throughout."""
    return {int(s) for c in ("yes", "ask") for own in rules[c] for s in own} | set(rules["new"].tolist())


def _framed(rows: pd.DataFrame, out: list, columns: list[str], with_segment: bool = True) -> pd.DataFrame:
    frame = pd.DataFrame(out, columns=columns)
    if with_segment:
        frame.insert(0, "seg", int(rows["seg"].iloc[0]))
    frame.insert(0, "dataset_id", rows["dataset_id"].iloc[0])
    return frame


_FUNCTION = "dataset_id string, seg bigint, start bigint, end bigint, n bigint, last bigint"


def _function(rows: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """One segment as a function: for each start the end, how many notifications it accepts, and the last of them.

    Starts that have come to one header go on as one group, so the work per row shrinks to a few headers. A group knows what it
    has accepted, and of each member how much more or less that is.
    """
    live = {s: [0, None, [(s, 0)]] for s in sorted(_named(rules))}
    for seq, new, yes, _, verified in _steps(rows, rules):
        if not verified:
            continue
        groups = [live.pop(s) for s in [s for s in live if s == new or s in yes]]
        if not groups:
            continue
        whole = max(groups, key=lambda g: len(g[2]))
        for g in groups:
            if g is not whole:
                whole[2] += [(s, more + g[0] - whole[0]) for s, more in g[2]]
        whole[0], whole[1] = whole[0] + 1, seq
        live[new] = whole
    out = [(s, end, n + more, last) for end, (n, last, members) in live.items() for s, more in members]
    return _framed(rows, out, ["start", "end", "n", "last"]).astype({"last": "Int64"})


def _either_way(rows: pd.DataFrame, rules: pd.DataFrame, starts: list[int], asked: set | None = None) -> dict[int, int]:
    """Headers that a segment may end with, each with the set (as bits) of the starts that may lead there.

    A step that depends on an impact is taken both ways; ``asked`` gathers these (prev, new, raw, p).
    """
    live = {s: 1 << k for k, s in enumerate(starts)}
    policies = rows.sort_values("seq")["p"].tolist()
    for p, (_, new, yes, ask, verified) in zip(policies, _steps(rows, rules)):
        open_ = [s for s in live if s != new and s in ask]
        if asked is not None:
            asked.update((s, new, p) for s in open_)
        if not verified:
            continue
        arriving = 0
        for s in [s for s in live if s != new and s in yes]:
            arriving |= live.pop(s)
        for s in open_:
            arriving |= live[s]
        if arriving:
            live[new] = live.get(new, 0) | arriving
    return live


def _relation(rows: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    starts = sorted(_named(rules))
    out = [(s, end) for end, bits in _either_way(rows, rules, starts).items() for k, s in enumerate(starts) if bits >> k & 1]
    return _framed(rows, [(*o, 0, None) for o in out], ["start", "end", "n", "last"]).astype({"last": "Int64"})


def _asks(rows: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """(dataset_id, prev, new, p) of the steps of one segment that can depend on an impact."""
    asked: set = set()
    _either_way(rows, rules, sorted({int(s["state"]) for s in rules["starts"].iloc[0]}), asked)
    return _framed(rows, sorted(asked), ["prev", "new", "p"], with_segment=False)


_FOLDED = "dataset_id string, seq bigint, allowed boolean, accepted boolean, previous_seq bigint, n bigint"


def _fold(rows: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    """Decisions of one segment from its start; ``n`` counts what the dataset has accepted before."""
    (start,), out = rules["starts"].iloc[0], []
    at, last, n = start["state"], start["last"], start["n"]
    for seq, new, yes, _, verified in _steps(rows, rules):
        allowed = new == at or at in yes
        accepted = allowed and verified
        out.append((seq, allowed, accepted, last, n))
        if accepted:
            at, last, n = new, seq, n + 1
    return _framed(rows, out, ["seq", "allowed", "accepted", "previous_seq", "n"], with_segment=False).astype({"previous_seq": "Int64"})


def _per_segment(rows: DataFrame, rules: DataFrame, step: Callable, schema: str) -> DataFrame:
    """``step`` on each segment's rows and rules; a segment is of bounded size, whatever its dataset."""
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]

    def call(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if own.empty or known.empty:
            return pd.DataFrame({n: pd.Series([], dtype=object) for n in names})
        return step(own, known.rename(columns={"_raw": "raw", "_p": "p"}))

    # Own names on the right: both sides stem from the same stored table.
    right = rules.withColumnsRenamed({"dataset_id": "_d", "seg": "_s", "raw": "_raw", "p": "_p"})
    return rows.groupBy("dataset_id", "seg").cogroup(right.groupBy("_d", "_s")).applyInPandas(call, schema)


# --- composition of segments -------------------------------------------------------------


def scan(functions: DataFrame, first: DataFrame, segments: int) -> DataFrame:
    """(dataset_id, seg, state, n, last): with what each segment starts; several rows if it may start with several headers.

    functions: dataset_id, seg, start, end, n, last; a start that is not listed stays what it is. first: dataset_id, state.
    ``segments``: how many the largest dataset has. An up-sweep composes neighbours, so level k holds the functions of 2^k
    segments each; the down-sweep hands each first half the start of the whole, and each second half what the first half
    makes of it. Both are equi-joins on (dataset, block, header): no dataset is gathered anywhere.
    """
    keys = {"dataset_id": "_d", "seg": "_s", "start": "_start", "end": "_end", "n": "_n", "last": "_last"}
    after = (F.coalesce("_end", "state").alias("state"), (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("_last", "last").alias("last"))
    here = (F.col("dataset_id") == F.col("_d")) & (F.col("seg") == F.col("_s")) & (F.col("state") == F.col("_start"))
    levels = [functions]
    while 1 << len(levels) < segments:
        halves = levels[-1].withColumns({"seg": F.expr("seg div 2"), "_half": F.col("seg") % 2})
        left = halves.where("_half = 0").withColumnRenamed("end", "state").drop("_half")
        right = halves.where("_half = 1").drop("_half").withColumnsRenamed(keys)
        through = left.join(right, here, "left").select("dataset_id", "seg", "start", *after).withColumnRenamed("state", "end")
        # Headers that the first half leaves alone are moved by the second half only.
        only = right.join(left, (F.col("dataset_id") == F.col("_d")) & (F.col("seg") == F.col("_s")) & (F.col("start") == F.col("_start")), "left_anti")
        only = only.withColumnsRenamed({v: k for k, v in keys.items()})
        levels.append(written(through.unionByName(only).distinct(), "composed"))
    starts = first.select("dataset_id", F.lit(0).cast("bigint").alias("seg"), "state", F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("last"))
    for functions in reversed(levels if segments > 1 else []):
        begin = starts.withColumn("seg", 2 * F.col("seg"))
        second = begin.join(functions.withColumnsRenamed(keys), here, "left").select("dataset_id", (F.col("seg") + 1).alias("seg"), *after)
        starts = written(begin.unionByName(second).distinct(), "starts")
    return starts


def segment_numbers(rows: DataFrame, segment_rows: int) -> DataFrame:
    """(dataset_id, _bucket, seg): ranges of ``segment_rows`` offsets, put together while they hold fewer rows than that.

    ``seq`` is unique per dataset, so a segment holds less than twice as many rows. One row per range that holds any.
    """
    counts = rows.groupBy("dataset_id", F.expr(f"seq div {int(segment_rows)}").alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
    before = W.partitionBy("dataset_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    begin = counts.withColumn("_begin", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    group = F.expr(f"_begin div {int(segment_rows)}")
    # Numbers without gaps, so that neighbours are neighbours in the scan.
    return begin.select("dataset_id", "_bucket", (F.dense_rank().over(W.partitionBy("dataset_id").orderBy(group)) - 1).cast("bigint").alias("seg"))


def replay(
    notifications: DataFrame,
    config: dict,
    edges: DataFrame | None = None,
    initial: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Decision and version of every notification.

    notifications: dataset_id, seq (whole number, unique per dataset), attributes,
    requested_policy and optionally verified. initial: dataset_id, attributes, version of the
    registry's latest headers. Without ``edges`` no change has an impact.

    Result: dataset_id, seq, allowed, accepted, previous_seq (the accepted notification it was
    compared with; null if none in this input), previous_version, new_version.

    The decision table has a row per dataset, policy and pair of its distinct headers, of which a dataset
    has few beside its notifications; steps from headers that were never verified are left out.
    """
    whole = written(fold_input(notifications, config), "fold-input")
    numbers = written(segment_numbers(whole, segment_rows), "segments")
    bucket = whole.withColumn("_bucket", F.expr(f"seq div {int(segment_rows)}"))
    rows = bucket.join(numbers, ["dataset_id", "_bucket"]).select("dataset_id", "seg", "seq", "raw", "p", "verified")
    segments = (numbers.agg(F.max("seg")).head()[0] or 0) + 1

    kinds = rows.groupBy("dataset_id", "seg", "raw", "p").agg(F.max("verified").alias("verified"))
    known = whole.select("raw", "attributes")
    if initial is not None:
        initial = initial.withColumn("raw", F.xxhash64(F.to_json("attributes")))
        known = known.unionByName(initial.select("raw", "attributes"))
    names = written(dictionary(known), "headers")
    used = written(kinds.join(names.select("raw", F.col("h").alias("new")), "raw"), "kinds")
    first = _first_states(numbers, initial, names)
    headers = names.select("h", "sig").distinct()
    policies = policies_frame(whole.sparkSession, config)
    policies = policies.select(F.xxhash64("policy_name").alias("p"), F.struct(*policies.columns).alias("policy"))

    before = used.where("verified").select("dataset_id", F.col("new").alias("prev")).unionByName(first.select("dataset_id", F.col("state").alias("prev")))
    steps = used.select("dataset_id", "new", "p").distinct().join(before.distinct(), "dataset_id").where("prev <> new")
    table = decision_table(steps.select("prev", "new", "p").distinct(), headers, policies, edges is not None)
    decided = written(steps.join(table, ["prev", "new", "p"]).where("answer <> 'no'"), "decided")

    def by_segment(answers: DataFrame) -> DataFrame:
        """Rules of each segment: one row for each (raw, p) in it."""
        none = F.array().cast("array<bigint>")
        found = used.drop("verified").join(_rules(answers), ["dataset_id", "new", "p"], "left")
        return found.withColumns({c: F.coalesce(c, none) for c in ("yes", "ask")})

    def with_starts(rules: DataFrame, step: Callable) -> DataFrame:
        functions = None
        if segments > 1:
            # Nothing asks what the last segment of a dataset makes of its start.
            last = numbers.groupBy("dataset_id").agg(F.max("seg").alias("_last"))
            functions = written(_per_segment(rows.join(last, "dataset_id").where("seg < _last").drop("_last"), rules, step, _FUNCTION), "functions")
        starts = scan(functions, first, segments)
        lists = starts.groupBy("dataset_id", "seg").agg(F.collect_set(F.struct("state", "n", "last")).alias("starts"))
        return rules.join(lists, ["dataset_id", "seg"])

    rules = by_segment(decided)
    if edges is not None:
        ask = _per_segment(rows, with_starts(rules, _relation), _asks, "dataset_id string, prev bigint, new bigint, p bigint")
        asked = written(ask.distinct().join(decided.where("answer = 'ask'").drop("answer"), ["dataset_id", "prev", "new", "p"]), "asked")
        passed = _answered(asked, edges, headers, policies).withColumn("answer", F.lit("yes"))
        rules = by_segment(written(decided.where("answer = 'yes'").drop("changed").unionByName(passed), "answered"))
    folded = _per_segment(rows, with_starts(rules, _function), _fold, _FOLDED)
    based = folded.join(first.select("dataset_id", F.col("version").alias("_base")), "dataset_id")
    version = (F.col("_base") + F.col("n")).cast("bigint")
    return based.select(
        "dataset_id",
        "seq",
        "allowed",
        "accepted",
        "previous_seq",
        F.when(version > 0, version).alias("previous_version"),
        F.when(F.col("accepted"), version + 1).alias("new_version"),
    )


def _first_states(numbers: DataFrame, initial: DataFrame | None, names: DataFrame) -> DataFrame:
    """dataset_id, state, version of every dataset in the input."""
    ids = numbers.where("seg = 0").select("dataset_id").distinct()
    none, zero = F.lit(NO_HEADER).cast("bigint"), F.lit(0).cast("bigint")
    if initial is None:
        return ids.select("dataset_id", none.alias("state"), zero.alias("version"))
    known = initial.select("dataset_id", "raw", F.col("version").cast("bigint").alias("version")).join(names.select("raw", "h"), "raw")
    return ids.join(known, "dataset_id", "left").select(
        "dataset_id", F.coalesce("h", none).alias("state"), F.coalesce("version", zero).alias("version")
    )
