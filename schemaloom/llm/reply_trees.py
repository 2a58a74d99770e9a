"""Chat formatting of reply trees.

Messages point to the message that they reply to. Self-joins that double their reach at each round
(1, 2, 4, ... replies) give every message its depth and the score of its path, and list the
root-to-leaf paths of the best leaves. Each chosen path becomes one conversation: its rows, in order, are the
formatted turns, each with the place of its loss span. A conversation is not gathered into one row, so its
length is not bounded by memory; its text is its ``piece`` values in the order of ``position``.

Template of a turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and texts a backslash is written as two
and ``<|`` as ``<\\|``, so no text can hold a control string and each text can be read back; a
line feed or percent sign in a role is written as ``%0A`` or ``%25``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.workspace import written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescaped_role(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def chosen_paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """The ``top`` best root-to-leaf paths of each tree: (tree, path, position, node, path_score).

    ``messages``: tree, node (unique within its tree, neither may be null), parent, score (null: 0). A parent
    that is null or not in the tree makes a root. Paths are ranked by the mean score of their messages, then by
    the smaller leaf; ``path`` counts from 1, ``position`` from 0 at the root. Messages on a cycle of
    replies have no root and lie on no path. An empty table has none.

    Round r joins each message with the one 2^r replies above it, so a tree of depth d takes log2(d) rounds;
    only messages that have not reached their root take part. The list of paths comes from the same
    tables the other way round and grows with the paths' length only.
    """
    spark = messages.sparkSession
    own = messages.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    up = own.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    level = written(
        own.join(up, (own["tree"] == up["_t"]) & (own["parent"] == up["_n"]), "left").select(
            "tree", "node", F.col("_n").alias("above"), F.col("score").alias("total"), F.lit(1).cast("bigint").alias("depth")
        ),
        "reply-0",
    )
    jumps = [level]
    nodes = level.count()
    while (1 << (len(jumps) - 1)) < max(nodes, 1):
        level = jumps[-1]
        moving = level.where("above IS NOT NULL")
        if moving.isEmpty():
            break
        target = level.select(
            F.col("tree").alias("_t"),
            F.col("node").alias("_n"),
            F.col("above").alias("_above"),
            F.col("total").alias("_total"),
            F.col("depth").alias("_depth"),
        )
        joined = moving.join(target, (moving["tree"] == target["_t"]) & (moving["above"] == target["_n"]))
        moved = joined.select(
            "tree",
            "node",
            F.col("_above").alias("above"),
            (F.col("total") + F.col("_total")).alias("total"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
        )
        # What has reached its root stays in the table, unjoined: others may jump onto it.
        level = written(moved.unionByName(level.where("above IS NULL")), f"reply-{len(jumps)}")
        jumps.append(level)
    finished = jumps[-1].where("above IS NULL")
    parents = jumps[0].where("above IS NOT NULL").select("tree", F.col("above").alias("node")).distinct()
    leaves = finished.join(parents, ["tree", "node"], "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc("path_score"), "node")
    frontier = written(
        leaves.withColumn("path_score", F.col("total") / F.col("depth"))
        .withColumn("path", F.row_number().over(best))
        .where(F.col("path") <= top)
        .select("tree", "path", "node", "path_score", "depth", F.lit(0).cast("bigint").alias("_back")),
        "reply-paths",
    )
    for r, level in enumerate(jumps[:-1] if len(jumps) > 1 else jumps):
        step = level.where("above IS NOT NULL").select("tree", "node", "above")
        further = (
            frontier.join(step, ["tree", "node"])
            .select("tree", "path", F.col("above").alias("node"), "path_score", "depth", (F.col("_back") + (1 << r)).alias("_back"))
        )
        frontier = written(frontier.unionByName(further), "reply-paths")
    return frontier.select(
        "tree", "path", (F.col("depth") - 1 - F.col("_back")).alias("position"), "node", "path_score"
    )


def formatted(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """Adds ``piece, loss_start, loss_end`` to rows with ``role`` and ``text`` (null: empty).

    The loss span of a turn, in code points of its piece from 0, covers the (escaped) text of a turn whose role
    is ``learn``; other turns have a span of length 0.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), escaped_role(role), F.lit("\n"))
    body = escaped(text)
    return turns.withColumns(
        {
            "piece": F.concat(head, body, F.lit(CLOSE)),
            "loss_start": F.length(head),
            "loss_end": F.length(head) + F.when(role == learn, F.length(body)).otherwise(F.lit(0)),
        }
    )


def read_back(pieces: DataFrame) -> DataFrame:
    """Role, text and the text under the loss span, from ``piece, loss_start, loss_end`` alone."""
    inner = F.expr(f"substring(piece, {len(OPEN) + 1}, length(piece) - {len(OPEN) + len(CLOSE)})")
    cut = F.instr(inner, "\n")
    span = F.substring(F.col("piece"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return pieces.withColumns(
        {
            "role": unescaped_role(F.substring(inner, F.lit(1), cut - 1)),
            "text": unescaped(F.substring(inner, cut + 1, F.length(inner))),
            "loss_text": unescaped(span),
        }
    )


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it, by turn (null first), role, text."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumn("node", F.row_number().over(order).cast("bigint"))
        .select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"),
            "node",
            F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"),
            F.lit(0.0).alias("score"),
            "conv_id",
            "role",
            "text",
        )
    )


def format_trees(messages: DataFrame, top: int = 1) -> DataFrame:
    """Formatted turns of the chosen paths: the columns of ``messages`` and ``path, position, path_score, piece, ...``."""
    paths = chosen_paths(messages, top)
    return formatted(messages.join(paths, ["tree", "node"]))


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation read back from its pieces; the rows stream by in order, whatever their number."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row, turns, loss = None, None, None, None

        def done() -> list:
            return [[*row[:2], turns.hexdigest(), row[2], loss.hexdigest(), row[3]]]

        for batch in batches:
            out = []
            for tree, conv_id, path, role, text, loss_text, chars in zip(
                batch["tree"], batch["conv_id"], batch["path"], batch["role"], batch["text"], batch["loss_text"], batch["chars"]
            ):
                if (tree, path) != key:
                    if key is not None:
                        out += done()
                    key, turns, loss = (tree, path), hashlib.sha256(), hashlib.sha256()
                    row = [None if conv_id is None else int(conv_id), 0, 0, 0]
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(loss_text.encode())
                row[1] += 1
                row[2] += len(loss_text)
                row[3] += chars
            yield framed(out)
        if key is not None:
            yield framed(done())

    def framed(rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"conv_id": "Int64"})

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    columns = [c.split()[0] for c in schema.split(", ")]
    rows = read_back(pieces).select(
        "tree", F.col("conv_id").cast("string"), "path", "position", "role", "text", "loss_text", F.length("piece").alias("chars")
    )
    return rows.repartition("tree", "path").sortWithinPartitions("tree", "path", "position").mapInPandas(stream, schema)
