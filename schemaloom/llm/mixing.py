"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.llm.tables import packed, unpacked
from schemaloom.workspace import written

#: A word, as sizes count it.
WORD = r"[^\x20\x09-\x0D]+"
#: The draw of a row has 60 bits; its first 12 deal the rows of a source into buckets.
_BUCKET = 1 << 48


def size_of(text: str) -> Column:
    """Number of words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """Targets of sources: (source, source_size) gains ``target``.

    Sources get ``weights`` in turn, by code point, null last. They share ``share`` of all words by
    weight; a source stops at ``max_epochs`` times its size and its excess is dealt to the others by
    weight, again and again. The fixed point of these rounds is a water level: with the sources in
    ascending order of cap per weight, the first k stop, where k is the first position at which the
    level that is left fits below the next cap. One row per source, so these windows are small.
    """
    table = ", ".join(f"{float(w)!r}D" for w in weights)
    ranked = sizes.select(
        "source",
        "source_size",
        F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())).alias("_rank"),
    ).withColumn("_weight", F.expr(f"element_at(array({table}), CAST((_rank - 1) % {len(weights)} AS INT) + 1)"))
    capped = ranked.withColumn("_cap", F.lit(float(max_epochs)) * F.col("source_size"))
    everything = W.partitionBy()
    order = W.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    levels = capped.select(
        "*",
        F.row_number().over(order).alias("_by_cap"),
        (F.lit(float(share)) * F.sum("source_size").over(everything)).alias("_budget"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_stopped"),
        F.sum("_weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("_open"),
    ).withColumn("_level", F.greatest(F.lit(0.0), F.col("_budget") - F.col("_stopped")) / F.col("_open"))
    # Levels fall until the first source that does not stop; from there on that level is the one.
    free = F.col("_cap") >= F.col("_level") * F.col("_weight")
    level = F.min(F.when(free, F.struct("_by_cap", "_level"))).over(everything)["_level"]
    return (
        levels.withColumn("_final", level).select(
            "source",
            "source_size",
            F.when(F.col("_final").isNull(), F.col("_cap"))
            .otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("_weight")))
            .alias("target"),
        )
    )


def mix(
    docs: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 0,
    id_column: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with ``mix_size, mix_source_size, mix_target, mix_repeats``.

    Every document is taken ``floor(target / size of its source)`` times. For the fraction, the rows of a
    source are put in the order of a hash of (seed, id, size, text); those are taken once more whose middle lies
    below the fraction in words, and of rows that repeat an id and its text as many as do. So the words taken differ
    from the target by half a document at most. Reruns agree: nothing depends on partitions.

    Running sums go over 4,096 buckets of the hash per source; only the bucket in which the cut lies is
    sorted, so a source with a third of all rows is not gathered. Texts are not shuffled: what comes back
    to them is one row per source, and the planner broadcasts it if it is small.

    Null ids, texts and sources: the null source is a source of its own, a null text has no words, null ids
    count as one id. A source without words has target 0 and its rows are taken 0 times. No rows: none.
    Other columns are kept whatever their names are.
    """
    draw = F.expr(
        f"CAST(conv(substring(md5(concat('{seed}:', coalesce(CAST(_id AS STRING), ''), ':', mix_size, ':', coalesce(_text, ''))), 1, 15),"
        " 16, 10) AS BIGINT)"
    )
    drawn = packed(docs, source=source, mix_size=size_of(text), _id=id_column, _text=text).withColumn("_draw", draw).drop("_id", "_text")
    rows = written(drawn.select("source", F.col("mix_size").alias("_size"), "_draw"), "mix")
    targets = written(
        water_fill(rows.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, share, max_epochs),
        "targets",
    )
    # The whole part may be rounded to a hair's breadth below; such a fraction takes all rows once more.
    plan = targets.withColumn(
        "_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("_part", F.col("target") - F.col("_whole") * F.col("source_size"))

    bucket = F.expr(f"_draw div {_BUCKET}")
    buckets = rows.groupBy("source", bucket.alias("_b")).agg(F.sum("_size").alias("_words"))
    running = W.partitionBy("source").orderBy("_b")
    buckets = buckets.withColumn("_end", F.sum("_words").over(running)).withColumn(
        "_begin", F.col("_end") - F.col("_words")
    )
    same = buckets["source"].eqNullSafe(plan["source"])
    cut = (
        buckets.join(plan, same)
        .where((F.col("_begin") <= F.col("_part")) & (F.col("_part") < F.col("_end")))
        .select(buckets["source"].alias("_cut_source"), F.col("_b").alias("_cut_bucket"), "_begin", "_part")
        # Buckets without words may begin and end at the same place; the last one holds the cut.
        .groupBy("_cut_source")
        .agg(F.max(F.struct("_cut_bucket", "_begin", "_part")).alias("_at"))
        .select("_cut_source", "_at.*")
    )
    before = W.partitionBy("_cut_source").orderBy("_draw").rowsBetween(W.unboundedPreceding, -1)
    # Of n rows of one draw and size s, the j-th has its middle (j - 1/2) s behind what comes before them.
    fits = F.expr("CASE WHEN _s > 0 THEN greatest(0, least(_n, floor((2 * (_part - _before) + _s) / (2 * _s)))) ELSE _n END")
    inside = (
        rows.join(cut, rows["source"].eqNullSafe(cut["_cut_source"]) & (bucket == F.col("_cut_bucket")))
        .groupBy("_cut_source", "_cut_bucket", "_begin", "_part", "_draw")
        .agg(F.sum("_size").alias("_words"), F.max("_size").alias("_s"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.col("_begin") + F.coalesce(F.sum("_words").over(before), F.lit(0)))
        .withColumn("_fit", fits.cast("bigint"))
        .groupBy("_cut_source")
        .agg(
            F.max(F.when(F.col("_fit") == F.col("_n"), F.col("_draw"))).alias("_last"),
            F.min(F.when((F.col("_fit") > 0) & (F.col("_fit") < F.col("_n")), F.struct("_draw", "_fit"))).alias("_tie"),
        )
    )
    limits = (
        plan.join(cut, plan["source"].eqNullSafe(cut["_cut_source"]), "left")
        .drop("_cut_source", "_begin")
        .drop(cut["_part"])
        .alias("p")
        .join(inside, F.col("p.source").eqNullSafe(F.col("_cut_source")), "left")
        .select(
            F.col("p.source").alias("_m_source"),
            F.col("source_size").alias("_m_size"),
            F.col("target").alias("_m_target"),
            F.col("_whole").alias("_m_whole"),
            # The last draw that is taken: within the cut bucket, else the end of the bucket before it.
            F.when(plan["_part"] <= 0, F.lit(-1))
            .when(F.col("_cut_bucket").isNull(), F.lit((1 << 60) - 1))
            .otherwise(F.coalesce("_last", F.col("_cut_bucket") * F.lit(_BUCKET) - 1))
            .cast("bigint")
            .alias("_m_last"),
            F.when(plan["_part"] > 0, F.col("_tie._draw")).alias("_m_tie"),
            F.col("_tie._fit").alias("_m_fit"),
        )
    )
    limits = written(limits, "limits")
    joined = drawn.join(limits, drawn["source"].eqNullSafe(limits["_m_source"])).withColumns(
        {
            "mix_source_size": F.col("_m_size"),
            "mix_target": F.col("_m_target"),
            "mix_repeats": F.col("_m_whole") + (F.col("_draw") <= F.col("_m_last")).cast("bigint"),
        }
    )
    added = ("mix_size", "mix_source_size", "mix_target", "mix_repeats")
    if limits.where("_m_tie IS NOT NULL").isEmpty():
        return unpacked(joined, *added)
    tied = F.coalesce(F.col("_draw") == F.col("_m_tie"), F.lit(False))
    # Rows of such a draw are copies of a few: they are counted, and each copy gets a number.
    kinds = joined.where(tied).groupBy("_row", "_m_source", "_m_fit", *added).agg(F.count(F.lit(1)).alias("_n"))
    order = W.partitionBy("_m_source").orderBy(F.sha2(F.to_json("_row"), 256)).rowsBetween(W.unboundedPreceding, -1)
    numbered = kinds.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0))).withColumn("_copy", F.explode(F.expr("sequence(1L, _n)")))
    once_more = (F.col("_before") + F.col("_copy") <= F.col("_m_fit")).cast("bigint")
    copies = numbered.withColumn("mix_repeats", F.col("mix_repeats") + once_more)
    return unpacked(joined.where(~tied).select("_row", *added).unionByName(copies.select("_row", *added)), *added)


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    times = F.explode(F.expr("sequence(1L, mix_repeats)"))
    return mixed.where("mix_repeats > 0").select(*[f"`{c}`" for c in columns], times.alias("_copy")).drop("_copy")
