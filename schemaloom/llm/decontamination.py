"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

Benchmark items are cut into windows of consecutive words. The index stores where the rarest words of those
windows stand in the training documents; each further list of a window is intersected, moved by the distance of
its word, starting from the rarest. What is left is compared word by word with the words
around the rarest one, which its posting carries. Texts are never shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from schemaloom.llm.tables import packed, unpacked
from schemaloom.workspace import written

#: Everything that is not in a word, after A-Z is lowered.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Lists that are intersected for each window: its rarest words.
LISTS = 3
#: Distinct words of windows, and bytes of them, up to which their list is broadcast; beyond, it is joined by shuffle.
BROADCAST_TERMS, BROADCAST_BYTES = 200_000, 8 << 20

KEY = ("_id", "_hash")


def words(text: str | Column) -> Column:
    """Words of a whole text, A-Z lowered; none for null."""
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BETWEEN_WORDS), "")


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """Rows with the key (_id, _hash of the text): equal rows share a key and get equal answers."""
    return packed(docs, _id=id_column, _hash=F.xxhash64(F.col(f"`{text}`")), _text=text)


def _small(terms: DataFrame) -> DataFrame:
    """A table of words, with a broadcast hint only if its counted size allows it."""
    terms = written(terms, "terms")
    size = terms.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("bytes")).head()
    return F.broadcast(terms) if size.n <= BROADCAST_TERMS and size.bytes <= BROADCAST_BYTES else terms


def frequencies(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, frequency): how often each of the terms stands in all texts; terms that never do are missing."""
    every = docs.select(F.explode(words(text)).alias("term"))
    return every.join(_small(terms), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))


def postings(docs: DataFrame, terms: DataFrame, around: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The index: (term, _id, _hash, pos, near, near_from) for each place of each term in whole texts.

    ``terms``: term, with_near. Where ``with_near`` holds, ``near`` has the words from ``around`` before to ``around``
    after the place, starting at position ``near_from``.
    """
    rows = _keyed(docs, id_column, text).select(*KEY, words("_text").alias("_words"))
    places = rows.select(*KEY, "_words", F.posexplode("_words").alias("pos", "term"))
    begin = F.greatest(F.col("pos") - around, F.lit(0))
    found = places.join(_small(terms), "term")
    return found.select(
        "term",
        *KEY,
        "pos",
        F.when(F.col("with_near"), F.slice("_words", begin + 1, F.lit(2 * around + 1))).alias("near"),
        begin.alias("near_from"),
    )


def windows_of(items: DataFrame, length: int = 13, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct windows (window_words, items): ``items`` are the ids, as strings, of the items that hold it.

    An item of fewer words than ``length``, but not none, is one window. Null and empty items have none. Items without an id
    have windows like any other, but name nobody.
    """
    rows = items.select(F.col(f"`{id_column}`").cast("string").alias("item"), words(F.col(f"`{text}`")).alias("w"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (length - 1), F.lit(1)))
    pieces = rows.where(F.size("w") > 0).select(
        "item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(length)))).alias("window_words")
    )
    return pieces.groupBy("window_words").agg(F.collect_set("item").alias("items"))


def phrase_matches(
    docs: DataFrame, phrases: DataFrame, *, longest: int = 13, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """All exact occurrences (_id, _hash, start, length, phrase) of phrases, given as arrays of words, in documents.

    ``phrases``: phrase (unique), phrase_words (1 to ``longest`` words). ``start`` counts words from 0.
    """
    phrases = written(phrases.select("phrase", "phrase_words"), "phrases")
    terms = phrases.select("phrase", F.posexplode("phrase_words").alias("offset", "term"))
    counts = written(frequencies(docs, terms.select("term").distinct(), text), "frequencies")
    # A phrase with a word that stands nowhere cannot occur.
    ranked = terms.join(counts, "term").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct("frequency", "offset", "term"))).alias("rarest")
    )
    plans = written(
        phrases.join(ranked, "phrase")
        .where(F.size("rarest") == F.size("phrase_words"))
        .select("phrase", "phrase_words", F.slice("rarest", 1, LISTS).alias("rarest")),
        "plans",
    )
    used = (
        plans.select(F.posexplode("rarest").alias("list", "r"))
        .groupBy(F.col("r.term").alias("term"))
        .agg((F.min("list") == 0).alias("with_near"))
    )
    index = written(postings(docs, used, longest - 1, id_column, text), "postings")
    first = plans.select("phrase", "phrase_words", "rarest", F.col("rarest")[0]["term"].alias("term"))
    found = index.where("near IS NOT NULL").join(first, "term")
    found = found.withColumn("start", F.col("pos") - F.col("rarest")[0]["offset"]).where("start >= near_from")
    for n in range(1, LISTS):
        lists = index.select("term", *KEY, "pos").withColumnsRenamed({"term": "_term", "_id": "_i", "_hash": "_h", "pos": "_pos"})
        # Phrases of fewer words have no such list and keep what they have.
        short = found.where(F.size("rarest") <= n)
        at = F.get("rarest", F.lit(n))
        met = found.where(F.size("rarest") > n).join(
            lists,
            (at["term"] == F.col("_term"))
            & F.col("_id").eqNullSafe(F.col("_i"))
            & (F.col("_hash") == F.col("_h"))
            & ((F.col("start") + at["offset"]) == F.col("_pos")),
            "left_semi",
        )
        found = met.unionByName(short)
    same = F.slice("near", F.col("start") - F.col("near_from") + 1, F.size("phrase_words")) == F.col("phrase_words")
    return found.where(same).select(*KEY, "start", F.size("phrase_words").alias("length"), "phrase")


def proximity_matches(index: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """Places (query, _id, _hash, pos) of the rarest term of a query around which all its terms stand.

    ``index`` from ``postings``; ``queries``: query, term (each pair once). All terms must stand within
    ``within`` words of ``pos``. Positions are cut into buckets of that width, so only neighbours are joined.
    """
    sizes = index.groupBy("term").agg(F.count(F.lit(1)).alias("frequency"))
    known = queries.join(sizes, "term", "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))
    rarest = known.groupBy("query").agg(F.min_by("term", F.struct("frequency", "term")).alias("term"), F.count(F.lit(1)).alias("terms"))
    bucket = F.expr(f"pos div {int(within) + 1}")
    anchors = index.join(rarest, "term").select("query", "terms", *KEY, "pos", F.explode(F.array(*[bucket + d for d in (-1, 0, 1)])).alias("_b"))
    others = index.join(queries, "term").select(
        F.col("query").alias("_q"), "term", F.col("_id").alias("_i"), F.col("_hash").alias("_h"), F.col("pos").alias("_p"), bucket.alias("_pb")
    )
    met = anchors.join(
        others,
        (F.col("query") == F.col("_q")) & F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")) & (F.col("_b") == F.col("_pb")),
    ).where(F.abs(F.col("pos") - F.col("_p")) <= within)
    return (
        met.select("query", "terms", *KEY, "pos", "term").distinct()
        .groupBy("query", "terms", *KEY, "pos")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n = terms")
        .select("query", *KEY, "pos")
    )


def contamination(
    docs: DataFrame, items: DataFrame, *, length: int = 13, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id"
) -> DataFrame:
    """``docs`` with ``n_words, n_hit, hit_items`` (sorted array of item ids as strings) and ``contaminated``.

    A word is hit if it lies in an occurrence of a window of an item; a document is contaminated if it
    has a hit and 20 times its hits reach its words. Null and empty texts have no words and are clean. Items
    without words match nothing, items without an id hit words but are not named; with no items every document is clean. Input columns of these
    names are replaced, all others kept; equal rows get equal answers.
    """
    windows = written(windows_of(items, length, item_id).withColumn("phrase", F.monotonically_increasing_id()), "windows")
    hits = written(
        phrase_matches(
            docs,
            windows.select("phrase", F.col("window_words").alias("phrase_words")),
            longest=length,
            id_column=id_column,
            text=text,
        ),
        "hits",
    )
    spans = hits.groupBy(*KEY, "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = W.partitionBy(*KEY).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(F.max("end").over(before), F.lit(0))))
    covered = spans.withColumn("_fresh", fresh).groupBy(*KEY).agg(F.sum("_fresh").alias("_hit"))
    named = (
        hits.select(*KEY, "phrase").distinct()
        .join(windows.select("phrase", F.explode("items").alias("item")), "phrase")
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("item")).alias("_items"))
    )
    found = covered.join(named, covered["_id"].eqNullSafe(named["_id"]) & (covered["_hash"] == named["_hash"]), "left").select(
        covered["_id"].alias("_i"), covered["_hash"].alias("_h"), "_hit", "_items"
    )
    found = written(found, "found")
    rows = _keyed(docs, id_column, text).withColumn("n_words", F.size(words("_text")).cast("bigint")).drop("_text")
    judged = rows.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    hit = F.coalesce("_hit", F.lit(0)).cast("bigint")
    judged = judged.withColumns(
        {
            "n_hit": hit,
            "hit_items": F.coalesce("_items", F.array().cast("array<string>")),
            "contaminated": (hit > 0) & (20 * hit >= F.col("n_words")),
        }
    )
    return unpacked(judged, "n_words", "n_hit", "hit_items", "contaminated")


def clean(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    own = packed(docs, doc_id="doc_id", text="text")
    return contamination(own, items, **how).where("NOT contaminated").select(
        *[F.col("_row").getField(c).alias(c) for c in docs.columns]
    )
