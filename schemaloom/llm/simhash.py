"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint of 64 bits is cut into four blocks of 16. Two fingerprints that differ in two bits or fewer agree
on at least two whole blocks, so they meet under one of the six pairs of blocks. Blocks are joined on, and
the distance of those that meet is verified. Copies are merged before: all steps after the first work on
distinct fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.tables import packed, released
from schemaloom.workspace import folders, forget, swept, written

BITS, BLOCKS = 64, 4
#: Fingerprints under one pair of blocks that are compared with one another; more are split again.
CROWD = 32
#: Sets under one shingle that one task compares with all others there, and leaders of a crowd that all others are compared with first.
SALTED, LEADERS = 2000, 4
#: One member of so many is looked at beyond the prefix, to leave out sets that share too few with any other.
MORE = 10


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a whole text, A-Z lowered, in order; fewer words make one shingle, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    if len(words) <= size:
        shingles = [joined]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[: len(words) - size + 1].tolist()
        shingles = map(joined.__getitem__, map(slice, starts, (ends[size - 1 :] - 1).tolist()))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], "<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """64 bits, lowest first: which are set in over half of the hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        full = np.zeros(-(-len(part) // 255) * 255, "<u8")
        full[: len(part)] = part
        bits = np.unpackbits(full.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # Up to 255 rows are summed in bytes, then those sums.
        total += bits.reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return (2 * total > len(hashes)).astype(np.uint8)


def fingerprint(text: str | None, size: int) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    return int(np.packbits(majority(shingle_hashes(text, size)), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, size: int = 3, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint): shingles of ``size`` words, A-Z lowered, repeats counted; bigint with the sign of bit 63."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch["text"]], np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fingerprint": found.view(np.int64)})

    rows = docs.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, "id string, fingerprint bigint").select(F.col("id").cast("bigint").alias("id"), "fingerprint")


def close_pairs(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``distance`` (2 only).

    Under each pair of blocks, a small crowd is joined with itself and verified. A crowd of more than ``CROWD``
    would need a join that is quadratic in its size: it is split again, by the points that lie one bit off its
    members in their other 32 bits. Two members within two bits share such a point (or one is the
    other's), members of one point are within two bits, and each is linked to the point's least member only.
    """
    width = BITS // BLOCKS
    if distance != 2:
        # Members of one point are within two bits, so a smaller distance would lose links in crowds.
        raise ValueError("pairs are found within 2 bits")

    def block(n: int) -> Column:
        return F.shiftright("fingerprint", n * width).bitwiseAND(F.lit((1 << width) - 1))

    keys = [
        F.struct(F.lit(n).alias("which"), (block(i) * F.lit(1 << width) + block(j)).alias("block"))
        for n, (i, j) in enumerate(_pairs())
    ]
    keyed = written(distinct.select("fingerprint", F.explode(F.array(*keys)).alias("k")).select("k.*", "fingerprint"), "blocks")
    crowds = keyed.groupBy("which", "block").agg(F.count(F.lit(1)).alias("crowd")).where("crowd > 1")
    met = written(keyed.join(crowds, ["which", "block"]), "crowds")
    few = met.where(F.col("crowd") <= CROWD)
    other = few.select("which", "block", F.col("fingerprint").alias("b"))
    near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("b"))) <= distance
    joined = few.join(other, ["which", "block"]).where((F.col("fingerprint") < F.col("b")) & near)
    pairs = joined.select(F.col("fingerprint").alias("a"), "b")

    many = met.where(F.col("crowd") > CROWD)
    flips = {
        n: [0, *(1 << bit for b in range(BLOCKS) if b not in pair for bit in range(b * width, (b + 1) * width))]
        for n, pair in enumerate(_pairs())
    }
    masks = F.create_map(*[x for n, m in flips.items() for x in (F.lit(n), F.array(*[F.lit(_signed(v)).cast("bigint") for v in m]))])
    points = many.select(
        "which", "block", "fingerprint", F.explode(F.element_at(masks, F.col("which"))).alias("mask")
    ).select("which", "block", "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("mask")).alias("point"))
    least = points.groupBy("which", "block", "point").agg(F.min("fingerprint").alias("least"), F.count(F.lit(1)).alias("n"))
    # The point itself may be a member that is one bit off the others: then all lie within two bits as well.
    stars = (
        points.join(least.where("n > 1"), ["which", "block", "point"])
        .where("fingerprint <> least")
        .where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("least"))) <= distance)
        .select(F.col("least").alias("a"), F.col("fingerprint").alias("b"))
    )
    return pairs.unionByName(stars).distinct()


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >> 63 else v


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the least node of the component; only nodes that have a link.

    Alternating large and small stars: each node links its larger neighbours, then its smaller ones, to
    the least node it knows. A round is two aggregates, each joined back; nothing gathers a node's neighbours. The
    edges of each round are written, and the loop ends when a round changes nothing.
    """
    edges = written(links.select("a", "b").where("a <> b"), "links")
    seen = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(lowest, "a")
            .select(F.col("m").alias("a"), "b")
            .where("a <> b")
            .unionByName(lowest.select(F.col("m").alias("a"), F.col("a").alias("b")))
            .distinct()
        )
        edges = written(small, "small")
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == seen:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = mark


def near_duplicates(docs: DataFrame, *, size: int = 3, distance: int = 2, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component): one row per row of ``docs``; component is the smallest id reachable.

    A null or empty text has fingerprint 0 and is linked like any other. Rows of one fingerprint are
    always linked. A null id is never the smallest one unless its component has no other. No rows: none.
    """
    prints = written(fingerprints(docs, size=size, id_column=id_column, text=text), "fingerprints")
    distinct = written(prints.groupBy("fingerprint").agg(F.min("id").alias("least_id")), "distinct")
    # Signed and unsigned order differ, which does not matter: any order gives the same components.
    known = _smallest_ids(distinct, close_pairs(distinct, distance), "fingerprint")
    return prints.join(written(known, "components"), "fingerprint").select("id", "fingerprint", "component")


def _smallest_ids(distinct: DataFrame, links: DataFrame, node: str) -> DataFrame:
    """(node, root, component) of all nodes: the smallest ``least_id`` of the nodes that links reach."""
    rooted = components(links).withColumnRenamed("node", "_node")
    labelled = distinct.join(rooted, F.col(node) == F.col("_node"), "left").select(
        node, "least_id", F.coalesce("root", node).alias("root")
    )
    labelled = written(labelled, "roots")
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component"))
    return labelled.join(smallest, "root").select(node, "root", "component")


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the word shingles of each whole text, least first, as signed numbers in unsigned order.

    A-Z are lowered; fewer words make one shingle, none (or null) make none. A word is hashed once for all texts given, and a
    shingle folds the hashes of its words in order. They are not the hashes of ``shingle_hashes``.
    """
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    words = pc.ascii_split_whitespace(trimmed)
    # A text of white space alone splits into one empty word.
    counts = np.asarray(pc.fill_null(pc.list_value_length(words), 0)) - np.asarray(pc.fill_null(pc.equal(trimmed, ""), False))
    flat = words.flatten()
    coded = flat.filter(pc.not_equal(flat, "")).dictionary_encode()
    digests = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)
    own = digests[np.asarray(coded.indices)]
    long_enough = max(len(own) - size + 1, 0)
    folded = own[:long_enough].copy()
    for k in range(1, size):
        folded = _fold(folded, own[k : k + long_enough])
    ends = np.cumsum(counts)
    begins = ends - counts
    short = np.nonzero((counts > 0) & (counts < size))[0]
    whole = own[begins[short]]
    for k in range(1, size - 1):
        more = counts[short] > k
        whole[more] = _fold(whole[more], own[begins[short][more] + k])
    single = dict(zip(short.tolist(), _spread(whole)))
    folded = _spread(folded)
    spans = zip(begins.tolist(), (ends - size + 1).tolist())
    sets = (np.array([single[n]]) if n in single else folded[begin : max(begin, end)] for n, (begin, end) in enumerate(spans))
    return [np.unique(s).view(np.int64) for s in sets]


def _fold(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (before ^ (before >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of the hash, one to one."""
    hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(31))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few texts are worked on at once; a batch itself may hold very long ones."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 512):
            yield batch.slice(begin, 512)


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int64), *sets]))


def similar_documents(docs: DataFrame, *, size: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component) of every row: components of all pairs of texts whose sets of shingles have this Jaccard similarity or more.

    No pair is lost and none below is linked. Null and empty texts are one group; a null id is never the smallest
    unless its group has no other.
    """
    return _grouped(docs, size, similarity, id_column, text).select("id", "component")


def _grouped(docs: DataFrame, size: int, similarity: float, id_column: str, text: str) -> DataFrame:
    """(id, hash, root, component) of every row: ``hash`` is that of the text, ``root`` names the group."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            sets = shingle_sets(part.column("text"), size)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": part.column("id"),
                    "hash": part.column("hash"),
                    "print": pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    "size": pa.array([len(s) for s in sets], pa.int32()),
                    "head": _lists([s[: _prefix(len(s), similarity) + len(s) // MORE] for s in sets]),
                }
            )
        released()

    def wholes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches):
            sets = shingle_sets(part.column("text"), size)
            bits = np.array([majority(s.view("<u8")) for s in sets], np.uint8).reshape(-1, BITS)
            prints = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
            yield pa.RecordBatch.from_pydict({"node": part.column("node"), "fingerprint": pa.array(prints, pa.int64()), "whole": _lists(sets)})
        released()

    named = packed(docs, id=id_column, hash=F.xxhash64(F.col(f"`{text}`")), text=text).select(F.col("id").cast("string").alias("id"), "hash", "text")
    before = folders(docs.sparkSession)
    found = named.mapInArrow(heads, "id string, hash bigint, print binary, size int, head array<bigint>")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "heads")
    # What outlives the heads, which are deleted once they have been compared.
    prints = written(found.select(F.col("id").cast("bigint").alias("id"), "hash", "print"), "prints")
    # A node is the first row of its set.
    distinct = written(found.groupBy("print").agg(F.min(F.col("id").cast("bigint")).alias("least_id"), F.min("row").alias("node")), "distinct")
    firsts = found.join(distinct.select(F.col("node").alias("row")), "row")
    maybe = firsts.join(_with_partners(firsts, similarity), "row", "left_semi").select("id", "hash", F.col("row").alias("node"))
    maybe = written(maybe, "maybe").withColumnsRenamed({"id": "_id", "hash": "_hash"})
    del firsts, found
    swept(docs.sparkSession, folders(docs.sparkSession) - before, "heads")
    texts = named.join(maybe, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")))
    # Repeated rows give one node several times.
    sets = texts.select("node", "text").mapInArrow(wholes, "node bigint, fingerprint bigint, whole array<bigint>").dropDuplicates(["node"])
    sets = written(sets.select("node", "fingerprint", F.size("whole").alias("size"), "whole"), "sets")
    forget(docs.sparkSession)
    links = _similar_pairs(sets, similarity)
    known = written(_smallest_ids(distinct.select("node", "least_id"), links, "node"), "components")
    return prints.join(distinct.select("print", "node"), "print").join(known, "node").select("id", "hash", "root", "component")


def _with_partners(sets: DataFrame, similarity: float) -> DataFrame:
    """(row) of the sets of which enough of ``head`` stands in other heads; all that have a similar set are among them.

    Of the members that two similar sets share, the first n // MORE stand in both heads, where n is the size of the smaller one.
    """
    heads = sets.select("row", "size", F.explode("head").alias("key")).repartition("key")
    shared = heads.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    smaller = F.ceil(F.lit(similarity) * F.col("size") - 1e-9)
    met = heads.join(shared, "key", "left_semi").groupBy("row", "size").agg(F.count(F.lit(1)).alias("met"))
    return met.where(F.col("met") >= F.greatest(F.lit(1), F.floor(smaller / MORE))).select("row")


def _prefix(size: int, similarity: float) -> int:
    """Two sets this similar have one of their first so many members in common, in any order that all sets share."""
    return size - math.ceil(similarity * size - 1e-9) + 1 if size else 0


def _similar_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) of nodes, whose components are those of all pairs of this similarity or more; ``sets``: node, fingerprint, size, whole.

    Sets whose SimHash fingerprints lie within two bits are found by blocks, as everywhere, and the similarity decides. Bits lose
    pairs at the threshold, so the sets that they leave apart are compared exactly. Shingles are ordered by the sets that hold
    them, rarest first, and sets meet under their first ones (see ``_prefix``).
    Each is compared with the least it meets, those of a crowd then with a few leaders; at last all pairs that meet and are
    not known to be in one component are. The number of steps is fixed.
    """
    members = sets.select("node", "size", F.explode("whole").alias("key")).repartition("key")
    often = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = members.join(often, "key").groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("order"))
    # Shingles of one set only come first in the order, and nothing meets under them.
    alone = F.col("size") - F.size("order")
    first = F.col("size") - F.ceil(F.lit(similarity) * F.col("size") - 1e-9).cast("int") + 1
    cut = ranked.select("node", "size", alone.alias("alone"), F.slice("order", F.lit(1), F.greatest(first - alone, F.lit(0))).alias("order"))
    keyed = cut.select("node", "size", "alone", F.posexplode("order").alias("at", "o"))
    keyed = written(keyed.select(F.col("o.key").alias("key"), "node", "size", (F.col("alone") + F.col("at")).alias("at")), "prefixes")

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        """Pairs under one shingle, of different components, that their sizes and its places do not rule out."""
        names = {c: f"_{c}" for c in ("node", "size", "at", "root")}
        # A hot shingle is dealt over several tasks: one side by a salt, the other to each of them.
        salts = F.ceil(F.col("crowd") / SALTED).cast("int")
        left = left.withColumn("salt", F.pmod(F.xxhash64("node"), salts).cast("int"))
        right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).withColumnsRenamed(names).drop("crowd")
        both = F.least("at", "_at") + F.least(F.col("size") - F.col("at"), F.col("_size") - F.col("_at"))
        may = both / (F.col("size") + F.col("_size") - both) >= similarity
        sizes = F.least("size", "_size") / F.greatest("size", "_size") >= similarity
        met = left.join(right, ["key", "salt"]).where((F.col("root") != F.col("_root")) & sizes & may)
        return met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("whole").alias("_a"))
        right = sets.select(F.col("node").alias("b"), F.col("whole").alias("_b"))
        common = F.size(F.array_intersect("_a", "_b"))
        close = common / (F.size("_a") + F.size("_b") - common) >= similarity
        return pairs.join(left, "a").join(right, "b").where(close).select("a", "b")

    def crowds(labels: DataFrame) -> DataFrame:
        """Rows under shingles at which two components meet, with the number of sets there."""
        labelled = keyed.join(labels, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))
        sizes = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("root").alias("_low"), F.max("root").alias("_high"))
        return written(labelled.join(sizes.where("_low < _high").drop("_low", "_high"), "key"), "crowds")

    forget(sets.sparkSession)
    near = written(verified(_close_nodes(sets)), "links")
    joined = written(components(near), "joined")
    least = keyed.groupBy("key").agg(F.min("node").alias("least"))
    begin = keyed.join(least, "key").groupBy("node").agg(F.min("least").alias("a")).where("a < node")
    # Those that the fingerprints have brought together need no second look.
    a, b = (joined.select(F.col("node").alias(n), F.col("root").alias(f"_{n}")) for n in ("a", "b"))
    apart = begin.select("a", F.col("node").alias("b")).join(a, "a", "left").join(b, "b", "left")
    apart = apart.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
    first = written(near.unionByName(verified(apart)), "links")
    roots = components(first).withColumnRenamed("node", "_node")

    crowded = crowds(roots).where(F.col("crowd") > CROWD)
    member = F.struct("node", "size", "at", "root")
    chosen = crowded.groupBy("key", "crowd").agg(*[F.min_by(member, F.xxhash64("node", F.lit(n))).alias(f"l{n}") for n in range(LEADERS)])
    leaders = chosen.select("key", "crowd", F.explode(F.array_distinct(F.array(*[f"l{n}" for n in range(LEADERS)]))).alias("m")).select("key", "crowd", "m.*")
    second = written(verified(compared(crowded, leaders)), "links")
    # One star step: each component takes the least one that a leader has joined it to.
    known = roots.select("_node", "root")
    named = second
    for end in ("a", "b"):
        named = named.join(known.withColumnsRenamed({"_node": f"_{end}", "root": f"r{end}"}), F.col(end) == F.col(f"_{end}"), "left")
        named = named.withColumn(f"r{end}", F.coalesce(f"r{end}", end))
    stars = named.select(F.greatest("ra", "rb").alias("_old"), F.least("ra", "rb").alias("_new")).where("_old <> _new").groupBy("_old").agg(F.min("_new").alias("_new"))
    every = known.unionByName(second.select(F.explode(F.array("a", "b")).alias("_node")).distinct().join(known, "_node", "left_anti").withColumn("root", F.col("_node")))
    labels = every.join(stars, F.col("root") == F.col("_old"), "left").select("_node", F.coalesce("_new", "root").alias("root"))
    left = crowds(written(labels, "labels"))
    # Whatever is left: every pair of two components under one shingle.
    third = written(verified(compared(left, left)), "links")
    return first.unionByName(second).unionByName(third).distinct()


def _close_nodes(sets: DataFrame) -> DataFrame:
    """(a, b): nodes of one fingerprint with the least of them, and the least ones of two fingerprints within two bits."""
    prints = written(sets.groupBy("fingerprint").agg(F.min("node").alias("least")), "distinct")
    same = sets.select("node", "fingerprint").join(prints, "fingerprint").where("least < node").select(F.col("least").alias("a"), F.col("node").alias("b"))
    a, b = (prints.select(F.col("fingerprint").alias(n), F.col("least").alias(f"_{n}")) for n in ("a", "b"))
    close = close_pairs(prints).join(a, "a").join(b, "b")
    return same.unionByName(close.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).distinct()


def kept(
    docs: DataFrame, *, size: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each group of near-duplicates, whole: that of the smallest id (null last), then of the smallest hash of its text.

    Rows that repeat its id and text are dropped as well. Groups are told apart by their texts, so null ids, or one id on
    several texts, leave a row in each group. Texts without words form one group.
    """
    found = _grouped(docs, size, similarity, id_column, text)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("f"))
    stays = written(first.select(F.col("f.id").alias("_stays"), F.col("f.hash").alias("_text_hash")), "stays")
    rows = packed(docs, _id=id_column, _hash=F.xxhash64(F.col(f"`{text}`")))
    same = rows["_id"].cast("bigint").eqNullSafe(stays["_stays"]) & (rows["_hash"] == stays["_text_hash"])
    # Of rows that differ in other columns only, the choice does not depend on where they lie.
    chosen = rows.join(stays, same, "left_semi").withColumn("_place", F.sha2(F.to_json("_row"), 256))
    least = chosen.groupBy("_id", "_hash").agg(F.min_by("_row", "_place").alias("_row"))
    return least.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
