"""Suffix-array dedup: bytes covered by long strings that start at more than one place.

Which strings must be compared is narrowed exactly before any suffix is sorted. In each string of ``length`` bytes the
``GRAM``-byte piece of least hash (the leftmost, if several) is its anchor, so equal strings have equal anchors at
equal distances. Around an anchor lies the window of all strings that can have it.

* An anchor whose hash occurs once has no repeated string.
* A window whose bytes occur at two places is repeated throughout; nothing needs sorting.
* Only distinct windows around the same anchor go to shards. A shard sorts their suffixes by Larsson-Sadakane
  refinement, gets common prefixes with Kasai's pass, and finds which strings occur at two places. An anchor with very
  many distinct windows is dealt over several shards; their sorted strings are then merged by binary search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.spans import cut_out, keyed
from schemaloom.workspace import written

LENGTH, GRAM = 400, 64
#: Distinct windows of one anchor that a shard takes, and windows per shard in all, about.
CROWD, SHARD = 1024, 1024
_PART = 1 << 22  # strings of a text that are looked at together
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a power of two) at each place, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    power, size = _BASE, 1
    with np.errstate(over="ignore"):
        while size < gram:
            h = h[:-size] * power + h[size:]
            power = power * power
            size *= 2
        return (h ^ (h >> np.uint64(29))) * _MIX


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash) of the windows of a text: strings of ``length`` bytes that start in ``[begin, end - length]``
    have one anchor, of that hash. Each string lies in one window only; short texts have none.
    """
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    width, begins, hashes = length - gram + 1, [], []
    for cut in range(0, n, _PART):
        starts = min(_PART, n - cut)
        own = gram_hashes(data[cut : cut + starts + length - 1], gram)
        # Upper bits of the hash, then the place, so that the least value is the leftmost of the least hashes.
        least = (own & ~np.uint64(4 * _PART - 1)) | np.arange(len(own), dtype=np.uint64)
        size = 1
        while 2 * size <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if rest := width - size:
            least = np.minimum(least[:-rest], least[rest:])
        at = (least & np.uint64(4 * _PART - 1)).astype(np.int64)
        first = np.nonzero(np.concatenate([[True], at[1:] != at[:-1]]))[0]
        begins.append(first + cut)
        hashes.append(own[at[first]].view(np.int64))
    begin = np.concatenate(begins)
    return begin, np.concatenate([begin[1:], [n]]) + length - 1, np.concatenate(hashes)


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, ranks) by the first ``depth`` bytes, by Larsson-Sadakane refinement.

    Ranks start from eight bytes; each round doubles what they cover and sorts, within groups of one rank, by
    the rank of what follows. Suffixes that are alone in their group take no further part. Suffixes equal in ``depth``
    bytes or more may share a rank. The end of the data sorts before any byte.
    """
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = np.zeros(n, np.uint64)
    for k in range(7):  # nine bits a byte, so that the end differs from byte 0
        key = (key << np.uint64(9)) | padded[k : k + n]
    order = np.argsort(key)
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = group
    covered = 7
    while covered < depth:
        # A group is named by the place of its first suffix; open groups have more than one.
        alone = first & np.concatenate([first[1:], [True]])
        open_at = np.nonzero(~alone)[0]
        if not len(open_at):
            break
        step = min(covered, depth - covered)
        own = order[open_at]
        follow = rank[np.minimum(own + step, n)]
        sort = np.argsort(group[open_at] * (n + 2) + follow + 1)
        own, follow, groups = own[sort], follow[sort], group[open_at]
        new = np.concatenate([[True], (groups[1:] != groups[:-1]) | (follow[1:] != follow[:-1])])
        order[open_at] = own
        first[open_at] = new
        group[open_at] = np.maximum.accumulate(np.where(new, open_at, 0))
        rank[own] = group[open_at]
        covered += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, lanes: np.ndarray, most: int) -> np.ndarray:
    """Kasai: common prefix, ``most`` at most, of each suffix in ``order`` with the one before it.

    The pass goes through the text from left to right and loses one byte of the prefix at each step at most. The text
    consists of pieces that begin at ``lanes``; all pieces are passed at once, step by step. Suffixes of one rank agree in
    ``most`` bytes and have no order among them, so nothing is inferred from one of those for the next.
    """
    n = len(data)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    # Eight bytes from each place on, to be compared at once.
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
    result = np.zeros(n, np.int64)
    ends = np.concatenate([lanes[1:], [n]])
    have = np.zeros(len(lanes), np.int64)
    for step in range(int((ends - lanes).max(initial=0))):
        live = np.nonzero(lanes + step < ends)[0]
        i = lanes[live] + step
        p = place[i]
        j = np.where(p > 0, order[p - 1], n)
        equal = (p > 0) & (rank[i] == rank[np.minimum(j, n - 1)])
        h = np.where((p == 0) | (have[live] == most), 0, np.maximum(have[live] - 1, 0))
        h[equal] = most
        room = np.minimum(n - np.maximum(i, j), most)
        going = np.nonzero((p > 0) & ~equal)[0]
        while len(going):
            differ = eight[i[going] + h[going]] ^ eight[j[going] + h[going]]
            same = differ == 0
            low = differ & (~differ + np.uint64(1))
            h[going] += np.where(same, 8, np.bitwise_count(low - np.uint64(1)) >> 3)
            going = going[same & (h[going] < room[going])]
        h = np.minimum(h, room)
        result[p] = h
        have[live] = h
    return result


def string_groups(windows: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, group) of all strings of ``length`` bytes in the windows, sorted; equal strings share a group."""
    sizes = np.array([len(w) for w in windows], np.int64)
    data = np.frombuffer(b"".join(windows), np.uint8)
    lanes = np.cumsum(sizes) - sizes
    order, rank = suffix_ranks(data, length)
    prefix = common_prefixes(data, order, rank, lanes, length)
    window = np.repeat(np.arange(len(windows)), sizes)
    start = np.arange(len(data)) - lanes[window]
    # Suffixes that run over the end of their window are sorted along, but hold no string of it.
    group = np.cumsum(prefix < length)
    whole = (start + length <= sizes[window])[order]
    at = order[whole]
    return window[at], start[at], group[whole]


_RECORD = np.dtype([("high", ">u8"), ("low", ">u8"), ("d_high", "i8"), ("d_low", "i8"), ("start", "i4"), ("times", "i4")])
RANGES = "h bigint, d_high bigint, d_low bigint, first int, last int"


def _ranges(h, d_high, d_low, start) -> pd.DataFrame:
    """Runs of consecutive starts of one window."""
    frame = pd.DataFrame({"h": h, "d_high": d_high, "d_low": d_low, "start": start}).sort_values(["h", "d_high", "d_low", "start"])
    values = frame.to_numpy(np.int64).reshape(-1, 4)
    if not len(values):
        return pd.DataFrame({c.split()[0]: [] for c in RANGES.split(", ")}, dtype="int64")
    new = np.concatenate([[True], (values[1:, :3] != values[:-1, :3]).any(1) | (values[1:, 3] != values[:-1, 3] + 1)])
    last = values[np.concatenate([new[1:], [True]]), 3]
    h, d_high, d_low, first = values[new].T
    return pd.DataFrame({"h": h, "d_high": d_high, "d_low": d_low, "first": first, "last": last})


def merged_by_search(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted arrays of digests as one: binary search gives each element of the second its place in the first."""
    out = np.empty(len(a) + len(b), a.dtype)
    at = np.searchsorted(a, b, "right") + np.arange(len(b))
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[at], out[rest] = b, a
    return out


def _all_merged(parts: list[np.ndarray]) -> np.ndarray:
    while len(parts) > 1:
        parts = [merged_by_search(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def repeated_ranges(windows: DataFrame, length: int = LENGTH) -> DataFrame:
    """Which strings of distinct windows occur in two of them: ranges of starts (h, d_high, d_low, first, last).

    ``windows``: h (anchor), d_high, d_low (digest of the bytes), n (places of the window), m (distinct windows of the
    anchor), bytes. Shards take whole anchors, about ``SHARD`` windows each; an anchor with more than ``CROWD`` windows
    is dealt over shards of its own, whose sorted strings are cut by digest into slots and merged there.
    """
    shards = max(1, windows.count() // SHARD)
    alone = F.col("m") <= CROWD
    part = F.pmod(F.col("d_low"), F.ceil(F.col("m") / CROWD))
    shard = F.when(alone, F.struct(F.pmod(F.xxhash64("h"), F.lit(shards)).alias("a"), F.lit(-1).cast("bigint").alias("b"))).otherwise(
        F.struct(F.col("h").alias("a"), part.alias("b"))
    )

    def sort_shard(rows: pd.DataFrame) -> pd.DataFrame:
        window, start, group = string_groups(rows["bytes"].tolist(), length)
        h, d_high, d_low, n = (rows[c].to_numpy(np.int64) for c in ("h", "d_high", "d_low", "n"))
        new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
        begin = np.nonzero(new)[0]
        size = np.diff(np.concatenate([begin, [len(group)]]))
        times = np.add.reduceat(n[window], begin) if len(begin) else np.zeros(0, np.int64)
        # Within a window, all strings of one anchor differ, so a group of two has two windows.
        twice = np.repeat(times > 1, size)
        found = _ranges(h[window[twice]], d_high[window[twice]], d_low[window[twice]], start[twice])
        found = found.assign(slot=-1, records=None)
        if rows["m"].max() <= CROWD:
            return found[COLUMNS]
        # One string of each group goes on, to meet those of the anchor's other shards.
        raw, anchor = rows["bytes"].tolist(), int(h[0])
        records = np.empty(len(begin), _RECORD)
        digests = b"".join(xxhash.xxh3_128_digest(raw[w][s : s + length]) for w, s in zip(window[begin].tolist(), start[begin].tolist()))
        records[["high", "low"]] = np.frombuffer(digests, np.dtype([("high", ">u8"), ("low", ">u8")]))
        records["d_high"], records["d_low"] = d_high[window[begin]], d_low[window[begin]]
        records["start"], records["times"] = start[begin], np.minimum(times, 2)
        records = np.sort(records, order=["high", "low"])
        slots = 1 << max(0, int(rows["m"].max() // CROWD)).bit_length()
        slot = (records["high"] % slots).astype(np.int64)
        nothing = {"d_high": [0], "d_low": [0], "first": [0], "last": [0]}
        more = [pd.DataFrame({"h": [anchor], **nothing, "slot": [k], "records": [records[slot == k].tobytes()]}) for k in range(slots)]
        return pd.concat([found, *more])[COLUMNS]

    COLUMNS = ["h", "d_high", "d_low", "first", "last", "slot", "records"]
    sorted_ = written(
        windows.withColumn("shard", shard).groupBy("shard").applyInPandas(sort_shard, RANGES + ", slot bigint, records binary"), "shards"
    )

    def merge_slot(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(r, _RECORD) for r in rows["records"]]
        key = np.dtype([("high", ">u8"), ("low", ">u8")])
        # As byte strings, digests sort like numbers and are searched by one call.
        names = [np.ascontiguousarray(p[["high", "low"]].astype(key)).view("S16") for p in parts]
        everything = _all_merged(names)
        keep = []
        for own, name in zip(parts, names):
            met = np.searchsorted(everything, name, "right") - np.searchsorted(everything, name, "left") > 1
            keep.append(own[met & (own["times"] < 2)])
        found = np.concatenate(keep)
        return _ranges(np.full(len(found), rows["h"].iloc[0]), found["d_high"], found["d_low"], found["start"])

    across = sorted_.where("slot >= 0").select("h", "slot", "records").groupBy("h", "slot").applyInPandas(merge_slot, RANGES)
    return sorted_.where("slot < 0").drop("slot", "records").unionByName(across)


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash, begin, end): bytes covered by strings of ``length`` bytes that start at two places; spans may overlap."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 64):
                part, out = batch.iloc[at : at + 64], []
                for doc_id, text_hash, t in zip(part["id"], part["hash"], part["text"]):
                    raw = t.encode("utf-8", "surrogatepass") if t else b""
                    begin, end, h = anchors(np.frombuffer(raw, np.uint8), length, gram)
                    if len(begin):
                        digests = b"".join(xxhash.xxh3_128_digest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist()))
                        d = np.frombuffer(digests, ">i8").reshape(-1, 2).astype(np.int64)
                        out.append(pd.DataFrame({"id": doc_id, "hash": text_hash, "begin": begin, "end": end, "h": h, "d_high": d[:, 0], "d_low": d[:, 1]}))
                if out:
                    yield pd.concat(out)

    named = keyed(docs, id_column, text).select(F.col("id").cast("string").alias("id"), "hash", "text")
    found = named.mapInPandas(find, "id string, hash bigint, begin int, end int, h bigint, d_high bigint, d_low bigint")
    found = written(found.withColumn("id", F.col("id").cast("bigint")), "anchors")
    kinds = found.groupBy("h", "d_high", "d_low").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "hash", "begin", "end")).alias("at")
    )
    # Anchors that occur once are dropped before anything is joined; counts are combined map-side.
    crowds = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("places")).where("places > 1")
    kinds = written(kinds.join(crowds.select("h", "m"), "h"), "windows")

    wanted = kinds.where("m > 1").select(F.col("at.id").alias("_i"), F.col("at.hash").alias("_h"), F.struct(F.col("at.begin").alias("begin"), F.col("at.end").alias("end"), "h", "d_high", "d_low", "n", "m").alias("w"))
    lists = wanted.groupBy("_i", "_h").agg(F.collect_list("w").alias("ws"))
    rows = keyed(docs, id_column, text).select("id", "hash", "text")
    met = rows.join(lists, F.col("id").eqNullSafe(F.col("_i")) & (F.col("hash") == F.col("_h")))
    pieces = met.select(F.encode("text", "UTF-8").alias("raw"), F.explode("ws").alias("w")).select(
        "w.h", "w.d_high", "w.d_low", "w.n", "w.m", F.expr("substring(raw, w.begin + 1, w.end - w.begin)").alias("bytes")
    )
    pieces = written(pieces.dropDuplicates(["h", "d_high", "d_low"]), "pieces")  # repeated rows give a piece twice
    ranges = repeated_ranges(pieces, length)
    key = ["h", "d_high", "d_low"]
    whole = found.join(kinds.where("n > 1").select(*key), key).select("id", "hash", "begin", "end")
    some = found.join(ranges, key).select(
        "id", "hash", (F.col("begin") + F.col("first")).alias("begin"), (F.col("begin") + F.col("last") + length).alias("end")
    )
    return whole.unionByName(some)


def deduplicated(docs: DataFrame, *, length: int = LENGTH, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``n_bytes, n_covered, n_removed, n_spans, kept_bytes``: every byte that a repeated string of
    ``length`` bytes covers is removed, wherever the string occurs, judged on the input.

    Null and empty texts have no bytes; texts shorter than ``length`` stay whole. Repeated rows repeat their strings.
    Input columns of these names are replaced, others kept.
    """
    spans = repeated_spans(docs, length=length, id_column=id_column, text=text).withColumn("remove", F.lit(True))
    return cut_out(docs, spans, id_column=id_column, text=text)
