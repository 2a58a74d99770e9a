"""Embedding near-duplicates by binary codes of random rotations.

A vector of length 1 is turned by random rotations (seeded, the same everywhere). The signs of the turned components are
its code; beside the code its correction factor is stored, the inner product of the vector with the unit vector that
the code stands for. For another vector, whose turned components are stored in four bits with random rounding, the
inner product with the code divided by the factor is an unbiased estimate of the cosine, with a confidence bound that
the factor gives. Pairs whose bound lies below the threshold are done with; the others are computed exactly.

Which pairs meet: signs of further rotations are cut into blocks, and vectors that agree in a whole block lie in one bucket.
The number of blocks is chosen such that a pair right at the threshold shares one with the stated probability.
A pair is judged in the first block that it shares only, so links can be counted where they are found, and no list of pairs
leaves a task.

Large groups: equal vectors are one from the start. A bounded sample shows where very many vectors lie closer than half
the angle to one direction; by the triangle inequality these all are links of each other, are counted as such, and are
compared with the others only. Buckets that are still large are cut into pieces, and pairs of pieces are dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.simhash import components
from schemaloom.workspace import written

#: Bits of a code, at least; bits of a turned component of the other side; standard deviations of the confidence bound.
CODE, FINE, SIGMAS = 256, 4, 5.0
#: Vectors of a piece of a bucket, pairs that are judged at once, and rows of cells that are gathered for it.
PIECE, PAIRS, GATHERED = 256, 1 << 17, 4096
#: Vectors (and bytes) of the sample that is searched for crowded directions, and how many of it must lie there.
SAMPLE, SAMPLE_BYTES, CROWD = 2048, 1 << 24, 8


@dataclass(frozen=True)
class Plan:
    """``blocks`` of ``width`` sign bits for vectors at least ``cosine`` alike."""

    cosine: float
    width: int
    blocks: int

    @staticmethod
    def of(rows: int, cosine: float, recall: float) -> Plan:
        """A block has three bits more than number the rows, so unrelated vectors seldom meet, however many there are.

        Signs of a random direction differ with probability angle / pi.
        """
        same = 1 - math.acos(cosine) / math.pi
        width = min(32, max(8, math.ceil(math.log2(rows + 1)) + 3))
        return Plan(cosine, width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**width))))


@lru_cache(maxsize=8)
def rotations(dims: int, bits: int, seed: int) -> np.ndarray:
    """At least ``bits`` rows of stacked random rotations of that many dimensions; each rotation is orthonormal."""
    draw = np.random.default_rng([seed, dims])
    stacked = []
    for _ in range(-(-bits // dims)):
        q, r = np.linalg.qr(draw.standard_normal((dims, dims)))
        stacked.append(q * np.sign(np.diag(r)))
    return np.concatenate(stacked)


def _planes(bits: np.ndarray) -> np.ndarray:
    """(rows, words) of 64 bits each from (rows, bits) of 0 and 1."""
    padded = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), np.uint8)
    padded[:, : bits.shape[1]] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


@dataclass
class Codes:
    """Codes of unit vectors; row k of every array belongs to vector k."""

    signs: np.ndarray  # (rows, words)
    factor: np.ndarray  # inner product of the vector and what its code stands for
    fine: np.ndarray  # (rows, FINE, words): the turned components as whole numbers, plane by plane
    base: np.ndarray  # least turned component
    step: np.ndarray  # between two of the whole numbers
    total: np.ndarray  # sum of the components as they are stored
    bits: int

    @staticmethod
    def of(units: np.ndarray, *, seed: int = 0, least: int = CODE) -> Codes:
        turn = rotations(units.shape[1], least, seed)
        bits = len(turn)
        turned = units @ turn.T / math.sqrt(bits / units.shape[1])
        base = turned.min(1)
        step = np.maximum((turned.max(1) - base) / ((1 << FINE) - 1), 1e-300)
        rounding = np.random.default_rng([seed, 1]).random(bits)  # by place only, so that a vector has one code
        whole = np.floor((turned - base[:, None]) / step[:, None] + rounding).clip(0, (1 << FINE) - 1).astype(np.uint8)
        planes = np.stack([_planes(whole >> j & 1) for j in range(FINE)], 1)
        total = bits * base + step * whole.sum(1, dtype=np.int64)
        return Codes(_planes(turned > 0), np.abs(turned).sum(1) / math.sqrt(bits), planes, base, step, total, bits)

    def records(self) -> list[bytes]:
        """What is stored beside a vector: its code, the factor, and its fine components."""
        numbers = np.stack([self.factor, self.base, self.step, self.total], 1)
        whole = np.concatenate([numbers.view("<u8"), self.signs, self.fine.reshape(len(self.signs), -1)], 1)
        return [r.tobytes() for r in np.ascontiguousarray(whole)]

    @staticmethod
    def read(records: list[bytes], dims: int, *, least: int = CODE) -> Codes:
        whole = np.frombuffer(b"".join(records), "<u8").reshape(len(records), -1)
        words = (whole.shape[1] - 4) // (1 + FINE)
        factor, base, step, total = np.ascontiguousarray(whole[:, :4]).view("<f8").T
        return Codes(whole[:, 4 : 4 + words], factor, whole[:, 4 + words :].reshape(-1, FINE, words), base, step, total, -(-least // dims) * dims)

    def take(self, at: np.ndarray) -> Codes:
        return Codes(self.signs[at], self.factor[at], self.fine[at], self.base[at], self.step[at], self.total[at], self.bits)

    def estimate(self, other: Codes) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosine of each vector with that of ``other`` in its place, and the half-width of its confidence interval."""
        ones = np.bitwise_count(self.signs).sum(1, dtype=np.int64)
        inner = np.zeros(len(self.factor))
        for j in range(FINE):
            inner += float(1 << j) * np.bitwise_count(self.signs & other.fine[:, j]).sum(1, dtype=np.int64)
        positive = other.base * ones + other.step * inner
        value = (2 * positive - other.total) / math.sqrt(self.bits) / self.factor
        spread = np.sqrt(np.maximum(1 - self.factor**2, 0)) / self.factor / math.sqrt(max(self.bits - 1, 1))
        rounding = other.step / 2 / self.factor
        return value, SIGMAS * np.hypot(spread, rounding)


def block_keys(units: np.ndarray, plan: Plan, seed: int = 0) -> np.ndarray:
    """(rows, blocks): the signs of each block as a whole number."""
    turn = rotations(units.shape[1], plan.width * plan.blocks, seed + 1)[: plan.width * plan.blocks]
    weight = np.left_shift(np.uint64(1), np.arange(plan.width, dtype=np.uint64))
    out = np.empty((len(units), plan.blocks), np.uint32)
    for k in range(plan.blocks):
        own = units @ turn[k * plan.width : (k + 1) * plan.width].T > 0
        out[:, k] = (own * weight).sum(1)
    return out


def unit_vectors(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """(rows, dims) vectors of one length, scaled to length 1, and which of them have a direction: finite, not zero."""
    raw = np.array(vectors, np.float64).reshape(len(vectors), -1)
    good = np.isfinite(raw).all(1)
    raw = np.where(good[:, None], raw, 0.0)
    largest = np.abs(raw).max(1, initial=0)
    good &= largest > 0
    scaled = raw / np.where(good, largest, 1.0)[:, None]  # squares neither overflow nor vanish
    return scaled / np.where(good, np.linalg.norm(scaled, axis=1), 1.0)[:, None], good


_VECTORS = "id string, print binary, dims int, unit binary"


def _directions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, print, dims, unit) of rows (id, vector): equal vectors have one print; it is null where there is no direction."""
    for batch in batches:
        lengths = np.array([-1 if v is None else len(v) for v in batch["vector"]])
        for dims in np.unique(lengths):
            own = batch[lengths == dims]
            found = pd.DataFrame({"id": own["id"], "print": None, "dims": int(dims), "unit": None})
            if dims > 0:
                vectors = [np.array(v, np.float64) + 0.0 for v in own["vector"]]
                units, good = unit_vectors(vectors)
                found["print"] = [xxhash.xxh3_128_digest(v.tobytes()) if g else None for v, g in zip(vectors, good)]
                found["unit"] = [u.tobytes() if g else None for u, g in zip(units, good)]
            yield found


def crowded_directions(units: np.ndarray, cosine: float, crowd: int = CROWD) -> np.ndarray:
    """Directions in a sample with ``crowd`` of its vectors within half the angle, the fullest first; each vector serves one."""
    half = math.cos(math.acos(cosine) / 2)
    left, found = units, []
    while len(left) >= crowd:
        near = left @ left.T >= cosine
        first = int(near.sum(1).argmax())
        if near[first].sum() < crowd:
            break
        middle = left[near[first]].mean(0)
        middle /= np.linalg.norm(middle)
        inside = left @ middle >= half
        if inside.sum() >= crowd:
            found.append(middle)
        left = left[~(inside | near[first])]
    return np.array(found).reshape(-1, units.shape[1])


def _sampled_crowds(classes: DataFrame, cosine: float) -> dict[int, np.ndarray]:
    """Crowded directions by vector length, from a sample of classes in the order of a hash."""
    longest = classes.agg(F.max("dims")).head()[0] or 1
    some = classes.orderBy(F.xxhash64("node"), "node").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest))))
    found = {}
    for dims, own in some.select("dims", "unit").toPandas().groupby("dims"):
        found[int(dims)] = crowded_directions(np.frombuffer(b"".join(own["unit"]), "<f8").reshape(-1, int(dims)), cosine)
    return {d: x for d, x in found.items() if len(x)}


_CODED = "node bigint, times bigint, dims int, core int, keys array<bigint>, code binary, unit binary"


def _coded(classes: DataFrame, plan: Plan, crowds: dict[int, np.ndarray], seed: int) -> DataFrame:
    """Classes with the crowded direction within half the angle (``core``, -1: none), the block keys and the stored code."""
    # A hair less than half the angle, so that rounding never makes a link of what is none.
    half = math.cos(math.acos(plan.cosine) / 2 - 1e-6)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, own in batch.groupby("dims"):
                for at in range(0, len(own), 4096):
                    part = own.iloc[at : at + 4096]
                    units = np.frombuffer(b"".join(part["unit"]), "<f8").reshape(len(part), -1)
                    core = np.full(len(part), -1)
                    if (middles := crowds.get(int(dims))) is not None:
                        near = units @ middles.T
                        core = np.where(near.max(1) >= half, int(dims) * SAMPLE + near.argmax(1), -1)
                    # Vectors of different lengths never meet.
                    keys = block_keys(units, plan, seed).astype(np.int64) | int(dims) << 32
                    code = Codes.of(units, seed=seed).records()
                    yield part[["node", "times", "dims"]].assign(core=core, keys=list(keys), code=code, unit=part["unit"])

    return classes.select("node", "times", "dims", "unit").mapInPandas(run, _CODED)


def _cells(members: DataFrame) -> DataFrame:
    """(which, key, node, first, second, side): who meets whom.

    A bucket of one crowd only has nothing to compare and drops out. A bucket up to ``PIECE`` vectors is one cell. A larger one is cut into
    pieces by a hash, crowd by crowd, and each pair of pieces that are not of one crowd is a cell; side 0 meets
    side 1, or itself where there is no side 1.
    """
    bucket = ["which", "key"]
    sizes = members.groupBy(*bucket, "core").agg(F.count(F.lit(1)).alias("n"))
    mixed = F.count_if(F.col("core") < 0) + F.count(F.lit(1)) > 1
    totals = sizes.groupBy(*bucket).agg(F.sum("n").alias("total"), mixed.alias("_mixed")).where("total > 1 AND _mixed")
    met = written(members.join(totals.drop("_mixed"), bucket), "met")
    nothing = F.lit("")
    small = met.where(F.col("total") <= PIECE).select(*bucket, "node", nothing.alias("first"), nothing.alias("second"), F.lit(0).alias("side"))
    large = met.where(F.col("total") > PIECE)
    cut = large.groupBy(*bucket, "core").agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("pieces"))
    cut = written(cut, "cut")
    piece = F.concat_ws(":", "core", "piece")
    pieces = cut.select(*bucket, "core", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pieces") - 1)).alias("piece")).withColumn("name", piece)
    a = pieces.select(*bucket, F.col("core").alias("_a"), F.col("name").alias("first"))
    b = pieces.select(*bucket, F.col("core").alias("_b"), F.col("name").alias("second"))
    grid = written(a.join(b, bucket).where("first <= second AND (_a < 0 OR _a <> _b)").select(*bucket, "first", "second"), "grid")
    own = F.concat_ws(":", "core", F.pmod(F.xxhash64("node"), F.col("pieces")))
    placed = large.join(cut, [*bucket, "core"]).withColumn("name", own).drop("pieces")
    sides = []
    for side, name, cells in ((0, "first", grid), (1, "second", grid.where("first <> second"))):
        met = placed.withColumnRenamed("name", name).join(cells, [*bucket, name])
        sides.append(met.select(*bucket, "node", "first", "second", F.lit(side).alias("side")))
    return small.unionByName(sides[0]).unionByName(sides[1])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least reachable place of each of ``n`` places under links (a, b)."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
        if (label == before).all():
            return label


def _pairs(start: np.ndarray, sides: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places within cells, some ``PAIRS`` at once; cells begin at ``start`` and end where the next begins."""
    left, right, held = [], [], 0
    for begin, end in zip(start[:-1].tolist(), start[1:].tolist()):
        if end - begin == 1:
            continue
        middle = begin + int((sides[begin:end] == 0).sum())  # side 0 comes first
        for x in range(begin, middle):
            met = np.arange(middle, end) if middle < end else np.arange(x + 1, end)
            left.append(np.full(len(met), x))
            right.append(met)
            held += len(met)
            if held >= PAIRS:
                yield np.concatenate(left), np.concatenate(right)
                left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


_LINKED = "node bigint, links bigint, root bigint"
_CELL = ["which", "key", "first", "second"]


def judged(rows: pd.DataFrame, dims: int, cosine: float) -> pd.DataFrame:
    """Links within whole cells: (node, links, root) of nodes that have any; ``links`` counts copies, ``root`` is linked through the cell."""
    cells = rows[_CELL].to_numpy(object)
    new = np.concatenate([[True], (cells[1:] != cells[:-1]).any(1)])
    start = np.append(np.nonzero(new)[0], len(rows))
    units = np.frombuffer(b"".join(rows["unit"]), "<f8").reshape(len(rows), -1)
    keys = np.stack(rows["keys"].to_numpy())
    codes = Codes.read(rows["code"].tolist(), dims)
    node, core, times, which, sides = (rows[c].to_numpy(np.int64) for c in ("node", "core", "times", "which", "side"))
    links, ends = np.zeros(len(rows), np.int64), []
    for a, b in _pairs(start, sides):
        apart = (core[a] < 0) | (core[a] != core[b])
        a, b = a[apart], b[apart]
        value, bound = codes.take(a).estimate(codes.take(b))
        open_ = value + bound >= cosine
        a, b = a[open_], b[open_]
        linked = np.einsum("ij,ij->i", units[a], units[b]) >= cosine
        a, b = a[linked], b[linked]
        # The pair counts in the first block that both share.
        here = (keys[a] == keys[b]).argmax(1) == which[a]
        a, b = a[here], b[here]
        np.add.at(links, a, times[b])
        np.add.at(links, b, times[a])
        ends.append((a, b))
    a, b = (np.concatenate(x) for x in zip(*ends)) if ends else (np.zeros(0, int), np.zeros(0, int))
    root = node[_forest(a, b, len(rows))]
    some = links > 0
    return pd.DataFrame({"node": node[some], "links": links[some], "root": root[some]})


def _links(coded: DataFrame, plan: Plan) -> DataFrame:
    """(node, links, root) found in all cells; a node has a row for each cell in which it has links."""
    members = coded.select("node", "core", F.posexplode("keys").alias("which", "key"))
    data = coded.select(*[F.col(c).alias("_node" if c == "node" else c) for c in ("node", "times", "dims", "core", "keys", "code", "unit")])
    cells = _cells(members)
    order = [*_CELL, "side"]
    rows = cells.join(data, F.col("node") == F.col("_node")).drop("_node").repartition(*_CELL).sortWithinPartitions(*order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for dims, own in rows.groupby("dims"):
                yield judged(own, int(dims), plan.cosine)

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= GATHERED:
                rows = pd.concat(held, ignore_index=True)
                last = (rows[_CELL] == rows[_CELL].iloc[-1]).all(axis=1).to_numpy()  # this cell may go on
                yield from done(rows[~last])
                held = [rows[last]]
        if held:
            yield from done(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(run, _LINKED)


def linked(
    vectors: DataFrame, *, cosine: float = 0.95, recall: float = 0.995, seed: int = 0, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(id, n_links, component, kept): one row per row of ``vectors``.

    ``n_links``: other rows whose cosine with this one is ``cosine`` or more; each such pair is found with probability
    ``recall`` at least, one that is closer with a higher one, and no other pair is linked. ``component``: the smallest id reachable
    by links, itself included. ``kept``: whether that is its own.

    Vectors that are null, empty or zero, or hold a null or a component that is not finite, link with nothing, and so do
    vectors of different lengths. Equal vectors are links. Rows that repeat an id are rows of their own; a null id
    is never the smallest one unless its component has no other. No rows: none. Other columns are not looked at.
    """
    rows = vectors.select(F.col(f"`{id_column}`").cast("string").alias("id"), F.col(f"`{vector}`").alias("_v"))
    whole = rows.select("id", F.when(~F.exists("_v", lambda x: x.isNull()), F.col("_v")).alias("vector"))
    given = whole.mapInPandas(_directions, _VECTORS)
    given = written(given.withColumns({"id": F.col("id").cast("bigint"), "row": F.monotonically_increasing_id()}), "vectors")
    some = given.where("print IS NOT NULL")
    # A node is the first row of its vector.
    counted = written(some.groupBy("print").agg(F.min("row").alias("node"), F.min("id").alias("least_id"), F.count(F.lit(1)).alias("times")), "classes")
    classes = some.select("row", "dims", "unit").join(counted.select("node", "times"), F.col("row") == F.col("node")).drop("row")
    classes = written(classes, "units")
    plan = Plan.of(classes.count(), cosine, recall)
    coded = written(_coded(classes, plan, _sampled_crowds(classes, cosine), seed), "coded")
    found = written(_links(coded, plan), "links")

    crowds = written(coded.where("core >= 0").groupBy("core").agg(F.sum("times").alias("all"), F.min("node").alias("root")), "crowds")
    inside = coded.join(crowds, "core").select("node", (F.col("all") - F.col("times")).alias("links"), "root")
    every = found.unionByName(inside)
    rooted = components(every.select(F.col("root").alias("a"), F.col("node").alias("b"))).withColumnsRenamed({"node": "_node", "root": "_root"})
    sums = every.groupBy(F.col("node").alias("_n")).agg(F.sum("links").alias("links"))
    known = (
        counted.join(sums, F.col("node") == F.col("_n"), "left")
        .join(rooted, F.col("node") == F.col("_node"), "left")
        .select("print", "least_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("_root", "node").alias("root"))
    )
    known = written(known, "linked")
    least = known.groupBy("root").agg(F.min("least_id").alias("component"))
    known = known.join(least, "root").select(F.col("print").alias("_print"), "n_links", "component")
    met = given.select("id", "print").join(known, F.col("print") == F.col("_print"), "left")
    component = F.when(F.col("print").isNull(), F.col("id")).otherwise(F.col("component"))
    return met.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component"))
    )
