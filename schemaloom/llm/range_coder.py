"""Adaptive context-mixing range coder for blocks of token ids, in numpy.

Blocks are independent: each starts from the same state, so any block can be decoded alone. Many blocks are coded at once,
one per lane: step t codes the t-th id of every lane with vector operations.

Order 0 is the distribution of all ids that are coded together, in 2^18ths or finer. It is stored beside the blocks (the
``prior``); blocks that share one are coded by the same tables. Order 2 and order 1 remember, in each lane and by hash of
the last two ids and of the last one, which id followed there and how often it was right (0 to 3). The weights of the three
are learned as the block goes on: for each pair of confidences, how often order 2 is right, and how often order 1 is when
order 2 is not; what is left goes to order 0. An id gets the interval of the first order that names it, so every id keeps a
share, and a carrying 64-bit range coder codes that.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict

import numpy as np

#: Ids of a block and lanes coded at once, at most.
BLOCK, LANES = 1024, 2048
#: Least length of the blocks into which a small rest is cut, so that few lanes never make many steps.
SHORTEST = 256

_BITS2, _BITS1 = 10, 9
_SHARE = 16  # shares of orders 2 and 1 are in 2^16ths
_RATE, _LIMIT = 4, 1 << 8
_TRUST = np.array([0, 0, 1, 2, 1, 2, 3, 3])  # by confidence + 4 if right
_HEAD = "<4sII"  # magic, ids, crc32 of the ids
_MAGIC = b"ACM2"
_U = np.uint64


class Prior:
    """The ids that occur, ascending, and their shares in 2^bits."""

    def __init__(self, ids: np.ndarray, shares: np.ndarray, bits: int) -> None:
        self.ids, self.bits = ids.astype(np.int64), bits
        self.ends = np.concatenate([[0], np.cumsum(shares)]).astype(np.int64)

    @staticmethod
    def of(ids: np.ndarray) -> Prior:
        counts = np.bincount(ids)
        own = np.nonzero(counts)[0]
        bits = max(18, len(own).bit_length() + 2)
        spare = (1 << bits) - len(own)
        shares = 1 + counts[own].astype(np.float64) * spare // max(len(ids), 1)
        shares = shares.astype(np.int64)
        if len(own):
            shares[shares.argmax()] += (1 << bits) - shares.sum()
        return Prior(own, shares, bits)

    def dump(self) -> bytes:
        steps = np.diff(self.ids, prepend=0).astype("<u4")
        shares = np.diff(self.ends).astype("<u4")
        # Byte planes of numbers that are mostly small compress well.
        planes = np.concatenate([steps, shares]).view(np.uint8).reshape(-1, 4).T.tobytes()
        return struct.pack("<BI", self.bits, len(steps)) + zlib.compress(planes, 6)

    @staticmethod
    def load(raw: bytes) -> Prior:
        bits, n = struct.unpack_from("<BI", raw)
        numbers = np.ascontiguousarray(np.frombuffer(zlib.decompress(raw[5:]), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        if len(numbers) != 2 * n or not 18 <= bits <= 32 or numbers[n:].sum() != (1 << bits) * bool(n):
            raise ValueError("damaged")
        return Prior(np.cumsum(numbers[:n]), numbers[n:], bits)

    def places(self) -> np.ndarray:
        """Place of the id in whose share each 2^bits-th lies."""
        return np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.ends))


class _Model:
    """Orders 2 and 1 and the weights of all lanes; ids are places in the prior."""

    def __init__(self, lanes: int, bits: int) -> None:
        lane = np.arange(lanes)
        self.bits = bits
        self.slots2, self.slots1 = np.zeros(lanes << _BITS2, np.uint32), np.zeros(lanes << _BITS1, np.uint32)
        self.lane2, self.lane1, self.lane_state = lane << _BITS2, lane << _BITS1, lane << 5
        self.right2, self.right1 = (np.full(lanes << 5, 1 << (_SHARE - 2), np.int64) for _ in range(2))
        self.hashed = self.before = np.zeros(lanes, np.int64)

    def predict(self) -> None:
        self.at1 = self.lane1 + ((self.hashed >> 12) & ((1 << _BITS1) - 1))
        self.at2 = self.lane2 + (((self.hashed + 5 * self.before) >> 11) & ((1 << _BITS2) - 1))
        slot2, slot1 = self.slots2.take(self.at2), self.slots1.take(self.at1)
        self.trust2, self.trust1 = slot2 & 3, slot1 & 3
        self.guess2, self.guess1 = slot2 >> 2, slot1 >> 2
        self.state = self.lane_state + ((self.trust2 << 3) + (self.trust1 << 1) + (self.guess2 == self.guess1))
        self.share2, self.share1 = self.right2.take(self.state), self.right1.take(self.state)
        self.mass1 = ((1 << _SHARE) - self.share2) * self.share1 >> _SHARE
        self.skip = self.share2 + self.mass1
        self.rest = (1 << _SHARE) - self.skip

    def update(self, own: np.ndarray, hit2: np.ndarray, hit1: np.ndarray) -> None:
        """``hit2``: order 2 was right; ``hit1``: it was wrong and order 1 right."""
        goal = (1 << _SHARE) - 2 * _LIMIT
        self.right2[self.state] = self.share2 + ((hit2 * goal + (_LIMIT - self.share2)) >> _RATE)
        # Order 1 learns only where order 2 was wrong.
        self.right1[self.state] = self.share1 + (((hit1 * goal + (_LIMIT - self.share1)) >> _RATE) * ~hit2)
        seen = own.astype(np.uint32)
        for slots, at, guess, trust in ((self.slots2, self.at2, self.guess2, self.trust2), (self.slots1, self.at1, self.guess1, self.trust1)):
            # One step of trust up if right (3 at most), down if wrong; a wrong guess without trust is replaced.
            case = trust + ((guess == seen) * np.uint32(4))
            slots[at] = (np.where(case, guess, seen) << 2) + _TRUST32.take(case)
        self.before, self.hashed = self.hashed, own * 0x9E3779


_TRUST32 = _TRUST.astype(np.uint32)


def _encode_lanes(ids: np.ndarray, prior: Prior) -> list[bytes]:
    """``ids``: (steps, lanes), places in the prior."""
    steps, lanes = ids.shape
    model, total = _Model(lanes, prior.bits), _U(_SHARE + prior.bits)
    begins, shares = prior.ends[:-1], np.diff(prior.ends)
    width = steps + 64
    words = np.zeros((lanes, width), np.int32)
    place = np.zeros(lanes, np.int64)
    lane = np.arange(lanes)
    low, span = np.zeros(lanes, _U), np.full(lanes, (1 << 64) - 1, _U)
    for t in range(steps):
        if t % 16 == 0 and int(place.max()) + 64 > width:
            words = np.concatenate([words, np.zeros((lanes, width), np.int32)], 1)
            width *= 2
        own = ids[t].astype(np.int64)
        model.predict()
        hit2 = own == model.guess2
        hit1 = (own == model.guess1) & ~hit2
        start = (model.skip << prior.bits) + model.rest * begins.take(own)
        length = model.rest * shares.take(own)
        if len(one := np.nonzero(hit1)[0]):
            start[one], length[one] = model.share2[one] << prior.bits, model.mass1[one] << prior.bits
        if len(two := np.nonzero(hit2)[0]):
            start[two], length[two] = 0, model.share2[two] << prior.bits
        scale = span >> total
        add = scale * start.view(_U)
        low = low + add
        if len(over := np.nonzero(low < add)[0]):
            words[over, place[over] - 1] += 1
        span = scale * length.view(_U)
        while len(small := np.nonzero(span < _U(1 << 48))[0]):
            words[small, place[small]] = (low[small] >> _U(48)).astype(np.int32)
            place[small] += 1
            low[small] <<= _U(16)
            span[small] <<= _U(16)
        model.update(own, hit2, hit1)
    for _ in range(4):
        words[lane, place] = (low >> _U(48)).astype(np.int32)
        place += 1
        low <<= _U(16)
    for k in range(int(place.max()) - 1, 0, -1):  # carries run from the last word to the first
        over = words[:, k] >> 16
        if over.any():
            words[:, k - 1] += over
            words[:, k] &= 0xFFFF
    return [row[:n].astype(">u2").tobytes() for row, n in zip(words, place)]


def _decode_lanes(streams: list[bytes], steps: int, prior: Prior) -> np.ndarray:
    lanes = len(streams)
    model, total = _Model(lanes, prior.bits), _U(_SHARE + prior.bits)
    begins, shares, places = prior.ends[:-1], np.diff(prior.ends), prior.places()
    width = max(len(s) for s in streams) // 2 + 4
    words = np.zeros((lanes, width), np.uint16)
    for n, s in enumerate(streams):
        words[n, : len(s) // 2] = np.frombuffer(s[: len(s) // 2 * 2], ">u2")
    words = words.ravel()
    place = np.arange(lanes) * width + 4
    code = np.zeros(lanes, _U)
    for k in range(4):
        code = (code << _U(16)) | words[place - 4 + k]
    span = np.full(lanes, (1 << 64) - 1, _U)
    top = _U((1 << int(total)) - 1)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        model.predict()
        scale = span >> total
        # What division leaves over at the end of the whole interval belongs to nobody and never occurs.
        value = np.minimum(code // scale, top).view(np.int64)
        upper = value >> prior.bits
        hit2 = upper < model.share2
        hit1 = ~hit2 & (upper < model.skip)
        own = np.where(hit2, model.guess2, model.guess1).astype(np.int64)
        start = np.where(hit2, 0, model.share2) << prior.bits
        length = np.where(hit2, model.share2, model.mass1) << prior.bits
        if len(rest := np.nonzero(upper >= model.skip)[0]):
            share, skip = model.rest[rest], model.skip[rest] << prior.bits
            into = ((value[rest] - skip).view(_U) // share.view(_U)).view(np.int64)
            found = places.take(into, mode="clip")
            own[rest], start[rest], length[rest] = found, skip + share * begins.take(found), share * shares.take(found)
        code = code - scale * start.view(_U)
        span = scale * length.view(_U)
        while len(small := np.nonzero(span < _U(1 << 48))[0]):
            at = place[small]
            code[small] = (code[small] << _U(16)) | words.take(at, mode="clip")
            place[small] += 1
            span[small] <<= _U(16)
            if t + 1 == steps and (span[small] == 0).any():
                break
        out[t] = own
        model.update(own, hit2, hit1)
    return out


def _check(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def cuts(total: int, block: int = BLOCK) -> list[int]:
    """Where a sequence of ``total`` ids is cut into blocks of about one length, for as few steps as it needs."""
    if not total:
        return [0]
    count = max(-(-total // block), min(LANES, -(-total // SHORTEST)))
    return [total * n // count for n in range(count + 1)]


def encode_with_prior(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[bytes]]:
    """The prior of a sequence of ids and its blocks; see ``cuts`` for which ids they hold."""
    edges, prior, blocks = cuts(len(ids), block), Prior.of(ids), []
    place = np.zeros(int(prior.ids[-1]) + 1 if len(prior.ids) else 1, np.int32)
    place[prior.ids] = np.arange(len(prior.ids))
    for begin in range(0, len(edges) - 1, LANES):
        parts = [ids[a:b] for a, b in zip(edges[begin : begin + LANES], edges[begin + 1 : begin + LANES + 1])]
        padded = np.zeros((max(map(len, parts)), len(parts)), np.int32)
        for n, part in enumerate(parts):
            padded[: len(part), n] = place[part]
        for part, stream in zip(parts, _encode_lanes(padded, prior)):
            blocks.append(struct.pack(_HEAD, _MAGIC, len(part), _check(part)) + stream)
    return prior.dump(), blocks


def decode_with_priors(blocks: list[bytes], priors: list[bytes]) -> list[np.ndarray]:
    """The ids of each block, by its prior. A block that does not give the ids of its checksum is an error."""
    heads = [struct.unpack_from(_HEAD, b) for b in blocks]
    if any(h[0] != _MAGIC for h in heads):
        raise ValueError("not a block of this format")
    found: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    groups = defaultdict(list)
    for n, p in enumerate(priors):
        groups[p].append(n)
    for raw, members in groups.items():
        try:
            prior = Prior.load(raw)
        except (ValueError, zlib.error, struct.error) as problem:
            raise ValueError(f"blocks {members} are damaged: their prior cannot be read") from problem
        names = prior.ids.astype(np.uint32)
        order = [n for n in sorted(members, key=lambda n: heads[n][1]) if heads[n][1] and len(prior.ids)]
        for begin in range(0, len(order), LANES):
            own = order[begin : begin + LANES]
            # A length that no such stream can hold is damage, not a reason to go on for long.
            steps = min(max(heads[n][1] for n in own), 64 * max(len(blocks[n]) for n in own) * 8)
            ids = _decode_lanes([blocks[n][struct.calcsize(_HEAD) :] for n in own], steps, prior)
            for k, n in enumerate(own):
                found[n] = names[ids[: heads[n][1], k]]
    for n, (ids, head) in enumerate(zip(found, heads)):
        if len(ids) != head[1] or _check(ids) != head[2]:
            raise ValueError(f"block {n} is damaged: its ids do not give its checksum")
    return found


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> list[bytes]:
    """Blocks of a sequence of ids below ``vocabulary`` that carry their prior with them."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < vocabulary:
        raise ValueError("ids outside the vocabulary")
    prior, blocks = encode_with_prior(ids, block)
    return [b[: struct.calcsize(_HEAD)] + struct.pack("<I", len(prior)) + prior + b[struct.calcsize(_HEAD) :] for b in blocks]


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks of ``encode``."""
    size, bare, priors = struct.calcsize(_HEAD), [], []
    for b in blocks:
        if b[:4] != _MAGIC:
            raise ValueError("not a block of this format")
        (n,) = struct.unpack_from("<I", b, size)
        priors.append(b[size + 4 : size + 4 + n])
        bare.append(b[:size] + b[size + 4 + n :])
    return decode_with_priors(bare, priors)
