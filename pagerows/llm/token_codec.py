"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that reset all state, so each block stands alone. A block's ids lie in ``LANES`` stretches, which
are coded side by side, as are many blocks, one numpy lane each; a block's stretches share what they learn. Of each id, two
things are coded, in one interval:

- Whether it is the candidate of the longest context that knows one: what followed the last two ids (order 2, by a hash
  that is checked) or the last id (order 1, the whole id). Each order predicts how likely the candidate is, by how often
  that has come true: order 2 and 1 where they were as sure, order 1 also by whether it agrees, order 0 where the candidate
  was as frequent. Their logits are mixed by learnt weights, and the mixed prediction is refined by what came true where
  all three said the same. Without a candidate this is left out.
- If it isn't, which id it is, by the counts of the block's ids so far (order 0); ids that these don't hold share an
  escape, as likely as there are different ids, and stand as 16 bits beside the coder's words.

Contexts, predictions, weights and counts are learnt each time the block has grown by a part, from all ids since.

Everything is in whole numbers and table look-ups; the float quotients are rounded as IEEE 754 says, so encoder and decoder
agree bit by bit.

A block: magic, number of ids, CRC-32 of the ids, number of 16-bit words (little-endian), then these words: of each lane
how many words it has, of each how many new ids, the lanes' words, the lanes' new ids.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np

BLOCK_IDS = 65_536
#: Stretches of a block; blocks that are coded side by side at most. ``TILE`` ids are worked on at a time where ids are known,
#: so few that they stay in cache.
LANES, GROUP, TILE = 64, 144, 1 << 15
MAGIC = b"TID2"
_HEAD = struct.Struct("<4sIII")
#: A context's slot: what followed (16 bits), check bits (order 2), how sure order 2 and 1 are (2 bits each: 1 to 3), one
#: bit for whether they agree, and how frequent what followed was (2 bits). Order 1 has a slot for each id.
_SLOTS2, _CHECK, _SURE2, _SURE1, _AGREE, _LEVEL = 15, 0xFF80, 5, 3, 2, 3
_SAYS = 128
#: Contexts learn from so many steps at a time. It must not depend on which blocks are coded together, as decoding may not.
_ROWS = 8
_MIX1, _MIX2 = np.uint32(2_654_435_761), np.uint32(2_246_822_519)
_LOW32, _LOW48 = (1 << 32) - 1, (1 << 48) - 1
#: Intervals are parts of 1 << 24; a hit has at most all but 1/64, so that each count still has a part.
_PARTS, _MOST = 24, (1 << 24) - (1 << 18)
#: Logits are in units of 1/512, from probabilities in units of 1/4096 and to such in units of 1/65536; a weight of 1.
_UNIT, _GRID, _ONE = 512, 4096, 1 << 12
_SQUASH = np.array([min(65472, max(64, round(65536 / (1 + math.exp(-x / _UNIT))))) for x in range(-_GRID, _GRID)], "int64")
_STRETCH = np.array([round(_UNIT * math.log((x + 0.5) / (4095.5 - x))) for x in range(4096)], "int64")
#: What orders 2 and 1 have said and how often it came true before a block begins, by how sure they are: of 8, so many.
_PRIOR, _CAME = 8, np.array([0, 2, 4, 6])
#: The mixed prediction counts as so many cases.
_CASES = 24


def _renewals(steps: int) -> list[int]:
    """The steps before which is learnt: each time the block has grown by an eighth."""
    out, t = [], 1
    while t < steps:
        out.append(t)
        t += max(1, t // 8)
    return [*out, steps]


class _Model:
    """What encoder and decoder learn alike of some blocks, whose lanes stand in order of falling length."""

    def __init__(self, sizes: np.ndarray):
        self.blocks = len(sizes)
        stretch = -(-sizes // LANES)
        lengths = np.clip(sizes[:, None] - np.arange(LANES) * stretch[:, None], 0, stretch[:, None]).ravel()
        #: Lanes in the blocks' order, and the block of each.
        self.order = np.argsort(-lengths, kind="stable")
        self.lengths, self.own = lengths[self.order], self.order // LANES
        self.begin = ((np.cumsum(sizes) - sizes)[:, None] + np.arange(LANES) * stretch[:, None]).ravel()[self.order]
        self.steps = int(lengths.max(initial=0))
        self.alive = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(self.steps), side="right")
        #: Ids by step and lane, after two steps of zeros.
        self.ids = np.zeros((self.steps + 2, len(lengths)), "uint16")
        self.base1, self.base2, self.says = self.own << 16, self.own << _SLOTS2, self.own * _SAYS
        self.after1, self.after2 = np.zeros(self.blocks << 16, "uint32"), np.zeros(self.blocks << _SLOTS2, "uint32")
        self.cases, self.hits = np.zeros(self.blocks * _SAYS, "int64"), np.zeros(self.blocks * _SAYS, "int64")
        self.weights = np.full((2, 3, self.blocks), _ONE // 2, "int64")
        #: Place of each id among its block's ids (0: none yet, the escape's), the ids and counts by place.
        self.places, self.kinds = np.zeros(self.blocks << 16, "int32"), np.zeros(self.blocks, "int64")
        self.names, self.counts = np.full((self.blocks, 1), 65536, "int64"), np.ones((self.blocks, 1), "int64")
        self.count()
        self.mix()

    def look(self, prev: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """After the last ids (32 bits) of the first ``n`` lanes: the candidate, and where what the orders say stands."""
        held1 = self.after1.take(self.base1[:n] + prev, mode="clip")
        key = prev * _MIX1
        key += before * _MIX2
        held2 = self.after2.take(self.base2[:n] + (key >> np.uint32(32 - _SLOTS2)), mode="clip")
        key ^= held2
        key &= np.uint32(_CHECK)
        held2 *= key == 0
        held = np.where(held2, held2, held1)
        at = held2 & np.uint32(3 << _SURE2)
        at |= held1 & np.uint32(3 << _SURE1)
        at |= held & np.uint32(_LEVEL)
        held1 ^= held
        at |= (held1 < 65536).astype("uint32") << np.uint32(_AGREE)
        held >>= np.uint32(16)
        return held, self.says[:n] + at

    def learn(self, start: int, until: int, at: np.ndarray, hit: np.ndarray) -> None:
        """From the ids of these steps, what the orders said of them, and whether the candidates came true."""
        n = int(self.alive[start])
        valid = None if self.alive[until - 1] == n else np.arange(start, until)[:, None] < self.lengths[:n]
        if valid is not None:
            at, hit = at[valid], hit[valid]
        self.cases += np.bincount(at.ravel(), minlength=len(self.cases))
        self.hits += np.bincount(at[hit], minlength=len(self.hits))

        known = self.ids[start + 2 : until + 2, :n] + self.base1[:n]
        wide = self.counts.shape[1]
        place = self.places.take(known, mode="clip")
        unknown = np.nonzero(place == 0 if valid is None else valid & (place == 0))
        if len(unknown[0]):
            asked = known[unknown]
            fresh = np.unique(asked)
            of = fresh >> 16
            more = np.bincount(of, minlength=self.blocks)
            spot = self.kinds[of] + np.arange(len(fresh)) - (np.cumsum(more) - more)[of] + 1
            self.kinds += more
            if self.kinds.max() >= wide:
                extra = ((0, 0), (0, int(self.kinds.max()) * 5 // 4 + 1 - wide))
                self.names, self.counts = np.pad(self.names, extra), np.pad(self.counts, extra)
                wide = self.counts.shape[1]
            self.places[fresh] = spot
            self.names[of, spot] = fresh & 0xFFFF
            place[unknown] = self.places.take(asked, mode="clip")
        place = place + self.own[:n] * wide
        self.counts += np.bincount(place.ravel() if valid is None else place[valid], minlength=self.counts.size).reshape(self.counts.shape)
        self.counts[:, 0] = np.maximum(self.kinds, 1)
        self.count()
        share = self.counts * 256
        level = (share >= self.total[:, None]).astype("uint8")
        level += share >= 4 * self.total[:, None]
        level += share >= 16 * self.total[:, None]
        level = level.ravel()

        for t in range(start, until, _ROWS):
            end = min(t + _ROWS, until)
            now, prev, before = (self.ids[t + k : end + k, :n].astype("uint32") for k in (2, 1, 0))
            now <<= np.uint32(16)
            now |= level.take(place[t - start : end - start], mode="clip")
            slot1 = self.base1[:n] + prev
            key = prev * _MIX1
            key += before * _MIX2
            slot2 = self.base2[:n] + (key >> np.uint32(32 - _SLOTS2))
            key &= np.uint32(_CHECK)
            if valid is not None:
                now, slot1, slot2, key = (x[valid[t - start : end - start]] for x in (now, slot1, slot2, key))
            for table, slot, check, sure in ((self.after1, slot1, None, _SURE1), (self.after2, slot2, key, _SURE2)):
                held = table.take(slot, mode="clip")
                same = (held ^ now) < 65536
                strength = held >> np.uint32(sure)
                strength &= np.uint32(3)
                told = now
                if check is not None:
                    mine = ((held ^ check) & np.uint32(_CHECK)) == 0
                    same &= mine
                    strength *= mine
                    told = now | check
                # what has followed several times is not given up at once
                surer = np.minimum(strength + np.uint32(1), np.uint32(3))
                surer <<= np.uint32(sure)
                told = told + np.where(same, surer, np.uint32(1 << sure))
                table[slot] = np.where(same | (strength < 2), told, held - np.uint32(1 << sure))
        self.mix()

    def count(self) -> None:
        self.below = np.cumsum(self.counts, axis=1)
        self.total = self.below[:, -1].copy()
        self.below -= self.counts

    def mix(self) -> None:
        """Probabilities of hits (parts of 1 << 24) and the parts of a count, for each block and all that orders can say."""
        shape = (self.blocks, 4, 4, 2, 4)
        cases, hits = self.cases.reshape(shape), self.hits.reshape(shape)
        known = np.ones((4, 4, 2, 4), bool)
        known[0, 0] = False
        cases, hits = cases * known, hits * known
        inputs = []
        for axes, prior in (((2, 3, 4), _CAME[:, None, None, None]), ((1, 4), _CAME[:, None, None]), ((1, 2, 3), 2)):
            n, h = cases.sum(axis=axes, keepdims=True), hits.sum(axis=axes, keepdims=True)
            inputs.append(_STRETCH[((h + prior) * 4095) // (n + _PRIOR)])
        inputs[0][:, 0] = 0  # says nothing
        inputs[1][:, :, 0] = 0
        inputs = [np.ascontiguousarray(np.broadcast_to(x, shape)).reshape(self.blocks, -1) for x in inputs]
        cases, hits, known = cases.reshape(self.blocks, -1), hits.reshape(self.blocks, -1), known.ravel()
        parts = slice(0, _SAYS // 4), slice(_SAYS // 4, _SAYS)  # weights of their own where order 2 knows a candidate
        p = self.mixed(inputs, parts)
        error, spread = (hits << 16) - cases * p, cases * (p * (65536 - p) >> 16)
        # a third of Newton's step for each weight, over all cases so far
        for i, x in enumerate(inputs):
            slope, bend = error * x, spread * x * x >> 9
            for k, part in enumerate(parts):
                self.weights[k, i] += slope[:, part].sum(axis=1) * (_ONE // 3) // (bend[:, part].sum(axis=1) + (1 << 24))
        np.clip(self.weights, -_ONE, 4 * _ONE, out=self.weights)
        p = ((hits << 24) + self.mixed(inputs, parts) * (_CASES << 8)) // (cases + _CASES)
        np.minimum(p, _MOST, out=p)
        p *= known
        self.p, self.parts = p.ravel(), (((1 << _PARTS) - p) // self.total[:, None]).ravel()

    def mixed(self, inputs: list[np.ndarray], parts: tuple[slice, slice]) -> np.ndarray:
        p = np.empty(inputs[0].shape, "int64")
        for part, weights in zip(parts, self.weights):
            p[:, part] = _SQUASH.take((sum(x[:, part] * w[:, None] for x, w in zip(inputs, weights)) >> 12) + _GRID, mode="clip")
        return p


def _groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Blocks by falling length, some at a time."""
    order = np.argsort(-sizes, kind="stable")
    return np.array_split(order, -(-len(order) // GROUP)) if len(order) else []


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of unsigned 16-bit ids, as bytes each; a block may be empty, and has at most ``BLOCK_IDS`` ids."""
    out: list[bytes] = [b""] * len(blocks)
    for group in _groups(np.array([len(b) for b in blocks], "int64")):
        for k, coded in zip(group.tolist(), _encode([blocks[k] for k in group.tolist()])):
            out[k] = coded
    return out


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks by falling length, side by side."""
    sizes = np.array([len(b) for b in blocks], "int64")
    if sizes.max(initial=0) > BLOCK_IDS:
        raise ValueError(f"blocks have at most {BLOCK_IDS} ids")
    model = _Model(sizes)
    steps, lanes = model.steps, len(model.own)
    flat = np.concatenate([*blocks, np.zeros(1, "uint16")]).astype("uint16")
    for first in range(0, steps, 256):
        some = np.arange(first, min(first + 256, steps))[:, None]
        model.ids[2 + first : 2 + first + len(some)] = flat.take(model.begin + some, mode="clip") * (some < model.lengths)
    low, width = np.zeros(lanes, "int64"), np.full(lanes, 1 << 48, "int64")
    # the k-th words of all lanes lie together, as lanes fill at about the same pace
    words, used = np.zeros((2 * steps + 6) * lanes, "uint16"), np.arange(lanes)
    new_ids, new_lanes = [np.zeros(0, "uint16")], [np.zeros(0, "int64")]

    def carry(at: np.ndarray) -> None:
        while len(at):
            words[at] += np.uint16(1)
            at = at[words[at] == 0] - lanes

    def settle(some: np.ndarray) -> None:
        """Move 16 bits out where the width has become small, after the carry that a sum has left above them."""
        while len(some):
            part, at = low.take(some, mode="clip"), used.take(some, mode="clip")
            over = part > _LOW48
            if over.any():
                carry(at[over] - lanes)
            words[at] = (part >> 32).astype("uint16")
            used[some] = at + lanes
            low[some] = (part & _LOW32) << 16
            wider = width.take(some, mode="clip") << 16
            width[some] = wider
            some = some[wider <= _LOW32]

    start = 0
    for until in _renewals(steps) if steps else []:
        n = int(model.alive[start])
        shape, rows = (until - start, n), max(1, TILE // max(n, 1))
        said, hits, parts, size = np.empty(shape, "int64"), np.empty(shape, bool), np.empty(shape, "int64"), np.empty(shape, "int64")
        wide, packed = model.own[:n] * model.counts.shape[1], (model.below << 20 | model.counts).ravel()
        for t in range(start, until, rows):
            end = min(t + rows, until)
            own = slice(t - start, end - start)
            now, prev, before = (model.ids[t + k : end + k, :n].astype("uint32") for k in (2, 1, 0))
            cand, at = model.look(prev, before, n)
            p, part = model.p.take(at, mode="clip"), model.parts.take(at, mode="clip")
            hit = cand == now
            hit &= p > 0
            spot = model.places.take(model.base1[:n] + now, mode="clip")
            escaped = spot == 0
            escaped &= ~hit
            if model.alive[end - 1] < n:
                escaped &= np.arange(t, end)[:, None] < model.lengths[:n]
            row, lane = np.nonzero(escaped)
            new_ids.append(now[row, lane].astype("uint16"))
            new_lanes.append(lane)
            spot = spot + wide
            found = packed.take(spot, mode="clip")
            size[own] = np.where(hit, p, (found & 0xFFFFF) * part)
            found >>= 20
            part *= found
            part += p
            part *= ~hit
            parts[own], said[own], hits[own] = part, at, hit
        for t in range(start, until):
            n = int(model.alive[t])
            unit = width[:n] >> _PARTS
            low[:n] += unit * parts[t - start, :n]
            unit *= size[t - start, :n]
            width[:n] = unit
            settle(np.flatnonzero(unit <= _LOW32))
        if until < steps:
            model.learn(start, until, said, hits)
        start = until
    # of all numbers in the last interval, one whose words but the first are zero, which needn't be written
    low = (low + _LOW32) >> 32
    carry(used[low > 65535] - lanes)
    words[used] = low.astype("uint16")
    used += lanes
    # back to the blocks' order
    back = np.argsort(model.order)
    lengths = (used // lanes)[back]
    streams = np.ascontiguousarray(words.reshape(-1, lanes)[: int(lengths.max(initial=0))].T)
    which = model.order[np.concatenate(new_lanes)]
    fresh = np.concatenate(new_ids)[np.argsort(which, kind="stable")]
    many = np.bincount(which, minlength=lanes)
    ends = np.cumsum(many)
    done = []
    for k, b in enumerate(blocks):
        own = range(k * LANES, (k + 1) * LANES)
        parts = [lengths[own.start : own.stop], many[own.start : own.stop], *(streams[back[i], : lengths[i]] for i in own)]
        parts.append(fresh[ends[own.start] - many[own.start] : ends[own.stop - 1]])
        coded = np.concatenate([x.astype("<u2") for x in parts])
        done.append(_HEAD.pack(MAGIC, len(b), zlib.crc32(np.asarray(b, "<u4").tobytes()), len(coded)) + coded.tobytes())
    return done


def split_blocks(payload: bytes) -> list[tuple[int, int, np.ndarray]]:
    """``(number of ids, checksum, words)`` of each block in a payload."""
    out, at = [], 0
    while at < len(payload):
        magic, n, crc, words = _HEAD.unpack_from(payload, at)
        if magic != MAGIC:
            raise ValueError("not a block of token ids")
        at += _HEAD.size
        out.append((n, crc, np.frombuffer(payload, "<u2", words, at)))
        at += 2 * words
    return out


def decode_blocks(blocks: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
    """The ids of each block; a wrong checksum raises ValueError."""
    out: list = [None] * len(blocks)
    for group in _groups(np.array([n for n, _, _ in blocks], "int64")):
        for k, ids in zip(group.tolist(), _decode([blocks[k] for k in group.tolist()])):
            out[k] = ids
    return out


def _decode(blocks: list[tuple[int, int, np.ndarray]]) -> list[np.ndarray]:
    """Blocks by falling length, side by side."""
    sizes = np.array([n for n, _, _ in blocks], "int64")
    if sizes.max(initial=0) > BLOCK_IDS or any(len(w) < 2 * LANES or len(w) != 2 * LANES + int(w[: 2 * LANES].sum(dtype="int64")) for _, _, w in blocks):
        raise ValueError("a block of token ids is damaged")
    model = _Model(sizes)
    steps, lanes = model.steps, len(model.own)
    heads = np.stack([w[: 2 * LANES] for _, _, w in blocks]).astype("int64")
    lengths, many = heads[:, :LANES].ravel(), heads[:, LANES:].ravel()
    back = np.argsort(model.order)
    size = int(lengths.max()) + 4
    streams = np.zeros((lanes, size), "uint16")
    for k, (_, _, own) in enumerate(blocks):
        at = 2 * LANES
        for i in range(k * LANES, (k + 1) * LANES):
            streams[back[i], : lengths[i]] = own[at : at + lengths[i]]
            at += lengths[i]
    words = np.ascontiguousarray(streams.T).ravel()
    del streams
    fresh = np.concatenate([*(w[len(w) - int(h[LANES:].sum()) :] for (_, _, w), h in zip(blocks, heads)), np.zeros(1, "uint16")])
    next_new = (np.cumsum(many) - many)[model.order]
    lane = np.arange(lanes)
    code = words[lane].astype("int64") << 32 | words[lane + lanes].astype("int64") << 16 | words[lane + 2 * lanes]
    used, last = lane + 3 * lanes, (size - 1) * lanes
    width = np.full(lanes, 1 << 48, "int64")
    ids = model.ids

    def settle(some: np.ndarray) -> None:
        while len(some):
            at = used.take(some, mode="clip")
            code[some] = code.take(some, mode="clip") << 16 | words.take(at, mode="clip")
            used[some] = np.minimum(at + lanes, last)
            wider = width.take(some, mode="clip") << 16
            width[some] = wider
            some = some[(wider <= _LOW32) & (wider > 0)]

    start = 0
    prev, before = np.zeros(lanes, "uint32"), np.zeros(lanes, "uint32")
    for until in _renewals(steps) if steps else []:
        spread = np.repeat(np.arange(model.counts.size, dtype="int32"), model.counts.ravel())
        packed = (model.names << 40 | model.below << 20 | model.counts).ravel()
        row = (np.cumsum(model.total) - model.total)[model.own]
        n = int(model.alive[start])
        said, hits = np.zeros((until - start, n), "int64"), np.zeros((until - start, n), bool)
        for t in range(start, until):
            n = int(model.alive[t])
            cand, at = model.look(prev[:n], before[:n], n)
            p, parts = model.p.take(at, mode="clip"), model.parts.take(at, mode="clip")
            part = code[:n]
            unit = width[:n] >> _PARTS
            # exact, as both are below 2 ** 53 and their quotients far below
            value = (part / unit).astype("int64")
            hit = value < p
            value -= p
            spot = (value / parts).astype("int64")
            spot += row[:n]
            found = packed.take(spread.take(spot, mode="clip"), mode="clip")
            below = found >> 20
            below &= 0xFFFFF
            below *= parts
            below += p
            below *= ~hit
            below *= unit
            part -= below
            parts *= found & 0xFFFFF
            unit *= np.where(hit, p, parts)
            width[:n] = unit
            settle(np.flatnonzero(unit <= _LOW32))
            found >>= 40
            now = np.where(hit, cand, found)
            new = np.flatnonzero(now > 65535)
            if len(new):
                spot = next_new.take(new)
                now[new] = fresh.take(spot, mode="clip")
                next_new[new] = spot + 1
            ids[t + 2, :n] = now
            said[t - start, :n], hits[t - start, :n] = at, hit
            before[:n] = prev[:n]
            prev[:n] = now
        del spread, packed
        if until < steps:
            model.learn(start, until, said, hits)
        start = until
    flat = np.zeros(int(sizes.sum()) + 1, "uint16")
    for i in range(lanes):
        flat[model.begin[i] : model.begin[i] + model.lengths[i]] = ids[2 : 2 + model.lengths[i], i]
    result, ends = [], np.cumsum(sizes)
    for (n, crc, _), end in zip(blocks, ends.tolist()):
        own = flat[end - n : end]
        if zlib.crc32(own.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum differs: a block of token ids is damaged")
        result.append(own)
    return result
