"""Adaptive context-mixing range coder for token ids.

A block of ids is coded alone: its model starts empty, and a CRC of the ids
goes with it.  Blocks are the lanes of numpy arrays, so one step codes one id
of every block.  For each id the model

* looks up the id last seen after the same two ids (order 2) and after the same
  id (order 1), each with a flag that tells if the entry was right last time;
* mixes the two orders' estimates of "order 2 is right", "order 1 is right" and
  "neither", learnt by flag and by agreement, by weights that the block learns
  from how well each order has estimated so far, and codes which of them holds;
* if neither, codes the id's class with the order-0 estimate of this block; its
  place in the class is even, so its bits go past the coder as they are.

The looked-up ids adapt with every id, the estimates after every `SEGMENT` ids.
Weights come from sums of squared errors, so that sums, products and quotients
alone decide: they are the same on every machine, as exponentials need not be.
The coder keeps 60 bits of range, which both choices of an id fit into, and moves
32 bits at a time; carries are resolved when a block is complete.  A block's bits
past the coder lie behind its coded words, from its last word backwards.  All that
does not depend on the coder's state is worked out for `STEPS` ids of a lane at once.
"""

from __future__ import annotations

import zlib

import numpy as np

BITS = 12
TOTAL = 1 << BITS
SEGMENT = 256
#: Ids of each lane that are prepared at once; divides SEGMENT.
STEPS = 16
#: Bits of range; a word is moved when fewer than WORD_LEAST are left.
RANGE, WORD_LEAST = 60, 28
ORDER1_BITS, ORDER2_BITS = 10, 11
#: Classes of the order-0 estimate: `count` classes of 2**bits ids each, in id order; the last kind goes on as far as ids do.
KINDS = ((16, 4), (15, 8), (None, 12))


def _classes(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first id, bits) of each class so that ids up to `most` have one."""
    first, bits, at = [], [], 0
    for count, b in KINDS:
        while at <= most and (count is None or count > 0):
            first.append(at)
            bits.append(b)
            at += 1 << b
            count = None if count is None else count - 1
    return np.array(first, np.int32), np.array(bits, np.uint32)


def _filled(size: int) -> np.ndarray:
    """Zeros in memory that numpy asks large pages for, as it does not for np.zeros(): entries are looked up all over it."""
    out = np.empty(size, np.int32)
    out.fill(0)
    return out


class Model:
    """State of `lanes` blocks of ids up to `most`."""

    def __init__(self, lanes: int, most: int) -> None:
        self.first, self.bits = _classes(most)
        n = len(self.first)
        self.lanes, self.lane = lanes, np.arange(lanes, dtype=np.int32)
        # Entries of both orders in one array, looked up by two rows at once: how often a row's hash is shifted, its mask, its lanes' places.
        self.down, self.mask = np.array([[4], [15]], np.int32), np.array([[(1 << ORDER1_BITS) - 1], [(1 << ORDER2_BITS) - 1]], np.int32)
        self.base = np.stack([self.lane << ORDER1_BITS, (lanes << ORDER1_BITS) + (self.lane << ORDER2_BITS)])
        self.entries = _filled((lanes << ORDER1_BITS) + (lanes << ORDER2_BITS))  # id * 4 + right last time, which is 1 for order 1 and 2 for order 2
        self.seen = np.zeros((2, 4, 3, lanes), np.int32)  # by order, by flag and agreement: which held
        self.seen[:, :, 0], self.seen[:, :, 1], self.seen[:, :, 2] = 1, 1, 6
        self.error = np.full((2, lanes), 8.0)  # by order: squared errors so far
        self.used = np.ones((n, lanes), np.int32)
        self.held = np.zeros((SEGMENT, lanes), np.int32)
        self.class_of = np.full((SEGMENT, lanes), n, np.int32)
        self.prev1, self.prev2 = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)
        self.step = 0
        self.estimate()

    def estimate(self) -> None:
        share = self.share = self.seen / self.seen.sum(2, keepdims=True)
        near = 1 / (self.error * self.error * self.error)
        weight = near[0] / (near[0] + near[1])
        mixed = weight * share[0][[0, 0, 1, 1, 2, 2, 3, 3]] + (1 - weight) * share[1][[0, 1, 0, 1, 2, 3, 2, 3]]  # by agreement, order 2's flag, order 1's flag
        f = (mixed[:, :2] * (TOTAL - 128)).astype(np.int64) + 16
        # By context and lane, 16 bits each: 0, order 2 is right, order 2 or order 1 is right, TOTAL.
        self.choices = (f[:, 0] << 16 | f[:, 0] + f[:, 1] << 32 | TOTAL << 48).ravel().view(np.uint64)
        n = len(self.first)
        total = np.cumsum(self.used, 0)
        edge = (total * ((TOTAL - n) / total[-1])).astype(np.int32) + np.arange(1, n + 1, dtype=np.int32)[:, None]
        edge[-1] = TOTAL
        self.high = edge[:-1].astype(np.int16)
        # By class and lane, 16 bits each: start, width; the class after the last one is the whole, for ids that need none.
        start = np.zeros((n + 1, self.lanes), np.uint32)
        start[1:n] = edge[:-1]
        width = np.full((n + 1, self.lanes), TOTAL, np.uint32)
        width[:n] = edge.view(np.uint32) - start[:n]
        self.parts = (start | width << np.uint32(16)).ravel()

    def part(self, kind: np.ndarray, lane: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of the classes, in units of r."""
        width = self.parts.take(kind * self.lanes + lane, mode="clip").astype(np.uint64)
        start = width & _LOW16
        start *= r
        width >>= _16
        width *= r
        return start, width

    def places(self, prev1: np.ndarray, prev2: np.ndarray) -> np.ndarray:
        """Where the ids after prev1, and after prev2 and prev1, are looked up."""
        k = prev1[..., None, :] * _FACTORS
        k[..., 1, :] += prev2 * np.int32(-1640531535)
        k >>= self.down
        k &= self.mask
        k += self.base
        return k.astype(np.intp)  # the index type, made once and not by each use

    def context(self, e: np.ndarray) -> np.ndarray:
        """Of the entries looked up: whether they agree, and their flags."""
        one, two = e[..., 0, :], e[..., 1, :]
        c = one | two
        c &= 3
        c += ((one ^ two).view(np.uint32) < 4).view(np.int8) << 2
        return c

    def predict(self) -> np.ndarray:
        """Look up after the last two ids; the lanes' choices, as estimate() packs them."""
        self.k = self.places(self.prev1, self.prev2)
        e = self.entries.take(self.k, mode="clip")
        self.now = self.context(e)
        e >>= 2
        self.p, (self.p1, self.p2) = e, e
        return self.choices.take(self.now * np.intp(self.lanes) + self.lane, mode="clip")

    def update(self, ids: np.ndarray, hit2: np.ndarray, held: np.ndarray, at: np.ndarray, kind: np.ndarray) -> None:
        """held: 0, 1 or 2 as order 2, order 1 or neither was right."""
        right = (self.p == ids) * _FLAGS
        right |= ids << 2
        self.entries[self.k] = right
        self.prev2, self.prev1 = self.prev1, ids
        np.multiply(self.now, 3, out=self.held[self.step])
        self.held[self.step] += held
        self.class_of[self.step][at] = kind
        self.step += 1
        if self.step == SEGMENT:
            self.learn()

    def learn(self) -> None:
        n, step = len(self.first), self.step
        seen = np.bincount((self.held[:step] * self.lanes + self.lane).ravel(), minlength=24 * self.lanes).reshape(2, 2, 2, 3, self.lanes)
        for order, n_held in enumerate((seen.sum(2).reshape(4, 3, -1), seen.sum(1).reshape(4, 3, -1))):
            p = self.share[order]
            self.error[order] += (n_held * (1 - 2 * p + (p * p).sum(1, keepdims=True))).reshape(12, -1).sum(0)
            self.seen[order] += n_held
        used = np.bincount((self.class_of[:step] * self.lanes + self.lane).ravel(), minlength=(n + 1) * self.lanes)
        self.used += (4 * used.reshape(n + 1, self.lanes)[:n]).astype(np.int32)
        self.class_of[:] = n
        self.step = 0
        self.estimate()


#: By order: factor of the last id in its hash, flag in an entry.
_FACTORS, _FLAGS = np.array([[40503], [-2048144777]], np.int32), np.array([[1], [2]], np.int32)
_BITS, _WORD, _MOVE, _KEPT = np.uint64(BITS), np.uint64(32), np.uint64(WORD_LEAST), np.uint64((1 << WORD_LEAST) - 1)
_FOUR, _LOW4, _32 = np.uint32(4), np.uint32(15), np.uint32(32)
_SHORT, _16, _LOW16 = np.uint64(1 << WORD_LEAST), np.uint64(16), np.uint64(0xFFFF)


def _raw_words(values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words of each row's values one after another, number of words by row)."""
    ends = np.cumsum(bits, 1, dtype=np.int32)
    count = (ends[:, -1] + 15) >> 4
    room = int(count.max(initial=0)) + 2
    at = ends - bits
    window = values.astype(np.int64) << (32 - bits - (at & 15))  # of the word in which a value begins and the next one
    at >>= 4
    at += (np.arange(len(values), dtype=np.int32) * room)[:, None]
    # No two values share a bit, so sums join them, and doubles hold them exactly.
    sums = np.bincount(at.ravel(), window.ravel(), len(values) * room).astype(np.uint64)
    words = (sums >> _16).astype(np.uint16)
    words[1:] |= sums[:-1].astype(np.uint16)
    return words.reshape(-1, room), count


def encode_blocks(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(16-bit words of all blocks, words of each block, largest id). ids is cut into blocks of `size`."""
    lanes = -(-len(ids) // size)
    most = int(ids.max(initial=0))
    steps = min(size, len(ids))
    whole = len(ids) // size
    grid = np.zeros((steps + 2, lanes), np.int32)  # after two zeros; the only copy of the ids
    grid[2:, :whole] = ids[: whole * size].reshape(whole, size).T[:steps]
    grid[2 : len(ids) - whole * size + 2, whole:] = ids[whole * size :, None]
    m = Model(lanes, most)
    n = len(m.first)
    kind_of = np.repeat(np.arange(n, dtype=np.int16), 1 << m.bits.astype(np.int64))
    kinds = np.empty((steps, lanes), np.int16)
    most_moved = SEGMENT + 3  # a step moves a word at most
    room = min(steps, steps // 4 + SEGMENT) + most_moved  # of a lane; made larger where ids take more
    out, count = np.zeros(lanes * room, np.uint64), np.arange(lanes, dtype=np.int64) * room
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, 1 << RANGE, np.uint64)
    r, add, short = np.empty(lanes, np.uint64), np.empty(lanes, np.uint64), np.empty(lanes, bool)

    for step in range(0, steps, STEPS):
        if step % SEGMENT == 0:
            used = int((count - np.arange(lanes, dtype=np.int64) * room).max(initial=0))
            if used + most_moved > room:
                wider = np.zeros((lanes, 2 * room), np.uint64)
                wider[:, :room] = out.reshape(lanes, room)
                count += np.arange(lanes, dtype=np.int64) * room
                out, room = wider.ravel(), 2 * room
        x = grid[step + 2 : min(step + STEPS, steps) + 2]
        here = len(x)
        k = m.places(grid[step + 1 : step + 1 + here], grid[step : step + here])
        e, shifted = np.empty(k.shape, np.int32), x << 2
        for j in range(here):
            right = ((m.entries.take(k[j], out=e[j], mode="clip") ^ shifted[j]).view(np.uint32) < 4) * _FLAGS
            right |= shifted[j]
            m.entries[k[j]] = right
        right = (e ^ shifted[:, None]).view(np.uint32) < 4
        hit2 = right[:, 1]
        none = ~(right[:, 0] | hit2)
        held = (~hit2).view(np.int8) + none.view(np.int8)
        context = m.context(e)
        choice = m.choices.take(context * np.intp(lanes) + m.lane)
        choice >>= held.astype(np.uint64) << np.uint64(4)
        lo = choice & _LOW16
        choice >>= _16
        choice &= _LOW16
        choice -= lo
        kind = kinds[step : step + here]
        kind[:] = np.where(none, kind_of.take(x), np.int16(n))
        part = m.parts.take(kind * np.intp(lanes) + m.lane).astype(np.uint64)
        start = part & _LOW16
        part >>= _16
        for j in range(here):
            for begin, width in ((lo[j], choice[j]), (start[j], part[j])):
                np.right_shift(span, _BITS, out=r)
                np.multiply(r, begin, out=add)
                low += add
                np.multiply(r, width, out=span)
            np.less(span, _SHORT, out=short)
            at = np.flatnonzero(short)
            if len(at):
                moved, place = low.take(at), count.take(at)
                out[place] = moved >> _MOVE
                count[at] = place + 1
                moved &= _KEPT
                low[at] = moved << _WORD
                span[at] = span.take(at) << _WORD
        m.held[m.step : m.step + here] = context * 3 + held
        m.class_of[m.step : m.step + here] = kind
        m.step += here
        if m.step == SEGMENT:
            m.learn()
    # The end of a block: the first 48 bits of a number in the range, whatever follows them.
    low += np.uint64((1 << 12) - 1)
    out[count] = low >> _MOVE
    out[count + 1] = low >> np.uint64(12) << _16 & np.uint64(0xFFFFFFFF)
    count += 2 - np.arange(lanes, dtype=np.int64) * room
    used = out.reshape(lanes, room)[:, : int(count.max(initial=0))]
    while used.max(initial=0) > 0xFFFFFFFF:
        carry = used[:, 1:] >> _WORD
        used &= np.uint64(0xFFFFFFFF)
        used[:, :-1] += carry
    count = 2 * count - 1
    shift = np.append(m.bits, 0).astype(np.int32)
    base = np.append(m.first, 0)
    whole_words, total = [], count.copy()
    for a in range(0, lanes, 64):
        b = min(a + 64, lanes)
        kind = np.ascontiguousarray(kinds[:, a:b].T)
        bits = shift.take(kind)
        raw, n_raw = _raw_words(np.where(bits > 0, grid[2:, a:b].T - base.take(kind), 0), bits)
        total[a:b] += n_raw
        coded = used[a:b].astype(">u4").view(">u2")
        both = np.concatenate([coded, raw[:, ::-1]], 1, dtype=np.uint16, casting="same_kind")
        at = np.arange(both.shape[1])
        whole_words.append(both[(at < count[a:b, None]) | (at >= both.shape[1] - n_raw[:, None])])
    return np.concatenate([np.zeros(0, np.uint16), *whole_words]), total, most


def decode_blocks(words: np.ndarray, count: np.ndarray, size: int, most: int, total: int) -> np.ndarray:
    """The ids that encode_blocks() was given; any run of whole blocks can be decoded alone."""
    lanes = len(count)
    steps = min(size, total)
    m = Model(lanes, most)
    n = len(m.first)
    ends = np.cumsum(count)
    first = ends - count
    words = np.r_[np.zeros(1, np.uint32), words.astype(np.uint32), np.zeros(6, np.uint32)]
    # From each word on: the 32 bits past the range's last whole word; from each word back: it and the one before.
    coded = words[1:-2] << np.uint32(28) | words[2:-1] << np.uint32(12) | words[3:] >> np.uint32(4)
    raw = words[1:] << np.uint32(16) | words[:-1]
    x = np.zeros(lanes, np.uint64)
    for k in range(4):
        x = x << _16 | words[first + k + 1]
    x >>= np.uint64(64 - RANGE)
    at_coded, end, at_raw = first + 3, (ends - 1).astype(np.uint32), np.zeros(lanes, np.uint32)  # the last in bits
    span = np.full(lanes, 1 << RANGE, np.uint64)
    grid = np.empty((steps, lanes), np.int32)
    bits, base = np.append(m.bits, 0).astype(np.uint32), np.append(m.first, 0)  # those of the class after the last one too
    below, few, lane = np.empty(m.high.shape, bool), np.int8 if n < 128 else np.int32, m.lane.astype(np.intp)

    for step in range(steps):
        choice = m.predict()
        r = span >> _BITS
        a = choice >> _16
        a &= _LOW16
        a *= r
        b = choice >> _WORD
        b &= _LOW16
        b *= r
        hit2, known = x < a, x < b
        held = np.int8(2) - hit2.view(np.int8)
        held -= known.view(np.int8)
        choice >>= held.astype(np.uint64) << np.uint64(4)
        lo = choice & _LOW16
        choice >>= _16
        choice &= _LOW16
        choice -= lo
        lo *= r
        x -= lo
        choice *= r
        r = choice
        r >>= _BITS
        v = x.view(np.int64) / r.view(np.int64)  # as doubles; what rounding does to it is mended below
        np.less_equal(m.high, v.astype(np.int16), out=below)
        kind = np.add.reduce(below.view(np.int8), 0, dtype=few).astype(np.intp)
        np.maximum(kind, known * np.intp(n), out=kind)
        lo, part = m.part(kind, lane, r)
        x -= lo
        outside = x >= part
        if outside.any():
            at = np.flatnonzero(outside)
            x[at] += lo[at]
            kind[at] = np.where(known[at], n, (m.high[:, at] <= (x[at] // r[at]).astype(np.int64)).sum(0))
            lo, part[at] = m.part(kind[at], at, r[at])
            x[at] -= lo
        span = part
        shift = bits.take(kind, mode="clip")
        value = raw.take(end - (at_raw >> _FOUR), mode="clip")
        value <<= at_raw & _LOW4
        value >>= _32 - shift  # none where that is 32
        at_raw += shift
        ids = np.where(hit2, m.p2, m.p1)
        ids *= known
        ids += base.take(kind, mode="clip")
        ids += value.view(np.int32)
        at = np.flatnonzero(span < _SHORT)
        if len(at):
            place = at_coded.take(at)
            x[at] = x.take(at) << _WORD | coded.take(place, mode="clip")
            span[at] = span.take(at) << _WORD
            at_coded[at] = place + 2
        m.update(ids, hit2, held, slice(None), kind)
        grid[step] = ids
    return grid.T.ravel()[:total]


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
