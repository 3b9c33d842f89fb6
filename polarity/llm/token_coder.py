"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of ``block`` ids. Every block starts with an empty
model, has a checksum, and can be decoded by itself; blocks of a group are
coded side by side, one id of each per step, with numpy (its calls cost less
per id the more blocks there are).

An id is coded as a choice and, if need be, the id itself:

* order 2 predicts the id that last followed the two ids before, order 1 the
  one that last followed the id before (hashed contexts). Each prediction has
  a confidence, the number of times it held in a row.
* the choice (order 2 right, order 1 right, order 0, an id new to order 0) is mixed
  from counts that the block keeps for each pair of confidences.
* order 0 codes the id by the counts of the block's ids so far (brought up to
  date after 64, 128, 256, ... ids); new ids are coded as equally likely.

The arithmetic is a range coder of 48 bits that emits 16-bit words; carries
are resolved when a block is finished. Its numbers stay below 2**53, so they
are kept as floats, whose quotients, rounded down, are exact here.
"""

from __future__ import annotations

import zlib

import numpy as np

BLOCK = 1024
ORDER1_BITS = 9
ORDER2_BITS = 9
STATES = 5            # no prediction, or 0 to 3 times right in a row
FIRST_COUNTS = 64     # ids after which order 0 counts for the first time
MOST = 4095           # ids in a block, so that counts fit their fields
STEP = 3              # weight of a choice that was made, against 1 for each at first
_TOP, _DOWN, _WORD = 2.0 ** 32, 2.0 ** -32, 2.0 ** 16
_CELLS = STATES * STATES * 2
_ONES, _FIELD = 0x0001000100010001, 0xFFFF  # four counts of 16 bits in one integer; times _ONES: their sums
_ORDER2, _ORDER1, _ORDER0, _NEW = range(4)
_FRESH = 1 << 30      # marks a new id among the encoder's intervals
_CHUNK = 16           # blocks whose ids are looked up at once
_MIX1, _MIX2 = np.uint32(2654435769), np.uint32(65599)


class _Model:
    """The predictions and choice counts of blocks that are coded side by side."""

    def __init__(self, lanes: int, vocabulary: int):
        lane = np.arange(lanes, dtype=np.uint32)
        self.base1, self.base2, self.base = lane << ORDER1_BITS, lane << ORDER2_BITS, lane * np.uint32(_CELLS)
        self.last1, self.last2 = np.zeros(lanes << ORDER1_BITS, np.uint32), np.zeros(lanes << ORDER2_BITS, np.uint32)  # id * 8 + state
        self.counts = np.full(lanes * _CELLS, _ONES, np.int64)
        self.mixed = np.full(lanes, vocabulary, np.uint32) * _MIX1
        self.before = self.mixed * _MIX2

    def keep(self, lanes: int) -> None:
        """Go on with the first lanes only."""
        self.base1, self.base2, self.base, self.mixed, self.before = (x[:lanes] for x in (self.base1, self.base2, self.base, self.mixed, self.before))

    def predict(self) -> None:
        self.at1 = (self.mixed >> (32 - ORDER1_BITS)) + self.base1
        self.at2 = (self.mixed + self.before >> (32 - ORDER2_BITS)) + self.base2
        self.guess1, self.guess2 = self.last1.take(self.at1), self.last2.take(self.at2)
        self.state1, self.state2 = self.guess1 & 7, self.guess2 & 7
        self.at = (self.state2 * STATES + self.state1) * 2 + ((self.guess1 ^ self.guess2) < 8) + self.base
        self.count = self.counts.take(self.at)
        self.sums = self.count * _ONES
        self.total = (self.sums >> 48).astype(np.float64)

    def interval(self, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, width) of the choices, given as 16 times their number."""
        width = self.count >> shift & _FIELD
        return ((self.sums >> shift & _FIELD) - width).astype(np.float64), width.astype(np.float64)

    def learn(self, ids: np.ndarray, marked: np.ndarray, right1: np.ndarray, right2: np.ndarray, shift: np.ndarray) -> None:
        """``marked`` are ids times 8."""
        self.counts[self.at] = self.count + (STEP << shift)
        fresh = marked + 1
        self.last1[self.at1] = fresh + np.minimum(self.state1, STATES - 2) * right1
        self.last2[self.at2] = fresh + np.minimum(self.state2, STATES - 2) * right2
        self.before = self.mixed * _MIX2
        self.mixed = ids * _MIX1


def _updates(steps: int) -> list[int]:
    out, t = [], FIRST_COUNTS
    while t < steps:
        out.append(t)
        t *= 2
    return out


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids of each lane (flat), where the runs of equal ones begin, and the runs' lengths.
    A run's place in its lane is the low end of its interval."""
    flat = np.sort(ids, axis=1, kind="stable").ravel()
    new = np.ones(len(flat), dtype=bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::ids.shape[1]] = True
    begin = np.flatnonzero(new)
    return flat, begin, np.diff(begin, append=len(flat))


def _intervals(grid: np.ndarray) -> np.ndarray:
    """By (step, lane): low << 12 | width in order 0, or for new ids their own place and ``_FRESH``."""
    lanes, steps = grid.shape
    due = _updates(steps)
    out = np.empty((steps, lanes), np.int32)
    seen = np.zeros(_CHUNK << 16, np.uint16)  # by (lane, id): where the id's run begins, if it has one
    for a in range(0, lanes, _CHUNK):
        part = grid[a:a + _CHUNK]
        lane = np.arange(len(part))[:, None]
        out[:FIRST_COUNTS, a:a + _CHUNK] = (part[:, :FIRST_COUNTS].astype(np.int32) << 12 | 1 | _FRESH).T
        for t, to in zip(due, [*due[1:], steps]):
            flat, begin, width = _order0(part[:, :t])
            seen[(begin // t << 16) + flat[begin]] = begin % t
            want = part[:, t:to]
            low = np.minimum(seen.take((lane << 16) + want), t - 1)
            at = low + lane * t
            widths = np.ones(len(flat), np.int32)
            widths[begin] = width
            out[t:to, a:a + _CHUNK] = np.where(flat.take(at) == want, low.astype(np.int32) << 12 | widths.take(at), want.astype(np.int32) << 12 | 1 | _FRESH).T
    return out


def _lanes(ids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids as (lane, step), and the length of each lane; only the last may be short."""
    n = -(-len(ids) // block)
    grid = np.zeros(n * block, np.uint16)
    grid[:len(ids)] = ids
    length = np.full(n, block)
    length[-1:] = len(ids) - (n - 1) * block
    return grid.reshape(n, block)[:, :length.max(initial=0)], length


def _finish(words: np.ndarray, place: np.ndarray, low: np.ndarray) -> list[bytes]:
    """The words of each lane, with its last three and all carries; ``words`` is flat, by (word, lane)."""
    lanes = len(low)
    for scale in (_DOWN, 1 / _WORD, 1.0):
        word = np.floor(low * scale)
        words[place] = word.astype(np.uint32)
        low = low - word / scale
        place = place + lanes
    size = place // lanes
    words = words.reshape(-1, lanes)[:size.max()]
    carry = np.zeros(lanes, np.uint32)
    for i in range(len(words) - 1, -1, -1):
        words[i] += carry
        carry = words[i] >> 16
    return [w[:n].tobytes() for w, n in zip(np.ascontiguousarray(words.astype("<u2").T), size.tolist())]


def encode(ids: np.ndarray, vocabulary: int, block: int = BLOCK) -> list[tuple[int, int, bytes]]:
    """(number of ids, checksum of them as little-endian 32-bit integers, words) of each block."""
    if block > MOST:
        raise ValueError(f"blocks have at most {MOST} ids")
    if not len(ids):
        return []
    grid, length = _lanes(ids, block)
    lanes, steps = grid.shape
    intervals, turned = _intervals(grid), np.ascontiguousarray(grid.T)
    model, totals = _Model(lanes, vocabulary), np.array([1.0, 1.0, 1.0, vocabulary])
    low, range_, place = np.zeros(lanes), np.full(lanes, 2.0 ** 48 - 1), np.arange(lanes)
    words = np.zeros((2 * steps + 8) * lanes, np.uint32)
    short = []
    for t in range(steps):
        if t == length[-1]:
            short = [(low[-1:], place[-1:])]
            low, range_, place = low[:-1], range_[:-1].copy(), place[:-1].copy()
            model.keep(lanes - 1)
        if t >= FIRST_COUNTS and t & (t - 1) == 0:
            totals[_ORDER0] = t
        k = len(low)
        id_ = turned[t, :k].astype(np.uint32)
        marked = id_ << 3
        model.predict()
        right1, right2 = (model.guess1 ^ marked) < 8, (model.guess2 ^ marked) < 8
        missed = ~(right1 | right2)
        own = np.where(missed, intervals[t, :k], 1)
        choice = (right1 > right2).view(np.uint8) + missed.view(np.uint8) * 2 + (own >= _FRESH)
        shift = choice.astype(np.int64) << 4
        a, b = model.interval(shift)
        part = np.floor(range_ / model.total)
        low = low + part * a
        part = np.floor(part * b / totals.take(choice))
        low += part * (own >> 12 & 0xFFFF).astype(np.float64)
        range_ = part * (own & 0xFFF).astype(np.float64)
        model.learn(id_, marked, right1, right2, shift)
        small = range_ < _TOP
        word = np.floor(low * _DOWN)
        words[place] = word.astype(np.uint32)
        up = small * (_WORD - 1) + 1
        low = (low - word * _TOP * small) * up
        range_ *= up
        place = place + small * np.int64(lanes)
        who = np.flatnonzero(range_ < _TOP)
        if len(who):
            word = np.floor(low[who] * _DOWN)
            words[place[who]] = word.astype(np.uint32)
            low[who] = (low[who] - word * _TOP) * _WORD
            range_[who] *= _WORD
            place[who] += lanes
    coded = _finish(words, *(np.concatenate(x) for x in zip((place, low), *((p, x) for x, p in short))))
    return [(int(m), zlib.crc32(grid[i, :m].astype("<u4").tobytes()), w) for i, (m, w) in enumerate(zip(length, coded))]


@np.errstate(all="ignore")  # a damaged block may lead anywhere before its checksum is seen
def decode(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> np.ndarray:
    """Ids of blocks that were encoded together or apart (longest first); raises on a wrong checksum."""
    if not blocks:
        return np.zeros(0, np.int64)
    length = np.array([b[0] for b in blocks])
    if (np.diff(length) > 0).any():
        raise ValueError("a block is longer than the one before")
    lanes, steps = len(blocks), int(length.max())
    longer = np.searchsorted(-length, -np.arange(steps), side="left").tolist()  # lanes longer than a step
    sizes = [len(b[2]) // 2 for b in blocks]
    words = np.zeros((lanes, max(*sizes, 3) + 1), np.uint16)  # a damaged block may read past its end
    for i, b in enumerate(blocks):
        words[i, :sizes[i]] = np.frombuffer(b[2], "<u2")
    place = np.arange(lanes) * words.shape[1]
    words = words.ravel()
    code = words.take(place) * _TOP + words.take(place + 1) * _WORD + words.take(place + 2)
    place += 3
    range_ = np.full(lanes, 2.0 ** 48 - 1)
    model, totals = _Model(lanes, vocabulary), np.array([1.0, 1.0, 1.0, vocabulary])
    grid = np.zeros((steps, lanes), np.uint16)
    order0, base0, last0 = np.zeros(lanes, np.int64), np.arange(lanes), 0
    for t in range(steps):
        if t >= FIRST_COUNTS and t & (t - 1) == 0:
            flat, begin, width = _order0(np.ascontiguousarray(grid[:t].T))
            order0 = np.repeat(flat[begin].astype(np.int64) << 32 | begin % t << 16 | width, width)  # by (lane, value)
            base0, totals[_ORDER0], last0 = np.arange(lanes) * t, t, t - 1
        k = longer[t]
        if k < len(code):
            code, range_, place = code[:k], range_[:k], place[:k]
            model.keep(k)
        model.predict()
        part = np.floor(range_ / model.total)
        value = (code / part).astype(np.int64)
        sums = model.sums
        choice = (value >= (sums & _FIELD)).view(np.uint8) + (value >= (sums >> 16 & _FIELD)) + (value >= (sums >> 32 & _FIELD))
        shift = choice.astype(np.int64) << 4
        a, b = model.interval(shift)
        code = code - part * a
        part = np.floor(part * b / totals.take(choice))
        value = (code / part).astype(np.int64)  # 0 after a prediction
        marked = np.where(choice == _ORDER2, model.guess2, model.guess1) & 0xFFFFFFF8
        range_ = part.copy()
        who = np.flatnonzero(choice == _NEW)
        marked[who] = value[who] << 3
        who = np.flatnonzero(choice == _ORDER0)
        if len(who):
            found = order0.take(base0[who] + np.clip(value[who], 0, last0))
            marked[who] = found >> 32 << 3
            value[who] = found >> 16 & _FIELD
            range_[who] *= found & _FIELD
        code -= part * value.astype(np.float64)
        id_ = marked >> 3
        grid[t, :k] = id_
        model.learn(id_, marked, (model.guess1 ^ marked) < 8, (model.guess2 ^ marked) < 8, shift)
        small = range_ < _TOP
        up = small * (_WORD - 1) + 1
        code = code * up + (words.take(place, mode="clip") * small).astype(np.float64)
        range_ *= up
        place = place + small
        who = np.flatnonzero(range_ < _TOP)
        if len(who):
            code[who] = code[who] * _WORD + words.take(place[who], mode="clip")
            range_[who] *= _WORD
            place[who] += 1
    grid = np.ascontiguousarray(grid.T)
    for i, (m, crc, _) in enumerate(blocks):
        if zlib.crc32(grid[i, :m].astype("<u4").tobytes()) != crc:
            raise ValueError(f"wrong checksum in block {i}")
    return grid.ravel() if length[-1] == steps else np.concatenate([grid[i, :m] for i, m in enumerate(length)])
