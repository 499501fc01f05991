"""An adaptive context-mixing range coder for blocks of token ids.

A block is one model and many lanes: its ids are cut into equal stretches, and numpy works on the
same place of all stretches at once. Three predictions are mixed linearly for each id: order 0,
the frequencies of ids so far in the block; order 1, the id last seen after the one before; order
2, the id last seen after the two before. How sure the last two have been lately and whether they
agree selects a row of counts of which order was right, and these counts are the mixing weights.
The distribution function of a mixture is the mixture of the distribution functions, so an id is
coded in one step, and decoding inverts the three parts one after another. After each step the
model learns the ids of all lanes; order-0 tables are made anew after 1, 2, 4, ... steps. The
coder is a carryless range coder with 64 bits of state a lane that puts out 32 bits at a time.
Nothing is carried from one block to the next. All arithmetic is on integers.

Ids of 24 bits at most; a block without ids is no bytes.
"""

from __future__ import annotations

import struct

import numpy as np

#: Ids in a lane.
STEPS = 256
#: Contexts of two ids are told apart by so many bits.
CONTEXT_BITS = 17
MOST_IDS = 1 << 24
HEAD = struct.Struct("<II")
THIRTY_TWO = np.uint64(32)
CELL = np.uint64(1 << 32)
LOW = np.uint64((1 << 32) - 1)


class _Model:
    """What a block's ids so far say about the next one. Shares are of `total`."""

    def __init__(self, alphabet: int):
        self.alphabet = alphabet
        self.bits = max(12, alphabet.bit_length() + 2)
        self.total = 1 << (self.bits + 6)
        # guess << 2 | how sure; tables are of 32 bits, so that they stay in a core's cache
        self.one = np.zeros(alphabet, np.int32)
        self.two = np.zeros(1 << CONTEXT_BITS, np.int32)
        self.seen = np.zeros(alphabet, np.int64)
        self.hits = np.tile(np.array([1, 1, 4], np.int64), (32, 1))
        self.weigh()
        self.tables()

    def weigh(self) -> None:
        # order 0 keeps a 64th, so that every id has room
        shares = self.hits * (self.total // 64 * 63) // self.hits.sum(axis=1, keepdims=True)
        self.second, self.first = shares[:, 0].copy(), shares[:, 1].copy()

    def tables(self) -> None:
        slots, n = 1 << self.bits, int(self.seen.sum())
        sizes = 1 + self.seen * (slots - self.alphabet) // max(n, 1)
        sizes[0] += slots - int(sizes.sum())
        self.upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        self.id_of = np.repeat(np.arange(self.alphabet, dtype=np.int32), sizes)

    def before(self, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """What order 0 gives to all ids below each x, of `rest`."""
        return self.upto.take(x, mode="clip").astype(np.int64) * rest >> self.bits

    def predict(self, one: np.ndarray, two: np.ndarray):
        """For the ids before and those before them: the guesses, their shares, what is left for order 0, and how to learn."""
        one, two = one.astype(np.int64), two.astype(np.int64)
        at = (one * 0x9E3779B1 + two * 0x85EBCA77 >> 13) & ((1 << CONTEXT_BITS) - 1)
        a, b = self.one.take(one, mode="clip"), self.two.take(at, mode="clip")
        g1, g2, sure1, sure2 = a >> 2, b >> 2, a & 3, b & 3
        row = (sure2 << 3) + (sure1 << 1) + (g1 == g2)
        p1, p2 = self.first.take(row, mode="clip"), self.second.take(row, mode="clip")
        return g1, g2, p1, p2, self.total - p1 - p2, (one, at, a, b, sure1, sure2, row)

    def interval(self, x: np.ndarray, g1: np.ndarray, g2: np.ndarray, p1: np.ndarray, p2: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of the share of each x."""
        low, high = self.before(x, rest), self.before(x + 1, rest)
        return low + p1 * (g1 < x) + p2 * (g2 < x), high - low + p1 * (g1 == x) + p2 * (g2 == x)

    def invert(self, v: np.ndarray, g1: np.ndarray, g2: np.ndarray, p1: np.ndarray, p2: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """The id whose share holds each v: the later guess's part is taken out, then the earlier one's, then order 0 is looked up."""
        swap = g1 > g2
        near, far = np.minimum(g1, g2), np.maximum(g1, g2)
        p = np.where(swap, p2, p1)
        q = p1 + p2 - p
        edge = self.before(far + 1, rest) + p
        v = np.where(v < edge, v, np.maximum(v - q, edge - 1))
        edge = self.before(near + 1, rest)
        v = np.where(v < edge, v, np.maximum(v - p, edge - 1))
        v = ((v + 1) << self.bits) - 1
        # below 2^53 a quotient of doubles never rounds up to the next whole number
        slot = (v / rest).astype(np.int64) if 2 * self.bits + 6 < 53 else v // rest
        return self.id_of.take(slot, mode="clip")

    def learn(self, x: np.ndarray, g1: np.ndarray, g2: np.ndarray, how) -> None:
        one, at, a, b, sure1, sure2, row = how
        hit1, hit2 = g1 == x, g2 == x
        right = np.where(hit2, 0, 2 - hit1)
        self.hits += np.bincount(row * 3 + right, minlength=96).reshape(32, 3)
        self.weigh()
        new = x << 2
        self.one[one] = np.where(hit1 | (sure1 > 1), a + np.where(hit1, sure1 < 3, np.int32(-2)), new)
        self.two[at] = np.where(hit2 | (sure2 > 1), b + np.where(hit2, sure2 < 3, np.int32(-2)), new)


class _Lanes:
    """A range coder for each lane. words: to decode, a row of words for each."""

    def __init__(self, lanes: int, total_bits: int, words: np.ndarray | None):
        self.shift = np.uint64(total_bits)
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        self.most = np.uint64((1 << total_bits) - 1)
        if words is None:
            self.words, self.at = np.zeros((lanes, STEPS + 1), np.uint32), np.zeros(lanes, np.int64)
            self.code = None
        else:
            self.words, self.at = words, np.full(lanes, 2)
            self.code = words[:, 0].astype(np.uint64) << THIRTY_TWO | words[:, 1]

    def value(self, n: int) -> np.ndarray:
        return np.minimum((self.code[:n] - self.low[:n]) // (self.range[:n] >> self.shift), self.most).view(np.int64)

    def narrow(self, start: np.ndarray, size: np.ndarray) -> None:
        n = len(start)
        step = self.range[:n] >> self.shift
        low, span = self.low[:n], self.range[:n]
        low += step * start.view(np.uint64)
        np.multiply(step, size.view(np.uint64), out=span)
        few = np.flatnonzero(span < CELL)
        if len(few):
            a, s = low[few], span[few]
            # a range over a boundary of the upper half gives up its smaller side, so that no carry comes later
            inside = CELL - (a & LOW)
            over = s > inside
            after = over & (s - inside > inside)
            s = np.where(after, s - inside, np.where(over, inside, s))
            a = np.where(after, a + inside, a)
            if self.code is None:
                self.words[few, self.at[few]] = (a >> THIRTY_TWO).astype(np.uint32)
            else:
                self.code[few] = self.code[few] << THIRTY_TWO | self.words[few, self.at[few]]
            self.at[few] += 1
            low[few], span[few] = a << THIRTY_TWO, s << THIRTY_TWO

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all lanes and how many each has; a last one says where in its range a lane ends."""
        lanes = np.arange(len(self.low))
        self.words[lanes, self.at] = ((self.low + LOW) >> THIRTY_TWO).astype(np.uint32)
        self.at += 1
        return self.words[np.arange(self.words.shape[1]) < self.at[:, None]], self.at


def _lanes(n: int) -> tuple[int, np.ndarray]:
    """How many lanes a block of n ids has, and how many of them each step reaches: only the last one may be shorter."""
    lanes = -(-n // STEPS)
    last = n - (lanes - 1) * STEPS
    return lanes, np.where(np.arange(STEPS) < last, lanes, lanes - 1)


def encode(ids: np.ndarray) -> bytes:
    """A block of ids as bytes."""
    if not len(ids):
        return b""
    most = int(ids.max())
    if most >= MOST_IDS:
        raise ValueError(f"an id of {MOST_IDS} or more is beyond this format")
    lanes, reached = _lanes(len(ids))
    grid = np.zeros(lanes * STEPS, np.int32)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, STEPS).T)
    model = _Model(most + 1)
    coder = _Lanes(lanes, model.bits + 6, None)
    nothing = np.zeros(lanes, np.int32)
    for t, n in enumerate(reached.tolist()):
        if not n:
            break
        x = grid[t, :n]
        g1, g2, p1, p2, rest, how = model.predict(grid[t - 1, :n] if t else nothing[:n], grid[t - 2, :n] if t > 1 else nothing[:n])
        coder.narrow(*model.interval(x, g1, g2, p1, p2, rest))
        model.learn(x, g1, g2, how)
        if t & (t + 1) == 0:  # after 1, 2, 4, ... steps
            model.seen = np.bincount(grid[: t + 1, :n].ravel(), minlength=model.alphabet)
            model.tables()
    words, counts = coder.finish()
    return HEAD.pack(len(ids), most + 1) + counts.astype("<u2").tobytes() + words.astype("<u4").tobytes()


def decode(data: bytes) -> np.ndarray:
    """The ids that encode() made into data."""
    if not data:
        return np.zeros(0, np.uint32)
    size, alphabet = HEAD.unpack_from(data)
    lanes, reached = _lanes(size)
    counts = np.frombuffer(data, "<u2", lanes, HEAD.size).astype(np.int64)
    flat = np.frombuffer(data, "<u4", int(counts.sum()), HEAD.size + 2 * lanes)
    words = np.zeros((lanes, STEPS + 4), np.uint32)
    if lanes and counts.max() > STEPS + 1:
        raise ValueError("not a block of this format")
    words[np.arange(words.shape[1]) < counts[:, None]] = flat
    grid = np.zeros((STEPS, lanes), np.int32)
    model = _Model(alphabet)
    coder = _Lanes(lanes, model.bits + 6, words)
    nothing = np.zeros(lanes, np.int32)
    for t, n in enumerate(reached.tolist()):
        if not n:
            break
        g1, g2, p1, p2, rest, how = model.predict(grid[t - 1, :n] if t else nothing[:n], grid[t - 2, :n] if t > 1 else nothing[:n])
        x = model.invert(coder.value(n), g1, g2, p1, p2, rest)
        coder.narrow(*model.interval(x, g1, g2, p1, p2, rest))
        model.learn(x, g1, g2, how)
        grid[t, :n] = x
        if t & (t + 1) == 0:
            model.seen = np.bincount(grid[: t + 1, :n].ravel(), minlength=alphabet)
            model.tables()
    return grid.T.ravel()[:size].astype(np.uint32)
