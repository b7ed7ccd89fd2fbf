"""A context-mixing range coder for token ids: blocks that are reset, checksummed and independent.

A block of n ids below 65536 is cut into lanes of consecutive ids; all lanes step together, as
numpy has its cost by the call, and share what the block has taught. Before each step there are three predictions of an id: order 0,
a distribution over all ids; order 1, the two ids that most often followed the id before; order 2,
the one that followed the two ids before. They are mixed by weights that belong to how much the
two contexts have seen, and the mix drives a range coder of each lane. After each step the
contexts learn the step's ids, and every few steps the weights move to the orders that foretold them; order 0
is renewed at steps 1, 2, 4, 8, 16 and each 32 more. Encoder and decoder do the same arithmetic, in
whole numbers and IEEE sums, products and quotients, alike on every machine.

Layout, little-endian: "QRC3", uint32 n, uint32 crc32 of the ids as uint32, uint16 lanes,
uint16 words of each lane, then the lanes' uint32 words one after the other.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"QRC3"
#: Ids of a block, about and at most.
BLOCK = 1 << 20
MOST = BLOCK + BLOCK // 4
IDS = 1 << 16
#: Steps of a block's lanes, if it is long.
STEPS = 256
#: Rows of the order-2 contexts; each tells by eight bits whose it is.
ROWS = 1 << 18
#: Order 0's total; a mix's total is 64 of it.
UNIT, PARTS = 20, 6
TOTAL = np.uint64(UNIT + PARTS)
U32 = np.uint64(32)
FULL = np.uint64(1) << U32
#: Order 0 before anything is seen: lower ids of a vocabulary built by merges are commoner.
PRIOR = (1 << 22) // (np.arange(IDS, dtype=np.int64) + 256)
SEEN = 12_000
#: Kinds of an order-1 row by its counts (nothing, or one of four sizes, led by one id or not) and, from bit 8 on, its first id's share of 4096.
_C0, _C1 = np.meshgrid(np.arange(256), np.arange(256))  # a row's counts are number c0 + 256 * c1
_SIZE = np.array([0] + [1] * 2 + [2] * 4 + [3] * 14 + [4])[np.minimum(_C0 + _C1, 21)]
_KIND = np.where(_SIZE == 0, 0, 2 * _SIZE - 1 + (_C0 * 4 >= (_C0 + _C1) * 3))
FIRST = (_KIND + (((_C0 << 12) // np.maximum(_C0 + _C1, 1)) << 8)).astype(np.int32).reshape(-1)
#: Kinds of rows of both orders; those of order 2 are nothing, or one of four counts.
KINDS_1 = 9
KINDS = KINDS_1 * 5


def geometry(n: int) -> tuple[int, int]:
    """Lanes and steps of a block of n ids."""
    lanes = max(n // STEPS, min(256, n // 64), 1)
    return lanes, -(-n // lanes)


class Model:
    """Predictions of a block's lanes.

    A mix lays the share of order 2's candidate first, then those of order 1's two, and order 0's behind
    them; a candidate of both orders has the sum of its shares at the former. A candidate is a number: its id and,
    from bit 16 on, its count; order 2's has its row's owner from bit 23 on.
    """

    def __init__(self):
        self.seen = PRIOR.copy()
        self.table = np.zeros((IDS, 2), np.int32)  # where an id begins, and how wide it is
        self.first, self.second = np.zeros((IDS, 2), np.int32), np.zeros(ROWS, np.int32)
        # how much of what was coded each order foretold, by the contexts' kinds
        self.weights = np.tile(np.array([[24], [16], [24]], np.int64) << 4, (1, KINDS))
        kind = np.arange(KINDS)
        self.seen_by = np.array([kind >= 0, kind % KINDS_1 > 0, kind >= KINDS_1])
        self.waiting: list[np.ndarray] = []
        self.renew()
        self.share()

    def renew(self) -> None:
        if self.waiting:
            self.seen += np.bincount(np.concatenate(self.waiting), minlength=IDS) * SEEN
            self.waiting.clear()
        cum = np.cumsum(self.seen)
        room = (1 << UNIT) - IDS
        ends = np.minimum((cum * (room / float(cum[-1]))).astype(np.int64), room) + np.arange(1, IDS + 1)
        self.table[1:, 0] = ends[:-1]
        self.table[:, 1] = ends - self.table[:, 0]
        self.places = None

    def share(self) -> None:
        """What each kind gives to the orders: of 64 parts to order 0 and, from bit 8 on, 4096ths of order 2's share."""
        self.live = w = self.weights * self.seen_by
        base = np.maximum((w[0] << PARTS) // w.sum(axis=0), 1)
        rest = ((1 << PARTS) - base) << UNIT
        near = rest * w[2] // np.maximum(w[1] + w[2], 1) >> 12
        self.shares = (base + (near << 8)).astype(np.int32)

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """`base`, the share of order 0, and the three candidates with where their shares end."""
        mixed = one.view(np.uint32) * np.uint32(0x9E3779B1) + two.view(np.uint32) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
        self.at, self.mark = (mixed & np.uint32(ROWS - 1)).astype(np.intp), mixed.view(np.int32) >> 24
        self.one = one.astype(np.intp)
        self.rows = _pairs(self.first, self.one)
        a, b = self.rows[:, 0], self.rows[:, 1]
        c = self.second.take(self.at)
        c *= c >> 23 == self.mark
        self.ids = a & 0xFFFF, b & 0xFFFF, c & 0xFFFF
        self.count = c >> 16 & 127
        led = FIRST.take((a >> 16) + (b >> 8 & 0xFF00))
        self.kind = ((led & 255) + KINDS_1 * (np.minimum(self.count, 3) + (self.count > 5))).astype(np.intp)
        self.led = led >> 8
        shares = self.shares.take(self.kind)
        self.base = shares & 255
        near = shares >> 8
        far = (((1 << PARTS) - self.base) << 8) - near
        near <<= 12
        x = far * self.led
        y = (far << 12) - x
        ends = near + x + y
        for i, w in ((0, x), (1, y)):
            gain = w * (self.ids[i] == self.ids[2])
            near += gain
            w -= gain
        self.wide = x, y, near
        self.ends = near + x, ends, near

    def place(self, x: np.ndarray, slots: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where ids begin in the mix and how wide they are there; `slots` tells whose candidates they are, if that is known."""
        self.same = tuple(i == x for i in self.ids)
        p, q, r = slots or tuple(s & (w > 0) for s, w in zip(self.same, self.wide))
        own = _pairs(self.table, x.astype(np.intp))
        self.own = own[:, 1]
        width, cum = self.own * self.base, own[:, 0] * self.base + self.ends[1]
        for told, w, before in ((p, self.wide[0], self.ends[2]), (q, self.wide[1], self.ends[0]), (r, self.wide[2], 0)):
            np.copyto(width, w, where=told)
            np.copyto(cum, before, where=told)
        return cum, width

    def find(self, want: np.ndarray) -> tuple[np.ndarray, tuple]:
        """The ids in whose places `want` lies, and whose candidates they are."""
        if self.places is None:
            self.places = np.repeat(np.arange(IDS, dtype=np.uint16), self.table[:, 1])
        r, p, q = want < self.ends[2], want < self.ends[0], want < self.ends[1]
        q &= ~p
        p &= ~r
        x = self.places.take((want - self.ends[1]) // self.base, mode="clip").astype(np.int32)
        for told, i in zip((p, q, r), self.ids):
            np.copyto(x, i, where=told)
        return x, (p, q, r)

    def learn(self, x: np.ndarray, live: int, step: int) -> None:
        """Learn a step's ids, placed before; lanes that have ended take no part in order 0 and the weights."""
        same_a, same_b, same_c = self.same
        if step % 4 == 0 or step < 16:
            led = self.led * 2.0**-12
            told = self.own * 2.0**-UNIT, led * same_a + (1 - led) * same_b, same_c
            parts = [w.take(self.kind) * t for w, t in zip(self.live, told)]
            part = 16 / np.maximum(parts[0] + parts[1] + parts[2], 1e-300)
            for w, p in zip(self.weights, parts):
                w += np.bincount(self.kind[:live], np.floor(p * part)[:live], KINDS).astype(np.int64)
            self.share()
        # order 2: a hit counts, a miss halves, and what is left without a count gives way
        count = np.where(same_c, np.minimum(self.count + 1, 127), self.count >> 1)
        c = self.ids[2]
        np.copyto(c, x, where=count == 0)
        c += np.maximum(count, 1) << 16
        c += self.mark << 23
        self.second[self.at] = c
        # order 1: a hit counts two, a miss takes one from the second, which gives way without a count
        a, b = self.rows[:, 0], self.rows[:, 1]
        same_a, same_b = same_a & (a > 0xFFFF), same_b & (b > 0xFFFF)
        a = a + same_a * np.int32(2 << 16)
        b = b + same_b * np.int32(2 << 16) - ~(same_a | same_b) * np.int32(1 << 16)
        np.copyto(b, x + np.int32(2 << 16), where=(b < 1 << 16) & ~same_a)
        full = a > 250 << 16
        if full.any():
            a, b = (np.where(full, (n >> 17 << 16) + (n & 0xFFFF), n) for n in (a, b))
        np.maximum(a, b, out=self.rows[:, 0])
        np.minimum(a, b, out=self.rows[:, 1])
        self.first.view(np.int64)[self.one, 0] = self.rows.view(np.int64)[:, 0]
        self.waiting.append(x[:live])
        done = step + 1
        if done % 32 == 0 or done in (1, 2, 4, 8, 16):
            self.renew()


def _pairs(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of a table of pairs, each read at once."""
    return table.view(np.int64)[:, 0].take(at)[:, None].view(np.int32)


def _grid(ids: np.ndarray, lanes: int, steps: int) -> np.ndarray:
    """ids as [step + 2, lane], after two steps of zeros."""
    full = np.zeros(lanes * steps, np.int32)
    full[: len(ids)] = ids
    x = np.zeros((steps + 2, lanes), np.int32)
    x[2:] = full.reshape(lanes, steps).T
    return x


class Coder:
    """The range coder's state, one range a lane."""

    def __init__(self, lanes: int):
        self.low, self.rng = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))

    def narrow(self, cum: np.ndarray, width: np.ndarray, live: int) -> np.ndarray:
        """Narrow the ranges of the first `live` lanes, which go on, to the places given; the lanes with a word settled."""
        low, rng = self.low[:live], self.rng[:live]
        rng >>= TOTAL
        low += cum[:live].astype(np.uint64) * rng
        rng *= width[:live].astype(np.uint64)
        return np.flatnonzero(rng < FULL)

    def shift(self, need: np.ndarray) -> None:
        """Drop a settled word; a range that crosses a word's end is cut there."""
        low, rng = self.low[need], self.rng[need]
        rng = np.where((low ^ (low + rng)) >> U32 != 0, (np.uint64(0) - low) & (FULL - np.uint64(1)), rng)
        self.low[need], self.rng[need] = low << U32, rng << U32


def _live(n: int, steps: int, step: int) -> int:
    """Lanes that have an id at a step: the first ones."""
    return max(0, -(-(n - step) // steps))


def encode(ids: np.ndarray) -> bytes:
    """A block of 1 to MOST ids. An id of 65536 or more raises ValueError."""
    n = len(ids)
    if n and (ids.max() >= IDS or ids.min() < 0):
        raise ValueError(f"ids must be from 0 to {IDS - 1}")
    lanes, steps = geometry(n)
    x = _grid(ids, lanes, steps)
    lane = np.arange(lanes)
    model, coder = Model(), Coder(lanes)
    words, used = np.zeros((lanes, steps + 4), np.uint32), np.zeros(lanes, np.int64)
    for s in range(steps):
        live = _live(n, steps, s)
        model.predict(x[s + 1], x[s])
        need = coder.narrow(*model.place(x[s + 2]), live)
        if len(need):
            words[need, used[need]] = coder.low[need] >> U32
            used[need] += 1
            coder.shift(need)
        model.learn(x[s + 2], live, s)
    words[lane, used] = (coder.low + (FULL - np.uint64(1))) >> U32
    used += 1
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    head = MAGIC + struct.pack("<IIH", n, crc, lanes) + used.astype("<u2").tobytes()
    return head + words[np.arange(words.shape[1])[None, :] < used[:, None]].astype("<u4").tobytes()


def parse(data: bytes) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(n, crc, words of each lane, words) of the blocks in `data`."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != MAGIC:
            raise ValueError(f"no block at byte {at}")
        n, crc, lanes = struct.unpack_from("<IIH", data, at + 4)
        if not 0 < n <= MOST or lanes != geometry(n)[0]:
            raise ValueError(f"a block of {n} ids in {lanes} lanes at byte {at}")
        used = np.frombuffer(data, "<u2", lanes, at + 14).astype(np.int64)
        at += 14 + 2 * lanes
        words = np.frombuffer(data, "<u4", int(used.sum()), at)
        at += 4 * len(words)
        out.append((n, crc, used, words))
    return out


def decode(n: int, crc: int, used: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """The ids of a parsed block; ValueError where the checksum fails."""
    lanes, steps = geometry(n)
    words = np.zeros((lanes, int(used.max()) + 2), np.uint64)
    words[np.arange(words.shape[1])[None, :] < used[:, None]] = coded
    lane = np.arange(lanes)
    model, coder = Model(), Coder(lanes)
    code, at = words[:, 0] << U32 | words[:, 1], np.full(lanes, 2)
    last = words.shape[1] - 1
    x = np.zeros((steps + 2, lanes), np.int32)
    top = np.uint64((1 << UNIT + PARTS) - 1)
    for s in range(steps):
        live = _live(n, steps, s)
        model.predict(x[s + 1], x[s])
        got, slots = model.find(np.minimum((code - coder.low) // (coder.rng >> TOTAL), top).astype(np.int32))
        got[live:] = 0
        x[s + 2] = got
        need = coder.narrow(*model.place(got, slots), live)
        if len(need):
            code[need] = code[need] << U32 | words[need, np.minimum(at[need], last)]
            at[need] += 1
            coder.shift(need)
        model.learn(got, live, s)
    ids = x[2:].T.astype(np.uint16).reshape(-1)[:n]
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
        raise ValueError("a block's checksum differs")
    return ids


def pack(ids: np.ndarray) -> bytes:
    """Any number of ids as blocks of about one length."""
    blocks = -(-len(ids) // MOST)
    return b"".join(encode(part) for part in np.array_split(ids, max(1, blocks)) if len(part))


def unpack(data: bytes) -> np.ndarray:
    """The ids of `pack`; raises ValueError where a block's checksum fails."""
    return np.concatenate([np.zeros(0, np.uint16), *(decode(*block) for block in parse(data))])
