"""Adaptive context-mixing range coder for token ids.

A block holds up to BLOCK ids and is coded on its own: its model starts anew,
and its header has a checksum. For each id, the model has the id that last
followed the two ids before (order 2), the id that last followed the one before
(order 1), and a table of ids met so far (order 0). Which of them is right, or
none, is coded with a probability mixed from three sets of adaptive counts;
the weights of the mixture follow how well each set predicts. What the flag
leaves open, a place in the order-0 table or the id itself, is coded evenly.

Blocks are coded side by side: each step codes one id of every block."""

import struct
import zlib

import numpy as np

BLOCK = 2048
MAGIC = b"CMR1"
_HEAD = struct.Struct("<4sIIII")  # magic, ids, crc32 of the ids, words, wide (ids of more than 16 bits)
_BITS1, _BITS2 = 10, 11
_ONE = np.uint64(1)
_S16, _S32, _S48 = np.uint64(16), np.uint64(32), np.uint64(48)
_LOW48 = np.uint64((1 << 48) - 1)
_LEAST = np.uint64(1 << 32)


class _Model:
    """Predictions of many blocks; the coder and the decoder drive it alike."""

    def __init__(self, lanes: int):
        self.t2 = np.zeros((lanes << _BITS2), np.uint32)
        self.t1 = np.zeros((lanes << _BITS1), np.uint32)
        self.t0 = np.zeros((lanes << 8), np.uint32)
        self.c2, self.c1 = np.zeros(len(self.t2), np.uint8), np.zeros(len(self.t1), np.uint8)
        self.f2, self.f1 = np.ones((lanes * 8, 4)), np.ones((lanes * 8, 4))
        self.f0 = np.ones((lanes * 4, 4))
        self.weights = np.full((lanes, 3), 1 / 3)
        self.before, self.last = np.zeros(lanes, np.uint32), np.zeros(lanes, np.uint32)
        self.flag = np.full(lanes, 3, np.int64)
        self.lane = np.arange(lanes)

    def predict(self, n: int):
        """Bounds of the four flags, in 1/65536, for the first n blocks."""
        lane, last = self.lane[:n], self.last[:n]
        self.k2 = (lane << _BITS2) + (((self.before[:n] * np.uint32(0x9E3779B1)) ^ (last * np.uint32(0x85EBCA6B)))
                                      >> np.uint32(32 - _BITS2)).astype(np.int64)
        self.k1 = (lane << _BITS1) + ((last * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS1)).astype(np.int64)
        self.p2, self.p1 = self.t2[self.k2], self.t1[self.k1]
        self.rows = ((lane << 3) + self.c2[self.k2], (lane << 3) + self.c1[self.k1], (lane << 2) + self.flag[:n])
        self.parts = []
        mixed = 0
        for i, (table, row) in enumerate(zip((self.f2, self.f1, self.f0), self.rows)):
            f = table[row]
            f /= (f[:, 0] + f[:, 1] + f[:, 2] + f[:, 3])[:, None]
            self.parts.append(f)
            mixed = mixed + f * self.weights[:n, i, None]
        self.mixed = mixed
        # Every flag keeps a share of at least 16/65536.
        q = (mixed * 65472.0).astype(np.int64) + 16
        bounds = np.empty((n, 5), np.int64)
        bounds[:, 0], bounds[:, 4] = 0, 65536
        bounds[:, 1] = q[:, 0]
        bounds[:, 2] = bounds[:, 1] + q[:, 1]
        bounds[:, 3] = bounds[:, 2] + q[:, 2]
        return bounds

    def slot(self, x):
        return (x * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.int64)

    def update(self, x, flag):
        n = len(x)
        lane, y = self.lane[:n], x + np.uint32(1)
        at = self.mixed[lane, flag]
        w = self.weights[:n]
        for i, (table, row, part) in enumerate(zip((self.f2, self.f1, self.f0), self.rows, self.parts)):
            w[:, i] = 0.98 * w[:, i] * part[lane, flag] / at + 0.02 / 3
            table[row, flag] += 1
        w /= (w[:, 0] + w[:, 1] + w[:, 2])[:, None]
        for table, sure, k, p in ((self.t2, self.c2, self.k2, self.p2), (self.t1, self.c1, self.k1, self.p1)):
            right = p == y
            c = sure[k]
            # A prediction that failed loses its standing before it is replaced.
            sure[k] = np.where(right, np.minimum(c + 1, 7), c >> 1)
            table[k] = np.where(right | (c < 2), y, p)
        self.t0[(lane << 8) + self.slot(x)] = y
        self.before[:n], self.last[:n], self.flag[:n] = self.last[:n], x, flag


class _Writer:
    def __init__(self, lanes: int, words: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 1 << 48, np.uint64)
        self.words, self.out, self.at = words, np.zeros(lanes * words, np.uint16), np.arange(lanes) * words

    def put(self, start, size):
        n = len(start)
        low, rng = self.low[:n], self.range[:n]
        part = rng >> _S16
        low += part * start.astype(np.uint64)
        rng[:] = part * size.astype(np.uint64)
        over = np.flatnonzero(low >> _S48)
        if len(over):
            low[over] &= _LOW48
            at = self.at[over] - 1
            self.out[at] += np.uint16(1)
            while len(at := at[self.out[at] == 0]):  # the carry runs on through full words
                at = at - 1
                self.out[at] += np.uint16(1)
        short = np.flatnonzero(rng < _LEAST)
        if len(short):
            self._word(short)
            rng[short] <<= _S16

    def _word(self, lanes):
        self.out[self.at[lanes]] = (self.low[lanes] >> _S32).astype(np.uint16)
        self.at[lanes] += 1
        self.low[lanes] = (self.low[lanes] << _S16) & _LOW48

    def close(self):
        for _ in range(3):
            self._word(np.arange(len(self.low)))
        lanes = np.arange(len(self.low)) * self.words
        return [self.out[a:b].astype("<u2").tobytes() for a, b in zip(lanes, self.at)]


class _Reader:
    def __init__(self, streams):
        size = max(len(s) for s in streams) // 2 + 4
        self.data = np.zeros((len(streams), size), np.uint64)
        for i, s in enumerate(streams):
            self.data[i, :len(s) // 2] = np.frombuffer(s, "<u2")
        self.data = self.data.ravel()
        self.at = np.arange(len(streams)) * size
        self.code, self.range = np.zeros(len(streams), np.uint64), np.full(len(streams), 1 << 48, np.uint64)
        for _ in range(3):
            self.code = (self.code << _S16) | self.data[self.at]
            self.at += 1

    def peek(self, n):
        self.part = self.range[:n] >> _S16
        return np.minimum(self.code[:n] // self.part, np.uint64(65535)).astype(np.int64)

    def take(self, start, size):
        n = len(start)
        code, rng = self.code[:n], self.range[:n]
        code -= self.part * start.astype(np.uint64)
        rng[:] = self.part * size.astype(np.uint64)
        short = np.flatnonzero(rng < _LEAST)
        if len(short):
            code[short] = (code[short] << _S16) | self.data[self.at[short]]
            self.at[short] += 1
            rng[short] <<= _S16


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of ids (unsigned, up to 32 bits; ids must be below 2**32 - 1)."""
    ids = np.asarray(ids, np.uint32)
    if not len(ids):
        return []
    wide = int(ids.max()) > 65535
    lanes = -(-len(ids) // BLOCK)
    grid = np.zeros(lanes * BLOCK, np.uint32)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    rest = len(ids) - (lanes - 1) * BLOCK  # only the last block is shorter
    model, out = _Model(lanes), _Writer(lanes, 3 * BLOCK + 8)
    for t in range(min(BLOCK, len(ids))):
        n = lanes if t < rest else lanes - 1
        x = grid[t, :n]
        y = x + np.uint32(1)
        bounds = model.predict(n)
        slot = model.slot(x)
        known = model.t0[(model.lane[:n] << 8) + slot] == y
        flag = np.where(model.p2 == y, 0, np.where(model.p1 == y, 1, np.where(known, 2, 3)))
        lane = model.lane[:n]
        start = bounds[lane, flag]
        out.put(start, bounds[lane, flag + 1] - start)
        raw = flag == 3
        if wide:
            out.put(np.where(raw, x >> np.uint32(16), 0).astype(np.int64), np.where(raw, 1, 65536))
        out.put(np.where(raw, (x & np.uint32(65535)).astype(np.int64), np.where(flag == 2, slot << 8, 0)),
                np.where(raw, 1, np.where(flag == 2, 256, 65536)))
        model.update(x, flag)
    blocks = []
    for i, s in enumerate(out.close()):
        part = ids[i * BLOCK:(i + 1) * BLOCK]
        blocks.append(_HEAD.pack(MAGIC, len(part), zlib.crc32(part.astype("<u4").tobytes()), len(s) // 2, wide) + s)
    return blocks


def split(data: bytes) -> list[bytes]:
    """The blocks of blocks written one after another."""
    out, at = [], 0
    while at < len(data):
        magic, _, _, words, _ = _HEAD.unpack_from(data, at)
        if magic != MAGIC:
            raise ValueError("not a block of ids")
        out.append(data[at:at + _HEAD.size + 2 * words])
        at += _HEAD.size + 2 * words
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; any selection of blocks in any order. A block that was damaged raises."""
    if not blocks:
        return []
    heads = [_HEAD.unpack_from(b) for b in blocks]
    if any(h[0] != MAGIC or len(b) != _HEAD.size + 2 * h[3] for h, b in zip(heads, blocks)):
        raise ValueError("not a block of ids")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    sizes = np.array([heads[i][1] for i in order])
    wide = np.array([heads[i][4] for i in order], bool)
    src = _Reader([blocks[i][_HEAD.size:] for i in order])
    model = _Model(len(order))
    grid = np.zeros((sizes[0], len(order)), np.uint32)
    for t in range(sizes[0]):
        n = int(np.searchsorted(-sizes, -t, "left"))
        bounds = model.predict(n)
        v = src.peek(n)
        flag = (v >= bounds[:, 1]).astype(np.int64) + (v >= bounds[:, 2]) + (v >= bounds[:, 3])
        lane = model.lane[:n]
        start = bounds[lane, flag]
        src.take(start, bounds[lane, flag + 1] - start)
        raw = flag == 3
        high = np.zeros(n, np.int64)
        if wide.any():
            # Blocks of 16-bit ids have no such step: theirs is taken back.
            keep = (src.code[:n].copy(), src.range[:n].copy(), src.at[:n].copy())
            v = src.peek(n)
            high = np.where(raw, v, 0)
            src.take(high, np.where(raw, 1, 65536))
            for now, old in zip((src.code, src.range, src.at), keep):
                now[:n] = np.where(wide[:n], now[:n], old)
            high = np.where(wide[:n], high, 0)
        v = src.peek(n)
        place = v >> 8
        src.take(np.where(raw, v, np.where(flag == 2, place << 8, 0)),
                 np.where(raw, 1, np.where(flag == 2, 256, 65536)))
        met = model.t0[(lane << 8) + place]
        x = np.where(flag == 0, model.p2, np.where(flag == 1, model.p1, met)) - np.uint32(1)
        x = np.where(raw, ((high << 16) + v).astype(np.uint32), x)
        model.update(x, flag)
        grid[t, :n] = x
    out: list = [None] * len(blocks)
    for j, i in enumerate(order):
        ids = np.ascontiguousarray(grid[:sizes[j], j])
        if zlib.crc32(ids.astype("<u4").tobytes()) != heads[i][2]:
            raise ValueError("checksum of a block of ids does not match")
        out[i] = ids
    return out
