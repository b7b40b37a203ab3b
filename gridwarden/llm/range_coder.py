"""Adaptive context-mixing range coder for token ids, many blocks side by side.

Every block has a model and a coder of its own and starts from the same state, so blocks are
independent; numpy steps through all blocks of a call at once, one id of each at a time.

Orders 1 and 2 predict the next id from the last one and the last two ids (the id last seen
there, with a confidence). Order 0 is the hit rate of the block and an adaptive distribution
over the upper halves of ids. Hit probabilities of the orders are mixed in the logistic domain
with weights learnt in the block, and the range coder then codes one of: the id of order 2, the
id of order 1, or an id spelled out under order 0. All arithmetic is on integers, so decoding
does not depend on the machine.
"""

from __future__ import annotations

import math

import numpy as np

SLOTS = 4096  # contexts an order keeps in a block
LEVELS = 8  # confidences
HIGH = 256  # upper halves of 16-bit ids
REFRESH = 64  # ids between updates of the order 0 table
# Coders hold 64 bits. Up to three symbols of 16, 16 and 8 bits follow one renormalisation.
TOP, BOTTOM = np.uint64(1 << 56), np.uint64(1 << 48)
BYTE, HALF = np.uint64(8), np.uint64(16)

_STRETCH = np.array(
    [round(256 * math.log((i + 0.5) / (4095.5 - i))) for i in range(4096)], dtype=np.int64
).clip(-2047, 2047).astype(np.int32)
_SQUASH = np.array(
    [min(4095, max(1, round(4096 / (1 + math.exp(-i / 256))))) for i in range(-2048, 2048)],
    dtype=np.int32,
)


class Model:
    """The state of all blocks: what the next id may be, and learning from what it was."""

    def __init__(self, blocks: int):
        self.rows = np.arange(blocks)
        self.base, self.levels = self.rows * SLOTS, self.rows * LEVELS
        self.guess = [np.zeros(blocks * SLOTS, np.uint16) for _ in range(2)]
        self.sure = [np.zeros(blocks * SLOTS, np.uint8) for _ in range(2)]
        start = np.array([(i + 1) * 65536 // (LEVELS + 2) for i in range(LEVELS)], dtype=np.int32)
        self.rate = [np.tile(start, blocks) for _ in range(2)]  # of hits, by confidence
        self.any_rate = np.full(blocks, 20_000, np.int32)
        self.weights = [np.full(blocks, w, np.int32) for w in (40_000, 16_000, 8_000)]
        self.fallback = [np.full(blocks, w, np.int32) for w in (50_000, 8_000)]
        self.last = np.zeros(blocks, np.int64)
        self.before = np.zeros(blocks, np.int64)
        self.counts = np.ones(blocks * HIGH, np.int32)
        self.table = np.zeros((blocks, HIGH + 1), np.uint32)
        self.step = 0

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequencies out of 65536 of order 2 and order 1 (the rest is spelled out)."""
        if self.step % REFRESH == 0:
            counts = self.counts.reshape(-1, HIGH).astype(np.int64)
            share = 1 + counts * (65536 - HIGH) // counts.sum(axis=1, keepdims=True)
            np.cumsum(share, axis=1, out=self.table[:, 1:])
            self.table[:, HIGH] = 65536
        slot1 = (self.last * 40503 >> 3) & (SLOTS - 1)
        slot2 = ((self.before * 30011 + self.last * 48271) >> 4) & (SLOTS - 1)
        self.at = (slot1 + self.base, slot2 + self.base)
        self.got = [self.guess[k].take(self.at[k]) for k in range(2)]
        self.conf = [self.sure[k].take(self.at[k]) for k in range(2)]
        self.cell = [self.levels + self.conf[k] for k in range(2)]
        self.hit_rate = [self.rate[k].take(self.cell[k]) for k in range(2)]
        self.same = self.got[0] == self.got[1]
        s1, s2 = (_STRETCH.take(self.hit_rate[k] >> 4) for k in range(2))
        s0 = _STRETCH.take(self.any_rate >> 4)
        self.inputs = (s2, np.where(self.same, s1, -s1), s0)
        self.back_inputs = (s1, s0)
        self.p = self._mix(self.weights, self.inputs)
        self.q = self._mix(self.fallback, self.back_inputs)
        two = self.p << 4
        rest = 65536 - two
        one = np.minimum(np.maximum((rest >> 4) * self.q >> 8, 1), rest - 1)
        one[self.same] = 0
        return two, one

    @staticmethod
    def _mix(weights: list[np.ndarray], inputs: tuple[np.ndarray, ...]) -> np.ndarray:
        total = weights[0] * inputs[0]
        for w, x in zip(weights[1:], inputs[1:]):
            total += w * x
        total >>= 16
        total += 2048
        return _SQUASH.take(total, mode="clip")

    def learn(self, ids: np.ndarray, hit2: np.ndarray, spelled: np.ndarray, high: np.ndarray) -> None:
        hit1 = ids == self.got[0]
        flag2, flag1 = hit2.astype(np.int32), hit1.astype(np.int32)
        error = ((flag2 << 12) - self.p) * 6
        for w, x in zip(self.weights, self.inputs):
            w += (x * error) >> 10
        error = ((flag1 << 12) - self.q) * 6
        error[hit2 | self.same] = 0
        for w, x in zip(self.fallback, self.back_inputs):
            w += (x * error) >> 10
        self.any_rate += (flag2 * 65535 - self.any_rate) >> 5
        for k, hit, flag in ((0, hit1, flag1), (1, hit2, flag2)):
            conf, at = self.conf[k], self.at[k]
            self.rate[k][self.cell[k]] = self.hit_rate[k] + ((flag * 65535 - self.hit_rate[k]) >> 5)
            self.guess[k][at] = np.where(hit | (conf > 1), self.got[k], ids)
            self.sure[k][at] = np.where(hit, np.minimum(conf + 1, LEVELS - 1), conf >> 1)
        self.counts[spelled * HIGH + high] += 24
        self.before, self.last = self.last, ids.astype(np.int64)
        self.step += 1


def _ready(low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which coders put out their upper byte: it is settled, or the width got too narrow."""
    settled = (low ^ (low + width)) < TOP
    return settled, settled | (width < BOTTOM)


def _next_byte(low: np.ndarray, width: np.ndarray, settled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.where(settled, width, (~low + np.uint64(1)) & (BOTTOM - np.uint64(1)))
    return low << BYTE, cut << BYTE


class Encoder:
    def __init__(self, blocks: int, steps: int):
        self.low = np.zeros(blocks, np.uint64)
        self.width = np.full(blocks, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.out = np.zeros((blocks, 4 * steps + 64), np.uint8)
        self.size = np.zeros(blocks, np.int64)

    def settle(self) -> None:
        _, ready = _ready(self.low, self.width)
        rows = np.flatnonzero(ready)
        low, width = self.low[rows], self.width[rows]
        while len(rows):
            settled, ready = _ready(low, width)
            if not ready.all():
                self.low[rows], self.width[rows] = low, width
                rows, low, width, settled = rows[ready], low[ready], width[ready], settled[ready]
            self.out[rows, self.size[rows]] = low >> np.uint64(56)
            self.size[rows] += 1
            low, width = _next_byte(low, width, settled)

    def finish(self) -> list[bytes]:
        rows = np.arange(len(self.low))
        for _ in range(8):
            self.out[rows, self.size] = self.low >> np.uint64(56)
            self.low <<= BYTE
            self.size += 1
        return [self.out[i, :n].tobytes().rstrip(b"\0") for i, n in enumerate(self.size)]


class Decoder:
    def __init__(self, payloads: list[bytes]):
        longest = max(map(len, payloads), default=0) + 16
        joined = b"".join(p.ljust(longest, b"\0") for p in payloads)
        self.data = np.frombuffer(joined, np.uint8).reshape(len(payloads), longest)
        self.low = np.zeros(len(payloads), np.uint64)
        self.width = np.full(len(payloads), 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.code = np.zeros(len(payloads), np.uint64)
        for k in range(8):
            self.code = self.code << BYTE | self.data[:, k]
        self.at = np.full(len(payloads), 8, np.int64)

    def settle(self) -> None:
        _, ready = _ready(self.low, self.width)
        rows = np.flatnonzero(ready)
        low, width, code = self.low[rows], self.width[rows], self.code[rows]
        last = self.data.shape[1] - 1
        while len(rows):
            settled, ready = _ready(low, width)
            if not ready.all():
                self.low[rows], self.width[rows], self.code[rows] = low, width, code
                rows, low, width, settled = rows[ready], low[ready], width[ready], settled[ready]
                code = code[ready]
            at = self.at[rows]
            code = code << BYTE | self.data[rows, np.minimum(at, last)]
            self.at[rows] = at + 1
            low, width = _next_byte(low, width, settled)


def encode(ids: np.ndarray) -> list[bytes]:
    """Payloads of the rows of a matrix of ids (blocks x steps, 0..65535)."""
    blocks, steps = ids.shape
    model, coder = Model(blocks), Encoder(blocks, steps)
    for now in np.ascontiguousarray(ids.T.astype(np.uint16)):
        two, one = model.predict()
        hit2 = now == model.got[1]
        hit1 = ~hit2 & (now == model.got[0])
        both = two + one
        unit = coder.width >> HALF
        coder.low += unit * np.where(hit2, 0, np.where(hit1, two, both)).astype(np.uint64)
        coder.width = unit * np.where(hit2, two, np.where(hit1, one, 65536 - both)).astype(np.uint64)
        spelled = np.flatnonzero(~(hit2 | hit1))
        letters = now[spelled]
        high = (letters >> 8).astype(np.int64)
        start, stop = model.table[spelled, high], model.table[spelled, high + 1]
        unit = coder.width[spelled] >> HALF
        inner = unit * (stop - start) >> BYTE
        coder.low[spelled] += unit * start + inner * (letters & 255)
        coder.width[spelled] = inner
        coder.settle()
        model.learn(now, hit2, spelled, high)
    return coder.finish()


def decode(payloads: list[bytes], steps: int) -> np.ndarray:
    """The matrix of ids (blocks x steps) of payloads that were encoded together or apart."""
    blocks = len(payloads)
    model, coder = Model(blocks), Decoder(payloads)
    out = np.empty((steps, blocks), np.uint16)
    flat = model.table.reshape(-1)
    for step in range(steps):
        two, one = model.predict()
        both = two + one
        unit = coder.width >> HALF
        value = ((coder.code - coder.low) // unit).astype(np.int64)
        hit2 = value < two
        hit1 = ~hit2 & (value < both)
        coder.low += unit * np.where(hit2, 0, np.where(hit1, two, both)).astype(np.uint64)
        coder.width = unit * np.where(hit2, two, np.where(hit1, one, 65536 - both)).astype(np.uint64)
        now = np.where(hit2, model.got[1], model.got[0])
        spelled = np.flatnonzero(~(hit2 | hit1))
        left = coder.code[spelled] - coder.low[spelled]
        unit = coder.width[spelled] >> HALF
        value = np.minimum(left // unit, np.uint64(65535)).astype(np.uint32)
        base = spelled * (HIGH + 1)
        high = np.zeros(len(spelled), np.int64)
        for bit in (128, 64, 32, 16, 8, 4, 2, 1):
            high += bit * (flat.take(base + (high + bit)) <= value)
        start, stop = flat.take(base + high), flat.take(base + high + 1)
        inner = unit * (stop - start) >> BYTE
        low = np.minimum((left - unit * start) // inner, np.uint64(255))
        coder.low[spelled] += unit * start + inner * low
        coder.width[spelled] = inner
        now[spelled] = high << 8 | low.astype(np.int64)
        coder.settle()
        out[step] = now
        model.learn(now, hit2, spelled, high)
    return np.ascontiguousarray(out.T)
