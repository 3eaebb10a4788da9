"""Elias-Fano sequences in flat 64-bit words, searched many values at a time."""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_PACK = 1 << 16


def _pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bits of each value, side by side."""
    parts = []
    for at in range(0, len(values), _PACK):  # a multiple of 8 values ends on a byte
        part = np.ascontiguousarray(values[at : at + _PACK], "<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
        parts.append(np.packbits(bits.reshape(-1), bitorder="little"))
    data = np.concatenate([*parts, np.zeros(16, np.uint8)]) if width else np.zeros(16, np.uint8)
    return np.pad(data, (0, -len(data) % 8)).view("<u8")


def encode(values: np.ndarray) -> np.ndarray:
    """Words of a non-decreasing sequence of unsigned integers."""
    values = values.astype(np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(1, n)).bit_length() - 1)
    low = _pack_low(values & np.uint64((1 << width) - 1), width)
    size = n + (top >> width) + 2
    set_at = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[set_at] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.uint64)]).astype("<u8")
    return np.concatenate([np.array([n, width, len(low), len(high)], "<u8"), low, high, ones])


_ODD, _PAIRS, _NIBBLES, _BYTES, _TOPS = (
    np.uint64(int(byte * 8, 16)) for byte in ("55", "33", "0f", "01", "80")
)
# Place of the nth set bit of a byte.
_IN_BYTE = np.array(
    [[([k for k in range(8) if byte >> k & 1] + [0] * 8)[n] for n in range(8)] for byte in range(256)], np.uint8
)


def _nth_set(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth set bit (from 0) of each word: its byte from running counts, then a table."""
    nth = nth.astype(np.uint64)
    counts = words - ((words >> _ONE) & _ODD)
    counts = (counts & _PAIRS) + ((counts >> np.uint64(2)) & _PAIRS)
    running = ((counts + (counts >> np.uint64(4))) & _NIBBLES) * _BYTES
    shift = np.bitwise_count(((nth * _BYTES) | _TOPS) - running & _TOPS).astype(np.uint64) * np.uint64(8)
    before = ((running << np.uint64(8)) >> shift) & np.uint64(255)
    byte = (words >> shift) & np.uint64(255)
    return shift.astype(np.int64) + _IN_BYTE[byte, nth - before]


class EliasFano:
    """Reads ``encode``'s words in place, for instance from a memory map."""

    def __init__(self, words: np.ndarray):
        self.n, self.width, n_low, n_high = (int(w) for w in words[:4])
        words = np.asarray(words)  # a plain view of a mapped file
        self.low = words[4 : 4 + n_low]
        self.bytes = np.ndarray(max(0, 8 * n_low - 7), "<u8", self.low, strides=(1,)) if n_low else self.low
        self.high = words[4 + n_low : 4 + n_low + n_high]
        self.ones = words[4 + n_low + n_high :]
        self.zeros = np.arange(len(self.ones), dtype=np.uint64) * np.uint64(64) - self.ones
        self.buckets = int(self.zeros[-1])

    def _low(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.uint64)
        if self.width <= 57:  # the bits lie in the eight bytes from their first one
            bit = at * self.width
            return (self.bytes[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.width) - 1)
        bit = at.astype(np.uint64) * np.uint64(self.width)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        # two shifts, as one by 64 is undefined
        upper = (self.low[word + 1] << (np.uint64(63) - shift)) << _ONE
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.width) - 1)

    def _select(self, before: np.ndarray, flip: bool, nth: np.ndarray) -> np.ndarray:
        word = np.searchsorted(before, nth.astype(np.uint64), "right") - 1
        bits = self.high[word]
        return word * 64 + _nth_set(~bits if flip else bits, nth.astype(np.uint64) - before[word])

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at the given positions."""
        at = np.asarray(at, np.int64)
        high = (self._select(self.ones, False, at) - at).astype(np.uint64)
        return (high << np.uint64(self.width)) | self._low(at)

    def successor(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of the first value >= x (n if none), and whether it equals x."""
        x = np.asarray(x, np.uint64)
        bucket = x >> np.uint64(self.width)
        inside = bucket < np.uint64(self.buckets)
        where = np.where(inside, bucket, np.uint64(0)).astype(np.int64)
        # the bucket's ones follow the zero that ends the bucket before it
        begin = self._select(self.zeros, True, np.maximum(where - 1, 0)) + 1
        begin[where == 0] = 0
        start = begin - where
        word, shift = begin >> 6, (begin & 63).astype(np.uint64)
        after = self.high[np.minimum(word + 1, len(self.high) - 1)]
        run = (self.high[word] >> shift) | ((after << (np.uint64(63) - shift)) << _ONE)
        held = np.bitwise_count(run & ~(run + _ONE)).astype(np.int64)  # ones below the next zero
        end = start + held
        long = np.flatnonzero((run == ~np.uint64(0)) | (word + 1 >= len(self.high)))
        if len(long):
            end[long] = self._select(self.zeros, True, where[long]) - where[long]
        found = np.where(inside, start, self.n)
        equal = np.zeros(len(x), bool)
        # searched by halves: only those still open, each step's values side by side
        at = np.flatnonzero(inside & (start < end))
        lo, hi, target = start[at], end[at], x[at] & np.uint64((1 << self.width) - 1)
        while len(at):
            middle = (lo + hi) >> 1
            value = self._low(middle)
            less = value < target
            # values don't fall, so an equal one is at the place found, or a run of them ends there
            equal[at[value == target]] = True
            lo, hi = np.where(less, middle + 1, lo), np.where(less, hi, middle)
            closed = lo >= hi
            done = np.flatnonzero(closed)
            found[at[done]] = lo[done]
            still = np.flatnonzero(~closed)
            at, lo, hi, target = at[still], lo[still], hi[still], target[still]
        return found, equal
