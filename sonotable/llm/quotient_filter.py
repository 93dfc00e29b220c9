"""Counting quotient filters over packed n-grams: lossless, compact, merged by sorted runs.

An n-gram of word ids is one integer of ``n * id_bits`` bits. A Feistel network permutes
these integers; the upper ``q`` bits of the result are the quotient, all others the
remainder, so quotient and remainder together give the n-gram back. A filter holds its
entries in the order of the permuted value: how many entries every quotient has, the
remainders, and a counter for each. Since the permutation spreads n-grams evenly over the
quotients, ranges of them are even shards, whatever the n-grams are.

Numbers are kept as two halves (``high``, ``low``) of at most 64 bits each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from sonotable.llm.hashing import mixed

ROUNDS = 4
WIDE = 255  # counters from here on are kept aside


def halves(n: int, id_bits: int) -> tuple[int, int]:
    """Bits of the high and the low half of a packed n-gram."""
    bits = n * id_bits
    return (bits + 1) // 2, bits // 2


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def packed(ids: list[np.ndarray], id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the integers whose digits are ``ids``, most significant first."""
    n = len(ids)
    hb, lb = halves(n, id_bits)
    high, low = np.zeros(len(ids[0]), dtype=np.uint64), np.zeros(len(ids[0]), dtype=np.uint64)
    for k, x in enumerate(ids):
        x, at = x.astype(np.uint64), (n - 1 - k) * id_bits  # bits at .. at + id_bits of the integer
        if at >= lb:
            high |= x << np.uint64(at - lb)
        else:
            low |= (x << np.uint64(at)) & _mask(lb)
            if at + id_bits > lb:
                high |= x >> np.uint64(lb - at)
    return high, low


def unpacked(high: np.ndarray, low: np.ndarray, n: int, id_bits: int) -> list[np.ndarray]:
    _, lb = halves(n, id_bits)
    out = []
    for k in range(n):
        at = (n - 1 - k) * id_bits
        if at >= lb:
            x = high >> np.uint64(at - lb)
        else:
            x = low >> np.uint64(at)
            if at + id_bits > lb:
                x = x | (high << np.uint64(lb - at))
        out.append(x & _mask(id_bits))
    return out


def _round(x: np.ndarray, k: int, bits: int) -> np.ndarray:
    return mixed(x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1)) >> np.uint64(64 - bits)


def permuted(high: np.ndarray, low: np.ndarray, n: int, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    hb, lb = halves(n, id_bits)
    for k in range(0, ROUNDS, 2):
        low = low ^ _round(high, k, lb)
        high = high ^ _round(low, k + 1, hb)
    return high, low


def restored(high: np.ndarray, low: np.ndarray, n: int, id_bits: int) -> tuple[np.ndarray, np.ndarray]:
    hb, lb = halves(n, id_bits)
    for k in reversed(range(0, ROUNDS, 2)):
        high = high ^ _round(low, k + 1, hb)
        low = low ^ _round(high, k, lb)
    return high, low


def _bytes_of(x: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :(bits + 7) // 8]).tobytes()


def _of_bytes(data: bytes, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :(bits + 7) // 8] = np.frombuffer(data, dtype=np.uint8).reshape(n, -1)
    return out.view("<u8").reshape(n).astype(np.uint64)


@dataclass
class Filter:
    """Entries in ascending (high, low) order with their counts."""

    high: np.ndarray
    low: np.ndarray
    count: np.ndarray

    def __len__(self) -> int:
        return len(self.count)

    def at_least(self, n: int) -> Filter:
        keep = self.count >= n
        return Filter(self.high[keep], self.low[keep], self.count[keep])

    def slices(self, shards: int, n: int, id_bits: int):
        """(shard, filter) for the shards that have entries: ranges of the permuted value."""
        hb, _ = halves(n, id_bits)
        if hb >= 32:
            shard = ((self.high >> np.uint64(hb - 32)) * np.uint64(shards)) >> np.uint64(32)
        else:
            shard = (self.high * np.uint64(shards)) >> np.uint64(hb)
        at = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(self) else np.zeros(0, dtype=np.int64)
        for a, b in zip(at.tolist(), np.r_[at[1:], len(self)].tolist()):
            yield int(shard[a]), Filter(self.high[a:b], self.low[a:b], self.count[a:b])

    def dump(self, n: int, id_bits: int) -> bytes:
        """Header, entries per quotient, remainders, counters, wide counters."""
        hb, lb = halves(n, id_bits)
        size = len(self)
        span = int(self.high[-1] - self.high[0]) + 1 if size else 1
        rest = max(0, (span // max(1, size)).bit_length() - 1)  # about one entry per quotient of the range
        quotient = self.high >> np.uint64(rest)
        first = int(quotient[0]) if size else 0
        runs = np.bincount((quotient - np.uint64(first)).astype(np.int64)) if size else np.zeros(0, dtype=np.int64)
        wide = self.count[self.count >= WIDE].astype("<u8")
        far = runs[runs >= WIDE].astype("<u8")
        head = np.array([size, rest, first, len(runs), len(far)], dtype="<u8").tobytes()
        return b"".join([head, np.minimum(runs, WIDE).astype(np.uint8).tobytes(), far.tobytes(), _bytes_of(self.high & _mask(rest), rest),
                         _bytes_of(self.low, lb), np.minimum(self.count, WIDE).astype(np.uint8).tobytes(), wide.tobytes()])

    @staticmethod
    def load(data: bytes, n: int, id_bits: int) -> Filter:
        _, lb = halves(n, id_bits)
        size, rest, first, n_runs, n_far = np.frombuffer(data, dtype="<u8", count=5).astype(int).tolist()
        at = 40

        def take(length: int) -> bytes:
            nonlocal at
            at += length
            return data[at - length:at]

        runs = np.frombuffer(take(n_runs), dtype=np.uint8).astype(np.int64)
        runs[runs == WIDE] = np.frombuffer(take(8 * n_far), dtype="<u8").astype(np.int64)
        high = np.repeat(np.arange(n_runs, dtype=np.uint64) + np.uint64(first), runs) << np.uint64(rest)
        if rest:
            high = high | _of_bytes(take(size * ((rest + 7) // 8)), size, rest)
        low = _of_bytes(take(size * ((lb + 7) // 8)), size, lb)
        count = np.frombuffer(take(size), dtype=np.uint8).astype(np.int64)
        count[count == WIDE] = np.frombuffer(take(len(data) - at), dtype="<u8").astype(np.int64)
        return Filter(high, low, count)


def _summed(high: np.ndarray, low: np.ndarray, count: np.ndarray | None) -> Filter:
    order = np.lexsort((low, high))  # stable merge sort: sorted runs are merged, not sorted anew
    high, low = high[order], low[order]
    new = np.flatnonzero(np.r_[True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])]) if len(high) else np.zeros(0, dtype=np.int64)
    sums = np.diff(np.r_[new, len(high)]) if count is None else (np.add.reduceat(count[order], new) if len(high) else count)
    return Filter(high[new], low[new], sums.astype(np.int64))


def counted(ids: list[np.ndarray], id_bits: int) -> Filter:
    """The filter of n-grams given by their columns of word ids."""
    return _summed(*permuted(*packed(ids, id_bits), len(ids), id_bits), None)


def merged(filters: list[Filter]) -> Filter:
    if len(filters) == 1:
        return filters[0]
    return _summed(*(np.concatenate([getattr(f, k) for f in filters]) for k in ("high", "low", "count")))


def grams(f: Filter, n: int, id_bits: int) -> list[np.ndarray]:
    """Columns of word ids of the filter's entries."""
    return unpacked(*restored(f.high, f.low, n, id_bits), n, id_bits)
