"""Words of a text as 64-bit hashes, hashes of runs of words, and packed rows for bulk exchanges."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_WORDS = 150_000  # cached per Python worker

# odd multipliers for the positions of a run; fixed, so that all tasks agree
MULTIPLIERS = np.random.default_rng(20240229).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def word_list(text: str | None, lower: bool) -> list[bytes]:
    """Words of UTF-8 text: runs without the six ASCII white-space characters, which are what ``bytes.split`` cuts at."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()  # bytes.lower changes A-Z only


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher, so that all bits of a sum count in every bit of the hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` words."""
    n = len(words) - length + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n] * MULTIPLIERS[0]
    for k in range(1, length):
        h = h + words[k:k + n] * MULTIPLIERS[k]
    return mixed(h)


def bucket_of(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """Bucket by the upper half of a hash; ascending with the hash."""
    return ((h >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)


def blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def planes(values: np.ndarray) -> bytes:
    """Integers >= 0 in as few bits as the largest needs, bit by bit: upper bits that are all alike compress to nothing."""
    width = max(1, int(values.max()).bit_length()) if len(values) else 1
    octets = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :-(-width // 8)]
    return np.packbits(np.unpackbits(octets, axis=1, bitorder="little")[:, :width].T, axis=1).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    """The ``n`` integers of ``planes``."""
    out = np.zeros((n, 8), dtype=np.uint8)
    if n:
        bits = np.unpackbits(np.frombuffer(data, dtype=np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n)
        octets = np.packbits(bits.T, axis=1, bitorder="little")
        out[:, :octets.shape[1]] = octets
    return out.view("<u8").ravel()


def unblob(rows, dtype) -> np.ndarray:
    """The arrays of several blobs, one after the other."""
    return np.frombuffer(b"".join(rows), dtype=dtype)
