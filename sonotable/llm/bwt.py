"""Repeated strings of a given length from a Burrows-Wheeler transform, by interval expansion."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols; a round sorts by as many ranks as fit 62 bits."""
    n = len(symbols)
    bits = max(1, (int(symbols.max()) + 1).bit_length())
    have = min(depth, 62 // bits)
    values = symbols
    places = range(have)
    while True:
        key = np.zeros(n, dtype=np.int64)
        for k in places:  # past the end: 0
            key <<= bits
            key[:max(0, n - k)] += values[k:] + np.int64(1)
        order = np.argsort(key)
        if have >= depth:
            return order
        key = key[order]
        values = np.empty(n, dtype=np.int64)
        values[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]))
        bits = n.bit_length()
        places = [0]
        for _ in range(62 // bits - 1):  # ranks may overlap
            places.append(min(places[-1] + have, depth - have))
        places = sorted(set(places))
        have += places[-1]


def string_classes(symbols: np.ndarray, length: int) -> np.ndarray:
    """For each position the number of its class: equal where the next ``length`` symbols are equal.

    Symbol 0 separates texts; strings that contain it get classes of no meaning. The
    longest common prefixes of neighbouring suffixes are derived by increasing value:
    an interval of suffixes that share a string of l symbols is extended backwards by every
    symbol before them, which gives the intervals of strings of l + 1 symbols; a right end
    not met before has the value l there, and its interval is extended in the next round.
    The rounds stop at ``length``, so every end is met once at most and what is left
    unmarked separates nothing.
    """
    n = len(symbols)
    present = np.bincount(symbols) > 0
    letter = (np.cumsum(present) - 1).astype(np.uint16)[symbols]
    order = suffix_order(letter, length + 1)
    transform = letter[order - 1]  # the symbol before each suffix
    # where each suffix is with that symbol in front, with a gap between symbols; a separator is never extended to
    slot = np.arange(1, n + 1, dtype=np.int32) + letter[order]
    place = np.empty(slot[-1] + 2, dtype=np.int32)
    place[slot] = np.arange(n, dtype=np.int32)
    back = np.empty(n, dtype=np.int32)
    back[np.argsort(transform, kind="stable")] = slot
    if present[0]:
        back[transform == 0] = -1
    met = np.zeros(n + 1, dtype=bool)
    met[n] = True
    # equal symbols in a row go to neighbouring slots, so an interval is extended by its runs of the transform
    head = np.flatnonzero(np.concatenate([[True], transform[1:] != transform[:-1], [True]])).astype(np.int32)
    run = np.repeat(np.arange(len(head) - 1, dtype=np.int32), np.diff(head))
    begun, ended = np.full((2, len(place)), -1, dtype=np.int32)  # the last interval with a run that begins, ends at a slot
    low, high, intervals = np.array([0]), np.array([n]), 0
    for _ in range(length):
        size = run[high - 1] - run[low] + 1
        last = np.cumsum(size)
        runs = np.repeat(run[low] - last + size, size) + np.arange(last[-1])
        begin, end = head[runs], head[runs + 1]
        begin[last - size], end[last - 1] = low, high
        source = np.repeat(np.arange(intervals, intervals + len(low), dtype=np.int32), size)
        intervals += len(low)
        a = back[begin]
        own = a >= 0
        a, source = a[own], source[own]
        z = a + (end - begin)[own]
        begun[a], ended[z] = source, source
        # runs of one symbol in an interval join
        a, z = np.sort(place[a[ended[a] != source]]), np.sort(place[z[begun[z] != source] - 1]) + 1
        new = ~met[z]
        low, high = a[new], z[new]
        if not len(low):
            break
        met[high] = True
    classes = np.empty(n, dtype=np.int64)
    classes[order] = np.cumsum(met[:n])
    return classes
