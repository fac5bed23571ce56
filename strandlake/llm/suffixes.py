"""Sampled suffixes of texts, their order, and the tree of their common prefixes.

Every window of ``least`` bytes names one anchor in it: where its smallest hash of ``gram`` bytes lies
(the first of equal ones).  That depends on the window's bytes alone, so equal windows name the same place,
and it is enough to sort suffixes that begin at anchors, one in some thirty.  Windows that
name an anchor follow each other; a tile is the text that they cover, cut at the anchor into what stands
before it and the suffix.

``maximal_repeats`` sorts the suffixes of tiles with one hash, takes the lengths of common prefixes of
neighbours and scans them with a stack: each interval of that tree is a set of suffixes that share a
prefix which no longer one shares.  Within it, suffixes are told apart by what stands before them, by the same
scan over their left sides: what it reports can be extended neither way, and comes with all occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Window starts that are hashed at once; INDEX bits of a key number the place in the block.
BLOCK = 1 << 19
INDEX = 20
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, BLOCK + 4096)
_DOWN = _powers(pow(_BASE, -1, 2**64), BLOCK + 4096)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on, by differences of one running sum."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * _DOWN[: len(data)], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * _UP[: len(data) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    n, have = len(x) - width + 1, 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])


def anchors(data: np.ndarray, lengths: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, place, first and last window start of every anchor of texts that lie one after another in ``data``."""
    valid = np.ones(len(data), bool)
    ends = np.cumsum(lengths)
    for a, b in zip((ends - lengths).tolist(), ends.tolist()):
        valid[max(a, b - least + 1) : b] = False
    found = []
    low = np.uint64((1 << INDEX) - 1)
    for at in range(0, len(data), BLOCK):
        starts = np.flatnonzero(valid[at : at + BLOCK])
        if not len(starts):
            continue
        h = gram_hashes(data[at : at + int(starts[-1]) + least], gram)
        key = h & ~low | np.arange(len(h), dtype=np.uint64)
        place = (sliding_least(key, least - gram + 1)[starts] & low).astype(np.int64)
        begin = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(begin[1:], len(place)) - 1
        found.append((h[place[begin]], place[begin] + at, starts[begin] + at, starts[last] + at))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


def intervals(shared: Sequence[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of all intervals of ``least`` or longer in the tree of common prefixes, children before parents.

    ``shared`` has the length that each entry shares with the one before it; that of the first is not read.
    """
    stack: list[tuple[int, int]] = []
    n = len(shared)
    for i in range(1, n + 1):
        now, begin = (shared[i] if i < n else -1), i - 1
        while stack and stack[-1][0] > now:
            length, begin = stack.pop()
            if length >= least:
                yield length, begin, i - 1
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append((now, begin))


def maximal_repeats(tiles: Sequence[tuple[bytes, bytes]], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """(before, after, members) of all repeats of at least ``least`` bytes across the anchor of tiles (before, after).

    A repeat is the last ``before`` bytes of the left side and the first ``after`` bytes of the suffix; members are all
    tiles that hold it.  No byte can be added on either side without losing a member, as far as tiles reach.
    """
    reach = max((len(before) for before, _ in tiles), default=0)
    order = sorted(range(len(tiles)), key=lambda k: tiles[k][1])
    shared = [0] + [common_prefix(tiles[a][1], tiles[b][1]) for a, b in zip(order, order[1:])]
    for after, lo, hi in intervals(shared, least - reach):
        need = max(0, least - after)
        ranks = [k for k in range(lo, hi + 1) if len(tiles[order[k]][0]) >= need]
        if len(ranks) < 2:
            continue
        back = {k: tiles[order[k]][0][::-1] for k in ranks}
        ranks.sort(key=back.__getitem__)
        left = [0] + [common_prefix(back[a], back[b]) for a, b in zip(ranks, ranks[1:])]
        for before, a, b in intervals(left, need):
            same = ranks[a : b + 1]
            first, last = min(same), max(same)
            if min(shared[first + 1 : last + 1]) == after:  # else all of them share more to the right
                yield before, after, [order[k] for k in same]
