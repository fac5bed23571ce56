"""Shingle sets as hashes, and HyperMinHash sketches of them, vectorised over a batch.

A document's set is its distinct five-word shingles, each a 64-bit hash; with fewer words the
whole sequence is the one shingle.  A sketch has one register per bucket: the number of leading
zeros of the smallest hash in the bucket, and the mantissa bits that follow (Yu and Weber 2017).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .common import ASCII_SPACE, LOWER

SHINGLE = 5
#: log2 of the number of buckets.
BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
#: Mantissa bits kept after the leading zeros.
MANTISSA = 10
EMPTY = np.uint16(0xFFFF)

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 constants)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(ASCII_SPACE)] = True
_BYTE = mix(np.arange(256, dtype=np.uint64))
_STEP = mix(np.arange(100, 100 + SHINGLE, dtype=np.uint64)) | np.uint64(1)

#: Bytes hashed at once; longer batches are cut between texts, longer texts between words.
_CHUNK = 1 << 20
_POWER = np.full(_CHUNK + 1, _P, np.uint64)
_POWER[0] = 1
np.multiply.accumulate(_POWER, out=_POWER)
_INVERSE = np.full(_CHUNK + 1, _P_INV, np.uint64)
_INVERSE[0] = 1
np.multiply.accumulate(_INVERSE, out=_INVERSE)


def _hash_words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word in at most _CHUNK bytes (more only if one word is longer)."""
    gap = _IS_SPACE[b]
    edge = np.flatnonzero(np.diff(gap, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if len(b) > _CHUNK:  # a giant word: fold it piece by piece
        out = np.empty(len(start), np.uint64)
        for i, (x, y) in enumerate(zip(start.tolist(), end.tolist())):
            h = np.zeros(1, np.uint64)
            for z in range(x, y, _CHUNK):
                part = b[z : min(y, z + _CHUNK)]
                own = np.array([(_BYTE[part] * _POWER[: len(part)]).sum(dtype=np.uint64)])
                h = own if z == x else mix(h) ^ own
            out[i] = mix(h ^ np.array([y - x], np.uint64) * np.uint64(0xD6E8FEB86659FD93))[0]
        return out, start
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _POWER[: len(b)], out=total[1:])
    own = (total[end] - total[start]) * _INVERSE[start]
    return mix(own ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), start


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of lower-cased bytes, and where it starts.

    A word's hash is a polynomial of its bytes (by prefix sums), mixed with its length, so it does
    not depend on what stands around the word.
    """
    b = np.frombuffer(raw, np.uint8)
    if len(b) <= _CHUNK:
        return _hash_words(b)
    hashes, starts, a = [], [], 0
    while a < len(b):
        z = a + _CHUNK
        if z < len(b):
            last = np.flatnonzero(_IS_SPACE[b[a:z]])
            if len(last):
                z = a + int(last[-1]) + 1
            else:
                step, more = z, np.array([], int)
                while step < len(b) and not len(more):
                    more = np.flatnonzero(_IS_SPACE[b[step : step + _CHUNK]])
                    step += 0 if len(more) else _CHUNK
                z = step + int(more[0]) + 1 if len(more) else len(b)
        h, s = _hash_words(b[a:z])
        hashes.append(h)
        starts.append(s + a)
        a = z
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; the words of all are hashed together."""
    raws = [(t or "").encode().translate(LOWER) for t in texts]
    edges = np.cumsum([0, *(len(r) + 1 for r in raws)])
    words, start = word_hashes(b" ".join(raws))
    first = np.searchsorted(start, edges)
    n = len(words)
    runs = np.zeros(max(0, n - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE if len(runs) else 0):
        runs = _add(runs, words[k : n - SHINGLE + 1 + k], k)
    runs = mix(runs + np.uint64(SHINGLE))
    out = []
    for a, b in zip(first.tolist(), first.tolist()[1:]):
        if b - a >= SHINGLE:
            own = np.sort(runs[a : b - SHINGLE + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        elif b > a:
            h = np.zeros(1, np.uint64)
            for k in range(b - a):
                h = _add(h, words[a + k : a + k + 1], k)
            out.append(mix(h + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _add(h: np.ndarray, w: np.ndarray, k: int) -> np.ndarray:
    h = (h ^ mix(w)) * _STEP[k]
    return h ^ (h >> np.uint64(29))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set: rows of BUCKETS uint16, EMPTY where no hash fell."""
    size = np.array([len(s) for s in sets], np.int64)
    out = np.full((len(sets), BUCKETS), EMPTY, np.uint16)
    h = np.concatenate([*sets, np.empty(0, np.uint64)])
    if not len(h):
        return out
    at = np.repeat(np.arange(len(sets)), size) * BUCKETS + (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    # The hashes of a set are sorted, so the first of each bucket is its smallest.
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    least = h[first] << np.uint64(BUCKET_BITS)
    zeros = leading_zeros(least)
    mantissa = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[at[first]] = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    return out


def leading_zeros(x: np.ndarray) -> np.ndarray:
    """Leading zeros of 64-bit integers, at most 62."""
    n = np.zeros(len(x), np.int64)
    y = x.copy()
    for s in (32, 16, 8, 4, 2, 1):
        small = y < (np.uint64(1) << np.uint64(64 - s))
        n[small] += s
        y[small] <<= np.uint64(s)
    return np.minimum(n, 62)


def _probes() -> np.ndarray:
    """For each bucket, the order in which an empty one borrows from the others (fixed)."""
    k = np.arange(BUCKETS, dtype=np.uint64)
    return np.argsort(mix(k[:, None] * np.uint64(1 << 32) + k[None, :] + np.uint64(7)), axis=1)


_PROBES = _probes()


def densify(registers: np.ndarray) -> np.ndarray:
    """Fills empty registers from others in an order fixed per bucket (Shrivastava 2017).

    Two sets then agree in a register with probability about their Jaccard similarity, however
    small they are.  Rows that are all empty (no shingles) stay so.
    """
    out = registers.astype(np.uint32)
    full = registers != EMPTY
    doc, empty = np.nonzero(~full & full.any(axis=1)[:, None])
    for a in range(0, len(doc), 1 << 15):
        d, e = doc[a : a + (1 << 15)], empty[a : a + (1 << 15)]
        order = _PROBES[e]
        src = order[np.arange(len(d)), np.argmax(full[d[:, None], order], axis=1)]
        out[d, e] = registers[d, src].astype(np.uint32) | ((src.astype(np.uint32) + 1) << np.uint32(16))
    return out


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key per band of ``rows`` densified registers."""
    dense = densify(registers).astype(np.uint64)
    bands = BUCKETS // rows
    out = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(dense), 1))
    for k in range(rows):
        out = mix(out ^ mix(dense[:, k : bands * rows : rows] + np.uint64(k + 1)))
    return out.view(np.int64)


@lru_cache(maxsize=256)
def collision_rate(n: float, m: float) -> float:
    """Expected share of buckets in which two disjoint sets of sizes n and m agree by chance.

    Per bucket, smallest values are about exponential with rates n/B and m/B; registers agree if
    both fall in the same cell.  Summed over the cells of each leading-zero count.
    """
    cells = 1 << MANTISSA
    total = 0.0
    a, b = n / BUCKETS, m / BUCKETS
    for z in range(63):
        width = 2.0 ** -(z + 1) / cells
        x = 2.0 ** -(z + 1) + (np.arange(cells) * width)
        pa = np.exp(-a * x) * -np.expm1(-a * width)
        pb = np.exp(-b * x) * -np.expm1(-b * width)
        add = float((pa * pb).sum())
        total += add
        if z > 8 and add < 1e-12:
            break
    return total


def jaccard_bounds(registers: np.ndarray, size: np.ndarray, sigmas: float = 4.5) -> np.ndarray:
    """For all pairs of rows: the collision-corrected estimate plus ``sigmas`` standard errors.

    The estimate takes from the agreeing registers those expected by chance; a pair whose bound is
    below a threshold can be left out before verification.
    """
    m = len(registers)
    same = np.zeros((m, m), np.int32)
    both_empty = np.zeros((m, m), np.int32)
    for k in range(BUCKETS):
        col = registers[:, k]
        none = col == EMPTY
        eq = col[:, None] == col[None, :]
        both = none[:, None] & none[None, :]
        same += eq & ~both
        both_empty += both
    either = np.maximum(BUCKETS - both_empty, 1)
    # The chance rate is least sharp in its arguments: powers of two are near enough.
    level = np.round(np.log2(np.maximum(size, 1))).astype(np.int64)
    rate = np.array([collision_rate(2.0**x, 2.0**x) * BUCKETS for x in range(int(level.max()) + 1)])
    chance = rate[np.maximum(level[:, None], level[None, :])]
    estimate = np.clip((same - chance) / np.maximum(either - chance, 1e-9), 0.0, 1.0)
    return estimate + sigmas * np.sqrt(0.25 / either)
