"""Superposition, distances and scores of point sets."""

from __future__ import annotations

import numpy as np


def superpose(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations R and translations t that bring each q onto r with least squares: r ~ R q + t.

    ``q`` and ``r`` are (..., n, 3).  Degenerate sets (coincident or collinear points) still give
    proper rotations: the singular vectors are completed to determinant +1.
    """
    cq, cr = q.mean(axis=-2), r.mean(axis=-2)
    cov = np.swapaxes(q - cq[..., None, :], -1, -2) @ (r - cr[..., None, :])
    u, _, vt = np.linalg.svd(cov)
    sign = np.sign(np.linalg.det(u) * np.linalg.det(vt))
    sign = np.where(sign == 0, 1.0, sign)
    fix = np.ones((*sign.shape, 3))
    fix[..., 2] = sign
    rot = np.swapaxes(vt, -1, -2) @ (fix[..., None] * np.swapaxes(u, -1, -2))
    return rot, cr - (rot @ cq[..., None])[..., 0]


#: Product of the gaps between the greatest eigenvalue and the others, below which a rotation is worked out by singular values.
LEAST_GAP = 1e-4


def rotations(cov: np.ndarray) -> np.ndarray:
    """Proper rotations R of greatest trace(R cov) for many (B, 3, 3) sums of q_a r_b about the centres: r ~ R q.

    The quaternion is the eigenvector of Horn's matrix for its greatest eigenvalue, which Newton steps find from above, all
    matrices at once.  Where eigenvalues (nearly) coincide, as for collinear points, singular vectors are taken.
    """
    size = np.sqrt((cov * cov).sum((1, 2)))
    s = np.moveaxis(cov / np.where(size > 0, size, 1.0)[:, None, None], 0, -1)
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = s
    k = (xx + yy + zz, yz - zy, zx - xz, xy - yx, xx - yy - zz, xy + yx, zx + xz, yy - xx - zz, yz + zy, zz - xx - yy)
    linear = -8 * (xx * (yy * zz - yz * zy) - xy * (yx * zz - yz * zx) + xz * (yx * zy - yy * zx))
    own = _cofactors(*k)
    constant = k[0] * own[0][0] + k[1] * own[0][1] + k[2] * own[0][2] + k[3] * own[0][3]
    top, step = np.full(len(cov), 3**0.5), np.ones(len(cov))
    for _ in range(14):
        square = top * top
        slope = (4 * square - 4) * top + linear
        step = ((square - 2) * square + linear * top + constant) / np.where(slope > 0, slope, 1.0)
        top = top - step
        if abs(step).max(initial=0) < 1e-14:
            break
    rows = np.array(_cofactors(k[0] - top, k[1], k[2], k[3], k[4] - top, k[5], k[6], k[7] - top, k[8], k[9] - top))
    square = abs(np.array([rows[i, i] for i in range(4)]))
    w, x, y, z = rows[square.argmax(axis=0), :, np.arange(len(cov))].T
    norm = np.sqrt(w * w + x * x + y * y + z * z)
    w, x, y, z = (c / np.where(norm > 0, norm, 1.0) for c in (w, x, y, z))
    rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    rot = np.ascontiguousarray(np.moveaxis(rot, -1, 0))
    hard = ~((square.sum(axis=0) > LEAST_GAP) & (abs(step) < 1e-11))
    if hard.any():
        rot[hard] = _by_singular_vectors(cov[hard])
    return rot


def _cofactors(a, b, c, d, e, f, g, h, i, j):
    """Rows of cofactors of symmetric matrices, given by their upper triangles row by row."""
    b01, b02, b03, b12, b13, b23 = c * g - f * d, c * i - h * d, c * j - i * d, f * i - h * g, f * j - i * g, h * j - i * i
    a01, a02, a03, a12, a13, a23 = a * e - b * b, a * f - c * b, a * g - d * b, b * f - c * e, b * g - d * e, c * g - d * f
    return (
        (e * b23 - f * b13 + g * b12, -(b * b23 - f * b03 + g * b02), b * b13 - e * b03 + g * b01, -(b * b12 - e * b02 + f * b01)),
        (-(b * b23 - c * b13 + d * b12), a * b23 - c * b03 + d * b02, -(a * b13 - b * b03 + d * b01), a * b12 - b * b02 + c * b01),
        (g * a23 - i * a13 + j * a12, -(d * a23 - i * a03 + j * a02), d * a13 - g * a03 + j * a01, -(d * a12 - g * a02 + i * a01)),
        (-(f * a23 - h * a13 + i * a12), c * a23 - h * a03 + i * a02, -(c * a13 - f * a03 + i * a01), c * a12 - f * a02 + h * a01),
    )


def _by_singular_vectors(cov: np.ndarray) -> np.ndarray:
    u, _, vt = np.linalg.svd(cov)
    v = np.swapaxes(vt, -1, -2).copy()
    v[..., 2] *= np.where(np.linalg.det(u @ vt) < 0, -1.0, 1.0)[..., None]
    return v @ np.swapaxes(u, -1, -2)


def superpose_weighted(q: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``superpose`` for (..., n, 3) points with weights (..., n), none of which may sum to zero."""
    w = w / w.sum(axis=-1, keepdims=True)
    weighted = w[..., None] * q
    cq, cr = weighted.sum(axis=-2), (w[..., None, :] @ r)[..., 0, :]
    rot = _by_singular_vectors(np.swapaxes(weighted, -1, -2) @ r - cq[..., :, None] * cr[..., None, :])
    return rot, cr - (rot @ cq[..., None])[..., 0]


def between2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired points."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def move(points: np.ndarray, rot: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return points @ np.swapaxes(rot, -1, -2) + shift[..., None, :]


def invert(rot: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    back = np.swapaxes(rot, -1, -2)
    return back, -(back @ shift[..., None])[..., 0]


def rmsd(q: np.ndarray, r: np.ndarray) -> float:
    """Least root-mean-square deviation of paired points."""
    if not len(q):
        return 0.0
    rot, shift = superpose(q, r)
    return float(np.sqrt(np.maximum(((move(q, rot, shift) - r) ** 2).sum(axis=1).mean(), 0)))


def distances2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all points of a to all of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def d0_final(n: int, mol: str) -> float:
    if mol == "NA":
        return max(0.3, 0.6 * np.sqrt(n - 0.5) - 2.5 if n >= 30 else 0.7 if n > 23 else 0.6 if n > 19 else 0.5 if n > 15 else 0.4 if n > 11 else 0.3)
    return max(0.5, 1.24 * np.cbrt(n - 15) - 1.8 if n > 21 else 0.5)


def d0_search(n: int) -> float:
    return (1.24 * np.cbrt(n - 15) - 1.8 if n > 19 else 0.168) + 0.8


def d8(n: int) -> float:
    return 1.5 * n**0.3 + 3.5


def tm(d2: np.ndarray, d0: float) -> np.ndarray:
    return 1.0 / (1.0 + d2 / (d0 * d0))


def secondary_structure(xyz: np.ndarray) -> str:
    """Helix, strand, turn or loop of each position from distances within five residues.

    The reference distances and tolerances are fixed values; the two ends are loop.
    """
    n = len(xyz)
    if n < 5:
        return " " * n
    dist = {k: np.sqrt(((xyz[k:] - xyz[:-k]) ** 2).sum(1)) for k in (2, 3, 4)}
    d15, d14, d25 = dist[4], dist[3][:-1], dist[3][1:]
    d13, d24, d35 = dist[2][:-2], dist[2][1:-1], dist[2][2:]
    near = lambda a15, a14, a13, tol: (abs(d15 - a15) < tol) & (abs(d14 - a14) < tol) & (abs(d25 - a14) < tol) & (abs(d13 - a13) < tol) & (abs(d24 - a13) < tol) & (abs(d35 - a13) < tol)
    helix, strand = near(6.37, 5.18, 5.45, 2.1), near(13.0, 10.4, 6.1, 1.42)
    return "  " + "".join(np.select([helix, strand, d15 < 8], ["h", "e", "t"], " ").tolist()) + "  "


#: Least and greatest distance of paired nucleotides by atom (fixed values), and the most deviation of a pair.
NA_BANDS = {"C3'": (12.5, 15.0), "C4'": (14.0, 16.0), "C5'": (16.0, 18.0), "O3'": (13.5, 16.5), "O5'": (15.5, 18.5), "P": (16.5, 21.0)}
NA_DEVIATION = 1.5
PAIRS = frozenset(("TA", "UA", "AT", "AU", "GC", "GU", "CG", "UG"))


def base_pairs(xyz: np.ndarray, seq: str, atom: str = "C3'") -> str:
    """Dots and brackets: reciprocal best partners among pairable bases more than two apart."""
    n = len(seq)
    if not n:
        return ""
    low, high = NA_BANDS[atom]
    dev = abs(np.sqrt(distances2(xyz, xyz)) - (low + high) / 2)
    can = np.array([[a + b in PAIRS for b in seq] for a in seq]) & (abs(np.subtract.outer(np.arange(n), np.arange(n))) > 2)
    dev = np.where(can & (dev <= (high - low) / 2) & (dev < NA_DEVIATION), dev, np.inf)
    best = np.where(np.isfinite(dev.min(axis=1)), dev.argmin(axis=1), -1)
    return "".join("." if b < 0 or best[b] != i else "(" if i < b else ")" for i, b in enumerate(best.tolist()))
