"""Scores and geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shorter(lq: Column, lr: Column) -> Column:
    return F.least(lq, lr)


def d0_protein(n: Column) -> Column:
    return F.greatest(F.lit(0.5), F.when(n > 21, 1.24 * F.cbrt(n - 15) - 1.8).otherwise(0.5))


def d0_na(n: Column) -> Column:
    steps = F.when(n >= 30, 0.6 * F.sqrt(n - 0.5) - 2.5).when(n > 23, 0.7).when(n > 19, 0.6).when(n > 15, 0.5).when(n > 11, 0.4).otherwise(0.3)
    return F.greatest(F.lit(0.3), steps)


def d0(n: Column, mol: Column) -> Column:
    """The normalising distance of a length and molecule type."""
    return F.when(mol == "NA", d0_na(n)).otherwise(d0_protein(n))


def d0_search(n: Column) -> Column:
    return F.when(n > 19, 1.24 * F.cbrt(n - 15) - 1.8).otherwise(0.168) + 0.8


def d02_scan(n: Column) -> Column:
    return F.pow(d0_search(n) + 1.5, 2)


def d02s(d0: Column) -> Column:
    return F.pow(F.greatest(F.lit(4.5), F.least(F.lit(8.0), d0)), 2)


def d82(n: Column) -> Column:
    return F.pow(1.5 * F.pow(n, 0.3) + 3.5, 2)


def pair_score(distance2: Column, d0: Column) -> Column:
    return d0 * d0 / (d0 * d0 + distance2)


def distance2(a: tuple, b: tuple) -> Column:
    return sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0]))


def transform(point: tuple, rotation: list, translation: list) -> tuple:
    """R x + t with a row-major rotation."""
    return tuple(sum((rotation[3 * i + k] * point[k] for k in (1, 2)), rotation[3 * i] * point[0]) + translation[i] for i in range(3))


def inverse(rotation: list, translation: list) -> tuple[list, list]:
    """The rotation's transpose and the translation that undoes ``transform``."""
    back = [rotation[3 * k + i] for i in range(3) for k in range(3)]
    return back, [-sum((back[3 * i + k] * translation[k] for k in (1, 2)), back[3 * i] * translation[0]) for i in range(3)]


def normalised(total: Column, n: Column) -> Column:
    return total / n


def greater(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def harmonic(a: Column, b: Column) -> Column:
    return F.when(F.greatest(a, b) > 0, 2 * a * b / (a + b)).otherwise(0.0)


def in_limits(length: Column, least: int, most: int) -> Column:
    return length.between(least, most)


def same_molecule(a: Column, b: Column) -> Column:
    return a == b


def gapless_length(lq: Column, lr: Column, q: Column, r: Column) -> Column:
    return F.least(lq - q, lr - r)


def fragment_length(aligned: Column, level: int, levels: int = 6) -> Column:
    """The length of a refinement fragment: halved at each level, within floors."""
    if level == 0:
        return F.when(aligned < 4, aligned).otherwise(aligned if level + 1 < levels else F.lit(4))
    half = F.shiftright(aligned, level)
    half = F.when((half == 2) & (F.shiftright(half, level - 1).bitwiseAND(1) == 1), 4).otherwise(half)
    kept = F.greatest(half, F.lit(4)) if level + 1 < levels else F.lit(4)
    return F.when(half < 3, 0).otherwise(kept)


def step_size(n: Column, depth: str) -> Column:
    """The distance between seeds along a structure of n positions."""
    small = F.least(F.lit(15), F.greatest(F.lit(1), F.floor(n / 3).cast("int")))
    medium = F.when(n > 250, 45).when(n > 200, 35).when(n > 150, 25).otherwise(small)
    large = {"deep": F.when(n > 150, 15).otherwise(small), "high": F.when(n > 150, 23).otherwise(small), "medium": medium, "shallow": medium * 2}
    return large[depth]


def seed_length(lq: Column, lr: Column, which: int, frame: int = 0) -> Column:
    """The length of a seed fragment: short (0), long (1), or that of a frame of 64 or 128."""
    n = F.least(lq, lr)
    half = F.shiftright(n, 1)
    if frame:
        return F.least(F.lit(frame), half)
    return F.least(F.lit(20), F.greatest(F.lit(1), F.floor(n / 3).cast("int"))) if which == 0 else F.least(F.lit(100), half)
