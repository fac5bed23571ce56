"""Residue names, letters and the public substitution matrix."""

from __future__ import annotations

from functools import lru_cache
from math import log2

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Three-letter names by letter, the usual one first (fixed values of the public nomenclature).
NAMES = {
    "A": "ALA DAL", "B": "ASX", "C": "CYS DCY", "D": "ASP DAS", "E": "GLU DGL", "F": "PHE DPN", "G": "GLY", "H": "HIS DHI", "I": "ILE DIL",
    "K": "LYS DLY", "L": "LEU DLE", "M": "MET MED MSE", "N": "ASN DSG", "O": "PYL", "P": "PRO DPR", "Q": "GLN DGN", "R": "ARG DAR",
    "S": "SER DSN", "T": "THR DTH", "U": "SEC", "V": "VAL DVA", "W": "TRP DTR", "Y": "TYR DTY", "Z": "GLX",
}
LETTER = {name: letter for letter, names in NAMES.items() for name in names.split()}

#: Gonnet, Cohen and Benner (1992), PAM 250, in tenths of a decimal logarithm; rows follow ORDER (fixed values).
ORDER = "CSTPAGNDEQHRKMILVFYW"
GONNET = """
11.5
0.1 2.2
-0.5 1.5 2.5
-3.1 0.4 0.1 7.6
0.5 1.1 0.6 0.3 2.4
-2.0 0.4 -1.1 -1.6 0.5 6.6
-1.8 0.9 0.5 -0.9 -0.3 0.4 3.8
-3.2 0.5 0.0 -0.7 -0.3 0.1 2.2 4.7
-3.0 0.2 -0.1 -0.5 0.0 -0.8 0.9 2.7 3.6
-2.4 0.2 0.0 -0.2 -0.2 -1.0 0.7 0.9 1.7 2.7
-1.3 -0.2 -0.3 -1.1 -0.8 -1.4 1.2 0.4 0.4 1.2 6.0
-2.2 -0.2 -0.2 -0.9 -0.6 -1.0 0.3 -0.3 0.4 1.5 0.6 4.7
-2.8 0.1 0.1 -0.6 -0.4 -1.1 0.8 0.5 1.2 1.5 0.6 2.7 3.2
-0.9 -1.4 -0.6 -2.4 -0.7 -3.5 -2.2 -3.0 -2.0 -1.0 -1.3 -1.7 -1.4 4.3
-1.1 -1.8 -0.6 -2.6 -0.8 -4.5 -2.8 -3.8 -2.7 -1.9 -2.2 -2.4 -2.1 2.5 4.0
-1.5 -2.1 -1.3 -2.3 -1.2 -4.4 -3.0 -4.0 -2.8 -1.6 -1.9 -2.2 -2.1 2.8 2.8 4.0
0.0 -1.0 0.0 -1.8 0.1 -3.3 -2.2 -2.9 -1.9 -1.5 -2.0 -2.0 -1.7 1.6 3.1 1.8 3.4
-0.8 -2.8 -2.2 -3.8 -2.3 -5.2 -3.1 -4.5 -3.9 -2.6 -0.1 -3.2 -3.3 1.6 1.0 2.0 0.1 7.0
-0.5 -1.9 -1.9 -3.1 -2.2 -4.0 -1.4 -2.8 -2.7 -1.7 2.2 -1.8 -2.1 -0.2 -0.7 0.0 -1.1 5.1 7.8
-1.0 -3.3 -3.5 -5.0 -3.6 -4.0 -3.6 -5.2 -4.3 -2.7 -0.8 -1.6 -3.5 -1.0 -1.8 -0.7 -2.6 3.6 4.1 14.2
"""


@lru_cache(maxsize=1)
def substitution() -> dict[tuple[str, str], float]:
    """Bit scores of residue pairs; pairs that are missing score 0."""
    out = {}
    for a, row in zip(ORDER, GONNET.strip().split("\n")):
        for b, tenths in zip(ORDER, row.split()):
            out[a, b] = out[b, a] = float(tenths) / 10 * log2(10)
    return out


def residue_score(a: Column, b: Column) -> Column:
    """The score of two letters, by a literal map of fixed size."""
    table = F.create_map(*[F.lit(x) for (p, q), s in sorted(substitution().items()) for x in (p + q, s)])
    return F.coalesce(F.try_element_at(table, F.concat(a, b)), F.lit(0.0))


def letter(name: Column) -> Column:
    """The letter of a residue name; a one-character name stands for itself, others are X."""
    table = F.create_map(*[F.lit(x) for pair in sorted(LETTER.items()) for x in pair])
    short = F.trim(name)
    return F.coalesce(F.try_element_at(table, name), F.when(F.length(short) == 1, short).otherwise("X"))


def letter_of(name: str) -> str:
    """As ``letter``, for the readers."""
    short = name.strip()
    return LETTER.get(name) or (short if len(short) == 1 else "X")
