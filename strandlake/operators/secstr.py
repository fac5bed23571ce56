"""Secondary structure as window expressions over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kernels.geometry import NA_BANDS, NA_DEVIATION


def protein_structure(positions: DataFrame, key: str = "sid", order: str = "i") -> DataFrame:
    """Adds ``ss`` to positions (key, order, x, y, z): h, e, t or blank.

    One window over each structure; distances within five residues come from leads and lags.
    """
    w = Window.partitionBy(key).orderBy(order)

    def dist(a: int, b: int) -> Column:
        at = lambda c, k: F.lag(c, -k).over(w) if k < 0 else (F.lead(c, k).over(w) if k > 0 else F.col(c))
        return F.sqrt(sum(((at(c, a) - at(c, b)) * (at(c, a) - at(c, b)) for c in ("y", "z")), (at("x", a) - at("x", b)) * (at("x", a) - at("x", b))))

    df = positions
    for name, a, b in (("d15", -2, 2), ("d14", -2, 1), ("d25", -1, 2), ("d13", -2, 0), ("d24", -1, 1), ("d35", 0, 2)):
        df = df.withColumn(f"__{name}", dist(a, b))

    def near(far: float, four: float, three: float, tol: float) -> Column:
        want = {"d15": far, "d14": four, "d25": four, "d13": three, "d24": three, "d35": three}
        out = F.lit(True)
        for name, v in want.items():
            out = out & (F.abs(F.col(f"__{name}") - v) < tol)
        return out

    ss = F.when(F.col("__d15").isNull(), " ").when(near(6.37, 5.18, 5.45, 2.1), "h").when(near(13.0, 10.4, 6.1, 1.42), "e").when(F.col("__d15") < 8, "t").otherwise(" ")
    return df.withColumn("ss", ss).drop(*[f"__{n}" for n in ("d15", "d14", "d25", "d13", "d24", "d35")])


def pairing(a: Column, b: Column) -> Column:
    """Whether two bases can pair."""
    return F.concat(a, b).isin("TA", "UA", "AT", "AU", "GC", "GU", "CG", "UG")


def deviation(distance: Column, atom: str = "C3'") -> Column:
    """Deviation from the mean distance of paired atoms; null outside the band."""
    low, high = NA_BANDS[atom]
    off = F.abs(distance - (low + high) / 2)
    return F.when(off <= (high - low) / 2, off)


def base_pairs(positions: DataFrame, atom: str = "C3'", key: str = "sid", order: str = "i", letter: str = "res") -> DataFrame:
    """Adds ``ss`` to nucleotides: reciprocal best partners are brackets, the rest dots.

    A self-join within a structure on its key; the best partner is a partially aggregated minimum.
    """
    a = positions.select(F.col(key), F.col(order).alias("i1"), F.col(letter).alias("a"), *[F.col(c).alias(f"{c}1") for c in "xyz"])
    b = positions.select(F.col(key), F.col(order).alias("i2"), F.col(letter).alias("b"), *[F.col(c).alias(f"{c}2") for c in "xyz"])
    d = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2 + (F.col("z1") - F.col("z2")) ** 2)
    pairs = a.join(b, key).where((F.abs(F.col("i1") - F.col("i2")) > 2) & pairing(F.col("a"), F.col("b"))).withColumn("dev", deviation(d, atom)).where(F.col("dev") < NA_DEVIATION)
    partner = pairs.groupBy(key, F.col("i1")).agg(F.min(F.struct(F.round("dev", 9).alias("dev"), F.col("i2").alias("to")))["to"].alias("to"))
    back = partner.select(key, F.col("i1").alias("to"), F.col("to").alias("again"))
    mutual = partner.join(back, [key, "to"]).where(F.col("again") == F.col("i1")).select(key, F.col("i1").alias(order), "to")
    ss = F.when(F.col("to").isNull(), ".").when(F.col(order) < F.col("to"), "(").otherwise(")")
    return positions.join(mutual, [key, order], "left").withColumn("ss", ss).drop("to")
