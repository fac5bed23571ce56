"""Structures derived from the driver's tables: synthetic point chains, not biological data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROTEIN, NUCLEIC = "ACDEFGHIKLMNPQRSTVWY", "ACGU"

#: The same positions as SQL, for the checks.
POSITIONS_SQL = f"""
raw as (
  select vec_id // 4 as sid, (vec_id % 4) * 21 + k as i, embedding[3 * k - 2]::double as a, embedding[3 * k - 1]::double as b, embedding[3 * k]::double as c
  from embeddings, range(1, 22) t(k)),
steps as (select sid, i, a, b, c, sqrt(a * a + b * b + c * c) as norm from raw where i <= 84 - (sid % 5) * 12),
sums as (
  select sid, cast(i as int) as i,
    round(sum(3.8 * a / norm) over w, 3) as x, round(sum(3.8 * b / norm) over w, 3) as y, round(sum(3.8 * c / norm) over w, 3) as z,
    case when sid % 5 = 4 then 'NA' else 'Protein' end as mol, cast(count(*) over (partition by sid) as int) as len,
    case when sid % 5 = 4 then substr('{NUCLEIC}', cast((7 * i + sid) % 4 + 1 as int), 1) else substr('{PROTEIN}', cast((7 * i + sid) % 20 + 1 as int), 1) end as res
  from steps window w as (partition by sid order by i rows unbounded preceding)),
pos as (select sid, i, case when x = 0 then 0.0 else x end as x, case when y = 0 then 0.0 else y end as y, case when z = 0 then 0.0 else z end as z, mol, len, res from sums)
"""


def tasks(spark: SparkSession) -> int:
    """As many tasks as the cluster runs, or a shuffle has."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, i, x, y, z, mol, len, res): four vectors make a chain of up to 84 steps of 3.8 A."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    at = lambda off: F.get("embedding", 3 * F.col("k") + off).cast("double")
    raw = e.select(F.expr("vec_id div 4").alias("sid"), "vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("k"))
    raw = raw.select("sid", ((F.col("vec_id") % 4) * 21 + F.col("k")).cast("int").alias("i"), at(-3).alias("a"), at(-2).alias("b"), at(-1).alias("c")).where(F.col("i") <= 84 - (F.col("sid") % 5) * 12)
    # Dealt once, by structure, for the windows and all that follows: as many tasks as the cluster runs,
    # since the pairs that follow cost far more than the bytes suggest.
    raw = raw.repartition(tasks(spark), "sid")
    norm = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    w = Window.partitionBy("sid").orderBy("i")
    total = lambda c: F.round(F.sum(3.8 * F.col(c) / norm).over(w.rowsBetween(Window.unboundedPreceding, 0)), 3)
    run = lambda c: F.when(total(c) == 0, 0.0).otherwise(total(c))  # noqa: E731  zero has no sign
    nucleic = F.col("sid") % 5 == 4
    letter = lambda s: F.substring(F.lit(s), ((7 * F.col("i") + F.col("sid")) % len(s) + 1).cast("int"), F.lit(1))
    return raw.select("sid", "i", run("a").alias("x"), run("b").alias("y"), run("c").alias("z"), F.when(nucleic, "NA").otherwise("Protein").alias("mol"), F.count("*").over(Window.partitionBy("sid")).cast("int").alias("len"), F.when(nucleic, letter(NUCLEIC)).otherwise(letter(PROTEIN)).alias("res"))


def structures(spark: SparkSession, sf_dir: str, ss: bool = False) -> DataFrame:
    """The same chains as rows of the structures table; with ``ss`` proteins have their secondary structure."""
    from ..operators.secstr import protein_structure

    p = positions(spark, sf_dir)
    p = protein_structure(p) if ss else p.withColumn("ss", F.lit(None).cast("string"))
    g = p.groupBy("sid").agg(F.first("mol").alias("mol_type"), F.first("len").alias("length"), F.sort_array(F.collect_list(F.struct("i", "x", "y", "z", "res", "ss"))).alias("p"))  # at most 84 positions
    whole = F.when(F.col("mol_type") == "Protein", F.array_join(F.col("p")["ss"], "")) if ss else F.lit(None).cast("string")
    return g.select(F.col("sid").cast("long").alias("struct_id"), F.concat(F.lit("chain"), F.col("sid").cast("string")).alias("description"), "mol_type", "length", F.array_join(F.col("p")["res"], "").alias("seq"), whole.alias("ss"), F.col("p")["x"].alias("x"), F.col("p")["y"].alias("y"), F.col("p")["z"].alias("z"))


#: How far apart the parts of a long chain start, and where ids of long nucleic chains begin.
APART, LONG_NUCLEIC = 30.0, 1_000_000


def long_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of 180 to 264 positions: the four proteins of five structures in a row, and five nucleic chains, as one."""
    s = structures(spark, sf_dir)
    sid, nucleic = F.col("struct_id"), F.col("mol_type") == "NA"
    own = s.withColumn("whole", F.when(nucleic, LONG_NUCLEIC + F.expr("struct_id div 25")).otherwise(F.expr("struct_id div 5")))
    part = F.struct(sid.alias("sid"), F.when(nucleic, F.expr("struct_id div 5") % 5).otherwise(sid % 5).alias("k"), "seq", "x", "y", "z")
    g = own.groupBy("whole").agg(F.first("mol_type").alias("mol_type"), F.sum("length").cast("int").alias("length"), F.array_sort(F.collect_list(part)).alias("p"))  # five parts at most
    joined = lambda c, far: F.flatten(F.transform("p", lambda t: F.transform(t[c], lambda v: v + far * t["k"]))).alias(c)
    seq = F.array_join(F.transform("p", lambda t: t["seq"]), "")
    return g.select(F.col("whole").alias("struct_id"), F.concat(F.lit("long"), F.col("whole").cast("string")).alias("description"), "mol_type", "length", seq.alias("seq"), F.lit(None).cast("string").alias("ss"), joined("x", APART), joined("y", 0.0), joined("z", 0.0))


#: A turn and a shift, and how many residues a copy lacks in the middle.
TURN, SHIFT, MISSING = (0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6), (1.0, 2.0, -3.0), 10
#: Ids of copies start here.
COPY = 1_000_000_000


def copies(structures: DataFrame) -> DataFrame:
    """Each structure turned, shifted and without MISSING residues after its middle."""
    cut = F.floor(F.col("length") / 2).cast("int")
    without = lambda c: F.concat(F.slice(c, F.lit(1), cut), F.slice(c, cut + MISSING + 1, F.col("length") - cut - MISSING))
    row = lambda r: lambda t: TURN[3 * r] * t["x"] + TURN[3 * r + 1] * t["y"] + TURN[3 * r + 2] * t["z"] + SHIFT[r]
    moved = [F.transform(F.arrays_zip("x", "y", "z"), row(r)).alias(c) for r, c in enumerate("xyz")]
    whole = structures.select((F.col("struct_id") + COPY).alias("struct_id"), F.regexp_replace("description", "^chain", "copy").alias("description"), "mol_type", "length", "seq", F.lit(None).cast("string").alias("ss"), *moved)
    seq = F.concat(F.substring(F.col("seq"), F.lit(1), cut), F.substring(F.col("seq"), cut + MISSING + 1, F.col("length")))
    return whole.select("struct_id", "description", "mol_type", (F.col("length") - MISSING).alias("length"), seq.alias("seq"), "ss", *[without(c).alias(c) for c in "xyz"])
