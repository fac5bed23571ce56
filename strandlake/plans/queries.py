"""The registered queries of the engine, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..functions.residues import LETTER, letter, substitution
from ..functions.text import identifier, output_name, wrapped
from ..operators import aggregates as A
from ..operators import pairs as P
from ..operators import secstr
from ..kernels import gapless as kernels
from ..operators.cluster import cluster_rows, clusters, linkage_tree
from ..operators.filters import longest_first, reportable, scored, sort_key, top_hits
from ..operators.graph import folder, stored
from ..options import ClusterOptions, ReadOptions, SearchOptions
from ..sources import files, reports
from .checks import copied_hits, linkage_faults, recomputed, turned_around
from .fixtures import LONG_NUCLEIC, POSITIONS_SQL, copies, long_structures, positions, structures, tasks
from .search import aligned, all_pairs, candidate_pairs, cluster, search

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = f"with recursive {sql}" if "recursive" not in sql.split("\n", 1)[0] else sql
        return f

    return add


_D0 = "(case when {m} = 'NA' then greatest(0.3, case when {n} >= 30 then 0.6 * sqrt({n} - 0.5) - 2.5 when {n} > 23 then 0.7 when {n} > 19 then 0.6 when {n} > 15 then 0.5 when {n} > 11 then 0.4 else 0.3 end) else greatest(0.5, case when {n} > 21 then 1.24 * cbrt({n} - 15) - 1.8 else 0.5 end) end)"
_D2 = "((q.x - r.x) * (q.x - r.x) + (q.y - r.y) * (q.y - r.y) + (q.z - r.z) * (q.z - r.z))"
_SS = """
moved as (
  select *, lag(x, 2) over w as x1, lag(y, 2) over w as y1, lag(z, 2) over w as z1, lag(x) over w as x2, lag(y) over w as y2, lag(z) over w as z2,
    lead(x) over w as x4, lead(y) over w as y4, lead(z) over w as z4, lead(x, 2) over w as x5, lead(y, 2) over w as y5, lead(z, 2) over w as z5
  from pos window w as (partition by sid order by i)),
dist as (
  select *, sqrt((x1-x5)*(x1-x5)+(y1-y5)*(y1-y5)+(z1-z5)*(z1-z5)) as d15, sqrt((x1-x4)*(x1-x4)+(y1-y4)*(y1-y4)+(z1-z4)*(z1-z4)) as d14,
    sqrt((x2-x5)*(x2-x5)+(y2-y5)*(y2-y5)+(z2-z5)*(z2-z5)) as d25, sqrt((x1-x)*(x1-x)+(y1-y)*(y1-y)+(z1-z)*(z1-z)) as d13,
    sqrt((x2-x4)*(x2-x4)+(y2-y4)*(y2-y4)+(z2-z4)*(z2-z4)) as d24, sqrt((x-x5)*(x-x5)+(y-y5)*(y-y5)+(z-z5)*(z-z5)) as d35 from moved),
sspos as (
  select sid, i, x, y, z, mol, len, res, case when d15 is null then ' '
    when abs(d15-6.37)<2.1 and abs(d14-5.18)<2.1 and abs(d25-5.18)<2.1 and abs(d13-5.45)<2.1 and abs(d24-5.45)<2.1 and abs(d35-5.45)<2.1 then 'h'
    when abs(d15-13.0)<1.42 and abs(d14-10.4)<1.42 and abs(d25-10.4)<1.42 and abs(d13-6.1)<1.42 and abs(d24-6.1)<1.42 and abs(d35-6.1)<1.42 then 'e'
    when d15 < 8 then 't' else ' ' end as ss from dist)
"""
_SET = "q.sid % 100 = 0"


#: Positions of the query set that may be broadcast; a larger set joins by a shuffle.
MOST_POSITIONS = 500_000


def _broadcast(q: DataFrame) -> DataFrame:
    return F.broadcast(q) if q.count() <= MOST_POSITIONS else q


def _sides(p: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Positions of the query set against those of every reference of the same type, at equal places.

    The query set is a hundredth of the structures; the join is an equi-join on type and place.
    """
    cols = ("sid", "i", "x", "y", "z", "mol", "len", "res", *extra)
    q = p.where(F.col("sid") % 100 == 0).select(*[F.col(c).alias(f"q{c}") for c in cols])
    r = p.select(*[F.col(c).alias(f"r{c}") for c in cols])
    return r.join(_broadcast(q), (F.col("qmol") == F.col("rmol")) & (F.col("qi") == F.col("ri")))


def d2():
    return S.distance2((F.col("qx"), F.col("qy"), F.col("qz")), (F.col("rx"), F.col("ry"), F.col("rz")))


@query(
    POSITIONS_SQL
    + f""", pairs as (
  select q.sid as query_id, r.sid as ref_id, q.len as ql, r.len as rl, sum(1 / (1 + {_D2} / power({_D0.format(m="q.mol", n="q.len")}, 2))) / q.len as tq,
    sum(1 / (1 + {_D2} / power({_D0.format(m="r.mol", n="r.len")}, 2))) / r.len as tr
  from pos q join pos r on q.mol = r.mol and q.i = r.i where {_SET} group by q.sid, r.sid, q.len, r.len),
ranked as (
  select query_id, ref_id, round(tq, 6) as tmscore_query, round(tr, 6) as tmscore_refn, round(greatest(tq, tr), 6) as greater, round(2 * tq * tr / (tq + tr), 6) as harmonic,
    row_number() over (partition by query_id order by round(greatest(tq, tr), 6) desc, ref_id) as rank from pairs where greatest(tq, tr) >= 0.05)
select * from ranked where rank <= 2000"""
)
def search_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the query set against all at equal places, above a threshold, ranked per query."""
    q, s = _searched(structures(spark, sf_dir))
    t = P.scored_blocks(q, s, kernels.gapless, P.HIT)
    both = (F.col("tmscore_query"), F.col("tmscore_refn"))
    t = reportable(t, 0.05).select("query_id", "ref_id", F.round(S.harmonic(*both), 6).alias("harmonic"), *[F.round(c, 6).alias(n) for c, n in zip(both, ("tmscore_query", "tmscore_refn"))])
    return top_hits(t, "tm_greater", 2000).select("query_id", "ref_id", *("tmscore_query", "tmscore_refn"), S.greater(*both).alias("greater"), "harmonic", "rank")


@query(POSITIONS_SQL + "select sid, i, x, y, z, mol, len, res from pos")
def structure_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positions(spark, sf_dir)


@query(
    POSITIONS_SQL
    + f"""select sid, case when sum(case when mol = 'NA' then 1 else -1 end) > 0 then 'NA' else 'Protein' end as mol_type, cast(count(*) as bigint) as length,
  string_agg(res, '' order by i) as seq, round({_D0.format(m="max(mol)", n="count(*)")}, 6) as d0, count(*) between 48 and 84 as in_limits from pos group by sid"""
)
def structure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type by vote, length, sequence and normalising distance of each structure."""
    p = positions(spark, sf_dir)
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "res"))), lambda t: t["res"]), "")
    g = p.groupBy("sid").agg(A.molecule_vote(F.when(F.col("mol") == "NA", 1).otherwise(-1)).alias("mol_type"), F.count("*").alias("length"), seq.alias("seq"))
    return g.select("sid", "mol_type", "length", "seq", F.round(S.d0(F.col("length"), F.col("mol_type")), 6).alias("d0"), S.in_limits(F.col("length"), 48, 84).alias("in_limits"))


@query(POSITIONS_SQL + ", one as (select sid, max(len) as n from pos group by sid) select cast(count(*) as bigint) as structures, cast(sum(n) as bigint) as residues, cast(sum(case when sid % 100 = 0 then n else 0 end) * sum(n) as bigint) as search_space from one")
def search_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = positions(spark, sf_dir).groupBy("sid").agg(F.max("len").alias("n"))
    return one.agg(F.count("*").alias("structures"), F.sum("n").alias("residues"), (F.sum(F.when(F.col("sid") % 100 == 0, F.col("n")).otherwise(0)) * F.sum("n")).alias("search_space"))


@query(
    f"""n as (select distinct cast(o_orderkey % 300 + 1 as int) as n from orders)
select n, round({_D0.format(m="'Protein'", n="n")}, 6) as d0_protein, round({_D0.format(m="'NA'", n="n")}, 6) as d0_na,
  round((case when n > 19 then 1.24 * cbrt(n - 15) - 1.8 else 0.168 end) + 0.8, 6) as d0_search, round(power((case when n > 19 then 1.24 * cbrt(n - 15) - 1.8 else 0.168 end) + 2.3, 2), 6) as d02_scan,
  round(power(greatest(4.5, least(8.0, {_D0.format(m="'Protein'", n="n")})), 2), 6) as d02s, round(power(1.5 * power(n, 0.3) + 3.5, 2), 6) as d82,
  case when n > 150 then 15 else least(15, greatest(1, n // 3)) end as step_deep, case when n > 150 then 23 else least(15, greatest(1, n // 3)) end as step_high,
  case when n > 250 then 45 when n > 200 then 35 when n > 150 then 25 else least(15, greatest(1, n // 3)) end as step_medium,
  2 * case when n > 250 then 45 when n > 200 then 35 when n > 150 then 25 else least(15, greatest(1, n // 3)) end as step_shallow,
  least(20, greatest(1, least(n, 200) // 3)) as seed_short, least(100, least(n, 200) // 2) as seed_long, least(64, least(n, 200) // 2) as seed_frame,
  case when n // 4 = 2 then 4 when n // 4 < 3 then 0 else greatest(n // 4, 4) end as fragment_2, case when n // 32 < 3 then 0 else 4 end as fragment_5 from n"""
)
def length_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every number that depends on lengths alone."""
    n = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") % 300 + 1).cast("int").alias("n")).distinct()
    c, r = F.col("n"), lambda x: F.round(x, 6)
    other = F.lit(200)
    return n.select(
        "n", r(S.d0_protein(c)).alias("d0_protein"), r(S.d0_na(c)).alias("d0_na"), r(S.d0_search(c)).alias("d0_search"), r(S.d02_scan(c)).alias("d02_scan"),
        r(S.d02s(S.d0_protein(c))).alias("d02s"), r(S.d82(c)).alias("d82"), *[S.step_size(c, d).alias(f"step_{d}") for d in ("deep", "high", "medium", "shallow")],
        S.seed_length(c, other, 0).alias("seed_short"), S.seed_length(c, other, 1).alias("seed_long"), S.seed_length(c, other, 1, 64).alias("seed_frame"),
        S.fragment_length(c, 2).alias("fragment_2"), S.fragment_length(c, 5).alias("fragment_5"),
    )


@query(POSITIONS_SQL + "," + _SS + "select sid, cast(sum(case when ss = 'h' then 1 else 0 end) as bigint) as helix, cast(sum(case when ss = 'e' then 1 else 0 end) as bigint) as strand, cast(sum(case when ss = 't' then 1 else 0 end) as bigint) as turn, string_agg(ss, '' order by i) as ss from sspos where mol = 'Protein' group by sid")
def secondary_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = secstr.protein_structure(positions(spark, sf_dir).where("mol = 'Protein'"))
    n = lambda c, name: F.sum(F.when(F.col("ss") == c, 1).otherwise(0)).alias(name)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "ss"))), lambda t: t["ss"]), "").alias("ss")
    return p.groupBy("sid").agg(n("h", "helix"), n("e", "strand"), n("t", "turn"), text)


@query(
    POSITIONS_SQL
    + """, cand as (
  select a.sid, a.i as i1, b.i as i2, abs(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) - 13.75) as dev
  from pos a join pos b on a.sid = b.sid where a.mol = 'NA' and abs(a.i - b.i) > 2 and a.res || b.res in ('TA','UA','AT','AU','GC','GU','CG','UG')),
partner as (select sid, i1, min((round(dev, 9), i2))[2] as i2 from cand where dev <= 1.25 group by sid, i1),
mutual as (select a.sid, a.i1, a.i2 from partner a join partner b on a.sid = b.sid and a.i2 = b.i1 and b.i2 = a.i1)
select p.sid, p.i, case when m.i2 is null then '.' when p.i < m.i2 then '(' else ')' end as ss from pos p left join mutual m on p.sid = m.sid and p.i = m.i1 where p.mol = 'NA'"""
)
def base_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secstr.base_pairs(positions(spark, sf_dir).where("mol = 'NA'")).select("sid", "i", "ss")


def _matrix_sql() -> str:
    return "matrix(a, b, s) as (values " + ", ".join(f"('{a}', '{b}', {s!r}::double)" for (a, b), s in sorted(substitution().items())) + ")"


def _local_sql(edge: int, step: int) -> str:
    """The best ungapped local score ``v`` (missing for none) of the query set against all, as ``best``: diagonals ``step`` apart, none from the last ``edge`` places."""
    every, later = (f"range({first}, 84, {step})" if step > 1 else f"range({first}, 84)" for first in (0, step))
    end = f" - {edge}" if edge else ""
    return (
        POSITIONS_SQL
        + ","
        + _matrix_sql()
        + f""", lens as (select distinct sid, len, mol from pos),
starts as (
  select q.sid as qs, r.sid as rs, q.len as ql, r.len as rl, s as qo, 0 as ro from lens q join lens r on q.mol = r.mol, {every} t(s) where q.sid % 100 = 0 and s < q.len{end}
  union all select q.sid, r.sid, q.len, r.len, 0, s from lens q join lens r on q.mol = r.mol, {later} t(s) where q.sid % 100 = 0 and s < r.len{end}),
marks as (
  select qs, rs, qo, ro, q.i as i, coalesce(m.s, 0) as s from starts join pos q on q.sid = qs and q.i > qo join pos r on r.sid = rs and r.i - ro = q.i - qo left join matrix m on m.a = q.res and m.b = r.res),
run as (select *, sum(s) over (partition by qs, rs, qo, ro order by i rows unbounded preceding) as c from marks),
low as (select *, least(0, coalesce(min(c) over (partition by qs, rs, qo, ro order by i rows between unbounded preceding and 1 preceding), 0)) as m from run),
best as (select qs, rs, max(c - m) as v from low group by qs, rs)
"""
    )


_BEST_SQL = " from lens q join lens r on q.mol = r.mol left join best on qs = q.sid and rs = r.sid where q.sid % 100 = 0"


@query(_local_sql(0, 1) + "select q.sid as q_id, r.sid as r_id, round(greatest(0, coalesce(v, 0)), 6) as similarity" + _BEST_SQL)
def sequence_prescreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ungapped local score of the query set against all, by all diagonals."""
    q, s = _searched(structures(spark, sf_dir))
    return P.similarities(q, s, starts=kernels.EVERY_START).select("q_id", "r_id", F.round("similarity", 6).alias("similarity"))


@query(POSITIONS_SQL + ", one as (select distinct sid, len, mol from pos) select a.mol, a.len as len_a, b.len as len_b, cast(count(*) as bigint) as pairs from one a join one b on a.mol = b.mol and a.sid < b.sid and greatest(a.len, b.len) * 0.7 <= least(a.len, b.len) group by a.mol, a.len, b.len")
def coverage_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the length-coverage filter of clustering lets through, by type and lengths (of the smaller id first)."""
    one = positions(spark, sf_dir).where("i = 1").select(F.col("sid").alias("struct_id"), F.col("mol").alias("mol_type"), F.col("len").alias("length"))
    g = all_pairs(one, ClusterOptions(coverage=0.7), SearchOptions()).groupBy(F.col("q_mol").alias("mol"), F.col("q_len").alias("len_a"), F.col("r_len").alias("len_b"))
    return g.agg(F.count("*").alias("pairs"))


@query(POSITIONS_SQL + "," + _matrix_sql() + f" select q.sid as query_id, r.sid as ref_id, round(sum(coalesce(m.s, 0)), 6) as score from pos q join pos r on q.mol = r.mol and q.i = r.i left join matrix m on m.a = q.res and m.b = r.res where {_SET} group by q.sid, r.sid")
def residue_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The substitution score of each pair at equal places."""
    q, s = _searched(structures(spark, sf_dir))
    return P.scored_blocks(q, s, kernels.residue_scores, "query_id long, ref_id long, score double", ("seq",)).withColumn("score", F.round("score", 6))


_COV = ", ".join([f"round(sum(q.{a} * r.{b}), 6) as s_{a}{b}" for a in "xyz" for b in "xyz"] + [f"round(sum({s}.{a}), 6) as {s}_{a}" for s in "qr" for a in "xyz"] + ["cast(count(*) as bigint) as n"] + [f"round(sum({s}.{a} * {s}.{a}), 6) as {s}{s}_{a}" for s in "qr" for a in "xyz"])


@query(POSITIONS_SQL + f"select q.sid as query_id, r.sid as ref_id, {_COV} from pos q join pos r on q.mol = r.mol and q.i = r.i where {_SET} group by q.sid, r.sid")
def covariance_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = _searched(structures(spark, sf_dir))
    kinds = ", ".join(f"{c} {'long' if c == 'n' else 'double'}" for c in kernels.COVARIANCE)
    g = P.scored_blocks(q, s, kernels.covariance, f"query_id long, ref_id long, {kinds}")
    return g.select("query_id", "ref_id", *[F.round(c, 6).alias(c) if c != "n" else "n" for c in g.columns[2:]])


@query(POSITIONS_SQL + f", d as (select distinct q.sid as query_id, r.sid as ref_id, round({_D2}, 6) as d2 from pos q join pos r on q.mol = r.mol and q.i = r.i where {_SET}), k as (select *, row_number() over (partition by query_id, ref_id order by d2) as k from d) select query_id, ref_id, max(case when k = 1 then d2 end) as v1, max(case when k = 2 then d2 end) as v2, max(case when k = 3 then d2 end) as v3 from k where k <= 3 group by query_id, ref_id")
def smallest_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, s = _searched(structures(spark, sf_dir))
    return P.scored_blocks(q, s, kernels.smallest, "query_id long, ref_id long, v1 double, v2 double, v3 double")


_T2 = "case when q.ss = 'h' and r.ss <> 'h' or q.ss <> 'h' and r.ss = 'h' then 0 else 1 / (1 + {d} / power({n}, 2)) end"
_KEYS = {"tm_greater": "greatest(tq, tr)", "tm_refn": "tr", "tm_query": "tq", "tm_harmonic": "2 * tq * tr / (tq + tr)", "rmsd": "-rmsd", "tm2_greater": "greatest(sq, sr)", "tm2_refn": "sr", "tm2_query": "sq", "tm2_harmonic": "case when greatest(sq, sr) > 0 then 2 * sq * sr / (sq + sr) else 0 end"}


@query(
    POSITIONS_SQL
    + ","
    + _SS
    + f""", typed as (select * replace (case when mol = 'NA' then '.' else ss end as ss) from sspos),
t as (
  select q.sid as query_id, r.sid as ref_id, sum(1 / (1 + {_D2} / power({_D0.format(m="q.mol", n="q.len")}, 2))) / q.len as tq, sum(1 / (1 + {_D2} / power({_D0.format(m="r.mol", n="r.len")}, 2))) / r.len as tr,
    sum({_T2.format(d=_D2, n=_D0.format(m="q.mol", n="q.len"))}) / q.len as sq, sum({_T2.format(d=_D2, n=_D0.format(m="r.mol", n="r.len"))}) / r.len as sr, sqrt(avg({_D2})) as rmsd
  from typed q join typed r on q.mol = r.mol and q.i = r.i where {_SET} group by q.sid, r.sid, q.len, r.len)
select query_id, ref_id, """
    + ", ".join(f"cast(row_number() over (partition by query_id order by round({v}, 6) desc, ref_id) as int) as {k}" for k, v in _KEYS.items())
    + " from t"
)
def sort_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rank of each hit under all nine sort keys, second scores without unmatched helices."""
    ss = secstr.protein_structure(positions(spark, sf_dir))
    p = _sides(ss.withColumn("ss", F.when(F.col("mol") == "NA", ".").otherwise(F.col("ss"))), ("ss",))
    one = lambda side: S.pair_score(d2(), S.d0(F.col(f"{side}len"), F.col(f"{side}mol")))
    odd = (F.col("qss") == "h") != (F.col("rss") == "h")
    second = lambda side: F.when(odd, 0.0).otherwise(one(side))
    t = p.groupBy(F.col("qsid").alias("query_id"), F.col("rsid").alias("ref_id"), "qlen", "rlen").agg((F.sum(one("q")) / F.col("qlen")).alias("tmscore_query"), (F.sum(one("r")) / F.col("rlen")).alias("tmscore_refn"), (F.sum(second("q")) / F.col("qlen")).alias("tm2score_query"), (F.sum(second("r")) / F.col("rlen")).alias("tm2score_refn"), F.sqrt(F.avg(d2())).alias("rmsd"))
    rank = lambda k: F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(sort_key(k), 6).desc(), "ref_id")).alias(k)
    return t.select("query_id", "ref_id", *[rank(k) for k in _KEYS])


@query(
    POSITIONS_SQL
    + f""", o as (
  select q.sid as query_id, r.sid as ref_id, q.i - r.i as off, round(sum(1 / (1 + {_D2} / power({_D0.format(m="q.mol", n="least(q.len, r.len)")}, 2))), 6) as score
  from pos q join pos r on q.mol = r.mol where {_SET} group by q.sid, r.sid, q.i - r.i, q.len, r.len having count(*) >= greatest(5, least(q.len, r.len) // 2))
select query_id, ref_id, max(score) as score, cast(max((score, -off))[2] * -1 as int) as off from o group by query_id, ref_id"""
)
def best_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best gapless alignment of each pair, of all that overlap enough; a pair is one row."""
    q, s = _searched(structures(spark, sf_dir))
    return P.best_diagonals(q, s)


@query(POSITIONS_SQL + f"select q.sid as query_id, r.sid as ref_id, cast(sum(case when q.res = r.res then 1 else 0 end) as bigint) as n_identities, cast(sum(case when {_D2} <= 25 then 1 else 0 end) as bigint) as n_matched, string_agg(case when q.res = r.res and {_D2} <= 25 then upper(q.res) when q.res = r.res then lower(q.res) when {_D2} <= 25 then '+' else ' ' end, '' order by q.i) as middle from pos q join pos r on q.mol = r.mol and q.i = r.i where {_SET} group by q.sid, r.sid")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, matches within 5 A and the middle line of each pair."""
    q, s = _searched(structures(spark, sf_dir))
    return P.scored_blocks(q, s, kernels.matches(), "query_id long, ref_id long, n_identities long, n_matched long, middle string", ("x", "y", "z", "seq"))


@query(
    """c as (select user_id, ts, event_id, value - 50 as v from events),
run as (select user_id, ts, event_id, sum(v) over w as s from c window w as (partition by user_id order by ts, event_id rows unbounded preceding)),
low as (select user_id, s, least(0, coalesce(min(s) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)) as m from run)
select user_id, round(greatest(0, max(s - m)), 4) as best_run from low group by user_id"""
)
def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of a signed series: running sums and running minima."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", (F.col("value") - 50).alias("v"))
    return A.best_run(e, ["user_id"], ["ts", "event_id"], "v").select("user_id", F.round("best_run", 4).alias("best_run"))


@query(
    """f as (select user_id, ts, event_id, case when event_type <> lag(event_type) over (partition by user_id order by ts, event_id) then 1 else 0 end as cut from events),
s as (select user_id, sum(cut) over (partition by user_id order by ts, event_id rows unbounded preceding) as segment from f)
select user_id, cast(segment as bigint) as segment, cast(count(*) as bigint) as n from s group by user_id, segment"""
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation at each change of kind: a flag and its running sum, as chains are cut."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "event_type")
    return A.segmented(e, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id", "segment").agg(F.count("*").alias("n"))


@query(
    """d as (select p_partkey, case when p_partkey % 3 = 0 then '/data/sub/pdb' else '/data/' end || p_partkey || case when p_partkey % 2 = 0 then '.ent' else '.cif.gz' end
  || case when p_partkey % 5 = 0 then ':m' || p_partkey || '.pdb' else '' end || case when p_partkey % 4 > 0 then ' Chn:' || chr(cast(65 + p_partkey % 4 as int)) else '' end || case when p_partkey % 7 = 0 then ' (M:' || (p_partkey % 3) || ')' else '' end as description from part),
b as (select p_partkey, description, case when starts_with(regexp_extract(description, '[^/]*$'), 'pdb') then substr(regexp_extract(description, '[^/]*$'), 4) else regexp_extract(description, '[^/]*$') end as name from d),
c as (select *, regexp_extract(name, '^.* \\(M:([^) ]{0,4})', 1) as model, regexp_replace(name, ' \\(M:.*$', '') as name2 from b),
e as (select *, regexp_extract(name2, '^.* Chn:([^ ]{0,4})', 1) as chain, regexp_replace(name2, ' Chn:.*$', '') as stem from c),
g as (select *, case when instr(stem, ':') > 0 and length(stem) > instr(stem, ':') then substr(stem, instr(stem, ':') + 1) else stem end as s2 from e),
h as (select *, case when instr(s2, '.') > 4 then split_part(s2, '.', 1) else regexp_replace(s2, '\\.[^.]{0,3}$', '') end as s3 from g)
select p_partkey, description, s3 || case when chain <> '' then '_' || chain else '' end || case when model <> '' and not starts_with(model, '0') then '_' || model else '' end as id,
  regexp_replace(regexp_extract(description, '[^/]*$'), '\\.[^.]*$', '') || '__' || p_partkey || '.json' as output from h"""
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids and output names of descriptions."""
    k = F.col("p_partkey")
    s = k.cast("string")
    d = F.concat(F.when(k % 3 == 0, "/data/sub/pdb").otherwise("/data/"), s, F.when(k % 2 == 0, ".ent").otherwise(".cif.gz"), F.when(k % 5 == 0, F.concat(F.lit(":m"), s, F.lit(".pdb"))).otherwise(""), F.when(k % 4 > 0, F.concat(F.lit(" Chn:"), F.char((65 + k % 4).cast("int")))).otherwise(""), F.when(k % 7 == 0, F.concat(F.lit(" (M:"), (k % 3).cast("string"), F.lit(")"))).otherwise(""))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", d.alias("description")).select("p_partkey", "description", identifier(F.col("description")).alias("id"), output_name(F.col("description"), k, "json").alias("output"))


_NAMES = [*sorted(LETTER), "  U", " DA", "UNK", "HOH", "A  "]


@query(
    "known(n, l) as (values " + ", ".join(f"('{n}', '{c}')" for n, c in sorted(LETTER.items())) + "), d as (select p_partkey, [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][cast(p_partkey % {len(_NAMES)} + 1 as int)] as name from part) select p_partkey, name, coalesce(l, case when length(trim(name)) = 1 then trim(name) else 'X' end) as letter from d left join known on n = name"
)
def residue_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("p_partkey") % len(_NAMES) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", name.alias("name")).withColumn("letter", letter(F.col("name")))


@query(POSITIONS_SQL + f", d as (select q.sid as query_id, r.sid as ref_id, q.i, min((round({_D2}, 6), r.i)) as m from pos q join pos r on q.mol = r.mol where {_SET} group by q.sid, r.sid, q.i) select query_id, ref_id, i, m[2] as nearest, m[1] as d2 from d")
def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each position of the query set the nearest one of every reference, exactly; a pair is one row until its positions are listed."""
    q, s = _searched(structures(spark, sf_dir))
    return P.nearest_positions(q, s)


@query(POSITIONS_SQL + "," + _SS + f""", d as (select q.sid as query_id, r.sid as ref_id, q.i, min((round({_D2}, 6), r.i)) as m from sspos q join sspos r on q.mol = r.mol and q.ss = r.ss
  where {_SET} and q.mol = 'Protein' and round({_D2}, 6) <= 64 group by q.sid, r.sid, q.i) select query_id, ref_id, i, m[2] as nearest, m[1] as d2 from d""")
def nearest_of_same_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``nearest_neighbours`` among positions of the same secondary structure within 8 A; proteins, whose structure is h, e, t or none."""
    q, s = _searched(structures(spark, sf_dir, ss=True).where("mol_type = 'Protein'"))
    return P.nearest_positions(q, s, same_structure=True)


@query(POSITIONS_SQL + "select sid, i, round(0.36 * x + 0.48 * y - 0.8 * z + 1, 6) as tx, round(-0.8 * x + 0.6 * y + 2, 6) as ty, round(0.48 * x + 0.64 * y + 0.6 * z - 3, 6) as tz, round(x, 6) as bx, round(y, 6) as by, round(z, 6) as bz from pos")
def transformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions after a transform, and after its inverse again."""
    rot, shift = [F.lit(v) for v in (0.36, 0.48, -0.8, -0.8, 0.6, 0.0, 0.48, 0.64, 0.6)], [F.lit(v) for v in (1.0, 2.0, -3.0)]
    p = positions(spark, sf_dir)
    there = S.transform((F.col("x"), F.col("y"), F.col("z")), rot, shift)
    back = S.transform(there, *S.inverse(rot, shift))
    return p.select("sid", "i", *[F.round(c, 6).alias(n) for c, n in zip((*there, *back), ("tx", "ty", "tz", "bx", "by", "bz"))])


#: Gapless hits of all pairs within coverage, and their single linkage at a TM-score of 0.07, as SQL.
_LINKED = (
    POSITIONS_SQL
    + f""", one as (select sid, any_value(len) as len, any_value(mol) as mol, string_agg(res, '' order by i) as seq from pos group by sid),
e as (
  select q.sid as a, r.sid as b, sum(1 / (1 + {_D2} / power({_D0.format(m="q.mol", n="q.len")}, 2))) / q.len as tq, sum(1 / (1 + {_D2} / power({_D0.format(m="r.mol", n="r.len")}, 2))) / r.len as tr,
    sqrt(avg({_D2})) as rmsd, count(*) as n, q.len as ql, r.len as rl
  from pos q join pos r on q.mol = r.mol and q.i = r.i and q.sid < r.sid and greatest(q.len, r.len) * 0.7 <= least(q.len, r.len) group by q.sid, r.sid, q.len, r.len),
far as (select *, case when n < 0.7 * ql or n < 0.7 * rl then 1.0 else greatest(0, 1 - greatest(tq, tr)) end as dist from e),
near as (select a, b, dist from far where dist <= 1 - 0.07),
l as (select a, b from near union select b, a from near),
reach as (select distinct sid as a, sid as b from pos union select r.a, l.b from reach r join l on r.b = l.a),
named as (select a as struct_id, min(b) as cluster_id from reach group by a),
low as (select id, min(dist) as h from (select a as id, dist from near union all select b, dist from near) group by id),
rep as (select cluster_id, min((coalesce(h, 1e9), struct_id))[2] as rep_id, count(*) as n_members from named left join low on id = struct_id group by cluster_id),
assigned as (select struct_id, cluster_id, rep_id, n_members from named join rep using (cluster_id))
"""
)


def gapless(spark: SparkSession, sf_dir: str, options: ClusterOptions | None = None) -> DataFrame:
    """Hits of all pairs within coverage, aligned place by place; with ``options`` those that a clustering looks at."""
    return P.gapless_hits(structures(spark, sf_dir), 0.7, options)


_SINGLE, _COMPLETE = ClusterOptions(threshold=0.07, linkage="single"), ClusterOptions(threshold=0.07)


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(structures(spark, sf_dir), gapless(spark, sf_dir, _SINGLE), _SINGLE)


@query(_LINKED + "select struct_id, cluster_id, rep_id, n_members from assigned")
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single linkage at a fixed cut: components of the pairs that are near enough, with representatives and sizes."""
    return linked(spark, sf_dir)


@query(
    _LINKED
    + """, p0 as (select a, b, min(d) as d from (select a, b, dist as d from near union all select b, a, dist from near union all select sid, sid, 0 from one) group by a, b),
"""
    + ",\n".join(f"p{k + 1} as (select x.a, y.b, min(greatest(x.d, y.d)) as d from p{k} x join p{k} y on x.b = y.a group by x.a, y.b)" for k in range(7))
    + """,
joins as (select b as "from", min(d) as height from p7 where a < b group by b)
select (select min(a) from p7 where p7.b = j."from" and p7.d <= j.height) as "into", "from", round(height, 6) as height from joins j"""
)
def single_linkage_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree of single linkage: where each structure's cluster, named by its smallest member, is joined to which other."""
    tree = linkage_tree(gapless(spark, sf_dir, _SINGLE), _SINGLE)
    return tree.select("into", "from", F.round("height", 6).alias("height"))


@query(_LINKED + "select cast(rep_id as varchar) || coalesce(' ' || string_agg(cast(struct_id as varchar), ' ' order by struct_id) filter (struct_id <> rep_id), '') as value from assigned group by cluster_id, rep_id")
def cluster_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster list: a line each, the representative first, large clusters first."""
    return reports.cluster_list(cluster_rows(linked(spark, sf_dir)))


@query(
    _LINKED
    + """, placed as (select cluster_id, row_number() over (partition by cluster_id order by struct_id <> rep_id, struct_id) as "order", struct_id, seq from assigned join one on sid = struct_id)
select cluster_id, "order", 0 as line_no, '>chain' || struct_id as line from placed
union all select cluster_id, "order", cast(k + 1 as int), substr(seq, cast(k * 80 + 1 as int), 80) from placed, range(0, 2) t(k) where k * 80 < length(seq)"""
)
def linked_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of the same clusters, the representative first."""
    return reports.cluster_sequences(linked(spark, sf_dir), structures(spark, sf_dir))


@query(
    _LINKED
    + """, placed as (select cluster_id, n_members, rep_id, row_number() over (partition by cluster_id order by struct_id <> rep_id, struct_id) as place, struct_id, seq from assigned join one on sid = struct_id),
lines as (
  select cluster_id, place, 0 as line_no, '>chain' || struct_id as line from placed
  union all select cluster_id, place, cast(k + 1 as int), substr(seq, cast(k * 80 + 1 as int), 80) from placed, range(0, 2) t(k) where k * 80 < length(seq)),
listed as (select n_members, rep_id, string_agg(cast(struct_id as varchar), ' ' order by place) as line from placed group by cluster_id, n_members, rep_id)
select 'cluster_' || cluster_id || '.fa' as file, count(*) as n_lines, md5(string_agg(line || chr(10), '' order by place, line_no)) as content from lines group by cluster_id
union all select 'clusters.lst', count(*), md5(string_agg(line || chr(10), '' order by n_members desc, rep_id)) from listed"""
)
def cluster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster list and the sequences of each cluster as files, read again: lines and digest of each."""
    at = folder(spark, "cluster-files")
    assigned = stored(linked(spark, sf_dir), "assigned")
    reports.write_cluster_list(cluster_rows(assigned), at)
    reports.write_cluster_sequences(assigned, structures(spark, sf_dir), at)
    read = spark.read.text(at, wholetext=True).withColumn("file", F.regexp_extract(F.input_file_name(), "[^/]*$", 0))
    return read.select("file", (F.size(F.split("value", "\n")) - 1).cast("long").alias("n_lines"), F.md5("value").alias("content"))


@query(_LINKED + "select (select count(*) from one) as structures, (select count(*) from near) > 0 as some_together, 0::bigint as apart, 0::bigint as joinable")
def complete_linkage_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete linkage of the same hits: no far pair within a cluster, and no two clusters that could still be joined."""
    return linkage_faults(structures(spark, sf_dir), gapless(spark, sf_dir, _COMPLETE), _COMPLETE)


@query(
    _LINKED
    + """select a as query_id, b as ref_id, round(case when n < 0.7 * ql or n < 0.7 * rl then 1.0 else greatest(0, 1 - greatest(tq, tr)) end, 6) as greater, round(case when n < 0.7 * ql and n < 0.7 * rl then 1.0 else 1 - tr end, 6) as refn,
  round(case when n < 0.7 * ql or n < 0.7 * rl then 1.0 else 1 - tq end, 6) as query, round(case when n < 0.7 * ql or n < 0.7 * rl then 1.0 else 1 - 2 * tq * tr / (tq + tr) end, 6) as harmonic, round(case when n < 0.7 * ql or n < 0.7 * rl then 100.0 else rmsd end, 6) as rmsd from e"""
)
def cluster_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distance of each pair under every measure; what is aligned too little is far."""
    of = lambda measure, **more: ClusterOptions(threshold=0.2, measure=measure, **more)
    measures = {"greater": of("tm_greater"), "refn": of("tm_refn", one_sided=True), "query": of("tm_query"), "harmonic": of("tm_harmonic"), "rmsd": of("rmsd")}
    return P.gapless_distances(structures(spark, sf_dir), 0.7, measures)


_SEARCH_D0 = "((case when {n} > 19 then 1.24 * cbrt({n} - 15) - 1.8 else 0.168 end) + 0.8)"


@query(POSITIONS_SQL + f""", t as (select q.sid as q_id, r.sid as r_id, sum(1 / (1 + {_D2} / power({_SEARCH_D0.format(n="least(q.len, r.len)")}, 2))) as score, least(any_value(q.len), any_value(r.len)) as n
  from pos q join pos r on q.mol = r.mol and q.i = r.i where {_SET} group by q.sid, r.sid) select q_id, r_id, round(score, 6) as score from t where score >= 0.1 * n""")
def score_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that the screen by provisional score lets through."""
    q, s = _searched(structures(spark, sf_dir))
    return scored(P.total_scores(q, s, 0.1), 0.1).select("q_id", "r_id", F.round("score", 6).alias("score"))


@query(POSITIONS_SQL + ", one as (select sid as struct_id, max(len) as length, sid // 50 as chunk from pos group by sid) select struct_id, length, chunk, cast(row_number() over (partition by chunk order by length desc, struct_id) as int) as place from one")
def length_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures of each chunk of 50, the longest first."""
    one = positions(spark, sf_dir).where("i = 1").select(F.col("sid").alias("struct_id"), F.col("len").alias("length"), F.floor(F.col("sid") / 50).alias("chunk"))
    return longest_first(one, "chunk")


@query(POSITIONS_SQL + ", s as (select sid, string_agg(res, '' order by i) as seq from pos group by sid) select sid, cast(k as int) as line_no, substr(seq, cast(k * 40 + 1 as int), 40) as line from s, range(0, 3) t(k) where k * 40 < length(seq)")
def wrapped_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structures(spark, sf_dir).select(F.col("struct_id").alias("sid"), F.posexplode(wrapped(F.col("seq"), 40)).alias("line_no", "line"))


@query(
    """u as (select page_id, regexp_replace(coalesce(url, ''), '[?#].*$', '') as path from pages)
select page_id, regexp_extract(path, '[^/]*$') as name, case when regexp_matches(lower(path), '\\.(cif|mmcif)(\\.gz)?$') then 'cif' when regexp_matches(lower(path), '\\.(tar(\\.gz)?|tgz)$') then 'tar' else 'pdb' end as format, ends_with(path, '.html') as has_suffix,
  cast(length(path) - length(replace(path, '/', '')) as int) as depth from u"""
)
def input_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, formats by extension, suffix test and depth of paths."""
    from pyspark.sql.functions import pandas_udf

    from ..sources.parse import file_format, is_tar

    @pandas_udf("string")
    def kind(path: pd.Series) -> pd.Series:
        return path.map(lambda p: "tar" if is_tar(p) else file_format(p, ReadOptions()))

    path = F.regexp_replace(F.coalesce("url", F.lit("")), "[?#].*$", "")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", path.alias("path"))
    return p.select("page_id", F.element_at(F.split("path", "/"), -1).alias("name"), kind("path").alias("format"), F.col("path").endswith(".html").alias("has_suffix"), (F.size(F.split("path", "/")) - 1).alias("depth"))


def _queries(s: DataFrame) -> DataFrame:
    return s.where("struct_id % 100 = 0")


def _searched(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query set and all structures, which are derived once, and dealt to as many tasks as the cluster runs; both are read again and again."""
    s = stored(s, "structures")
    return _queries(s), s.repartition(tasks(s.sparkSession), "struct_id")


_OPTIONS = SearchOptions(score_threshold=0.3, pre_score=0.2, second_tm=True).at_speed(13)


@query()
def aligned_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full alignment of the query set against all structures."""
    s = structures(spark, sf_dir)
    return search(_queries(s), s, _OPTIONS)


#: Every stage of the search: the deepest grid, seeds by secondary structure, all branches, the fullest refinement.
_DEEPEST = SearchOptions(score_threshold=0.0, pre_score=0.0, second_tm=True, refinement="full", seed_rule=0).at_speed(0)
_COPY_D0 = lambda n: _D0.format(m="mol", n=n)


@query(
    POSITIONS_SQL
    + f""", one as (select sid, any_value(len) as len, any_value(mol) as mol, string_agg(res, '' order by i) as seq from pos group by sid)
select sid as query_id, 1000000000 + sid as ref_id, len as query_length, len - 10 as ref_length, len - 10 as n_aligned, len - 10 as n_identities, len - 10 as n_matched, 10 as n_gaps, 1 as query_from, len as query_to, 1 as refn_from,
  len - 10 as refn_to, 1.0::double as tmscore_refn, round((len - 10) / len, 4) as tmscore_query, 0.0::double as rmsd, round({_COPY_D0("len")}, 6) as d0_query, round({_COPY_D0("(len - 10)")}, 6) as d0_refn, seq as query_aln,
  substr(seq, 1, len // 2) || '----------' || substr(seq, len // 2 + 11) as refn_aln, '0.3600,0.4800,-0.8000,-0.8000,0.6000,0.0000,0.4800,0.6400,0.6000' as rotation, '1.0000,2.0000,-3.0000' as translation from one"""
)
def aligned_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure aligned with a moved copy of itself that lacks ten residues, by all stages of the search.

    What must come out is known: each residue on itself, one gap of ten, and the transform that was applied.
    """
    s = structures(spark, sf_dir)
    h = copied_hits(s, copies(s), _DEEPEST)
    r = lambda c, n: F.round(c, n).alias(c)
    flat = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.4f", F.round(v, 4) + 0.0)), ",").alias(c)
    keep = ("query_id", "ref_id", "query_length", "ref_length", "n_aligned", "n_identities", "n_matched", "n_gaps", "query_from", "query_to", "refn_from", "refn_to", "query_aln", "refn_aln")
    return h.select(*keep, r("tmscore_refn", 4), r("tmscore_query", 4), r("rmsd", 4), r("d0_query", 6), r("d0_refn", 6), flat("rotation"), flat("translation"))


@query(POSITIONS_SQL + "select distinct sid as query_id, 0 as wrong_scores, 0 as wrong_rmsd, 0 as wrong_counts, 1.0::double as own_score, len as own_aligned from pos where sid % 100 = 0")
def alignment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reported alignments of the query set, worked out again from their drawings and transforms alone.

    For each query the number of hits whose scores, RMSD or counts differ from what positions, drawn
    rows, rotation and translation give; and the score and size of its alignment with itself.
    """
    s = structures(spark, sf_dir)
    h = stored(search(_queries(s), s, _OPTIONS), "checked_hits")  # read several times
    return recomputed(h, s)


#: Long chains, by all kinds of seeds: the trigger and seeds from local alignments of secondary structures, two sections.
_LONG = SearchOptions(score_threshold=0.0, pre_score=0.0, second_tm=True, depth="high", trigger=50, seed_rule=64, search_by_ss=True, referenced=True, symmetric=True, refinement="few")
_LONG_SQL = POSITIONS_SQL + f", long as (select case when mol = 'NA' then {LONG_NUCLEIC} + sid // 25 else sid // 5 end as id, any_value(mol) as mol, cast(count(*) as int) as len from pos group by 1) "


@query(_LONG_SQL + "select id as query_id, 0 as wrong_scores, 0 as wrong_rmsd, 0 as wrong_counts, 1.0::double as own_score, len as own_aligned from long where id % 100 = 0")
def long_alignment_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``alignment_checks`` for chains above 150 positions, with transforms that move the reference."""
    s = stored(long_structures(spark, sf_dir), "long")
    return recomputed(stored(search(_queries(s), s, _LONG, tasks(spark)), "long_hits"), s)


@query(_LONG_SQL + "select q.id as query_id, count(*) as hits, 0 as different from long q join long r on q.mol = r.mol where q.id % 100 = 0 group by q.id")
def symmetric_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the query set with long chains, and those that differ if query and reference are swapped: none, by the option ``symmetric``."""
    s = stored(long_structures(spark, sf_dir), "long")
    options = replace(_LONG, depth="medium", referenced=False, search_by_ss=False)
    return turned_around(search(_queries(s), s, options, tasks(spark)), aligned(s, _queries(s), options, tasks=tasks(spark)))


@query()
def alignment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain report of the same search as rows of text."""
    s = structures(spark, sf_dir)
    hits = stored(reports.described(aligned_hits(spark, sf_dir).drop("rank"), s), "hits")  # a report reads its hits several times
    return reports.plain_lines(hits, n_hits=_OPTIONS.hits, n_alignments=_OPTIONS.alignments, queries=_queries(s), searched=reports.Searched.of(s, ("embeddings",), threshold=_OPTIONS.score_threshold, screened=True))


@query(
    POSITIONS_SQL
    + """, one as (select sid, any_value(len) as len, any_value(mol) as mol from pos group by sid), total as (select count(*) as n, sum(len - 10) as residues from one),
heads as (select sid, unnest(['strandlake 2', '', printf(' Query (%d residues):', len), 'chain' || sid, '', ' Searched:', 'copies', '             ' || n || ' structure(s)', '             ' || residues || ' total residues']) as line,
  unnest(range(0, 9)) as line_no from one, total)
select sid as query_id, 0 as section, 0 as rank, cast(line_no as int) as line_no, line from heads
union all select sid, 1, 1, 0, printf('%6d %-38s %6.4f %6.4f %5.2f %5d %9s %9s %8d', 1, 'copy' || sid, 1.0::double, (len - 10) / len, 0.0::double, len - 10, '1-' || len, '1-' || (len - 10), len - 10) from one
union all select sid, 3, 0, k, case k when 0 then '' when 1 then 'Query length: ' || len when 2 then 'Total length of reference structures: ' || residues else 'Search space: ' || (len * residues) end from one, total, unnest([0, 1, 2, 3]) t(k)"""
)
def report_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Head, hit table and summary of the plain reports of all structures against their copies."""
    s = structures(spark, sf_dir)
    c = copies(s)
    named = s.select("struct_id", "description").unionByName(c.select("struct_id", "description"))
    hits = reports.described(stored(copied_hits(s, c, SearchOptions(score_threshold=0.0, pre_score=0.0).at_speed(13)), "hits"), named)
    lines = reports.plain_lines(hits, queries=s, searched=reports.Searched.of(c, ("copies",)))
    return lines.where("section in (1, 3) or section = 0 and line_no < 9").select("query_id", "section", "rank", "line_no", "line")


@query(
    POSITIONS_SQL
    + """, one as (select sid, any_value(len) as len from pos group by sid), total as (select count(*) as n, sum(len - 10) as residues from one),
lines as (
  select sid, 0 as section, unnest(['{"strandlake_search": {"program": "strandlake", "version": "2",', '"query": {"length": ' || len || ', "description": "chain' || sid || '"},',
    '"database": {"entries": ["copies"], "number_of_structures": ' || n || ', "number_of_positions": ' || residues || '},', '"message": "",', '"search_summary": [']) as line, unnest(range(0, 5)) as line_no from one, total
  union all select sid, 2, unnest(['],', '"search_results": [']), unnest(range(0, 2)) from one
  union all select sid, 4, unnest(['],', '"search_statistics": {"query_length": ' || len || ', "total_database_length": ' || residues || ', "search_space": ' || (len * residues) || '}}}']), unnest(range(0, 2)) from one, total)
select sid as query_id, section, cast(line_no as int) as line_no, line from lines"""
)
def json_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around the hits of the JSON reports of all structures against their copies."""
    s = structures(spark, sf_dir)
    c = copies(s)
    hits = stored(copied_hits(s, c, SearchOptions(score_threshold=0.0, pre_score=0.0).at_speed(13)), "hits").withColumn("query_description", F.concat(F.lit("chain"), F.col("query_id").cast("string")))
    lines = reports.json_report(hits, queries=s, searched=reports.Searched.of(c, ("copies",)))
    return lines.where("section in (0, 2, 4)").select("query_id", "section", "line_no", "line")


@query(POSITIONS_SQL + "select sid, any_value(mol) as mol_type, cast(count(*) as int) as length, string_agg(res, '' order by i) as seq, round(sum(x), 3) as x, round(sum(y), 3) as y, round(sum(z), 3) as z, case when sid % 2 = 0 then 'cif' else 'pdb' end as kind from pos group by sid")
def structure_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every structure written as a file, PDB lines or a compressed mmCIF loop, and read again with the reader of files."""
    root = files.write_structures(structures(spark, sf_dir))
    back = files.read_structures(spark, f"{root}/pdb,{root}/pdb", least=3).unionByName(files.read_structures(spark, f"{root}/cif", ReadOptions(infmt="cif"), least=3))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda t, v: t + v), 3).alias(c)
    return back.select(F.regexp_extract("source_path", r"sid=(\d+)", 1).cast("long").alias("sid"), "mol_type", "length", "seq", total("x"), total("y"), total("z"), F.regexp_extract("source_path", r"/(pdb|cif)/sid=", 1).alias("kind"))


def _packed(sid: pd.Series, text: pd.Series) -> pd.Series:
    """Bytes of a file: compressed, in a tar beside a member too small to count, plain, or with a broken line."""
    import gzip
    import io
    import tarfile

    def one(k: int, t: str) -> bytes:
        if k % 4 == 0:
            return gzip.compress(t.encode())
        if k % 4 == 1:
            out = io.BytesIO()
            with tarfile.open(fileobj=out, mode="w") as tar:
                for name, data in ((f"m/{k}.pdb", t.encode()), ("tiny.pdb", b"x")):
                    info = tarfile.TarInfo(name)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
            return out.getvalue()
        return t.replace("ATOM      2  ", "ATOM      2  CA  ALA A   x").encode() if k % 4 == 3 else t.encode()

    return pd.Series([one(k, t) for k, t in zip(sid, text)])


@query(POSITIONS_SQL + """select sid, case when sid % 4 = 1 then 'm/' || sid || '.pdb' else '' end as member, case when sid % 4 <> 3 then any_value(mol) end as mol_type, case when sid % 4 <> 3 then cast(count(*) as int) end as length,
  case when sid % 4 <> 3 then string_agg(res, '' order by i) end as seq, sid % 4 = 3 as failed from pos group by sid""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structures parsed from files of all containers; a file with a broken line is a row with its error."""
    lines = files.file_lines(structures(spark, sf_dir)).groupBy(F.col("struct_id").alias("sid"), "kind").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("v"))  # at most 90 lines
    text = lines.select("sid", "kind", F.concat_ws("\n", F.col("v")["value"]).alias("text"))
    k = F.col("sid") % 4
    name = F.concat(F.lit("/in/"), F.col("sid").cast("string"), F.when(k == 1, ".tar").when(k == 0, F.concat(F.lit("."), "kind", F.lit(".gz"))).otherwise(F.concat(F.lit("."), "kind")))
    parsed = files.parse_files(text.select(name.alias("path"), F.pandas_udf(_packed, "binary")("sid", "text").alias("content")))
    return parsed.select(F.regexp_extract("source_path", r"/in/(\d+)", 1).cast("long").alias("sid"), "member", "mol_type", "length", "seq", F.col("error").isNotNull().alias("failed"))


@query(_local_sql(kernels.EDGE, kernels.STEP) + "select q.sid as q_id, r.sid as r_id, q.len as q_len, r.len as r_len" + _BEST_SQL + " and greatest(0, coalesce(v, 0)) >= 10 and least(q.len, r.len) >= 40")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the query set and all that type, length limits and the sequence pre-screen let through."""
    s = structures(spark, sf_dir)
    return candidate_pairs(_queries(s), s, SearchOptions(pre_similarity=10.0, min_length=40), sequences=False).select("q_id", "r_id", "q_len", "r_len")


@query()
def complete_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete-linkage clusters of all chains, with representatives and sizes."""
    s = structures(spark, sf_dir)
    return cluster_rows(cluster(s, ClusterOptions(threshold=0.3), SearchOptions(pre_score=0.1).at_speed(13)))


@query()
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON report of the same search, as lines that are one document a query."""
    s = structures(spark, sf_dir)
    hits = stored(reports.described(aligned_hits(spark, sf_dir).drop("rank"), s), "hits")
    return reports.json_report(hits, queries=_queries(s), searched=reports.Searched.of(s, ("embeddings",), threshold=_OPTIONS.score_threshold, screened=True), which="tm_harmonic", limit=_OPTIONS.hits, second=True)


@query()
def cluster_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of all chains by single-linkage cluster, the representative first."""
    s = structures(spark, sf_dir)
    return reports.cluster_sequences(cluster(s, ClusterOptions(threshold=0.3, linkage="single"), SearchOptions(pre_score=0.1).at_speed(13)), s)
