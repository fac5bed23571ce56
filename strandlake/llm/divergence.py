"""How far the sources of a language differ in their words, from counts that are kept sparse.

1. Each task counts the terms of its documents, per group of language and source; the sums of all
   tasks meet by (language, term), where terms of too few documents are dropped.  What is left are
   the postings: one row per group and kept term that occurs in it.
2. The distance of two groups is the sum of abs(p - q) over all V kept terms of their language.
   Most terms are missing from one of them or from both, so it is taken by inclusion and exclusion:
   a group's histogram of counts prices all its terms as if the other had none; (V - terms of the
   one - terms of the other) times the distance of two zero counts stands for the rest; and a join of
   the postings of one term corrects the terms that both groups have.
3. The terms that a group has more of than its language are ranked, 50 a group.

Shares are p = 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)), in whole numbers throughout.

Defined results: null text, language and source read as empty strings; rows that repeat an id are documents of
their own; a group without terms takes part with counts of zero; a language without kept terms has distances
of 0 and no terms; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, stored, table

#: A term is kept if at least so many documents of its language hold it.
LEAST_DOCUMENTS = 30
SCALE = 1_000_000_000
SMOOTH = 5
#: Ranks of terms that are listed for a group.
TOP_TERMS = 50
#: Partial counts that a task holds before it hands them on.
HELD_TERMS = 300_000
#: Tasks at least that the pairs of one language are dealt to.
SALTS = 32

#: Bytes with A-Z lower-cased and every other ASCII byte that is no letter turned into a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def partial_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n and docs: what a part of a task's documents adds to the counts; no shuffle."""
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def run(batches):
        said: dict[tuple, Counter] = {}
        held: dict[tuple, Counter] = {}

        def flush():
            for (a, b), counts in said.items():
                names = list(counts)
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(a, pa.string()), len(names)), pa.repeat(pa.scalar(b, pa.string()), len(names)), pa.array([t.decode() for t in names], pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([held[a, b][t] for t in names], pa.int64())], schema=kinds)
            said.clear()
            held.clear()

        entries = 0
        for batch in batches:
            for a, b, t in zip(*(batch.column(k).to_pylist() for k in range(3))):
                words = t.encode().translate(_LETTERS).split()
                group = (a, b)
                if group not in said:
                    said[group], held[group] = Counter(), Counter()
                before = len(said[group])
                said[group].update(words)
                held[group].update(set(words))
                entries += len(said[group]) - before
                if entries > HELD_TERMS:
                    yield from flush()
                    entries = 0
        yield from flush()

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))))
    return map_arrow(read, run, "lang string, source string, term string, n long, docs long")


def postings(docs: DataFrame, least: int = LEAST_DOCUMENTS, **columns) -> DataFrame:
    """lang, term, source and n of each kept term that a group holds, with the language's count in ``total`` and ``first`` on one row a term."""
    term = Window.partitionBy("lang", "term")
    counts = partial_counts(docs, **columns).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = counts.withColumns({"all_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "first": (F.row_number().over(term.orderBy("source")) == 1).cast("long")})
    return counts.where(F.col("all_docs") >= least).select("lang", "term", "source", "n", "total", "first")


def share(count: str, among: str) -> Column:
    """Share of a count, exact: ``among`` is N + SMOOTH * V."""
    return F.expr(f"1 + (({count}) + {SMOOTH}) * cast({SCALE} as decimal(10,0)) div cast({among} as decimal(20,0))")


def groups(docs: DataFrame, posted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (lang, source): terms, among, zero (the share of a count of 0) and the language's v, lang_among."""
    every = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source")).distinct()
    langs = posted.groupBy("lang").agg(F.sum("first").alias("v"), (F.sum("n") + SMOOTH * F.sum("first")).alias("lang_among"))
    own = posted.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    out = every.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "n", "terms"])
    return out.withColumn("among", F.col("n") + SMOOTH * F.col("v")).withColumn("zero", F.when(F.col("v") > 0, share("0", "among"))).drop("n")


def divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS, **columns) -> DataFrame:
    """lang, source, part, item, value and rank: all other sources by distance (``pair``), and the terms a source leans to (``term``)."""
    named = {k: v for k, v in columns.items() if k in ("lang", "source")}
    posted = stored(postings(docs, least, **columns), "postings")
    group = stored(groups(docs, posted, **named), "groups")
    priced = posted.join(group, ["lang", "source"]).withColumns({"p": share("n", "among"), "q": share("total", "lang_among")})
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    leaning = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = leaning.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    hist = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("hist"))
    told = group.join(hist, ["lang", "source"], "left").select("lang", "source", "v", "terms", "zero", F.coalesce("hist", F.array().cast("array<struct<p:bigint,m:bigint>>")).alias("hist"))
    side = lambda df, k: df.select("lang", *(F.col(c).alias(f"{c}_{k}") for c in df.columns if c != "lang"))
    a = side(told, "a").withColumn("salt", F.pmod(F.xxhash64("source_a"), F.lit(SALTS)))
    b = side(told, "b").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    one_sided = lambda hist, zero: F.aggregate(hist, F.lit(0).cast("long"), lambda s, h: s + F.abs(h["p"] - F.col(zero)) * h["m"])
    apart = F.col("v_a") - F.col("terms_a") - F.col("terms_b")
    value = one_sided("hist_a", "zero_b") + one_sided("hist_b", "zero_a") + apart * F.abs(F.col("zero_a") - F.col("zero_b"))
    bounds = a.join(b, ["lang", "salt"]).where("source_a < source_b").select("lang", "source_a", "source_b", F.coalesce(value, F.lit(0).cast("long")).alias("bound"))

    post = priced.select("lang", "term", "source", "p", "zero")
    both = side(post, "a").withColumnRenamed("term_a", "term").join(side(post, "b").withColumnRenamed("term_b", "term"), ["lang", "term"]).where("source_a < source_b")
    change = F.expr("abs(p_a - p_b) - abs(p_a - zero_b) - abs(zero_a - p_b) + abs(zero_a - zero_b)")
    overlap = both.groupBy("lang", "source_a", "source_b").agg(F.sum(change).alias("change"))

    found = bounds.join(overlap, ["lang", "source_a", "source_b"], "left").withColumn("value", F.col("bound") + F.coalesce("change", F.lit(0).cast("long")))
    ways = F.explode(F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item"))))
    pairs = found.select("lang", "value", ways.alias("way")).select("lang", "way.source", "way.item", "value").withColumn("rank", F.row_number().over(order))

    cols = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
    return cols(pairs, "pair").unionByName(cols(terms, "term"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE = rf"""
with d as (
  select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
said as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as total from said group by lang, term having count(distinct r) >= 30),
langs as (select lang, count(*) as v, sum(total) as n from kept group by lang),
grp as (select distinct lang, source from d),
counted as (select lang, source, term, count(*) as c from said group by lang, source, term),
dense as (
  select g.lang, g.source, k.term, k.total, coalesce(c.c, 0) as c, sum(coalesce(c.c, 0)) over (partition by g.lang, g.source) as n
  from grp g join kept k on g.lang = k.lang left join counted c on c.lang = g.lang and c.source = g.source and c.term = k.term),
priced as (
  select e.lang, source, term, c, 1 + (1000000000::hugeint * (c + 5)) // (e.n + 5 * l.v)::hugeint as p, 1 + (1000000000::hugeint * (total + 5)) // (l.n + 5 * l.v)::hugeint as q
  from dense e join langs l on e.lang = l.lang),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from priced a join priced b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
pair as (select a.lang, a.source, b.source as item, coalesce(f.value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select lang, source, term as item, p - q as value from priced where c > 0 and p > q),
ranked as (
  select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from pair
  union all
  select * from (select lang, source, 'term' as part, item, value, row_number() over (partition by lang, source order by value desc, item) as rank from term) where rank <= 50)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked
"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))
