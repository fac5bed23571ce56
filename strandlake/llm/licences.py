"""Licence scan: Dice coefficient over word bigrams against licence templates, in SQL functions only.

The units of a text are the whole of it, its paragraphs (cut at blank lines), its lines, and the sentences of
paragraphs and of lines; so a notice is met whether it is wrapped or not, and a licence file as a whole.
A unit is normalised to lower-case words of ASCII letters and digits, and equal units of a text count once.
Its distinct bigrams are compared with those of each template: one-sentence notices, whole licence texts and their paragraphs.

Dice at least ``LEAST`` needs sizes within a factor of LEAST / (2 - LEAST), so the number of a unit's
distinct bigrams selects its candidate templates before any comparison.  It also needs
LEAST / (2 - LEAST) of a template's bigrams, so a unit that matches holds one of any set of more than the
rest.  ``clues`` takes the least ordinary ones of every template; texts and units without a clue are
not taken apart, and no match is lost.

Everything is an expression over one row: no shuffle, no Python on executors, no explosion of
rows.  The templates are a literal of fixed size.

Defined results: null and empty texts match nothing; units of fewer than two words have no
bigrams; repeated rows are judged each; an empty table gives an empty result; only the named columns
are read, and ``find_licences`` replaces a column that bears the name of its result.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licence_texts import NOTICES, TEXTS

LEAST = 0.8

#: Ordinary words, which make poor clues (fixed values).
_PLAIN = frozenset("""a above accompanying act action advised all an and any anyone appear application applications appreciated are arising as at author
authors be being benefit binary but by can cause charge claim code commercial condition conditions connection contract copies copy damages data deal
derived details detriment direct distributed do documentation domain event executable express file files fitness following for form free freely from
grant granted have heirs held holder holders hope hope if implied in included including interest international is it its kind language law laws later
limited line list loss made marked materials may means met modified modify more must name names not object obtain obtaining of on one option or
organization origin original other our out part particular person persons plainly portions possibility present product products program provided public
purpose released required requirements restriction restrictions right rights see sell shall should so software source special specific statement
subject such term terms that the third this to tort under use used useful user version versions was we whether who whole whom will with without work
works would write written you your""".split())

#: Paragraphs of whole texts that are templates of their own, by their first words; others are met as part of the whole.
_APART = ("permission", "redistribution", "redistributions", "the software", "this software", "licensed under", "this program", "this source", "unless")


@lru_cache(maxsize=1)
def templates() -> tuple[tuple[str, tuple[str, ...]], ...]:
    """(licence, sorted distinct bigrams), the notices first, then whole texts and their paragraphs; each set of bigrams once."""
    out: dict[tuple[str, ...], str] = {}
    texts = [(name, t) for name, own in NOTICES.items() for t in own]
    texts += [(name, t) for name, whole in TEXTS.items() for t in (whole, *(p for p in whole.split("\n\n") if p.lower().startswith(_APART)))]
    for name, t in texts:
        w = re.findall("[a-z0-9]+", t.lower())
        grams = tuple(sorted({f"{a} {b}" for a, b in zip(w, w[1:])}))
        if len(grams) >= 2:
            out.setdefault(grams, name)
    return tuple((name, grams) for grams, name in out.items())


def _bounds(n: int) -> tuple[int, int]:
    """Numbers of bigrams that can reach LEAST against n."""
    ok = [k for k in range(1, 8 * n + 8) if 2 * min(k, n) >= LEAST * (k + n)]
    return ok[0], ok[-1]


@lru_cache(maxsize=1)
def clues() -> tuple[str, ...]:
    """Bigrams of which every unit that matches any template holds one.

    A unit that reaches LEAST against n bigrams shares at least n * LEAST / (2 - LEAST) of them, so it
    cannot miss all of any set of more than the others: the ones with the fewest ordinary words.
    """
    chosen: set[str] = set()
    for _, grams in templates():
        most_missed = int(len(grams) * (1 - LEAST / (2 - LEAST)) + 1e-9)
        chosen |= set(sorted(grams, key=lambda g: (g not in chosen, sum(w in _PLAIN or len(w) < 3 for w in g.split()), g))[: most_missed + 1])
    return tuple(sorted(chosen))


def _tree(words: dict[str, str]) -> str:
    """A pattern for any of the words, each followed by its own tail, that looks at a letter once."""
    own, by = [], {}
    for w, tail in words.items():
        if w:
            by.setdefault(w[0], {})[w[1:]] = tail
        else:
            own.append(tail)
    parts = [c + _tree(rest) for c, rest in sorted(by.items())] + own
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def clue_pattern() -> str:
    """Matches lower-cased raw text that holds a clue; its words may be any other characters apart."""
    second: dict[str, dict[str, str]] = {}
    for gram in clues():
        a, b = gram.split()
        second.setdefault(a, {})[b] = "(?![a-z0-9])"
    return "(?<![a-z0-9])" + _tree({a: "[^a-z0-9]++" + _tree(bs) for a, bs in second.items()})


def matches(text: Column) -> Column:
    """An array of (dice, name), one for each unit that matches: its best template, the first of equals."""
    rows = [(name, b, *_bounds(len(b))) for name, b in templates()]
    lo, hi = min(r[2] for r in rows), max(r[3] for r in rows)
    bank = F.array(*[F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, b)).alias("b"), F.lit(x).alias("lo"), F.lit(y).alias("hi")) for name, b, x, y in rows])
    low = F.lower(F.coalesce(text, F.lit("")))
    clue = clue_pattern()
    hinted = low.rlike(clue)

    pieces = lambda parts, space: F.flatten(F.transform(parts, lambda p: F.split(p, f"(?<=[.!?]){space}+")))
    paragraphs, lines = F.split(low, "\n[ \t\r]*\n"), F.split(low, "\n")
    raw = F.filter(F.array_distinct(F.concat(F.array(low), paragraphs, lines, pieces(paragraphs, "[ \t\r\n]"), pieces(lines, "[ \t\r]"))), lambda u: u.rlike(clue))
    units = F.transform(F.array_distinct(F.transform(raw, lambda u: F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")))), lambda u: F.split(u, " "))

    def may_fit(words: Column) -> Column:
        # Each further distinct word ends a new bigram, so more than hi + 1 of them make more than hi bigrams.
        return (F.size(words) > lo) & ((F.size(words) <= hi) | (F.size(F.array_distinct(words)) <= hi + 1))

    def bigrams(words: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(words, 2, F.size(words) - 1), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))

    grams = F.filter(F.transform(F.filter(units, may_fit), bigrams), lambda b: F.size(b).between(lo, hi))

    def best(b: Column) -> Column:
        near = F.filter(bank, lambda t: F.size(b).between(t["lo"], t["hi"]))
        scored = F.transform(near, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(b, t["b"])) / (F.size(b) + F.size(t["b"]))).alias("dice"), t["name"].alias("name")))
        return F.aggregate(scored, F.struct(F.lit(0.0).alias("dice"), F.lit("").alias("name")), lambda x, y: F.when(y["dice"] > x["dice"], y).otherwise(x))

    found = F.filter(F.transform(grams, best), lambda m: m["dice"] >= LEAST)
    return F.when(hinted, found).otherwise(F.array().cast("array<struct<dice:double,name:string>>"))


def find_licences(docs: DataFrame, text: str = "text", out: str = "licences") -> DataFrame:
    """``docs`` with ``out``: an array of (dice, name), one for each unit that matches."""
    return docs.withColumn(out, matches(F.col(text)))


def op5_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), out="m").drop("text")
    names = F.array_join(F.array_sort(F.array_distinct(F.col("m")["name"])), ",")
    return found.select("doc_id", F.size("m").cast("long").alias("n_matches"), names.alias("licences"), F.round(F.coalesce(F.array_max(F.col("m")["dice"]), F.lit(0.0)), 6).alias("best_dice"))


def oracle() -> str:
    """All units of all texts against all templates whose sizes allow a match, without clues."""
    bank = ",\n".join(f"({i}, '{name}', ['" + "', '".join(b) + "'])" for i, (name, b) in enumerate(templates()))
    return rf"""
with bank(k, name, b) as (values {bank}),
docs as (select row_number() over () as r, doc_id, lower(coalesce(text, '')) as t from documents),
paragraphs as (select r, unnest(string_split_regex(t, '\n[ \t\r]*\n')) as p from docs),
lines as (select r, unnest(string_split(t, chr(10))) as line from docs),
units as (
  select r, t as unit from docs union all select r, p from paragraphs union all select r, line from lines
  union all select r, unnest(string_split(regexp_replace(replace(p, chr(10), ' '), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) from paragraphs
  union all select r, unnest(string_split(regexp_replace(line, '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10))) from lines),
plain as (select distinct r, trim(regexp_replace(unit, '[^a-z0-9]+', ' ', 'g')) as unit from units),
cut as (select row_number() over () as u, r, string_split(unit, ' ') as w from plain),
grams as (select u, r, list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as g from cut where len(w) > 1),
scored as (select u, r, name, k, 2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) as dice from grams, bank
  where 2 * least(len(g), len(b)) >= {LEAST} * (len(g) + len(b))),
best as (select u, r, max(dice) as dice, min_by(name, (-dice, k)) as name from scored where dice >= {LEAST} group by u, r),
found as (select r, count(*) as n_matches, string_agg(distinct name, ',' order by name) as licences, max(dice) as best_dice from best group by r)
select doc_id, coalesce(n_matches, 0) as n_matches, coalesce(licences, '') as licences, round(coalesce(best_dice, 0.0), 6) as best_dice
from docs left join found using (r)
"""


def brute_force(text: str | None) -> tuple[int, str, float]:
    """Straight from the definition, for tests: (n_matches, licences, best_dice)."""
    low = (text or "").lower()
    paragraphs, lines = re.split(r"\n[ \t\r]*\n", low), low.split("\n")
    units = [low, *paragraphs, *lines, *(s for p in paragraphs for s in re.split(r"(?<=[.!?])[ \t\r\n]+", p)), *(s for x in lines for s in re.split(r"(?<=[.!?])[ \t\r]+", x))]
    found = []
    for w in {tuple(re.findall("[a-z0-9]+", u)) for u in units}:
        g = {f"{a} {b}" for a, b in zip(w, w[1:])}
        best = max(((2 * len(g & set(b)) / (len(g) + len(b)), -i, n) for i, (n, b) in enumerate(templates())), default=(0, 0, "")) if g else (0, 0, "")
        if best[0] >= LEAST:
            found.append(best)
    return len(found), ",".join(sorted({n for *_, n in found})), round(max((d for d, *_ in found), default=0.0), 6)
