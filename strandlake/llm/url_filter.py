"""URL filters that follow redirects and canonical links.

An address is a node (host, path).  ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``
of a page are edges from its address to the one they name, and so are rows of an edge table.
Connected components over these edges are sets of aliases.  An address with a rule of its own
obeys that rule; another takes the decision of its aliases: allow if any of them is explicitly
allowed, else block if any is blocked, else allow.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
is no alias of anything, so it is allowed; null html has no edges; repeated rows are judged each;
rules of equal length that fit are settled for allow, then by name; an empty table gives an empty
result; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, join_hot, table

#: Parameter: the rules of the query, as (action, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))

#: Rules that are written into the expression; it is a parameter list, so it has a fixed size.
MOST_RULES = 256
#: Decisions that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, action); null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1:])):  # the last to fit decides
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, with the references that urls hold decoded; empty if there is none."""
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    value = F.trim(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)]))
    for reference, char in (("&(?:quot|#34|#x22);", '"'), ("&(?:apos|#39|#x27);", "'"), ("&(?:lt|#60|#x3c);", "<"), ("&(?:gt|#62|#x3e);", ">"), ("&(?:amp|#38|#x26);", "&")):
        value = F.regexp_replace(value, f"(?i){reference}", char)
    return value


def resolved(df: DataFrame, base: str, target: str) -> DataFrame:
    """Replaces the column ``target`` by the address that it means on a page at the column ``base``.

    Mail addresses, scripts and the like become null.  Each step is a projection of its own, so that
    what one step uses several times is worked out once.
    """
    t = F.col(target)
    df = df.withColumn("__host", host(F.col(base))).withColumn("__path", path(F.col(base)))
    here = F.concat(F.lit("x://"), "__host")
    folder = F.coalesce(F.nullif(F.regexp_extract("__path", "(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    full = (
        F.when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), t).when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(t.startswith("//"), F.concat(F.lit("x:"), t)).when(t.startswith("/"), F.concat(here, t))
        .when(t.rlike("^(?:[?#]|$)"), F.concat(here, "__path")).otherwise(F.concat(here, folder, t))
    )
    df = df.withColumn(target, full).withColumn("__host", host(t)).withColumn("__path", path(t))
    step = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s)))
    df = df.withColumn("__names", F.when(F.col("__path").rlike(r"(?:^|/)\.\.?(?:/|$)"), F.split(F.regexp_replace("__path", "^/", ""), "/")))
    df = df.withColumn("__kept", F.aggregate("__names", F.array().cast("array<string>"), step))
    ends = F.when((F.size("__kept") > 0) & F.element_at("__names", -1).isin(".", ".."), "/").otherwise("")
    plain = F.concat(F.lit("x://"), "__host", F.lit("/"), F.array_join("__kept", "/"), ends)
    return df.withColumn(target, F.when(F.col("__names").isNotNull(), plain).otherwise(t)).drop("__host", "__path", "__names", "__kept")


def html_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (host, path) to (to_host, to_path) that pages state; most pages state none.

    Comments, scripts and styles state nothing; targets are resolved against the page's first
    ``<base href>``, if it has one, and its address.
    """
    lower = F.lower(F.col(html))
    some = pages.where(lower.contains("canonical") | lower.contains("refresh")).select(F.col(url).alias("url"), F.col(html).alias("html"))
    bare = F.regexp_replace("html", r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\b[^>]*>|\z)|<style\b.*?(?:</style\b[^>]*>|\z)", " ")
    tags = some.select("url", F.regexp_extract_all(bare, F.lit(r"(?is)(<(?:link|meta|base)\b[^>]*>)"), F.lit(1)).alias("tags"))
    bases = F.filter(F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: attribute(t, "href")), lambda v: v != "")
    tags = resolved(tags.withColumn("base", F.coalesce(F.get(bases, F.lit(0)), F.lit(""))), "url", "base").select("url", F.coalesce("base", "url").alias("base"), F.explode("tags").alias("tag"))
    tags = tags.withColumn("link", F.col("tag").rlike("(?i)^<link")).withColumn("kind", F.lower(attribute(F.col("tag"), "rel"))).withColumn("equiv", F.lower(attribute(F.col("tag"), "http-equiv")))
    tags = tags.withColumn("said", F.when(F.col("link") & F.col("kind").rlike(r"(?:^|\s)canonical(?:\s|$)"), attribute(F.col("tag"), "href")).when(~F.col("link") & (F.col("equiv") == "refresh"), F.regexp_extract(attribute(F.col("tag"), "content"), r"""(?is)\burl\s*=\s*['"]?([^"'\s]+)""", 1)))
    found = resolved(tags.where("said <> ''").select("url", "base", F.col("said").alias("to")), "base", "to")
    return found.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), host(F.col("to")).alias("to_host"), path(F.col("to")).alias("to_path"))


def judge_urls(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, url: str = "url", html: str | None = "html") -> DataFrame:
    """``pages`` without ``html`` but with host, path, rule and verdict, which replace columns of these names.

    ``edges`` (host, path, to_host, to_path) are redirects known from elsewhere.  Only addresses
    with an edge take part in the components; all other rows are judged where they are read.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", html)]
    parts = [html_edges(pages, url, html)] if html else []
    parts += [edges.select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", F.translate("to_host", _UPPER, _LOWER).alias("to_host"), "to_path")] if edges is not None else []
    node = lambda h, p: F.concat(F.col(h), F.lit("\x00"), F.col(p))
    # The caller's columns travel in a struct, so no name of theirs can clash.
    out = pages.select(F.struct(*keep).alias("row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    out = out.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("alias", F.lit(None).cast("boolean"))
    if parts:
        links = parts[0]
        for p in parts[1:]:
            links = links.unionByName(p)
        links = cut(links.where("host <> '' and to_host <> ''").select(node("host", "path").alias("a"), node("to_host", "to_path").alias("b")).where("a <> b").distinct())
        if not links.isEmpty():
            comp = components(links)
            split = F.split("id", "\x00", 2)
            named = comp.withColumn("action", rule_of(split[0], split[1], rules)["action"])
            decided = named.groupBy("component").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"), F.count("*").alias("n"))
            decided = cut(decided.where("blocked and not coalesce(allowed, false)").select("component", "n"))
            blocked = cut(join_hot(comp, decided, "component").select(F.col("id").alias("node"), F.lit(True).alias("alias")))
            small = blocked.count() <= BROADCAST_ROWS
            out = out.drop("alias").withColumn("node", node("host", "path")).join(F.broadcast(blocked) if small else blocked, "node", "left")
    verdict = F.coalesce(F.col("own")["action"], F.when(F.col("alias"), F.lit("block")), F.lit("allow"))
    return out.select("row.*", "host", "path", F.col("own")["rule"].alias("rule"), verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts under a redirect table, as a crawl's log would give it.

    The pages of the test tables state no links of their own, so the table is derived from them: every
    page but each fourth redirects to the page that follows it by id.  Here aliases decide.
    """
    pages = table(spark, sf_dir, "pages").where("url is not null and page_id is not null")
    here = pages.where("page_id % 4 <> 3").select((F.col("page_id") + 1).alias("to"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    there = pages.select(F.col("page_id").alias("to"), host(F.col("url")).alias("to_host"), path(F.col("url")).alias("to_path"))
    return judge_urls(table(spark, sf_dir, "pages"), here.join(there, "to").drop("to")).select("page_id", "host", "path", "rule", "verdict")


def _rule_sql(rules=RULES) -> str:
    rows = ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in rules)
    return f"rules(action, h, p) as (values {rows})"


#: Links that pages state themselves; targets that start with a scheme, // or /, as SQL; others are tested on small pages.
_HTML_LINKS = r"""
stated as (
  select url, unnest(regexp_extract_all(html, '(?is)(<(?:link|meta)\b[^>]*>)', 1)) as tag from pages
  where contains(lower(html), 'canonical') or contains(lower(html), 'refresh')),
aims as (
  select url, case when regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') then regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    when regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') then regexp_extract(tag, '(?is)\burl\s*=\s*[''"]?([^"''\s>]+)', 1) end as aim from stated),
urls as (
  select url as src, case when starts_with(aim, '//') then 'x:' || aim
    when starts_with(aim, '/') then 'x://' || regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) || aim else aim end as aim
  from aims where aim <> ''),
links as (
  select distinct translate(regexp_extract(src, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h1, regexp_extract(src, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as p1,
    translate(regexp_extract(aim, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h2, regexp_extract(aim, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as p2
  from urls),
"""

#: The derived redirect table of ``url_aliases``.
_CHAIN_LINKS = r"""
cut as (
  select page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as h, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as p
  from pages where url is not null),
links as (select distinct a.h as h1, a.p as p1, b.h as h2, b.p as p2 from cut a join cut b on b.page_id = a.page_id + 1 where a.page_id % 4 <> 3),
"""


def oracle(links: str) -> str:
    return f"with recursive {_rule_sql()},{links}{_JUDGED}"


_JUDGED = r"""
twoway as (select h1, p1, h2, p2 from links where h1 <> '' and h2 <> '' union select h2, p2, h1, p1 from links where h1 <> '' and h2 <> ''),
reach as (select distinct h1, p1, h1 as h2, p1 as p2 from twoway union select r.h1, r.p1, b.h2, b.p2 from reach r join twoway b on r.h2 = b.h1 and r.p2 = b.p1),
found as (
  select r.h1, r.p1, r.h2, r.p2, (select max_by(action, length(h || p)) from rules where (r.h2 = h or ends_with(r.h2, '.' || h)) and starts_with(r.p2, p)) as action from reach r),
alias as (select h1, p1, case when bool_or(action = 'allow') then 'allow' when bool_or(action = 'block') then 'block' end as action from found group by h1, p1),
pages2 as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
judged as (
  select p.page_id, p.host, p.path,
    (select max_by(struct_pack(rule := r.h || r.p, action := r.action), length(r.h || r.p)) from rules r where (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.p)) as own
  from pages2 p)
select j.page_id, j.host, j.path, j.own.rule as rule, coalesce(j.own.action, a.action, 'allow') as verdict
from judged j left join alias a on j.host = a.h1 and j.path = a.p1
"""

ORACLE, ALIASES = oracle(_HTML_LINKS), oracle(_CHAIN_LINKS)
