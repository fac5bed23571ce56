"""SQL that works out the results of operators by definition, for tables of moderate size."""

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

GROUPS = rf"""
with recursive words as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select r, doc_id, case when len(w) = 0 then cast([] as varchar[]) when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s from words),
sized as (select r, doc_id, s, len(s) as n from sets),
classes as (select min(r) as c, any_value(n) as n, list_sort(s) as s from sized where n > 0 group by list_sort(s)),
member as (select z.r, z.doc_id, z.n, c.c from sized z left join classes c on z.n > 0 and list_sort(z.s) = c.s),
one as (select c, n, unnest(s) as x from classes),
common as (select a.c as a, b.c as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from one a join one b on a.x = b.x and a.c < b.c and 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) group by a.c, b.c),
pairs as (select a, b from common where 100 * k >= 75 * (na + nb - k)),
links as (select a, b from pairs union select b, a from pairs),
reach as (select c as a, c as b from classes union select r.a, l.b from reach r join links l on r.b = l.a),
least_id as (select r.a as c, min(m.doc_id) as component_id from reach r join member m on m.c = r.b group by r.a)
select m.doc_id, m.n as n_shingles, coalesce(l.component_id, m.doc_id) as component_id, m.doc_id is not distinct from coalesce(l.component_id, m.doc_id) as kept
from member m left join least_id l on m.c = l.c
"""

LINKS = """
with recursive v as (select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings),
good as (
  select * from v where label is not null and e is not null and len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0),
pairs as (select a.r as a, b.r as b from good a join good b on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select r as a, r as b from v union select r.a, p.b from reach r join pairs p on r.b = p.a),
least_id as (select a, min(v.vec_id) as component_id from reach join v on v.r = reach.b group by a),
counted as (select a, count(*) as n from pairs group by a)
select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id is not distinct from component_id as kept
from v join least_id l on l.a = v.r left join counted c on c.a = v.r
"""

LEAKS = rf"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (
  select distinct item_id, least(len(w), 10) as k, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') for i in range(1, greatest(len(w) - 8, 2))]) as x from items where len(w) > 0),
sizes as (select distinct k from windows),
grams as (select r, k, unnest(range(1, len(w) - k + 2)) as i from docs, sizes where len(w) >= k),
said as (select g.r, g.k, g.i, array_to_string(d.w[g.i:g.i + g.k - 1], ' ') as x from grams g join docs d on d.r = g.r),
found as (select s.r, s.i, s.k, w.item_id from said s join windows w on s.k = w.k and s.x = w.x),
hit as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from found) group by r),
listed as (select r, count(distinct cast(item_id as varchar)) as n_items, array_to_string(list_sort(list_distinct(list(cast(item_id as varchar)))), ',') as names from found where item_id is not null group by r)
select d.doc_id, len(d.w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hit h on h.r = d.r left join listed l on l.r = d.r
"""
