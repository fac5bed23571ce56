import pytest

from strandlake.llm import token_counts, url_filter
from strandlake.llm.common import work_path


@pytest.fixture
def rollup(spark):
    return token_counts.Rollup(spark, work_path(spark, "test-rollup"))


def rows(spark, *r):
    return spark.createDataFrame(r, token_counts.SCHEMA)


def test_batches_add_once(spark, rollup):
    load = rows(spark, ("a", "en", "t1", 1, 10), ("a", "en", "t1", 1, 5), (None, None, "t1", 1, None), ("b", "en", "t1", 1, 7))
    assert rollup.totals().count() == 0
    assert rollup.apply("load", load) and not rollup.apply("load", load)
    assert rollup.apply("drop", rows(spark, ("b", "en", "t1", -1, -7))) and rollup.apply("revise", rows(spark, ("a", "en", "t1", 0, 3)))
    want = {("a", "en", "t1", 2, 18), (None, None, "t1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert {tuple(r) for r in rollup.totals().collect()} == want
    assert not rollup.apply("drop", rows(spark, ("b", "en", "t1", -1, -7)))
    assert rollup.apply("empty", rows(spark, ("a", "en", "t1", 1, 1)).limit(0))
    assert {tuple(r) for r in rollup.totals().collect()} == want


class Killed(Exception):
    """Stands for the end of a process."""


def test_a_writer_that_died_leaves_nothing(spark, rollup, monkeypatch):
    one = rows(spark, ("a", "en", "t1", 1, 10))
    one.write.parquet(f"{rollup.path}/deltas/orphan")
    whole = rollup.fs

    class Dying:
        """The file system, up to the call that the process does not live to make."""

        def __init__(self, at):
            self.at = at

        def __getattr__(self, name):
            if name == self.at:
                raise Killed
            return getattr(whole, name)

    for at in ("create", "rename"):  # before the manifest exists, and between its writing and its name
        rollup.fs = Dying(at)
        with pytest.raises(Killed):
            rollup.apply("load", one)
        rollup.fs = whole
        assert rollup.totals().count() == 0 and rollup.committed() == set()
    stream = whole.create(rollup._path(f"{rollup.path}/pending/half"), False)
    stream.write(bytearray(b'{"batch": "lo'))
    stream.close()
    assert rollup.apply("load", one) and not rollup.apply("load", one)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t1", 1, 10)]


def test_a_compactor_that_died_or_was_overtaken_loses_nothing(spark, rollup, monkeypatch):
    one = rows(spark, ("a", "en", "t1", 1, 10))
    total = lambda: [tuple(r) for r in rollup.totals().collect()]
    assert rollup.apply("b1", one) and rollup.apply("b2", one) and not token_counts.Rollup(spark, rollup.path).apply("b2", one)
    put = rollup._manifest

    def dies(name, content):
        raise Killed

    monkeypatch.setattr(rollup, "_manifest", dies)
    with pytest.raises(Killed):
        rollup.compact()
    monkeypatch.setattr(rollup, "_manifest", put)
    assert total() == [("a", "en", "t1", 2, 20)]

    other = token_counts.Rollup(spark, rollup.path)

    def late(name, content):  # another writer commits, and another compactor finishes, before this one's manifest
        assert other.apply("b3", one) and other.compact()
        return put(name, content)

    monkeypatch.setattr(rollup, "_manifest", late)
    assert not rollup.compact()
    monkeypatch.setattr(rollup, "_manifest", put)
    assert total() == [("a", "en", "t1", 3, 30)] and rollup.committed() == {"b1", "b2", "b3"}
    assert not rollup.compact() and rollup.apply("b4", one) and rollup.compact() and total() == [("a", "en", "t1", 4, 40)]
    rollup.vacuum()
    assert total() == [("a", "en", "t1", 4, 40)] and not any(rollup.apply(f"b{k}", one) for k in range(1, 5))


def test_any_string_is_a_batch_id(spark, rollup):
    ids = ["_hidden", ".dot", "a/b", "", "é \n", "x" * 5000]
    assert all(rollup.apply(b, rows(spark, ("a", "en", "t1", 1, 1))) for b in ids)
    assert not any(rollup.apply(b, rows(spark, ("a", "en", "t1", 1, 1))) for b in ids)
    assert rollup.committed() == set(ids) and rollup.totals().first().docs == len(ids)


def test_counts(spark):
    df = spark.createDataFrame([("Hi, you 2!", "s"), (None, "s"), ("", "s"), (" \u00e9\u00e9 x\n", "s")], "text string, counts string")
    got = [tuple(r.counts) for r in token_counts.count_tokens(df).collect()]
    assert got == [(3, 5), (0, 0), (0, 0), (2, 3)]


RULES = url_filter.RULES


def judge_one(url):
    """The rule of one address, straight from the contract."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, a) for a, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None


def test_rules_against_the_contract(spark):
    urls = [None, "", "no scheme", "http://", "https://Example.COM/en/7x?q#f", "http://a.example.com/en/6", "http://com/en/", "http://xcom/en/", "ftp://example.net/de/81", "http://m.example.net/de/7", "http://x.org/es/", "http://x.org/es", "http://x.org/ES/", "a://b://com/en/", "http://com:80/en/", "http://x.com?/en/", "http://É.com/en/\n1", "http://x.com/en/#a/?"]
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    for r in url_filter.judge_urls(df).collect():
        host, path, rule, action = judge_one(urls[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, action or "allow"), urls[r.page_id]


def link(to):
    return f'<html><head><LINK rel="canonical" href="{to}"></head>'


def test_aliases_take_decisions_with_allow_first(spark):
    pages = [
        (1, "http://one.info/a", link("http://x.com/en/1")),  # aliased to a blocked address
        (2, "http://two.info/b?x=1", "<meta http-equiv='refresh' content='0; url=http://one.info/a#z'>"),  # through another alias
        (3, "http://three.info/c", link("http://y.com/en/2")),
        (4, "http://three.info/c", link("http://example.com/en/7")),  # the same address is allowed elsewhere
        (5, "http://four.info/d", "canonical but no link"),
        (6, "http://x.com/en/1", None),
        (7, "http://five.info/e", link("/f")),
        (8, "http://five.info/f", link("//z.org/es/9")),
        (9, "http://x.com/en/1", "<p>again</p>"),
        (10, None, link("http://x.com/en/1")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "block", 9: "block", 10: "allow"}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", pages)
    sql = {r[0]: r[4] for r in con.execute(url_filter.ORACLE).fetchall()}
    assert sql == got


def test_edges_from_elsewhere_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://q.info/x")], "page_id long, url string")
    edges = spark.createDataFrame([("Q.info", "/x", "m.com", "/en/"), ("q.info", "/x", None, None)], "host string, path string, to_host string, to_path string")
    assert url_filter.judge_urls(df, edges, html=None).first().verdict == "block"
    assert url_filter.judge_urls(df.limit(0), edges, html=None).count() == 0


def test_targets_are_resolved(spark):
    from pyspark.sql import functions as F

    base = "https://Site.org/a/b/c.html?q=1#f"
    cases = {
        "http://x.com/en/1": "x.com/en/1", "//y.com/p": "y.com/p", "/r/s": "site.org/r/s", "d.html": "site.org/a/b/d.html", "./d": "site.org/a/b/d", "../d": "site.org/a/d", "../../../d": "site.org/d",
        "?x=2": "site.org/a/b/c.html", "#top": "site.org/a/b/c.html", "..": "site.org/a/", "e/./f/../g": "site.org/a/b/e/g", "mailto:a@b.c": None, "javascript:x": None,
    }
    df = url_filter.resolved(spark.createDataFrame([(t, t) for t in cases], "t string, full string").withColumn("base", F.lit(base)), "base", "full")
    got = {r.t: None if r.full is None else r.h + r.p for r in df.select("t", "full", url_filter.host(F.col("full")).alias("h"), url_filter.path(F.col("full")).alias("p")).collect()}
    assert got == cases


def test_pages_state_aliases_in_their_head_only(spark):
    pages = [
        (1, "http://a.info/d/x", "<base href='http://m.com/'><link rel='canonical' href='en/1'>", "block"),  # against the base
        (2, "http://b.info/x", "<!-- <link rel=canonical href='http://m.com/en/1'> --><p>canonical", "allow"),
        (3, "http://c.info/x", "<script>var s='<link rel=canonical href=http://m.com/en/1>'</script>", "allow"),
        (4, "http://d.info/x", "<link rel='alternate stylesheet' href='http://m.com/en/1'><p>canonical</p>", "allow"),
        (5, "http://e.info/x", "<link href='http://m.com/en/1?a=1&amp;b=2' rel=\"prev canonical\">", "block"),
        (6, "http://f.info/x", "<meta http-equiv=Refresh content='5;URL=http://m.com/en/1'>", "block"),
        (7, "http://g.info/x", "<!-- canonical <link rel=canonical href=http://m.com/en/1>", "allow"),
        (8, "http://h.info/x/", "<link rel=canonical href='../../en/5'><base href='//m.com/u/v/w'>", "block"),
        (9, "http://i.info/x", "<link rel=canonical href='mailto:x@m.com'>", "allow"),
    ]
    df = spark.createDataFrame([(*p[:3], "own", True) for p in pages], "page_id long, url string, html string, own string, alias boolean")
    out = url_filter.judge_urls(df)
    assert {r.page_id: r.verdict for r in out.collect()} == {p[0]: p[3] for p in pages}
    assert out.columns == ["page_id", "url", "own", "alias", "host", "path", "rule", "verdict"] and out.first().own == "own"


def test_aliases_decide_in_the_query(spark, tmp_path):
    urls = ["http://a.info/1", "http://b.org/es/2", "http://c.info/3", "http://d.info/4", "http://e.info/5", "http://f.com/en/6", "http://example.com/en/7", None, "http://g.info/9"]
    spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.url_aliases(spark, str(tmp_path)).collect()}
    assert [got[k][1] for k in range(9)] == ["block", "block", "block", "block", "allow", "block", "allow", "allow", "allow"]
    assert got[0][0] is None and got[4][0] is None and got[6][0] == "example.com/en/7"
