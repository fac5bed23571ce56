"""Fill-in-the-middle cuts, divergence of sources and removal of repeats, against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.llm import divergence, fill_middle, repeats, suffixes
from strandlake.llm.elias_fano import EliasFano, encode

DOC = "doc_id long, text string, lang string, source string, key string, n string, batch int"


def table(spark, rows):
    """Documents with columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, None, None, "k", "n", 7) for i, t in rows], DOC)


def prose(seed, n, vocabulary=400):
    g = random.Random(seed)
    return " ".join(f"{g.choice('bcdfg')}{g.choice('aeiou')}{g.randrange(vocabulary)}" for _ in range(n))


def test_elias_fano():
    g = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 300):
        for step in (1, 2, 7, 1000, 10**9):
            values = np.cumsum(g.integers(0 if step > 1 else 1, step + 1, n))
            got = EliasFano(n, *encode(values))
            assert [got.select(i) for i in range(n)] == values.tolist()
    with pytest.raises(IndexError):
        EliasFano(0, *encode(np.zeros(0))).select(0)


TEXTS = ["", None, " ", "\n\t ", "one", " one", "one ", "a b c d e f g", "é ü  ß\x0b x", "with <P> mark", "half <S mark <M", "x" * 100_000, "word " * 30_000, prose(1, 200), prose(2, 50) + " end \r\n"]


def test_cuts(spark, monkeypatch):
    rows = [(k, t) for k, t in enumerate(TEXTS * 6)] + [(k, TEXTS[7]) for k in range(200, 500)] + [(5, "x y z"), (5, "x y z"), (None, "a b c"), (-3, "a b c")]
    monkeypatch.setattr(fill_middle, "BUCKET_BYTES", 300_000)
    got = fill_middle.report(table(spark, rows))
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, fill_middle.brute_force(rows)))
    assert {r.form for r in got.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    assert fill_middle.report(table(spark, rows).limit(0)).count() == 0


def test_cuts_give_outputs_and_one_list_a_text(spark):
    rows = [(k, "a b c d") for k in range(300)] + [(k, f"t{k} u") for k in range(300, 320)]
    docs = table(spark, rows)
    lists = fill_middle.distinct_index(fill_middle._dealt(docs, "doc_id", "text", 42)[0])
    assert lists.count() == lists.select("sha").distinct().count() == 21
    out = fill_middle.fill_in_middle(docs, marks=("[p]", "[s]", "[m]"), rate=100, suffix_first=0)
    assert out.where(~F.col("output").startswith("[p]")).isEmpty()
    back = out.select("doc_id", fill_middle.restored(marks=("[p]", "[s]", "[m]")).alias("text"))
    assert {tuple(r) for r in back.collect()} == set(rows)


def audited(rows, least=30, top=50):
    """Straight from the definition."""
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in t or "").split(" ")
    docs = [(a or "", b or "", [w for w in words(t) if w]) for t, a, b in rows]
    out = []
    for lang in {a for a, _, _ in docs}:
        own = [(b, w) for a, b, w in docs if a == lang]
        held = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in held.items() if n >= least)
        v = len(kept)
        count = {s: Counter(t for b, w in own if b == s for t in w) for s in {b for b, _ in own}}
        count[None] = Counter(t for _, w in own for t in w)
        total = {s: sum(c[t] for t in kept) for s, c in count.items()}
        p = {s: {t: 1 + 10**9 * (c[t] + 5) // (total[s] + 5 * v) for t in kept} for s, c in count.items()}
        for s in count.keys() - {None}:
            parts = {
                "pair": [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in count.keys() - {None, s}],
                "term": [(p[s][t] - p[None][t], t) for t in kept if count[s][t] and p[s][t] > p[None][t]],
            }
            for part, found in parts.items():
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def audit(spark, rows, **options):
    docs = spark.createDataFrame([(t, a, b, 3, "q") for t, a, b in rows], "text string, lang string, source string, p int, term string")
    return sorted(tuple(r) for r in divergence.divergence(docs, **options).collect())


def test_divergence(spark, monkeypatch):
    g = random.Random(5)
    vocabulary = ["Über", "naïve", "ab", "AB", "zz", "日本", *(f"{a}{b}" for a in "cdefgh" for b in "klmnop")]
    rows = []
    for k in range(240):
        source = g.choice(["s1", "s2", "ä", None, "hot", "hot", "hot"])
        own = vocabulary[: 20 if source == "s1" else 99]
        rows.append((" ".join(g.choice(own) for _ in range(g.randrange(0, 40))) + "1,x-y Z", g.choice(["en", "en", "de", None]), source))
    rows += [(None, "en", "quiet"), ("", "xx", "s1"), ("", "xx", "s2"), ("lonely", "yy", "s1"), (rows[0][0], *rows[0][1:]), ("w" * 100_000, "en", "s2"), ("ab " * 30_000, "de", "s1")]
    want = audited(rows, 12, 9)
    assert audit(spark, rows, least=12, top=9) == want and len({r[2] for r in want}) == 2 and ("xx", "s1", "pair", "s2", 0, 1) in want
    monkeypatch.setattr(divergence, "HELD_TERMS", 10)
    assert audit(spark, rows, least=12, top=9) == want
    assert audit(spark, rows) == audited(rows) and audit(spark, []) == []


def exhaustive(tiles, least):
    """All repeats across the anchor that no byte can be added to."""
    groups = {}
    for i, (before, after) in enumerate(tiles):
        for d in range(len(before) + 1):
            for e in range(max(0, least - d), len(after) + 1):
                groups.setdefault((before[len(before) - d :], after[:e]), set()).add(i)
    shapes = {}
    for (before, after), members in groups.items():
        if len(members) > 1:
            shapes.setdefault(frozenset(members), set()).add((len(before), len(after)))
    return {(a, b, m) for m, found in shapes.items() for a, b in found if not any(x >= a and y >= b and (x, y) != (a, b) for x, y in found)}


def test_prefix_tree_gives_all_maximal_repeats():
    g = random.Random(2)
    some = lambda n: bytes(g.choice(b"ab") for _ in range(g.randrange(n)))
    for _ in range(300):
        tiles, least = list({(some(7), some(9)) for _ in range(g.randrange(2, 10))}), g.randrange(3, 9)
        assert {(a, b, frozenset(m)) for a, b, m in suffixes.maximal_repeats(tiles, least)} == exhaustive(tiles, least)


def test_every_window_names_one_anchor_by_its_bytes(monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK", 1000)
    texts = [prose(k, 60, 30).encode() for k in range(40)] + [b"a" * 700, b"", b"short", prose(3, 60, 30).encode()]
    data, lengths = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    h, place, first, last = suffixes.anchors(data, lengths, 50, 16)
    named, ends = {}, np.cumsum(lengths)
    for a, p, x, y in zip(h, place, first, last):
        for i in range(x, y + 1):
            window = data[i : i + 50].tobytes()
            assert i <= p <= i + 34 and named.setdefault(window, (p - i, a)) == (p - i, a)
    assert sum(last - first + 1) == sum(max(0, len(t) - 49) for t in texts) == len(data) - sum(min(49, len(t)) for t in texts) and ends[-1] == len(data)


def passages():
    g = random.Random(9)
    line = prose(70, 11)[:90]
    shared, rows = [prose(50 + k, 30) for k in range(4)], []
    for k in range(120):
        t = prose(1000 + k, g.randrange(0, 120))
        for _ in range(g.randrange(3)):
            at = g.randrange(len(t) + 1)
            t = t[:at] + g.choice([shared[0], shared[1], shared[2][20:170], line, "é" * 70, shared[3] * 2]) + t[at:]
        rows.append((3 * k % 121, t))
    rows += [(500 + k, rows[k][1]) for k in range(30)] + [(300 + k, f"{k} {line} {prose(k, 5)}") for k in range(60)]
    return rows + [(700, None), (701, ""), (702, "z" * 5000), (703, "zy" * 2000), (704, "z" * 99), (705, "q" * 101), (None, rows[0][1]), (-4, shared[0])]


@pytest.mark.parametrize(("batch", "hot"), [(10**7, 500), (9000, 500), (9000, 2)])
def test_repeats(spark, monkeypatch, batch, hot):
    monkeypatch.setattr(repeats, "BATCH_BYTES", batch)
    monkeypatch.setattr(repeats, "HOT_TILES", hot)
    monkeypatch.setattr(repeats, "BUCKET_HASHES", 700)
    monkeypatch.setattr(repeats, "HELD_SPANS", 50)
    rows = passages()
    got = sorted(map(repr, (tuple(r) for r in repeats.report(table(spark, rows)).collect())))
    assert got == sorted(map(repr, repeats.brute_force(rows)))


def test_repeats_of_equal_ids_and_empty_tables(spark):
    text = prose(1, 60)
    rows = [(1, text), (1, text), (None, text), (None, "a" + text)]
    out = repeats.remove_repeats(table(spark, rows)).collect()
    assert sorted(len(r.kept) for r in out) == [0, 0, 1, len(text)]
    assert sum(len(r.spans) for r in out) == 3 and {len(r.kept) for r in out if r.doc_id == 1} == {0, len(text)}
    assert repeats.report(table(spark, []).limit(0)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(table(spark, rows), gram=200)
