import hashlib
import random
import re

import pytest

import corpus_pipeline
from strandlake.llm import bpe, decontaminate, licences, secrets
from strandlake.llm.common import components

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.production_ranks())


def reference_encoding():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(bpe.read_ranks(bpe.production_ranks())), special_tokens={})


def test_bpe_equals_the_library(codec):
    ref, g = reference_encoding(), random.Random(1)
    alphabet = " '\n\t sSrevlmdt1٣²é中\u00a0\u2003\x1c!.-_😀\u0301\u0130"
    for _ in range(20000):
        t = "".join(g.choice(alphabet) for _ in range(g.randint(0, 14)))
        assert codec.encode(t) == ref.encode_ordinary(t), repr(t)
        assert codec.decode(codec.encode(t)) == t.encode()
    long = "ab" * 20000 + " " * 5000 + "é" * 3000
    assert codec.encode(long) == ref.encode_ordinary(long)


def test_perfect_hash_is_minimal_and_confirms():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert all(keys[h.index(k)] == k for k in keys) and sorted(h.slot_key) == list(range(5000))
    assert keys[h.index(b"absent")] != b"absent"


def test_forgetting_changes_nothing(codec, monkeypatch):
    texts = ["alpha beta gamma delta " * 3, "epsilon zeta alpha"]
    want = [codec.encode(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    codec.seen.clear()
    assert [codec.encode(t) for t in texts] == want


def test_bpe_rows(spark, codec):
    df = spark.createDataFrame([(1, "Hello world", "n", 3), (2, None, None, 4), (2, "", "k", 5), (None, "x", "k", 6)], "doc_id long, text string, key string, n_tokens int")
    rows = {(r.doc_id, r.n_tokens, r.decoded_sha256) for r in bpe.encode_documents(df, bpe.production_ranks()).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (2, 0, empty) in rows and len(rows) == 3 and (1, len(codec.encode("Hello world")), hashlib.sha256(b"Hello world").hexdigest()) in rows
    assert bpe.encode_documents(df.limit(0), bpe.production_ranks(), token_ids=True).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"]


def test_search_against_brute_force():
    g = random.Random(2)
    words = ["a", "b", "c", "dé", "É", "ÀB"]
    for _ in range(300):
        items = [(i, " ".join(g.choice(words) for _ in range(g.randint(0, 6)))) for i in range(4)]
        docs = [(i, g.choice([" ", ", ", "\n"]).join(g.choice(words) for _ in range(g.randint(0, 30)))) for i in range(5)]
        m = decontaminate.Matcher(items, 4)
        for (_, t), want in zip(docs, decontaminate.brute_force(docs, items, 4)):
            n, ranges, found = m.scan(t)
            assert (n, sum(b - a for a, b in decontaminate.merge(ranges)), len(found)) == want[1:4]


def test_leaks_in_one_block_and_several(spark):
    g = random.Random(3)
    word = lambda: g.choice("abcdefghij") + g.choice("xyz")
    items = [(i, " ".join(word() for _ in range(g.choice([0, 3, 9, 10, 14, 30])))) for i in range(12)] + [(3, "again " * 11), (None, "q " * 10), (50, None)]
    docs = [(i, " ".join(word() for _ in range(40)) + " " + g.choice(items[:12])[1].upper() + "! " + " ".join(word() for _ in range(9))) for i in range(30)] + [(90, None), (91, ""), (91, "q Q q q-q q q q q q"), (92, "again " * 30)]
    d = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOC)
    b = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(decontaminate.brute_force(docs, items))
    assert sorted(tuple(r) for r in decontaminate.leak_report(d, b).collect()) == want
    assert sorted(tuple(r) for r in decontaminate.leak_report(d, b, block_bytes=60).collect()) == want
    clean = sorted(i for i, *_, hit in want if not hit)
    assert sorted(r.doc_id for r in decontaminate.keep_uncontaminated(d, b).collect()) == clean
    assert sorted(r.doc_id for r in decontaminate.keep_uncontaminated(d, b, block_bytes=60).collect()) == clean
    assert decontaminate.keep_uncontaminated(d, b.limit(0)).count() == len(docs) and decontaminate.leak_report(d.limit(0), b).count() == 0


HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def test_base_spans_against_the_patterns():
    g = random.Random(4)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", " = ", ":", "=", '"', "'", " ", "\n", "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 9, HEX, "ff", "é", "ſecret", "toKen"]
    for _ in range(4000):
        t = "".join(g.choice(parts) for _ in range(g.randint(0, 12)))
        assert [s for s in secrets.spans(t) if s[0] != "guess"] == secrets.brute_force_base(t), repr(t)


def exhaustive_bits(value):
    """The cheapest segmentation by trying every cut and every kind, from the prices alone."""
    from functools import lru_cache
    from math import log2

    n, low, plain, rank = len(value), value.lower(), value.lower().translate(secrets._PLAIN), secrets.dictionary()

    def prices(i, j):
        s, out = value[i:j], [sum(map(secrets._char_bits, value[i:j]))]
        for form, extra in ((low, 0.0), (plain, 2.0)):
            if j - i >= 2 and form[i:j] in rank:
                out.append(rank[form[i:j]] + extra + (s != low[i:j]))
        if (m := secrets._DATE.match(value, i)) and m.end() == j:
            out.append(log2(36525))
        for unit in range(1, (j - i) // 2 + 1):
            times = (j - i) // unit
            if times * unit == j - i and s[:unit] * times == s and times >= (3 if unit == 1 else 2):
                out.append(sum(map(secrets._char_bits, s[:unit])) + log2(times))
        if j - i >= 3 and all(any(a + b in row or b + a in row for row in secrets.KEYBOARD) for a, b in zip(low[i:j], low[i + 1 : j])):
            out.append(log2(sum(map(len, secrets.KEYBOARD))) + 1 + log2(j - i))
        return out

    @lru_cache(None)
    def best(j):
        return 0.0 if not j else min(best(i) + secrets.SEGMENT + min(prices(i, j)) for i in range(j))

    return best(n)


def test_guess_cost_is_the_minimum():
    g = random.Random(5)
    parts = ["pass", "word", "P@ssw0rd", "dragon", "1999", "2024-05-06", "xK", "Q", "7", "zp", "love", "ddd", "qwe", "4321", "abab", "xKxK", "aaaa", "ytr"]
    kinds = set()
    for _ in range(400):
        v = "".join(g.choice(parts) for _ in range(g.randint(1, 4)))
        if g.random() < 0.3:
            v = "".join(g.choice("ab1Q") for _ in range(g.randint(1, 14)))
        bits, cut = secrets.guess_bits(v)
        assert cut[0][1] == 0 and cut[-1][2] == len(v) and all(a[2] == b[1] for a, b in zip(cut, cut[1:]))
        assert bits == pytest.approx(exhaustive_bits(v)), v
        kinds |= {k for k, *_ in cut}
    assert kinds == {"word", "date", "repeat", "walk", "brute"}
    assert secrets.guess_bits("passwordddd")[0] == pytest.approx(exhaustive_bits("passwordddd"))


def test_long_values_and_gaps_take_linear_time():
    import time

    began = time.time()
    for text in ("password" + " " * 1_000_000, "bearer" + " " * 1_000_000, "token is " * 100_000, "secret=" + "x" * 300_000, "token=" + "ab" * 150_000, "secret=" + "7" * 99_999 + "8" + "7" * 100_000):
        secrets.spans(text)
    assert time.time() - began < 60


def test_weak_and_strong_values():
    bits = lambda v: secrets.guess_bits(v)[0]
    for weak in ("password123", "qwertyuiop", "aaaaaaaaaaaaaaaa", "abcabcabcabc", "changeme", "Summer2024"):
        assert bits(weak) < secrets.LEAST_BITS
    for strong in (HEX, "hG7$kq92LmzX9", "tr0ub4dor&3xyzzQ!"):
        assert bits(strong) >= secrets.LEAST_BITS
    assert bits("x" * 50000) < 40 and bits("") == 0
    assert [k for k, *_ in secrets.guess_bits("password123")[1]] == ["word", "walk"]
    assert secrets.spans("the pwd is hG7$kq92LmzX9 now") == [("guess", 11, 24)] and secrets.spans("the password is password") == []


def test_prose_is_no_secret_and_any_repeat_is_cheap():
    for clean in ("password management and password requirements", "credentials verification", "the password is management", "passphrase: recommendations"):
        assert not secrets.spans(clean), clean
    bits = lambda v: secrets.guess_bits(v)[0]
    assert bits("qXk9#" * 10) < secrets.LEAST_BITS and bits("qXk9#" * 10) == bits("Xk9#q" * 10)
    assert bits("zz" + "aaaaaaaab") < bits("zz" + "aaaaaaaa") + 12 and secrets.repeats("abcabcab") == [(0, 8, 3)]
    assert secrets.spans("Authorization: Bearer hG7$kq92LmzX9") == [("guess", 22, 35)]
    g = random.Random(8)
    for _ in range(300):
        v = "".join(g.choice(["ab", "a", "abc", "bca"]) for _ in range(g.randint(1, 8)))
        want = {(i, j) for i in range(len(v)) for j in range(i + 2, len(v) + 1) if any((j - i) % u == 0 and v[i : i + u] * ((j - i) // u) == v[i:j] for u in range(1, (j - i) // 2 + 1))}
        assert want == {(i, j) for a, z, u in secrets.repeats(v) for i in range(a, z) for j in range(i + 2 * u, z + 1, u)}


def test_whole_values_of_base_contexts(spark):
    strong = "k$8!vQz@2pLm#9Rt"
    for name in ("api_key", "DB_PASSWORD", "secret", "ACCESS_TOKEN", "db_pwd", "CLIENT_SECRET", "MY_access_key"):
        t = f'x {name} = "{strong}" y'
        at = t.index(strong)
        assert ("guess", at, at + len(strong)) in secrets.spans(t), name
    t = "secret=abcdef$K9zz!Qm2 b"
    assert secrets.spans(t) == [("assign", 0, 13), ("guess", 7, 22)] and secrets.brute_force_base(t) == [("assign", 0, 13)]
    df = spark.createDataFrame([(1, t, "en", "s", 0), (2, "token=abcdef!x b", "en", "s", 0)], DOC)
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["secret=[SECRET] b", "token=[SECRET] b"]


def test_redaction_and_rows(spark):
    rows = [(1, f'a token = "{HEX}" b', "en", "s", 0), (2, "clean", "en", "s", 0), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, "AKIA" + "A1" * 9 + " é", "en", "s", 0)]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r.text for r in secrets.redact(df).collect()}
    assert got == {1: 'a token = "[SECRET]" b', 2: "clean", 3: None, 4: "", 5: "[SECRET] é"}
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.find_secrets(df.withColumn("spans", df.lang)).collect()}
    assert found == {i: secrets.spans(t or "") for i, t, *_ in rows}
    assert secrets.find_secrets(df.limit(0)).count() == 0
    assert all(not secrets.spans(t or "") for t in got.values())


def test_licences_against_brute_force(spark):
    g = random.Random(6)
    texts = [t for group in licences.NOTICES.values() for t in group] + [t for whole in licences.TEXTS.values() for t in (whole, *whole.split("\n\n"))]
    rows = []
    for i in range(120):
        w = g.choice(texts).split()
        for _ in range(g.choice([0, 0, 1, 2, 4])):
            w[g.randrange(len(w))] = g.choice(["foo", "THE", "license"])
        w = [x + g.choice(["", "", "", "\n", "\n\n"]) if i % 3 == 0 and g.random() < 0.2 else x for x in w]
        rows.append((i, "Intro text. " * g.randint(0, 2) + " ".join(w) + g.choice(["", "\nmore\n", " End of it. Licensed under CC BY 4.0."])))
    rows += [(200, None), (201, ""), (202, "a"), (203, "of the of the of the"), (203, "MIT\t\nLicense" * 3)]
    got = licences.find_licences(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, name string"), out="m").collect()
    for r in got:
        m = [(x.dice, x.name) for x in r.m]
        assert (len(m), ",".join(sorted({n for _, n in m})), round(max((d for d, _ in m), default=0.0), 6)) == licences.brute_force(r.text)
    assert sum(len(r.m) > 0 for r in got) > 60


def test_wrapped_notices_and_whole_licences_match(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation\nfiles."
    texts = ["Read this.\n\n" + grant, "Copyright 2024 Ann\n\n" + licences.TEXTS["mit"], licences.TEXTS["bsd-3-clause"].replace("\n\n", "\r\n\r\n"), "Intro.\n" * 300 + licences.TEXTS["isc"]]
    got = {r.k: {x.name for x in r.m} for r in licences.find_licences(spark.createDataFrame(list(enumerate(texts)), "k long, text string"), out="m").collect()}
    assert got[0] == {"mit"} and "mit" in got[1] and "bsd-3-clause" in got[2] and "isc" in got[3]
    plan = licences.find_licences(spark.createDataFrame([(1, "a")], "k long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clues_lose_no_match():
    """A unit that shares as few bigrams of a template as LEAST allows still holds a clue."""
    import re

    clues, pattern = set(licences.clues()), re.compile(licences.clue_pattern().replace("++", "+"))
    for _, grams in licences.templates():
        least = -(-len(grams) * 2 // 3)
        assert len(clues & set(grams)) > len(grams) - least
    assert pattern.search("x mit -- license") and not pattern.search("emit license") and not pattern.search("a mit licenses")


def test_long_units_of_few_bigrams_match(spark):
    texts = ["Released under the MIT License, " * 40, "Released under the MIT License, " * 4000, " ".join(f"w{i}" for i in range(5000)), "of the " * 900]
    got = licences.find_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), out="m").collect()
    want = {r.doc_id: (len(r.m), ",".join(sorted({x.name for x in r.m})), round(max((x.dice for x in r.m), default=0.0), 6)) for r in got}
    assert want == {i: licences.brute_force(t) for i, t in enumerate(texts)} and [want[i][0] for i in range(4)] == [1, 1, 0, 0]


def test_components(spark, monkeypatch):
    from strandlake.llm import common

    g = random.Random(7)
    e = [(g.randint(0, 80), g.randint(0, 80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 125)] + [(3, 3), (None, 4), (100, 101)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(e, "a long, b long")
    for small in (1000, 0):
        monkeypatch.setattr(common, "SMALL_EDGES", small)
        assert {r.id: r.component for r in components(df).collect()} == {x: find(x) for x in root}
    assert components(df.limit(0)).count() == 0


def test_pipeline_stages_chain(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "secrets", "byte_bpe"]
    words = lambda seed, n: " ".join(random.Random(seed).choice("abcdefgh") + random.Random(seed * 31 + k).choice("klmnop") + str(k % 7) for k in range(n))
    base, item = words(1, 80), words(9, 12)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, words(2, 60)), (5, f"x {item} y"), (6, f"token = {HEX} " + words(3, 40)), (7, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOC)
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        docs.write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, d)
            if k < 4:
                assert out.schema.names == DOC.replace(",", "").split()[::2]
                out.write.parquet(f"{d}/{k}")
                docs = spark.read.parquet(f"{d}/{k}")
        assert {r.doc_id for r in out.collect()} == {1, 4, 6, 7, 8}
        assert all(re.fullmatch("[0-9a-f]{64}", r.ids_sha256) and len(r.token_ids) == r.n_tokens for r in out.collect())
        assert not any(HEX in (r.text or "") for r in docs.collect())
        assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {1, 4, 6, 7, 8}
