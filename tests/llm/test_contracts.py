"""The registered queries themselves, their columns and values, against brute force on a small folder of tables."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm import bpe, checks, decontaminate, html_text, licences, neardup, registry, secrets, token_counts, toxicity, vectors
from tests.llm.test_near_and_models import PAGES
from tests.llm.test_text_ops import reference_encoding

HEX = "0123456789abcdef" * 2
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    g = random.Random(seed)
    return " ".join(g.choice("abcdefgh") + g.choice("klmnop") + g.choice("aeiou") + str(g.randint(0, 9)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    g, abuse = random.Random(4), "grunk vlob snerf".split()
    rows, labels = [], []
    for k in range(160):
        toxic = k % 3 == 0
        w = words(k, 40).split()
        if toxic:
            w[10:10] = [g.choice(abuse) for _ in range(6)]
        rows.append((k, " ".join(w), g.choice(["en", "de", None]), g.choice(["s", "t"])))
        labels.append((k, g.randint(0, 1), int(toxic)))
    base, item = words(900, 80), words(901, 14)
    rows += [(200, base, "en", "s"), (201, base, "en", "s"), (202, base + " tail end", "en", "t"), (203, f"x {item} y", "en", "s"), (204, f"{words(902, 30)} token = {HEX} {words(903, 9)}", "en", "s"), (205, "Released under the MIT\nLicense.", "en", "s")]
    rows += [(206, None, None, None), (207, "", "en", "s"), (None, "no id here at all", "en", "s"), (200, base, "en", "s"), (208, words(904, 30_000), "de", "s"), (209, "password: hG7$kq92LmzX9 é\u2028", "fr", "t"), (210, "x" * 200_000, "en", "s")]
    spark.createDataFrame([(i, t, a, s, None if t is None else len(t)) for i, t, a, s in rows], DOC).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*labels, (0, 1, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("i1", item), ("i2", item), (None, "x"), ("i3", None), ("i4", "")], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    pages = [(k, f"http://s{k}.com/en/{k}", html) for k, (html, _) in enumerate(PAGES.values())]
    spark.createDataFrame([*pages, (90, None, None), (91, "x", "")], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    v = [[g.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    near = [[x + g.gauss(0, 0.02) for x in v[k % 12]] for k in range(60)]
    embeddings = [(k, x, k % 12 % 3) for k, x in enumerate(v + near)] + [(100, v[0], 0), (101, None, 0), (102, [0.0] * 16, 0), (103, v[1], None), (104, [float("nan")] * 16, 1)]
    spark.createDataFrame(embeddings, "vec_id long, embedding array<double>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def texts(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def result(spark, folder, name):
    return registry.QUERIES[name](spark, folder).collect()


def test_secret_scan(spark, folder, texts):
    want = {}
    for i, t in texts:
        base = secrets.brute_force_base(t)
        want[i] = (*(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex")), secrets.digest(base), ",".join(f"{k}:{a}:{b}" for k, a, b in secrets.spans(t or "")))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in result(spark, folder, "op3_secret_scan")}
    assert got == want and want[209][4] == "guess:10:23" and want[204][:3] == (1, 0, 1)


def test_bpe(spark, folder, texts):
    own = reference_encoding()
    want = sorted(((i, len(ids := own.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in texts), key=repr)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in result(spark, folder, "op10_byte_bpe")), key=repr) == want


def test_another_pattern_is_refused(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(public_tokenizers, "PATTERN", public_tokenizers.PATTERN + "x")
    with pytest.raises(ValueError):
        bpe.codec.__wrapped__(bpe.production_ranks())


def test_toxicity(spark, folder, texts):
    got = result(spark, folder, "op7_toxicity")
    assert len(got) == len(texts) and [f.name for f in registry.QUERIES["op7_toxicity"](spark, folder).schema] == ["doc_id", "held_out", "score", "predicted"]
    net = toxicity.learn(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    alone = {i: float(toxicity.Scorer(net).scores([t])[0]) for i, t in texts}
    right = 0
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id not in (None, 200):
            assert r.score == pytest.approx(alone[r.doc_id], abs=1e-5)
        if r.held_out and r.doc_id is not None and r.doc_id < 160:
            right += r.predicted == int(r.doc_id % 3 == 0)
    held = sum(r.held_out and r.doc_id is not None and r.doc_id < 160 for r in got)
    assert right / held > 0.9


def test_html_text(spark, folder):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in result(spark, folder, "op8_html_text")}
    for k, (_, want) in enumerate(PAGES.values()):
        assert got[k] == (f"http://s{k}.com/en/{k}", want, len(want))
    assert got[90] == (None, "", 0) and got[91] == ("x", "", 0)


def test_the_others_against_brute_force(spark, folder, texts):
    key = lambda rows: sorted(map(repr, rows))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in result(spark, folder, "op9_decontamination")]
    short = [(i, t) for i, t in texts if len(t or "") < 100_000]
    assert key(g for g in got if g[0] not in (208, 210)) == key(decontaminate.brute_force([x for x in short if x[0] not in (208, 210)], items))
    some = [(i, t) for i, t in texts if i is not None]
    groups = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in result(spark, folder, "op4_hyperminhash") if r.doc_id is not None}
    assert groups == set(neardup.brute_force(some))
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in result(spark, folder, "op6_cross_polytope")} == set(vectors.brute_force(rows))
    found = {r.doc_id: (r.n_matches, r.licences, r.best_dice) for r in result(spark, folder, "op5_licence_scan")}
    assert found == {i: licences.brute_force(t) for i, t in texts} and found[205][1] == "mit"
    counts: dict = {}
    labels = [(r.doc_id, r.quality, r.toxic) for r in spark.read.parquet(f"{folder}/labels.parquet").collect()]
    gone, poor = {i for i, _, t in labels if t == 1}, {i for i, q, _ in labels if q == 0}
    kinds = {v: re.compile(p) for v, p in token_counts.TOKENIZERS.items()}
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        if r.doc_id is None or r.doc_id not in gone:
            n = {v: len(p.findall(r.text or "")) for v, p in kinds.items()}
            for v in kinds:
                c = counts.setdefault((r.source, r.lang, v), [0, 0])
                c[0] += 1
                c[1] += n["words-2"] if r.doc_id in poor else n[v]
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in result(spark, folder, "op1_token_rollup")} == counts


def test_pipeline_against_brute_force(spark, folder, texts):
    """Every stage by its definition, on plain lists."""
    tables = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels", "benchmark")}
    scorer = toxicity.Scorer(toxicity.learn(tables["documents"], tables["labels"]))
    docs = [(i, t) for i, t in texts if scorer.scores([t])[0] < toxicity.THRESHOLD]
    assert not any(i is not None and i < 160 and i % 9 == 0 for i, _ in docs) or len(docs) < len(texts)
    seen, kept = set(), []
    groups = neardup.brute_force([(10**9 if i is None else i, t) for i, t in docs])
    for (i, t), (_, n, _, keep) in zip(docs, groups):
        if keep and (not n or (i, t) not in seen):
            seen.add((i, t))
            kept.append((i, t))
    items = [(r.item_id, r.text) for r in tables["benchmark"].collect()]
    clean = [(i, t) for i, t in kept if len(t or "") > 100_000 or not decontaminate.brute_force([(i, t)], items)[0][5]]
    own, want = reference_encoding(), []
    for i, t in clean:
        hidden = []  # spans that overlap are one; of an assignment only its whole value goes
        for kind, a, b in secrets.spans(t or ""):
            if kind == "assign":
                a, b = secrets.ASSIGN.match(t, a).span(2)
                while b < len(t) and not re.match("[\\s\"'<>,;]", t[b]):
                    b += 1
            hidden.append((a, b))
        for a, b in reversed(decontaminate.merge(hidden)):
            t = t[:a] + "[SECRET]" + t[b:]
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {i for i, *_ in got} >= {200, 204, 205, 206, 207, 208, 209, 210} and not {i for i, *_ in got} & {201, 202, 203}


def test_a_pipeline_goes_on_after_its_last_whole_stage(spark, folder, tmp_path, monkeypatch):
    work = str(tmp_path / "work")
    first = sorted(map(repr, corpus_pipeline.run(spark, folder, work).collect()))
    monkeypatch.setattr(corpus_pipeline.toxicity, "learn", None)  # a finished stage is not asked again
    assert sorted(map(repr, corpus_pipeline.run(spark, folder, work).collect())) == first
    other = tmp_path / "other"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(5).write.parquet(f"{other}/{name}.parquet")
    with pytest.raises(ValueError, match="other tables"):
        corpus_pipeline.run(spark, str(other), work)  # never the first corpus's stages
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[1:])
    with pytest.raises(ValueError, match="other code"):
        corpus_pipeline.run(spark, folder, work)
    (tmp_path / "work" / "MADE_FROM").unlink()
    with pytest.raises(ValueError, match="origin"):
        corpus_pipeline.run(spark, folder, work)
    corpus_pipeline.clear(spark, work)
    assert not (tmp_path / "work").exists()


def test_empty_tables_and_clashing_names(spark, folder, tmp_path):
    d = str(tmp_path)
    for name in ("documents", "labels", "benchmark", "pages", "embeddings"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{d}/{name}.parquet")
    for name, q in registry.QUERIES.items():
        assert q(spark, d).count() == 0, name
    assert corpus_pipeline.run(spark, d).count() == 0
    odd = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id > 199")
    for c in ("key", "cls", "bucket", "hits", "items", "spans", "score", "codes", "least", "own", "n_words", "component", "set_key", "w"):
        odd = odd.withColumn(c, F.lit("own"))
    bench, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("benchmark", "labels"))
    for out in (neardup.keep_one(odd), decontaminate.keep_uncontaminated(odd, bench), secrets.redact(odd), toxicity.keep_clean(odd, toxicity.learn(odd, labels))):
        assert out.columns == odd.columns and out.count() > 0
    for out in (neardup.find_groups(odd), decontaminate.find_leaks(odd, bench), secrets.find_secrets(odd), bpe.encode_documents(odd, bpe.production_ranks()), licences.find_licences(odd), token_counts.count_tokens(odd)):
        assert out.count() == odd.count()
    assert html_text.extract(spark.read.parquet(f"{folder}/pages.parquet").withColumn("html_", F.lit(1))).columns == ["page_id", "url", "html_", "text"]


def test_a_large_benchmark_is_searched_block_by_block(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    docs = docs.where("doc_id < 208")
    whole = {(r.doc_id, r.n_hit, r.items_sha256) for r in decontaminate.leak_report(docs, bench).collect()}
    assert {(r.doc_id, r.n_hit, r.items_sha256) for r in decontaminate.leak_report(docs, bench, block_bytes=600).collect()} == whole
    assert {r.doc_id for r in decontaminate.keep_uncontaminated(docs, bench, block_bytes=600).collect()} == {i for i, n, _ in whole if not n}


def test_built_size_of_a_block_is_counted():
    import tracemalloc

    g = random.Random(5)
    vocabulary = ["".join(g.choice("abcdefghijklmnop") for _ in range(g.randint(3, 9))) for _ in range(40_000)]
    items = [(i, " ".join(g.choices(vocabulary, k=60))) for i in range(8_000)]
    counted = decontaminate.PLACE_BYTES * 480_000 + decontaminate.WORD_BYTES * len({w for _, t in items for w in t.split()})
    tracemalloc.start()
    decontaminate.Matcher(items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * counted + 40_000_000
    hot = decontaminate.Matcher([(i, " ".join([f"a{i}"] * 8) + " zz yy") for i in range(4000)])
    assert hot.scan("b " * 8 + "zz yy " * 500)[1] == []


def test_sql_of_the_checks_runs_on_the_folder(spark, folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for n in ("documents", "labels", "benchmark", "embeddings", "pages"):
        con.execute(f"create view {n} as select * from '{folder}/{n}.parquet/*.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        order = [[c[0] for c in want.description].index(c) for c in columns]
        one = lambda v: round(v, 6) if isinstance(v, float) else v
        rows = sorted(repr(tuple(one(r[k]) for k in order)) for r in want.fetchall())
        got = registry.QUERIES[name](spark, folder)
        assert sorted(repr(tuple(one(r[c]) for c in columns)) for r in got.collect()) == rows, name
    assert checks.GROUPS
