"""Every query with SQL agrees with it at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def one(v):
        return None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v

    return sorted(repr(tuple(one(v) for v in r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF)
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(tuple(r) for r in got.select(*columns).collect()) == canonical(want.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_clustering_takes_every_structure(spark, monkeypatch):
    from strandlake.plans import queries

    whole = queries.structures
    monkeypatch.setattr(queries, "structures", lambda spark, sf_dir: whole(spark, sf_dir).where("struct_id < 10"))
    rows = entry.queries()["complete_linkage"](spark, SF).collect()
    assert sorted(m for r in rows for m in r.members) == list(range(10))
    names = {r.line for r in entry.queries()["cluster_fasta"](spark, SF).where("line_no = 0").collect()}
    assert names == {f">chain{k}" for k in range(10)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_reports_list_every_rank(spark, monkeypatch):
    from pyspark.sql import functions as F

    from strandlake.plans import queries

    whole = queries.structures
    monkeypatch.setattr(queries, "structures", lambda spark, sf_dir: whole(spark, sf_dir).where("struct_id = 0"))
    one = queries.aligned_hits(spark, SF)
    hits = spark.createDataFrame(one.collect(), one.schema).crossJoin(spark.range(25)).withColumn("ref_id", F.col("id")).drop("id")
    assert hits.count() == 25
    monkeypatch.setattr(queries, "aligned_hits", lambda spark, sf_dir: hits)
    lines = queries.alignment_report(spark, SF)
    assert [lines.where(f"section = {k}").select("rank").distinct().count() for k in (1, 2)] == [25, 25]
    assert queries.json_report(spark, SF).where("section = 3").count() == 25


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["alignment_report", "json_report", "json_frame", "report_frame"])
def test_reports_align_once(spark, monkeypatch, name):
    from strandlake.plans import queries

    whole = queries.structures
    monkeypatch.setattr(queries, "structures", lambda spark, sf_dir: whole(spark, sf_dir).where("struct_id < 2"))
    assert "PythonUDF" not in (plan := entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()) and "MapInArrow" not in plan
