"""Lines as files: whole on commit, nothing after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from strandlake.operators.cluster import cluster_rows
from strandlake.sources import reports, sink


def test_files_are_whole_and_in_order(spark, tmp_path):
    rows = [(f"f{k % 7}", k // 7, f"line {k}") for k in range(200)] + [("empty", 0, None)]
    lines = spark.createDataFrame(rows, "file string, n int, line string").repartition(6)
    sink.write_lines(lines, ["n"], str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == sorted({r[0] for r in rows})
    for name in {r[0] for r in rows}:
        assert (tmp_path / name).read_text() == "".join(f"{t or ''}\n" for f, _, t in rows if f == name)
    sink.write_lines(lines.where("file = 'f1' and n < 2"), ["n"], str(tmp_path))
    assert (tmp_path / "f1").read_text() == "line 1\nline 8\n" and len(os.listdir(tmp_path)) == 8


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "f1").write_text("old\n")
    lines = spark.createDataFrame([(f"f{k % 7}", k // 7, f"line {k}") for k in range(200)], "file string, n int, line string")
    bad = lines.withColumn("line", F.when((F.col("file") == "f3") & (F.col("n") == 20), F.raise_error("lost")).otherwise(F.col("line")))
    for wrong in (bad, lines.withColumn("file", F.lit("../out")), lines.withColumn("file", F.lit(None).cast("string"))):
        with pytest.raises(Exception):  # noqa: B017
            sink.write_lines(wrong, ["n"], str(tmp_path))
        assert os.listdir(tmp_path) == ["f1"] and (tmp_path / "f1").read_text() == "old\n"
    with pytest.raises(Exception, match="append"):
        lines.select("file", "line").write.format(sink.FORMAT).mode("overwrite").save(str(tmp_path))


def test_cluster_files(spark, tmp_path):
    assigned = spark.createDataFrame([(1, 1, 2, 3), (2, 1, 2, 3), (5, 1, 2, 3), (9, 9, 9, 1)], "struct_id long, cluster_id long, rep_id long, n_members long")
    structures = spark.createDataFrame([(k, f"s{k}", "ACDEF" * 3) for k in (1, 2, 5, 9)], "struct_id long, description string, seq string")
    reports.write_cluster_list(cluster_rows(assigned), str(tmp_path))
    reports.write_cluster_sequences(assigned, structures, str(tmp_path), width=10)
    assert (tmp_path / "clusters.lst").read_text() == "2 1 5\n9\n"
    assert (tmp_path / "cluster_9.fa").read_text() == ">s9\nACDEFACDEF\nACDEF\n"
    assert (tmp_path / "cluster_1.fa").read_text().split()[::3] == [">s2", ">s1", ">s5"]
