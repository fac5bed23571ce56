import gzip
import io
import tarfile

import pytest
from pyspark.sql import functions as F

from strandlake.options import ReadOptions
from strandlake.sources import files as S
from strandlake.sources.datasource import StructureSource
from strandlake.sources.parse import structures


def atom(k, chain="A", x=0.0, name=" CA ", res="ALA", alt=" ", kind="ATOM  ", num=None):
    return f"{kind}{k:5d} {name}{alt}{res} {chain}{num or k:4d}    {x:8.3f}{k * 3.8:8.3f}{0.0:8.3f}  1.00  0.00"


def pdb(n=25, **kw):
    return "\n".join(atom(k, x=k % 2, **kw) for k in range(1, n + 1))


def cif(n=25):
    head = ["data_x", "loop_"] + [f"_atom_site.{c}" for c in ("group_PDB", "id", "label_atom_id", "label_alt_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "pdbx_PDB_ins_code", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num")]
    return "\n".join(head + [f"ATOM {k} CA . ALA A {k} ? {k % 2:.3f} {k * 3.8:.3f} 0.000 1" for k in range(1, n + 1)] + ["#"])


def test_segmentation():
    two = pdb(20) + "\nTER\n" + pdb(20, chain="B") + "\nEND"
    assert [len(s.atoms) for s in structures("a.pdb", two.encode(), ReadOptions())] == [20]
    assert [(s.chain, len(s.atoms)) for s in structures("a.pdb", two.encode(), ReadOptions(ter=0, split=2))] == [("A", 20), ("B", 20)]
    assert [len(x.atoms) for x in structures("a.pdb", two.encode(), ReadOptions(ter=2))] == [20]
    assert [len(x.atoms) for x in structures("a.pdb", (pdb(20) + "\nTER\n" + atom(21)).encode(), ReadOptions(ter=2))] == [21]
    assert [len(x.atoms) for x in structures("a.pdb", two.encode(), ReadOptions(ter=1))] == [40]
    models = "MODEL 1\n" + pdb(20) + "\nENDMDL\nMODEL 2\n" + pdb(20) + "\nENDMDL"
    assert [s.model for s in structures("a.pdb", models.encode(), ReadOptions(ter=0, split=1))] == ["1", "2"]
    assert len(structures("a.pdb", models.encode(), ReadOptions())) == 1


def test_atoms_that_do_not_count():
    text = pdb(20) + "\n" + atom(21, alt="B") + "\n" + atom(22, name=" CB ") + "\n" + atom(23, kind="HETATM")
    assert len(structures("a.pdb", text.encode(), ReadOptions())[0].atoms) == 20
    assert len(structures("a.pdb", text.encode(), ReadOptions(hetatm=True))[0].atoms) == 21


def test_nucleic_by_vote():
    text = "\n".join(atom(k, name=" C3'", res="  U" if k % 2 else " DA") for k in range(1, 22))
    row = structures("a.pdb", text.encode(), ReadOptions())[0].row(ReadOptions())
    assert row["mol_type"] == "NA" and row["seq"][0] == "U"
    assert structures("a.pdb", text.encode(), ReadOptions())[0].row(ReadOptions(mol="Protein"))["mol_type"] == "Protein"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    (d / "one.pdb").write_text(pdb())
    (d / "two.cif").write_text(cif())
    (d / "three.ent.gz").write_bytes(gzip.compress(pdb().encode()))
    with tarfile.open(d / "four.tar", "w") as t:
        for name, data in (("m/five.pdb", pdb().encode()), ("six.cif.gz", gzip.compress(cif().encode())), ("tiny.pdb", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    (d / "bad.pdb").write_text(atom(1).replace("3.800", "3.8x0"))
    (d / "short.pdb").write_text(pdb(19))
    (d / ".hidden.pdb").write_text(pdb())
    deep = d / "a" / "b" / "c" / "d"
    deep.mkdir(parents=True)
    (deep / "deep.pdb").write_text(pdb())
    return d


def test_every_container_gives_the_same_structure(spark, folder):
    got = S.read_structures(spark, str(folder)).collect()
    assert len(got) == 5
    assert {(r.mol_type, r.length, r.seq, tuple(r.x), tuple(r.y)) for r in got} == {("Protein", 25, "A" * 25, tuple(float(k % 2) for k in range(1, 26)), tuple(round(k * 3.8, 3) for k in range(1, 26)))}
    assert len({r.struct_id for r in got}) == 5 and any(":m/five.pdb Chn:A" in r.description for r in got)
    parsed = S.parse_files(S.catalog(spark, str(folder)))
    assert parsed.where("error is not null").count() == 1
    assert S.read_structures(spark, str(folder), ReadOptions(suffixes=(".cif",))).count() == 1


def test_saved_structures_come_back(spark, folder, tmp_path):
    df = S.read_structures(spark, str(folder))
    S.save(df, str(tmp_path / "s"))
    assert S.load(spark, str(tmp_path / "s")).exceptAll(df).isEmpty()


def test_input_list():
    assert S.input_list("b, a,b") == ["a", "b"]
    with pytest.raises(ValueError):
        S.input_list("a,,b")


def test_data_source(spark, folder):
    spark.dataSource.register(StructureSource)
    df = spark.read.format("structures").option("suffixes", ".pdb,.cif").load(str(folder))
    assert df.where(F.col("length") == 25).count() == 2  # the folder of depth four is too deep
    bad = df.where("error is not null").collect()
    assert [r.source_path.rsplit("/", 1)[1] for r in bad] == ["bad.pdb"] and "ValueError" in bad[0].error
    assert spark.read.format("structures").option("mode", "dropmalformed").load(str(folder)).where("error is not null").count() == 0


def test_data_source_takes_several_roots_and_all_reading_options(spark, folder):
    spark.dataSource.register(StructureSource)
    twice = spark.read.format("structures").option("suffixes", ".pdb,.cif").load(f"{folder},{folder}")
    once = spark.read.format("structures").option("suffixes", ".pdb,.cif").load(str(folder))
    assert twice.count() == once.count() > 2
    reader = StructureSource({"path": str(folder), "aatom": " CB ", "natom": " P  ", "mol": "NA", "hetatm": "true"}).reader(None)
    assert reader.options == ReadOptions(aatom=" CB ", natom=" P  ", mol="NA", hetatm=True)
    assert once.where("error is null").count() > spark.read.format("structures").option("suffixes", ".pdb,.cif").option("aatom", " XX ").load(str(folder)).where("error is null and length > 3").count()


def test_members_of_a_tar_are_partitions(spark, folder):
    reader = StructureSource({"path": str(folder / "four.tar"), "partitions": "2"}).reader(None)
    parts = reader.partitions()
    assert sorted(p[1] for part in parts for p in part.pieces) == ["m/five.pdb", "six.cif.gz"] and len(parts) == 2
    rows = [dict(zip(StructureSource.schema(None).replace(" ", "_").split(",_"), r)) for part in parts for r in reader.read(part)]
    assert len(rows) == 2 and {r["seq_string"] for r in rows} == {"A" * 25}


def test_rows_of_a_loop_over_lines_and_quotes():
    whole = structures("a.cif", cif().encode(), ReadOptions())[0].row(ReadOptions())
    broken = cif().replace(" ALA A", " ALA\n  A").replace("ATOM 3 CA", "ATOM 3 'CA'")
    assert structures("a.cif", broken.encode(), ReadOptions())[0].row(ReadOptions()) == whole
    assert structures("a.cif", cif().replace("ATOM 5 CA .", "ATOM 5 CA ?").encode(), ReadOptions())[0].row(ReadOptions())["length"] == 24
    both = cif().replace("_atom_site.auth_asym_id", "_atom_site.auth_comp_id\n_atom_site.auth_asym_id").replace(" ALA A", " ALA GLY A")
    assert structures("a.cif", both.encode(), ReadOptions())[0].row(ReadOptions())["seq"] == "A" * 25
    with pytest.raises(ValueError, match="Cartn_z"):
        structures("a.cif", cif().replace("_atom_site.Cartn_z\n", "").encode(), ReadOptions())


def test_a_file_that_several_items_name_counts_once(spark, folder):
    paths = [r.path for r in S.catalog(spark, f"{folder},{folder}/a,{folder}/one.pdb", content=False).select("path").collect()]
    assert len(paths) == len(set(paths)) and sum(p.endswith("one.pdb") for p in paths) == 1 and any(p.endswith("deep.pdb") for p in paths)
    plan = S.catalog(spark, f"{folder},{folder}/a")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_cache_knows_its_files_and_parameters(spark, folder, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "one.pdb").write_text(pdb())
    cache = str(tmp_path / "cache")
    first = S.cached_structures(spark, str(d), cache)
    assert first.count() == 1 and len(list((tmp_path / "cache").iterdir())) == 1
    assert S.cached_structures(spark, str(d), cache).count() == 1 and len(list((tmp_path / "cache").iterdir())) == 1
    assert S.cached_structures(spark, str(d), cache, least=26).count() == 0
    (d / "two.pdb").write_text(pdb())
    assert S.cached_structures(spark, str(d), cache).count() == 2


def test_stream_of_files(spark, folder, tmp_path):
    from strandlake.options import SearchOptions
    from strandlake.streaming.ingest import arriving_structures, search_arrivals

    refs = S.read_structures(spark, str(folder / "one.pdb")).cache()
    q = search_arrivals(arriving_structures(spark, str(folder)), refs, str(tmp_path / "out"), str(tmp_path / "ck"), SearchOptions().at_speed(13))
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.where("tmscore_refn > 0.99").count() >= 5


def test_structure_files_have_no_folder_of_their_own(spark, tmp_path):
    import os

    side = "struct_id long, mol_type string, seq string, x array<double>, y array<double>, z array<double>"
    rows = [(k, "Protein", "ACD", [1.0, 2.0, 3.5 + k], [0.0, 1.0, 2.0], [-1.0, 0.0, 1.0]) for k in range(9)]
    for _ in range(2):  # what is written again is the same
        assert S.write_structures(spark.createDataFrame(rows, side), str(tmp_path)) == str(tmp_path)
        assert sorted(os.listdir(tmp_path / "pdb")) == [f"sid={k}.pdb" for k in (1, 3, 5, 7)]
        assert sorted(os.listdir(tmp_path / "cif")) == [f"sid={k}.cif.gz" for k in (0, 2, 4, 6, 8)]
    lines = (tmp_path / "pdb" / "sid=3.pdb").read_text().split("\n")
    assert len(lines) == 6 and lines[0].startswith("MODEL") and lines[4:] == ["TER", ""]
    assert gzip.decompress((tmp_path / "cif" / "sid=2.cif.gz").read_bytes()).startswith(b"data_x\nloop_\n")
