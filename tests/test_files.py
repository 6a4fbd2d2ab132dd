from __future__ import annotations

import pytest
from pyspark.sql import types as T

from tessera.operators import geometry as g
from tessera.operators.lake import LakeWriter, WriterConfig
from tessera.plans.analysis import single_design
from tessera.sources import files
from tessera.sources.formats import text
from tests.structures import make


def test_directories(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    for d in "ab":
        (tmp_path / d / "x.cif").write_text(text.write_mmcif(make()))
    (tmp_path / "a" / "y.v2.pdb").write_text(text.write_pdb(make()))
    found = {r["name"]: r for r in files.index_files(spark, str(tmp_path)).collect()}
    assert set(found) == {"x", "y.v2"} and found["x"]["n_paths"] == 2 and found["x"]["path"].endswith("/a/x.cif")
    read = files.read_structures(spark, str(tmp_path), "*.pdb")
    assert read.first()["form"] == "pdb" and read.first()["name"] == "y.v2"
    assert files.structure_atoms(read).count() == len(make()["x"])


def test_canonical_order(spark):
    names = ["CD2", "O", "CB", "OXT", "N", "CD1", "CA", "CG", "C"]
    rows = [("s", i, "A", 1, False, n) for i, n in enumerate(names, 5)] + [("s", 20, "B", 1, True, "C2"), ("s", 21, "B", 1, True, "C1")]
    atoms = spark.createDataFrame(rows, "struct_id string, atom_idx int, chain_id string, res_id int, hetero boolean, atom_name string")
    got = [r["atom_name"] for r in g.canonical_order(atoms).orderBy("atom_idx").collect()]
    assert got == ["N", "CA", "C", "O", "CB", "CG", "CD1", "CD2", "OXT", "C2", "C1"]


def test_dump_and_single_design(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path / "lake"), T.StructType([T.StructField("name", T.StringType())])))
    w.write_pdb(text.write_pdb(make()), {"name": "a"})
    w.flush()
    for how in ({"keys": {"name": "a"}}, {"seed": 1}, {}):
        assert len(text.read_mmcif(w.lake.dump_cif(path=str(tmp_path / "d.cif"), **how))["x"]) == len(make()["x"])
    with pytest.raises(ValueError):
        w.lake.dump_cif({"name": "z"}, str(tmp_path / "d.cif"))
    assert [tuple(r) for r in single_design(w.query(), "D").collect()] == [("a", "D")]
