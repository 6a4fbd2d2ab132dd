from __future__ import annotations

import json
import os
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lake import LakeWriter, StructureLake, WriterConfig
from tessera.sources import pack
from tessera.sources.formats import text
from tessera.sources.schema import full_schema, load_schema, parse_type
from tessera.sources.table_log import TableLog
from tessera.streaming.spool import SpoolIngester, StagingWriter
from tests.structures import make

USER = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("sample_idx", T.IntegerType()),
        T.StructField("noise_seed", T.IntegerType()),
        T.StructField("rmsd", T.FloatType()),
    ]
)
N = 30


@pytest.fixture(scope="module")
def writer(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lake"))
    w = LakeWriter(spark, WriterConfig(path, USER, batch_size=15, shard_max_bytes=20_000))
    for i in range(N):
        atoms = make(noise=0.1, noise_seed=42 + i)
        heavy = {"pae": [[0.5, 2.0]], "plddt": [80.0]} if i % 2 else None
        got = w.write_cif(text.write_mmcif(atoms), {"name": "noisy", "sample_idx": i, "noise_seed": 42 + i, "rmsd": 0.17, "other": 1}, heavy)
        assert len(got["id_hex"]) == 64
    w.write_pdb(text.write_pdb(make()), {"name": "single", "sample_idx": 1001})
    w.finalize()
    return w


def test_schema():
    full = full_schema(USER)
    assert full.names[:2] == ["id", "id_hex"] and "json_len" in full.names and full.names[-1] == "rmsd"
    assert "json_len" not in full_schema(USER, False).names
    with pytest.raises(ValueError):
        full_schema(T.StructType([T.StructField("id_hex", T.StringType())]))


@pytest.mark.parametrize(
    ("spec", "want"),
    [
        ("int8", T.ByteType()),
        ({"list": "float32"}, T.ArrayType(T.FloatType())),
        ({"large_list": {"list": "string"}}, T.ArrayType(T.ArrayType(T.StringType()))),
        ({"timestamp": "us"}, T.TimestampNTZType()),
        ({"timestamp": {"unit": "ms", "tz": "UTC"}}, T.TimestampType()),
        ({"struct": [{"name": "a", "type": "bool"}]}, T.StructType([T.StructField("a", T.BooleanType())])),
    ],
)
def test_types(spec, want):
    assert parse_type(spec) == want


@pytest.mark.parametrize("spec", ["uint8", {"map": "int8"}, 3, {"timestamp": "h"}, {"list": "int8", "x": 1}])
def test_unknown_types(spec):
    with pytest.raises(ValueError):
        parse_type(spec)


def test_schema_files(tmp_path):
    fields = {"fields": [{"name": "name", "type": "string"}, {"name": "sample_idx", "type": "int32", "nullable": False}]}
    (tmp_path / "a.json").write_text(json.dumps(fields))
    (tmp_path / "a.yaml").write_text("fields:\n- {name: name, type: string}\n- {name: sample_idx, type: int32, nullable: false}\n")
    assert load_schema(str(tmp_path / "a.json")) == load_schema(str(tmp_path / "a.yaml"))
    for bad in ("{}", '{"fields": []}', '{"fields": [{"name": "x"}]}'):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(ValueError):
            load_schema(str(tmp_path / "b.json"))
    with pytest.raises(ValueError):
        load_schema("x.toml")


def test_rows_and_packs(writer):
    rows = writer.query().collect()
    assert len(rows) == N + 1 == writer.row_count()
    assert len({r["id_hex"] for r in rows}) == N + 1 and all(r["id"].hex() == r["id_hex"] for r in rows)
    assert len({r["bcif_shard"] for r in rows}) > 2
    plain = next(r for r in rows if r["name"] == "single")
    assert (plain["json_shard"], plain["json_len"]) == ("", 0) and plain["rmsd"] is None


def test_queries(writer):
    assert writer.check_exists({"name": "noisy", "sample_idx": 3})
    assert not writer.check_exists({"name": "noisy", "sample_idx": 1003})
    assert not writer.check_exists({"name": None})
    with pytest.raises(ValueError):
        writer.check_exists({})
    got = writer.query((F.col("name") == "noisy") & (F.col("sample_idx") < 5), ["name", "sample_idx"])
    assert got.columns == ["name", "sample_idx"] and got.count() == 5
    assert writer.query("sample_idx > 5000").count() == 0
    assert 0.05 < writer.query().agg(F.avg("rmsd")).first()[0] < 0.5


def test_complete(writer):
    keys = [{"name": "noisy", "sample_idx": i} for i in range(N - 5, N + 10)]
    ok, found, missing = writer.check_complete(keys)
    assert not ok and len(found) == 5 and len(missing) == 10
    assert writer.check_complete(keys[:5]) == (True, found, set())
    assert writer.check_complete(keys, ["name"])[0]
    assert writer.check_complete([{"name": "none", "sample_idx": 1}])[2] == {("none", 1)}
    with pytest.raises(ValueError):
        writer.check_complete([])


def test_index_cache(writer):
    lake = writer.lake
    with pytest.raises(ValueError):
        StructureLake(lake.spark, lake.path).load_row({"name": "x"})
    lake.load_index_cache(["name", "sample_idx"], {"sample_idx": [1, 2]})
    row = lake.load_row({"sample_idx": 2})
    assert set(row) == {"bcif_shard", "bcif_data_off", "bcif_len", "name", "sample_idx"}
    atoms = lake.load_atoms({"sample_idx": 2})
    assert len(atoms["x"]) == len(make()["x"])
    for bad in ({"name": "noisy"}, {}, {"nothing": 1}, {"sample_idx": 77}):
        with pytest.raises(ValueError):
            lake.load_row(bad)
    for more, filters in (("nothing", None), (None, {"name": []}), (None, {"name": "noisy"}), (None, {"nothing": [1]})):
        with pytest.raises(ValueError):
            lake.load_index_cache(more, filters)


def test_atoms_heavy_and_sequences(writer):
    lake = writer.lake
    some = lake.query("sample_idx = 1")
    assert lake.atoms(some).count() == len(make()["x"])
    assert json.loads(lake.heavy(some).first()["heavy"]) == {"pae": [[0.5, 2.0]], "plddt": [80.0]}
    assert lake.get_seq(some).first()["sequence"] == "ADFLDA"
    assert lake.get_seq(some, ["C"]).count() == 0


def test_export(writer, tmp_path):
    lake = writer.lake
    some = lake.query("sample_idx < 2")
    out = lake.extract_cif(some, str(tmp_path), ["name", "sample_idx"])
    assert sorted(os.listdir(tmp_path)) == ["noisy_0.cif", "noisy_1.cif"] and out.filter("error is not null").count() == 0
    cif = lake.extract_cif(lake.query("sample_idx = 1"), as_str=True)
    assert isinstance(cif, str) and len(text.read_mmcif(cif)["x"]) == len(make()["x"])
    r = lake.query("sample_idx = 1").first()
    again = lake.extract_cif(bcif_shard=r["bcif_shard"], bcif_data_off=r["bcif_data_off"], bcif_len=r["bcif_len"], file_names="a", as_str=True)
    assert again == cif
    for how in ({}, {"df": some, "file_names": "x", "as_str": True}, {"as_str": True}, {"as_str": True, "file_name_cols": "name"}, {"df": some.select("name"), "as_str": True}):
        with pytest.raises(ValueError):
            lake.extract_cif(**how)


def test_validation_finds_damage(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    ids = [w.write_bcif(bytes([i]) * 50, {"name": str(i)})["id_hex"] for i in range(4)]
    w.flush()
    rows = {r["id_hex"]: r for r in w.query().collect()}
    r = rows[ids[1]]
    file = f"{tmp_path}/shards/{r['bcif_shard']}"
    with open(file, "r+b") as f:
        f.seek(r["bcif_data_off"])
        f.write(b"\xff")
        last = rows[ids[3]]
        f.truncate(last["bcif_data_off"] + 10)
    bad = {x["id"].hex(): x["error"] for x in w.lake.validate_entries().collect()}
    assert set(bad) == {ids[1], ids[3]} and "checksum" in bad[ids[1]] and "short" in bad[ids[3]]


def test_pack_format(spark, tmp_path):
    w = pack.PackWriter(str(tmp_path), "p", 100)
    at = [w.append(p) for p in (b"a" * 10, b"b" * 80, b"c")]
    w.close()
    assert [a.off for a in at] == [0, 57, 0] and at[0].data_off == 43
    with open(f"{tmp_path}/{at[0].shard}", "rb") as f:
        assert struct.unpack(">4sBHI", f.read(11)) == (b"PACK", 1, 32, 10)
    pack.register(spark)
    rows = spark.read.format("pack").load(str(tmp_path)).orderBy("shard", "off").collect()
    assert [bytes(r["payload"]) for r in rows] == [b"a" * 10, b"b" * 80, b"c"] and all(r["crc_ok"] for r in rows)


def test_log_versions_conflicts_and_evolution(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, s string")
    with pytest.raises(RuntimeError):
        log.snapshot()
    log.create(df.schema)
    assert log.read().count() == 0
    v1 = log.append(df)
    wide = T.StructType([*df.schema.fields, T.StructField("x", T.DoubleType())])
    log.append(spark.createDataFrame([(3, 1.5, 9)], "k long, x double, unknown int"), wide)
    assert log.read(v1).columns == ["k", "s"] and log.read(v1).count() == 2
    assert [tuple(r) for r in log.read().orderBy("k").collect()] == [(1, "a", None), (2, None, None), (3, None, 1.5)]
    assert sum(log.snapshot().files.values()) == 3
    old = sorted(log.snapshot().files)
    log.rewrite("optimize", old, log.read())
    with pytest.raises(RuntimeError):
        log.rewrite("optimize", old, log.read())
    assert log.read().count() == 3
    log.vacuum()
    assert log.read().count() == 3


def test_concurrent_appends(spark, tmp_path):
    log = TableLog(spark, str(tmp_path / "t"))
    df = spark.range(25).withColumn("w", F.lit(0).cast("long"))
    log.create(df.schema)
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda w: TableLog(spark, log.path).append(df.withColumn("w", F.lit(w).cast("long"))), range(8)))
    assert log.version() == 8
    assert {tuple(r) for r in log.read().groupBy("w").count().collect()} == {(w, 25) for w in range(8)}


@pytest.fixture
def lake(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    # Rows 0 and 2 have equal names and contents, rows 1 and 3 equal names only; two names are null.
    for i, (name, data) in enumerate([("a", b"x"), ("b", b"y"), ("a", b"x"), ("b", b"z"), (None, b"u"), (None, b"v")]):
        w.write_bcif(data * 20, {"name": name, "sample_idx": i})
    w.flush()
    return w.lake


def left(lake):
    return sorted(r["sample_idx"] for r in lake.df().collect())


def test_delete(lake):
    lake.delete({"name": "b", "sample_idx": 3})
    assert left(lake) == [0, 1, 2, 4, 5]
    lake.delete({"name": "nothing"})
    assert left(lake) == [0, 1, 2, 4, 5]
    lake.delete({"name": None})
    assert left(lake) == [0, 1, 2]
    with pytest.raises(ValueError):
        lake.delete({})
    assert lake.df(1).count() == 6


def test_dedupe(lake):
    assert lake.dedupe_by("name", dry_run=True) == 3 and lake.nrow() == 6
    assert lake.dedupe_by("name") == 3
    assert left(lake) == [0, 1, 4]


def test_dedupe_compat_drops_originals_of_equal_content(lake):
    lake.dedupe_by("name", compat=True)
    assert left(lake) == [1, 4]


def test_merge(spark, lake):
    rows = {r["sample_idx"]: r["id_hex"] for r in lake.df().collect()}
    one = spark.createDataFrame([(rows[1], 0.5, None)], "id_hex string, score double, rmsd float")
    with pytest.raises(ValueError):
        lake.merge(one)
    with pytest.raises(ValueError):
        lake.merge(one.union(one), ignore_row_count=True)
    lake.merge(one, ignore_row_count=True)
    got = {r["sample_idx"]: r["score"] for r in lake.df().collect()}
    assert got == {0: None, 1: 0.5, 2: None, 3: None, 4: None, 5: None}


def test_maintenance_and_fasta(spark, lake, tmp_path):
    before = sorted(map(str, lake.df().collect()))
    lake.maintenance()
    assert sorted(map(str, lake.df().collect())) == before
    assert lake.to_fasta(str(tmp_path / "f")) is None
    seq = lake.df().select("id_hex", F.when(F.col("sample_idx") < 2, "AC").alias("sequence")).dropDuplicates(["id_hex"])
    lake.merge(seq, ignore_row_count=True)
    lake.to_fasta(str(tmp_path / "f"), ["name", "sample_idx"])
    lines = spark.read.text(str(tmp_path / "f")).collect()
    assert {r[0] for r in lines if r[0].startswith(">")} >= {">a_0", ">b_1"}
    with pytest.raises(ValueError):
        lake.to_fasta(str(tmp_path / "f"), "nothing")


def test_distributed_append(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    pdb = text.write_pdb(make())
    df = spark.range(12).select(F.lit(pdb).alias("payload"), F.lit("n").alias("name"), F.col("id").cast("int").alias("sample_idx"), F.lit('{"a": [1]}').alias("h")).repartition(3)
    w.append(df, form="pdb", heavy="h")
    assert w.row_count() == 12 and w.lake.validate_entries().count() == 0
    assert json.loads(w.lake.heavy(w.query("sample_idx = 3")).first()["heavy"]) == {"a": [1]}
    assert len({r["bcif_shard"] for r in w.query().collect()}) == 3


def test_missing_lake(spark, tmp_path):
    with pytest.raises(RuntimeError):
        StructureLake(spark, str(tmp_path / "none"))
    assert StructureLake(spark, str(tmp_path / "new"), create=True).nrow() == 0


def test_without_json_packs(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER, write_json_shards=False))
    w.write_bcif(b"x", {"name": "a"}, {"ignored": 1})
    w.flush()
    assert "json_shard" not in w.query().columns


def test_spool(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    spool = SpoolIngester(str(tmp_path), w)
    assert StagingWriter(str(tmp_path)).publish() is None
    s = StagingWriter(str(tmp_path))
    pdb = text.write_pdb(make())
    s.add(pdb, {"name": "staged", "sample_idx": 0})
    s.add(pdb, {"name": "staged", "sample_idx": 1}, {"pae": [[1.0, 2.0]]})
    assert s.entry_count == 2 and spool.run_once()["ingested_entries"] == 0
    assert s.publish()
    with pytest.raises(RuntimeError):
        s.publish()
    with pytest.raises(RuntimeError):
        s.add(pdb, {})
    assert spool.run_once() == {"ingested_entries": 2, "pending_entries": 0}
    assert spool.run_once() == {"ingested_entries": 0, "pending_entries": 0}
    rows = {r["sample_idx"]: r for r in w.query().collect()}
    assert rows[0]["id_hex"] == rows[1]["id_hex"] and rows[0]["json_len"] == 0 and rows[1]["json_len"] > 0
    s = StagingWriter(str(tmp_path))
    s.add(pdb, {"name": "more", "sample_idx": 2})
    s.publish()
    assert spool.run_once(run_maintenance=True)["ingested_entries"] == 1
    assert np.array_equal(sorted(r["sample_idx"] for r in w.query().collect()), [0, 1, 2])


def test_spool_checks_the_manifest(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    s = StagingWriter(str(tmp_path))
    for i in range(2):
        s.add(text.write_pdb(make()), {"name": "x", "sample_idx": i})
    (tmp_path / "spool" / "incoming" / s.name / "group-00001.json").unlink()
    s.publish()
    with pytest.raises(Exception, match="manifest"):
        SpoolIngester(str(tmp_path), w).run_once()
    assert w.row_count() == 0


def test_progress_of_validation(spark, tmp_path):
    from pyspark.sql import Observation

    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    w.append(spark.createDataFrame([(text.write_pdb(make()), "a", i) for i in range(3)], "payload string, name string, sample_idx int"), form="pdb")
    seen = Observation()
    assert w.lake.validate_entries(seen).count() == 0 and seen.get == {"scanned": 3, "invalid": 0}


def test_command_line(spark, tmp_path):
    """Scores against a folder and against one file, staged and merged, with a built-in score function."""
    from tessera import cli

    w = LakeWriter(spark, WriterConfig(str(tmp_path / "lake"), USER))
    w.append(spark.createDataFrame([(text.write_pdb(make(noise=0.1)), "d", 0)], "payload string, name string, sample_idx int"), form="pdb")
    (tmp_path / "designs").mkdir()
    design = tmp_path / "designs" / "d.pdb"
    design.write_text(text.write_pdb(make()))
    lake, staging = str(tmp_path / "lake"), str(tmp_path / "staging")
    plugins = ["--plugins", "lig_atom_dist", "--ligand_atom_distances", "LIG:C1_LIG:O1"]
    cli.main(["analyse", "--lake", lake, "--design-dir", str(design.parent), "--staging-path", staging, "--dont-merge", *plugins])
    assert "RMSD_CA" not in w.lake.df().columns
    cli.main(["analyse", "--lake", lake, "--staging-path", staging, "--merge-only"])
    row = w.lake.df().first()
    assert 0 < row["RMSD_CA"] < 1 and row["lig_atom_dist_LIG.C1_LIG.O1"] > 0 and row["score_error"] is None
    cli.main(["analyse", "--lake", lake, "--design-pdb", str(design), *plugins])
    assert w.lake.df().first()["RMSD_CA"] == pytest.approx(row["RMSD_CA"])
    with pytest.raises(SystemExit):
        cli.main(["analyse", "--lake", lake])


def test_spool_after_a_crash_between_commit_and_checkpoint(spark, tmp_path):
    """A batch that the table has is not stored again, though the stream's checkpoint doesn't know of it."""
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER))
    spool = SpoolIngester(str(tmp_path), w)
    pdb = text.write_pdb(make())
    for i in range(2):
        s = StagingWriter(str(tmp_path))
        s.add(pdb, {"name": "one", "sample_idx": i})
        s.publish()
        assert spool.run_once()["ingested_entries"] == 1
    last = max(os.listdir(tmp_path / "spool" / "_checkpoint" / "commits"))
    for f in (last, f".{last}.crc"):
        path = tmp_path / "spool" / "_checkpoint" / "commits" / f
        if path.exists():
            path.unlink()
    w.append(spark.createDataFrame([(pdb, "between", 9)], "payload string, name string, sample_idx int"), form="pdb")
    assert SpoolIngester(str(tmp_path), w).run_once()["ingested_entries"] == 0 and w.row_count() == 3


def test_vacuum_spares_files_of_running_writers(spark, tmp_path):
    log = StructureLake(spark, str(tmp_path), create=True).log
    files = log.write_files(log.read(), log.snapshot().schema) or {}
    df = spark.range(3).select(F.lit("x").alias("id_hex"))
    files = log.write_files(df, log.snapshot().schema)
    assert log.vacuum() == []
    log.commit("append", files)
    assert log.read().count() == 3


def test_serializers_of_distributed_writes(spark, tmp_path):
    w = LakeWriter(spark, WriterConfig(str(tmp_path), USER, light_serializer=lambda d: d | {"name": d["name"].upper()}, heavy_serializer=lambda d: d | {"more": 1}))
    pdb = text.write_pdb(make())
    w.append(spark.createDataFrame([(pdb, "low", 1, "{}")], "payload string, name string, sample_idx int, h string"), form="pdb", heavy="h")
    assert w.query().first()["name"] == "LOW" and json.loads(w.lake.heavy(w.query()).first()["heavy"]) == {"more": 1}
