from __future__ import annotations

import math
from argparse import ArgumentParser, Namespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import checks, scores, tables
from tessera.operators import geometry as g
from tessera.plans import analysis
from tests.structures import make

ATOMS = "struct_id string, atom_idx int, chain_id string, res_id int, ins_code string, res_name string, hetero boolean, atom_name string, element string, x double, y double, z double, b_factor double"


def rows(name, atoms):
    keys = ["chain_id", "res_id", "ins_code", "res_name", "hetero", "atom_name", "element", "x", "y", "z", "b_factor"]
    return [(name, i, *v) for i, v in enumerate(zip(*(atoms[k] for k in keys), strict=True))]


def frame(spark, structures):
    return spark.createDataFrame([r for n, a in structures.items() for r in rows(n, a)], ATOMS).repartition(2)


def xyz(atoms):
    return np.array([atoms["x"], atoms["y"], atoms["z"]]).T


def turned(atoms, seed=3, noise=0.2):
    """The structure, rotated, shifted and with noise."""
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    p = (xyz(atoms) + rng.normal(0, noise, xyz(atoms).shape)) @ q.T + [10, -5, 3]
    return atoms | {"x": p[:, 0].tolist(), "y": p[:, 1].tolist(), "z": p[:, 2].tolist()}


def kabsch(fixed, mobile, every):
    return scores.fit(fixed, mobile, every)


@pytest.fixture(scope="module")
def pair(spark):
    d = make()
    p = turned(d)
    atoms = frame(spark, {"d": d, "p": p})
    keys = spark.createDataFrame([("d|p", "d", "p")], "pair_id string, fixed_id string, mobile_id string")
    return d, p, g.pair_atoms(atoms, atoms, keys).cache()


def test_rmsd_and_superposition(pair):
    d, p, pairs = pair
    plain = math.sqrt(((xyz(d) - xyz(p)) ** 2).sum(1).mean())
    assert g.rmsd(pairs).first()["rmsd"] == pytest.approx(plain)
    ca = np.array([a == "CA" for a in d["atom_name"]])
    moved = kabsch(xyz(d)[ca], xyz(p)[ca], xyz(p))
    want = math.sqrt(((xyz(d) - moved) ** 2).sum(1).mean())
    fitted = g.superpose(pairs, F.col("atom_name") == "CA")
    assert g.rmsd(fitted).first()["rmsd"] == pytest.approx(want)
    assert want < plain
    a, b = (x - x.mean(0) for x in (xyz(d)[ca], xyz(p)[ca]))
    s = np.linalg.svd(a.T @ b)[1] * [1, 1, np.sign(np.linalg.det(a.T @ b))]
    assert g.rmsd(fitted, F.col("atom_name") == "CA").first()["rmsd"] == pytest.approx(math.sqrt(max(0.0, (a**2).sum() + (b**2).sum() - 2 * s.sum()) / ca.sum()), abs=1e-6)


def brute_automorphic(d, p):
    """Every residue with and without its exchange."""
    total, n = 0.0, len(d["x"])
    residues = {}
    for i in range(n):
        residues.setdefault((d["chain_id"][i], d["res_id"][i]), []).append(i)
    for at in residues.values():
        name = d["res_name"][at[0]]
        own = sum(((xyz(d)[i] - xyz(p)[i]) ** 2).sum() for i in at)
        order = {i: i for i in at}
        for a, b in g.SWAPS.get(name, ()):
            i, j = (next(k for k in at if d["atom_name"][k] == x) for x in (a, b))
            order[i], order[j] = j, i
        total += min(own, sum(((xyz(d)[i] - xyz(p)[order[i]]) ** 2).sum() for i in at))
    return math.sqrt(total / n)


def test_automorphic(spark):
    d = make(ligand=False)
    p = make(ligand=False, noise=0.3)
    flip = {"OD1": "OD2", "OD2": "OD1", "CD1": "CD2", "CD2": "CD1", "CE1": "CE2", "CE2": "CE1"}
    where = {(r, a): i for i, (r, a) in enumerate(zip(p["res_id"], p["atom_name"], strict=True))}
    source = [where[r, flip.get(a, a)] if r in (2, 3) else i for i, (r, a) in enumerate(zip(p["res_id"], p["atom_name"], strict=True))]
    p = p | {c: [p[c][i] for i in source] for c in "xyz"}
    atoms = frame(spark, {"d": d, "p": p})
    pairs = g.pair_atoms(atoms, atoms, spark.createDataFrame([("x", "d", "p")], "pair_id string, fixed_id string, mobile_id string"))
    want = brute_automorphic(d, p)
    assert g.automorphic_rmsd(pairs).first()["rmsd"] == pytest.approx(want)
    assert want < g.rmsd(pairs).first()["rmsd"]
    as_frame = lambda a: pd.DataFrame({k: a[k] for k in ("chain_id", "res_id", "res_name", "atom_name", "x", "y", "z")})
    assert scores.automorphic(as_frame(d), as_frame(p)) == pytest.approx(want)
    less = pairs.filter("not (res_id = 2 and atom_name = 'OD2')")
    with pytest.raises(Exception, match="symmetric atom"):
        g.automorphic_rmsd(less).collect()
    assert g.automorphic_rmsd(less, ignore_missing=True).count() == 1
    short = as_frame(d)[lambda x: x["atom_name"] != "OD2"]
    with pytest.raises(ValueError):
        scores.automorphic(short, short)


def test_neighbours_and_masks(spark):
    d = make()
    atoms = frame(spark, {"d": d})
    h = np.array(d["hetero"])
    near = (np.linalg.norm(xyz(d)[:, None] - xyz(d)[None, h], axis=2).min(1) <= 3.0) & ~h
    got = g.near_hetero(atoms, 3.0)
    assert {r["atom_idx"] for r in got.collect()} == set(np.flatnonzero(near))
    residues = {(d["chain_id"][i], d["res_id"][i]) for i in np.flatnonzero(near)}
    whole = g.expand_to_residues(atoms, got)
    assert {r["atom_idx"] for r in whole.collect()} == {i for i in range(len(h)) if (d["chain_id"][i], d["res_id"][i]) in residues}
    assert not {r["atom_name"] for r in g.side_chains(atoms.filter("not hetero")).collect()} & set(g.BACKBONE)
    assert g.near_hetero(atoms.filter("not hetero")).count() == 0


def test_mutations(spark):
    atoms = frame(spark, {"s": make(ligand=False)})
    other = frame(spark, {"s": make(("ALA", "ASP", "LEU", "LEU", "ASP", "ALA"), ligand=False)})
    common = {(r["res_id"], r["atom_name"]) for r in g.common_residues(atoms, other).collect()}
    assert (3, "CA") in common and (3, "CB") not in common and (4, "CB") in common
    translated = {(r["res_id"], r["atom_name"]) for r in g.translate_mask(atoms.filter("res_id in (3, 4)"), other).collect()}
    assert (3, "CA") in translated and (3, "CB") not in translated and (4, "CD1") in translated and (5, "CA") not in translated


def test_names_and_renames(spark):
    df = spark.createDataFrame([("A10,B12-14,35", 1), ("12", 2)], "contig string, id int")
    got = sorted(tuple(r) for r in names.expand_contigs(df).collect())
    assert got == [(1, "A", 10), (1, "A", 35), (1, "B", 12), (1, "B", 13), (1, "B", 14), (2, "A", 12)]
    assert names.expand_contig("A10,B12-14,35,A10") == [("A", 10), ("A", 35), ("B", 12), ("B", 13), ("B", 14)]
    with pytest.raises(ValueError):
        names.expand_contig("x-")
    atoms = spark.createDataFrame([("A", "X"), ("B", "X"), ("C", "Y")], "res_name string, atom_name string")
    assert [r[0] for r in names.rename_residues(atoms, ["A=B", "B=C"]).collect()] == ["C", "C", "C"]
    assert [tuple(r) for r in names.rename_residue_atoms(atoms, ["A:Z=X:Q,Q:R"]).collect()] == [("Z", "R"), ("B", "X"), ("C", "Y")]
    out = spark.createDataFrame([(1, None, "a.cif")], "n int, m int, f string").select(names.joined_name(["n", "m"]), names.with_suffix(F.col("f")), names.first_parts(F.lit("a_b_c"), 2))
    assert tuple(out.first()) == ("1_None", "a.cif", "a_b")


def test_contigs_of_one_file(spark, tmp_path):
    """They are expanded by several tasks, and aggregates take a row for each 64 residues of a range."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    contigs = [f"A{i}-{i + 6399}, B62-65,{i + 7000},B127-128,A9-5,z2147483647" for i in range(20)]
    contigs += ["7,A3-70", "A60-63,A64,A66,A191-193", "B5-5,b5", None]
    data = [(None if i == 19 else i % 21, c) for i, c in enumerate(contigs)]
    spark.createDataFrame(data, "low int, chains string").coalesce(1).write.parquet(str(tmp_path / "c"))
    want = {(k, *r) for k, c in data if c for r in names.expand_contig(c)}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = names.expand_contigs(spark.read.parquet(str(tmp_path / "c")), "chains", "low")
        got = df.toArrow().to_pydict()
        plan = list(nodes(df._jdf.queryExecution().executedPlan()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert list(got) == ["low", "chain", "res"] and len(got["res"]) == len(want) and set(zip(*got.values(), strict=True)) == want
    assert all(p.outputPartitioning().numPartitions() > 1 for p in plan if p.nodeName() in ("Generate", "HashAggregate"))
    held = [p.metrics().apply("numOutputRows").value() for p in plan if p.nodeName() == "HashAggregate"]
    assert len(held) == 2 and max(held) < len(want) / 30


def test_table_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "k long, s string")
    assert sorted(r["k"] for r in tables.keep_first(df, "s", ["k"]).collect()) == [1, 3]
    assert sorted(r["k"] for r in tables.later_duplicates(df, "s", ["k"]).collect()) == [2, 4]
    assert tables.delete_where(df, checks.equals({"s": "a"})).count() == 2
    runs = spark.createDataFrame([(i, v) for i, v in enumerate("aabba")], "i long, v string").withColumn("p", F.lit(0))
    assert [r["run"] for r in tables.runs(runs, "v", ["p"], ["i"]).orderBy("i").collect()] == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        tables.assert_unique(df, "s")
    with pytest.raises(ValueError):
        tables.assert_same_count(df, df.limit(1))
    assert checks.first_row(df, {"s": "a"}, ["k"])["k"] == 1 and checks.first_row(df, {"s": "z"}) is None


def inputs(spark):
    d = make()
    p = turned(d)
    two = make(("ALA", "ASP", "LEU", "LEU", "ASP", "ALA"))
    designs = spark.createDataFrame([("x", "D1"), ("y", "D2")], "name string, design_id string")
    predictions = spark.createDataFrame([("P1", "x", 0, 1), ("P2", "y", 0, 1), ("P3", "none", 0, 1)], "id_hex string, name string, sample int, seed int")
    return d, p, designs, predictions, frame(spark, {"D1": d, "D2": two}), frame(spark, {"P1": p, "P2": make(), "P3": d})


def test_analysis_of_atoms_without_counterparts(spark):
    """A residue less, a ligand atom of another name, a terminal oxygen more, an inserted residue."""
    d = make()
    only = lambda atoms, f: {k: [v for v, *at in zip(atoms[k], atoms["res_id"], atoms["atom_name"], atoms["hetero"], strict=True) if f(*at)] for k in atoms}
    shorter = only(d, lambda r, a, h: r != 6 or h)
    renamed = d | {"atom_name": ["C9" if a == "C1" else a for a in d["atom_name"]]}
    ends = {k: [*v, {"atom_name": "OXT", "element": "O", "res_id": 6, "res_name": "ALA", "chain_id": "A", "hetero": False, "ins_code": "", "b_factor": 1.0}.get(k, 0.0)] for k, v in d.items()}
    names_ = ["shorter", "renamed", "ends"]
    designs = spark.createDataFrame([(n, "D") for n in names_], "name string, design_id string")
    predictions = spark.createDataFrame([(n, n, 0, 1) for n in names_], "id_hex string, name string, sample int, seed int")
    atoms = frame(spark, {"shorter": shorter, "renamed": renamed, "ends": ends})
    got = {r["id_hex"]: r for r in analysis.analyse(predictions, designs, atoms, frame(spark, {"D": d})).collect()}
    assert set(got) == {"renamed", "ends"}
    assert got["renamed"]["pLDDT_AA"] == pytest.approx(np.mean(d["b_factor"])) and got["ends"]["pLDDT_AA"] == pytest.approx(np.mean(d["b_factor"]))
    h = np.array(d["hetero"])
    close = (np.linalg.norm(xyz(d)[:, None] - xyz(d)[h][None], axis=2).min(axis=1) <= g.RADIUS) & ~h
    residues = {(c, r) for c, r, x in zip(d["chain_id"], d["res_id"], close, strict=True) if x}
    side = [b for b, c, r, x, a in zip(d["b_factor"], d["chain_id"], d["res_id"], h, d["atom_name"], strict=True) if not x and (c, r) in residues and a not in g.BACKBONE]
    assert got["renamed"]["pLDDT_SC_around_lig"] == pytest.approx(np.mean(side))
    loose = {r["id_hex"]: r for r in analysis.analyse(predictions, designs, atoms, frame(spark, {"D": d}), seq_mismatch=True).collect()}
    assert loose["shorter"]["pLDDT_AA"] == pytest.approx(np.mean(shorter["b_factor"]))
    coded = d | {"ins_code": ["A" if r == 6 else x for r, x in zip(d["res_id"], d["ins_code"], strict=True)], "res_id": [5 if r == 6 else r for r in d["res_id"]]}
    two = [frame(spark, {"x": coded}).withColumnRenamed("struct_id", "pair_id") for _ in range(2)]
    assert analysis.aligned(*two).count() == len(d["x"]) and analysis.mismatched(*two).count() == 0


def test_analysis(spark):
    d, p, designs, predictions, d_atoms, p_atoms = inputs(spark)
    got = {r["id_hex"]: r.asDict() for r in analysis.analyse(predictions, designs, p_atoms, d_atoms, source_version=7).collect()}
    assert set(got) == {"P1"}
    r = got["P1"]
    ca = np.array([a == "CA" for a in d["atom_name"]])
    moved = kabsch(xyz(d)[ca], xyz(p)[ca], xyz(p))
    b, h = np.array(d["b_factor"]), np.array(d["hetero"])
    assert r["pLDDT_CA"] == pytest.approx(b[ca].mean()) and r["pLDDT_AA"] == pytest.approx(b.mean())
    assert r["pLDDT_LIG_LIG"] == pytest.approx(b[h].mean())
    assert r["RMSD_CA"] == pytest.approx(math.sqrt(((xyz(d) - moved)[ca] ** 2).sum(1).mean()))
    keep = {k: [v for v, x in zip(d[k], h, strict=True) if not x] for k in d}
    mine = keep | {c: moved[~h, i].tolist() for i, c in enumerate("xyz")}
    assert r["RMSD_AA"] == pytest.approx(brute_automorphic(keep, mine))
    assert r["RMSD_SC_around_lig"] is not None and 0 < r["pLDDT_SC_around_lig"] < 100 and r["analysis_source_version"] == 7
    both = analysis.analyse(predictions, designs, p_atoms, d_atoms, seq_mismatch=True)
    assert {r["id_hex"] for r in both.collect()} == {"P1", "P2"}
    with pytest.raises(ValueError):
        analysis.analyse(predictions, designs, p_atoms, d_atoms, rename_residues=["A=B"], rename_atoms=["A:B=C:D"])
    with pytest.raises(ValueError):
        analysis.join_designs(predictions, designs, required=True)
    with pytest.raises(ValueError):
        analysis.join_designs(predictions, designs.union(designs))


def side(atoms):
    return pd.DataFrame({"atom_idx": range(len(atoms["x"]))} | {k: atoms[k] for k in ("chain_id", "res_id", "res_name", "hetero", "atom_name", "x", "y", "z", "b_factor")})


def test_ligand_scores():
    d = make()
    p = make()
    c1, c2 = (next(i for i, a in enumerate(p["atom_name"]) if a == x) for x in ("C1", "C2"))
    for c in "xyz":
        p[c][c1], p[c][c2] = p[c][c2], p[c][c1]
    s = scores.ScoreInput(side(d), side(p), {"name": "x_1_z"}, {}, Namespace())
    names_ = ["C1", "C2", "O1", "O2"]
    assert scores.ligand_rmsd(s, {"LIG:LIG": names_}, {})["RMSD_lig_LIG:LIG"] > 0.5
    assert scores.ligand_rmsd(s, {"LIG:LIG": names_}, {"LIG:LIG": [("C1", "C2")]})["RMSD_lig_LIG:LIG"] == pytest.approx(0)
    assert scores.ligand_rmsd(s, {"ABC:LIG": names_}, {}) == {}
    less = scores.ScoreInput(side(d), side(p)[lambda x: x["atom_name"] != "O2"], {}, {}, Namespace())
    assert math.isnan(scores.ligand_rmsd(less, {"LIG:LIG": names_}, {})["RMSD_lig_LIG:LIG"])
    assert scores.ligand_rmsd(less, {"LIG:LIG": names_}, {}, partial=True)["RMSD_lig_LIG:LIG"] > 0
    dist = scores.ligand_atom_distance(s, ["LIG:C1_LIG:O1"])["lig_atom_dist_LIG.C1_LIG.O1"]
    assert dist == pytest.approx(np.linalg.norm(xyz(p)[c1] - xyz(p)[[a == "O1" for a in p["atom_name"]].index(True)]))
    assert scores.ligand_atom_distance(s, None) == {}
    with pytest.raises(ValueError):
        scores.ligand_atom_distance(s, ["LIG:C1_LIG:ZZ"])


def test_motif_scores(tmp_path):
    import sqlite3

    from tessera.sources.formats import msgpack

    d = make()
    s = scores.ScoreInput(side(d), side(turned(d, noise=0.0)), {"name": "x_1_z"}, {}, Namespace())
    got = scores.motif_rmsd(s, "A1-4", align=True)
    assert got["motif_rmsd_AA"] == pytest.approx(0, abs=1e-6) and got["motif_rmsd_CA"] == pytest.approx(0, abs=1e-6)
    assert scores.motif_rmsd(s, "2-3")["motif_rmsd_AA"] > 1
    with sqlite3.connect(tmp_path / "m.db") as db:
        db.execute("create table maps(name text, data blob)")
        db.execute("insert into maps values (?, ?)", ("x_1", msgpack.packb({"A2": "A2", "A3": "A3", "A4": "A4"})))
    maps = scores.read_motif_maps(str(tmp_path / "m.db"))
    got = scores.mapped_motif_rmsd(s, maps, 2)
    parts = [got[f"diff_motif_rmsd_A{i}"] for i in (2, 3, 4)]
    assert got["diff_motif_rmsd_overall"] == pytest.approx(math.sqrt(np.mean(np.square(parts))))
    assert scores.mapped_motif_rmsd(s, maps, 2, align=True)["diff_motif_rmsd_overall"] == pytest.approx(0, abs=1e-6)
    with pytest.raises(ValueError):
        scores.mapped_motif_rmsd(s, maps, 1)


def test_plugins(spark, tmp_path):
    (tmp_path / "_hidden.py").write_text("raise RuntimeError")
    (tmp_path / "atoms.py").write_text(
        "COLUMNS = 'n_atoms int, note string'\ndef register_args(p):\n    p.add_argument('--note', default='n')\ndef score(s):\n    return {'n_atoms': len(s.design), 'note': s.args.note + s.meta['name'], 'unknown': 1}\n"
    )
    (tmp_path / "fails.py").write_text("def score(s):\n    raise ValueError('no')\n")
    registry, parser = scores.Registry(), ArgumentParser()
    with pytest.raises(ValueError):
        (tmp_path / "none.py").write_text("x = 1\n")
        registry.load(str(tmp_path), ["none"])
    functions = registry.load(str(tmp_path), ["atoms", "fails"], parser)
    d, _, designs, predictions, d_atoms, p_atoms = inputs(spark)
    out = analysis.analyse(predictions, designs, p_atoms, d_atoms, functions, parser.parse_args(["--note", "z"])).first()
    assert (out["n_atoms"], out["note"], out["fails"]) == (len(d["x"]), "zx", None) and out["score_error"] == "fails: no"


def test_built_in_scores(spark, tmp_path):
    """All four by their arguments, with stored confidences; a ligand in another chain is compared too."""
    import json
    import sqlite3

    from tessera.sources.formats import msgpack

    with sqlite3.connect(tmp_path / "m.db") as db:
        db.execute("create table maps(name text, data blob)")
        db.execute("insert into maps values ('x', ?)", (msgpack.packb({"M1": "A2", "M2": "A3"}),))
    parser = ArgumentParser()
    for f in scores.BUILT_IN.values():
        f.register_args(parser)
    argv = ["--ligand_atom_distances", "LIG:C1_LIG:O1", "--motif-residues-contig", "A2-5", "--superimpose-on-motif", "--diff-motif-map-db", str(tmp_path / "m.db")]
    args = parser.parse_args(argv)
    d = make()
    p = turned(d, noise=0.0)
    p = p | {"chain_id": ["C" if h else c for c, h in zip(p["chain_id"], p["hetero"], strict=True)]}
    designs = spark.createDataFrame([("x", "D")], "name string, design_id string")
    predictions = spark.createDataFrame([("P", "x", 0, 1)], "id_hex string, name string, sample int, seed int")
    plddts = np.arange(len(d["x"])) / 2
    heavy = spark.createDataFrame([("P", json.dumps({"atom_plddts": plddts.tolist(), "pae": [[1.5]]}))], "id_hex string, heavy string")
    seen = scores.ScoreFunction("seen", "pae double, last double", lambda s: {"pae": s.confidences["pae"][0][0], "last": s.confidences["atom_plddts"][-1]})
    functions = [*scores.BUILT_IN.values(), seen]
    out = analysis.analyse(predictions, designs, frame(spark, {"P": p}), frame(spark, {"D": d}), functions, args, confidences=heavy).first().asDict()
    assert out["score_error"] is None
    for c in ("RMSD_lig_LIG:LIG", "motif_rmsd_AA", "motif_rmsd_CA", "diff_motif_rmsd_M1", "diff_motif_rmsd_M2", "diff_motif_rmsd_overall"):
        assert out[c] == pytest.approx(0, abs=1e-4), c
    at = {a: xyz(d)[i] for i, (a, h) in enumerate(zip(d["atom_name"], d["hetero"], strict=True)) if h}
    assert out["lig_atom_dist_LIG.C1_LIG.O1"] == pytest.approx(np.linalg.norm(at["C1"] - at["O1"]))
    assert out["pLDDT_AA"] == pytest.approx(plddts.mean()) and (out["pae"], out["last"]) == (1.5, plddts[-1])
    merged = tables.merge_update(predictions, spark.createDataFrame([("P", 2.0)], ["id_hex", "a.b"]), "id_hex")
    assert merged.first()["a.b"] == 2.0


def test_entry_imports():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
