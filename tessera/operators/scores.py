"""Score functions: plugins that compare a predicted structure with its design.

A plugin has a name, the columns it returns, and a function of a ``ScoreInput``. Plugins from files
are modules with ``score(input) -> dict``, ``COLUMNS`` (a schema string), and if they like
``init(args)`` (once in each Python worker) and ``register_args(parser)``; they travel to the workers by
value. ``BUILT_IN`` has four: lig_rmsd, lig_atom_dist, motif_rmsd, diff_motif_rmsd. Only plugins that are
asked for run. Their errors end up in the column ``score_error`` of the structure. A plugin file:

    COLUMNS = "my_score double, my_note string"
    def register_args(parser): parser.add_argument("--my-arg", type=int, default=1)
    def init(args): ...
    def score(input): return {"my_score": len(input.design) * input.args.my_arg, "my_note": input.meta["name"]}

``COLUMNS`` may also be a function of the arguments and of a function that lists the names of the
predictions' hetero residues.
"""

from __future__ import annotations

import importlib.util
import itertools
import json
import math
import os
import sys
from argparse import ArgumentParser, Namespace
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.names import expand_contig, parse_residue
from tessera.operators.geometry import SWAPS


@dataclass
class ScoreInput:
    """All atoms of design and prediction (pandas, each ordered by its atom_idx, the prediction fitted on
    the design), the prediction's row, its confidences (atom_plddts and atom_chain_ids of the atoms
    given, and whatever else is stored of it, such as pae), and arguments."""

    design: pd.DataFrame
    prediction: pd.DataFrame
    meta: dict[str, Any]
    confidences: dict[str, Any]
    args: Namespace


@dataclass(frozen=True)
class ScoreFunction:
    name: str
    columns: str | Callable[[Namespace, Callable[[], list[str]]], str]
    score: Callable[[ScoreInput], dict[str, Any] | None]
    init: Callable[[Namespace], None] | None = None
    register_args: Callable[[ArgumentParser], None] | None = None


@dataclass
class Registry:
    """Score functions by name."""

    functions: dict[str, ScoreFunction] = field(default_factory=dict)

    def add(self, f: ScoreFunction) -> ScoreFunction:
        self.functions[f.name] = f
        return f

    def load(self, folder: str, names: Sequence[str] | None = None, parser: ArgumentParser | None = None) -> list[ScoreFunction]:
        """Plugins of a folder's Python files whose names don't begin with an underscore."""
        out = []
        for file in sorted(os.listdir(folder)):
            name = file.removesuffix(".py")
            if not file.endswith(".py") or name.startswith("_") or names is not None and name not in names:
                continue
            spec = importlib.util.spec_from_file_location(f"tessera_plugin_{name}", os.path.join(folder, file))
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            # Workers have no such module: its functions are pickled by value.
            sys.modules[module.__name__] = module
            cloudpickle.register_pickle_by_value(module)
            if not callable(getattr(module, "score", None)):
                raise ValueError(f"{file} has no function score")
            f = ScoreFunction(name, getattr(module, "COLUMNS", f"{name} double"), module.score, getattr(module, "init", None), getattr(module, "register_args", None))
            if parser is not None and f.register_args:
                f.register_args(parser)
            out.append(self.add(f))
        return out


def _coordinates(df: pd.DataFrame) -> np.ndarray:
    return df[["x", "y", "z"]].to_numpy(float)


def _rms(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.sqrt(((a - b) ** 2).sum(1).mean())) if len(a) else math.nan


def fit(fixed: np.ndarray, mobile: np.ndarray, every: np.ndarray) -> np.ndarray:
    """``every`` moved as ``mobile`` is moved to fit ``fixed`` best."""
    a, b = fixed.mean(0), mobile.mean(0)
    u, _, vt = np.linalg.svd((fixed - a).T @ (mobile - b))
    r = u @ np.diag([1.0, 1.0, np.sign(np.linalg.det(u @ vt))]) @ vt
    return (every - b) @ r.T + a


def automorphic(reference: pd.DataFrame, subject: pd.DataFrame, ignore_missing: bool = False) -> float:
    """RMSD with symmetric atoms of each residue exchanged where that is closer."""
    names = reference["atom_name"].to_numpy()
    if not np.array_equal(names, subject["atom_name"].to_numpy()):
        raise ValueError("the structures' atoms differ in order")
    place = (reference["chain_id"].astype(str) + ":" + reference["res_id"].astype(str)).to_numpy()
    a, b = _coordinates(reference), _coordinates(subject)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    total = 0.0
    for lo, hi in zip(starts, np.append(starts[1:], len(place)), strict=True):
        own = ((a[lo:hi] - b[lo:hi]) ** 2).sum()
        order, known = np.arange(lo, hi), {n: i for i, n in reversed(list(enumerate(names[lo:hi], lo)))}
        for p, q in SWAPS.get(reference["res_name"].iat[lo], ()):
            if p in known and q in known:
                order[[known[p] - lo, known[q] - lo]] = known[q], known[p]
            elif not ignore_missing:
                raise ValueError(f"a symmetric atom of {p}, {q} is missing in residue {place[lo]}")
        total += min(own, ((a[lo:hi] - b[order]) ** 2).sum())
    return math.sqrt(total / len(a)) if len(a) else math.nan


def ligand_rmsd(s: ScoreInput, pairs: dict[str, list[str]], equivalent: dict[str, list[tuple[str, str]]], partial: bool = False) -> dict[str, float]:
    """RMSD_lig_<pair> for each ``PREDICTED:DESIGNED`` residue name: the least over all copies, atoms
    matched by name; each pair of equivalent atoms in turn is exchanged if that is strictly closer."""
    out = {}
    for key, atoms in pairs.items():
        mine, theirs = key.split(":")
        sides = []
        for df, name in ((s.prediction, mine), (s.design, theirs)):
            found = df[(df["res_name"] == name) & df["atom_name"].isin(atoms)].sort_values(["atom_name", "atom_idx"])
            sides.append([g for _, g in found.groupby(["chain_id", "res_id"], sort=True)])
        if not all(sides):
            continue
        best = math.nan
        for p, d in itertools.product(*sides):
            p_names, d_names = p["atom_name"].tolist(), d["atom_name"].tolist()
            if p_names != d_names:
                common = set(p_names) & set(d_names)
                p, d = p[p["atom_name"].isin(common)], d[d["atom_name"].isin(common)]
                p_names = p["atom_name"].tolist()
                if not partial or not common or p_names != d["atom_name"].tolist():
                    continue
            x, fixed = _coordinates(p), _coordinates(d)
            now = _rms(fixed, x)
            for one, two in equivalent.get(key, ()):
                i, j = p_names.index(one), p_names.index(two)
                swapped = x.copy()
                swapped[[i, j]] = x[[j, i]]
                # What moves is the atom with its name, so that later pairs find it by name.
                other = _rms(fixed, swapped)
                if other < now:
                    x, now = swapped, other
                    p_names[i], p_names[j] = p_names[j], p_names[i]
            best = now if math.isnan(best) else min(best, now)
        out[f"RMSD_lig_{key}"] = best
    return out


def ligand_atom_distance(s: ScoreInput, specs: Sequence[str]) -> dict[str, float]:
    """lig_atom_dist_<LIG>.<ATOM>_<LIG>.<ATOM> for each ``LIG:ATOM_LIG:ATOM``; ValueError unless both
    exist once."""
    out = {}
    for spec in specs or ():
        points = []
        for part in spec.split("_"):
            name, atom = part.split(":")
            found = s.prediction[(s.prediction["res_name"] == name) & (s.prediction["atom_name"] == atom)]
            if len(found) != 1:
                raise ValueError(f"{part} stands for {len(found)} atoms")
            points.append(_coordinates(found)[0])
        out[f"lig_atom_dist_{spec.replace(':', '.')}"] = float(np.linalg.norm(points[0] - points[1]))
    return out


def _at(df: pd.DataFrame, places: set[tuple[str, int]]) -> pd.DataFrame:
    """The atoms of the residues at these places."""
    return df[[w in places for w in zip(df["chain_id"], df["res_id"], strict=True)]]


def _fitted(d: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
    """``p`` fitted on ``d``; ValueError if their atoms differ."""
    if d["atom_name"].tolist() != p["atom_name"].tolist() or not len(d):
        raise ValueError("the motif's atoms differ")
    return p.assign(**dict(zip("xyz", fit(_coordinates(d), _coordinates(p), _coordinates(p)).T, strict=True)))


def motif_rmsd(s: ScoreInput, contig: str, align: bool = False) -> dict[str, float]:
    """RMSD of a contig's residues, over all atoms (symmetry-aware) and CA; fitted on its CA atoms if
    ``align``."""
    residues = set(expand_contig(contig))
    d, p = _at(s.design, residues), _at(s.prediction, residues)

    def ca(df: pd.DataFrame) -> pd.DataFrame:
        return df[(df["atom_name"] == "CA") & ~df["hetero"].astype(bool)]

    if align:
        fixed, mobile = _coordinates(ca(d)), _coordinates(ca(p))
        if len(fixed) != len(mobile) or not len(fixed):
            raise ValueError("the motif's CA atoms differ")
        p = p.assign(**dict(zip("xyz", fit(fixed, mobile, _coordinates(p)).T, strict=True)))
    return {"motif_rmsd_AA": automorphic(d, p), "motif_rmsd_CA": _rms(_coordinates(ca(d)), _coordinates(ca(p)))}


def mapped_motif_rmsd(s: ScoreInput, maps: Mapping[str, dict[str, str]], parts: int | None, align: bool = False) -> dict[str, float]:
    """diff_motif_rmsd_<residue> for each residue of the motif map of the structure's name (or of its
    first ``parts`` parts), and diff_motif_rmsd_overall, the root of the mean square of all; fitted on all
    of the motif's atoms if ``align``. Hetero atoms take no part. ValueError without a map."""
    name = "_".join(str(s.meta["name"]).split("_")[:parts])
    found = maps.get(name)
    if found is None:
        raise ValueError(f"no motif map for {name}")
    places = {k: parse_residue(v) for k, v in found.items()}
    d, p = (_at(df[~df["hetero"].astype(bool)], set(places.values())) for df in (s.design, s.prediction))
    if align:
        p = _fitted(d, p)
    out = {f"diff_motif_rmsd_{k}": automorphic(_at(d, {place}), _at(p, {place})) for k, place in places.items()}
    out["diff_motif_rmsd_overall"] = math.sqrt(np.mean(np.square(list(out.values())))) if out else math.nan
    return out


def read_motif_maps(path: str) -> dict[str, dict[str, str]]:
    """All motif maps of an SQLite file with a table maps(name, data), data in MessagePack."""
    import sqlite3

    from tessera.sources.formats import msgpack

    with sqlite3.connect(path) as db:
        return {name: msgpack.unpackb(data) for name, data in db.execute("select name, data from maps")}


class MotifMaps(Mapping):
    """Motif maps by name, each read when it is asked for."""

    def __init__(self, path: str) -> None:
        import sqlite3

        self.db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    def __getitem__(self, name: str) -> dict[str, str]:
        from tessera.sources.formats import msgpack

        row = self.db.execute("select data from maps where name = ?", (name,)).fetchone()
        if row is None:
            raise KeyError(name)
        return msgpack.unpackb(row[0])

    def __iter__(self):  # noqa: ANN204
        return (r[0] for r in self.db.execute("select name from maps"))

    def __len__(self) -> int:
        return self.db.execute("select count(*) from maps").fetchone()[0]


def _after(spec: str) -> tuple[str, str]:
    """``PREDICTED:DESIGNED$rest`` as its two parts."""
    key, _, rest = spec.partition("$")
    return key, rest


def _doubles(names: Iterable[str]) -> str:
    return ", ".join(f"`{n}` double" for n in names)


def _ligands_of(s: ScoreInput) -> dict[str, list[str]]:
    """All atoms of every hetero residue name of the prediction."""
    hetero = s.prediction[s.prediction["hetero"].astype(bool)]
    return {f"{n}:{n}": sorted(set(g["atom_name"])) for n, g in hetero.groupby("res_name")}


def _score_ligands(s: ScoreInput) -> dict[str, float]:
    atoms = s.args.atom_names_rmsd
    pairs = _ligands_of(s) if atoms is None else {k: v.split(":") for k, v in map(_after, atoms)}
    equivalent = {k: [tuple(x.split(":")) for x in v.split("_")] for k, v in map(_after, s.args.chem_eq_atoms or ())}
    return ligand_rmsd(s, pairs, equivalent, s.args.lig_rmsd_allow_partial_matches)


def _ligand_columns(args: Namespace, ligands: Callable[[], list[str]]) -> str:
    keys = [f"{n}:{n}" for n in ligands()] if args.atom_names_rmsd is None else [_after(x)[0] for x in args.atom_names_rmsd]
    return _doubles(f"RMSD_lig_{k}" for k in keys)


def _ligand_args(p: ArgumentParser) -> None:
    p.add_argument("--atom_names_rmsd", nargs="+", help="atoms of ligands, PREDICTED:DESIGNED$ATOM1:ATOM2:...; all atoms of all ligands if not given")
    p.add_argument("--chem_eq_atoms", nargs="+", help="equivalent atoms, PREDICTED:DESIGNED$ATOM1:ATOM2_ATOM3:ATOM4...")
    p.add_argument("--lig_rmsd_allow_partial_matches", action="store_true", help="compare the common atoms of ligands whose atoms differ")


def _distance_args(p: ArgumentParser) -> None:
    p.add_argument("--ligand_atom_distances", nargs="+", help="pairs of atoms, LIG:ATOM_LIG:ATOM")


def _motif_args(p: ArgumentParser) -> None:
    p.add_argument("--motif-residues-contig", help="residues such as A10,B12-30; chain A if none is given")
    p.add_argument("--superimpose-on-motif", action="store_true", help="fit on the motif's CA atoms")


def _map_args(p: ArgumentParser) -> None:
    p.add_argument("--diff-motif-map-db", help="SQLite file of motif maps, in a folder that all executors see")
    p.add_argument("--diff-motif-map-db-name-split", type=int, help="how many parts of a structure's name are the map's name")
    p.add_argument("--diff-motif-align", action="store_true", help="fit on the motif's atoms")


def _score_motif(s: ScoreInput) -> dict[str, float]:
    if not s.args.motif_residues_contig:
        raise ValueError("--motif-residues-contig is not given")
    return motif_rmsd(s, s.args.motif_residues_contig, s.args.superimpose_on_motif)


_MAPS: dict[str, MotifMaps] = {}


def _open_maps(args: Namespace) -> None:
    if args.diff_motif_map_db not in _MAPS:
        _MAPS[args.diff_motif_map_db] = MotifMaps(args.diff_motif_map_db)


def _score_map(s: ScoreInput) -> dict[str, float]:
    return mapped_motif_rmsd(s, _MAPS[s.args.diff_motif_map_db], s.args.diff_motif_map_db_name_split, s.args.diff_motif_align)


def _map_columns(args: Namespace, ligands: Callable[[], list[str]]) -> str:
    """A column for each residue that some map has."""
    if not args.diff_motif_map_db:
        raise ValueError("--diff-motif-map-db is not given")
    maps = MotifMaps(args.diff_motif_map_db)
    return _doubles([*(f"diff_motif_rmsd_{k}" for k in sorted({k for name in maps for k in maps[name]})), "diff_motif_rmsd_overall"])


BUILT_IN = {
    f.name: f
    for f in (
        ScoreFunction("lig_rmsd", _ligand_columns, _score_ligands, register_args=_ligand_args),
        ScoreFunction(
            "lig_atom_dist",
            lambda args, ligands: _doubles(f"lig_atom_dist_{x.replace(':', '.')}" for x in args.ligand_atom_distances or ()),
            lambda s: ligand_atom_distance(s, s.args.ligand_atom_distances),
            register_args=_distance_args,
        ),
        ScoreFunction("motif_rmsd", "motif_rmsd_AA double, motif_rmsd_CA double", _score_motif, register_args=_motif_args),
        ScoreFunction("diff_motif_rmsd", _map_columns, _score_map, _open_maps, _map_args),
    )
}


def confidences_of(heavy: str | None, p: pd.DataFrame) -> dict[str, Any]:
    """A prediction's stored confidences (JSON), those of atoms for the atoms ``p`` alone, in its order."""
    found = json.loads(heavy) if heavy else {}
    for name, column in (("atom_plddts", "b_factor"), ("atom_chain_ids", "chain_id")):
        every = found.get(name)
        whole = isinstance(every, list) and len(every) > p["own_idx"].max()
        found[name] = [every[i] for i in p["own_idx"]] if whole else p[column].tolist()
    return found


def apply_scores(designs: DataFrame, predictions: DataFrame, meta: DataFrame, functions: Sequence[ScoreFunction], args: Namespace, heavy: str | None = None) -> DataFrame:
    """pair_id, the functions' columns and score_error for each prediction.

    ``designs`` and ``predictions`` are atoms by pair_id, ``meta`` has a row for each pair_id, of which
    the column ``heavy`` is the prediction's confidences as JSON. Each pair of structures is one group, of
    a structure's size; its row meets it there, so that it isn't repeated for each atom.
    """
    listed: list[list[str]] = []

    def ligands() -> list[str]:
        if not listed:
            listed.append(sorted(r[0] for r in predictions.filter("hetero").select("res_name").distinct().collect()))
        return listed[0]

    declared = [f.columns(args, ligands) if callable(f.columns) else f.columns for f in functions]
    fields = [f for d in declared if d for f in T._parse_datatype_string(d).fields]
    schema = T.StructType([T.StructField("pair_id", T.StringType()), *fields, T.StructField("score_error", T.StringType())])
    names = [f.name for f in fields]
    started: list[bool] = []
    extra = [c for c in meta.columns if c not in ("pair_id", heavy)]

    def score(atoms: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(atoms) or not len(rows):
            return pd.DataFrame([], columns=schema.names)
        if not started:
            for f in functions:
                if f.init:
                    f.init(args)
            started.append(True)
        atoms = atoms.sort_values("atom_idx")
        d, p = atoms[atoms["side"] == 0].reset_index(drop=True), atoms[atoms["side"] == 1].reset_index(drop=True)
        row: dict[str, Any] = {"pair_id": atoms["pair_id"].iat[0], "score_error": None} | dict.fromkeys(names)
        info = {k: rows[f"__{i}"].iat[0] for i, k in enumerate(extra)}
        failed = []
        for f in functions:
            try:
                confidences = confidences_of(rows["__heavy"].iat[0] if heavy else None, p)
                found = f.score(ScoreInput(d.copy(), p.copy(), info, confidences, args))
                row |= {k: v for k, v in (found or {}).items() if k in names}
            except Exception as e:  # noqa: BLE001  a plugin's failure is a result
                failed.append(f"{f.name}: {e}")
        row["score_error"] = "; ".join(failed) or None
        return pd.DataFrame([row], columns=schema.names)

    columns = ["pair_id", "atom_idx", "chain_id", "res_id", "res_name", "hetero", "atom_name", "x", "y", "z", "b_factor"]
    one, two = (df.select(*columns, (F.col("own_idx") if "own_idx" in df.columns else F.col("atom_idx")).alias("own_idx"), F.lit(i).alias("side")) for i, df in enumerate((designs, predictions)))
    # Columns have other names there: both sides may come from one table, and theirs may have dots.
    given = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(extra)]
    rows = meta.select(F.col("pair_id").alias("__pair"), *given, *([F.col(heavy).alias("__heavy")] if heavy else []))
    return one.unionByName(two).groupBy("pair_id").cogroup(rows.groupBy("__pair")).applyInPandas(score, schema)
