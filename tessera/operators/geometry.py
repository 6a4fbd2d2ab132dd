"""Geometry of atoms as joins and aggregations.

``atoms`` has a row for each atom: struct_id, atom_idx, chain_id, res_id, res_name, hetero, atom_name,
x, y, z. ``pairs`` has a row for each pair of corresponding atoms of two structures: pair_id,
atom_idx, the first structure's columns, and mx, my, mz of the second (the mobile one).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Radius in which atoms are near a ligand.
RADIUS = 7.5
# Backbone atoms, and atoms that a residue's symmetry exchanges.
BACKBONE = ("N", "CA", "C", "O")
SWAPS = {
    "ASP": [("OD1", "OD2")],
    "GLU": [("OE1", "OE2")],
    "PHE": [("CD1", "CD2"), ("CE1", "CE2")],
    "TYR": [("CD1", "CD2"), ("CE1", "CE2")],
    "ARG": [("NH1", "NH2")],
    "LEU": [("CD1", "CD2")],
    "VAL": [("CG1", "CG2")],
    "KCX": [("OQ1", "OQ2")],
}
# One-letter codes of residues.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I", "LEU": "L", "LYS": "K",
    "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V", "SEC": "U", "PYL": "O",
}


def near_hetero(atoms: DataFrame, radius: float = RADIUS, struct: str = "struct_id") -> DataFrame:
    """Non-hetero atoms within ``radius`` of a hetero atom of their structure.

    Space is cut into cells of the radius; an atom meets the hetero atoms of its cell and of the 26
    around it in an equi-join, so that no structure's atoms are all paired.
    """
    cell = [F.floor(F.col(c) / radius) for c in "xyz"]
    around = F.explode(F.array(*[F.lit(d) for d in (-1, 0, 1)]))
    hetero = atoms.filter("hetero").select(F.col(struct).alias("s"), *[F.col(c).alias(f"h{c}") for c in "xyz"], *[(F.floor(F.col(c) / radius)).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        hetero = hetero.withColumn("d", around).withColumn(f"c{c}", F.col(f"c{c}") + F.col("d")).drop("d")
    here = atoms.filter("not hetero").withColumns({f"c{c}": e for c, e in zip("xyz", cell, strict=True)})
    close = sum(((F.col(c) - F.col(f"h{c}")) ** 2 for c in "xyz"), F.lit(0.0)) <= radius * radius
    same = (F.col(struct) == F.col("s")) & close
    for c in "xyz":
        same &= here[f"c{c}"] == hetero[f"c{c}"]
    return here.join(hetero, same, "left_semi").drop("cx", "cy", "cz")


def expand_to_residues(atoms: DataFrame, some: DataFrame, on: Sequence[str] = ("struct_id", "chain_id", "res_id")) -> DataFrame:
    """All atoms of the residues that ``some`` has atoms of."""
    return atoms.join(some.select(*on).distinct(), list(on), "left_semi")


def side_chains(atoms: DataFrame) -> DataFrame:
    """Atoms that are not the backbone of an amino acid."""
    return atoms.filter(~(F.col("atom_name").isin(*BACKBONE) & F.col("res_name").isin(*LETTERS)))


def canonical_rank(atom_name: Column) -> Column:
    """Sort key of an amino acid's atoms: backbone, then side chain outwards, terminal oxygen last."""
    backbone = F.array_position(F.array(*map(F.lit, BACKBONE)), atom_name)
    remote = F.coalesce(F.nullif(F.position(F.substring(atom_name, 2, 1), F.lit("ABGDEZH")), F.lit(0)), F.lit(8))
    order = F.when(backbone > 0, F.lpad(backbone.cast("string"), 2, "0")).when(atom_name == "OXT", F.lit("99"))
    return order.otherwise(F.concat(F.lpad((remote + 10).cast("string"), 2, "0"), F.substring(atom_name, 3, 2), atom_name))


def canonical_order(atoms: DataFrame, struct: str = "struct_id") -> DataFrame:
    """``atoms`` with the non-hetero atoms of each residue renumbered in canonical order; residues and
    hetero atoms keep their places."""
    residue = Window.partitionBy(struct, "chain_id", "res_id", "hetero")
    start = F.min("atom_idx").over(residue)
    place = start + F.row_number().over(residue.orderBy(canonical_rank(F.col("atom_name")), "atom_idx")) - 1
    return atoms.withColumn("atom_idx", F.when(F.col("hetero"), F.col("atom_idx")).otherwise(place).cast("int"))


def translate_mask(selected: DataFrame, other: DataFrame, keys: Sequence[str] = ("struct_id",)) -> DataFrame:
    """Atoms of ``other`` at the (chain, residue, atom name) of selected ones; where the residue's name
    differs, of its backbone only."""
    place = [*keys, "chain_id", "res_id"]
    wanted = selected.select(*place, "atom_name", F.col("res_name").alias("__name")).distinct()
    joined = other.join(wanted, [*place, "atom_name"])
    fits = (F.col("res_name") == F.col("__name")) | F.col("atom_name").isin(*BACKBONE)
    return joined.filter(fits).select(*other.columns).distinct()


def common_residues(atoms: DataFrame, other: DataFrame, keys: Sequence[str] = ("struct_id",), by_chain: bool = False) -> DataFrame:
    """Atoms of the backbone, and of residues that ``other`` has under the same number and name.

    A residue's name is that of its first atom; chains are ignored unless ``by_chain``.
    """
    place = [*keys, *(["chain_id"] if by_chain else []), "res_id"]

    def names(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*place).agg(F.min_by("res_name", "atom_idx").alias(name))

    joined = atoms.join(names(atoms, "__one"), place).join(names(other, "__two"), place, "left")
    keep = F.col("atom_name").isin(*BACKBONE) | F.coalesce(F.col("__one") == F.col("__two"), F.lit(False))
    return joined.filter(keep).select(*atoms.columns)


def pair_atoms(fixed: DataFrame, mobile: DataFrame, pairs: DataFrame) -> DataFrame:
    """Corresponding atoms of the structures named in ``pairs`` (pair_id, fixed_id, mobile_id)."""
    one = fixed.withColumnRenamed("struct_id", "fixed_id")
    two = mobile.select(F.col("struct_id").alias("mobile_id"), "atom_idx", F.col("atom_name").alias("m_name"), *[F.col(c).alias(f"m{c}") for c in "xyz"])
    return pairs.join(one, "fixed_id").join(two, ["mobile_id", "atom_idx"])


def square_distance() -> Column:
    """Squared distance of the two atoms of a row of ``pairs``."""
    return sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))


def rmsd(pairs: DataFrame, where: Column | None = None, name: str = "rmsd", by: str = "pair_id") -> DataFrame:
    """Root mean square distance of each pair of structures, over the atoms that fulfil ``where``."""
    d = square_distance() if where is None else F.when(where, square_distance())
    return pairs.groupBy(by).agg(F.sqrt(F.avg(d)).alias(name))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _rotations(c: pd.Series) -> pd.Series:
    """Best rotation for each 3x3 covariance (fixed by mobile), both by rows of nine numbers."""
    m = np.array([np.asarray(x, float) for x in c]).reshape(-1, 3, 3)
    u, _, vt = np.linalg.svd(m)
    flip = np.ones((len(m), 3))
    flip[:, 2] = np.sign(np.linalg.det(u @ vt))
    return pd.Series(list((u * flip[:, None, :] @ vt).reshape(-1, 9)))


def fits(pairs: DataFrame, where: Column, by: str = "pair_id") -> DataFrame:
    """For each pair of structures the best move of the mobile one onto the fixed one, over atoms
    ``where``: rotation r, and the centres a_x, a_y, a_z (fixed) and a_mx, a_my, a_mz (mobile).

    Means and covariances are aggregates; only nine numbers for each pair of structures go through
    Python. Pairs without such an atom have nulls.
    """
    on = lambda c: F.when(where, F.col(c))
    sums = [F.avg(on(c)).alias(f"a_{c}") for c in ("x", "y", "z", "mx", "my", "mz")]
    covariances = [F.covar_pop(on(a), on(f"m{b}")) for a in "xyz" for b in "xyz"]
    fit = pairs.groupBy(by).agg(F.array(*covariances).alias("c"), *sums)
    fit = fit.withColumn("r", F.when(F.col("a_x").isNotNull(), _rotations(F.coalesce("c", F.array(*[F.lit(0.0)] * 9)))))
    return fit.drop("c")


def move(atoms: DataFrame, fit: DataFrame, columns: Sequence[str] = ("x", "y", "z"), by: str = "pair_id") -> DataFrame:
    """``atoms`` with the coordinates in ``columns`` moved by ``fits``; unmoved where there is none."""
    joined = atoms.join(fit, by, "left")
    moved = {}
    for i, c in enumerate("xyz"):
        turned = sum((F.col("r")[3 * i + j] * (F.col(d) - F.col(f"a_m{e}")) for j, (d, e) in enumerate(zip(columns, "xyz", strict=True))), F.lit(0.0))
        moved[columns[i]] = F.coalesce(turned + F.col(f"a_{c}"), F.col(columns[i]))
    return joined.withColumns(moved).select(*atoms.columns)


def superpose(pairs: DataFrame, where: Column, by: str = "pair_id") -> DataFrame:
    """``pairs`` with the mobile structures moved onto the fixed ones, fitted on atoms ``where``."""
    return move(pairs, fits(pairs, where, by), ("mx", "my", "mz"), by)


def automorphic_rmsd(pairs: DataFrame, by: str = "pair_id", name: str = "rmsd", ignore_missing: bool = False) -> DataFrame:
    """RMSD in which the symmetric atoms of each residue are exchanged where that is closer.

    A residue is a run of atoms of one chain and number. All its pairs are exchanged together, and
    only if its mean square distance gets strictly smaller. A residue that lacks an atom of a pair is
    an error, or has the pair left alone with ``ignore_missing``.
    """
    atom = Window.partitionBy(by).orderBy("atom_idx")
    new = F.coalesce((F.col("chain_id") == F.lag("chain_id").over(atom)) & (F.col("res_id") == F.lag("res_id").over(atom)), F.lit(False))
    numbered = pairs.withColumn("__run", F.sum(F.when(new, 0).otherwise(1)).over(atom))
    swaps = [(r, a, b) for r, ps in SWAPS.items() for p in ps for a, b in (p, p[::-1])]
    spark = pairs.sparkSession
    table = F.broadcast(spark.createDataFrame(swaps, "__res string, __from string, __to string"))
    residue = Window.partitionBy(by, "__run").orderBy("atom_idx")
    named = numbered.withColumn("__first", F.first("res_name").over(residue))
    partner = named.join(table, (F.col("__first") == F.col("__res")) & (F.col("atom_name") == F.col("__from")), "left")
    other = named.groupBy(by, "__run", F.col("atom_name").alias("__to")).agg(*[F.min_by(f"m{c}", "atom_idx").alias(f"o{c}") for c in "xyz"])
    both = partner.join(other, [by, "__run", "__to"], "left")
    swapped = sum(((F.col(c) - F.coalesce(F.col(f"o{c}"), F.col(f"m{c}"))) ** 2 for c in "xyz"), F.lit(0.0))
    alone = F.count_if(F.col("__to").isNotNull() & F.col("ox").isNull())
    present = F.count_if(F.col("__to").isNotNull())
    sizes = table.groupBy("__res").agg(F.count("*").alias("__want"))
    per = both.groupBy(by, "__run").agg(F.first("__first").alias("__first"), F.sum(square_distance()).alias("d"), F.sum(swapped).alias("s"), F.count("*").alias("n"), alone.alias("alone"), present.alias("present"))
    per = per.join(F.broadcast(sizes), F.col("__first") == F.col("__res"), "left")
    if not ignore_missing:
        lacking = (F.col("alone") > 0) | (F.col("present") < F.coalesce("__want", F.lit(0)))
        fail = F.raise_error(F.concat(F.lit("a symmetric atom is missing in residue "), F.col("__first")))
        per = per.withColumn("d", F.when(lacking, fail.cast("double")).otherwise(F.col("d")))
    return per.groupBy(by).agg(F.sqrt(F.sum(F.least("d", "s")) / F.sum("n")).alias(name))


def atom_distance(atoms: DataFrame, a: tuple[str, str], b: tuple[str, str], struct: str = "struct_id", name: str = "distance") -> DataFrame:
    """Distance of atom ``a`` (residue name, atom name) and atom ``b``; structures must have one each,
    others are left out."""

    def one(which: tuple[str, str], prefix: str) -> DataFrame:
        found = atoms.filter((F.col("res_name") == which[0]) & (F.col("atom_name") == which[1]))
        return found.groupBy(struct).agg(F.count("*").alias("n"), *[F.first(c).alias(f"{prefix}{c}") for c in "xyz"]).filter("n = 1").drop("n")

    d = sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return one(a, "a").join(one(b, "b"), struct).select(struct, F.sqrt(d).alias(name))


def best_copies(fixed: DataFrame, mobile: DataFrame, struct: str = "struct_id") -> DataFrame:
    """Least RMSD over all pairs of copies (chain, residue number) of each residue name whose atoms
    have the same names, atoms matched by name; copies of one structure meet only each other."""

    def copies(df: DataFrame, p: str) -> DataFrame:
        a = F.struct("atom_name", "atom_idx", "x", "y", "z")
        return df.groupBy(struct, "res_name", F.col("chain_id").alias(f"{p}_chain"), F.col("res_id").alias(f"{p}_res")).agg(F.sort_array(F.collect_list(a)).alias(p))

    both = copies(fixed, "f").join(copies(mobile, "m"), [struct, "res_name"])
    same = F.transform("f", lambda a: a["atom_name"]) == F.transform("m", lambda a: a["atom_name"])
    d = F.zip_with("f", "m", lambda p, q: (p["x"] - q["x"]) ** 2 + (p["y"] - q["y"]) ** 2 + (p["z"] - q["z"]) ** 2)
    r = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, v: s + v) / F.size("f"))
    return both.filter(same).groupBy(struct, "res_name").agg(F.min(r).alias("rmsd"))
