"""Scores of predicted structures against their designs, in one plan.

Predictions are joined to designs by name; atoms are exploded once; every metric is an aggregate of
the atoms of a pair of structures, keyed by pair_id; score functions add columns; the result is merged
into the lake's table. A structure is scored by one group, so the work spreads over structures.
"""

from __future__ import annotations

from argparse import Namespace
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import geometry as g
from tessera.operators.scores import ScoreFunction, apply_scores
from tessera.operators.tables import assert_unique


def prepare(atoms: DataFrame, ncaa: Sequence[str] = ()) -> DataFrame:
    """Atoms without hydrogens; residues named in ``ncaa`` count as amino acids."""
    return names.as_polymer(atoms.filter(~F.col("element").isin("H", "D")), ncaa)


def join_designs(predictions: DataFrame, designs: DataFrame, on: str = "name", required: bool = False) -> DataFrame:
    """Predictions with the key of their design (design_id); those without one are left out, or are an
    error if ``required``. Design names must be unique."""
    assert_unique(designs, on)
    if required and predictions.join(designs, on, "left_anti").limit(1).count():
        raise ValueError("a prediction has no design")
    return predictions.join(designs.select(on, "design_id"), on)


def single_design(predictions: DataFrame, design_id: str, on: str = "name") -> DataFrame:
    """A table of designs in which one structure is the design of every prediction."""
    return predictions.select(on).distinct().withColumn("design_id", F.lit(design_id))


def _place(design: DataFrame, prediction: DataFrame) -> list[str]:
    """The columns that tell an atom's place."""
    coded = ["ins_code"] if "ins_code" in design.columns and "ins_code" in prediction.columns else []
    return ["pair_id", "chain_id", "res_id", *coded, "atom_name"]


def without_new_oxygen(design: DataFrame, prediction: DataFrame) -> DataFrame:
    """The prediction's atoms without terminal oxygens where the design has none at all."""
    ending = design.filter("atom_name = 'OXT'").select("pair_id").distinct()
    return prediction.filter("atom_name != 'OXT'").unionByName(prediction.filter("atom_name = 'OXT'").join(ending, "pair_id", "left_semi").select(*prediction.columns))


def mismatched(design: DataFrame, prediction: DataFrame) -> DataFrame:
    """pair_id of the pairs in which an atom of one side's polymer has no counterpart on the other, or a
    CA atom's residue has another name there."""
    place = _place(design, prediction)
    one, two = (df.filter("not hetero").select(*place, F.col("res_name").alias(n)) for df, n in ((design, "one"), (prediction, "two")))
    differs = F.col("one").isNull() | F.col("two").isNull() | (F.col("atom_name") == "CA") & (F.col("one") != F.col("two"))
    return one.join(two, place, "full_outer").filter(differs).select("pair_id").distinct()


def aligned(design: DataFrame, prediction: DataFrame, ignore_missing_oxygen: bool = True) -> DataFrame:
    """Corresponding atoms of each pair: same chain, residue number, insertion code (if both sides have
    that column) and atom name, in design order; terminal oxygens that the design lacks drop out, with
    their confidences."""
    place = _place(design, prediction)
    one = design.groupBy(*place).agg(F.min("atom_idx").alias("atom_idx"), *[F.min_by(c, "atom_idx").alias(c) for c in ("res_name", "hetero", "x", "y", "z")])
    two = prediction.groupBy(*place).agg(*[F.min_by(c, "atom_idx").alias(n) for c, n in (("res_name", "m_res_name"), ("x", "mx"), ("y", "my"), ("z", "mz"), ("b_factor", "plddt"))])
    return one.join(two, place)


def in_design_order(prediction: DataFrame, pairs: DataFrame) -> DataFrame:
    """The prediction's atoms, numbered as their counterparts in the design; those without one come last.
    Their own numbers are own_idx."""
    place = [c for c in ("pair_id", "chain_id", "res_id", "ins_code", "atom_name") if c in pairs.columns and c in prediction.columns]
    counterparts = pairs.select(*place, F.col("atom_idx").alias("__design"))
    last = F.col("own_idx") + (1 << 24)
    return prediction.withColumnRenamed("atom_idx", "own_idx").join(counterparts, place, "left").withColumn("atom_idx", F.coalesce("__design", last).cast("int")).drop("__design")


def with_confidences(atoms: DataFrame, confidences: DataFrame) -> DataFrame:
    """Atoms (struct_id, atom_idx) whose b_factor is that of atom_plddts in the JSON ``heavy`` of their
    structure (id_hex), where it has one for the atom."""
    plddts = confidences.select(F.col("id_hex").alias("struct_id"), F.from_json("heavy", "atom_plddts array<double>")["atom_plddts"].alias("__plddts"))
    joined = atoms.join(plddts, "struct_id", "left")
    return joined.withColumn("b_factor", F.coalesce(F.get("__plddts", F.col("atom_idx")), "b_factor")).select(*atoms.columns)


def base_metrics(design: DataFrame, prediction: DataFrame, pairs: DataFrame, seq_mismatch: bool = False, ignore_missing: bool = True) -> DataFrame:
    """pLDDT_CA, pLDDT_AA, RMSD_CA, RMSD_AA, pLDDT_SC_around_lig, RMSD_SC_around_lig for each pair.

    Distances are between corresponding atoms (``pairs``). Means of confidences are over all of the
    prediction's atoms, with or without a counterpart, and the neighbourhood of ligands is the design's.
    Pairs whose polymers differ in their atoms are left out unless ``seq_mismatch``; then side chains
    are compared only where residues agree.
    """
    if not seq_mismatch:
        other = mismatched(design, prediction)
        design, prediction, pairs = (df.join(other, "pair_id", "left_anti") for df in (design, prediction, pairs))
    ca = (F.col("atom_name") == "CA") & ~F.col("hetero")
    fitted = g.superpose(pairs, ca)
    plddt = prediction.groupBy("pair_id").agg(F.avg(F.when(F.col("atom_name") == "CA", F.col("b_factor"))).alias("pLDDT_CA"), F.avg("b_factor").alias("pLDDT_AA"))
    polymer = fitted.filter("not hetero")
    comparable = polymer.filter((F.col("res_name") == F.col("m_res_name")) | F.col("atom_name").isin(*g.BACKBONE))
    out = plddt.join(g.rmsd(fitted, ca, "RMSD_CA"), "pair_id", "left")
    out = out.join(g.automorphic_rmsd(comparable, name="RMSD_AA", ignore_missing=ignore_missing), "pair_id", "left")
    residue = ("pair_id", "chain_id", "res_id")
    near = g.near_hetero(design, struct="pair_id").select(*residue).distinct()
    residues = g.expand_to_residues(pairs.filter("not hetero"), near, residue)
    predicted = g.side_chains(g.expand_to_residues(prediction.filter("not hetero"), near, residue))
    around = g.side_chains(residues).filter(F.col("res_name") == F.col("m_res_name"))
    refitted = g.superpose(around, F.lit(True))
    out = out.join(predicted.groupBy("pair_id").agg(F.avg("b_factor").alias("pLDDT_SC_around_lig")), "pair_id", "left")
    return out.join(g.automorphic_rmsd(refitted, name="RMSD_SC_around_lig", ignore_missing=True), "pair_id", "left")


def ligand_plddt(atoms: DataFrame, residues: Sequence[str] | None = None) -> DataFrame:
    """pLDDT_LIG_<residue> for each pair: means over the atoms of hetero residues of a name."""
    hetero = atoms.filter("hetero").withColumn("column", F.concat(F.lit("pLDDT_LIG_"), "res_name"))
    values = [f"pLDDT_LIG_{r}" for r in residues] if residues is not None else None
    return hetero.groupBy("pair_id").pivot("column", values).agg(F.avg("b_factor"))


def analyse(
    predictions: DataFrame,
    designs: DataFrame,
    prediction_atoms: DataFrame,
    design_atoms: DataFrame,
    functions: Sequence[ScoreFunction] = (),
    args: Namespace | None = None,
    ncaa: Sequence[str] = (),
    rename_residues: Sequence[str] = (),
    rename_atoms: Sequence[str] = (),
    seq_mismatch: bool = False,
    source_version: int | None = None,
    confidences: DataFrame | None = None,
) -> DataFrame:
    """id_hex, all metrics and the version of the source, for every prediction that has a design.

    ``predictions`` has id_hex and name, ``designs`` name and design_id; atoms are keyed by struct_id
    (id_hex or design_id). ``confidences`` has id_hex and heavy, JSON as stored with a prediction: its
    atom_plddts, if there, count in place of the structure's own values, and score functions get all of
    it. Predictions without any keep their own values.
    """
    if rename_residues and rename_atoms:
        raise ValueError("rename residues or atoms, not both")
    matched = join_designs(predictions, designs).withColumn("pair_id", F.concat_ws("|", "id_hex", "design_id"))
    keys = matched.select("pair_id", "id_hex", "design_id")
    design = prepare(design_atoms, ncaa).join(keys.withColumnRenamed("design_id", "struct_id").drop("id_hex"), "struct_id").drop("struct_id")
    heavy = None
    if confidences is not None:
        heavy = confidences.groupBy("id_hex").agg(F.first("heavy").alias("heavy"))
        prediction_atoms = with_confidences(prediction_atoms, heavy)
    mine = names.rename_residue_atoms(names.rename_residues(prediction_atoms, rename_residues), rename_atoms)
    prediction = prepare(mine, ncaa).join(keys.withColumnRenamed("id_hex", "struct_id").drop("design_id"), "struct_id").drop("struct_id")
    prediction = without_new_oxygen(design, prediction)
    pairs = aligned(design, prediction)
    out = keys.select("pair_id", "id_hex").join(base_metrics(design, prediction, pairs, seq_mismatch), "pair_id").join(ligand_plddt(prediction), "pair_id", "left")
    if functions:
        ca = (F.col("atom_name") == "CA") & ~F.col("hetero")
        moved = in_design_order(g.move(prediction, g.fits(pairs, ca)), pairs)
        meta = matched.select("pair_id", *[f"`{c}`" for c in predictions.columns if c != "pair_id"])
        if heavy is not None:
            meta = meta.join(heavy.select("id_hex", F.col("heavy").alias("__heavy")), "id_hex", "left")
        scored = apply_scores(design.withColumn("b_factor", F.lit(0.0)), moved, meta, functions, args or Namespace(), "__heavy" if heavy is not None else None)
        out = out.join(scored, "pair_id", "left")
    return out.drop("pair_id").withColumn("analysis_source_version", F.lit(source_version).cast("long"))
