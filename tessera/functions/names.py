"""Names, sequences, specifications: column functions and their parsers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def joined_name(columns: Sequence[str], sep: str = "_") -> Column:
    """Columns as text, joined; null reads None."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns])


def with_suffix(name: Column, suffix: str = ".cif") -> Column:
    return F.when(F.endswith(name, F.lit(suffix)), name).otherwise(F.concat(name, F.lit(suffix)))


def fasta_record(name: Column, sequence: Column) -> Column:
    """A FASTA record; null for a null sequence."""
    return F.concat(F.lit(">"), name, F.lit("\n"), sequence)


def first_parts(name: Column, n: int, sep: str = "_") -> Column:
    """The first n parts of a name."""
    return F.array_join(F.slice(F.split(name, re.escape(sep)), 1, n), sep)


def content_id(payload: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(payload, 256)


def expand_contigs(df: DataFrame, spec: str = "contig", key: str = "id") -> DataFrame:
    """Distinct (key, chain, res) of contigs such as ``A10,B12-30,35``; chain A where none is given, and no
    residues of a range whose end is before its start.

    Contigs are dealt out before they are expanded, as one task would else hold the residues of a whole
    file. Residues are told apart as bits of a mask for each 64 of a chain, so that long ranges take few rows."""
    # A count that is given stays: merged by their few bytes, the contigs would meet in few tasks again.
    spark = df.sparkSession
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = df.select(F.col(key).alias("k"), F.col(spec).alias("spec")).repartition(n, "k", "spec")
    part = dealt.select("k", F.explode(F.split(F.regexp_replace("spec", r"\s", ""), ",")).alias("p"))
    chain = F.coalesce(F.nullif(F.regexp_extract("p", r"^([A-Za-z])", 1), F.lit("")), F.lit("A"))
    low = F.regexp_extract("p", r"^[A-Za-z]?(\d+)", 1).cast("int")
    high = F.coalesce(F.nullif(F.regexp_extract("p", r"-[A-Za-z]?(\d+)$", 1), F.lit("")).cast("int"), F.col("low"))
    part = part.select("k", "p", chain.alias("chain"), low.alias("low")).select("k", "chain", "low", high.alias("high"))
    blocks = F.when(F.col("low") <= F.col("high"), F.sequence(F.shiftright("low", 6), F.shiftright("high", 6)))
    part = part.select("k", "chain", "low", "high", F.explode(blocks).alias("block"))
    start = F.col("block") * 64
    part = part.select("k", "chain", "block", F.greatest("low", start).alias("low"), F.least("high", start + 63).alias("high"))
    mask = F.bit_or(F.expr("shiftleft(-1L, low - block * 64) & shiftrightunsigned(-1L, block * 64 + 63 - high)"))
    masks = part.groupBy("k", "chain", "block").agg(F.min("low").alias("low"), F.max("high").alias("high"), mask.alias("mask"))
    res = masks.select("k", "chain", "mask", F.explode(F.sequence("low", "high")).alias("res"))
    return res.filter("getbit(mask, res & 63) = 1").select(F.col("k").alias(key), "chain", "res")


def expand_contig(spec: str) -> list[tuple[str, int]]:
    """The same for one contig, sorted."""
    out = set()
    for part in spec.replace(" ", "").split(","):
        m = re.fullmatch(r"([A-Za-z]?)(\d+)(?:-[A-Za-z]?(\d+))?", part)
        if not m:
            raise ValueError(f"no contig: {part!r}")
        out |= {(m[1] or "A", r) for r in range(int(m[2]), int(m[3] or m[2]) + 1)}
    return sorted(out)


def parse_residue(place: str) -> tuple[str, int]:
    """Chain and number of a residue such as A10."""
    return place[0], int(place[1:])


def rename(column: Column, renames: Sequence[tuple[str, str]]) -> Column:
    """Values renamed by each (old, new) in turn, so that later ones see earlier results."""
    for old, new in renames:
        column = F.when(column == old, F.lit(new)).otherwise(column)
    return column


def rename_residues(atoms: DataFrame, specs: Sequence[str]) -> DataFrame:
    """Residue names by ``OLD=NEW``, in turn."""
    return atoms.withColumn("res_name", rename(F.col("res_name"), [tuple(s.split("=", 1)) for s in specs]))


def rename_residue_atoms(atoms: DataFrame, specs: Sequence[str]) -> DataFrame:
    """Atoms and residues by ``OLD:NEW=A1:B1,A2:B2``, in turn; a spec's residues are those of its old
    name, whose atoms are renamed in turn before the residue is."""
    for spec in specs:
        left, _, right = spec.partition("=")
        old, new = left.split(":")
        mine = F.col("res_name") == old
        atom = rename(F.col("atom_name"), [tuple(p.split(":")) for p in right.split(",") if p])
        atoms = atoms.withColumn("atom_name", F.when(mine, atom).otherwise(F.col("atom_name")))
        atoms = atoms.withColumn("res_name", F.when(mine, F.lit(new)).otherwise(F.col("res_name")))
    return atoms


def as_polymer(atoms: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Residues of these names are no hetero atoms."""
    return atoms.withColumn("hetero", F.when(F.col("res_name").isin(*codes), F.lit(False)).otherwise(F.col("hetero"))) if codes else atoms


def drop_end_oxygen(atoms: DataFrame) -> DataFrame:
    """Without non-hetero OXT atoms; values joined to the atoms go with them."""
    return atoms.filter(F.col("hetero") | (F.col("atom_name") != "OXT"))


def sequences(atoms: DataFrame, chains: Sequence[str] = ("A",), struct: str = "struct_id") -> DataFrame:
    """One-letter sequence of the first of ``chains`` that each structure has, of non-hetero residues;
    names that have no letter read X."""
    from tessera.operators.geometry import LETTERS

    letters = F.create_map(*[F.lit(x) for p in LETTERS.items() for x in p])
    residue = atoms.filter(F.col("chain_id").isin(*chains) & ~F.col("hetero")).groupBy(struct, "chain_id", "res_id", "ins_code").agg(F.min("atom_idx").alias("at"), F.min_by("res_name", "atom_idx").alias("name"))
    letter = F.struct("at", F.coalesce(letters[F.col("name")], F.lit("X")).alias("l"))
    chain = residue.groupBy(struct, "chain_id").agg(F.sort_array(F.collect_list(letter)).alias("ls"), F.min("at").alias("at"))
    return chain.groupBy(struct).agg(F.array_join(F.transform(F.min_by("ls", "at"), lambda x: x["l"]), "").alias("sequence"))
