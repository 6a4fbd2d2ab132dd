"""Command line: ``python -m tessera.cli extract|ingest|analyse ...``.

``analyse`` takes designs from a lake, a folder of structure files or one file, and merges the scores; with
``--dont-merge`` it leaves them at ``--staging-path``, from where ``--merge-only`` merges them.
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.checks import equals
from tessera.operators.lake import LakeWriter, StructureLake, WriterConfig
from tessera.operators.scores import BUILT_IN, Registry
from tessera.plans.analysis import analyse, single_design
from tessera.sources.files import read_structures, structure_atoms
from tessera.sources.schema import load_schema
from tessera.streaming.spool import SpoolIngester


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    x = sub.add_parser("extract", help="write structures as mmCIF")
    x.add_argument("name")
    x.add_argument("--sample", type=int, default=0)
    x.add_argument("--seed", type=int, default=42)
    x.add_argument("--lake", default=os.environ.get("TESSERA_LAKE"))
    x.add_argument("--out-dir", default=".")
    i = sub.add_parser("ingest", help="store published batches")
    i.add_argument("--lake", required=True)
    i.add_argument("--schema", required=True, help="user columns, JSON or YAML")
    i.add_argument("--interval", type=int, default=600)
    i.add_argument("--once", action="store_true")
    i.add_argument("--batch-size", type=int, default=1000)
    i.add_argument("--shard-size", type=int, default=1 << 30, help="bytes of a pack file")
    i.add_argument("--maintenance", action="store_true")
    a = sub.add_parser("analyse", help="score predictions against designs and merge the scores")
    a.add_argument("--lake", required=True)
    a.add_argument("--snapshot-ver", type=int, help="version of the lake to score; the latest if not given")
    given = a.add_mutually_exclusive_group()
    given.add_argument("--design-lake")
    given.add_argument("--design-dir", help="folder of cif, pdb or bcif files, named as the predictions")
    given.add_argument("--design-pdb", help="one file, the design of all predictions")
    a.add_argument("--plugin-dir")
    a.add_argument("--plugins", nargs="*", help=f"score functions to run: {', '.join(BUILT_IN)}, or those of --plugin-dir, all of which run if none is named")
    a.add_argument("--staging-path", help="folder for the scores between scoring and merging")
    a.add_argument("--dont-merge", action="store_true")
    a.add_argument("--merge-only", action="store_true")
    a.add_argument("--ncaa", nargs="*", action="extend", default=[])
    a.add_argument("--rename-residues", nargs="*", default=[])
    a.add_argument("--rename-atoms", nargs="*", default=[])
    a.add_argument("--seq-mismatch", action="store_true")
    a.add_argument("--ignore-row-count-mismatch", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    top.tessera_commands = sub.choices
    return top


def _designs(spark: SparkSession, args: argparse.Namespace, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name and design_id of the designs, and their atoms."""
    if args.design_lake:
        lake = StructureLake(spark, args.design_lake)
        return lake.df().selectExpr("name", "id_hex as design_id"), lake.atoms()
    files = read_structures(spark, args.design_dir or args.design_pdb, "*.{cif,pdb,bcif}")
    if args.design_dir:
        return files.selectExpr("name", "name as design_id"), structure_atoms(files)
    files = files.withColumn("name", F.lit("design"))
    return single_design(rows, "design"), structure_atoms(files)


def main(argv: list[str] | None = None) -> int:
    top = parser()
    known, _ = top.parse_known_args(argv)
    functions = []
    if known.command == "analyse":
        options = top.tessera_commands["analyse"]
        functions = [BUILT_IN[n] for n in known.plugins or () if n in BUILT_IN]
        for f in functions:
            f.register_args(options)
        if known.plugin_dir:
            functions += Registry().load(known.plugin_dir, known.plugins, options)
        if unknown := set(known.plugins or ()) - {f.name for f in functions}:
            top.error(f"no score function {', '.join(sorted(unknown))}")
        if (known.dont_merge or known.merge_only) and not known.staging_path:
            top.error("give --staging-path")
        if not known.merge_only and not (known.design_lake or known.design_dir or known.design_pdb):
            top.error("give --design-lake, --design-dir or --design-pdb")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName(f"tessera-{args.command}").getOrCreate()
    if args.command == "extract":
        if not args.lake:
            top.error("give --lake or set TESSERA_LAKE")
        lake = StructureLake(spark, args.lake)
        found = lake.query(equals({"name": args.name, "sample": args.sample, "seed": args.seed}))
        lake.extract_cif(found, args.out_dir, ["name", "sample", "seed"]).show(truncate=False)
    elif args.command == "ingest":
        writer = LakeWriter(spark, WriterConfig(args.lake, load_schema(args.schema), batch_size=args.batch_size, shard_max_bytes=args.shard_size))
        spool = SpoolIngester(args.lake, writer)
        if args.once:
            print(spool.run_once(args.maintenance))
        else:
            spool.run_loop(args.interval).awaitTermination()
    else:
        lake = StructureLake(spark, args.lake)
        if args.merge_only:
            scores = spark.read.parquet(args.staging_path)
        else:
            version = lake.version() if args.snapshot_ver is None else args.snapshot_ver
            rows = lake.df(version)
            named, atoms = _designs(spark, args, rows)
            confidences = lake.heavy(rows).select("id_hex", "heavy") if "json_shard" in rows.columns else None
            scores = analyse(
                rows, named, lake.atoms(rows), atoms, functions, args, args.ncaa, args.rename_residues, args.rename_atoms, args.seq_mismatch, version, confidences
            )
        if args.dry_run:
            scores.explain("formatted")
        elif args.dont_merge:
            scores.write.mode("overwrite").parquet(args.staging_path)
        else:
            lake.merge(scores, ignore_row_count=args.ignore_row_count_mismatch)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
