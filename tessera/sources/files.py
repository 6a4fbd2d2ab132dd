"""Structure files of a directory tree as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def index_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """name (without directory and suffix), path (the first of those with this name), n_paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")
    base = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    return files.select(base.alias("name"), "path").groupBy("name").agg(F.min("path").alias("path"), F.count("*").alias("n_paths"))


def read_structures(spark: SparkSession, root: str, pattern: str = "*.cif") -> DataFrame:
    """name, path, payload (the file's bytes) and form (cif, pdb or bcif, by its suffix) of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    base = F.regexp_extract("path", r"([^/]+?)\.([^./]*)$", 1)
    return files.select(base.alias("name"), "path", F.col("content").alias("payload"), F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).alias("form"))


def structure_atoms(structures: DataFrame, key: str = "name") -> DataFrame:
    """One row for each atom of structures (key, payload, form), with the key as struct_id."""
    from tessera.operators.lake import decode_atoms, encode_structure, explode_atoms

    def encode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            payloads = [encode_structure(bytes(p), f) for p, f in zip(df["payload"], df["form"], strict=True)]
            yield pd.DataFrame({"key": df["key"], "payload": payloads})

    rows = structures.select(F.col(key).cast("string").alias("key"), "payload", "form").mapInPandas(encode, "key string, payload binary")
    return explode_atoms(decode_atoms(rows), "key")
