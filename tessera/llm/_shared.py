"""Tables that a multi-step operator writes between its steps.

They go to the folder in ``spark.checkpoint.dir``, which driver and executors share, so that the
loss of an executor never loses a finished step. Where the setting is missing, a temporary folder
is used in local mode only; a cluster without the setting is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables between steps, from ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="tessera-")
    return _LOCAL[app]


def keep(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and return the table read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Rows of ids up to which ``small`` broadcasts.
BROADCAST_ROWS = 2_000_000


def small(ids: DataFrame, name: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table of ids (one column of 64-bit integers), written and counted: to be broadcast while it has
    ``rows`` rows at most, 16 MB of ids, so that a join with it needn't move texts; beyond that joins with
    it are shuffled."""
    if [f.dataType.simpleString() for f in ids.schema.fields] != ["bigint"]:
        raise ValueError("only a table of one column of 64-bit integers has a known size")
    table_, _ = keep(ids, name)
    return F.broadcast(table_) if table_.count() <= rows else table_


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` except those of these names, in any case."""
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that later steps no longer read."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
