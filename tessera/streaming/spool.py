"""Spool: producers publish directories of structures, a stream stores them in a lake.

A batch is written below ``spool/incoming``, synced, and renamed to ``spool/ready`` in one step. Each
entry is one JSON file that holds everything, so the file source of Structured Streaming takes it
exactly once: the checkpoint moves on only after the lake's commit, and a batch that was committed before
a crash is recognised by the stream's id and the batch number, which the commit itself carries.
"""

from __future__ import annotations

import datetime
import json
import os
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.lake import LakeWriter

_ENTRY = "pdb string, light string, heavy string"


def _sync(path: str) -> None:
    fd = os.open(path, os.O_RDONLY)
    try:
        os.fsync(fd)
    finally:
        os.close(fd)


def folders(lake: str) -> tuple[str, str]:
    """Folders of batches being written and of published ones, made if needed."""
    out = os.path.join(lake, "spool", "incoming"), os.path.join(lake, "spool", "ready")
    for f in out:
        os.makedirs(f, exist_ok=True)
    return out


class StagingWriter:
    """Collects entries of one batch and publishes them together; of one use."""

    def __init__(self, lake: str) -> None:
        self.incoming, self.ready = folders(lake)
        self.name = f"batch-{uuid.uuid4().hex}"
        self.path = os.path.join(self.incoming, self.name)
        os.makedirs(self.path)
        self._count, self._published = 0, False

    @property
    def entry_count(self) -> int:
        return self._count

    def add(self, pdb: str, light: Mapping[str, Any], heavy: Mapping[str, Any] | None = None) -> str:
        if self._published:
            raise RuntimeError("the batch is published")
        name = f"group-{self._count:05d}.json"
        entry = {"pdb": pdb, "light": json.dumps(dict(light)), "heavy": None if heavy is None else json.dumps(dict(heavy))}
        with open(os.path.join(self.path, name), "w") as f:
            f.write(json.dumps(entry) + "\n")
        self._count += 1
        return name.removesuffix(".json")

    def publish(self) -> str | None:
        """Make the batch visible; None and no batch if it is empty."""
        if self._published:
            raise RuntimeError("the batch is published already")
        self._published = True
        if not self._count:
            os.rmdir(self.path)
            return None
        manifest = {"entry_count": self._count, "created_at": datetime.datetime.now(datetime.UTC).isoformat()}
        with open(os.path.join(self.path, "_manifest.json"), "w") as f:
            json.dump(manifest, f)
        for name in os.listdir(self.path):
            _sync(os.path.join(self.path, name))
        _sync(self.path)
        target = os.path.join(self.ready, self.name)
        os.rename(self.path, target)
        _sync(self.ready)
        return target


class SpoolIngester:
    """Stores published batches with a writer; a batch is taken once."""

    def __init__(self, lake: str, writer: LakeWriter) -> None:
        folders(lake)
        self.source, self.checkpoint, self.writer = os.path.join(lake, "spool", "ready"), os.path.join(lake, "spool", "_checkpoint"), writer
        self.ingested = 0

    def _committed(self, stream: str, epoch: int) -> bool:
        """Whether the table has this batch of the stream: its commits carry the stream's id and batch
        number, which ascend."""
        log = self.writer.lake.log
        for v in reversed(log.versions()):
            kind, _, rest = log._read(v)["operation"].partition(" ")
            if kind == "spool":
                of, _, number = rest.rpartition(" ")
                if of == stream and int(number) <= epoch:
                    return int(number) == epoch
        return False

    def _check_manifests(self, df: DataFrame) -> None:
        """ValueError if a published batch does not have as many entries as its manifest says; one row for
        each batch of this trigger reaches the driver."""
        batch = F.element_at(F.split("file", "/"), -2)
        for name, n in df.groupBy(batch.alias("batch")).agg(F.count_distinct("file").alias("n")).collect():
            with open(os.path.join(self.source, name, "_manifest.json")) as f:
                wanted = json.load(f)["entry_count"]
            if n != wanted:
                raise ValueError(f"{name} has {n} entries, its manifest says {wanted}")

    def _store(self, df: DataFrame, epoch: int) -> None:
        with open(os.path.join(self.checkpoint, "metadata")) as f:
            stream = json.load(f)["id"]
        if self._committed(stream, epoch):
            return
        self._check_manifests(df)
        user = self.writer.config.user_schema
        light = F.from_json("light", T.StructType([T.StructField(f.name, f.dataType) for f in user.fields]))
        rows = df.withColumn("l", light).select("pdb", "heavy", *[F.col(f"l.{f.name}") for f in user.fields]).persist()
        n = rows.count()
        if n:
            self.writer.append(rows, payload="pdb", form="pdb", heavy="heavy", operation=f"spool {stream} {epoch}")
        rows.unpersist()
        self.ingested += n

    def _stream(self):  # noqa: ANN202
        spark = self.writer.spark
        stream = spark.readStream.schema(_ENTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "group-*.json").json(self.source)
        stream = stream.select("*", F.col("_metadata.file_path").alias("file"))
        return stream.writeStream.foreachBatch(self._store).option("checkpointLocation", self.checkpoint)

    def run_once(self, run_maintenance: bool = False) -> dict[str, int]:
        """Store everything that is published now."""
        before = self.ingested
        self._stream().trigger(availableNow=True).start().awaitTermination()
        if run_maintenance and self.ingested > before:
            self.writer.maintenance()
        return {"ingested_entries": self.ingested - before, "pending_entries": 0}

    def run_loop(self, interval_seconds: int = 600):  # noqa: ANN201
        """A running query that looks for batches at this interval."""
        return self._stream().trigger(processingTime=f"{interval_seconds} seconds").start()
