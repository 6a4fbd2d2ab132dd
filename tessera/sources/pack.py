"""Packs: append-only files of payload records.

A record is ``PACK``, version 1, the id's length (2 bytes), the payload's length (4 bytes), id,
payload, and the payload's CRC-32 (4 bytes), all numbers big-endian.

Each task writes packs of its own, named after a random token, so that writers need no locks and a
task that is run again leaves an orphan at worst. Reads are clustered by pack and offset, one open
file for each pack. Paths go through pyarrow's file systems and may be URIs.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC, VERSION = b"PACK", 1
_HEAD = struct.Struct(">4sBHI")
#: Bytes of a record beside id and payload.
OVERHEAD = _HEAD.size + 4


class Address(NamedTuple):
    """Where a record lies: pack name, record and payload offset, payload length."""

    shard: str
    off: int
    data_off: int
    len: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class PackWriter:
    """Writes packs below ``folder``. A pack is full once its end reaches ``max_bytes`` behind a
    record, so the last record may exceed it."""

    def __init__(self, folder: str, prefix: str = "bcif-pack", max_bytes: int = 1 << 30) -> None:
        self.folder, self.prefix, self.max_bytes = folder.rstrip("/"), prefix, max_bytes
        self.token, self.number, self.stream, self.end, self.name = uuid.uuid4().hex[:12], 0, None, 0, ""
        self.fs, self.root = _open(self.folder)

    def append(self, payload: bytes, record_id: bytes | None = None) -> Address:
        record_id = hashlib.sha256(payload).digest() if record_id is None else record_id
        if self.stream is None:
            self.name = f"{self.prefix}-{self.token}-{self.number:06d}.pack"
            self.fs.create_dir(self.root, recursive=True)
            self.stream, self.end = self.fs.open_output_stream(f"{self.root}/{self.name}"), 0
            self.number += 1
        record = _HEAD.pack(MAGIC, VERSION, len(record_id), len(payload)) + record_id + payload + struct.pack(">I", zlib.crc32(payload))
        self.stream.write(record)
        at = Address(self.name, self.end, self.end + _HEAD.size + len(record_id), len(payload))
        self.end += len(record)
        if self.end >= self.max_bytes:
            self.close()
        return at

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.stream = None


class PackReader:
    """Reads payloads of the packs below ``folder``, keeping the last pack open."""

    def __init__(self, folder: str) -> None:
        self.fs, self.root = _open(folder.rstrip("/"))
        self.name, self.file = "", None

    def read(self, shard: str, data_off: int, length: int, check: bool = True) -> bytes:
        """A payload; IOError if it is cut short or its checksum differs."""
        if shard != self.name or self.file is None:
            self.close()
            self.file, self.name = self.fs.open_input_file(f"{self.root}/{shard}"), shard
        data = self.file.read_at(length + 4 * check, data_off)
        if len(data) < length + 4 * check:
            raise OSError(f"short read in {shard} at {data_off}")
        payload = data[:length]
        if check and struct.unpack(">I", data[length:])[0] != zlib.crc32(payload):
            raise OSError(f"checksum differs in {shard} at {data_off}")
        return payload

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


def fetch(df: DataFrame, folder: str, kind: str = "bcif", check: bool = True) -> DataFrame:
    """``df`` with ``payload`` and ``error`` (null if the payload could be read).

    Rows are clustered by pack and read in the order of offsets. Packs differ in size by design, and
    a row moves its address only.
    """
    shard, off, length = f"{kind}_shard", f"{kind}_data_off", f"{kind}_len"
    names = df.columns

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader(folder)
        for batch in it:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                payloads, errors = [], []
                for s, o, n in zip(*(part.column(names.index(c)).to_pylist() for c in (shard, off, length)), strict=True):
                    try:
                        if not s or o is None or n is None:
                            raise OSError("no address")
                        payloads.append(reader.read(s, o, n, check))
                        errors.append(None)
                    except OSError as e:
                        payloads.append(None)
                        errors.append(str(e))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(payloads, pa.binary()), pa.array(errors, pa.string())], [*names, "payload", "error"])
        reader.close()

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "payload binary", "error string"])
    dealt = df.repartition(shard).sortWithinPartitions(shard, off)
    # Columns go to Python under plain names, as theirs may have dots.
    return dealt.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(read, schema)


def scan_records(path: str) -> Iterator[tuple[bytes, int, int, int, bool, bytes]]:
    """(id, off, data_off, len, crc_ok, payload) of each record of a pack; IOError if it is damaged."""
    files, name = _open(path)
    with files.open_input_file(name) as f:
        off, size = 0, f.size()
        while off < size:
            head = f.read_at(_HEAD.size, off)
            if len(head) < _HEAD.size:
                raise OSError(f"cut short: {path} at {off}")
            magic, version, id_len, length = _HEAD.unpack(head)
            if magic != MAGIC or version != VERSION:
                raise OSError(f"no record: {path} at {off}")
            rest = f.read_at(id_len + length + 4, off + _HEAD.size)
            if len(rest) < id_len + length + 4:
                raise OSError(f"cut short: {path} at {off}")
            payload = rest[id_len : id_len + length]
            yield rest[:id_len], off, off + _HEAD.size + id_len, length, struct.unpack(">I", rest[-4:])[0] == zlib.crc32(payload), payload
            off += OVERHEAD + id_len + length


class PackSource(DataSource):
    """``spark.read.format("pack").load(folder)``: one partition for each pack."""

    @classmethod
    def name(cls) -> str:
        return "pack"

    def schema(self) -> str:
        return "shard string, id binary, off long, data_off long, len int, crc_ok boolean, payload binary"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"])


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        files, root = _open(self.path)
        found = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return [InputPartition(i.base_name) for i in sorted(found, key=lambda i: i.base_name) if i.base_name.endswith(".pack")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for record in scan_records(f"{self.path.rstrip('/')}/{partition.value}"):
            yield (partition.value, *record)


def register(spark: SparkSession) -> None:
    """Make the format ``pack`` known to a session."""
    spark.dataSource.register(PackSource)


def offsets(df: DataFrame, order: str, length: str, id_len: int = 32, parts: int | None = None) -> DataFrame:
    """``df`` with ``off`` and ``data_off`` that records of ``length`` bytes, in one pack by the number
    ``order`` (unique, not null), have.

    A running sum over ranges of ``order``: each range is summed, the sums of the ranges before (one row
    for each) are added to the running sum within a range.
    """
    from pyspark.sql import Window

    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01) if parts > 1 else []
    place = sum(((F.col(order) >= F.lit(c)).cast("int") for c in sorted(set(cuts))), F.lit(0))
    sized = df.withColumn("__part", place).withColumn("__size", (F.col(length) + OVERHEAD + id_len).cast("long"))
    sums = sized.groupBy("__part").agg(F.sum("__size").alias("__sum"))
    earlier = sums.select("__part", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    off = F.col("__base") + F.coalesce(F.sum("__size").over(within), F.lit(0))
    out = sized.join(F.broadcast(earlier), "__part").withColumn("off", off).withColumn("data_off", F.col("off") + _HEAD.size + id_len)
    return out.drop("__part", "__size", "__base")
