"""A lake: a versioned table of structures' metadata, and packs with their payloads."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import names
from tessera.operators import checks, tables
from tessera.sources import pack
from tessera.sources.formats import ATOM_COLUMNS, ATOMS_TYPE, bcif, msgpack, text
from tessera.sources.schema import full_schema
from tessera.sources.table_log import FILE, PLACE, RetryConfig, TableLog

#: Columns by which a payload is found.
ADDRESS = ["bcif_shard", "bcif_data_off", "bcif_len"]
#: Bytes of a table file after compaction.
TARGET_SIZE = 1 << 28


@dataclass(frozen=True)
class WriterConfig:
    """Where and how a writer stores structures. Serializers change metadata before it is stored."""

    path: str
    user_schema: T.StructType = T.StructType([])
    batch_size: int = 100
    shard_max_bytes: int = 1 << 30
    bcif_prefix: str = "bcif-pack"
    json_prefix: str = "json-pack"
    write_json_shards: bool = True
    rtol: float = 1e-6
    atol: float = 1e-4
    zstd_level: int = 12
    light_serializer: Callable[[dict], dict] | None = None
    heavy_serializer: Callable[[dict], dict] | None = None
    retry_config: RetryConfig | None = None


def encode_structure(data: bytes | str, form: str, rtol: float = 1e-6, atol: float = 1e-4) -> bytes:
    """A structure as BinaryCIF; ``form`` is cif, pdb or bcif."""
    if form == "bcif":
        return bytes(data)
    if form not in ("cif", "pdb"):
        raise ValueError(f"unknown format {form!r}")
    return bcif.write_atoms(text.read_mmcif(data) if form == "cif" else text.read_pdb(data), rtol, atol)


def encode_heavy(value: Mapping[str, Any], level: int = 12) -> bytes:
    """Heavy metadata as compressed MessagePack; floats have 32 bits."""
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(msgpack.packb(dict(value), single_float=True))


def decode_heavy(data: bytes) -> dict[str, Any]:
    import zstandard

    return msgpack.unpackb(zstandard.ZstdDecompressor().decompress(data))


def decode_atoms(df: DataFrame) -> DataFrame:
    """``df`` with ``atoms``, decoded from ``payload``; null where there is none."""

    @F.pandas_udf(ATOMS_TYPE)
    def atoms(payload):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(p: bytes | None) -> list[dict] | None:
            if p is None:
                return None
            t = bcif.read_atoms(p)
            return [dict(zip(["atom_idx", *ATOM_COLUMNS], (i, *row), strict=True)) for i, row in enumerate(zip(*(t[c] for c in ATOM_COLUMNS), strict=True))]

        return pd.Series([one(p) for p in payload])

    return df.withColumn("atoms", atoms("payload"))


def explode_atoms(df: DataFrame, struct: str = "id_hex") -> DataFrame:
    """One row for each atom, with the structure's key as struct_id."""
    return df.select(F.col(struct).alias("struct_id"), F.inline("atoms"))


class StructureLake:
    """The lake at ``path``: ``table/`` holds the versioned table and ``shards/`` the packs."""

    def __init__(self, spark: SparkSession, path: str, create: bool = False, retry_config: RetryConfig | None = None) -> None:
        self.spark, self.path = spark, str(path).rstrip("/")
        self.shards = f"{self.path}/shards"
        self.log = TableLog(spark, f"{self.path}/table", retry_config)
        self._cache: DataFrame | None = None
        self.load(create)

    def load(self, create: bool = False) -> bool:
        if not self.log.exists():
            if not create:
                raise RuntimeError(f"no lake at {self.path}")
            self.log.create(full_schema(T.StructType([])))
        return True

    def __repr__(self) -> str:
        return f"StructureLake({self.path!r}, rows={self.nrow()})"

    # Reading

    def version(self) -> int:
        return self.log.version()

    def df(self, version: int | None = None) -> DataFrame:
        """All rows, of a given version if wanted."""
        return self.log.read(version)

    def to_pandas(self):  # noqa: ANN201
        return self.df().toPandas()

    def nrow(self) -> int:
        """Number of rows, from the log alone."""
        return sum(self.log.snapshot().files.values())

    def query(self, condition: Column | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        df = self.df() if condition is None else self.df().filter(condition)
        return df.select(*columns) if columns else df

    def check_exists(self, keys: Mapping[str, Any]) -> bool:
        return checks.exists(self.df(), keys)

    def check_complete(self, expected: Sequence[Mapping[str, Any]], key_columns: Sequence[str] | None = None) -> tuple[bool, set[tuple], set[tuple]]:
        """Whether all expected keys exist, those that do and those that don't."""
        if not expected:
            raise ValueError("no expected keys")
        columns = list(key_columns or expected[0])
        fields = {f.name: f.dataType for f in self.log.snapshot().schema.fields}
        schema = T.StructType([T.StructField(c, fields[c]) for c in columns])
        wanted = self.spark.createDataFrame([tuple(k[c] for c in columns) for k in expected], schema)
        found, missing = checks.split_complete(wanted, self.df(), columns)
        there, gone = ({tuple(r) for r in x.collect()} for x in (found, missing))
        return not gone, there, gone

    def load_index_cache(self, columns: str | Sequence[str] | None = None, filters: Mapping[str, Sequence[Any]] | None = None) -> bool:
        """Keep the addresses, further columns and wanted rows for lookups."""
        if self._cache is not None:
            self._cache.unpersist()
        self._cache = checks.project(self.df(), ADDRESS, columns, filters).cache()
        return True

    def load_row(self, keys: Mapping[str, Any]) -> dict[str, Any]:
        if self._cache is None:
            raise ValueError("the index cache is not loaded")
        return checks.the_row(self._cache, keys)

    def load_atoms(self, keys: Mapping[str, Any], return_row: bool = False):  # noqa: ANN201
        """The atom table of the only structure with these values."""
        row = self.load_row(keys)
        reader = pack.PackReader(self.shards)
        atoms = bcif.read_atoms(reader.read(*(row[c] for c in ADDRESS)))
        reader.close()
        return (atoms, row) if return_row else atoms

    def fetch(self, df: DataFrame | None = None, kind: str = "bcif", check: bool = True) -> DataFrame:
        """Rows with their payloads."""
        return pack.fetch(self.df() if df is None else df, self.shards, kind, check)

    def atoms(self, df: DataFrame | None = None, struct: str = "id_hex") -> DataFrame:
        """One row for each atom of the structures."""
        return explode_atoms(decode_atoms(self.fetch(df)), struct)

    def heavy(self, df: DataFrame | None = None) -> DataFrame:
        """Rows with their heavy metadata as JSON; null where there is none."""
        found = self.fetch((self.df() if df is None else df).filter("json_len > 0"), "json")

        @F.pandas_udf("string")
        def as_json(payload):  # noqa: ANN001, ANN202
            return payload.map(lambda p: None if p is None else json.dumps(decode_heavy(p)))

        return found.withColumn("heavy", as_json("payload")).drop("payload")

    def validate_entries(self, progress: Observation | None = None) -> DataFrame:
        """(id, error) of rows whose payload is not addressed, cut short or damaged. ``progress`` gets the
        numbers of rows read (scanned) and found invalid, once the result is computed."""
        read = self.fetch(self.df().select("id", *ADDRESS))
        if progress is not None:
            read = read.observe(progress, F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("error").isNotNull()).alias("invalid"))
        return read.filter("error is not null").select("id", "error")

    # Export

    def extract_cif(
        self,
        df: DataFrame | None = None,
        out_dir: str | None = None,
        file_name_cols: str | Sequence[str] | None = None,
        overwrite: bool = False,
        as_str: bool = False,
        bcif_shard: str | Sequence[str] | None = None,
        bcif_data_off: int | Sequence[int] | None = None,
        bcif_len: int | Sequence[int] | None = None,
        file_names: str | Sequence[str] | None = None,
    ) -> DataFrame | str | list[str]:
        """mmCIF texts of rows, written to ``out_dir`` or returned with ``as_str``.

        Rows come as ``df`` (file names from ``file_name_cols``) or as addresses with ``file_names``.
        Files that exist stay unless ``overwrite``; rows that fail have an error and no file. Each task
        writes its own files, so that on a cluster ``out_dir`` must be a folder that all executors see.
        """
        lists = [bcif_shard, bcif_data_off, bcif_len, file_names]
        if out_dir is None and not as_str:
            raise ValueError("out_dir is needed")
        if df is not None and any(x is not None for x in lists):
            raise ValueError("give rows either as df or as addresses")
        if df is None:
            if file_name_cols is not None:
                raise ValueError("file_name_cols needs df")
            if any(x is None for x in lists):
                raise ValueError("give df, or shard, offset, length and file name")
            wrapped = [[x] if isinstance(x, (str, int)) else list(x) for x in lists]
            df = self.spark.createDataFrame(list(zip(*wrapped, strict=True)), "bcif_shard string, bcif_data_off long, bcif_len int, file_name string")
        else:
            if missing := set(ADDRESS) - set(df.columns):
                raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
            cols = [file_name_cols] if isinstance(file_name_cols, str) else list(file_name_cols or ["name"])
            df = df.withColumn("file_name", names.joined_name(cols))
        rows = self.fetch(df.select(*ADDRESS, names.with_suffix(F.col("file_name")).alias("file_name")))

        def convert(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                out = []
                for r in batch.to_pylist():
                    cif, error = None, r["error"]
                    if error is None:
                        try:
                            cif = text.write_mmcif(bcif.read_atoms(r["payload"]))
                            if out_dir is not None and not as_str:
                                target = os.path.join(out_dir, r["file_name"])
                                if overwrite or not os.path.exists(target):
                                    os.makedirs(out_dir, exist_ok=True)
                                    with open(target, "w") as f:
                                        f.write(cif)
                        except (ValueError, KeyError, OSError) as e:
                            error = str(e)
                    out.append({"file_name": r["file_name"], "cif": cif if as_str else None, "error": error})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("file_name", pa.string()), ("cif", pa.string()), ("error", pa.string())]))

        made = rows.mapInArrow(convert, "file_name string, cif string, error string")
        if as_str:
            texts = [r["cif"] for r in made.collect()]
            return texts[0] if len(texts) == 1 else texts
        # The files are written now, by the tasks; what became of each is kept with them.
        done = made.select("file_name", "error").persist()
        done.count()
        return done

    def dump_cif(self, keys: Mapping[str, Any] | None = None, path: str = "dump.cif", seed: int | None = None) -> str:
        """Write one structure as mmCIF: the first row with these values, or with ``seed`` a random one.
        ValueError if there is none. Returns its text."""
        rows = self.df() if not keys else self.df().filter(checks.equals(keys))
        order = F.rand(seed) if seed is not None else F.col("id_hex")
        found = rows.orderBy(order).limit(1).select(*ADDRESS).collect()
        if not found:
            raise ValueError("no such row")
        reader = pack.PackReader(self.shards)
        cif = text.write_mmcif(bcif.read_atoms(reader.read(*found[0])))
        reader.close()
        with open(path, "w") as f:
            f.write(cif)
        return cif

    def to_fasta(self, path: str, name_cols: str | Sequence[str] = "name", sep: str = "_") -> DataFrame | None:
        """FASTA records of all rows with a sequence, as text files below ``path``."""
        df = self.df()
        cols = [name_cols] if isinstance(name_cols, str) else list(name_cols)
        if "sequence" not in df.columns:
            return None
        if unknown := set(cols) - set(df.columns):
            raise ValueError(f"unknown columns: {', '.join(sorted(unknown))}")
        records = df.filter("sequence is not null").select(names.fasta_record(names.joined_name(cols, sep), F.col("sequence")).alias("value"))
        records.write.mode("overwrite").text(path)
        return records

    def get_seq(self, df: DataFrame | None = None, chains: Sequence[str] = ("A",), struct: str = "id_hex") -> DataFrame:
        """struct_id and one-letter sequence of structures."""
        return names.sequences(self.atoms(df, struct), chains)

    # Changes

    def append(self, df: DataFrame) -> int:
        """Add rows; columns that the table lacks are added to it."""
        schema = self.log.snapshot().schema
        new = [f for f in df.schema.fields if f.name not in schema.names]
        return self.log.append(df, T.StructType([*schema.fields, *new]) if new else None)

    def delete(self, keys: Mapping[str, Any]) -> None:
        """Remove the rows with these values (None: null); rewrites only files that hold some."""
        condition = checks.equals(keys, null_matches=True)
        touched = self.log.files_where(condition)
        if touched:
            self.log.rewrite("delete", touched, tables.delete_where(self.log.read(files=touched), condition))

    def dedupe_by(self, column: str = "name", dry_run: bool = False, compat: bool = False) -> int:
        """Keep the first row of each value, by time of its commit and place in its file. With
        ``compat`` all rows go that share the content of a later one, as a delete by content would.
        Returns how many rows go."""
        order = [FILE, PLACE]
        rows = self.log.read(places=True)
        later = tables.later_duplicates(rows, column, order)
        if compat:
            later = rows.join(later.select("id_hex").distinct(), "id_hex", "left_semi")
        count = later.count()
        if count and not dry_run:
            touched = sorted(r[0] for r in later.select(FILE).distinct().collect())
            keep = self.log.read(files=touched, places=True).join(later.select(*order), order, "left_anti").drop(*order)
            self.log.rewrite("dedupe", touched, keep)
        return count

    def merge(self, source: DataFrame, on: str = "id_hex", ignore_row_count: bool = False) -> None:
        """Update matching rows with all columns of ``source``, adding columns the table lacks.
        ValueError if keys of ``source`` repeat, or the row counts differ without the flag."""
        tables.assert_unique(source, on)
        rows = self.df()
        if not ignore_row_count:
            tables.assert_same_count(rows, source)
        schema = self.log.snapshot().schema
        new = [f for f in source.schema.fields if f.name not in schema.names]
        touched = sorted(r[0] for r in self.log.read(places=True).join(source.select(on), on, "left_semi").select(FILE).distinct().collect())
        merged = tables.merge_update(self.log.read(files=touched), source, on) if touched else rows.limit(0)
        self.log.rewrite("merge", touched, merged, T.StructType([*schema.fields, *new]))

    def maintenance(self, target_size: int = TARGET_SIZE, retention_hours: float = 0.0, by: str = "name", reload: bool = False) -> bool:
        """Compact the table into files of about ``target_size``, clustered by a column if it has it,
        and delete files that no recent version needs."""
        s = self.log.snapshot()
        if s.files:
            df = self.df()
            size = sum(self._size(f) for f in s.files)
            n = max(1, -(-size // target_size))
            dealt = tables.cluster(df, by, n) if by in df.columns else df.repartition(n)
            self.log.rewrite("optimize", sorted(s.files), dealt)
        self.log.vacuum(retention_hours)
        if reload and self._cache is not None:
            self.load_index_cache()
        return True

    def _size(self, name: str) -> int:
        fs, p = self.log._fs(f"{self.log.path}/{name}")
        return fs.getFileStatus(p).getLen()


class LakeWriter:
    """Stores structures one by one or from DataFrames.

    Packs are complete before the table's commit, so a crash leaves bytes that no row names, never a
    row without bytes.
    """

    def __init__(self, spark: SparkSession, config: WriterConfig) -> None:
        self.config = config
        self.schema = full_schema(config.user_schema, config.write_json_shards)
        self.spark = spark
        log = TableLog(spark, f"{config.path.rstrip('/')}/table", config.retry_config)
        if not log.exists():
            log.create(self.schema)
        self.lake = StructureLake(spark, config.path, retry_config=config.retry_config)
        self._pending: list[tuple[bytes, dict, bytes | None]] = []

    def write_cif(self, data: bytes | str, light: Mapping[str, Any], heavy: Mapping[str, Any] | None = None) -> dict[str, str]:
        return self._write(encode_structure(data, "cif", self.config.rtol, self.config.atol), light, heavy)

    def write_cif_file(self, path: str, light: Mapping[str, Any], heavy: Mapping[str, Any] | None = None) -> dict[str, str]:
        with open(path, "rb") as f:
            return self.write_cif(f.read(), light, heavy)

    def write_pdb(self, data: bytes | str, light: Mapping[str, Any], heavy: Mapping[str, Any] | None = None) -> dict[str, str]:
        return self._write(encode_structure(data, "pdb", self.config.rtol, self.config.atol), light, heavy)

    def write_pdb_file(self, path: str, light: Mapping[str, Any], heavy: Mapping[str, Any] | None = None) -> dict[str, str]:
        with open(path, "rb") as f:
            return self.write_pdb(f.read(), light, heavy)

    def write_bcif(self, data: bytes, light: Mapping[str, Any], heavy: Mapping[str, Any] | None = None) -> dict[str, str]:
        return self._write(data, light, heavy)

    def _write(self, payload: bytes, light: Mapping[str, Any], heavy: Mapping[str, Any] | None) -> dict[str, str]:
        c = self.config
        light = c.light_serializer(dict(light)) if c.light_serializer else dict(light)
        packed = None
        if heavy is not None and c.write_json_shards:
            packed = encode_heavy(c.heavy_serializer(dict(heavy)) if c.heavy_serializer else heavy, c.zstd_level)
        self._pending.append((payload, light, packed))
        if len(self._pending) >= c.batch_size:
            self.flush()
        return {"id_hex": hashlib.sha256(payload).hexdigest()}

    def flush(self) -> None:
        if not self._pending:
            return
        c = self.config
        main, side = (pack.PackWriter(self.lake.shards, p, c.shard_max_bytes) for p in (c.bcif_prefix, c.json_prefix))
        rows = []
        for payload, light, packed in self._pending:
            row = {f.name: None for f in self.schema.fields} | _address("bcif", main.append(payload))
            if c.write_json_shards:
                row |= _address("json", side.append(packed) if packed is not None else None)
            digest = hashlib.sha256(payload)
            row |= {"id": digest.digest(), "id_hex": digest.hexdigest()} | {k: v for k, v in light.items() if k in row}
            rows.append(tuple(row[f.name] for f in self.schema.fields))
        main.close()
        side.close()
        self.lake.log.append(self.spark.createDataFrame(rows, self.schema).coalesce(1))
        self._pending = []

    def finalize(self) -> None:
        self.flush()

    def append(self, df: DataFrame, payload: str = "payload", form: str = "bcif", heavy: str | None = None, operation: str = "append") -> int:
        """Store a DataFrame of structures: each task writes packs of its own and returns addresses,
        which become the table's new rows. ``heavy`` names a column of JSON objects. The writer's
        serializers change each row's user columns and heavy object. ``operation`` names the commit."""
        c, schema, shards = self.config, self.schema, self.lake.shards
        arrow = [f.name for f in schema.fields]

        def store(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            main, side = (pack.PackWriter(shards, p, c.shard_max_bytes) for p in (c.bcif_prefix, c.json_prefix))
            for batch in it:
                out = []
                for r in batch.to_pylist():
                    data = encode_structure(r[payload], form, c.rtol, c.atol)
                    light = {f.name: r.get(f.name) for f in c.user_schema.fields}
                    light = c.light_serializer(light) if c.light_serializer else light
                    row = {n: r.get(n) for n in arrow} | {k: v for k, v in light.items() if k in arrow} | _address("bcif", main.append(data))
                    if c.write_json_shards:
                        packed = None
                        if heavy is not None and r[heavy] is not None:
                            more = json.loads(r[heavy])
                            packed = encode_heavy(c.heavy_serializer(more) if c.heavy_serializer else more, c.zstd_level)
                        row |= _address("json", side.append(packed) if packed is not None else None)
                    digest = hashlib.sha256(data)
                    row |= {"id": digest.digest(), "id_hex": digest.hexdigest()}
                    out.append(row)
                yield pa.RecordBatch.from_pylist(out, to_arrow)
            main.close()
            side.close()

        from pyspark.sql.pandas.types import to_arrow_schema

        to_arrow = to_arrow_schema(schema)
        return self.lake.log.append(df.mapInArrow(store, schema), operation=operation)

    def row_count(self) -> int:
        return self.lake.nrow()

    def check_exists(self, keys: Mapping[str, Any]) -> bool:
        return self.lake.check_exists(keys)

    def check_complete(self, expected: Sequence[Mapping[str, Any]], key_columns: Sequence[str] | None = None) -> tuple[bool, set, set]:
        return self.lake.check_complete(expected, key_columns)

    def query(self, condition: Column | str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        return self.lake.query(condition, columns)

    def delete(self, keys: Mapping[str, Any]) -> None:
        self.lake.delete(keys)

    def maintenance(self, target_size: int = TARGET_SIZE, retention_hours: float = 1.0) -> bool:
        return self.lake.maintenance(target_size, retention_hours)


def _address(kind: str, at: pack.Address | None) -> dict[str, Any]:
    """Columns of an address; empty text and 0 where nothing is stored."""
    at = at or pack.Address("", 0, 0, 0)
    return {f"{kind}_shard": at.shard, f"{kind}_off": at.off, f"{kind}_data_off": at.data_off, f"{kind}_len": at.len}
