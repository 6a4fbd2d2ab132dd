"""Schemas: the lake's own columns and user columns from a JSON or YAML file."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import types as T

# Type names of schema files.
_SIMPLE = {
    "binary": T.BinaryType(), "bool": T.BooleanType(), "string": T.StringType(), "date32": T.DateType(), "float32": T.FloatType(), "float64": T.DoubleType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
}
_UNITS = ("s", "ms", "us", "ns")


def parse_type(spec: Any) -> T.DataType:
    """A Spark type from its name, or from {list|large_list: T}, {struct: [field]}, {timestamp: unit}.

    Timestamps are kept in microseconds, of ``ns`` the last three digits go; one with a time zone is an
    instant, one without has no zone.
    """
    if isinstance(spec, str):
        if spec in _SIMPLE:
            return _SIMPLE[spec]
        raise ValueError(f"unknown type {spec!r}")
    if not isinstance(spec, Mapping) or len(spec) != 1:
        raise ValueError(f"unknown type {spec!r}")
    (kind, inner), = spec.items()
    if kind in ("list", "large_list"):
        return T.ArrayType(parse_type(inner))
    if kind == "struct":
        return T.StructType([parse_field(f) for f in inner])
    if kind == "timestamp":
        unit, zone = (inner.get("unit"), inner.get("tz")) if isinstance(inner, Mapping) else (inner, None)
        if unit not in _UNITS:
            raise ValueError(f"unknown timestamp unit {unit!r}")
        return T.TimestampType() if zone else T.TimestampNTZType()
    raise ValueError(f"unknown type {spec!r}")


def parse_field(spec: Mapping[str, Any]) -> T.StructField:
    if "name" not in spec or "type" not in spec:
        raise ValueError(f"a field needs name and type: {spec!r}")
    return T.StructField(str(spec["name"]), parse_type(spec["type"]), bool(spec.get("nullable", True)))


def load_schema(path: str) -> T.StructType:
    """User columns from a .json, .yaml or .yml file with a list ``fields``."""
    name = str(path).lower()
    if not name.endswith((".json", ".yaml", ".yml")):
        raise ValueError("a schema file ends in .json, .yaml or .yml")
    with open(path) as f:
        if name.endswith(".json"):
            config = json.load(f)
        else:
            import yaml

            config = yaml.safe_load(f)
    if not isinstance(config, Mapping) or not isinstance(config.get("fields"), Sequence):
        raise ValueError("a schema file holds a list named fields")
    if not config["fields"]:
        raise ValueError("fields is empty")
    return T.StructType([parse_field(f) for f in config["fields"]])


def core_fields(with_json: bool = True) -> list[T.StructField]:
    """Columns that each row of a lake has."""
    fields = [T.StructField("id", T.BinaryType()), T.StructField("id_hex", T.StringType())]
    for kind in ("bcif", "json")[: 1 + with_json]:
        fields += [
            T.StructField(f"{kind}_shard", T.StringType()),
            T.StructField(f"{kind}_off", T.LongType()),
            T.StructField(f"{kind}_data_off", T.LongType()),
            T.StructField(f"{kind}_len", T.IntegerType()),
        ]
    return fields


def full_schema(user: T.StructType, with_json: bool = True) -> T.StructType:
    """Core columns before user columns; ValueError if a user column has a core column's name."""
    core = core_fields(with_json)
    if clash := {f.name for f in core} & set(user.names):
        raise ValueError(f"reserved column names: {', '.join(sorted(clash))}")
    return T.StructType([*core, *user.fields])
