"""BinaryCIF: MessagePack documents of columns under chains of encodings.

Reads all seven encodings of the public specification. Writes integers by delta, run-length and
packing, floats by fixed point within the tolerances, and strings by string arrays.
"""

from __future__ import annotations

from typing import Any

import numpy as np

from tessera.sources.formats import ATOM_COLUMNS, msgpack

# Type codes of the ByteArray encoding.
_TYPES = {1: "<i1", 2: "<i2", 3: "<i4", 4: "<u1", 5: "<u2", 6: "<u4", 32: "<f4", 33: "<f8"}
_CODES = {np.dtype(t): c for c, t in _TYPES.items()}


def _bytes(x: np.ndarray) -> tuple[bytes, dict]:
    return x.tobytes(), {"kind": "ByteArray", "type": _CODES[x.dtype.newbyteorder("<")]}


def _packed(x: np.ndarray) -> tuple[bytes, list[dict]]:
    """int32 values in the narrowest of one, two and four bytes; limits mark continued values."""
    best: tuple[bytes, list[dict]] | None = None
    unsigned = not len(x) or bool(x.min() >= 0)
    for width in (1, 2):
        dtype = np.dtype(f"<{'u' if unsigned else 'i'}{width}")
        top = np.iinfo(dtype).max
        low = np.iinfo(dtype).min
        wide = x.astype(np.int64)
        repeats = np.where(wide >= 0, wide // top, wide // low if low else 0)
        if repeats.sum() + len(x) > 2 * len(x) + 64:
            continue
        at = np.cumsum(repeats + 1) - 1
        out = np.where(np.repeat(wide, repeats + 1) >= 0, top, low)
        out[at] = np.where(wide >= 0, wide - repeats * top, wide - repeats * low)
        data, form = _bytes(out.astype(dtype))
        if best is None or len(data) < len(best[0]):
            best = data, [{"kind": "IntegerPacking", "byteCount": width, "isUnsigned": unsigned, "srcSize": len(x)}, form]
    if best is None or len(best[0]) >= 4 * len(x):
        data, form = _bytes(x.astype("<i4"))
        return data, [form]
    return best


def _encode_ints(x: np.ndarray) -> tuple[bytes, list[dict]]:
    """The shortest of plain, delta, run-length and both."""
    x = x.astype(np.int32)
    options = [_packed(x)]
    if len(x) > 1:
        wide = x.astype(np.int64)
        steps = np.diff(wide, prepend=wide[0])
        chains = [(x, [])]
        if np.abs(steps).max() < 1 << 31:
            delta = {"kind": "Delta", "origin": int(x[0]), "srcType": 3}
            chains.append((steps.astype(np.int32), [delta]))
            options.append((lambda p: (p[0], [delta, *p[1]]))(_packed(steps.astype(np.int32))))
        for values, chain in chains:
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            runs = np.stack([values[first], np.diff(np.append(first, len(values)))], 1).reshape(-1).astype(np.int32)
            data, forms = _packed(runs)
            options.append((data, [*chain, {"kind": "RunLength", "srcType": 3, "srcSize": len(values)}, *forms]))
    return min(options, key=lambda o: len(o[0]))


def _encode_floats(x: np.ndarray, rtol: float, atol: float) -> tuple[bytes, list[dict]]:
    for digits in range(7):
        factor = 10**digits
        scaled = np.round(x * factor)
        if np.all(np.isfinite(scaled)) and np.abs(scaled).max(initial=0) < 1 << 31 and np.allclose(scaled / factor, x, rtol, atol):
            data, forms = _encode_ints(scaled)
            return data, [{"kind": "FixedPoint", "factor": factor, "srcType": 33}, *forms]
    data, form = _bytes(x.astype("<f8"))
    return data, [form]


def _encode_strings(x: list[str]) -> tuple[bytes, list[dict]]:
    names, at = np.unique(np.array(x, dtype=object).astype(str), return_inverse=True)
    data, forms = _encode_ints(at.reshape(-1))
    offsets, offset_forms = _encode_ints(np.concatenate([[0], np.cumsum([len(n) for n in names])]))
    return data, [
        {"kind": "StringArray", "dataEncoding": forms, "stringData": "".join(names), "offsetEncoding": offset_forms, "offsets": offsets}
    ]


def _column(name: str, data: bytes, encoding: list[dict]) -> dict:
    return {"name": name, "data": {"data": data, "encoding": encoding}, "mask": None}


def write_atoms(atoms: dict[str, Any], rtol: float = 1e-6, atol: float = 1e-4) -> bytes:
    """An atom table as BinaryCIF bytes."""
    n = len(atoms["x"])
    strings = {
        "group_PDB": ["HETATM" if h else "ATOM" for h in atoms["hetero"]],
        "type_symbol": atoms["element"],
        "label_atom_id": atoms["atom_name"],
        "label_alt_id": [""] * n,
        "label_comp_id": atoms["res_name"],
        "label_asym_id": atoms["chain_id"],
        "pdbx_PDB_ins_code": atoms["ins_code"],
        "auth_comp_id": atoms["res_name"],
        "auth_asym_id": atoms["chain_id"],
        "auth_atom_id": atoms["atom_name"],
    }
    ints = {"id": np.arange(1, n + 1), "label_seq_id": atoms["res_id"], "auth_seq_id": atoms["res_id"], "pdbx_PDB_model_num": np.ones(n)}
    floats = {"Cartn_x": atoms["x"], "Cartn_y": atoms["y"], "Cartn_z": atoms["z"], "occupancy": np.ones(n), "B_iso_or_equiv": atoms["b_factor"]}
    columns = [_column(k, *_encode_strings(list(v))) for k, v in strings.items()]
    columns += [_column(k, *_encode_ints(np.asarray(v))) for k, v in ints.items()]
    columns += [_column(k, *_encode_floats(np.asarray(v, float), rtol, atol)) for k, v in floats.items()]
    block = {"header": "structure", "categories": [{"name": "_atom_site", "rowCount": n, "columns": columns}]}
    return msgpack.packb({"version": "0.3.0", "encoder": "tessera", "dataBlocks": [block]})


def decode(data: Any, encoding: list[dict]) -> Any:
    """Undo a chain of encodings, the last first."""
    for e in reversed(encoding):
        kind = e["kind"]
        if kind == "ByteArray":
            data = np.frombuffer(data, _TYPES[e["type"]])
        elif kind == "FixedPoint":
            data = data.astype(np.float64) / e["factor"]
        elif kind == "IntervalQuantization":
            data = e["min"] + data.astype(np.float64) * (e["max"] - e["min"]) / (e["numSteps"] - 1)
        elif kind == "RunLength":
            data = np.repeat(data[::2], data[1::2])
        elif kind == "Delta":
            data = np.cumsum(data.astype(np.int64)) + e["origin"]
        elif kind == "IntegerPacking":
            info = np.iinfo(data.dtype)
            more = data == info.max
            if not e["isUnsigned"]:
                more |= data == info.min
            ends = np.flatnonzero(~more)
            sums = np.cumsum(data.astype(np.int64))[ends]
            data = np.diff(sums, prepend=0)
        elif kind == "StringArray":
            offsets = decode(e["offsets"], e["offsetEncoding"])
            text = e["stringData"]
            names = np.array([text[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)] + [""], dtype=object)
            data = names[decode(data, e["dataEncoding"]).astype(np.int64)]
        else:
            raise ValueError(f"unknown encoding {kind}")
    return data


def read_atoms(data: bytes) -> dict[str, Any]:
    """The atom table of BinaryCIF bytes."""
    document = msgpack.unpackb(data)
    for block in document["dataBlocks"]:
        for category in block["categories"]:
            if category["name"].lstrip("_") == "atom_site":
                columns = {}
                for c in category["columns"]:
                    values = decode(c["data"]["data"], c["data"]["encoding"])
                    if c.get("mask") and values.dtype == object:
                        values = np.where(decode(c["mask"]["data"], c["mask"]["encoding"]) == 0, values, "")
                    columns[c["name"]] = values
                return from_atom_site(columns, category["rowCount"])
    raise ValueError("no atom_site category")


def from_atom_site(c: dict[str, Any], n: int) -> dict[str, Any]:
    """An atom table from columns of the atom_site category, first model only."""

    def pick(*names: str, default: Any = "") -> np.ndarray:
        for name in names:
            if name in c:
                return np.asarray(c[name], dtype=object)
        return np.full(n, default, dtype=object)

    def clean(x: np.ndarray) -> list[str]:
        return ["" if v in (".", "?", None) else str(v) for v in x]

    def ints(x: np.ndarray) -> list[int]:
        return [int(v) if str(v).lstrip("-").isdigit() else 0 for v in x]

    table = {
        "chain_id": clean(pick("auth_asym_id", "label_asym_id")),
        "res_id": ints(pick("auth_seq_id", "label_seq_id", default=0)),
        "ins_code": clean(pick("pdbx_PDB_ins_code")),
        "res_name": clean(pick("auth_comp_id", "label_comp_id")),
        "hetero": [v == "HETATM" for v in pick("group_PDB", default="ATOM")],
        "atom_name": clean(pick("auth_atom_id", "label_atom_id")),
        "element": clean(pick("type_symbol")),
    }
    for key, name in (("x", "Cartn_x"), ("y", "Cartn_y"), ("z", "Cartn_z"), ("b_factor", "B_iso_or_equiv")):
        table[key] = [float(v) if v not in (".", "?", None) else 0.0 for v in pick(name, default=0.0)]
    model = pick("pdbx_PDB_model_num", default=1)
    first = [m == model[0] for m in model] if n else []
    return {k: [v for v, f in zip(table[k], first, strict=True) if f] for k in ATOM_COLUMNS}
