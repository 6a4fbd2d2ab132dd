"""mmCIF and PDB texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from tessera.sources.formats import ATOM_COLUMNS
from tessera.sources.formats.bcif import from_atom_site

_TOKEN = re.compile(r"""'(?:[^'\n]|'(?=\S))*'(?=\s|$)|"(?:[^"\n]|"(?=\S))*"(?=\s|$)|#[^\n]*|\S+""")


def _tokens(text: str) -> Iterator[tuple[str, bool]]:
    """Words of a CIF text and whether they were quoted; a line that starts with ; opens a text field."""
    field: list[str] | None = None
    for line in text.splitlines():
        if line.startswith(";"):
            if field is not None:
                yield "\n".join(field), True
                field = None
                line = line[1:]
            else:
                field = [line[1:]]
                continue
        elif field is not None:
            field.append(line)
            continue
        for word in _TOKEN.findall(line):
            if word[0] in "'\"" and len(word) > 1 and word[-1] == word[0]:
                yield word[1:-1], True
            elif word[0] != "#":
                yield word, False


def read_mmcif(data: bytes | str) -> dict[str, Any]:
    """The atom table of an mmCIF text."""
    text = data.decode() if isinstance(data, bytes) else data
    names: list[str] = []
    values: list[str] = []
    inside = False
    for word, quoted in _tokens(text):
        plain = not quoted
        if plain and word.lower() == "loop_":
            if inside and values:
                break
            names, inside = [], False
        elif plain and word.lower().startswith("_atom_site."):
            names.append(word.partition(".")[2])
            inside = True
        elif plain and (word.startswith("_") or word.lower().startswith("data_")):
            if inside and values:
                break
            names, inside = [], False
        elif inside:
            values.append(word)
    if not names:
        raise ValueError("no atom_site category")
    n = len(values) // len(names)
    return from_atom_site({c: values[i :: len(names)] for i, c in enumerate(names)}, n)


def write_mmcif(atoms: dict[str, Any], name: str = "structure") -> str:
    """An atom table as an mmCIF text."""
    columns = "group_PDB id type_symbol label_atom_id label_alt_id label_comp_id label_asym_id label_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z occupancy B_iso_or_equiv auth_seq_id auth_comp_id auth_asym_id auth_atom_id pdbx_PDB_model_num".split()
    lines = [f"data_{name}", "#", "loop_", *[f"_atom_site.{c}" for c in columns]]

    def word(v: Any) -> str:
        v = str(v)
        if not v:
            return "."
        if re.search(r"[\s'\"#;_]", v) or v in (".", "?"):
            return f'"{v}"' if '"' not in v else f"'{v}'"
        return v

    for i in range(len(atoms["x"])):
        a = {k: atoms[k][i] for k in ATOM_COLUMNS}
        lines.append(
            " ".join(
                map(
                    word,
                    [
                        "HETATM" if a["hetero"] else "ATOM", i + 1, a["element"], a["atom_name"], ".", a["res_name"], a["chain_id"], a["res_id"],
                        a["ins_code"] or "?", f"{a['x']:.4f}", f"{a['y']:.4f}", f"{a['z']:.4f}", "1.00", f"{a['b_factor']:.2f}", a["res_id"], a["res_name"],
                        a["chain_id"], a["atom_name"], 1,
                    ],
                )
            ).replace('"?"', "?").replace('"."', ".")
        )
    return "\n".join([*lines, "#", ""])


def read_pdb(data: bytes | str) -> dict[str, Any]:
    """The atom table of a PDB text."""
    text = data.decode() if isinstance(data, bytes) else data
    out: dict[str, list] = {k: [] for k in ATOM_COLUMNS}
    for line in text.splitlines():
        if line.startswith("ENDMDL"):
            break
        if not line.startswith(("ATOM  ", "HETATM")) or line[16:17] not in (" ", "A", ""):
            continue
        name = line[12:16].strip()
        row = {
            "chain_id": line[21:22].strip(),
            "res_id": int(line[22:26]),
            "ins_code": line[26:27].strip(),
            "res_name": line[17:20].strip(),
            "hetero": line.startswith("HETATM"),
            "atom_name": name,
            "element": line[76:78].strip().upper() or name.lstrip("0123456789")[:1],
            "x": float(line[30:38]),
            "y": float(line[38:46]),
            "z": float(line[46:54]),
            "b_factor": float(line[60:66].strip() or 0.0),
        }
        for k in ATOM_COLUMNS:
            out[k].append(row[k])
    return out


def write_pdb(atoms: dict[str, Any]) -> str:
    """An atom table as a PDB text."""
    lines = []
    for i in range(len(atoms["x"])):
        a = {k: atoms[k][i] for k in ATOM_COLUMNS}
        name = a["atom_name"] if len(a["atom_name"]) > 3 else f" {a['atom_name']:<3}"
        lines.append(
            f"{'HETATM' if a['hetero'] else 'ATOM':<6}{(i + 1) % 100000:>5} {name:<4} {a['res_name']:>3} {a['chain_id'][:1] or ' '}{a['res_id']:>4}{a['ins_code'][:1] or ' '}   "
            f"{a['x']:8.3f}{a['y']:8.3f}{a['z']:8.3f}{1.0:6.2f}{a['b_factor']:6.2f}          {a['element']:>2}"
        )
    return "\n".join([*lines, "END", ""])
