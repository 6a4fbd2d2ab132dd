"""Structures made for tests: residues with full side chains and a ligand, with seeded noise."""

from __future__ import annotations

import numpy as np

from tessera.sources.formats import ATOM_COLUMNS

SIDE = {
    "ALA": ["CB"],
    "ASP": ["CB", "CG", "OD1", "OD2"],
    "PHE": ["CB", "CG", "CD1", "CD2", "CE1", "CE2", "CZ"],
    "LEU": ["CB", "CG", "CD1", "CD2"],
}


def make(residues=("ALA", "ASP", "PHE", "LEU", "ASP", "ALA"), seed=1, noise=0.0, noise_seed=42, ligand=True, chain="A"):
    rng = np.random.default_rng(seed)
    out = {c: [] for c in ATOM_COLUMNS}

    def add(res, name, atom, hetero, ch):
        x, y, z = np.array([3.8 * res, 0.0, 0.0]) + rng.normal(0, 1.5, 3)
        for c, v in zip(ATOM_COLUMNS, [ch, res, "", name, hetero, atom, atom[0], x, y, z, round(float(rng.uniform(50, 100)), 2)], strict=True):
            out[c].append(v)

    for i, r in enumerate(residues, 1):
        for atom in ["N", "CA", "C", "O", *SIDE[r]]:
            add(i, r, atom, False, chain)
    if ligand:
        for atom in ("C1", "C2", "O1", "O2"):
            add(3, "LIG", atom, True, "B")
    shift = np.random.default_rng(noise_seed).normal(0, noise, (len(out["x"]), 3)) if noise else np.zeros((len(out["x"]), 3))
    for i, c in enumerate("xyz"):
        out[c] = [round(float(v + s), 3) for v, s in zip(out[c], shift[:, i], strict=True)]
    return out
