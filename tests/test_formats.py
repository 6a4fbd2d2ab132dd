from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.sources.formats import ATOM_COLUMNS, bcif, msgpack, text
from tests.structures import make

values = st.recursive(
    st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text() | st.binary(),
    lambda v: st.lists(v, max_size=5) | st.dictionaries(st.text(), v, max_size=5),
    max_leaves=20,
)


@given(values)
@settings(max_examples=150, deadline=None)
def test_msgpack_round_trip(value):
    assert msgpack.unpackb(msgpack.packb(value)) == value


def test_msgpack_sizes_and_single_floats():
    for n in (15, 16, 31, 32, 255, 256, 65535, 65536):
        assert msgpack.unpackb(msgpack.packb([1] * n)) == [1] * n
        assert msgpack.unpackb(msgpack.packb("x" * n)) == "x" * n
        assert msgpack.unpackb(msgpack.packb(b"x" * n)) == b"x" * n
    assert msgpack.unpackb(msgpack.packb(0.1, single_float=True)) == np.float32(0.1)
    with pytest.raises(ValueError):
        msgpack.unpackb(b"\x01\x02")


@given(st.lists(st.integers(-(1 << 31), (1 << 31) - 1)) | st.lists(st.integers(-3, 300)))
@settings(max_examples=150, deadline=None)
def test_integer_encodings(x):
    data, encoding = bcif._encode_ints(np.array(x, np.int64))
    assert bcif.decode(data, encoding).tolist() == x


def test_interval_quantization_and_masks():
    data = np.array([0, 5, 10], "<u1").tobytes()
    chain = [{"kind": "IntervalQuantization", "min": 1.0, "max": 2.0, "numSteps": 11, "srcType": 33}, {"kind": "ByteArray", "type": 4}]
    assert np.allclose(bcif.decode(data, chain), [1.0, 1.5, 2.0])


@pytest.mark.parametrize("form", ["bcif", "cif", "pdb"])
def test_structures_round_trip(form):
    atoms = make()
    if form == "bcif":
        back = bcif.read_atoms(bcif.write_atoms(atoms))
    elif form == "cif":
        back = text.read_mmcif(text.write_mmcif(atoms))
    else:
        back = text.read_pdb(text.write_pdb(atoms))
    for c in ATOM_COLUMNS:
        if c in ("x", "y", "z", "b_factor"):
            assert np.allclose(back[c], atoms[c], atol=1e-3)
        else:
            assert list(back[c]) == list(atoms[c]), c


def test_first_model_only():
    one = text.write_pdb(make()).replace("END\n", "ENDMDL\n")
    assert len(text.read_pdb(one + one)["x"]) == len(make()["x"])


def test_mmcif_quotes_and_text_fields():
    cif = "data_x\n_note\n;loop_\nnot a loop\n;\nloop_\n_atom_site.group_PDB\n_atom_site.label_atom_id\n_atom_site.label_comp_id\n_atom_site.label_asym_id\n_atom_site.label_seq_id\n_atom_site.type_symbol\n_atom_site.Cartn_x\n_atom_site.Cartn_y\n_atom_site.Cartn_z\nATOM \"O5'\" G A 1 O 1.0 2.0 3.0 # end\nHETATM C1 'L X' B . C 1 2 3\n"
    got = text.read_mmcif(cif)
    assert got["atom_name"] == ["O5'", "C1"] and got["res_name"] == ["G", "L X"] and got["hetero"] == [False, True] and got["res_id"] == [1, 0]
    with pytest.raises(ValueError):
        text.read_mmcif("data_x\n_a.b 1\n")
