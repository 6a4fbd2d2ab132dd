"""The MessagePack format for None, bool, int, float, str, bytes, list and dict."""

from __future__ import annotations

import struct
from typing import Any


def packb(value: Any, single_float: bool = False) -> bytes:
    """``value`` in MessagePack; floats with 32 bits if ``single_float``."""
    out = bytearray()
    _pack(value, out, ">f" if single_float else ">d", b"\xca" if single_float else b"\xcb")
    return bytes(out)


def _head(out: bytearray, n: int, fix: tuple[int, int] | None, codes: list[tuple[int, str, int]]) -> None:
    if fix and n < fix[1]:
        out.append(fix[0] | n)
        return
    for code, form, limit in codes:
        if n < limit:
            out.append(code)
            out += struct.pack(form, n)
            return
    raise ValueError("too long for MessagePack")


def _pack(v: Any, out: bytearray, form: str, mark: bytes) -> None:
    if v is None:
        out.append(0xC0)
    elif v is True or v is False:
        out.append(0xC3 if v else 0xC2)
    elif isinstance(v, int):
        _pack_int(v, out)
    elif isinstance(v, float):
        out += mark + struct.pack(form, v)
    elif isinstance(v, str):
        b = v.encode()
        _head(out, len(b), (0xA0, 32), [(0xD9, ">B", 1 << 8), (0xDA, ">H", 1 << 16), (0xDB, ">I", 1 << 32)])
        out += b
    elif isinstance(v, (bytes, bytearray, memoryview)):
        _head(out, len(v), None, [(0xC4, ">B", 1 << 8), (0xC5, ">H", 1 << 16), (0xC6, ">I", 1 << 32)])
        out += v
    elif isinstance(v, (list, tuple)):
        _head(out, len(v), (0x90, 16), [(0xDC, ">H", 1 << 16), (0xDD, ">I", 1 << 32)])
        for x in v:
            _pack(x, out, form, mark)
    elif isinstance(v, dict):
        _head(out, len(v), (0x80, 16), [(0xDE, ">H", 1 << 16), (0xDF, ">I", 1 << 32)])
        for k, x in v.items():
            _pack(k, out, form, mark)
            _pack(x, out, form, mark)
    elif hasattr(v, "tolist"):
        _pack(v.tolist(), out, form, mark)
    else:
        raise TypeError(f"cannot pack {type(v).__name__}")


def _pack_int(v: int, out: bytearray) -> None:
    if 0 <= v < 128:
        out.append(v)
    elif -32 <= v < 0:
        out.append(v & 0xFF)
    else:
        forms = [(0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")] if v >= 0 else [(0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q")]
        for code, form in forms:
            try:
                b = struct.pack(form, v)
            except struct.error:
                continue
            out.append(code)
            out += b
            return
        raise OverflowError("integer beyond 64 bits")


def unpackb(data: bytes) -> Any:
    """The value of one MessagePack document."""
    value, at = _unpack(memoryview(data), 0)
    if at != len(data):
        raise ValueError("bytes behind the MessagePack value")
    return value


# Type bytes of the format.
_SIZED = {
    0xC4: (">B", "bin"), 0xC5: (">H", "bin"), 0xC6: (">I", "bin"),
    0xD9: (">B", "str"), 0xDA: (">H", "str"), 0xDB: (">I", "str"),
    0xDC: (">H", "list"), 0xDD: (">I", "list"), 0xDE: (">H", "map"), 0xDF: (">I", "map"),
}
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}


def _unpack(m: memoryview, at: int) -> tuple[Any, int]:
    c = m[at]
    at += 1
    if c < 0x80:
        return c, at
    if c >= 0xE0:
        return c - 256, at
    if c in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[c], at
    if c in _NUMBERS:
        form = _NUMBERS[c]
        return struct.unpack_from(form, m, at)[0], at + struct.calcsize(form)
    if c < 0x90:
        kind, n = "map", c & 15
    elif c < 0xA0:
        kind, n = "list", c & 15
    elif c < 0xC0:
        kind, n = "str", c & 31
    elif c in _SIZED:
        form, kind = _SIZED[c]
        n = struct.unpack_from(form, m, at)[0]
        at += struct.calcsize(form)
    else:
        raise ValueError(f"unknown MessagePack type {c:#x}")
    if kind in ("bin", "str"):
        if at + n > len(m):
            raise ValueError("MessagePack value cut short")
        raw = bytes(m[at : at + n])
        return (raw if kind == "bin" else raw.decode()), at + n
    if kind == "list":
        items = []
        for _ in range(n):
            x, at = _unpack(m, at)
            items.append(x)
        return items, at
    pairs = {}
    for _ in range(n):
        k, at = _unpack(m, at)
        pairs[k], at = _unpack(m, at)
    return pairs, at
