"""Lossless byte form of float vectors: block fixed point where every component allows it, raw floats otherwise."""

from __future__ import annotations

import numpy as np

#: Largest power of two by which components are tried to become whole numbers.
MAX_EXPONENT = 15


def pack(x: np.ndarray) -> list[bytes]:
    """Rows of a float32 matrix as bytes; equal rows give equal bytes (0.0 and -0.0 are equal)."""
    x = np.ascontiguousarray(x, dtype=np.float32) + np.float32(0)
    out: list[bytes | None] = [None] * len(x)
    left = np.arange(len(x))
    for e in range(MAX_EXPONENT + 1):
        if not len(left):
            break
        y = x[left] * np.float32(2**e)
        whole = (y == np.rint(y)).all(axis=1)
        top = np.abs(y).max(axis=1, initial=0)
        for limit, kind, code in ((127, np.int8, b"b"), (32767, np.int16, b"h")):
            here = whole & (top <= limit)
            head = code + bytes([e])
            for i, row in zip(left[here], y[here].astype(kind)):
                out[i] = head + row.tobytes()
            whole &= ~here
            if kind is np.int8:
                done = here
            else:
                done = done | here
        left = left[~done]
    for i in left:
        out[i] = b"f\0" + x[i].tobytes()
    return out


def unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """The float32 matrix whose rows were packed."""
    out = np.empty((len(rows), dim), dtype=np.float32)
    heads: dict[bytes, list[int]] = {}
    for i, r in enumerate(rows):
        heads.setdefault(r[:2], []).append(i)
    for head, at in heads.items():
        kind = {b"b": np.int8, b"h": np.int16, b"f": np.float32}[head[:1]]
        flat = np.frombuffer(b"".join(rows[i][2:] for i in at), dtype=kind).reshape(len(at), dim)
        out[at] = flat.astype(np.float32) / np.float32(2 ** head[1])
    return out
