"""Decimal(38,0) columns as 32-bit limbs, so that numpy can add them up exactly.

128-bit totals are summed as four 32-bit limbs in 64-bit integers, which leaves room for 2^31 terms. Sums beyond 38
digits raise an error, as they do in SQL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

LIMBS = 4
#: Values of the highest limb that 38 digits can reach.
HIGHEST = 10**38 >> 96


def limbs(column: pa.Array) -> np.ndarray:
    """Decimal(38,0) values as rows of 32-bit limbs, the highest one signed; null is 0."""
    column = column if column.offset == 0 else pa.concat_arrays([column])
    if column.null_count:
        column = column.fill_null(0)
    raw = np.frombuffer(column.buffers()[1], np.uint32, count=len(column) * LIMBS).reshape(-1, LIMBS).astype(np.int64)
    raw[:, LIMBS - 1] = raw[:, LIMBS - 1].astype(np.int32)
    return raw


def decimals(sums: np.ndarray, known: np.ndarray | None = None) -> pa.Array:
    """The inverse of ``limbs`` for sums of limbs, which may overflow into the next one; null where not ``known``."""
    flat = sums.reshape(-1, LIMBS).copy()
    for k in range(LIMBS - 1):
        flat[:, k + 1] += flat[:, k] >> 32
        flat[:, k] &= 0xFFFFFFFF
    if len(flat) and np.abs(flat[:, LIMBS - 1]).max() > HIGHEST:
        raise OverflowError("a total has more than 38 digits")
    mask = None if known is None or known.all() else pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.decimal128(38, 0), len(flat), [mask, pa.py_buffer(flat.astype(np.uint32).tobytes())])
