"""CRC-32 of joined pieces from the CRC-32 of each piece.

Appending ``t`` 32-bit ids to a prefix multiplies the prefix's CRC by a fixed linear
map, so the CRC of a document is the XOR of its chunks' CRCs, each shifted by
the ids that follow it.
"""

from __future__ import annotations

import numpy as np

_POLY = 0xEDB88320
_TABLES: list[np.ndarray] = []


def _step(tables: np.ndarray, c: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def _tables() -> list[np.ndarray]:
    """For each bit b: lookup tables (4 x 256) of the map that appends 2**b ids."""
    if not _TABLES:
        columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
        for _ in range(32):  # one zero bit at a time: 32 bits are one id
            columns = np.where(columns & 1, (columns >> np.uint32(1)) ^ np.uint32(_POLY), columns >> np.uint32(1))
        for _ in range(40):
            rows = np.zeros((4, 256), dtype=np.uint32)
            for part in range(4):
                for bit in range(8):
                    mask = (np.arange(256) >> bit) & 1 == 1
                    rows[part][mask] ^= columns[part * 8 + bit]
            _TABLES.append(rows)
            columns = _step(rows, columns)
    return _TABLES


def shift(crc: np.ndarray, ids_after: np.ndarray) -> np.ndarray:
    """Contribution of pieces with these CRCs that ``ids_after`` ids follow."""
    out, left = crc.astype(np.uint32), ids_after.astype(np.int64)
    for bit, rows in enumerate(_tables()):
        if not (left >> bit).any():
            break
        out = np.where((left >> bit) & 1 == 1, _step(rows, out), out)
    return out
