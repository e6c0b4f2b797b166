"""Keccak-256 with its original padding, for many messages at once on numpy lanes."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE = 136


def _round_constants() -> list[int]:
    """From the linear feedback shift register of the specification."""
    out, r = [], 1
    for _ in range(24):
        rc = 0
        for j in range(7):
            if r & 1:
                rc |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        out.append(rc)
    return out


def _rotations() -> np.ndarray:
    """Offsets of rho, by the walk of the specification."""
    out = np.zeros((5, 5), dtype=np.uint64)
    x, y = 1, 0
    for t in range(24):
        out[x, y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return out


_RC, _ROT = _round_constants(), _rotations()


def _left(v: np.ndarray, n: int) -> np.ndarray:
    return v if n == 0 else (v << np.uint64(n)) | (v >> np.uint64(64 - n))


def _permute(a: np.ndarray) -> np.ndarray:
    """Keccak-f[1600] on lanes [x, y, message]."""
    for rc in _RC:
        c = a[:, 0] ^ a[:, 1] ^ a[:, 2] ^ a[:, 3] ^ a[:, 4]
        d = np.stack([c[(x - 1) % 5] ^ _left(c[(x + 1) % 5], 1) for x in range(5)])
        a = a ^ d[:, None]
        b = np.empty_like(a)
        for x in range(5):
            for y in range(5):
                b[y, (2 * x + 3 * y) % 5] = _left(a[x, y], int(_ROT[x, y]))
        a = b ^ (~np.roll(b, -1, axis=0) & np.roll(b, -2, axis=0))
        a[0, 0] ^= np.uint64(rc)
    return a


def keccak256_many(messages: list[bytes]) -> list[bytes]:
    """Digests in the order of the messages, those of equally many blocks together."""
    by_blocks: dict[int, list[int]] = defaultdict(list)
    for i, m in enumerate(messages):
        by_blocks[len(m) // RATE + 1].append(i)
    out: list[bytes] = [b""] * len(messages)
    for blocks, where in by_blocks.items():
        data = np.zeros((len(where), blocks * RATE), dtype=np.uint8)
        for row, i in enumerate(where):
            m = messages[i]
            data[row, : len(m)] = np.frombuffer(m, dtype=np.uint8)
            data[row, len(m)] ^= 0x01
            data[row, -1] ^= 0x80
        lanes = data.view("<u8").reshape(len(where), blocks, RATE // 8)
        state = np.zeros((5, 5, len(where)), dtype=np.uint64)
        for k in range(blocks):
            for i in range(RATE // 8):
                state[i % 5, i // 5] ^= lanes[:, k, i]
            state = _permute(state)
        digest = np.stack([state[i, 0] for i in range(4)], axis=1).astype("<u8").tobytes()
        for row, i in enumerate(where):
            out[i] = digest[32 * row : 32 * row + 32]
    return out


def keccak256(message: bytes) -> bytes:
    return keccak256_many([message])[0]


@F.pandas_udf(T.BinaryType())
def keccak256_column(data: pd.Series) -> pd.Series:
    """Digest of a binary column; null stays null."""
    known = data[data.notna()]
    return pd.Series(keccak256_many(list(known)), index=known.index, dtype=object).reindex(data.index).where(data.notna(), None)
