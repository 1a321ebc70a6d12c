"""Integer arrays as compact bytes, for exchanges between row groups and shards."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray, ascending: bool = False) -> bytes:
    """Bytes of a 64-bit array; ascending arrays are stored as differences. Byte planes compress well."""
    x = np.ascontiguousarray(x).view(np.uint64)
    if ascending and len(x):
        x = np.concatenate([x[:1], np.diff(x)])
    top = int(x.max()) if len(x) else 0
    width = max(1, -(-top.bit_length() // 8))
    planes = x.view(np.uint8).reshape(-1, 8).T[:width]
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw: bytes, ascending: bool = False) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    x = out.view(np.uint64).reshape(-1)
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def pack_bits(x: np.ndarray) -> bytes:
    return len(x).to_bytes(8, "little") + np.packbits(x.astype(bool)).tobytes()


def unpack_bits(raw: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=8), count=int.from_bytes(raw[:8], "little")).astype(bool)


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal rows starts, the run of each row) of arrays sorted together."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new), np.cumsum(new) - 1


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Edges (node, root) that join what a-b joins."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            break
        root = low
    return [(int(x), int(root[x])) for x in np.unique(np.concatenate([a, b])) if root[x] != x]
