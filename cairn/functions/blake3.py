"""BLAKE3-256 in numpy: all chunks of many contents step together."""

from __future__ import annotations

import numpy as np

# The initial state, the order in which a round's words become the next's, and the domain flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK, SEGMENT = 1024, 64, 16 << 20

_COLUMNS, _DIAGONALS = ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11], [12, 13, 14, 15]), ([0, 1, 2, 3], [5, 6, 7, 4], [10, 11, 8, 9], [15, 12, 13, 14])


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Chaining values (8 x n) after a block of ``words`` (16 x n)."""
    n = words.shape[1]
    v = np.empty((16, n), np.uint32)
    v[:8], v[8:12] = cv, IV[:4, None]
    v[12], v[13], v[14], v[15] = counter & np.uint64(0xFFFFFFFF), counter >> np.uint64(32), length, flags
    m = words
    for r in range(7):
        for half, (a, b, c, d) in enumerate((_COLUMNS, _DIAGONALS)):
            x, y = m[8 * half : 8 * half + 8 : 2], m[8 * half + 1 : 8 * half + 8 : 2]
            va, vb, vc, vd = v[a], v[b], v[c], v[d]
            for word, turn_d, turn_b in ((x, 16, 12), (y, 8, 7)):
                va = va + vb + word
                vd = _turn(vd ^ va, turn_d)
                vc = vc + vd
                vb = _turn(vb ^ vc, turn_b)
            v[a], v[b], v[c], v[d] = va, vb, vc, vd
        if r < 6:
            m = m[PERMUTATION]
    return v[:8] ^ v[8:]


def _chunk_values(data: bytes, sizes: np.ndarray, counters: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Chaining values (n x 8) of chunks; ``data`` holds each chunk padded to full length."""
    words = np.frombuffer(data, "<u4").reshape(len(sizes), 16, 16)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    cv = np.repeat(IV[:, None], len(sizes), 1)
    for k in range(int(blocks.max())):
        on = np.flatnonzero(blocks > k)
        last = blocks[on] == k + 1
        flags = np.where(last, CHUNK_END, 0) | (CHUNK_START if k == 0 else 0) | np.where(last & root[on], ROOT, 0)
        length = np.where(last, sizes[on] - k * BLOCK, BLOCK)
        cv[:, on] = compress(cv[:, on], words[on, k].T, counters[on], length.astype(np.uint32), flags.astype(np.uint32))
    return cv.T


def _merge(values: np.ndarray, counts: np.ndarray, root: bool = True) -> np.ndarray:
    """Roots (n x 8) of the trees over runs of ``counts`` values: pairs level by level, an odd last one moves up."""
    while counts.max() > 1:
        starts = np.cumsum(counts) - counts
        rank = np.arange(len(values)) - np.repeat(starts, counts)
        size = np.repeat(counts, counts)
        left = np.flatnonzero((rank % 2 == 0) & (rank + 1 < size))
        flags = np.where(root & (size[left] == 2), PARENT | ROOT, PARENT).astype(np.uint32)
        zero = np.zeros(len(left), np.uint64)
        both = np.concatenate([values[left], values[left + 1]], 1).T
        values = values.copy()
        values[left] = compress(np.repeat(IV[:, None], len(left), 1), both, zero, np.full(len(left), BLOCK, np.uint32), flags).T
        values = values[rank % 2 == 0]
        counts = -(-counts // 2)
    return values


def digests(contents: list[bytes]) -> list[bytes]:
    """The digest of each of ``contents``; meant for batches of a few MB."""
    if not contents:
        return []
    sizes = np.array([len(c) for c in contents])
    counts = np.maximum(1, -(-sizes // CHUNK))
    ends = np.cumsum(counts)
    chunk_sizes = np.full(ends[-1], CHUNK)
    chunk_sizes[ends - 1] = sizes - (counts - 1) * CHUNK
    counters = (np.arange(ends[-1]) - np.repeat(ends - counts, counts)).astype(np.uint64)
    data = b"".join(c.ljust(n * CHUNK, b"\0") for c, n in zip(contents, counts.tolist()))
    values = _chunk_values(data, chunk_sizes, counters, np.repeat(counts == 1, counts))
    return [v.astype("<u4").tobytes() for v in _merge(values, counts)]


class Hasher:
    """Digest of a content given part by part, whatever its length: whole segments shrink to one value each."""

    def __init__(self):
        self.held, self.values, self.done = bytearray(), [], 0

    def update(self, part: bytes) -> None:
        self.held += part
        while len(self.held) > SEGMENT:
            self._segment(bytes(self.held[:SEGMENT]))
            del self.held[:SEGMENT]

    def _segment(self, data: bytes) -> None:
        n = max(1, -(-len(data) // CHUNK))
        sizes = np.full(n, CHUNK)
        sizes[-1] = len(data) - (n - 1) * CHUNK
        counters = np.arange(self.done, self.done + n).astype(np.uint64)
        values = _chunk_values(data.ljust(n * CHUNK, b"\0"), sizes, counters, np.zeros(n, bool))
        self.values.append(_merge(values, np.array([n]), root=False)[0])
        self.done += n

    def digest(self) -> bytes:
        if not self.values:
            return digests([bytes(self.held)])[0]
        self._segment(bytes(self.held))
        return _merge(np.stack(self.values), np.array([len(self.values)]))[0].astype("<u4").tobytes()
