"""Words of many texts at once, as numpy arrays over their joined bytes."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

def _trim() -> None:
    """Give freed memory back to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run):
    """A batch function after which its worker, which serves other tasks next, holds no freed memory."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes that are hashed at once; longer words are hashed one by one by another function.
SPAN, LONG = 1 << 18, 1 << 16
_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64 (BASE is odd, so it has an inverse)."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 2 * SPAN)
        made = []
        for base in (BASE, np.uint64(pow(int(BASE), -1, 1 << 64))):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            made.append(np.multiply.accumulate(out))
        if size > 2 * SPAN:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of raw[k] * BASE**k over i <= k < j."""
    up, _ = powers(len(raw))
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Equal for equal bytes, wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word of ``raw``, equal for equal bytes; memory is bounded by SPAN, not by ``raw``."""
    out = np.empty(len(start), np.uint64)
    huge = np.flatnonzero(end - start > LONG)
    for i in huge.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    for low, high in zip([0, *(huge + 1).tolist()], [*huge.tolist(), len(start)]):
        while low < high:
            until = max(low + 1, min(high, int(np.searchsorted(end, start[low] + SPAN, "right"))))
            base = start[low]
            out[low:until] = range_hash(prefix_sums(raw[base : end[until - 1]]), start[low:until] - base, end[low:until] - base)
            low = until
    return out


def word_class(spec: list[tuple[int, int]]) -> np.ndarray:
    """Table of 256: true for bytes that belong to words, given ranges of bytes that do not."""
    inside = np.ones(256, bool)
    for low, high in spec:
        inside[low : high + 1] = False
    return inside


#: Bytes that separate words.
SPACES = word_class([(0x20, 0x20), (0x09, 0x0D)])
SIGNS = word_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``raw``."""
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = inside[raw]
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts lower-cased (A-Z), a space between them, and where each begins (one more at the end)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=begin[1:])
    return LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)], begin


def groups_of(texts: list, most: int = SPAN):
    """Slices of a list of texts, each of about ``most`` characters or one text."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield slice(at, i)
            at, size = i, 0
        size += n
    if at < len(texts):
        yield slice(at, len(texts))


def row_groups(batch, column: str = "text", most: int = 1 << 20, rows: int = 1_000):
    """Slices of an Arrow batch, each of about ``most`` bytes of a column or one row."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at = size = 0
    for i, n in enumerate(lengths.tolist()):
        if i > at and (size + n > most or i - at == rows):
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)
