"""Vectorised text kernels over Arrow buffers.

A batch's texts are used as Arrow holds them: one buffer of UTF-8 bytes and one of offsets, so no Python object is
made per document or word. Hashes are polynomials modulo 2^64 over random byte values, finished by a mixing step; where
equal hashes decide a result, either 128 bits are compared or the bytes themselves are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one call of a kernel works on; a longer single text is one call of its own.
BLOCK = 1 << 18

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE1 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
M64 = (1 << 64) - 1
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(family: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or of the base's inverse."""
    have = _powers.get((family, inverse))
    if have is None or len(have) < n:
        base = BASES[family]
        if inverse:
            base = pow(base, -1, 1 << 64)
        size = max(n, BLOCK + (1 << 14))
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if size <= 4 * BLOCK:
            _powers[family, inverse] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finish hashes (a bijection of 64-bit values)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; a null has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    else:
        col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    lens = np.diff(offs)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    buf = buf[offs[0] : offs[-1]]
    offs = offs - offs[0]
    if col.null_count:
        null = np.asarray(col.is_null())
        if lens[null].any():  # a null slot may hide bytes
            keep = np.repeat(~null, lens)
            buf = buf[keep]
            offs = np.concatenate([[0], np.cumsum(np.where(null, 0, lens))])
    return buf, offs


def blocks(buf: np.ndarray, offs: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) for runs of rows of about `size` bytes."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def byte_class(chars: bytes, negate: bool = False) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return ~lut if negate else lut


#: Words as runs of what isn't ASCII white space; and as runs of digits, letters and bytes beyond ASCII, after lower().
NOT_SPACE = byte_class(b" \t\n\v\f\r", negate=True)
ALNUM = byte_class(bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Words:
    """Words of a block of texts: starts and ends in the buffer, and first[i]:first[i + 1] are those of text i."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lut: np.ndarray):
        self.buf, n = buf, len(buf)
        m = lut[buf]
        cut = offs[:-1][offs[:-1] < n]
        if n:
            head = m.copy()
            head[1:] &= ~m[:-1]
            head[cut] = m[cut]
            tail = m.copy()
            tail[:-1] &= ~m[1:]
            inner = cut[cut > 0] - 1
            tail[inner] = m[inner]
            self.starts, self.ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.mask = m
        self.first = np.searchsorted(self.starts, offs)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lens = self.ends - self.starts
        body = self.buf[self.mask]
        at = np.cumsum(lens) - lens
        pos = np.arange(len(body)) - np.repeat(at, lens)
        v = BYTE1[body]
        v *= powers(0, int(lens.max()))[pos]
        return mix(np.add.reduceat(v, at) + lens.astype(np.uint64))


_ODD = [(0xA0761D6478BD642F * (2 * k + 1) + 2 * k) & M64 | 1 for k in range(64)]


def ngrams(h: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hash of h[i:i + k] for every i with i + k <= len(h)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        if k <= 32:
            c = np.uint64(_ODD[(j + 32 * family) % 64])
        else:
            c = powers(family, k)[j]
        out += h[j : j + n] * c
    return mix(out)


def gram_rows(first: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Which positions of ngrams(h, k) lie in one text, and whose: (positions, text of each)."""
    per = np.maximum(counts - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), per)
    at = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    return first[:-1][doc] + at, doc


class Rolling:
    """Hashes of any range of a block of bytes, or of 64-bit values: two 64-bit families by prefix sums."""

    def __init__(self, buf: np.ndarray, families: tuple[int, ...] = (0, 1)):
        n = len(buf)
        self.sums, self.inv = {}, {}
        for f in families:
            s = np.zeros(n + 1, np.uint64)
            if buf.dtype == np.uint8:
                v = (BYTE1 if f == 0 else BYTE2)[buf]
            else:
                v = mix(buf ^ np.uint64(BASES[f]))
            v *= powers(f, n + 1)[:n]
            np.cumsum(v, out=s[1:])
            self.sums[f], self.inv[f] = s, powers(f, n + 1, inverse=True)

    def ranges(self, a: np.ndarray, b: np.ndarray, family: int = 0) -> np.ndarray:
        s = self.sums[family]
        return mix((s[b] - s[a]) * self.inv[family][a] + (b - a).astype(np.uint64))

    def plain_grams(self, k: int, family: int = 0) -> np.ndarray:
        """Hashes of k units from every place on, without the finishing step."""
        s = self.sums[family]
        n = len(s) - k
        return (s[k:] - s[:n]) * self.inv[family][:n] if n > 0 else np.zeros(0, np.uint64)

    def grams(self, k: int, family: int = 0) -> np.ndarray:
        s = self.sums[family]
        n = len(s) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((s[k:] - s[:n]) * self.inv[family][:n] + np.uint64(k))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow list column of rows of `counts` values each."""
    offs = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, kind))
