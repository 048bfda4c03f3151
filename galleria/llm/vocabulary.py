"""Exact words of a block as codes and a dictionary, and batches gathered to a useful size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernels as K


def coded(w: K.Words) -> tuple[np.ndarray, pa.Array]:
    """(code of each word, the different words): bytes are compared, not hashes."""
    lens = w.ends - w.starts
    offs = np.zeros(len(lens) + 1, np.int64)
    np.cumsum(lens, out=offs[1:])
    body = np.ascontiguousarray(w.buf[w.mask])
    words = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(offs), pa.py_buffer(body)]).dictionary_encode()
    return words.indices.to_numpy().astype(np.int64), words.dictionary


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Tables of at least so many rows (but the last) from Spark's small batches."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
