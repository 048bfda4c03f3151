"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over training token windows.

Benchmark texts are normalised (ASCII lower case; words are runs of digits, ASCII letters and characters beyond ASCII)
and cut into windows of `n` words; a shorter item is one window. Executors look every window of a document up by hash and
verify each hit by its words. A document word inside any verified hit is contaminated; spans or documents can be removed.

Scale: map-only over the documents. The window table is broadcast in slices of at most `max_broadcast` bytes of windows
(one window more at most). A benchmark of more than one slice is scanned slice by slice: each pass is written, adds its hits
to those of the passes before it, and its broadcast is destroyed before the next slice is read, so the driver and a worker
hold one slice at a time. The result is the same for more passes. Hot passages cost their occurrences only.

Defined results: null or empty text has no words and no hits; null items have no windows; equal windows of several items
count for each; repeated rows are judged each; extra columns are ignored; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.session import Scratch

from . import kernels as K
from .common import fresh, map_arrow

#: Words of a window; bytes of the windows of a slice, each with its words and items (in a worker's memory some five times that).
WINDOW, MAX_BROADCAST = 10, 16 << 20


@dataclass
class Windows:
    """Windows of one slice: for each length, sorted hashes and, by hash, (words joined by a space, items)."""

    hashes: dict[int, np.ndarray]
    items: dict[int, dict[int, list[tuple[bytes, tuple[str, ...]]]]]
    last: bool = False


def _windows_of(word_list: list[bytes], n: int) -> set[tuple[int, bytes]]:
    k = min(n, len(word_list))
    return {(k, b" ".join(word_list[i : i + k])) for i in range(len(word_list) - k + 1)} if k else set()


def normal_words(text: str | None) -> list[bytes]:
    low = K.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    return np.where(K.ALNUM[low], low, 0x20).astype(np.uint8).tobytes().split()


def slices(benchmark: DataFrame, n: int = WINDOW, item_col: str = "item_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> Iterator[Windows]:
    """The benchmark's windows in tables of at most max_broadcast bytes, one after the other. The items are read in turn, one
    partition of them at a time."""
    have, total, any_ = defaultdict(set), 0, False
    for row in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if row["t"] is None or row["i"] is None:
            continue
        for key in _windows_of(normal_words(row["t"]), n):
            total += len(row["i"]) + (0 if key in have else len(key[1]))
            have[key].add(row["i"])
            if total >= max_broadcast:
                yield _table(have)
                have, total, any_ = defaultdict(set), 0, True
    if have or not any_:
        yield _table(have, True)


def _table(have: dict[tuple[int, bytes], set[str]], last: bool = False) -> Windows:
    by: dict[int, list[tuple[bytes, tuple[str, ...]]]] = defaultdict(list)
    for (k, words), items in have.items():
        by[k].append((words, tuple(sorted(items))))
    hashes, table = {}, {}
    for k, rows in by.items():
        buf = np.frombuffer(b" ".join(w for w, _ in rows), np.uint8)
        w = K.Words(buf, np.array([0, len(buf)]), K.ALNUM)
        h = K.ngrams(w.hashes(), k)[::k]
        found: dict[int, list] = defaultdict(list)
        for x, row in zip(h.tolist(), rows, strict=True):
            found[x].append(row)
        hashes[k], table[k] = np.unique(h), dict(found)
    return Windows(hashes, table, last)


def _hits(low: np.ndarray, w: K.Words, win: Windows) -> tuple[np.ndarray, list[set[str]]]:
    """(words covered by verified windows, items per text)."""
    cover = np.zeros(len(w) + 1, np.int32)
    items: list[set[str]] = [set() for _ in w.counts]
    if not len(w):
        return cover[:-1] > 0, items
    h = w.hashes()
    data = None
    for k, known in win.hashes.items():
        at, doc = K.gram_rows(w.first, w.counts, k)
        if not len(at):
            continue
        g = K.ngrams(h, k)[at]
        mask = (1 << 20) - 1
        small = np.zeros(mask + 1, bool)
        small[(known & np.uint64(mask)).astype(np.int64)] = True
        maybe = np.flatnonzero(small[(g & np.uint64(mask)).astype(np.int64)])
        maybe = maybe[np.isin(g[maybe], known, assume_unique=False)]
        if not len(maybe):
            continue
        data = data or low.tobytes()
        table = win.items[k]
        for p, d, x in zip(at[maybe].tolist(), doc[maybe].tolist(), g[maybe].tolist(), strict=True):
            words = b" ".join(data[a:b] for a, b in zip(w.starts[p : p + k].tolist(), w.ends[p : p + k].tolist(), strict=True))
            for text, its in table[x]:
                if text == words:
                    cover[p] += 1
                    cover[p + k] -= 1
                    items[d].update(its)
    return np.cumsum(cover[:-1]) > 0, items


def _spans(covered: np.ndarray, w: K.Words, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of covered words of one text: (start byte, end byte, runs per text)."""
    if not len(covered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(w.counts), np.int64)
    doc = w.doc()
    new = covered & ~np.concatenate([[False], covered[:-1] & (doc[1:] == doc[:-1])])
    end = covered & ~np.concatenate([covered[1:] & (doc[1:] == doc[:-1]), [False]])
    s, e = np.flatnonzero(new), np.flatnonzero(end)
    return w.starts[s] - offs[doc[s]], w.ends[e] - offs[doc[s]], np.bincount(doc[s], minlength=len(w.counts))


_KINDS = [T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.LongType()), T.ArrayType(T.LongType())]


#: From a batch of docs and the five columns of what was found in it: columns of the result.
Then = Callable[[pa.RecordBatch], Iterator[list]]


def _scan(docs: DataFrame, windows: Windows, text_at: int, names: list[str], more: bool, then: tuple[Then, T.StructType] | None = None) -> tuple[DataFrame, Broadcast]:
    """docs and the columns `names`: words, hit words, items (ids as strings), first and last bytes of the hit spans.

    more: docs has them already as its last columns, and the slice's hits are added. then: what becomes of them in the same
    task, and its columns, so that a task needs one worker."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)
    n = len(docs.columns) - len(names) * more

    def make():
        table = shared.value

        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(text_at))
            for i, j, b, o in K.blocks(buf, offs):
                low = K.LOWER[b]
                w = K.Words(low, o, K.ALNUM)
                covered, items = _hits(low, w, table)
                if more:
                    old = [batch.column(n + k).slice(i, j - i) for k in (2, 3, 4)]
                    for x, y in zip(items, old[0].to_pylist(), strict=True):
                        x.update(y)
                    base = np.repeat(o[:-1], np.diff(old[1].offsets.to_numpy()))
                    marks = np.zeros(len(b) + 1, np.int64)
                    np.add.at(marks, base + old[1].flatten().to_numpy(), 1)
                    np.add.at(marks, base + old[2].flatten().to_numpy(), -1)
                    covered |= np.cumsum(marks)[w.starts] > 0
                sums = np.concatenate([[0], np.cumsum(covered)])
                s, e, per = _spans(covered, w, o)
                out = [c.slice(i, j - i) for c in batch.columns[:n]] + [
                    w.counts, sums[w.first[1:]] - sums[w.first[:-1]], pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    K.list_column(s, per, pa.int64()), K.list_column(e, per, pa.int64()),
                ]
                if then:
                    yield from then[0](pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], names=[*batch.schema.names[:n], *names]))
                else:
                    yield out

        return fn

    fields = docs.schema.fields[:n] + [T.StructField(c, k) for c, k in zip(names, _KINDS, strict=True)]
    return map_arrow(docs, make, then[1] if then else T.StructType(fields)), shared


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", max_broadcast: int = MAX_BROADCAST, then: tuple[Then, T.StructType] | None = None) -> tuple[DataFrame, list[str]]:
    """(docs and five columns of what was found, as of _scan, or what `then` makes of them; their names)."""
    names, at = [], docs.columns.index(text_col)
    for c in ("gl_n_words", "gl_n_hit", "gl_items", "gl_from", "gl_to"):
        names.append(fresh(docs, c))
    scratch, found, before, last = Scratch(docs.sparkSession), None, None, False
    for windows in slices(benchmark, n, max_broadcast=max_broadcast):
        last = windows.last
        if before is not None:
            kept = scratch.keep(found, "found")
            before.destroy()
            found, before = _scan(kept, windows, at, names, True, then if last else None)
        else:
            found, before = _scan(docs, windows, at, names, False, then if last else None)
    return (map_arrow(found, lambda: then[0], then[1]) if then and not last else found), names


def mark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """id, n_words, n_hit, items, spans (bytes of the hit runs) and contaminated: a row per row of docs."""
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("gl_text" if id_col != "gl_text" else "gl_text_1"))
    found, (words, hit, items, lo, hi) = scan(rows, benchmark, n, rows.columns[1], max_broadcast)
    spans = F.arrays_zip(F.col(lo).alias("start"), F.col(hi).alias("end"))
    return found.select(id_col, F.col(words).alias("n_words"), F.col(hit).alias("n_hit"), F.col(items).alias("items"), spans.alias("spans"), (F.col(hit) > 0).alias("contaminated"))


def _cut(text_at: int, n_cols: int, max_share: float) -> Then:
    def fn(batch: pa.RecordBatch):
        words, hit = batch.column(n_cols).to_numpy(), batch.column(n_cols + 1).to_numpy()
        keep = hit <= words * max_share
        rows = batch.filter(pa.array(keep))
        texts, lo, hi = (rows.column(k).to_pylist() for k in (text_at, n_cols + 3, n_cols + 4))
        out = []
        for t, a, b in zip(texts, lo, hi, strict=True):
            if a:
                raw, parts, last = t.encode(), [], 0
                for x, y in zip(a, b, strict=True):
                    parts.append(raw[last:x])
                    last = y
                t = b"".join([*parts, raw[last:]]).decode()
            out.append(t)
        cols = [rows.column(k) for k in range(n_cols)]
        cols[text_at] = pa.array(out, pa.string())
        yield cols

    return fn


def remove(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text_col: str = "text", chars_col: str | None = "n_chars", max_share: float = 0.5, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """docs with hit spans cut out; documents of which more than max_share of the words are hit are dropped."""
    out, _ = scan(docs, benchmark, n, text_col, max_broadcast, (_cut(docs.columns.index(text_col), len(docs.columns), max_share), docs.schema))
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
