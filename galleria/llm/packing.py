"""Packing: first-fit decreasing into sequences of a fixed length, with a tournament tree of bin capacities.

Every document is encoded and closed with an end token. Its ids are cut into full sequences and one remainder; full
pieces are sequences of their own. Remainders are dealt at random to groups of about `group_docs` pieces; in each group
they are taken in descending length, and the tree finds the first open sequence with enough room in log(bins) steps.

Scale: the texts are encoded once, and of each piece only (document, start, length, CRC) is kept, in a scratch table; ids
are not shuffled. Groups hold a bounded number of pieces by construction: the group of a piece is a hash of its input
partition and its row there, so a third of all rows being equal makes no group larger. Groups are independent.

Defined results: null text = empty = the end token alone; repeated rows are packed each; extra columns are ignored; an
empty table gives no pieces. Sequence ids are group number * 2^32 + number in the group; full pieces use their
partition and row with the top bit of 63 set.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleria.session import Scratch

from . import kernels as K
from . import tokens
from .common import map_arrow, schema_of, tune

SEQUENCE, END_ID, GROUP_PIECES = 4096, 2, 8192


class CapacityTree:
    """Room left in bins 0..n-1 under a tournament: each inner node holds the larger of its two."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [0] * (2 * self.leaves)
        for k in range(bins):
            self.room[self.leaves + k] = capacity
        for k in range(self.leaves - 1, 0, -1):
            self.room[k] = max(self.room[2 * k], self.room[2 * k + 1])

    def put(self, size: int) -> int:
        """Take size from the first bin that has it; its number, or -1."""
        room = self.room
        if room[1] < size:
            return -1
        k = 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        found = k - self.leaves
        room[k] -= size
        k >>= 1
        while k:
            best = room[2 * k] if room[2 * k] > room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
            k >>= 1
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each size; ties in the order given."""
    order = np.argsort(-sizes, kind="stable")
    tree = CapacityTree(max(1, len(sizes)), capacity)
    bins, offs, used = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), [0] * len(sizes)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        b = tree.put(size)
        bins[i], offs[i] = b, used[b]
        used[b] += size
    return bins, offs


_PIECE = "doc {id}, start long, length long, ids_crc32 long, doc_tokens long, part int, row long"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int | None = END_ID) -> DataFrame:
    """Every document's ids cut at multiples of `sequence`: a row a piece, with its input partition and number there."""
    path = tokenizer or tokens.default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        enc = tokens.encoder(path)
        part, count = TaskContext.get().partitionId(), 0

        def fn(batch: pa.RecordBatch):
            nonlocal count
            buf, offs = K.text_buffers(batch.column(1))
            for i, j, b, o in K.blocks(buf, offs, 2 * K.BLOCK):
                ids, at = enc.encode(K.Words(b, o, K.NOT_SPACE), o)
                if end_id is not None:
                    ids = np.insert(ids, at[1:], end_id)
                    at = at + np.arange(len(at))
                total = np.diff(at)
                n = -(-total // sequence)
                doc = np.repeat(np.arange(j - i), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * sequence
                length = np.minimum(sequence, total[doc] - start)
                raw = memoryview(ids.astype("<u4").tobytes())
                lo = ((at[:-1][doc] + start) * 4).tolist()
                hi = ((at[:-1][doc] + start + length) * 4).tolist()
                crc = [zlib.crc32(raw[x:y]) for x, y in zip(lo, hi, strict=True)]
                yield [
                    batch.column(0).slice(i, j - i).take(pa.array(doc)), start, length, crc, total[doc],
                    np.full(len(doc), part, np.int32), count + np.arange(len(doc)),
                ]
                count += len(doc)

        return fn

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, make, _PIECE.format(id=kind), encodes=True)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, sequence: int = SEQUENCE, end_id: int | None = END_ID, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row per piece: document, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tune(spark)
    cut = Scratch(spark).keep(pieces(docs, id_col, text_col, tokenizer, sequence, end_id), "pieces")
    whole = cut.filter(F.col("length") == sequence)
    rest = cut.filter(F.col("length") < sequence)
    full = F.shiftleft(F.lit(1).cast("long"), 62).bitwiseOR(F.shiftleft(F.col("part").cast("long"), 36)).bitwiseOR(F.col("row"))
    cols = [F.col("doc").alias(id_col), "start", "length", "ids_crc32", "doc_tokens"]
    groups = max(1, -(-rest.count() // group_pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = schema_of(f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by([("part", "ascending"), ("row", "ascending")])
        bins, offs = first_fit_decreasing(group["length"].to_numpy(), sequence)
        g = group["grp"].to_numpy().astype(np.int64)
        return pa.table([group["doc"], group["start"], group["length"], group["ids_crc32"], group["doc_tokens"], pa.array((g << 32) + bins), pa.array(offs)], names=schema.names)

    dealt = rest.withColumn("grp", F.pmod(F.xxhash64("part", "row"), F.lit(groups)).cast("int"))
    fitted = dealt.groupBy("grp").applyInArrow(fit, schema)
    return whole.select(*cols, full.alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionByName(fitted)
