"""What the operators share: Arrow maps with a stated schema, row identity, bounded collects."""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from galleria.session import ship

from . import kernels as K

#: Rows and bytes of an Arrow batch at most (a single row may be larger): Spark's own 10,000 rows of texts would not fit a worker.
BATCH_ROWS, BATCH_BYTES = 1024, 4 << 20

BatchFn = Callable[[pa.RecordBatch], Iterator[dict]]


def tune(spark: SparkSession) -> None:
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: workers are used again, and what one operator needed is not the next one's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def take_over(encodes: bool) -> None:
    """A worker is used again by the tasks of other operators: those that don't encode free the tokenizer and its known pieces."""
    tokens = sys.modules.get(f"{__package__}.tokens")
    if tokens and not encodes and tokens.held():
        tokens.forget()
        give_back()


def schema_of(ddl: str | T.StructType) -> T.StructType:
    return ddl if isinstance(ddl, T.StructType) else T.StructType.fromDDL(ddl)


def map_arrow(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[list]]], ddl: str | T.StructType, encodes: bool = False) -> DataFrame:
    """mapInArrow where make() is called once a task and returns a function from a batch to lists of columns. encodes: it uses tokens.encoder()."""
    tune(df.sparkSession)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)
    names, kinds = arrow.names, arrow.types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(encodes)
        fn = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            for cols in fn(batch):
                yield pa.RecordBatch.from_arrays([as_column(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        give_back()

    return df.mapInArrow(run, schema)


def map_sorted(df: DataFrame, make: Callable[[], Callable[[Iterator[pa.RecordBatch]], Iterator[list]]], ddl: str | T.StructType) -> DataFrame:
    """mapInArrow where make() returns a function from all batches of a partition, in order, to lists of columns."""
    tune(df.sparkSession)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(False)
        for cols in make()(batches):
            yield pa.RecordBatch.from_arrays([as_column(c, k) for c, k in zip(cols, arrow.types, strict=True)], names=arrow.names)
        give_back()

    return df.mapInArrow(run, schema)


def split_rows(docs: DataFrame, text_col: str, bits, id_col: str | None = None) -> tuple[DataFrame, DataFrame, str, str]:
    """(rows that may be in a broadcast bitmap, with their 128-bit text hash in two columns; the other rows; those columns).

    The key is the first half of the text hash, XOR a hash of the id if there is one. No row is shuffled."""
    t1, t2 = fresh(docs, "gl_t1"), fresh(docs, "gl_t2")
    n, at = len(docs.columns), docs.columns.index(text_col)
    rows = docs.select("*", F.xxhash64(id_col).alias(fresh(docs, "gl_id"))) if id_col else docs

    def texts(inside: bool) -> DataFrame:
        def make():
            known = bits.value

            def fn(batch: pa.RecordBatch):
                buf, offs = K.text_buffers(batch.column(at))
                for i, j, block, o in K.blocks(buf, offs):
                    h1, h2 = text_hashes(block, o)
                    key = K.signed(h1) ^ batch.column(n).slice(i, j - i).to_numpy() if id_col else h1
                    pick = known.may_hold(key) == inside
                    if pick.any():
                        cols = [batch.column(k).slice(i, j - i).filter(pa.array(pick)) for k in range(n)]
                        yield [*cols, h1[pick], h2[pick]] if inside else cols

            return fn

        more = [T.StructField(t1, T.LongType()), T.StructField(t2, T.LongType())] if inside else []
        return map_arrow(rows, make, T.StructType([*docs.schema.fields, *more]))

    return texts(True), texts(False), t1, t2


def as_column(c, kind: pa.DataType) -> pa.Array:
    if isinstance(c, pa.ChunkedArray):
        c = c.combine_chunks()
    if isinstance(c, pa.Array):
        return c if c.type == kind else c.cast(kind)
    if isinstance(c, np.ndarray) and c.dtype == np.uint64:
        c = c.view(np.int64)
    return pa.array(c, kind)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have (Spark's names ignore case)."""
    have, name, n = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in have:
        n += 1
        name = f"{stem}_{n}"
    return name


def text_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each text of a block, as two columns of 64."""
    data, at = memoryview(np.ascontiguousarray(buf)), offs.tolist()
    raw = b"".join(xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    both = np.frombuffer(raw, np.uint64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


#: Brings the high bits of a key (of a numbered row: its partition) into its place in a bitmap.
SPREAD = 2654435761


class Bitmap:
    """A one-hash Bloom filter of fixed size: what it lets through is checked by an exact join after it.

    It is built by an aggregation over at most `bits / 64` groups, so the driver gets bits / 8 bytes at most whatever the
    input; with far more keys than bits it lets everything through, which costs time and changes no result.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = 1 << 24):
        mixed = F.col(column).bitwiseXOR(F.shiftright(column, 33) * F.lit(SPREAD))
        rows = (
            keys.select(F.pmod(mixed, F.lit(bits)).alias("h"))
            .select(F.shiftright("h", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("b"))
            .groupBy("w")
            .agg(F.bit_or("b").alias("b"))
        )
        self.bits, self.words = bits, np.zeros(bits // 64, np.int64)
        got = rows.toArrow()
        self.words[got["w"].to_numpy()] = got["b"].to_numpy()

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Of signed 64-bit keys, those that may be in the set."""
        keys = keys.view(np.int64)
        at = np.mod(keys ^ ((keys >> 33) * SPREAD), np.int64(self.bits))
        return (self.words[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1


def literal_rows(spark: SparkSession, rows: list[tuple], fields: str) -> DataFrame:
    """A small constant table as literals of the plan, without a Python worker; fields as in a struct ("a: string, b: int")."""
    one = F.array(*[F.struct(*[F.lit(v) for v in r]) for r in rows]).cast(f"array<struct<{fields}>>")
    return spark.range(0, 1, 1, 1).select(F.inline(one))
