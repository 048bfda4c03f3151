"""Mixing sources to target weights: a stream of fixed-length blocks of words in which each source has its share.

Documents of a source are laid end to end in a pseudorandom order and cut into blocks of `block` words. The mix is a row of
output shards of `slots` blocks. Each shard draws its counts per source from a multinomial over the targets, by a generator
seeded with the shard's number. The i-th slot that a source has drawn is mapped by a pseudorandom permutation of its indices;
the first `quota` of them stay, which makes totals exact, and the others go, by a permutation again, to sources that drew too
few. A source's slots number its blocks: its first pass over the blocks is one permutation of them, its second another. Slots
and pieces of documents meet by a join on (source, block).

Targets: the mix has `percent` of all words; a source's target is its weight's share of it, at most `passes` times its own words,
and what is above goes to the others by weight. A source's words in the mix are its target rounded down: its last slot is cut.
The blocks of a source that are not full come last in a pass.

Scale: texts are counted in one pass and, for the texts of the mix, cut in one more; offsets are two-level sums over ranges of
the order's hash, so a source with a third of all rows is dealt like the others. Draws work on groups of shards; a group needs
its sources' counts in the groups before it, sums of a row per group and source. A block holds `block` words, so no join key has
more than that many pieces. The table of sources, a row per source with its weight, is the mix's definition; it goes to the
driver and the tasks and has MAX_SOURCES rows at most (beyond, name the sources to be mixed in a coarser column).

Defined results: null text has no words; null source is a source of its own, the last; rows without words are in no block and are
taken 0 times. Every row is a document, repeated ids and rows too. Equal inputs give equal mixes, whatever the partitions (rows
equal in id, source and text may stand for each other). A text of any length is cut into as many pieces as it needs (counted
whole, at some 10 bytes of memory a byte). An empty table, or one without words, mixes nothing. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleria.session import Scratch

from . import kernels as K
from .common import map_arrow, map_sorted

#: Shards that one row of the draws stands for.
GROUP = 64
#: Rows of a range of the order, about, and at most so many ranges for each source (as powers of two).
RANGE, RANGES_MOST = 15, 20
MAX_SOURCES = 1_000_000


@dataclass(frozen=True)
class Params:
    block: int = 512
    slots: int = 1024
    percent: int = 150
    passes: int = 2
    seed: int = 11
    id_col: str = "doc_id"
    text_col: str = "text"
    source_col: str = "source"


def targets(sizes: list[int], weights: list[int | Fraction], p: Params) -> list[Fraction]:
    """Shares of the mix by weight, none above passes times its size."""
    rest, left = Fraction(sum(sizes) * p.percent, 100), Fraction(sum(weights))
    out = [Fraction(0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: Fraction(sizes[k]) / weights[k]):
        out[k] = min(Fraction(p.passes * sizes[k]), rest * weights[k] / left)
        rest, left = rest - out[k], left - weights[k]
    return out


@dataclass
class Plan:
    """Of each source, in order: name, words, target, words to take, slots and blocks."""

    names: list[str | None]
    words: list[int]
    target: list[Fraction]
    take: np.ndarray
    slots: np.ndarray
    blocks: np.ndarray

    @property
    def total(self) -> int:
        return int(self.slots.sum())


def plan_of(names: list[str | None], words: list[int], weights: list[int], p: Params) -> Plan:
    """A source takes its target's words: whole passes, then slots of whole blocks, the last of them cut."""
    target = targets(words, weights, p)
    size = np.array(words, np.int64)
    take = np.array([int(t) for t in target], np.int64)
    blocks = -(-size // p.block)
    whole = np.where(size > 0, take // np.maximum(size, 1), 0)
    slots = whole * blocks + -(-(take - whole * size) // p.block)
    return Plan(names, words, target, take, slots, blocks)


def rounds(x: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom function of 64 bits."""
    return K.mix(x ^ K.mix(key))


def permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Of each x in [0, n): its place in the permutation of [0, n) that `key` numbers. Four Feistel rounds over the next even
    power of two, again until the place is below n."""
    n, key = np.broadcast_to(n, x.shape), np.broadcast_to(key, x.shape).astype(np.uint64)
    half = (np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)) if len(x) else np.zeros(0, np.uint64)
    half = np.where(np.left_shift(np.uint64(1), 2 * half) < n.astype(np.uint64), half + np.uint64(1), half)
    mask = np.left_shift(np.uint64(1), half) - np.uint64(1)
    out = x.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo]
        a, b = out[todo] >> h, out[todo] & m
        for r in range(4):
            a, b = b, a ^ (rounds(b, k * np.uint64(8) + np.uint64(r)) & m)
        out[todo] = (a << h) | b
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def sized(docs: DataFrame, p: Params, text: bool) -> DataFrame:
    """source, h (order), t (text hash), id, size and, if asked for, the text; each row's place in its source's order is by h, id, t."""
    schema = docs.select(F.col(p.id_col).alias("id")).schema.fields[0].dataType.simpleString()
    rows = docs.select(F.col(p.id_col).alias("id"), F.col(p.source_col).cast("string").alias("source"), F.col(p.text_col).cast("string").alias("text"))
    rows = rows.withColumns({"h": F.xxhash64(F.lit(p.seed), F.col("id").cast("string")), "t": F.xxhash64("text")})

    def make():
        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(2))
            for i, j, b, o in K.blocks(buf, offs, 8 * K.BLOCK):
                n = K.Words(b, o, K.NOT_SPACE).counts
                yield [*[batch.column(k).slice(i, j - i) for k in ((0, 1, 3, 4, 2) if text else (0, 1, 3, 4))], n]

        return fn

    return map_arrow(rows, make, f"id {schema}, source string, h long, t long, {'text string, ' if text else ''}size long")


def source_table(rows: DataFrame, weights: Callable[[list[str | None]], list[int]], p: Params) -> Plan:
    """The plan, from the words of each source: sources by code point, null last; weights(names) gives theirs."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("words"))
    got = sums.orderBy(F.col("source").asc_nulls_last()).limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources to mix")
    names = [r["source"] for r in got]
    return plan_of(names, [r["words"] for r in got], weights(names), p)


def number(df: DataFrame, plan: Plan) -> DataFrame:
    """Adds s, the source's number in the plan."""
    table = df.sparkSession.createDataFrame([(k, n) for k, n in enumerate(plan.names)], "s int, name string")
    small = len(plan.names) <= 10_000
    return df.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("name"))).drop("name")


def placed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Adds first: the words of the source before this row. Sums of ranges of the order first, then within a range."""
    n = max(1, sum(plan.words))
    bits = min(RANGES_MOST, max(0, (n >> 6).bit_length() - RANGE))
    rows = number(rows.filter(F.col("size") > 0), plan).withColumn("range", F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 64 - bits) if bits else F.lit(0).cast("long"))
    sums = rows.groupBy("s", "range").agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("s").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("s", "range", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("s", "range").orderBy("h", "id", "t").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return rows.join(sums, ["s", "range"]).withColumn("first", F.col("ahead") + F.col("inner")).drop("ahead", "inner", "range")


def pieces(rows: DataFrame, p: Params) -> DataFrame:
    """A row for each block that a document has words in: block, start (word of the document), length, at (word of the block)."""
    b = F.explode(F.expr(f"sequence(first div {p.block}, (first + size - 1) div {p.block})")).alias("block")
    out = rows.select("*", b)
    start = F.greatest(F.col("first"), F.col("block") * p.block)
    end = F.least(F.col("first") + F.col("size"), (F.col("block") + 1) * p.block)
    return out.withColumns({"start": start - F.col("first"), "length": end - start, "at": start - F.col("block") * p.block})


def shard_counts(shard: int, plan: Plan, p: Params) -> np.ndarray:
    """Slots of each source in a shard, by a multinomial draw."""
    size = min(p.slots, plan.total - shard * p.slots)
    rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([p.seed, shard])))
    return rng.multinomial(size, plan.slots / plan.total).astype(np.int64)


def dealt(i: np.ndarray, s: np.ndarray, drawn: np.ndarray, plan: Plan, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(source, number among that source's slots) for the i-th drawn slot of source s, when the sources have drawn `drawn` in all.

    The first `slots` of a source's draws, in permuted order, stay; the others are numbered and permuted too, and go to the
    sources that drew too few."""
    at = permuted(i, drawn[s], np.uint64(p.seed) * np.uint64(1 << 32) + s.astype(np.uint64))
    over = np.maximum(drawn - plan.slots, 0)
    lack = np.maximum(plan.slots - drawn, 0)
    many = int(over.sum())
    extra = at >= plan.slots[s]
    s = s.copy()
    if extra.any():
        e = (np.cumsum(over) - over)[s[extra]] + at[extra] - plan.slots[s[extra]]
        e = permuted(e, np.int64(many), np.uint64(p.seed + (1 << 20)))
        ends = np.cumsum(lack)
        to = np.searchsorted(ends, e, "right")
        s[extra], at[extra] = to, drawn[to] + e - (ends - lack)[to]
    return s, at


def block_of(j: np.ndarray, s: np.ndarray, plan: Plan, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(block, words of it that are taken) of a source's j-th slot."""
    n, size = plan.blocks[s], np.array(plan.words, np.int64)[s]
    turn, at = np.divmod(j, n)
    full = size // p.block
    inner = at < full  # the block that is not full stands last
    block = at.copy()
    block[inner] = permuted(at[inner], full[inner], (np.uint64(p.seed) + turn[inner].astype(np.uint64) + np.uint64(1)) * np.uint64(1 << 33) + s[inner].astype(np.uint64))
    before = turn * size + at * p.block
    return block, np.minimum(np.where(inner, p.block, size - full * p.block), plan.take[s] - before)


def slots(spark, plan: Plan, p: Params, scratch: Scratch) -> DataFrame:
    """shard, slot, s, block, words: which block, and how many of its words, each slot of the mix holds."""
    fields = "shard long, slot int, s int, block long, words int"
    shards = -(-plan.total // p.slots)
    if not shards:
        return spark.createDataFrame([], fields)
    groups = spark.range(0, -(-shards // GROUP)).withColumnRenamed("id", "group")
    known = spark.sparkContext.broadcast(plan)

    def count():
        def run(batches: Iterator[pa.RecordBatch]):
            for batch in batches:
                for g in batch.column(0).to_pylist():
                    n = sum(shard_counts(k, known.value, p) for k in range(g * GROUP, min(shards, (g + 1) * GROUP)))
                    yield [np.full(len(n), g), np.arange(len(n)), n]

        return run

    counts = scratch.keep(map_sorted(groups, count, "group long, s int, n long"), "draws")
    drawn = np.zeros(len(plan.names), np.int64)
    for r in counts.groupBy("s").agg(F.sum("n").alias("n")).collect():  # a row per source
        drawn[r["s"]] = r["n"]
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("group", "s", before.alias("base")).groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "base"))), lambda x: x["base"]).alias("bases"))

    def lay():
        def run(batches: Iterator[pa.RecordBatch]):
            plan = known.value
            for batch in batches:
                for g, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    base = np.array(base, np.int64)
                    for shard in range(g * GROUP, min(shards, (g + 1) * GROUP)):
                        n = shard_counts(shard, plan, p)
                        s = np.repeat(np.arange(len(n)), n)
                        i = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n) + base[s]
                        base += n
                        s, j = dealt(i, s, drawn, plan, p)
                        block, words = block_of(j, s, plan, p)
                        place = permuted(np.arange(len(s)), np.int64(len(s)), np.uint64(p.seed + (1 << 21)) + np.uint64(shard) * np.uint64(1 << 22))
                        yield [np.full(len(s), shard), place, s, block, words]

        return run

    return map_sorted(bases, lay, fields)


def taken(docs: DataFrame, weights: Callable[[list[str | None]], list[int]], p: Params | None = None) -> DataFrame:
    """A row per document: id, size, source_size, target (of its source), taken: its words in the mix, repeats counted."""
    p = p or Params()
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(sized(docs, p, False), "sizes")
    plan = source_table(rows, weights, p)
    at = scratch.keep(slots(spark, plan, p, scratch), "slots")
    cut = pieces(placed(rows, plan).select("s", "id", "size", "first"), p)
    hits = cut.join(at.select("s", "block", "words"), ["s", "block"], "left")
    n = F.coalesce(F.least(F.col("length"), F.greatest(F.col("words") - F.col("at"), F.lit(0))), F.lit(0))
    every = hits.groupBy("s", "first").agg(F.any_value("id").alias("id"), F.any_value("size").alias("size"), F.sum(n).alias("taken")).drop("first")
    every = every.unionByName(number(rows.filter(F.col("size") == 0), plan).select("id", "size", "s", F.lit(0).cast("long").alias("taken")))
    facts = spark.createDataFrame([(k, w, float(t)) for k, (w, t) in enumerate(zip(plan.words, plan.target, strict=True))], "s int, source_size long, target double")
    small = len(plan.names) <= 10_000
    return every.join(F.broadcast(facts) if small else facts, "s").select("id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: Callable[[list[str | None]], list[int]], p: Params | None = None) -> DataFrame:
    """The mix itself: shard, slot, at (word of the slot), source, id, start (word of the document), length, text."""
    p = p or Params()
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.keep(sized(docs, p, True), "sized-texts")
    plan = source_table(rows, weights, p)
    at = scratch.keep(slots(spark, plan, p, scratch), "slots")
    found = at.join(text_pieces(placed(rows, plan), p), ["s", "block"]).filter(F.col("words") > F.col("at"))
    found = found.withColumn("length", F.least(F.col("length"), F.col("words") - F.col("at")))
    return first_words(found.select("shard", "slot", "at", "source", "id", "start", "length", "text"))


def cuts(w: K.Words, data: memoryview, first: np.ndarray, last: np.ndarray) -> list[str]:
    """Texts from word `first` to word `last` of a block."""
    return [bytes(data[x:y]).decode() for x, y in zip(w.starts[first].tolist(), w.ends[last].tolist(), strict=True)]


def text_pieces(rows: DataFrame, p: Params) -> DataFrame:
    """Like pieces(), with the words of each piece as its text; each text is cut once."""
    kind = rows.schema["id"].dataType.simpleString()

    def make():
        def fn(batch: pa.RecordBatch):
            size, first = (batch.column(k).to_numpy() for k in (3, 4))
            buf, offs = K.text_buffers(batch.column(5))
            for i, j, b, o in K.blocks(buf, offs, 8 * K.BLOCK):
                w = K.Words(b, o, K.NOT_SPACE)
                low = first[i:j] // p.block
                many = (first[i:j] + size[i:j] - 1) // p.block - low + 1
                doc = np.repeat(np.arange(j - i), many)
                block = low[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
                lead = first[i:j][doc]
                start = np.maximum(lead, block * p.block) - lead
                length = np.minimum(lead + size[i:j][doc], (block + 1) * p.block) - lead - start
                row, word = pa.array(i + doc), w.first[doc] + start
                texts = cuts(w, memoryview(np.ascontiguousarray(b)), word, word + length - 1)
                yield [*[batch.column(k).take(row) for k in (0, 1, 2)], block, start, length, start + lead - block * p.block, texts]

        return fn

    return map_arrow(rows.select("s", "source", "id", "size", "first", "text"), make, f"s int, source string, id {kind}, block long, start long, length long, at long, text string")


def first_words(found: DataFrame) -> DataFrame:
    """Cuts each text, the last column, to its first `length` words (only those of a source's last slot have more)."""

    def make():
        def fn(batch: pa.RecordBatch):
            length = batch.column(6).to_numpy()
            buf, offs = K.text_buffers(batch.column(7))
            for i, j, b, o in K.blocks(buf, offs, 8 * K.BLOCK):
                w = K.Words(b, o, K.NOT_SPACE)
                first = w.first[:-1]
                yield [*[batch.column(k).slice(i, j - i) for k in range(7)], cuts(w, memoryview(np.ascontiguousarray(b)), first, first + length[i:j] - 1)]

        return fn

    return map_arrow(found, make, found.schema)
