"""Phrase collocation mining: phrases of 2 to 4 words that occur often and more often than their parts suggest.

Vertical positional inverted lists. Texts become blocks of one language (a few megabytes each); in a block every word has a
sorted list of its positions, and a position is left out between two pieces so that neighbours are words of one piece. The
summed list lengths are the exact frequencies of words. A phrase is extended by merging its list with the lists of adjacent
words: an occurrence at position i goes on if the phrases at i and at i + 1 are both frequent. The lengths of the extended
lists, summed over blocks, are the exact frequencies of the next level.

Scale: texts are read and cut into words once; the lists are written once, and each level is one pass over them. Frequent words
get dense numbers; they meet the lists by a join: broadcast up to 16 MB, else shuffled, where Spark splits a hot word's partition. Per level, tasks send a count for each
different phrase of a block, combined before the shuffle. The frequent phrases of a level reach the tasks as a filter of bits,
16 for each phrase and at most 32 MB whatever the input: beyond some 2^28 / 16 phrases it lets more through, which costs counts
and changes no result, as the counts decide. The best phrases per language are taken in salted shares first.

Defined results: null text is empty, null lang is `und`. Every row counts, repeated rows too. Bytes are compared, not hashes; words
and texts may be of any length (a block holds at least one whole text, at some 60 bytes of memory a byte). Ties go by frequency
and then by the phrase's UTF-8 bytes. An empty table, or one without frequent phrases, gives no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleria.session import Scratch

from . import kernels as K
from .common import map_sorted
from .vocabulary import coded, gathered

#: What ends a piece, and what separates words in a piece.
ENDS = K.byte_class(b".,;:!?\n\v\f\r")
WORD = ~(ENDS | K.byte_class(b" \t"))
#: Bytes of texts that a map task holds before it makes blocks of them.
HELD = 12 << 20
#: Positions whose phrases are counted at once.
SEGMENT = 1 << 19
#: Bits of a filter: for each phrase, and at least and at most in all (as powers of two).
BITS_EACH, BITS_LEAST, BITS_MOST = 16, 12, 28
#: Frequent words of up to so many bytes are broadcast to the lists; of more, lists and words are shuffled.
BROADCAST_BYTES = 16 << 20
#: Shares in which the best phrases of a language are looked for first.
SALTS = 64


@dataclass(frozen=True)
class Params:
    min_count: int = 30
    longest: int = 4
    cover_percent: int = 80
    top: int = 2000
    unit: int = 2_000_000
    text_col: str = "text"
    lang_col: str = "lang"


def lists_of(buf: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, list lengths, lists one after the other) of a block of texts."""
    w = K.Words(K.LOWER[buf], offs, WORD)
    codes, words = coded(w)
    ends = np.searchsorted(np.flatnonzero(ENDS[buf]), w.starts)
    doc = w.doc()
    apart = (np.diff(ends) > 0) | (np.diff(doc) > 0)
    at = np.arange(len(w), dtype=np.int64)
    at[1:] += np.cumsum(apart)
    order = np.argsort(codes, kind="stable")
    return words, np.bincount(codes, minlength=len(words)), at[order].astype(np.int32)


def binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column whose rows are `counts` values each."""
    offs = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts * values.itemsize, out=offs[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def word_lists(docs: DataFrame, p: Params) -> DataFrame:
    """block, lang, word, n, positions: the inverted lists. A block is of one language and of one map task."""
    rows = docs.select(F.col(p.text_col).cast("string"), F.coalesce(F.col(p.lang_col).cast("string"), F.lit("und")), F.spark_partition_id().cast("long"))

    def make():
        def run(batches):
            held: dict[str, list] = {}
            size = block = 0

            def out():
                nonlocal size, block
                for lang, texts in held.items():
                    words, n, lists = lists_of(np.concatenate([b for b, _ in texts]), np.r_[0, np.cumsum(np.concatenate([x for _, x in texts]))])
                    starts = np.r_[0, np.cumsum(n)]
                    for i in range(0, len(words), 1 << 14):  # rows of one batch
                        m = n[i : i + (1 << 14)]
                        cut = lists[starts[i] : starts[i + len(m)]]
                        yield [np.full(len(m), block), [lang] * len(m), words.slice(i, len(m)).cast(pa.large_string()), m, binary(cut, m)]
                    block += 1
                held.clear()
                size = 0

            for batch in batches:
                if not batch.num_rows:
                    continue
                block = max(block, int(batch.column(2)[0].as_py()) << 32)
                for lang in pc.unique(batch.column(1)).to_pylist():
                    buf, offs = K.text_buffers(batch.column(0).filter(pc.equal(batch.column(1), lang)))
                    held.setdefault(lang, []).append((buf.copy(), np.diff(offs)))
                    size += len(buf)
                if size >= HELD:
                    yield from out()
            yield from out()

        return run

    return map_sorted(rows, make, "block long, lang string, word string, n long, positions binary")


def numbered(scratch: Scratch, words: DataFrame) -> DataFrame:
    """The words with dense numbers `id` from 0: a row's number in its partition and the rows of the partitions before."""
    kept = scratch.keep(words.withColumn("at", F.monotonically_increasing_id()), "frequent-words")
    part = F.shiftright("at", 33)
    sizes = kept.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    start, firsts = 0, []
    for r in sizes:
        firsts.append((r["part"], start))
        start += r["count"]
    firsts = F.broadcast(scratch.spark.createDataFrame(firsts, "part long, first long"))
    return kept.withColumn("part", part).join(firsts, "part").select("lang", "word", "f", (F.col("first") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("id"))


def blocks(lists: DataFrame, words: DataFrame) -> DataFrame:
    """block, ids, sizes, positions: the lists of a block's frequent words in one row."""
    names = words.select("lang", "word", "id")
    small = names.select(F.coalesce(F.sum(F.octet_length("word") + 64), F.lit(0))).first()[0] <= BROADCAST_BYTES
    found = lists.join(F.broadcast(names) if small else names, ["lang", "word"]).select("block", "id", "n", "positions")
    dealt = found.repartition("block").sortWithinPartitions("block", "id")

    def make():
        def one(t: pa.Table):
            ids, n, lists = t.column("id").to_numpy(), t.column("n").to_numpy(), b"".join(t.column("positions").to_pylist())
            return [[t.column("block")[0].as_py()], [ids.astype(np.int64).tobytes()], [n.astype(np.int32).tobytes()], [lists]]

        def run(batches):
            held: list[pa.Table] = []
            for t in gathered(batches, 1 << 14):
                b = t.column("block").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(b)) + 1).tolist(), len(b)]
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    if held and held[0].column("block")[0].as_py() != int(b[i]):
                        yield one(pa.concat_tables(held))
                        held = []
                    held.append(t.slice(i, j - i))
            if held:
                yield one(pa.concat_tables(held))

        return run

    return map_sorted(dealt, make, "block long, ids binary, sizes binary, positions binary")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def row_hash(*columns: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of rows of longs."""
    turn = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(columns[0]), 42, np.uint64)
    for c in columns:
        h = h + _P5 + np.uint64(8)
        h ^= turn(c.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = turn(h, 27) * _P1 + _P4
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        h ^= h >> np.uint64(32)
    return h


class Frequent:
    """A filter of the frequent phrases of a level: all of them pass, and few others."""

    def __init__(self, phrases: DataFrame, keys: list[str]):
        n = phrases.count()
        self.bits = 1 << min(BITS_MOST, max(BITS_LEAST, (n * BITS_EACH).bit_length()))
        h = F.xxhash64(*keys).bitwiseAND(self.bits - 1)
        rows = phrases.select(h.alias("h")).select(F.shiftright("h", 6).cast("int").alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b"))
        got = rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        self.words = np.zeros(self.bits // 64, np.uint64)
        self.words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)

    def __call__(self, *keys: np.ndarray) -> np.ndarray:
        at = row_hash(*keys) & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def extended(ids: np.ndarray, sizes: np.ndarray, positions: np.ndarray, filters: list[Frequent]) -> Iterator[list[np.ndarray]]:
    """The lists of the phrases one word longer than the last filter's, as (keys of the words, lengths) of one block. The
    phrases that begin in each SEGMENT positions are counted by themselves: a task holds little more than the lists."""
    # Positions and codes of a block are below 2^31; only two codes together take 64 bits, for as long as they are sorted.
    size = int(positions.max()) + 5 if len(positions) else 5
    word = np.full(size, -1, np.int32)
    word[positions] = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)  # at each position the word whose list has it
    at = np.sort(positions)
    for i in range(0, len(at), SEGMENT):
        some = at[i : i + SEGMENT + 3]  # a phrase of four words that begins in the segment has three more positions
        low, last = some[0], at[min(i + SEGMENT, len(at)) - 1]
        yield from _extended(word[low : some[-1] + 5], some - low, last - low, ids, filters)


def _extended(word: np.ndarray, at: np.ndarray, last: int, ids: np.ndarray, filters: list[Frequent]) -> Iterator[list[np.ndarray]]:
    """extended() of phrases that begin at `last` at most. word: by position; at: positions, and three after the last."""
    size, m = len(word), len(ids)
    at = at[word[at + 1] >= 0]
    if not filters:
        at = at[at <= last]
        kinds, n = np.unique(word[at] * np.int64(m) + word[at + 1], return_counts=True)
        yield [packed(ids[kinds // m], ids[kinds % m]), n]
        return
    kinds, code = coded_pairs(word[at], word[at + 1], m)
    keys = packed(ids[kinds // m], ids[kinds % m])
    good = filters[0](keys)
    pair = np.full(size, -1, np.int32)
    pair[at] = np.where(good[code], code, -1)
    at = at[good[code]]
    at = at[pair[at + 1] >= 0]  # the phrases at i and at i + 1 meet
    if len(filters) == 1:
        at = at[at <= last]
        kinds, n = np.unique(pair[at] * np.int64(m) + word[at + 2], return_counts=True)
        yield [keys[kinds // m], ids[kinds % m], n]
        return
    kinds, code = coded_pairs(pair[at], word[at + 2], m)
    del word
    good = filters[1](keys[kinds // m], ids[kinds % m])
    three = np.zeros(size, bool)
    at = at[good[code]]
    del code, kinds
    three[at] = True
    at = at[three[at + 1] & (at <= last)]
    kinds, n = np.unique(pair[at] * np.int64(len(keys)) + pair[at + 2], return_counts=True)
    yield [keys[kinds // max(1, len(keys))], keys[kinds % max(1, len(keys))], n]


def coded_pairs(a: np.ndarray, b: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(different values of a * m + b, the place of each row's value there)."""
    both = a * np.int64(m) + b
    order = np.argsort(both)
    both = both[order]
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    code = np.empty(len(both), np.int32)
    code[order] = np.cumsum(new, dtype=np.int32) - 1
    return both[new], code


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two word numbers in 64 bits (numbers are below 2^31: frequent words only)."""
    return (a << 32) | b


def level(index: DataFrame, filters: list[Frequent], p: Params) -> DataFrame:
    """Frequent phrases of len(filters) + 2 words: k1 (first two words), k2 (third, or third and fourth), f."""
    known = index.sparkSession.sparkContext.broadcast(filters)
    names = ["k1"] if not filters else ["k1", "k2"]

    def make():
        def run(batches):
            for batch in batches:
                for row in batch.select(["ids", "sizes", "positions"]).to_pylist():
                    args = [np.frombuffer(row[c], kind) for c, kind in (("ids", np.int64), ("sizes", np.int32), ("positions", np.int32))]
                    for cols in extended(*args, known.value):
                        for i in range(0, len(cols[0]), 1 << 16):
                            yield [c[i : i + (1 << 16)] for c in cols]

        return run

    counts = map_sorted(index, make, ", ".join(f"{c} long" for c in [*names, "n"]))
    return counts.groupBy(*names).agg(F.sum("n").alias("f")).filter(F.col("f") >= p.min_count)


def frequent_phrases(docs: DataFrame, p: Params, scratch: Scratch) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(lang, n: all words), (lang, word, f, id: frequent words), tables of the frequent phrases of 2 words and more."""
    lists = scratch.keep(word_lists(docs, p), "word-lists")
    counts = lists.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = scratch.keep(numbered(scratch, counts.filter(F.col("f") >= p.min_count)), "numbered-words")
    total = scratch.keep(lists.groupBy("lang").agg(F.sum("n").alias("n")), "languages")
    index = scratch.keep(blocks(lists, words), "frequent-lists")
    scratch.drop(lists)
    levels: list[DataFrame] = []
    filters: list[Frequent] = []
    for k in range(2, p.longest + 1):
        levels.append(scratch.keep(level(index, filters, p), f"phrases-{k}"))
        if k < p.longest:
            filters.append(Frequent(levels[-1], levels[-1].columns[:-1]))
    scratch.drop(index)
    return total, words, levels


HIGH, LOW = "shiftright({0}, 32)", "({0} & 4294967295L)"
#: Of the phrases of 2, 3 and 4 words in their keys: the words, and the two phrases one word shorter as (k1) or (k1, k2).
SPELT = [[HIGH.format("k1"), LOW.format("k1")], [HIGH.format("k1"), LOW.format("k1"), "k2"], [HIGH.format("k1"), LOW.format("k1"), HIGH.format("k2"), LOW.format("k2")]]


def keys_of(words: list[str]) -> list[str]:
    """The key columns of a phrase of these words."""
    pair = lambda a, b: f"(shiftleft({a}, 32) | {b})"
    return [words[0]] if len(words) == 1 else [pair(*words[:2]), *([words[2]] if len(words) == 3 else [pair(*words[2:])] if len(words) == 4 else [])]


def scored(words: DataFrame, levels: list[DataFrame], p: Params) -> DataFrame:
    """lang, w (numbers of the words), a, l, r, score: the candidates that no longer one covers."""
    ones = words.select(F.col("id").alias("k1"), "f")
    tables = [ones, *levels]
    out = []
    for k, found in enumerate(levels, 2):
        spelt = SPELT[k - 2]
        rows = found.select(*[F.expr(c).alias(f"w{i}") for i, c in enumerate(spelt, 1)], F.col("f").alias("a"))
        names = [f"w{i}" for i in range(1, k + 1)]
        if k < p.longest and k - 1 < len(levels):
            longer = levels[k - 1].select(*[F.expr(c).alias(f"w{i}") for i, c in enumerate(SPELT[k - 1], 1)], "f")
            inside = [longer.select(*[F.col(f"w{i + s}").alias(f"w{i}") for i in range(1, k + 1)], "f") for s in (0, 1)]
            cover = inside[0].unionByName(inside[1]).groupBy(*names).agg(F.max("f").alias("cover"))
            rows = rows.join(cover, names, "left").filter(F.expr(f"cover IS NULL OR 100 * cover < {p.cover_percent} * a")).drop("cover")
        cuts = []
        for cut in range(1, k):
            for side, part in (("l", names[:cut]), ("r", names[cut:])):
                keys = keys_of(part)
                table = tables[len(part) - 1]
                table = table.select(*[F.col(c).alias(f"_{c}") for c in table.columns[:-1]], F.col("f").alias(f"{side}{cut}"))
                rows = rows.join(table, reduce(lambda x, y: x & y, [F.expr(e) == F.col(f"_k{i}") for i, e in enumerate(keys, 1)])).drop("_k1", "_k2")
            score = f"cast(a as decimal(20, 0)) * {p.unit} div (l{cut} + r{cut})"
            cuts.append(F.struct(F.expr(score).alias("score"), F.lit(cut).alias("cut"), F.col(f"l{cut}").alias("l"), F.col(f"r{cut}").alias("r")))
        rows = rows.withColumn("best", F.array_min(F.array(*cuts)))
        rows = rows.join(words.select("lang", F.col("id").alias("w1")), "w1")
        out.append(rows.select("lang", F.array(*names).alias("w"), "a", "best.l", "best.r", "best.score"))
    return reduce(DataFrame.unionByName, out)


def best(found: DataFrame, words: DataFrame, p: Params) -> DataFrame:
    """The first phrases of each language, spelt and ranked; those that shares of a language rank too low leave first."""
    share = F.pmod(F.xxhash64("w"), F.lit(SALTS))
    score = [F.col("score").desc(), F.col("a").desc()]
    near = found.withColumn("share", share).withColumn("nth", F.rank().over(Window.partitionBy("lang", "share").orderBy(*score))).filter(F.col("nth") <= p.top)
    each = near.select("*", F.posexplode("w").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = each.groupBy("lang", "share", "w", "a", "l", "r", "score").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"))
    spelt = spelt.withColumn("phrase", F.array_join("x.word", " ")).drop("w", "x")
    few = spelt.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*score, "phrase"))).filter(F.col("nth") <= p.top)
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*score, "phrase")).cast("long")).filter(F.col("rank") <= p.top).drop("share", "nth")


def mine(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """lang, rank, phrase, a (its frequency), l and r (of the parts at its worst cut), n (words of the language), score."""
    p = p or Params()
    if not 2 <= p.longest <= 4:
        raise ValueError("longest is 2, 3 or 4")
    scratch = Scratch(docs.sparkSession)
    total, words, levels = frequent_phrases(docs, p, scratch)
    found = scratch.keep(scored(words, levels, p), "scored")
    top = best(found, words, p)
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
