"""Hamming joins of 64-bit hashes by an index of bit bands with probes, exact at every distance.

The bits that vary are dealt to bands; each band has a radius so that a pair within the distance differs by at most the radius
in at least one of them (the radii plus one add up to the distance plus one). A row enters the index once per band, under its
bits there, and probes all keys within the band's radius; equal hashes are one. The number of bands is chosen by
the expected work: few wide bands take more probes and meet fewer strangers. Where the index would meet about as many rows as
all pairs (large distances, few varying bits), blocks of hashes meet block by block in Arrow tiles instead.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleria.functions import expr as X
from galleria.session import Scratch, ship

from . import tiles

#: Expected work of a probe and of a met row, in comparisons of a tile.
PROBE, MEET = 10.0, 12.0
#: Where many rows share a key, they look up its neighbours together: work of a key and of a row gathered, and rows of a key from which it pays.
KEY, GATHER, SHARED = 20_000.0, 4.0, 4
#: Most probes of a row in one band.
MOST_PROBES = 20_000


@dataclass(frozen=True)
class Band:
    bits: tuple[int, ...]
    radius: int

    @property
    def mask(self) -> int:
        return signed(sum(1 << k for k in self.bits))

    def probes(self) -> int:
        return sum(math.comb(len(self.bits), r) for r in range(self.radius + 1))

    def shared(self, rows: int) -> bool:
        """Whether rows of equal keys look up their neighbours together."""
        return len(self.bits) <= TABLE_BITS and rows >= SHARED << len(self.bits)


def signed(m: int) -> int:
    return m - (1 << 64) if m >> 63 else m


def deal(order: list[int], bands: int, distance: int) -> list[Band]:
    """The bits in turn to so many bands; the first bands take the larger radii."""
    base, more = divmod(distance + 1, bands)
    return [Band(tuple(order[k::bands]), base - 1 + (k < more)) for k in range(bands)]


def share_met(band: Band, odds: dict[int, float]) -> float:
    """Chance that two rows of independent bits differ by at most the radius in the band."""
    chance = [1.0]
    for k in band.bits:
        p = 2 * odds[k] * (1 - odds[k])
        chance = [(chance[i] if i < len(chance) else 0.0) * (1 - p) + (chance[i - 1] * p if i else 0.0) for i in range(len(chance) + 1)]
    return sum(chance[: band.radius + 1])


def expected_work(band: Band, odds: dict[int, float], rows_a: int, rows_b: int) -> float:
    met, keys = rows_a * rows_b * share_met(band, odds), 1 << len(band.bits)
    if band.shared(rows_a):
        return keys * (KEY + PROBE * band.probes()) + met * (1 + GATHER * keys / rows_a)
    return rows_a * band.probes() * PROBE + MEET * met


def plan(odds: dict[int, float], distance: int, rows_a: int, rows_b: int, probed: bool | None = None) -> list[Band] | None:
    """The bands of least expected work for bits that are set with these odds; none where tiles are less, unless probed."""
    order = sorted(odds, key=lambda k: abs(odds[k] - 0.5))
    best, least = None, math.inf if probed else float(rows_a) * rows_b
    for n in range(1, min(distance + 1, len(order)) + 1):
        bands = deal(order, n, distance)
        if any(b.radius >= len(b.bits) or b.probes() > MOST_PROBES for b in bands):
            continue
        work = sum(expected_work(b, odds, rows_a, rows_b) for b in bands)
        if work < least:
            best, least = bands, work
    return best


def bit_odds(*tables: DataFrame) -> tuple[dict[int, float], list[int]]:
    """(share of rows with the bit set, of bits that are not the same in all rows; rows of each table)."""
    cols = [F.count("h").alias("n"), *[F.sum(F.getbit("h", F.lit(k)).cast("long")).alias(f"b{k}") for k in range(64)]]
    rows = [t.agg(*cols).first() for t in tables]
    n = sum(r["n"] for r in rows)
    sets = {k: sum(r[f"b{k}"] or 0 for r in rows) for k in range(64)}
    return {k: s / n for k, s in sets.items() if 0 < s < n}, [r["n"] for r in rows]


def hamming_pairs(a: DataFrame, distance: int, b: DataFrame | None = None, probed: bool | None = None) -> DataFrame:
    """(id_a, id_b, dist) of 64-bit hashes within a Hamming distance; inputs (id, h), a null hash meets nothing. One table:
    id_a < id_b. Each pair comes from the first band that finds it. probed: the index or the tiles, instead of the choice."""
    odds, rows = bit_odds(*([a] if b is None else [a, b]))
    bands = None if probed is False else plan(odds, distance, rows[0], rows[-1], probed)
    if probed and bands is None:
        bands = deal(sorted(odds), max(1, min(distance // 3 + 1, len(odds))), distance)
    if bands is None:
        return tiled_pairs(a, distance, b)
    return indexed_pairs(a, distance, b, bands)


#: Rows of either side that a task holds, about, probing rows that a task takes at least, and rows of a key that stay in one task.
INDEX_ROWS, PROBING, TOGETHER = 4_000_000, 20_000, 64
#: Most leading bits of a band by which rows are dealt to slices; more rows of the same are dealt by their hash.
MOST_LEADING = 8
#: Hashes of a row on their way to tasks.
PACK = 4096
#: Ids of a hash that a row holds, about, and tasks of a core that write pairs of ids out.
TOLD, WRITING = 1000, 8
#: Keys of a band's bits that a table of places may have; a band of more bits is looked up by its sorted keys.
TABLE_BITS = 24
#: Probes that are looked up at once, and pairs of a key's rows with their neighbours that are compared at once.
AT_ONCE, COMPARED = 4_000_000, 1 << 17


class Index:
    """Hashes sorted by their bits in a band, and where each key's rows begin."""

    def __init__(self, hashes: np.ndarray, band: Band):
        self.bits, self.mask = np.array(sorted(band.bits), np.uint64), np.uint64(band.mask & (2**64 - 1))
        flips = [sum(1 << i for i in c) for r in range(band.radius + 1) for c in combinations(range(len(band.bits)), r)]
        self.flips = np.array(flips, np.uint64 if len(band.bits) > 31 else np.uint32)
        keys = self.keys(hashes)
        self.rows = np.argsort(keys, kind="stable")
        self.sorted, self.hashes = keys[self.rows], hashes[self.rows]
        self.first = None
        if len(band.bits) <= TABLE_BITS:
            self.first = np.searchsorted(self.sorted, np.arange((1 << len(band.bits)) + 1, dtype=self.sorted.dtype)).astype(np.int32)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.uint64)
        for i, k in enumerate(self.bits):
            out |= ((hashes >> k) & np.uint64(1)) << np.uint64(i)
        return out.astype(self.flips.dtype)

    def met(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places in hashes, rows of the index) that differ by at most the radius in the band; a few probes at a time."""
        step = max(1, AT_ONCE // len(self.flips))
        for i in range(0, len(hashes), step):
            probes = (self.keys(hashes[i : i + step])[:, None] ^ self.flips[None, :]).ravel()
            if self.first is not None:
                low = self.first[probes]
                n = self.first[probes + 1] - low
            else:
                low = np.searchsorted(self.sorted, probes)
                n = np.searchsorted(self.sorted, probes, "right") - low
            hit = np.flatnonzero(n)
            low, n = low[hit].astype(np.int64), n[hit].astype(np.int64)
            ends = np.cumsum(n)
            for j, k in _runs(ends, AT_ONCE):
                many = n[j:k]
                base = np.repeat(low[j:k] - (ends[j:k] - many), many) + np.arange(ends[j] - n[j], ends[k - 1])
                yield np.repeat(hit[j:k] // len(self.flips) + i, many), self.rows[base]

    def near(self, hashes: np.ndarray, distance: int, one: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of hashes within the distance that differ by at most the radius in the band: the rows of a key look its
        neighbours up once and meet them as a table. one: neighbours have no lower key, so unequal keys meet once."""
        keys = self.keys(hashes)
        order = np.argsort(keys, kind="stable")
        keys, hashes = keys[order], hashes[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
            probes = keys[i] ^ self.flips
            probes = probes[probes >= keys[i]] if one else probes
            low = self.first[probes].astype(np.int64)
            n = self.first[probes + 1] - low
            ends = np.cumsum(n)
            if not ends[-1]:
                continue
            y = self.hashes[np.repeat(low - (ends - n), n) + np.arange(ends[-1])]
            step = max(1, COMPARED // len(y))
            for k in range(i, j, step):
                x = hashes[k : min(j, k + step)]
                hit = np.flatnonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= distance)
                if not len(hit):
                    continue
                p, q = np.divmod(hit, len(y))
                a, b = x[p], y[q]
                if one:  # of equal keys both orders meet
                    once = ((a ^ b) & self.mask != 0) | (a <= b)
                    a, b = a[once], b[once]
                yield a, b


def _runs(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose running sums grow by about `most` each; a place of more is one by itself."""
    j = 0
    while j < len(ends):
        k = max(j + 1, int(np.searchsorted(ends, (ends[j - 1] if j else 0) + most, "right")))
        yield j, k
        j = k


def _salts(hashes: DataFrame, band: Band, most: int) -> int:
    """Parts to which the rows of a band's largest key are dealt: TOGETHER rows of it at least to each."""
    largest = hashes.groupBy(F.col("h").bitwiseAND(F.lit(band.mask)).alias("k")).count().agg(F.max("count")).first()[0]
    return max(1, min(most, (largest or 0) // TOGETHER))


@dataclass(frozen=True)
class Meeting:
    """A slice that is asked for and a slice in which it is looked up: (leading bits, number) each, the band, and what is left of it."""

    band: int
    left: tuple[int, int]
    right: tuple[int, int]
    inner: Band

    @property
    def same(self) -> bool:
        return self.left == self.right


def _lead(band: Band, rows: int) -> list[int]:
    """The bits of a band, its highest, by which so many rows are dealt to slices of about INDEX_ROWS."""
    n = min(max(0, math.ceil(math.log2(max(1, rows) / INDEX_ROWS))), len(band.bits) - 1, MOST_LEADING)
    return sorted(band.bits)[len(band.bits) - n :]


def _meetings(left: dict[tuple[int, int], int], right: dict[tuple[int, int], int], bands: list[Band], leads: list[list[int]], one: bool) -> list[Meeting]:
    """Slices meet whose leading bits differ by at most the radius; the rest of the band may differ by what is left of it. Of one
    table two slices meet once. The most work comes first."""
    out = []
    for (k, x), n in left.items():
        band, lead = bands[k], leads[k]
        rest = tuple(sorted(set(band.bits) - set(lead)))
        for r in range(min(band.radius, len(lead)) + 1):
            inner = Band(rest, band.radius - r)
            for flips in combinations(range(len(lead)), r):
                y = x ^ sum(1 << i for i in flips)
                pairs = itertools.product(range(n), range(right.get((k, y), 0)))
                out += [Meeting(k, (x, c), (y, d), inner) for c, d in pairs if not one or (x, c) <= (y, d)]
    return sorted(out, key=lambda m: -m.inner.radius)


def _pairs(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ha, hb = (np.concatenate(x).view(np.int64) for x in zip(*held, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(ha), pa.array(hb)], names=["ha", "hb"])


def indexed_pairs(a: DataFrame, distance: int, b: DataFrame | None, bands: list[Band]) -> DataFrame:
    """hamming_pairs by the bands. Equal hashes are one until the end: different hashes meet, and their ids are written out then.

    The hashes of both sides are dealt to slices of about INDEX_ROWS by the leading bits of each band, and by their hash where more
    have these bits; slices meet whose leading bits differ by at most the radius. A task builds the index of one in memory and
    probes it by another, or by a part of it. No probe and no row that is only met is ever a row of a table."""
    spark, one = a.sparkSession, b is None
    ship(spark)
    scratch = Scratch(spark)
    cores = spark.sparkContext.defaultParallelism

    def grouped(t: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((h, piece, ids): the ids of each hash, in pieces of about 1,000; (h, gl_n): hashes of several pieces)."""
        t = t.filter("h IS NOT NULL").select("id", "h")
        many = scratch.keep(t.groupBy("h").agg(F.ceil(F.count("*") / TOLD).cast("int").alias("gl_n")).filter("gl_n > 1"), "many")
        piece = F.coalesce(F.pmod(F.xxhash64("id"), F.col("gl_n")).cast("int"), F.lit(0))
        cut = t.join(F.broadcast(many), "h", "left").withColumn("piece", piece)
        return scratch.keep(cut.groupBy("h", "piece").agg(F.collect_list("id").alias("ids")), "hashes"), many

    left, many_left = grouped(a)
    right, many_right = (left, many_left) if one else grouped(b)
    each_left = scratch.keep(left.select("h").distinct(), "each")
    each_right = each_left if one else scratch.keep(right.select("h").distinct(), "each")
    n_left, n_right = each_left.count(), each_right.count()
    shared = [x.shared(min(n_left, n_right)) for x in bands]
    most = max(n_left, n_right)
    leads = [_lead(x, most) for x in bands]
    deal_to = lambda n, seed: F.pmod(F.xxhash64("h", F.lit(seed)), n).cast("int")

    def sliced(t: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
        """((h, gl_b, gl_x, gl_c): a hash in the slices of its leading bits in each band; rows of each leading bits)."""
        of = [sum((F.getbit("h", F.lit(k)).cast("int") * F.lit(1 << i) for i, k in enumerate(lead)), F.lit(0)) for lead in leads]
        placed = t.select("h", F.posexplode(F.array(*of)).alias("gl_b", "gl_x"))
        counts = scratch.keep(placed.groupBy("gl_b", "gl_x").agg(F.count("*").alias("gl_n")), "slices")
        cut = F.ceil(F.col("gl_n") / INDEX_ROWS).cast("int")
        out = placed.join(F.broadcast(counts), ["gl_b", "gl_x"]).withColumn("gl_c", deal_to(cut, 1))
        out = out.withColumn("gl_packs", F.greatest(F.lit(1), F.ceil(F.col("gl_n") / (cut * PACK)).cast("int"))).drop("gl_n")
        return out, {(r["gl_b"], r["gl_x"]): -(-r["gl_n"] // INDEX_ROWS) for r in counts.collect()}

    sliced_left, cuts_left = sliced(each_left)
    sliced_right, cuts_right = (sliced_left, cuts_left) if one else sliced(each_right)
    meetings = _meetings(cuts_left, cuts_right, bands, leads, one)
    parts = max(1, min(-(-4 * cores // max(1, len(meetings))), n_left // PROBING))
    spread = [_salts(each_left, x, parts) if together and parts > 1 else parts for x, together in zip(bands, shared, strict=True)]
    # Rows of a key go to one part, or to as many as its rows are worth.
    part_of = [F.pmod((F.xxhash64(F.col("h").bitwiseAND(F.lit(x.mask))) if n < parts else F.lit(0)) % parts + deal_to(F.lit(n), 2), F.lit(parts)).cast("int") for x, n in zip(bands, spread, strict=True)]
    # Hashes travel in packs, so that a row of a shuffle is some thousand of them.
    at = ["gl_b", "gl_x", "gl_c"]
    pack = lambda t, *by: t.withColumn("gl_k", deal_to(F.col("gl_packs"), 3)).groupBy(*at, *by, "gl_k").agg(F.collect_list("h").alias("hs"))
    asking = sliced_left.withColumn("gl_p", F.element_at(F.array(*part_of), F.col("gl_b") + 1)).withColumn("gl_packs", F.ceil(F.col("gl_packs") / parts).cast("int"))
    numbered = [(m, p, parts * i + p) for i, m in enumerate(meetings) for p in range(parts)]
    to = lambda rows: F.broadcast(spark.createDataFrame(rows, "gl_b int, gl_x int, gl_c int, gl_p int, gl_t int, gl_side int"))
    sent, asked = ([(m.band, *s, p, t, k) for m, p, t in numbered for s in [m.left if k else m.right]] for k in range(2))
    if one and parts == 1:  # both sides are the same packs
        dealt = pack(sliced_left).join(to(sent + asked), at).select("gl_t", "gl_side", "hs")
    else:
        dealt = pack(sliced_right).join(to(sent), at).select("gl_t", "gl_side", "hs")
        dealt = dealt.unionByName(pack(asking, "gl_p").join(to(asked), [*at, "gl_p"]).select("gl_t", "gl_side", "hs"))
    dealt = dealt.repartitionById(max(1, len(numbered)), F.col("gl_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition is a meeting, or a part of one."""
        sides: tuple[list[np.ndarray], list[np.ndarray]] = [], []
        for batch in batches:
            for i, (t, side) in enumerate(zip(batch.column("gl_t").to_pylist(), batch.column("gl_side").to_pylist(), strict=True)):
                meeting = meetings[t // parts]
                sides[side].append(batch.column("hs").slice(i, 1).flatten().to_numpy().view(np.uint64).copy())
        if not all(sides):
            return
        rows, asked = (np.concatenate(x) for x in sides)
        del sides
        k, alone = meeting.band, one and meeting.same
        index = Index(rows, meeting.inner)

        def met() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            if shared[k]:
                yield from index.near(asked, distance, alone)
                return
            for p, r in index.met(asked):
                ha, hb = asked[p], rows[r]
                keep = np.bitwise_count(ha ^ hb) <= distance
                keep &= (ha <= hb) if alone else True
                yield ha[keep], hb[keep]

        held, n = [], 0
        for ha, hb in met():
            for earlier in bands[:k]:  # a pair comes from the first band that finds it
                new = np.bitwise_count((ha ^ hb) & np.uint64(earlier.mask & (2**64 - 1))) > earlier.radius
                ha, hb = ha[new], hb[new]
            held.append((ha, hb))
            n += len(ha)
            if n >= 1 << 16 or len(held) >= 1 << 12:
                yield _pairs(held)
                held, n = [], 0
        if n:
            yield _pairs(held)

    found = dealt.mapInArrow(run, "ha long, hb long")
    # Pairs of hashes become pairs of pieces, which many tasks write out: few hashes of many copies are as much work as many hashes.
    pieces = lambda t, many, h, i: t.join(F.broadcast(many.withColumnRenamed("h", h)), h, "left").withColumn(i, F.explode(F.sequence(F.lit(0), F.coalesce("gl_n", F.lit(1)) - 1))).drop("gl_n")
    found = pieces(pieces(found, many_left, "ha", "i"), many_right, "hb", "j")
    x = left.select(F.col("h").alias("ha"), F.col("piece").alias("i"), F.col("ids").alias("xs"))
    y = right.select(F.col("h").alias("hb"), F.col("piece").alias("j"), F.col("ids").alias("ys"))
    told = max(WRITING * cores, int(spark.conf.get("spark.sql.shuffle.partitions")), (n_left + n_right) // 1_000_000)
    out = found.join(x, ["ha", "i"]).repartition(told, "hb", "j").join(y.hint("merge"), ["hb", "j"])
    out = out.withColumn("dist", X.hamming64(F.col("ha"), F.col("hb")).cast("int"))
    out = out.withColumn("x", F.explode("xs")).withColumn("y", F.explode("ys"))
    if not one:
        return out.select(F.col("x").alias("id_a"), F.col("y").alias("id_b"), "dist")
    # Two hashes meet once, the lower first; one hash meets itself, and of its pairs each is wanted once.
    return out.filter("(ha = hb AND x < y) OR (ha <> hb AND x <> y)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "dist")


def tiled_pairs(a: DataFrame, distance: int, b: DataFrame | None) -> DataFrame:
    """All pairs, block by block: the distances of a tile are one table of XORs and bit counts."""
    scratch = Scratch(a.sparkSession)
    table = lambda t: tiles.blocks(t.filter("h IS NOT NULL").select("id", "h"), scratch)
    left, one = table(a), b is None

    def tile(x: tiles.Block, y: tiles.Block):
        hx, hy = x.flat("h").view(np.uint64), y.flat("h").view(np.uint64)
        for i in range(0, len(hx), tiles.STEP):
            d = np.bitwise_count(hx[i : i + tiles.STEP, None] ^ hy[None, :])
            p, q = np.nonzero(d <= distance)
            id_a, id_b, keep = tiles.id_pairs(x, y, p + i, q, one)
            yield [id_a, id_b, d[p, q][keep].astype(np.int32)]

    kinds = [t.schema["id"].dataType.simpleString() for t in (a, a if one else b)]
    return tiles.meet(left, None if one else table(b), tile, f"id_a {kinds[0]}, id_b {kinds[1]}, dist int")
