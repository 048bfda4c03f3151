"""N-gram Jaccard join: connected classes of documents whose sets of k-word shingles have a Jaccard similarity of at least
`percent` / 100, by token-combination prefixes and exact verification.

1. Sets. A document's shingles are 64-bit hashes; documents with equal sets are one class (128-bit hash of the set), so
   copies are never compared.
2. The rarest tokens. A shingle that only one class holds is a single-token index entry without a partner. Of two similar
   sets, neither has more than n - ceil(t n) such shingles, so a class with more is linked with nothing and leaves. This is
   asked twice: of all classes by the shingles in a fixed share of the hash space (the same ones in every document), and of
   those left by all their shingles.
3. Token-combination prefixes. The shingles of the sets that are left are counted, all of them, and ordered by frequency
   class (powers of two; hashes within a class), rare ones first. With D = floor((1 - t) / t * n) shingles at most in one of
   two similar sets only:
   * rare shingles are indexed as single tokens: the first n - ceil(t n) + 1, or all r of them if there are fewer;
   * in the second case the prefix is extended. If none of its rare shingles is shared, D' = D - r differing ones are left
     for the rest. Frequent shingles are indexed by pairs of neighbours, the first 2 D' + 1: d differing shingles split the
     shared ones into d + 1 runs, so a run of two ends within the first 2 d + 2;
   * if they are too few for that, let them be f: at least (f - 1) / 2 of them differ, and D'' = D' - ceil((f - 1) / 2) are
     left for very frequent shingles, of which the first 3 D'' + 1 triples of neighbours are indexed.
   Only sets of a few shingles can pass all three; those of at most `plain_size` (and their partners) use the plain prefix.
4. Verification. Entries that two sets have are buckets. Sets that share a large bucket, or two neighbouring small ones,
   form clusters; a cluster is solved within one task, where each set is compared, as long as their components differ, with
   the larger sets of fitting size that share a bucket with it, and gives at most one link per set. Larger clusters are
   dealt into blocks of bounded size, which are solved one by one; then a bounded number of pivots of the cluster meets each
   block, and at last what is not in the cluster's main component, block by block. Pairs of clusters that share a small
   bucket are listed (a bucket has at most `small_bucket` sets, so at most half as many pairs an entry), thinned out by
   exact bounds (sizes, and parity sketches whose distance is at most that of the sets) and verified on whole sets.
   So no pair is listed within a group of near copies, and nothing is dropped, capped or sampled.

The frequency table is broadcast: at most `max_frequent` entries, the threshold being raised to keep that; any table gives
an exact order and result. Bitmaps are of fixed size (see common.Bitmap).

Defined results: null, empty or word-less text = empty set, linked with nothing (its own component); fewer words than k =
the whole sequence as one shingle; repeated rows share a component; a null id never names a component; extra columns are
ignored; an empty table gives an empty result. Shingles are compared as 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleria.operators.graph import connected_components
from galleria.session import Scratch

from . import kernels as K
from .common import Bitmap, fresh, map_arrow, map_sorted, split_rows, text_hashes


@dataclass(frozen=True)
class Params:
    words: int = 5
    percent: int = 80
    max_frequent: int = 1 << 18
    frequent: int = 5  #: power of two of the sets that hold a shingle, from which on it is indexed in pairs
    very_frequent: int = 9  #: ... and from which on in triples
    small_bucket: int = 32  #: sets of a bucket whose pairs may be listed
    block_sets: int = 4096  #: in a block of a cluster, and
    block_tokens: int = 4 << 20  #: shingles in one, about
    pivots: int = 256  #: of a large cluster

    @property
    def share(self) -> float:
        """Share of the hash space whose shingles the first sieve counts: with room for the n - ceil(t n) + 1 it asks for."""
        return min(1.0, max(0.2, (100 - self.percent) / 100 * 1.7 + 0.05))

    @property
    def plain_size(self) -> int:
        """Sets up to this size may have similar ones without a shared combination.

        Without one, d differing shingles leave at most 2 d + 3 shared ones, and similar sets have p d / (100 - p) at least."""
        ratio = self.percent / (100 - self.percent) if self.percent < 100 else float("inf")
        return 1 << 62 if ratio <= 2 else 3 * int(3 / (ratio - 2)) + 3


def shingle_sets(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of all texts, one after the other; how many each text has)."""
    w = K.Words(K.LOWER[buf], offs, K.NOT_SPACE)
    h = w.hashes()
    at, doc = K.gram_rows(w.first, w.counts, k)
    g = K.ngrams(h, k)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        extra = np.array([K.ngrams(h[w.first[d] : w.first[d + 1]], int(w.counts[d]))[0] for d in few], np.uint64)
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, few])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=len(offs) - 1)


def set_hashes(toks: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set (sums of mixed shingles)."""
    sums1, sums2 = np.zeros(len(toks) + 1, np.uint64), np.zeros(len(toks) + 1, np.uint64)
    np.cumsum(K.mix(toks ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=sums1[1:])
    np.cumsum(K.mix(toks * np.uint64(0x9E3779B97F4A7C15)), out=sums2[1:])
    ends = np.cumsum(n)
    return K.mix(sums1[ends] - sums1[ends - n] + n.astype(np.uint64)), K.mix(sums2[ends] - sums2[ends - n])


def may_lack(n, percent: int):
    """Shingles of a set of n that a similar set may lack, at most."""
    return n - -(-percent * n // 100)


def differ_most(n, percent: int):
    """Shingles in one of two similar sets only, at most, if one of them has n."""
    return (100 - percent) * n // percent


def _scan(p: Params, kind: str):
    """Of each text: hash of the text, size and hash of its set, and its shingles in the sieve's share of the hash space."""
    bound = np.uint64(min(int(p.share * 2.0**64), K.M64))

    def make():
        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            for i, j, b, o in K.blocks(buf, offs):
                toks, n = shingle_sets(b, o, p.words)
                k1, k2 = set_hashes(toks, n)
                t1, t2 = text_hashes(b, o)
                pick = toks <= bound
                sums = np.concatenate([[0], np.cumsum(pick)])
                ends = np.cumsum(n)
                yield [batch.column(0).slice(i, j - i), t1, t2, n, k1, k2, K.list_column(K.signed(toks[pick]), sums[ends] - sums[ends - n], pa.int64())]

        return fn

    return make, f"id {kind}, t1 long, t2 long, n long, k1 long, k2 long, sample array<long>"


def _sets(p: Params, keep):
    """Sets of rows that represent a class still in question. Rows: (hash of id, text)."""

    def make():
        bits = keep.value

        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j, b, o in K.blocks(buf, offs):
                toks, n = shingle_sets(b, o, p.words)
                k1, k2 = set_hashes(toks, n)
                pick = bits.may_hold(ids[i:j] ^ K.signed(k1)) & (n > 0)
                if pick.any():
                    yield [k1[pick], k2[pick], n[pick], K.list_column(K.signed(toks[np.repeat(pick, n)]), n[pick], pa.int64())]

        return fn

    return make, "k1 long, k2 long, n long, toks array<long>"


def kept_rows(df: DataFrame, bitmap, column: str) -> DataFrame:
    """Rows whose key may be in a broadcast bitmap."""
    at = df.columns.index(column)

    def make():
        bits = bitmap.value

        def fn(batch: pa.RecordBatch):
            rows = batch.filter(pa.array(bits.may_hold(batch.column(at).to_numpy())))
            if rows.num_rows:
                yield rows.columns

        return fn

    return map_arrow(df, make, df.schema)


@dataclass
class Frequent:
    """Sorted frequent shingles and the powers of two of their counts."""

    toks: np.ndarray
    powers: np.ndarray

    def of(self, toks: np.ndarray) -> np.ndarray:
        if not len(self.toks):
            return np.zeros(len(toks), np.int64)
        at = np.minimum(np.searchsorted(self.toks, toks), len(self.toks) - 1)
        return np.where(self.toks[at] == toks, self.powers[at], 0)


def frequent_table(counted: DataFrame, p: Params) -> Frequent:
    """The most frequent shingles by powers of two, as many whole powers as fit max_frequent. counted: tok, k."""
    power = F.floor(F.log2("k")).cast("int")
    counted = counted.filter(F.col("k") >= 1 << p.frequent).select("tok", power.alias("power"))
    per = sorted(((r["power"], r["m"]) for r in counted.groupBy("power").agg(F.count("*").alias("m")).collect()), reverse=True)
    least, total = None, 0
    for power_of, m in per:
        if total + m > p.max_frequent:
            break
        least, total = power_of, total + m
    if least is None:
        return Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    got = counted.filter(F.col("power") >= least).toArrow()
    toks = got["tok"].to_numpy().view(np.uint64)
    order = np.argsort(toks)
    return Frequent(toks[order], got["power"].to_numpy().astype(np.int64)[order])


def index_keys(toks: np.ndarray, powers: np.ndarray, p: Params) -> np.ndarray:
    """Index entries of one set. powers: 0 for rare shingles, else by frequency."""
    n = len(toks)
    d, lack = differ_most(n, p.percent), may_lack(n, p.percent)
    if d == 0:
        return toks[:0]  # only equal sets are similar, and those are one class
    order = np.lexsort((toks, powers))
    ordered = K.mix(toks[order])
    rare = int(np.count_nonzero(powers < p.frequent))
    often = int(np.count_nonzero(powers < p.very_frequent)) - rare
    singles = min(rare, lack + 1)
    if n <= p.plain_size:
        return np.unique(ordered[: lack + 1])
    if n * p.percent <= 100 * p.plain_size:
        singles = max(singles, lack + 1)  # its partner may use the plain prefix
    out = [ordered[:singles]]
    if rare <= lack:
        d -= min(rare, d)
        out.append(K.ngrams(ordered[rare : rare + min(often, 2 * d + 2)], 2, family=1))
        if often < 2 * d + 2:
            d = max(0, d - often // 2)
            out.append(K.ngrams(ordered[rare + often :][: 3 * d + 3], 3, family=1))
    return np.unique(np.concatenate(out))


def _index(p: Params, frequent, live):
    """(cid, n, keys) of the sets (cid, n, toks) that may be in a bitmap."""

    def make():
        freq, bits = frequent.value, live.value

        def fn(batch: pa.RecordBatch):
            batch = batch.filter(pa.array(bits.may_hold(batch.column(0).to_numpy())))
            if not batch.num_rows:
                return
            col = batch.column(2)
            flat, offs = col.flatten().to_numpy().view(np.uint64), col.offsets.to_numpy()
            offs = offs - offs[0]
            powers = freq.of(flat)
            keys = [index_keys(flat[a:b], powers[a:b], p) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield [batch.column(0), batch.column(1), K.list_column(K.signed(np.concatenate(keys)), np.array([len(x) for x in keys]), pa.int64())]

        return fn

    return make, "cid long, n long, keys array<long>"


def sketch(toks: np.ndarray) -> np.ndarray:
    """Parity of the set's shingles in each of 2^m places, 2^m >= n and 64: half of it is the sketch of half as many."""
    bits = max(64, 1 << int(len(toks) - 1).bit_length()) if len(toks) else 64
    odd = np.bincount((K.mix(toks) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def sketch_distance(a: np.ndarray, b: np.ndarray) -> int:
    """At most the number of shingles in one of the two sets only."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


class Forest:
    """Components of the sets of a block, as labels."""

    def __init__(self, labels: np.ndarray):
        _, self.of = np.unique(labels, return_inverse=True)

    def join(self, i: int, others: np.ndarray) -> np.ndarray:
        """Put the components of `others` to that of i; one of `others` for each component that was another."""
        comps, first = np.unique(self.of[others], return_index=True)
        pick = comps != self.of[i]
        if pick.any():
            self.of[np.isin(self.of, comps)] = self.of[i]
        return others[first[pick]]


def solve(n: np.ndarray, toks: np.ndarray, keys: np.ndarray, key_n: np.ndarray, labels: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of a block's similar sets: no more than it has sets.

    toks and keys hold the sets' shingles and bucket keys one after the other; sets with equal labels are joined already;
    sets of sides 1 and 2 are compared with the other side only."""
    order = np.argsort(n, kind="stable")
    _, local = np.unique(toks, return_inverse=True)
    _, key_local = np.unique(keys, return_inverse=True)
    off, key_off = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(key_n)])
    held, key_held = np.zeros(int(local.max(initial=-1)) + 1, bool), np.zeros(int(key_local.max(initial=-1)) + 1, bool)
    forest, links = Forest(labels), []
    sizes = n[order]
    tops = np.searchsorted(sizes * percent, 100 * sizes, "right")
    for r, i in enumerate(order.tolist()):
        near = order[r + 1 : tops[r]]
        near = near[forest.of[near] != forest.of[i]]
        if side[i]:
            near = near[side[near] != side[i]]
        if not len(near):
            continue
        mine = key_local[key_off[i] : key_off[i + 1]]
        key_held[mine] = True
        near = np.concatenate([part[_any(key_held[_ranges(key_local, key_off, part)], key_n[part])] for part in _slices(near, key_n)])
        key_held[mine] = False
        if not len(near):
            continue
        mine = local[off[i] : off[i + 1]]
        held[mine] = True
        common = np.concatenate([_sums(held[_ranges(local, off, part)], n[part]) for part in _slices(near, n)])
        held[mine] = False
        hit = near[common * 100 >= percent * (n[near] + n[i] - common)]
        if len(hit):
            links += [(i, j) for j in forest.join(i, hit).tolist()]
    return links


#: Values of sets that are looked at together.
SLICE = 1 << 19


def _slices(rows: np.ndarray, per: np.ndarray) -> list[np.ndarray]:
    """Runs of rows of about SLICE values in all, so that a block's temporary arrays stay small."""
    return np.split(rows, np.flatnonzero(np.diff(np.cumsum(per[rows]) // SLICE)) + 1)


def _ranges(values: np.ndarray, off: np.ndarray, rows: np.ndarray) -> np.ndarray:
    per = off[rows + 1] - off[rows]
    return values[np.repeat(off[rows] - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]


def _sums(flags: np.ndarray, per: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(per)
    return sums[ends] - sums[ends - per]


def _any(flags: np.ndarray, per: np.ndarray) -> np.ndarray:
    return _sums(flags, per) > 0


#: A row of a block: its cluster and place, on which side it is compared (0: with all; 1 and 2: with the other), the set.
_ROW = ["g1", "g2", "g3", "side", "cid", "label", "n", "toks", "keys"]


def _solve_blocks(p: Params):
    """Links (a, b) of blocks, from _ROW sorted by its first three columns."""

    def links(rows: list[tuple]) -> tuple[list, list] | None:
        if len(rows) < 2:
            return None
        side, cid, label, n, key_n = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        if (label == label[0]).all():
            return None
        found = solve(n, np.concatenate([r[5] for r in rows]), np.concatenate([r[6] for r in rows]), key_n, label, side, p.percent)
        return ([int(cid[i]) for i, _ in found], [int(cid[j]) for _, j in found]) if found else None

    def make():
        def run(batches):
            block, rows = None, []
            for batch in batches:
                g = [batch.column(k).to_pylist() for k in range(3)]
                flat = [batch.column(k).to_numpy() for k in range(3, 7)]
                toks, keys = ((c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (batch.column(7), batch.column(8)))
                for k in range(batch.num_rows):
                    at = (g[0][k], g[1][k], g[2][k])
                    if at != block:
                        if got := links(rows):
                            yield got
                        block, rows = at, []
                    key = keys[0][keys[1][k] : keys[1][k + 1]].copy()
                    rows.append((*(c[k] for c in flat), len(key), toks[0][toks[1][k] : toks[1][k + 1]].copy(), key))
            if got := links(rows):
                yield got

        return run

    return make, "a long, b long"


def _block_links(rows: DataFrame, p: Params) -> DataFrame:
    placed = rows.select(*_ROW).repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3")
    return map_sorted(placed, *_solve_blocks(p))


def _labels(links: list[DataFrame], scratch: Scratch) -> DataFrame:
    """(v, label) of the sets with a link."""
    every = links[0]
    for x in links[1:]:
        every = every.unionByName(x)
    return connected_components(every, "a", "b", scratch).toDF("v", "label")


def _up_to(column: str):
    return F.sequence(F.lit(0).cast("long"), F.col(column) - 1)


def cluster_links(work: DataFrame, p: Params, scratch: Scratch) -> list[DataFrame]:
    """Links within clusters. work: cid, n, toks, keys, cluster, parts (blocks of the cluster), sets (in it)."""
    block = F.pmod(F.xxhash64("cid"), F.col("parts"))
    rows = work.select("*", F.col("cluster").alias("g1"), block.alias("g2"))
    found = [scratch.keep(_block_links(rows.select("*", F.lit(0).alias("g3"), F.lit(0).alias("side"), F.col("cid").alias("label")), p), "links")]
    large = rows.filter("parts > 1")
    if large.isEmpty():
        return found

    def labelled(df: DataFrame) -> DataFrame:
        now = _labels(found, scratch).withColumnRenamed("label", "l")
        return df.join(now, F.col("cid") == F.col("v"), "left").select("*", F.coalesce("l", "cid").alias("label")).drop("v", "l")

    def meet(few: DataFrame, all_: DataFrame) -> DataFrame:
        """Each row of `few` goes to every block of its cluster, in its part g3; each row of `all_` to every g3 of its block."""
        left = few.drop("g2").select("*", F.explode(_up_to("parts")).alias("g2"), F.lit(1).alias("side"))
        return scratch.keep(_block_links(left.select(*_ROW).unionByName(all_.select("*", F.lit(2).alias("side")).select(*_ROW)), p), "links")

    now = scratch.keep(labelled(large), "large")
    pivot = F.pmod(F.xxhash64("cid", F.lit(1)), F.ceil(F.col("sets") / p.pivots)) == 0
    now = now.withColumn("g3", F.lit(0).cast("long"))
    found.append(meet(now.filter(pivot), now))
    # What is not in the largest component of its cluster meets all the cluster.
    now = scratch.keep(labelled(now.drop("label", "g3")), "large")
    main = now.groupBy("g1", "label").agg(F.count("*").alias("m")).groupBy("g1").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    main = main.withColumnRenamed("g1", "c")
    rest = now.join(main, (F.col("g1") == F.col("c")) & (F.col("label") != F.col("main"))).drop("c", "main")
    rest = scratch.keep(rest, "rest")
    per = rest.groupBy(F.col("g1").alias("c")).agg(F.ceil(F.greatest(F.count("*") / p.block_sets, F.sum("n") / p.block_tokens)).alias("groups"))
    few = rest.join(per, F.col("g1") == F.col("c")).withColumn("g3", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("groups"))).drop("c", "groups")
    every = now.join(per, F.col("g1") == F.col("c")).withColumn("g3", F.explode(_up_to("groups"))).drop("c", "groups")
    found.append(meet(few, every))
    return found


def _sketches(sets: DataFrame) -> DataFrame:
    """(s, n, sk) of sets (cid, n, toks)."""

    def make():
        def fn(batch: pa.RecordBatch):
            col = batch.column(2)
            flat, offs = col.flatten().to_numpy().view(np.uint64), (col.offsets.to_numpy() - col.offsets[0].as_py()).tolist()
            yield [batch.column(0), batch.column(1), pa.array([sketch(flat[a:b]).tobytes() for a, b in zip(offs, offs[1:], strict=False)], pa.binary())]

        return fn

    return map_arrow(sets.select("cid", "n", "toks"), make, "s long, n long, sk binary")


def _near(p: Params):
    """Pairs (a, b) that their sketches do not rule out, of rows (a, b, na, nb, ska, skb)."""

    def make():
        def fn(batch: pa.RecordBatch):
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            far = np.array([sketch_distance(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for x, y in zip(batch.column(4), batch.column(5), strict=True)])
            # |A xor B| <= (1 - t) / (1 + t) (|A| + |B|)
            pick = pa.array(far * (100 + p.percent) <= n * (100 - p.percent))
            yield [batch.column(0).filter(pick), batch.column(1).filter(pick)]

        return fn

    return make, "a long, b long"


def small_bucket_links(held: DataFrame, work: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """Links between clusters that share a small bucket. held: key, cid, n, m (sets of the bucket), c (cluster or set)."""
    e = held.filter(F.col("m") <= p.small_bucket).select("key", "cid", "n", "c")
    a, b = e.toDF("key", "a", "na", "ca"), e.toDF("key", "b", "nb", "cb")
    fits = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * p.percent
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).groupBy("a", "b").agg(F.lit(1).alias("one")).select("a", "b")
    pairs = scratch.keep(pairs, "pairs")
    sk = scratch.keep(_sketches(work), "sketches")
    rows = pairs.join(sk.toDF("a", "na", "ska"), "a").join(sk.toDF("b", "nb", "skb"), "b").select("a", "b", "na", "nb", "ska", "skb")
    near = scratch.keep(map_arrow(rows, *_near(p)), "near")
    scratch.drop(pairs, sk)
    common = F.size(F.array_intersect("ta", "tb")).cast("long")
    similar = common * 100 >= (F.col("na") + F.col("nb") - common) * p.percent
    asked = near.sparkSession.sparkContext.broadcast(Bitmap(near.select(F.explode(F.array("a", "b")).alias("cid")), "cid", 1 << 22))
    sets = kept_rows(work.select("cid", "n", "toks"), asked, "cid")
    return near.join(sets.toDF("a", "na", "ta"), "a").join(sets.toDF("b", "nb", "tb"), "b").filter(similar).select("a", "b")


def _live_sets(rows: DataFrame, scanned: DataFrame, classes: DataFrame, p: Params, scratch: Scratch) -> tuple:
    """Sets (cid, k1, k2, n, toks), a bitmap of those that may have a similar one, and counts (tok, k) of frequent shingles."""
    sc = rows.sparkSession.sparkContext
    lack = F.col("n") - F.expr(f"({p.percent} * n + 99) div 100")
    possible = F.col("n") * (100 - p.percent) >= p.percent
    lone = scanned.select(F.explode("sample").alias("tok"), "k1").groupBy("tok").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi")).filter("lo = hi")
    lone = lone.groupBy(F.col("lo").alias("l1")).agg(F.count("*").alias("u"))
    asked = classes.filter(possible).join(lone, F.col("k1") == F.col("l1"), "left").filter(F.coalesce("u", F.lit(0)) <= lack)
    keep = sc.broadcast(Bitmap(asked.select(F.xxhash64("rep").bitwiseXOR(F.col("k1")).alias("key")), "key"))
    sets = map_arrow(rows.select(F.xxhash64("id"), "text"), *_sets(p, keep))
    sets = sets.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("toks").alias("toks"))
    sets = scratch.keep(sets.withColumn("cid", F.monotonically_increasing_id()), "sets")
    counted = sets.select("cid", F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("k"), F.min("cid").alias("c"))
    counted = counted.filter((F.col("k") == 1) | (F.col("k") >= 1 << p.frequent))
    counted = scratch.keep(counted.select("k", F.when(F.col("k") > 1, F.col("tok")).alias("tok"), F.when(F.col("k") == 1, F.col("c")).alias("c")), "counts")
    lone = counted.filter("k = 1").groupBy("c").agg(F.count("*").alias("u"))
    live = sets.select("cid", "n").filter(possible).join(lone, F.col("cid") == F.col("c"), "left").filter(F.coalesce("u", F.lit(0)) <= lack)
    return sets, sc.broadcast(Bitmap(live, "cid")), counted.filter("k > 1").select("tok", "k")


@dataclass
class Joined:
    """documents: id, t1, t2, n, k1, k2 a row; classes: k1, k2, rep (smallest id) of each set; linked: (k1, k2, component, named
    1 and 2: the class that gives its component the name) of the classes with a link."""

    documents: DataFrame
    classes: DataFrame
    linked: DataFrame


def _join(docs: DataFrame, p: Params, id_col: str, text_col: str) -> Joined:
    spark = docs.sparkSession
    sc, scratch = spark.sparkContext, Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scanned = scratch.keep(map_arrow(rows, *_scan(p, kind)), "scanned")
    classes = scratch.keep(scanned.filter("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("n").alias("n")), "classes")
    slim = scratch.keep(scanned.drop("sample"), "documents")
    sets, live, frequent = _live_sets(rows, scanned, classes, p, scratch)
    scratch.drop(scanned)
    table = sc.broadcast(frequent_table(frequent, p))
    index = scratch.keep(map_arrow(sets.select("cid", "n", "toks"), *_index(p, table, live)), "index")

    entry = index.select("cid", "n", F.size("keys").alias("of"), F.explode("keys").alias("key"))
    buckets = scratch.keep(entry.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("head")).filter("m > 1"), "buckets")
    held = scratch.keep(entry.join(buckets.withColumnRenamed("key", "bk"), F.col("key") == F.col("bk")).drop("bk"), "held")
    scratch.drop(index, buckets)
    # A set belongs with the head of a large bucket, or of small ones that are a quarter of its entries.
    edges = held.groupBy("cid", "head").agg(F.max("m").alias("m"), F.count("*").alias("k"), F.first("of").alias("of"))
    edges = edges.filter((F.col("cid") != F.col("head")) & ((F.col("m") > p.small_bucket) | (F.col("k") * 4 >= F.col("of")))).select("cid", "head")
    cluster = connected_components(edges, "cid", "head", scratch).toDF("v", "cluster")
    size = scratch.keep(sets.select("cid", "n").join(cluster, F.col("cid") == F.col("v")).groupBy("cluster").agg(F.count("*").alias("sets"), F.sum("n").alias("tokens")), "clusters")
    parts = F.ceil(F.greatest(F.col("sets") / p.block_sets, F.col("tokens") / p.block_tokens)).alias("parts")
    of = cluster.join(size.select(F.col("cluster").alias("c"), "sets", parts), F.col("cluster") == F.col("c")).drop("c")
    keys = held.groupBy(F.col("cid").alias("h")).agg(F.collect_list("key").alias("keys"))
    met = sc.broadcast(Bitmap(held.select("cid").distinct(), "cid"))
    work = kept_rows(sets, met, "cid").join(keys, F.col("cid") == F.col("h")).join(of, F.col("cid") == F.col("v"), "left")
    work = scratch.keep(work.select("cid", "k1", "k2", "n", "toks", "keys", "cluster", "parts", "sets"), "work")
    links = cluster_links(work.filter("cluster IS NOT NULL").drop("k1", "k2"), p, scratch)
    own = held.join(cluster, F.col("cid") == F.col("v"), "left").select("key", "cid", "n", "m", F.coalesce("cluster", "cid").alias("c"))
    links.append(scratch.keep(small_bucket_links(own, work, p, scratch), "links"))
    scratch.drop(held, sets)

    labels = _labels(links, scratch)
    named = work.select("cid", "k1", "k2").join(labels, F.col("cid") == F.col("v")).select("label", "k1", "k2")
    named = named.join(classes.select("k1", "k2", "rep"), ["k1", "k2"])
    # A null id names nothing: it comes last.
    least = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "k1", "k2")).alias("x"))
    least = least.select("label", F.col("x.rep").alias("component"), F.col("x.k1").alias("named1"), F.col("x.k2").alias("named2"))
    linked = scratch.keep(named.join(least, "label").select("k1", "k2", "component", "named1", "named2"), "linked")
    scratch.drop(work)
    return Joined(slim, classes, linked)


def _of_class(rows: DataFrame, other: DataFrame, how: str = "left") -> DataFrame:
    other = other.withColumnRenamed("k1", "o1").withColumnRenamed("k2", "o2")
    return rows.join(other, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), how).drop("o1", "o2")


def join(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component (smallest id reachable by links, itself included): a row per row of docs."""
    found = _join(docs, p or Params(), id_col, text_col)
    each = _of_class(found.classes.select("k1", "k2", "rep"), found.linked.select("k1", "k2", "component")).select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    out = _of_class(found.documents, each)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def near_copies(texts: DataFrame) -> DataFrame:
    """(t1, class) of (t1, text): the smallest t1 that links reach."""
    return join(texts, None, "t1").select("t1", F.col("component_id").alias("class"))


def keep_one(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of the rows with the id that names it, the one with the smallest text hash.

    Rows are judged by id and text, so rows of one id with texts of different components are kept as such. Texts without
    words and rows without id stay. Rows pass by without a shuffle, but for those to drop and those that occur twice."""
    found = _join(docs, p or Params(), id_col, text_col)
    scratch = Scratch(docs.sparkSession)
    each = _of_class(found.classes.select("k1", "k2", "rep"), found.linked)
    each = each.select("k1", "k2", "rep", F.coalesce("named1", "k1").alias("named1"), F.coalesce("named2", "k2").alias("named2"))
    rows = _of_class(found.documents.filter("n > 0 AND id IS NOT NULL"), each)
    names = (F.col("k1") == F.col("named1")) & (F.col("k2") == F.col("named2")) & (F.col("id") == F.col("rep"))
    kept = rows.filter(names).groupBy("k1", "k2").agg(F.min(F.struct("t1", "t2")).alias("t"))
    kept = kept.select("k1", "k2", F.col("t.t1").alias("x1"), F.col("t.t2").alias("x2"))
    text = rows.groupBy("id", "t1", "t2", "k1", "k2").agg(F.count("*").alias("times"), F.max(names).alias("names"))
    text = _of_class(text, kept).withColumn("stays", F.col("names") & (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2")))
    moved = scratch.keep(text.filter("NOT stays OR times > 1").select(F.col("id").alias("mi"), F.col("t1").alias("m1"), F.col("t2").alias("m2"), "stays"), "moved")
    bits = docs.sparkSession.sparkContext.broadcast(Bitmap(moved.select(F.xxhash64("mi").bitwiseXOR(F.col("m1")).alias("key")), "key"))
    yes, no, t1, t2 = split_rows(docs, text_col, bits, id_col)
    mi, m1, m2, stays = (fresh(yes, x) for x in ("gl_mi", "gl_m1", "gl_m2", "gl_stays"))
    moved = moved.toDF(mi, m1, m2, stays)
    yes = yes.join(moved, (F.col(id_col) == F.col(mi)) & (F.col(t1) == F.col(m1)) & (F.col(t2) == F.col(m2)), "left").filter(F.coalesce(F.col(stays), F.lit(True)))
    once = yes.filter(F.col(stays)).dropDuplicates([id_col, t1, t2])
    return no.unionByName(yes.filter(F.col(stays).isNull()).unionByName(once).select(*docs.columns))
