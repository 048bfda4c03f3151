"""Suffix-array dedup: remove every unit covered by a string of `length` units that also starts anywhere else.

Units are bytes, or words (`words=True`): runs of other than ASCII white space, as 64-bit hashes. In what follows bytes are
named.

1. Anchors. In each run of `length` bytes one `gram`-byte gram has the smallest hash (the leftmost of equals): its anchor.
   Equal runs have equal anchors at equal offsets, so a run can repeat only where its anchor's hash does. A text has about
   one anchor every (length - gram) / 2 bytes. An anchor's context is all bytes that its runs may reach.
2. Contexts that occur as a whole at least twice (exact copies, inner parts of shared passages) need no comparing: each of
   their runs repeats. They are aggregated by a 128-bit hash, map-side first, so thousands of copies are one row.
3. Anchors with at least two different contexts: one representative of each context is fetched and the contexts of whole
   anchor groups are put together in blocks of bounded size. Contexts are cut, from their anchor on, into aligned symbols
   of `symbol` bytes; the suffix array (see suffix_array.py) of a block's symbols and its common-prefix array show which
   symbol runs long enough for a `length`-byte run are repeated. Around those, at each byte offset, runs are compared by
   their 128-bit hashes, which decides.
4. Anchors with more than `max_contexts` different contexts (a passage in a great share of all documents) would not fit a
   block. Their runs are counted by 128-bit hashes in distributed aggregations, which is exact as well: bands of
   neighbouring runs first, and single runs where contexts of a band differ.
5. Spans return to the texts that hold the contexts, are merged and cut out.

Scale: nothing here is grouped by document, source or text in one task; anchors whose hash is seen once are dropped by a
bitmap of fixed size before any join; texts are shuffled only where they hold a repeated anchor. Repeated anchors of many
different contexts and copies are aggregated before shuffles.

Defined results: null text = empty; texts shorter than `length` are kept whole; repeated rows are copies of each other and
lose every byte if long enough; null ids are allowed; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.session import Scratch

from . import kernels as K
from .common import Bitmap, fresh, map_arrow, map_sorted, split_rows, text_hashes
from .suffix_array import lcp_array, suffix_array


@dataclass(frozen=True)
class Params:
    length: int = 400
    gram: int = 50
    symbol: int = 80
    max_contexts: int = 500  #: of one anchor in a block
    block_contexts: int = 1000  #: in a block, but for the last anchor's
    band: int = 50  #: neighbouring run starts that are counted together
    words: bool = False  #: units are words

    @property
    def reach(self) -> int:
        """Grams in a run, less one: how far before its anchor a run may start."""
        return self.length - self.gram


#: Runs of 51 words and more: passages of over 50 words.
PASSAGES = Params(length=51, gram=8, symbol=10, band=7, words=True)


def units(buf: np.ndarray, offs: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(units of a block of texts, where each text's begin)."""
    if not p.words:
        return buf, offs
    w = K.Words(buf, offs, K.NOT_SPACE)
    return w.hashes(), w.first


def body_units(col: pa.Array, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(units of a column of contexts, where each begins)."""
    buf, offs = K.text_buffers(col)
    return (np.frombuffer(buf.tobytes(), np.uint64), offs // 8) if p.words else (buf, offs)


def anchors(roll: K.Rolling, offs: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the block, gram hashes) of every run's anchor, ascending."""
    g = roll.plain_grams(p.gram)
    w = p.reach + 1
    n = len(g)
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    bits = max(1, int(n - 1).bit_length())
    key = (g >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    pad = -n % w
    full = np.concatenate([key, np.full(pad, K.M64, np.uint64)]).reshape(-1, w)
    fwd = np.minimum.accumulate(full, axis=1).ravel()
    bwd = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(bwd[: n - w + 1], fwd[w - 1 : n])
    inside = np.zeros(n + p.gram + 1, np.int32)  # runs that lie in one text
    lo, hi = offs[:-1], offs[1:] - p.length + 1
    ok = hi > lo
    np.add.at(inside, lo[ok], 1)
    np.add.at(inside, hi[ok], -1)
    valid = np.cumsum(inside)[: len(least)] > 0
    at = (least[valid] & np.uint64((1 << bits) - 1)).astype(np.int64)  # ascending, as the runs are
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    return at, K.mix(g[at])


def _anchor_lists(p: Params):
    """Of each text: its hash and the hashes of its anchors."""

    def make():
        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(0))
            for _, _, b, bo in K.blocks(buf, offs):
                u, o = units(b, bo, p)
                at, h = anchors(K.Rolling(u, (0,)), o, p)
                yield [*text_hashes(b, bo), K.list_column(K.signed(h), np.diff(np.searchsorted(at, o)), pa.int64())]

        return fn

    return make, "t1 long, t2 long, ahs array<long>"


def _scan(p: Params, asked=None):
    """Anchors of each text (hash of its id, text) with the hashes of their contexts; asked: only those whose hash may be in a bitmap."""

    def make():
        bits = asked.value if asked else None

        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            for i, j, b, bo in K.blocks(buf, offs):
                u, o = units(b, bo, p)
                roll = K.Rolling(u)
                at, h = anchors(roll, o, p)
                if bits is not None:
                    pick = bits.may_hold(h)
                    at, h = at[pick], h[pick]
                if not len(at):
                    continue
                doc = np.searchsorted(o, at, "right") - 1
                lo, hi = np.maximum(o[doc], at - p.reach), np.minimum(o[doc + 1], at + p.length)
                t1, t2 = text_hashes(b, bo)
                yield [
                    batch.column(0).slice(i, j - i).take(pa.array(doc)), t1[doc], t2[doc], at - o[doc], h,
                    roll.ranges(lo, hi, 0) ^ (at - lo).astype(np.uint64), roll.ranges(lo, hi, 1), (at - lo).astype(np.int32), (hi - at).astype(np.int32),
                ]

        return fn

    return make, "who long, t1 long, t2 long, pos long, ah long, c1 long, c2 long, l int, r int"


def _keep_rows(bitmap, column: int, once: bool = False):
    """Rows whose key may be in a broadcast bitmap; once: equal rows of a batch once."""

    def make():
        bits = bitmap.value

        def fn(batch: pa.RecordBatch):
            rows = batch.filter(pa.array(bits.may_hold(batch.column(column).to_numpy())))
            if once:
                rows = pa.Table.from_batches([rows]).group_by(rows.schema.names).aggregate([]).combine_chunks()
                rows = rows.to_batches()[0] if rows.num_rows else batch.slice(0, 0)
            if rows.num_rows:
                yield rows.columns

        return fn

    return make


def _contexts(p: Params):
    """Units of the wanted contexts of a text: (ah, c1, c2, n, l, units, m) from rows (text, list of wanted)."""

    def make():
        def fn(batch: pa.RecordBatch):
            wanted = batch.column(1)
            buf, offs = K.text_buffers(batch.column(0))
            for i, j, b, bo in K.blocks(buf, offs):
                u, o = units(b, bo, p)
                part = wanted.slice(i, j - i)
                x, per = part.flatten(), np.diff(part.offsets.to_numpy())
                row = np.repeat(np.arange(j - i), per)
                at = o[row] + x.field("pos").to_numpy()
                lo, hi = np.maximum(o[row], at - p.reach), np.minimum(o[row + 1], at + p.length)
                bodies = [u[a:c].tobytes() for a, c in zip(lo.tolist(), hi.tolist(), strict=True)]
                yield [*(x.field(c) for c in ("ah", "c1", "c2", "n", "l")), pa.array(bodies, pa.binary()), x.field("m")]

        return fn

    return make, "ah long, c1 long, c2 long, n long, l int, body binary, m long"


def repeated_starts(bodies: list[bytes], lefts: list[int] | np.ndarray, groups: list[int], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(context, start) of every `length`-byte run that two contexts of one group hold at the same place from their anchor.

    A run in a text lies in the contexts of several anchors; counted within its anchor's group it is met once."""
    q = p.symbol
    buf = np.frombuffer(b"".join(bodies), np.uint64 if p.words else np.uint8)
    size = np.array([len(x) for x in bodies], np.int64) // buf.itemsize
    base = np.cumsum(size) - size
    left = np.array(lefts, np.int64)
    before, after = left // q, (size - left) // q
    n_sym = before + after
    ctx = np.repeat(np.arange(len(bodies)), n_sym)
    k = np.arange(len(ctx)) - np.repeat(np.cumsum(n_sym) - n_sym, n_sym)
    at = base[ctx] + left[ctx] + (k - before[ctx]) * q
    roll = K.Rolling(buf)
    _, sym = np.unique(roll.ranges(at, at + q), return_inverse=True)
    # Symbols of a context are followed by a separator of its own; 0 ends the string.
    m = len(bodies)
    string = np.zeros(len(ctx) + m + 1, np.int64)
    place = np.arange(len(ctx)) + ctx
    string[place] = sym + m + 1
    string[np.cumsum(n_sym) + np.arange(m)] = 1 + np.arange(m)
    text = string.tolist()
    sa = suffix_array(text)
    lcp = np.array(lcp_array(text, sa))
    need = (p.length - q + 1) // q
    run = lcp >= need
    member = run.copy()
    member[:-1] |= run[1:]
    back = np.full(len(string), -1, np.int64)
    back[place] = np.arange(len(ctx))
    cand = back[np.array(sa)[member]]
    cand = cand[cand >= 0]
    if not len(cand):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = (at[cand][:, None] - np.arange(q)).ravel()
    c = np.repeat(ctx[cand], q)
    ok = (s >= base[c]) & (s + p.length <= base[c] + size[c])
    s, c = s[ok], c[ok]
    rel = s - base[c] - left[c]
    h1 = roll.ranges(s, s + p.length, 0) ^ K.mix(np.array(groups, np.int64).view(np.uint64)[c] + rel.astype(np.uint64))
    h2 = roll.ranges(s, s + p.length, 1)
    order = np.argsort(h1)  # runs of equal h1 and unlike h2 would have to lie mixed for a miss: 64 bits, and no wrong match
    same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    hit = np.zeros(len(s), bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return c[hit], s[hit] - base[c[hit]]


def _covers(ctx: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, end) of the spans of runs, neighbouring starts together, by context."""
    if not len(ctx):
        return ctx, start, start
    order = np.lexsort((start, ctx))
    c, s = ctx[order], start[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (s[1:] > s[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(c)) - 1
    return c[at], s[at], s[last] + length


_SPANS = "ah long, c1 long, c2 long, spans array<struct<lo:int,hi:int>>"


def _by_suffix_array(p: Params):
    """From rows (ah, c1, c2, n, l, body) sorted by ah: spans of the contexts that occur once."""

    def make():
        rows: list[tuple] = []

        def solve(part: list[tuple]):
            lefts = np.array([x[4] for x in part], np.int64)
            ctx, start = repeated_starts([x[5] for x in part], lefts, [x[0] for x in part], p)
            asked = np.array([x[3] == 1 for x in part])[ctx]
            c, lo, hi = _covers(ctx[asked], start[asked] - lefts[ctx[asked]], p.length)
            if not len(c):
                return None
            which, per = np.unique(c, return_counts=True)
            both = pa.StructArray.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["lo", "hi"])
            ends = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
            return [[part[i][k] for i in which.tolist()] for k in range(3)] + [pa.ListArray.from_arrays(ends, both)]

        def run(batches):
            for batch in batches:
                cols = [c.to_pylist() for c in batch.columns]
                for row in zip(*cols, strict=True):
                    if len(rows) >= p.block_contexts and row[0] != rows[-1][0]:
                        got = solve(rows)
                        rows.clear()
                        if got:
                            yield got
                    rows.append(row)
            if rows:
                got = solve(rows)
                rows.clear()
                if got:
                    yield got

        return run

    return make


def _bands(o: np.ndarray, left: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, band, first and last distance from run start to anchor) of each band of runs that a context has."""
    right = np.diff(o) - left
    n = p.reach // p.band + 1
    ctx, band = np.repeat(np.arange(len(left)), n), np.tile(np.arange(n), len(left))
    first = np.maximum(band * p.band, p.length - right[ctx])
    last = np.minimum(np.minimum(band * p.band + p.band - 1, p.reach), left[ctx])
    ok = first <= last
    return ctx[ok], band[ok], first[ok], last[ok]


def _band_rows(p: Params):
    """Of each context and band: a hash of the bytes that all runs of the band have, and of all bytes that its runs reach."""

    def make():
        def fn(batch: pa.RecordBatch):
            u, offs = body_units(batch.column(5), p)
            left = batch.column(4).to_numpy().astype(np.int64)
            for i, j, b, o in K.blocks(u, offs, K.BLOCK // u.itemsize):
                ctx, band, first, last = _bands(o, left[i:j], p)
                roll = K.Rolling(b)
                anchor = o[ctx] + left[i:j][ctx]
                lo, hi = anchor - band * p.band, anchor - np.minimum(band * p.band + p.band - 1, p.reach) + p.length
                flo, fhi = anchor - last, anchor - first + p.length
                shape = K.mix((first * 4096 + last).astype(np.uint64))
                rows, take = batch.slice(i, j - i), pa.array(ctx)
                yield [rows.column(0).take(take), band.astype(np.int32), roll.ranges(lo, hi, 0), roll.ranges(lo, hi, 1)] + [
                    roll.ranges(flo, fhi, 0) ^ shape, roll.ranges(flo, fhi, 1), rows.column(1).take(take), rows.column(2).take(take), rows.column(3).take(take),
                    (-last).astype(np.int32), (p.length - first).astype(np.int32),
                ]

        return fn

    return make, "ah long, band int, k1 long, k2 long, f1 long, f2 long, c1 long, c2 long, n long, lo int, hi int"


def _runs(p: Params):
    """Every run of the wanted bands of a context: (ah, c1, c2, n, lo, w1, w2), n being the band's occurrences."""

    def make():
        def fn(batch: pa.RecordBatch):
            u, offs = body_units(batch.column(5), p)
            left, wanted = batch.column(4).to_numpy().astype(np.int64), [dict(x) for x in batch.column(6).to_pylist()]
            for i, j, b, o in K.blocks(u, offs, K.BLOCK // u.itemsize):
                ctx, band, first, last = _bands(o, left[i:j], p)
                times = np.array([wanted[i + c].get(k, 0) for c, k in zip(ctx.tolist(), band.tolist(), strict=True)], np.int64)
                ok = times > 0
                ctx, first, last, times = ctx[ok], first[ok], last[ok], times[ok]
                per = last - first + 1
                row = np.repeat(np.arange(len(ctx)), per)
                dist = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
                c = ctx[row]
                s = o[c] + left[i:j][c] - dist
                roll = K.Rolling(b)
                rows, take = batch.slice(i, j - i), pa.array(c)
                yield [rows.column(k).take(take) for k in range(3)] + [
                    times[row], (-dist).astype(np.int32), roll.ranges(s, s + p.length, 0), roll.ranges(s, s + p.length, 1)
                ]

        return fn

    return make, "ah long, c1 long, c2 long, n long, lo int, w1 long, w2 long"


def by_counting(contexts: DataFrame, p: Params, scratch: Scratch) -> DataFrame:
    """(ah, c1, c2, spans) of contexts that occur once, by counts of runs. contexts: ah, c1, c2, n, l, body.

    Runs are taken in bands of neighbouring starts. Contexts that agree in all bytes that a band reaches are one row, which
    settles the inside of a passage; single runs are counted only of bands whose common bytes differ around them."""
    bands = scratch.keep(map_arrow(contexts, *_band_rows(p)), "bands")
    full = bands.groupBy("ah", "band", "k1", "k2", "f1", "f2").agg(F.sum("n").alias("n"), F.min(F.struct("c1", "c2")).alias("rep"))
    full = scratch.keep(full, "bands")
    keys = full.groupBy("ah", "band", "k1", "k2").agg(F.count("*").alias("d")).filter("d > 1").toDF("kah", "kband", "kk1", "kk2", "d")
    on = (F.col("ah") == F.col("kah")) & (F.col("band") == F.col("kband")) & (F.col("k1") == F.col("kk1")) & (F.col("k2") == F.col("kk2"))
    differ = full.join(keys, on, "left_semi").groupBy("ah", "rep").agg(F.map_from_entries(F.collect_list(F.struct("band", "n"))).alias("bands"))
    differ = differ.select(F.col("ah").alias("rah"), F.col("rep.c1").alias("r1"), F.col("rep.c2").alias("r2"), "bands")
    look = contexts.join(differ, (F.col("ah") == F.col("rah")) & (F.col("c1") == F.col("r1")) & (F.col("c2") == F.col("r2"))).drop("rah", "r1", "r2")
    runs = map_arrow(look, *_runs(p))
    same = runs.groupBy("ah", "lo", "w1", "w2").agg(F.sum("n").alias("k")).filter("k > 1").toDF("vah", "vlo", "v1", "v2", "k")
    on = (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")) & (F.col("ah") == F.col("vah")) & (F.col("lo") == F.col("vlo"))
    single = runs.filter("n = 1").join(same, on, "left_semi").select("ah", "c1", "c2", "lo", (F.col("lo") + p.length).alias("hi"))
    often = full.filter("n > 1").select(F.col("ah").alias("wah"), F.col("band").alias("wband"), F.col("f1").alias("w1"), F.col("f2").alias("w2"))
    on = (F.col("ah") == F.col("wah")) & (F.col("band") == F.col("wband")) & (F.col("f1") == F.col("w1")) & (F.col("f2") == F.col("w2"))
    whole = bands.filter("n = 1").join(often, on, "left_semi").select("ah", "c1", "c2", "lo", "hi")
    return single.unionByName(whole).groupBy("ah", "c1", "c2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _fetched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(text, wanted) of the texts (who, text) that wanted (who, t1, t2, wanted) names; of repeated rows, one."""
    keys = wanted.select(F.col("t1").bitwiseXOR(F.xxhash64("who")).alias("key"))
    texts, _, t1, t2 = split_rows(rows, "text", rows.sparkSession.sparkContext.broadcast(Bitmap(keys, "key")), "who")
    texts = texts.withColumnsRenamed({t1: "t1", t2: "t2"})
    return texts.join(wanted, ["who", "t1", "t2"]).dropDuplicates(["who", "t1", "t2"]).select("text", "wanted")


def spans(docs: DataFrame, p: Params, scratch: Scratch, id_col: str, text_col: str, done: DataFrame | None = None) -> DataFrame:
    """(t1, t2, spans): by text hash, the spans to remove (not merged).

    done: (t1, t2) of texts that are not asked about; others are compared with them, but they may come without spans."""
    spark = docs.sparkSession
    # Of an id its hash will do: with the hash of the text it tells which of the copies is fetched, and any is as good.
    rows = docs.select(F.xxhash64(id_col).alias("who"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if done is None:
        seen = scratch.keep(map_arrow(rows, *_scan(p)), "anchors")
        repeated = seen.groupBy("ah").agg(F.count("*").alias("k")).filter("k > 1")
        bitmap = spark.sparkContext.broadcast(Bitmap(repeated, "ah", 1 << 26))
        some = scratch.keep(map_arrow(seen, _keep_rows(bitmap, seen.columns.index("ah")), seen.schema), "repeated")
    else:
        seen = scratch.keep(map_arrow(rows.select("text"), *_anchor_lists(p)), "anchors")
        asked = seen.join(done.select(F.col("t1").alias("d1"), F.col("t2").alias("d2")), (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2")), "left_anti")
        repeated = seen.select(F.explode("ahs").alias("ah")).groupBy("ah").agg(F.count("*").alias("k")).filter("k > 1")
        repeated = repeated.join(asked.select(F.explode("ahs").alias("ah")).distinct(), "ah", "left_semi")
        bitmap = spark.sparkContext.broadcast(Bitmap(repeated, "ah", 1 << 26))
        some = scratch.keep(map_arrow(rows, *_scan(p, bitmap)), "repeated")
    scratch.drop(seen)
    contexts = some.groupBy("ah", "c1", "c2").agg(
        F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("who", "t1", "t2", "pos", "l")]  # of one row
    )
    contexts = scratch.keep(contexts, "contexts")
    per_anchor = contexts.groupBy("ah").agg(F.count("*").alias("m")).filter("m > 1").withColumnRenamed("ah", "mah")
    mixed = contexts.join(per_anchor, F.col("ah") == F.col("mah")).drop("mah")

    # One text row fetches the representatives that lie in it, and its copies are not sent. Rows meet by plain keys, so they lie
    # where repeated rows are told apart, and texts are shuffled once.
    wanted = mixed.select("who", "t1", "t2", F.struct("ah", "c1", "c2", "n", "l", "pos", "m").alias("x"))
    wanted = wanted.groupBy("who", "t1", "t2").agg(F.collect_list("x").alias("wanted"))
    wanted = scratch.keep(wanted, "wanted")
    bodies = scratch.keep(map_arrow(_fetched(rows, wanted), *_contexts(p)), "bodies")
    scratch.drop(wanted)
    # One after the other, so that the shuffles of one are gone before those of the next.
    usual = bodies.filter(F.col("m") <= p.max_contexts).drop("m").repartition(F.col("ah")).sortWithinPartitions("ah", "c1", "c2")
    found = scratch.keep(map_sorted(usual, _by_suffix_array(p), _SPANS), "usual")
    hot = by_counting(bodies.filter(F.col("m") > p.max_contexts).drop("m"), p, scratch)
    whole = contexts.filter("n > 1").select("ah", "c1", "c2", F.lit(None).cast("array<struct<lo:int,hi:int>>").alias("spans"))
    marks = scratch.keep(found.unionByName(hot).unionByName(whole), "marked")
    scratch.drop(contexts, bodies, found)
    marked = marks.drop("ah").toDF("m1", "m2", "spans")

    # Of the places of repeated anchors only those go on whose context has spans. A context's hashes tell its anchor, and equal
    # places of copies meet at their context, where the set leaves one of them: no shuffle is needed to make them distinct.
    among = spark.sparkContext.broadcast(Bitmap(marks, "c1", 1 << 25))
    held = some.select("c1", "c2", "t1", "t2", "pos", "l", "r")
    held = map_arrow(held, _keep_rows(among, 0, True), held.schema)
    hits = held.join(marked, (F.col("c1") == F.col("m1")) & (F.col("c2") == F.col("m2")))
    all_of_it = F.array(F.struct((-F.col("l")).alias("lo"), F.col("r").alias("hi")))
    each = hits.select("t1", "t2", F.transform(F.coalesce("spans", all_of_it), lambda x: F.struct((F.col("pos") + x["lo"]).alias("lo"), (F.col("pos") + x["hi"]).alias("hi"))).alias("spans"))
    out = scratch.keep(each.groupBy("t1", "t2").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    scratch.drop(some, marks)
    return out


def merge(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, end) of each row's spans, put together where they meet or overlap. col: lists of (lo, hi), or nulls."""
    both = col.flatten()
    row = np.repeat(np.arange(len(col)), np.nan_to_num(pc.list_value_length(col).to_numpy(zero_copy_only=False)).astype(np.int64))
    lo, hi = (both.field(c).to_numpy().astype(np.int64) for c in ("lo", "hi"))
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    step = int(hi.max()) + 2  # rows one after the other, with a gap
    top = np.maximum.accumulate(hi + row * step)
    new = np.ones(len(row), bool)
    new[1:] = lo[1:] + row[1:] * step > top[:-1]
    at = np.flatnonzero(new)
    return row[at], lo[at], (top - row * step)[np.append(at[1:], len(row)) - 1]


def by_row(found: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int) -> list[list[tuple[int, int]]]:
    row, lo, hi = found
    ends = np.searchsorted(row, np.arange(rows + 1)).tolist()
    pairs = list(zip(lo.tolist(), hi.tolist(), strict=True))
    return [pairs[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def marked_rows(docs: DataFrame, found: DataFrame, text_col: str) -> DataFrame:
    """docs and found's columns after t1 and t2, by the hash of the text; only texts that may have any go through the join."""
    yes, no, t1, t2 = split_rows(docs, text_col, docs.sparkSession.sparkContext.broadcast(Bitmap(found, "t1")))
    own = [fresh(yes, f"gl_{c}") for c in found.columns]
    yes = yes.join(found.toDF(*own), (F.col(t1) == F.col(own[0])) & (F.col(t2) == F.col(own[1])), "left").select(*docs.columns, *own[2:])
    return yes.unionByName(no.withColumns({c: F.lit(None).cast(yes.schema[c].dataType) for c in own[2:]}))


def removed(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text", passages: Params | None = None) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, the removed spans, and repeats: a row per row of docs.

    Units are bytes. passages: units are words; repeats tells whether a text has bytes to remove or, if that is given, holds a
    repeated run of so many words."""
    p = p or Params()
    if p.words or passages and not passages.words:
        raise ValueError("removed() takes bytes away and looks for words")
    kind = docs.schema[id_col].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    found = spans(docs, p, scratch, id_col, text_col)
    if passages:
        more = spans(docs, passages, scratch, id_col, text_col, found).select("t1", "t2", F.lit(True).alias("runs"))
        found = scratch.keep(found.join(more, ["t1", "t2"], "full"), "found")
    else:
        found = found.withColumn("runs", F.lit(False))
    rows = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    bits = docs.sparkSession.sparkContext.broadcast(Bitmap(found, "t1"))
    yes, _, t1, t2 = split_rows(rows, text_col, bits)
    own = [fresh(yes, f"gl_{c}") for c in found.columns]
    yes = yes.join(found.toDF(*own), (F.col(t1) == F.col(own[0])) & (F.col(t2) == F.col(own[1])), "left").select(id_col, text_col, *own[2:])

    def report(ids: pa.Array, buf: np.ndarray, offs: np.ndarray, cut: tuple, runs: np.ndarray) -> list:
        data, o = memoryview(np.ascontiguousarray(buf)), offs.tolist()
        sha = []
        for k, spans_ in enumerate(by_row(cut, len(ids))):
            raw, last, h = data[o[k] : o[k + 1]], 0, hashlib.sha256()
            for a, b in spans_:
                h.update(raw[last:a])
                last = b
            h.update(raw[last:])
            sha.append(h.hexdigest())
        row, lo, hi = cut
        per = np.bincount(row, minlength=len(ids))
        gone = np.bincount(row, hi - lo, minlength=len(ids)).astype(np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32())
        kept = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], ["start", "end"]))
        return [ids, np.diff(offs), gone, per, sha, kept, runs | (gone > 0)]

    def marked():
        def fn(batch: pa.RecordBatch):
            yield report(batch.column(0), *K.text_buffers(batch.column(1)), merge(batch.column(2)), np.array(batch.column(3).fill_null(False)))

        return fn

    def others():
        known = bits.value
        none = (np.zeros(0, np.int64),) * 3

        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            rows = batch.filter(pa.array(~known.may_hold(text_hashes(buf, offs)[0])))
            if rows.num_rows:
                yield report(rows.column(0), *K.text_buffers(rows.column(1)), none, np.zeros(rows.num_rows, bool))

        return fn

    ddl = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,end:bigint>>, repeats boolean"
    return map_arrow(yes, marked, ddl).unionByName(map_arrow(rows, others, ddl))


def in_bytes(raw: bytes, found: list[tuple[int, int]], p: Params) -> list[tuple[int, int]]:
    if not p.words:
        return found
    w = K.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), K.NOT_SPACE)
    return [(int(w.starts[a]), int(w.ends[b - 1])) for a, b in found]


def clean(docs: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs without the repeated units; a character that a span cuts goes whole, and documents with nothing left go.

    The white space around a passage of words stays."""
    p = p or Params()
    at, n = docs.columns.index(text_col), len(docs.columns)

    def make():
        def fn(batch: pa.RecordBatch):
            texts, found = batch.column(at).to_pylist(), by_row(merge(batch.column(n)), batch.num_rows)
            out = []
            for t, s in zip(texts, found, strict=True):
                if s:
                    raw, parts, last = t.encode(), [], 0
                    for a, b in in_bytes(raw, s, p):
                        parts.append(raw[last:a].decode("utf-8", "ignore"))
                        last = b
                    t = "".join([*parts, raw[last:].decode("utf-8", "ignore")])
                    t = t if t.strip() else None
                out.append((t, bool(s)))
            keep = pa.array([t is not None or not cut for t, cut in out])
            cols = [batch.column(k) for k in range(n)]
            cols[at] = pa.array([t for t, _ in out], pa.string())
            yield [c.filter(keep) for c in cols]

        return fn

    out = map_arrow(marked_rows(docs, spans(docs, p, Scratch(docs.sparkSession), id_col, text_col), text_col), make, docs.schema)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
