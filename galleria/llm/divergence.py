"""Source divergence audit: how far each source's words are from those of the other sources and of its language.

Sort-based streaming. Map tasks count the terms of their documents; the partial counts are dealt by (lang, term) and sorted by
(lang, term, source, part), where a part is a run of documents of one map task. A scan of the runs adds up document frequency
and counts and keeps the terms in enough documents. A second scan over the kept runs emits, run by run, the partial
divergences of pairs of sources and the best terms of each source; sums and ranks over these are Spark's.

All arithmetic is in integers: a smoothed share is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), divided in three steps of
three digits so that no product passes 64 bits below 9 * 10^15 words, and f = floor((p - q)^2 / (p + q)).

Scale: each text is read once. Partial counts are combined in a map task before the shuffle, so a very frequent term has at
most a row per task and source. Runs stream through the scans: what a task holds is one run's row per source. Between two
sources all terms that neither has give the same f, so a run is worth its own sources times all sources, not all pairs. The
table of (lang, source) groups goes to the driver and the tasks; the result has a row for each ordered pair of its groups, so
it is about the square root of the result. In a task, the sums of a language of up to 2,048 sources are one matrix; of more
sources, each chunk of runs sends its own.

Defined results: null text, lang and source count as ''. Every row is a document, repeated ids and rows too. Terms of any
length and texts of any length are whole (a text is one block of the kernel, some 40 bytes of memory a byte). Ties in value go
by the item's UTF-8 bytes. A language without kept terms has its pairs with value 0 and no terms; one with a single source has
no pairs. An empty table gives no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleria.session import Scratch

from . import kernels as K
from .common import map_sorted
from .vocabulary import coded, gathered

#: Letters, and bytes beyond ASCII, after lower-casing A-Z.
LETTERS = K.byte_class(bytes([*range(0x61, 0x7B), *range(0x80, 0x100)]))
#: Bytes of text that are counted at once; partial rows a map task holds; matrix cells of a chunk of runs; sources of a matrix.
BLOCK, HELD, CELLS, MATRIX = 4 << 20, 600_000, 1 << 21, 2048


@dataclass(frozen=True)
class Params:
    min_docs: int = 10
    top_terms: int = 10
    unit: int = 1_000_000_000
    text_col: str = "text"
    lang_col: str = "lang"
    source_col: str = "source"


class Counts:
    """(group, term) -> documents and occurrences of a map task; it lets all go when it holds too many different ones."""

    def __init__(self):
        self.parts: list[pa.Table] = []
        self.rows = self.merged = 0

    def add(self, t: pa.Table) -> Iterator[pa.Table]:
        self.parts.append(t)
        self.rows += t.num_rows
        if self.rows > self.merged + HELD:
            one = self.merge()
            if one.num_rows > HELD:
                yield from self.flush()

    def merge(self) -> pa.Table:
        one = pa.concat_tables(self.parts)
        if len(self.parts) > 1:
            one = one.group_by(["lang", "source", "term"]).aggregate([("docs", "sum"), ("n", "sum")]).rename_columns(["lang", "source", "term", "docs", "n"])
        self.parts, self.rows, self.merged = [one], one.num_rows, one.num_rows
        return one

    def flush(self) -> Iterator[pa.Table]:
        if self.parts:
            yield self.merge()
        self.parts, self.rows, self.merged = [], 0, 0


def block_counts(buf: np.ndarray, offs: np.ndarray, group: np.ndarray, langs: pa.Array, sources: pa.Array) -> pa.Table:
    """Of a block of texts: documents and occurrences by group and term; a row of the term '' for the documents of a group."""
    w = K.Words(K.LOWER[buf], offs, LETTERS)
    codes, words = coded(w)
    m = max(1, len(words))
    pair, n = np.unique(w.doc() * m + codes, return_counts=True)
    doc, code = np.divmod(pair, m)
    key = group[doc] * np.int64(m) + code
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    g, c = np.divmod(key[at], m)
    groups, docs = np.unique(group, return_counts=True)
    every = pa.array(np.r_[groups, g])
    term = pa.concat_arrays([pa.array([b""] * len(groups), pa.large_binary()), words.take(pa.array(c))])
    sums = np.add.reduceat(n, at) if len(at) else n
    return pa.table(
        {
            "lang": langs.take(every), "source": sources.take(every), "term": term.cast(pa.large_string()),
            "docs": np.r_[docs, np.diff(np.r_[at, len(key)])].astype(np.int64), "n": np.r_[np.zeros(len(groups), np.int64), sums.astype(np.int64)],
        }
    )


def partial_counts(docs: DataFrame, p: Params) -> DataFrame:
    """lang, source, term, part, docs, n: what map tasks have counted; part numbers the runs of documents."""
    rows = docs.select(F.col(p.text_col).cast("string"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (p.lang_col, p.source_col)], F.spark_partition_id().cast("long"))

    def make():
        def run(batches):
            held, part = Counts(), 0

            def out(tables):
                nonlocal part
                for t in tables:
                    for piece in t.combine_chunks().to_batches(1 << 16):
                        yield [*[piece.column(k) for k in (0, 1, 2)], np.full(piece.num_rows, part), piece.column(3), piece.column(4)]
                    part += 1

            for batch in batches:
                part = max(part, int(batch.column(3)[0].as_py()) << 32) if batch.num_rows else part
                lang, source = (pc.dictionary_encode(c) for c in batch.columns[1:3])
                both = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
                kinds, group = np.unique(both, return_inverse=True)
                a, b = np.divmod(kinds, max(1, len(source.dictionary)))
                langs, sources = lang.dictionary.take(pa.array(a)).cast(pa.large_string()), source.dictionary.take(pa.array(b)).cast(pa.large_string())
                buf, offs = K.text_buffers(batch.column(0))
                for i, j, block, o in K.blocks(buf, offs, BLOCK):
                    yield from out(held.add(block_counts(block, o, group[i:j], langs, sources)))
            yield from out(held.flush())

        return run

    return map_sorted(rows, make, "lang string, source string, term string, part long, docs long, n long")


def breaks(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before it in one of the columns."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False) if n > 1 else False
    return out


def kept_runs(partial: DataFrame, p: Params) -> DataFrame:
    """A row per lang and term that enough documents hold: n, and each source with its count. The term '' lists all sources."""
    dealt = partial.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "part")

    def make():
        def finish(t: pa.Table):
            """Rows of whole runs, one per source."""
            lang, term, source, docs, n = (t.column(c).combine_chunks() for c in ("lang", "term", "source", "docs", "n"))
            at = np.flatnonzero(breaks(lang, term))
            size = np.diff(np.r_[at, t.num_rows])
            df, total = np.add.reduceat(docs.to_numpy(), at), np.add.reduceat(n.to_numpy(), at)
            none = pc.equal(term, "").to_numpy(zero_copy_only=False)[at]
            keep = none | (df >= p.min_docs)
            if keep.any():
                rows = np.repeat(keep, size)
                offs = pa.array(np.r_[0, np.cumsum(size[keep])].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offs, x.filter(pa.array(rows))) for x in (source.cast(pa.string()), n)]
                pick = pa.array(at[keep])
                yield [lang.take(pick), term.take(pick), total[keep], *lists]

        def run(batches):
            held = None
            for t in gathered(batches):
                t = t.select(["lang", "term", "source", "docs", "n"])
                t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
                at = np.flatnonzero(breaks(*[t.column(c).combine_chunks() for c in ("lang", "term", "source")]))
                sums = {c: np.add.reduceat(t.column(c).to_numpy(), at) for c in ("docs", "n")}
                t = t.take(pa.array(at)).set_column(3, "docs", pa.array(sums["docs"])).set_column(4, "n", pa.array(sums["n"])).combine_chunks()
                last = int(np.flatnonzero(breaks(t.column("lang").combine_chunks(), t.column("term").combine_chunks()))[-1])
                held = t.slice(last)
                if last:
                    yield from finish(t.slice(0, last))
            if held is not None:
                yield from finish(held)

        return run

    return map_sorted(dealt.select("lang", "term", "source", "docs", "n"), make, "lang string, term string, n long, sources array<string>, counts array<long>")


def share(count: np.ndarray, total: np.ndarray, unit: int) -> np.ndarray:
    """1 + floor(unit * count / total) for count <= total, in steps of three digits of the quotient."""
    rest, out = count.astype(np.int64), np.zeros(np.broadcast(count, total).shape, np.int64)
    while unit > 1:
        step = min(1000, unit)
        rest = rest * step
        out = out * step + rest // total
        rest, unit = rest % total, unit // step
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


@dataclass
class Lang:
    """Of a language: its sources in order, their words in kept terms, the language's, and the number of kept terms."""

    sources: list[str]
    words: np.ndarray
    total: int
    terms: int


def pair_sums(src: np.ndarray, run: np.ndarray, p: np.ndarray, zero: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(sources, own, other): for entries (source, run, p) in order of runs, what the runs add to f of the present sources
    (rows) and each source (columns), beyond what two absent sources give; other: only where the second is absent, for the
    pair the other way round."""
    step = max(1, CELLS // len(zero))
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    for k in range(0, len(starts), step):
        a, b = starts[k], starts[k + step] if k + step < len(starts) else len(run)
        at = np.searchsorted(run[starts[k : k + step]], run[a:b])
        table = np.repeat(zero[None, :], min(step, len(starts) - k), 0)
        there = np.zeros(table.shape, bool)
        table[at, src[a:b]], there[at, src[a:b]] = p[a:b], True
        for i in range(a, b, step):
            s, r = src[i : min(b, i + step)], at[i - a : i - a + step]
            order = np.argsort(s, kind="stable")
            s, r = s[order], r[order]
            delta = distance(p[i : i + len(s)][order][:, None], table[r]) - distance(zero[s][:, None], zero[None, :])
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            yield s[first], np.add.reduceat(delta, first, axis=0), np.add.reduceat(np.where(there[r], 0, delta), first, axis=0)


def divergences(runs: DataFrame, langs: dict[str, Lang], p: Params) -> DataFrame:
    """Partial rows (lang, source, item, part, value) of the kept runs: sums of f by pair of sources, and each source's best terms."""
    known = runs.sparkSession.sparkContext.broadcast(langs)
    fields = "lang string, source string, part string, item string, value long"

    def make():
        state = known.value

        def pairs(name: str, rows: np.ndarray, m: np.ndarray, turn: bool = False):
            s = pa.array(state[name].sources, pa.string())
            a, b = np.nonzero(m)
            if len(a):
                one, two = s.take(pa.array(rows[a])), s.take(pa.array(b))
                yield [[name] * len(a), *((two, ["pair"] * len(a), one) if turn else (one, ["pair"] * len(a), two)), m[a, b]]

        def best(name: str, terms: pa.Array, src, run, f):
            order = np.lexsort((run, -f, src))
            s = src[order]
            first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
            nth = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
            pick = order[nth < p.top_terms]
            yield [[name] * len(pick), pa.array(state[name].sources, pa.string()).take(pa.array(src[pick])), ["term"] * len(pick), terms.take(pa.array(run[pick])), f[pick]]

        def run(batches):
            sums: dict[str, np.ndarray] = {}
            for t in gathered(batches, 1 << 14):
                for name in pc.unique(t.column("lang")).to_pylist():
                    lang = state[name]
                    rows = t.filter(pc.equal(t.column("lang"), name)).combine_chunks()
                    lists = rows.column("sources").combine_chunks()
                    at = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
                    src = pc.index_in(lists.flatten(), pa.array(lang.sources, pa.string())).to_numpy().astype(np.int64)
                    count = rows.column("counts").combine_chunks().flatten().to_numpy()
                    held = count > 0
                    at, src, count = at[held], src[held], count[held]
                    mine = share(count + 2, lang.words[src] + 2 * lang.terms, p.unit)
                    q = share(rows.column("n").to_numpy() + 2, np.int64(lang.total + 2 * lang.terms), p.unit)[at]
                    over = mine > q
                    if over.any():
                        yield from best(name, rows.column("term").combine_chunks(), src[over], at[over], distance(mine[over], q[over]))
                    zero, size = share(np.full(len(lang.sources), 2), lang.words + 2 * lang.terms, p.unit), len(lang.sources)
                    for who, own, other in pair_sums(src, at, mine, zero) if len(at) else ():
                        if size > MATRIX:
                            yield from pairs(name, who, own)
                            yield from pairs(name, who, other, True)
                        else:
                            m = sums.setdefault(name, np.zeros((size, size), np.int64))
                            m[who] += own
                            m[:, who] += other.T
            for name, m in sums.items():
                yield from pairs(name, np.arange(len(m)), m)

        return run

    return map_sorted(runs, make, fields)


def group_table(runs: DataFrame) -> tuple[DataFrame, dict[str, Lang]]:
    """(lang, source, words, terms) of every group, and the same for the tasks."""
    each = runs.select("lang", "term", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    groups = each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("words"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("total"), F.count(F.when(F.col("term") != "", 1)).alias("terms"))
    out: dict[str, Lang] = {}
    for r in groups.join(langs, "lang").orderBy("lang", "source").toLocalIterator():
        lang = out.setdefault(r["lang"], Lang([], [], r["total"], r["terms"]))
        lang.sources.append(r["source"])
        lang.words.append(r["words"])
    for lang in out.values():
        lang.words = np.array(lang.words, np.int64)
    return groups.join(langs.select("lang", "terms"), "lang"), out


def audit(docs: DataFrame, p: Params | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its divergence from the other sources (part pair) and the terms
    that it has more of than its language (part term)."""
    p = p or Params()
    scratch = Scratch(docs.sparkSession)
    runs = scratch.keep(kept_runs(partial_counts(docs, p), p), "kept-runs")
    groups, langs = group_table(runs)
    groups = scratch.keep(groups, "groups")
    found = scratch.keep(divergences(runs.filter(F.col("term") != ""), langs, p), "partial-divergences")
    scratch.drop(runs)

    zero = F.when(F.col("terms") > 0, F.expr(f"{2 * p.unit}L div (words + 2 * terms)") + 1).otherwise(1)
    one = groups.select("lang", "source", "terms", zero.alias("z"))
    two = groups.select("lang", F.col("source").alias("item"), zero.alias("z2"))
    base = one.join(two, "lang").filter(F.col("source") != F.col("item"))
    base = base.select("lang", "source", "item", F.expr("terms * (((z - z2) * (z - z2)) div (z + z2))").alias("value"))
    more = found.filter("part = 'pair' AND source <> item").select("lang", "source", "item", "value")
    pairs = base.unionByName(more).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = found.filter("part = 'term'").select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms.filter(F.col("rank") <= p.top_terms))
