"""Quality rules: per-document counts, and lines that too many documents of a host repeat.

Method: every line is normalised (ASCII lower case, digit runs as one 0, white space runs as one space) and hashed; for
each host (`source`) and line hash the distinct documents are counted; lines above the limit are removed, and a document
of which too little is left is rejected.

A document is a text: exact copies of a host count once. The plain rule counts near copies each, so a host with more than
`max_docs_per_host` different versions of one text loses them all. Where a later stage is to keep one of them, give judge() and
clean() `copies`, a function that names classes of near copies (ngram_join.near_copies); then each class counts once.

Scale: one Arrow pass over the texts writes a row per document (counts, line hashes) as a scratch table; lines are
aggregated map-side by (host, line, text) and then by (host, line), so that a line or host which a third of all rows
hold is a single partial row per task. Lines over the limit return by a sort-merge join which AQE may split. Only texts
that hold such a line are given to `copies`. clean() moves only texts that lose lines or go as a whole; all others pass by.

Defined results: null text = no words, failed base rules, not kept; null source is a host of its own; repeated rows get
equal verdicts; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galleria.session import Scratch

from . import kernels as K
from .common import Bitmap, fresh, map_arrow, split_rows, text_hashes

SYMBOLS = K.byte_class(b"#*$%&|<>")
CONTINUATION = (np.arange(256) & 0xC0) == 0x80
_DIGITS, _SPACE = re.compile(rb"[0-9]+"), re.compile(rb"[ \t\n\v\f\r]+")


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    max_docs_per_host: int = 20  #: distinct texts of one host that may hold a line
    min_left_percent: int = 20  #: words that must be left when flagged lines are gone


def _repeat_words(h: np.ndarray, first: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """Per text: words inside k-word windows that occur at least twice in it."""
    at, doc = K.gram_rows(first, counts, k)
    out = np.zeros(len(counts), np.int64)
    if not len(at):
        return out
    g = K.ngrams(h, k)[at]
    key = K.mix(g + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    hit = at[order[same]]
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, hit, 1)
    np.add.at(cover, hit + k, -1)
    covered = np.cumsum(cover[:-1]) > 0
    sums = np.concatenate([[0], np.cumsum(covered)])
    return sums[first[1:]] - sums[first[:-1]]


def _line_rows(data: bytes) -> tuple[list[int], list[int], int]:
    """(hash of each distinct normalised line, its words over all its places, duplicate lines of one text)."""
    seen: set[bytes] = set()
    norm: dict[bytes, int] = {}
    dup = 0
    for line in data.split(b"\n"):
        words = len(line.split())
        if not words:
            continue
        if line in seen:
            dup += 1
        else:
            seen.add(line)
        n = normal_line(line)
        norm[n] = norm.get(n, 0) + words
    return list(norm), list(norm.values()), dup


def normal_line(line: bytes) -> bytes:
    return _SPACE.sub(b" ", _DIGITS.sub(b"0", line.lower())).strip(b" ")


def line_hashes(lines: list[bytes]) -> np.ndarray:
    if not lines:
        return np.zeros(0, np.uint64)
    offs = np.zeros(len(lines) + 1, np.int64)
    np.cumsum([len(x) for x in lines], out=offs[1:])
    buf = np.frombuffer(b"".join(lines), np.uint8)
    return K.Rolling(buf, (0,)).ranges(offs[:-1], offs[1:])


def _scan(rules: Rules):
    def make():
        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(2))
            for i, j, b, o in K.blocks(buf, offs):
                w = K.Words(b, o, K.NOT_SPACE)
                zero = lambda m: np.concatenate([[0], np.cumsum(m)])
                sums = zero(w.mask & ~CONTINUATION[b])
                syms = zero(SYMBOLS[b])
                repeat = _repeat_words(w.hashes(), w.first, w.counts, rules.window)
                data = b.tobytes()
                names, words, per, dups = [], [], np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
                for d in range(j - i):
                    ln, lw, dups[d] = _line_rows(data[o[d] : o[d + 1]])
                    names += ln
                    words += lw
                    per[d] = len(ln)
                lines = line_hashes(names)
                t1, t2 = text_hashes(b, o)
                yield [
                    batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), t1, t2, w.counts,
                    sums[o[1:]] - sums[o[:-1]], syms[o[1:]] - syms[o[:-1]], dups, repeat,
                    K.list_column(K.signed(lines), per, pa.int64()), K.list_column(np.array(words, np.int64), per, pa.int64()),
                ]

        return fn

    return make


_SCAN = (
    "id {id}, host string, t1 long, t2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, line array<long>, line_words array<long>"
)


def scan(docs: DataFrame, rules: Rules, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: counts, text hash and the hashes of its distinct normalised lines."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, _scan(rules), _SCAN.format(id=kind))


def _lines(scanned: DataFrame, *columns: str) -> DataFrame:
    each = scanned.select("host", "t1", "t2", F.explode(F.arrays_zip(*columns)).alias("x"))
    return each.select("host", "t1", "t2", *[F.col(f"x.{c}").alias(c) for c in columns])


def _of_lines(rows: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    other = lines.withColumnRenamed("host", "fh").withColumnRenamed("line", "fl")
    return rows.join(other, (F.col("line") == F.col("fl")) & F.col("host").eqNullSafe(F.col("fh")), how).drop("fh", "fl")


#: Given (t1, text) of different texts: (t1, class), equal for near copies.
Copies = Callable[[DataFrame], DataFrame]


def common_lines(scanned: DataFrame, rules: Rules) -> DataFrame:
    """(host, line) of lines that more texts of a host hold than the limit allows."""
    texts = _lines(scanned, "line").groupBy("host", "line", "t1", "t2").agg(F.lit(1).alias("one"))
    return texts.groupBy("host", "line").agg(F.count("*").alias("texts")).filter(F.col("texts") > rules.max_docs_per_host).select("host", "line")


def common_to_classes(rows: DataFrame, held: DataFrame, copies: Copies, rules: Rules) -> DataFrame:
    """(host, line) of lines that texts of more classes hold than the limit allows. rows: text; held: (host, t1, line)."""
    some = rows.sparkSession.sparkContext.broadcast(Bitmap(held.select("t1").distinct(), "t1", 1 << 22))
    texts, _, t1, _ = split_rows(rows, "text", some)
    named = copies(texts.select(F.col(t1).alias("t1"), "text").dropDuplicates(["t1"])).toDF("ct", "class")
    each = held.select("host", "line", "t1").join(named, F.col("t1") == F.col("ct")).groupBy("host", "line", "class").agg(F.lit(1).alias("one"))
    return each.groupBy("host", "line").agg(F.count("*").alias("classes")).filter(F.col("classes") > rules.max_docs_per_host).select("host", "line")


def verdicts(scanned: DataFrame, rows: DataFrame, rules: Rules, copies: Copies | None, scratch: Scratch) -> DataFrame:
    """Per (host, text) that holds flagged lines: their hashes and their words."""
    common = scratch.keep(common_lines(scanned, rules), "common")
    held = _of_lines(_lines(scanned, "line", "line_words"), common, "inner").groupBy("host", "t1", "t2", "line").agg(F.max("line_words").alias("words"))
    if copies:
        held = scratch.keep(held, "held")
        held = _of_lines(held, scratch.keep(common_to_classes(rows, held, copies, rules), "flags"), "left_semi")
    return held.groupBy("host", "t1", "t2").agg(F.sum("words").alias("flagged_words"), F.collect_list("line").alias("flagged"))


def judge(docs: DataFrame, rules: Rules | None = None, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", copies: Copies | None = None) -> DataFrame:
    """id, host, text hash, counts, base_failed, words in flagged lines, their hashes, and kept: a row per row of docs."""
    rules = rules or Rules()
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.keep(scan(docs, rules, id_col, text_col, host_col), "lines")
    marks = verdicts(scanned, docs.select(F.col(text_col).cast("string").alias("text")), rules, copies, scratch).select(F.col("host").alias("mh"), F.col("t1").alias("m1"), F.col("t2").alias("m2"), "flagged_words", "flagged")
    flat = scanned.drop("line", "line_words")
    rows = flat.join(marks, (F.col("t1") == F.col("m1")) & (F.col("t2") == F.col("m2")) & F.col("host").eqNullSafe(F.col("mh")), "left").drop("mh", "m1", "m2")
    failed = (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)
    left = F.col("n_words") - F.coalesce("flagged_words", F.lit(0))
    depleted = (left < rules.min_words) | (left * 100 < F.col("n_words") * rules.min_left_percent)
    return rows.select("*", failed.alias("base_failed"), left.alias("n_words_left"), (~failed & ~depleted).alias("kept"))


def _strip(batch_text: int, batch_flags: int):
    def make():
        def fn(batch: pa.RecordBatch):
            texts, flags = batch.column(batch_text).to_pylist(), batch.column(batch_flags).to_pylist()
            out = []
            for t, f in zip(texts, flags, strict=True):
                if f and t is not None:
                    lines = t.encode().split(b"\n")
                    bad = set(f)
                    h = K.signed(line_hashes([normal_line(x) for x in lines]))
                    t = b"\n".join(x for x, y in zip(lines, h, strict=True) if int(y) not in bad or not x.split()).decode()
                out.append(t)
            cols = [batch.column(k) for k in range(batch.num_columns) if k != batch_flags]
            cols[batch_text] = pa.array(out, pa.string())
            yield cols

        return fn

    return make


def clean(docs: DataFrame, rules: Rules | None = None, text_col: str = "text", host_col: str = "source", chars_col: str | None = "n_chars", copies: Copies | None = None) -> DataFrame:
    """docs without rejected documents and without flagged lines; same columns."""
    rules = rules or Rules()
    scratch = Scratch(docs.sparkSession)
    judged = judge(docs.select(F.lit(None).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), rules, "id", "text", "host", copies)
    marks = judged.filter(~F.col("kept") | F.col("flagged").isNotNull()).groupBy("host", "t1", "t2").agg(F.first("flagged").alias("flagged"), F.first("kept").alias("kept"))
    marks = scratch.keep(marks, "marks")
    yes, no, t1, t2 = split_rows(docs, text_col, docs.sparkSession.sparkContext.broadcast(Bitmap(marks, "t1")))
    mh, m1, m2, flagged, kept = (fresh(yes, f"gl_{c}") for c in marks.columns)
    on = (F.col(t1) == F.col(m1)) & (F.col(t2) == F.col(m2)) & F.col(host_col).cast("string").eqNullSafe(F.col(mh))
    yes = yes.join(marks.toDF(mh, m1, m2, flagged, kept), on, "left").filter(F.coalesce(F.col(kept), F.lit(True))).select(*docs.columns, flagged)
    out = map_arrow(yes, _strip(docs.columns.index(text_col), len(docs.columns)), docs.schema).unionByName(no)
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
