"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Documents are aggregated by encoded length, so what is left is a row per distinct length, whatever the number of
documents. From suffix sums over it every context limit L has its totals: documents longer than L, tokens in all, tokens
left when each document is cut at L, and quantiles of length.

Scale: one map pass encodes the texts; counts per length are combined map-side, so a hot length is one row per task. The
suffix sums run over ranges of lengths: sums of blocks of lengths first, then within each block, so no window holds the
whole histogram in one task. Number of rows <= number of distinct lengths.

Defined results: null and empty texts have length 0 (plus `extra` tokens); repeated rows count each; extra columns are
ignored; an empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from galleria.session import Scratch

from . import kernels as K
from . import tokens
from .common import map_arrow

#: Lengths in a block of the two-level suffix sums.
LENGTH_BLOCK = 1024


def lengths(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, extra: int = 0) -> DataFrame:
    """One row per document: its encoded length."""
    path = tokenizer or tokens.default_tokenizer()

    def make():
        enc = tokens.encoder(path)

        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(0))
            for _, _, b, o in K.blocks(buf, offs, 2 * K.BLOCK):
                yield [enc.lengths(K.Words(b, o, K.NOT_SPACE), o) + extra]

        return fn

    return map_arrow(docs.select(F.col(text_col).cast("string")), make, "n_tokens long", encodes=True)


def histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None, extra: int = 0) -> DataFrame:
    """n_tokens, n_docs: documents of each encoded length."""
    return lengths(docs, text_col, tokenizer, extra).groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """n_tokens, n_docs, and for the limit L = n_tokens: docs_over and tokens_over (longer documents and their tokens),
    total_docs, total_tokens, truncated_tokens (each document cut at L) and share_within (documents of at most L)."""
    # Both levels of sums read the histogram, so it is written once: a row per distinct length.
    hist = Scratch(hist.sparkSession).keep(hist, "histogram")
    h = hist.withColumn("block", F.floor(F.col("n_tokens") / LENGTH_BLOCK)).withColumn("mass", F.col("n_tokens") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("mass").alias("bm"))
    every = Window.partitionBy(F.lit(0))
    later = every.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("block").alias("b2"), F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("ad"), F.coalesce(F.sum("bm").over(later), F.lit(0)).alias("am"),
        F.sum("bd").over(every).alias("total_docs"), F.sum("bm").over(every).alias("total_tokens"),
    )
    inner = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = h.withColumn("id", F.coalesce(F.sum("n_docs").over(inner), F.lit(0))).withColumn("im", F.coalesce(F.sum("mass").over(inner), F.lit(0)))
    out = out.join(blocks, F.col("block") == F.col("b2"))
    over, mass = F.col("id") + F.col("ad"), F.col("im") + F.col("am")
    return out.select(
        "n_tokens", "n_docs", over.alias("docs_over"), mass.alias("tokens_over"), "total_docs", "total_tokens",
        (F.col("total_tokens") - mass + over * F.col("n_tokens")).alias("truncated_tokens"),
        ((F.col("total_docs") - over) / F.col("total_docs")).alias("share_within"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: documents, tokens, those longer than the limit and tokens left when cut there."""
    spark = sums.sparkSession
    lim = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    pairs = sums.join(F.broadcast(lim), F.col("n_tokens") > F.col("context_limit"))
    over = pairs.groupBy("context_limit").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    total = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("total_docs"), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0)).alias("total_tokens"))
    d, t = F.coalesce("d", F.lit(0)), F.coalesce("t", F.lit(0))
    return lim.join(over, "context_limit", "left").crossJoin(F.broadcast(total)).select(
        "context_limit", "total_docs", "total_tokens", d.alias("docs_over"), t.alias("tokens_over"),
        (F.col("total_tokens") - t + d * F.col("context_limit")).alias("truncated_tokens"),
    )


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """Smallest length with at least the share q of documents within it, for each q."""
    q = sums.sparkSession.createDataFrame([(float(x),) for x in qs], "q double")
    return sums.join(F.broadcast(q), F.col("share_within") >= F.col("q")).groupBy("q").agg(F.min("n_tokens").alias("n_tokens"))
