"""Column expressions: vectors, bit hashes, natural order, rounding and text forms. All of them run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Answers that count as yes in a review sheet.
YES = ("y", "yes", "1", "x", "true", "remove", "có", "co")


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """v / |v|; a zero vector stays zero."""
    d = as_double(v)
    # A list of one: inside the lambda the norm is a value, not an expression that each element computes again.
    norm = F.array(F.sqrt(dot(d, d)))
    return F.transform(norm, lambda n: F.when(n == 0, d).otherwise(F.transform(d, lambda x: x / n)))[0]


def cosine(a: Column, b: Column) -> Column:
    return dot(l2_normalize(a), l2_normalize(b))


def sign_hash64(v: Column, size: int = 64) -> Column:
    """Bits of the signs of the first `size` elements, as a long."""
    bits = [F.when(v[k] > 0, F.shiftleft(F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")) for k in range(size)]
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hamming64(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_from_hex(c: Column) -> Column:
    """Sixteen hex digits as a long (two's complement)."""
    return F.conv(c, 16, -10).cast("long")


def hash_to_hex(c: Column) -> Column:
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def natural_key(c: Column, width: int = 20) -> Column:
    """A sortable string: text in lower case, runs of digits padded with zeros to `width`."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(p, width, "0")).otherwise(p)), "")


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def is_yes(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*YES)


def gender_label(c: Column, female: str = "F") -> Column:
    """1 for the female label, 0 for any other and for null."""
    return F.coalesce((c.cast("string") == female).cast("int"), F.lit(0))


def sel(**conditions) -> Column:
    """All columns equal these values, compared as text."""
    return reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.lit(str(v)) for k, v in conditions.items()], F.lit(True))


def on_grid(c: Column, grid: list[float], eps: float = 1e-12) -> Column:
    return F.exists(F.array(*[F.lit(float(g)) for g in grid]), lambda g: F.abs(g - c) <= eps)


def hashed(seed: int, *parts: Column | str) -> Column:
    """The order of all sampling here: md5 of the seed and the parts, joined by |. Equal on every engine and partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def plus_minus(mean: Column, std: Column, n: Column, expected: Column | None = None) -> Column:
    """mean ± std with two digits; one run has no ±; no run is a dash; fewer runs than expected are marked."""
    body = F.when(n > 1, F.format_string("%.2f ± %.2f", mean, std)).otherwise(F.format_string("%.2f", mean))
    if expected is not None:
        body = F.when(n < expected, F.concat(body, F.format_string(" (n=%d/%d)", n, expected))).otherwise(body)
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("–")).otherwise(body)


def suggest_width(aspect: Column, height: int = 224, multiple: int = 32) -> Column:
    """Width of a canvas of this height for a median height-to-width ratio: a multiple, at least one, at most the height."""
    w = F.greatest(F.lit(multiple), (F.bround(F.lit(float(height)) / aspect / multiple, 0) * multiple).cast("int"))
    return F.when(aspect.isNull() | F.isnan(aspect) | (aspect <= 0), F.lit(height)).otherwise(F.least(w, F.lit(height)))


def letterbox(w: Column, h: Column, cw: int, ch: int) -> list[Column]:
    """Size and place of a w x h image scaled into a cw x ch canvas: new_w, new_h, left_pad, top_pad."""
    scale = F.least(F.lit(float(cw)) / w, F.lit(float(ch)) / h)
    nw = F.greatest(F.lit(1), F.least(F.lit(cw), F.bround(w * scale, 0).cast("int")))
    nh = F.greatest(F.lit(1), F.least(F.lit(ch), F.bround(h * scale, 0).cast("int")))
    return [nw.alias("new_w"), nh.alias("new_h"), F.floor((cw - nw) / 2).cast("int").alias("left_pad"), F.floor((ch - nh) / 2).cast("int").alias("top_pad")]


def learning_rate(step: Column, base: float, total: int, warmup: int, kind: str = "cosine", step_size: int = 30, gamma: float = 0.1, floor: float = 0.0) -> Column:
    """Schedules: linear warm-up, then cosine, step or constant."""
    warm = (step + 1) / F.lit(float(max(1, warmup)))
    t = (step - warmup) / F.lit(float(max(1, total - warmup)))
    after = {"cosine": floor + (1 - floor) * (1 + F.cos(F.lit(3.141592653589793) * t)) / 2, "step": F.pow(F.lit(gamma), F.floor((step - warmup) / step_size)), "constant": F.lit(1.0)}[kind]
    return F.when(step < warmup, warm).otherwise(after) * base


def register(spark: SparkSession) -> None:
    """The vector and bit functions for SQL, as SQL functions (no Python at run time)."""
    for sql in (
        "l2_normalize(v ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN transform(v, x -> x / CASE WHEN aggregate(v, 0D, (s, y) -> s + y * y) = 0 THEN 1D ELSE sqrt(aggregate(v, 0D, (s, y) -> s + y * y)) END)",
        "dot_product(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
        "cosine_sim(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN dot_product(l2_normalize(a), l2_normalize(b))",
        "sign_hash64(v ARRAY<DOUBLE>) RETURNS BIGINT RETURN aggregate(transform(slice(v, 1, 64), (x, k) -> CASE WHEN x > 0 THEN shiftleft(1L, k) ELSE 0L END), 0L, (s, x) -> s | x)",
        "fmt_pm(mean DOUBLE, std DOUBLE, n BIGINT) RETURNS STRING RETURN CASE WHEN coalesce(n, 0) = 0 THEN '–' WHEN n > 1 THEN format_string('%.2f ± %.2f', mean, std) ELSE format_string('%.2f', mean) END",
        "hamming64(a BIGINT, b BIGINT) RETURNS INT RETURN bit_count(a ^ b)",
        "natural_key(s STRING) RETURNS STRING RETURN array_join(transform(regexp_extract_all(lower(s), '([0-9]+|[^0-9]+)', 1), p -> CASE WHEN p RLIKE '^[0-9]' THEN lpad(p, 20, '0') ELSE p END), '')",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {sql}")
