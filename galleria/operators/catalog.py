"""The image catalogue: profiling, quantiles, histograms, gender assignment, checked loading."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleria.functions import expr as X


class CatalogError(ValueError):
    """A table breaks its contract."""


def require_empty(df: DataFrame, message: str, column: str) -> None:
    bad = [str(r[0]) for r in df.select(column).limit(5).collect()]
    if bad:
        raise CatalogError(f"{message}: {', '.join(bad)}")


def derived(images: DataFrame, tiny_below: int = 8) -> DataFrame:
    """min_side, aspect_hw and tiny of width and height; an unknown size is not tiny."""
    side = F.least("width", "height")
    return images.withColumns({"min_side": side, "aspect_hw": F.col("height") / F.col("width"), "tiny": F.coalesce(side < tiny_below, F.lit(False))})


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def group_size_stats(df: DataFrame, key: str) -> DataFrame:
    """One row: groups, and min, median, mean, max of their sizes."""
    n = df.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_groups"), F.min("n").alias("min"), F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"), F.max("n").alias("max"))


QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


#: Ranges that a pass cuts each kept range into, and values of a range that are few enough to be sorted.
CUTS, FEW = 64, 4096


def order_statistics(df: DataFrame, column: str, ranks: list[int], cuts: int = CUTS, few: int = FEW) -> dict[int, float]:
    """The values at these places (from 0) of the sorted column, which has no nulls, by refining ranges.

    Each pass counts the values in ranges, cut by approximate quantiles so that they halve and halve again whatever the
    distribution, and keeps those that hold a wanted place; a range of one value, or of few, is settled. A pass is a scan with
    partial counts: no task holds more than the counts of its ranges, and the driver gets `few` values a place at most."""
    v = df.select(F.col(column).cast("double").alias("v"))
    ends = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    open_ = {r: (ends["a"], ends["b"], 0) for r in ranks}  # place: (from, to, both included; values below)
    found: dict[int, float] = {}
    while open_:
        ranges = sorted({(a, b) for a, b, _ in open_.values()})
        inside = [(F.col("v") >= a) & (F.col("v") <= b) for a, b in ranges]
        qs = [k / cuts for k in range(1, cuts)]
        got = v.agg(*[F.percentile_approx(F.when(c, F.col("v")), qs, 20 * cuts).alias(f"q{k}") for k, c in enumerate(inside)]).first()
        parts = []
        for k, (a, b) in enumerate(ranges):
            edges = sorted({a, *got[f"q{k}"], b})
            # A value of an edge is a range of its own: a value that very many rows have is settled at once.
            place = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("v"))) * 2 + F.col("v").isin(edges).cast("int")
            parts.append(F.when(inside[k], F.struct(F.lit(k).alias("k"), place.alias("place"))))
        each = v.select("v", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull())).alias("p"))
        counts = each.groupBy("p").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).orderBy("p").collect()
        small: list[tuple[int, float, float, int]] = []
        for rank, (a, b, below) in list(open_.items()):
            for r in (r for r in counts if r["p"]["k"] == ranges.index((a, b))):
                if rank < below + r["n"]:
                    break
                below += r["n"]
            if r["a"] == r["b"]:
                found[rank] = r["a"]
                del open_[rank]
            elif r["n"] <= few:
                small.append((rank, r["a"], r["b"], below))
                del open_[rank]
            else:
                open_[rank] = (r["a"], r["b"], below)
        if small:
            wanted = sorted({(a, b) for _, a, b, _ in small})
            near = v.filter(functools.reduce(lambda x, y: x | y, [(F.col("v") >= a) & (F.col("v") <= b) for a, b in wanted]))
            values = [(r["v"], r["n"]) for r in near.groupBy("v").agg(F.count("*").alias("n")).orderBy("v").collect()]
            for rank, a, b, below in small:
                for x, n in values:
                    if a <= x <= b:
                        if rank < below + n:
                            found[rank] = x
                            break
                        below += n
    return found


def describe(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """One row: min, five exact quantiles (linear interpolation), max, mean; of no values all null."""
    v = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL")
    whole = v.agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"))
    n = whole.first()["n"]
    at = {k: q * (n - 1) for k, q in QUANTILES.items()}
    values = order_statistics(v, "v", sorted({f(x) for x in at.values() for f in (math.floor, math.ceil)})) if n else {}
    between = lambda x: values[math.floor(x)] + (values[math.ceil(x)] - values[math.floor(x)]) * (x - math.floor(x))
    cols = {"min": F.col("min"), **{k: F.lit(between(x) if n else None).cast("double") for k, x in at.items()}, "max": F.col("max"), "mean": F.col("mean")}
    return whole.select(*[(X.half_even(c, digits) if digits is not None else c).alias(k) for k, c in cols.items()])


def bin_labels(edges: list[float]) -> list[str]:
    return [f"[{a:g},{b:g})" for a, b in zip(edges, edges[1:], strict=False)]


def bin_of(value: Column, edges: list[float]) -> Column:
    """Number of the left-closed bin, null outside."""
    out = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        out = F.when((value >= edges[k]) & (value < edges[k + 1]), F.lit(k)).otherwise(out)
    return out


def bins_table(spark, edges: list[float]) -> DataFrame:
    return spark.createDataFrame([(k, s) for k, s in enumerate(bin_labels(edges))], "ord int, bin string")


def histogram(df: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """(ord, bin, n) with empty bins."""
    n = df.groupBy(bin_of(F.col(column), edges).alias("k")).agg(F.count("*").alias("n"))
    return bins_table(df.sparkSession, edges).join(n, F.col("ord") == F.col("k"), "left").select("ord", "bin", F.coalesce("n", F.lit(0)).alias("n"))


def mixed_layout(images: DataFrame) -> DataFrame:
    """Subjects with images both inside and outside split folders."""
    has = images.groupBy("subject").agg(F.bool_or(F.col("orig_split") != "").alias("a"), F.bool_or(F.col("orig_split") == "").alias("b"))
    return has.filter("a AND b").select("subject")


def problems(images: DataFrame) -> DataFrame:
    """(image_id, problem): bad status, truncated files, mixed layouts."""
    bad = images.filter("status <> 'ok'").select("image_id", F.col("status").alias("problem"))
    cut = images.filter("status = 'ok' AND truncated").select("image_id", F.lit("truncated").alias("problem"))
    mix = mixed_layout(images).select(F.col("subject").alias("image_id"), F.lit("mixed layout").alias("problem"))
    return bad.unionByName(cut).unionByName(mix)


def dataset_statistics(images: DataFrame, subjects: DataFrame, edges: list[float], digits: int = 4) -> DataFrame:
    """One row: subjects, images, both by gender, sizes per subject, quantiles of side and aspect, side bins, tiny."""
    ok = images.filter("status = 'ok'")
    named = ok.join(subjects.select("subject", "gender"), "subject")
    male, female = F.col("gender") == "M", F.col("gender") == "F"
    s = subjects.agg(F.count("*").alias("n_subjects"), F.count_if(male).alias("subjects_m"), F.count_if(female).alias("subjects_f"))
    i = named.agg(F.count("*").alias("n_images"), F.count_if(male).alias("images_m"), F.count_if(female).alias("images_f"), F.count_if("tiny").alias("tiny"))
    g = group_size_stats(ok, "subject").select(*[F.col(c).alias(f"per_subject_{c}") for c in ("min", "median", "mean", "max")])
    side = describe(ok, "min_side", digits).select(F.struct("*").alias("min_side"))
    ratio = describe(ok, "aspect_hw", digits).select(F.struct("*").alias("aspect_hw"))
    bins = histogram(ok, "min_side", edges).agg(F.array_sort(F.collect_list(F.struct("ord", "bin", "n"))).alias("side_bins"))
    out = s
    for part in (i, g, side, ratio, bins):
        out = out.crossJoin(part)
    return out


def assign_gender(subjects: DataFrame, labels: DataFrame | None = None, male_count: int | None = None) -> DataFrame:
    """subjects with gender and gender_source: from a checked label table (subject, gender), else the first male_count subjects
    in natural order are M."""
    if labels is not None:
        rows = labels.select(F.trim(F.col("subject")).alias("ls"), F.upper(F.trim(F.col("gender"))).alias("lg"))
        require_empty(rows.groupBy("ls").count().filter("count > 1"), "subject labelled twice", "ls")
        require_empty(rows.filter("lg IS NULL OR lg NOT IN ('M', 'F')"), "gender is neither M nor F", "ls")
        out = subjects.join(rows, F.col("subject") == F.col("ls"), "left")
        require_empty(out.filter("lg IS NULL"), "subject without a gender", "subject")
        return out.select(*subjects.columns, F.col("lg").alias("gender"), F.lit("labels_file").alias("gender_source"))
    n = subjects.count()
    if male_count is None or not 0 <= male_count <= n:
        raise CatalogError(f"male_count must lie in 0..{n}")
    w = Window.partitionBy(F.lit(0)).orderBy(X.natural_key(F.col("subject")), "subject")  # one row per subject: a dimension table
    return subjects.withColumn("gender", F.when(F.row_number().over(w) <= male_count, "M").otherwise("F")).withColumn("gender_source", F.lit("folder_order"))


def load_images(images: DataFrame, subjects: DataFrame, removed: DataFrame | None = None, groups: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Usable images with gender, order and group: status ok, not removed, subjects known, groups complete (else own id)."""
    out = images.filter("status = 'ok'")
    if removed is not None:
        out = out.join(removed.select("image_id"), "image_id", "left_anti")
    out = out.join(subjects.select("subject", "order", "gender"), "subject", "left")
    if check:
        require_empty(out.filter("gender IS NULL"), "images of unknown subjects", "image_id")
    if groups is None:
        out = out.withColumn("group", F.col("image_id"))
    else:
        out = out.join(groups.select("image_id", F.col("group")), "image_id", "left")
        if check:
            require_empty(out.filter("`group` IS NULL"), "images without a duplicate group (run the duplicate search again)", "image_id")
    return out.withColumn("orig_split", F.coalesce("orig_split", F.lit("")))


def positions(images: DataFrame) -> DataFrame:
    """Number of each image in the stable order (order, image_id), from 0: by subject counts first, then inside each subject."""
    n = images.groupBy("order", "subject").agg(F.count("*").alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("order", "subject").rowsBetween(Window.unboundedPreceding, -1)  # a row per subject
    start = n.select(F.col("subject").alias("ps"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("subject").orderBy("image_id")
    return images.join(start, F.col("subject") == F.col("ps")).withColumn("pos", F.col("start") + F.row_number().over(inside) - 1).drop("ps", "start")


def stale_split(split: DataFrame, images: DataFrame) -> DataFrame:
    """(problem, image_id) of a stored split that no longer fits: missing, extra and regrouped images."""
    a, b = images.select("image_id", F.col("group").alias("gi")), split.select("image_id", F.col("group").alias("gs"))
    missing = a.join(b, "image_id", "left_anti").select(F.lit("missing").alias("problem"), "image_id")
    extra = b.join(a, "image_id", "left_anti").select(F.lit("extra").alias("problem"), "image_id")
    moved = a.join(b, "image_id").filter("gi <> gs").select(F.lit("regrouped").alias("problem"), "image_id")
    return missing.unionByName(extra).unionByName(moved)


def load_split(split: DataFrame, images: DataFrame) -> DataFrame:
    for r in stale_split(split, images).groupBy("problem").agg(F.count("*").alias("n"), F.min("image_id").alias("x")).orderBy("problem").collect():
        raise CatalogError(f"the split is stale: {r['n']} {r['problem']} images, first {r['x']}")
    return images.join(split.select("image_id", "split"), "image_id", "left")


def encode_labels(df: DataFrame, column: str, out: str = "label") -> DataFrame:
    """Dense numbers of the values in natural order."""
    names = df.select(F.col(column).alias("gl_v")).distinct()
    w = Window.partitionBy(F.lit(0)).orderBy(X.natural_key(F.col("gl_v").cast("string")), "gl_v")  # a row per distinct value
    return df.join(names.withColumn(out, (F.row_number().over(w) - 1).cast("long")), F.col(column) == F.col("gl_v")).drop("gl_v")


def first_seen_codes(df: DataFrame, column: str, position: str, out: str = "code") -> DataFrame:
    """Dense numbers of the values in order of first appearance."""
    first = df.groupBy(F.col(column).alias("gl_v")).agg(F.min(position).alias("gl_p"))
    w = Window.partitionBy(F.lit(0)).orderBy("gl_p")
    return df.join(first.select("gl_v", (F.row_number().over(w) - 1).cast("long").alias(out)), F.col(column) == F.col("gl_v")).drop("gl_v")
