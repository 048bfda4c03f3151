"""Result summaries, pivots, selections and the keyed result store's relational part."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.functions.expr import sel

from .metrics import ci95, mean_std

# Columns of a result row that are not metrics.
BOOKKEEPING = {
    "model", "name", "family", "seed", "fold", "run", "restart", "episode", "split", "shot", "classifier", "variant", "dataset", "task", "mode", "status", "fingerprint",
    "lr", "preprocess", "best_epoch", "params_m", "train_seconds", "k", "c",
}


def metric_columns(df: DataFrame, keys: list[str]) -> list[str]:
    """Columns that hold numbers and are neither keys nor bookkeeping; test_ first, then val_, then the rest."""
    cand = [c for c in df.columns if c not in keys and c.lower() not in BOOKKEEPING and not c.startswith("gpu_")]
    if not cand:
        return []
    counts = df.agg(*[F.count(F.expr(f"try_cast(`{c}` AS double)")).alias(c) for c in cand]).first()
    order = lambda c: (0 if c.startswith("test_") else 1 if c.startswith("val_") else 2)
    return sorted((c for c in cand if counts[c]), key=order)


def summarise(runs: DataFrame, keys: list[str], metrics: list[str], confidence: bool = False, registry: DataFrame | None = None) -> DataFrame:
    """Per model and keys (null keys kept): n_runs and n_diverged, mean and sample deviation of each metric over runs that did
    not diverge, rounded to 4 digits; with a registry its name, family and order."""
    group = ["model", *keys]
    ok = F.col("status") != "diverged" if "status" in runs.columns else F.lit(True)
    aggs: list[Column] = [F.count_if(F.coalesce(ok, F.lit(True))).alias("n_runs"), F.count_if(~F.coalesce(ok, F.lit(True))).alias("n_diverged")]
    if "lr" in runs.columns and "lr" not in keys:
        aggs.append(F.array_join(F.transform(F.array_sort(F.collect_set("lr")), lambda x: x.cast("string")), " ").alias("lr"))
    for m in metrics:
        mean, std, n = mean_std(F.when(F.coalesce(ok, F.lit(True)), F.expr(f"try_cast(`{m}` AS double)")))
        aggs += [F.round(mean, 4).alias(f"{m}_mean"), F.round(std, 4).alias(f"{m}_std")]
        if confidence:
            aggs.append(F.round(ci95(std, n), 4).alias(f"{m}_ci95"))
    out = runs.groupBy(*group).agg(*aggs)
    if registry is not None:
        out = out.join(F.broadcast(registry.select(F.col("key").alias("rk"), "name", "family", "ord")), F.col("model") == F.col("rk"), "left").drop("rk")
        out = out.withColumn("name", F.coalesce("name", "model")).orderBy(F.col("ord").asc_nulls_last(), *group)
    return out


def best_per_group(df: DataFrame, group: str | list[str], value: str, tie: str) -> DataFrame:
    """The row of the largest value in each group; of equals the first by `tie`."""
    w = Window.partitionBy(group).orderBy(F.col(value).desc_nulls_last(), F.col(tie))
    return df.withColumn("gl_r", F.row_number().over(w)).filter("gl_r = 1").drop("gl_r")


def top_models(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    return df.groupBy("model").agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc(), "model").limit(n)


def first_best_epoch(log: DataFrame, value: str, patience: int, eps: float = 1e-9) -> DataFrame:
    """(run, best_epoch, stop_epoch): the first epoch of the last strict improvement, and where patience ran out."""
    past = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    better = F.col("before").isNull() | (F.col(value) > F.col("before") + eps)
    steps = log.withColumn("before", F.max(value).over(past)).withColumn("last_best", F.max(F.when(better, F.col("epoch"))).over(upto))
    stop = F.min(F.when(F.col("epoch") - F.col("last_best") >= patience, F.col("epoch")))
    ended = steps.groupBy("run").agg(stop.alias("stop_epoch"), F.max("epoch").alias("last_epoch"))
    return steps.join(ended, "run").filter(F.col("epoch") == F.coalesce("stop_epoch", "last_epoch")).select("run", F.col("last_best").alias("best_epoch"), F.coalesce("stop_epoch", "last_epoch").alias("stop_epoch"))


def pivot_table(df: DataFrame, row: str, column: str, values: list, value: str, how: str = "avg") -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(getattr(F, how)(value))


def class_weights(labels: DataFrame) -> DataFrame:
    """(cls, weight) = n / (classes * n_cls)."""
    n = labels.groupBy("cls").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t"), F.count("*").alias("c")))).select("cls", (F.col("t") / (F.col("c") * F.col("n"))).alias("weight"))


def run_health(stores: list[DataFrame]) -> DataFrame:
    """(store, model, problem): diverged runs, runs that fell back, models run on mixed devices or precisions."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stores)
    for c in ("status", "gpu_fallback", "gpu_name", "amp_dtype_used"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    one = lambda cond, text: rows.filter(cond).select("store", "model", F.lit(text).alias("problem")).distinct()
    several = lambda c: rows.groupBy("store", "model").agg(F.size(F.collect_set(c)).alias("n")).filter("n > 1").select("store", "model", F.lit(f"mixed {c}").alias("problem"))
    return one(F.col("status") == "diverged", "diverged").unionByName(one(F.lower(F.col("gpu_fallback").cast("string")) == "true", "fell back")).unionByName(several("gpu_name")).unionByName(several("amp_dtype_used"))


# Keyed store


def need_columns(df: DataFrame, keys: list[str]) -> None:
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise KeyError(f"missing key columns: {', '.join(missing)}")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old without the rows whose keys new has, and new; columns by name, missing ones null."""
    need_columns(new, keys)
    have = new.select(*[F.col(k).cast("string").alias(f"gl_{k}") for k in keys]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(k).cast("string").eqNullSafe(F.col(f"gl_{k}")) for k in keys])
    return old.join(have, on, "left_anti").unionByName(new, allowMissingColumns=True)


def select_rows(df: DataFrame, **conditions) -> DataFrame:
    """The rows where all columns equal these values as text; none where a column is unknown."""
    return df.filter(sel(**conditions) if set(conditions) <= set(df.columns) else F.lit(False))


def remove(old: DataFrame, match: dict) -> tuple[DataFrame, int]:
    """(rows left, rows removed) where all columns of `match` are equal as text."""
    hit = reduce(lambda a, b: a & b, [F.col(k).cast("string") == F.lit(str(v)) for k, v in match.items()])
    return old.filter(~F.coalesce(hit, F.lit(False))), old.filter(hit).count()


def should_skip(stored: DataFrame, planned: DataFrame, keys: list[str], facts: list[str], order: list[str] | None = None) -> DataFrame:
    """planned with `skip`: whether the stored row of the keys has the same facts: text exactly, numbers within 1e-12 of
    the larger of them and 1 (as text where either is no number). Of rows with equal keys the last by `order` counts; without
    an order keys are taken to be unique, and of equal ones the largest row counts."""
    s = stored.select(*[F.col(k).cast("string").alias(f"k_{k}") for k in keys], F.struct(*[F.col(f).cast("string").alias(f"s_{f}") for f in facts]).alias("row"), F.struct(*(order or [F.lit(0)])).alias("at"))
    s = s.groupBy(*[f"k_{k}" for k in keys]).agg(F.max(F.struct("at", "row")).alias("x")).withColumn("row", F.col("x.row")).select(*[f"k_{k}" for k in keys], F.lit(True).alias("gl_stored"), "row.*")

    def same(f: str) -> Column:
        a, b = F.col(f"s_{f}"), F.col(f).cast("string")
        numeric = isinstance(planned.schema[f].dataType, T.NumericType)
        x, y = F.expr(f"try_cast(`s_{f}` AS double)"), F.expr(f"try_cast(`{f}` AS double)")
        close = F.abs(x - y) <= F.greatest(F.lit(1.0), F.abs(x), F.abs(y)) * 1e-12
        return F.when(x.isNotNull() & y.isNotNull(), close).otherwise(a == b) if numeric else a == b

    on = reduce(lambda x, y: x & y, [F.col(f"k_{k}").eqNullSafe(F.col(k).cast("string")) for k in keys])
    ok = reduce(lambda x, y: x & y, [F.coalesce(same(f), F.lit(False)) for f in facts], F.lit(True))
    return planned.join(s, on, "left").select(*planned.columns, (F.col("gl_stored").isNotNull() & ok).alias("skip"))


def fingerprint(df: DataFrame, columns: list[str], out: str = "fingerprint") -> DataFrame:
    """fp and the first 16 hex digits of the SHA-1 of the columns as JSON; the prefix keeps it from being read as a number."""
    return df.withColumn(out, F.concat(F.lit("fp"), F.substring(F.sha1(F.to_json(F.struct(*sorted(columns)))), 1, 16)))


def accuracy_by_bin(predictions: DataFrame, sizes: DataFrame, edges: list[float]) -> DataFrame:
    """(model, ord, bin, n_images, top1) with every bin for every model; predictions: (model, id, hit), sizes: (id, min_side)."""
    from .catalog import bin_of, bins_table

    p = predictions.join(sizes, "id", "left").groupBy("model", bin_of(F.col("min_side"), edges).alias("k")).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("m"))
    models = predictions.select("model").distinct()
    every = models.crossJoin(F.broadcast(bins_table(predictions.sparkSession, edges)))
    hit = p.withColumnRenamed("model", "pm")
    return every.join(hit, (F.col("model") == F.col("pm")) & (F.col("ord") == F.col("k")), "left").select("model", "ord", "bin", F.coalesce("n", F.lit(0)).alias("n_images"), (F.col("m") * 100.0).alias("top1"))
