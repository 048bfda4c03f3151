"""Result tables: one row per model, cells of mean and deviation over its runs.

A table's cells are declared; all of them are computed in one aggregation over the runs and joined to the models, so a model
without runs has dashes. Means are over values that are numbers; a column that the runs lack gives dashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galleria.functions import expr as X

from .metrics import ci95, mean_std

DASH = "–"


@dataclass(frozen=True)
class Cell:
    """`label`: mean ± deviation (or half of the 95 % interval if `interval`) of `metric` over the rows where `where` holds.
    told: the number of values is told even if all that are expected are there."""

    label: str
    metric: str
    where: dict = field(default_factory=dict)
    interval: bool = False
    expected: int | None = None
    digits: int = 2
    told: bool = False


def _value(runs: DataFrame, metric: str, where: dict) -> Column | None:
    """The metric as a number where the conditions hold (compared as text); None if a column is missing."""
    if any(c not in runs.columns for c in (metric, *where)):
        return None
    return F.when(X.sel(**where), F.expr(f"try_cast(`{metric}` AS double)"))


def cell_text(runs: DataFrame, cell: Cell) -> Column:
    """The aggregate that makes a cell's text: one value has no ±; fewer values than expected are told."""
    v = _value(runs, cell.metric, cell.where)
    if v is None:
        return F.lit(DASH)
    mean, std, n = mean_std(v)
    spread, form = ci95(std, n) if cell.interval else std, f"%.{cell.digits}f"
    text = F.when(n > 1, F.format_string(f"{form} ± {form}", mean, spread)).otherwise(F.format_string(form, mean))
    if cell.expected:
        text = F.when(F.lit(cell.told) | (n < cell.expected), F.concat(text, F.format_string(f" (n=%d/{cell.expected})", n))).otherwise(text)
    return F.when(n == 0, F.lit(DASH)).otherwise(text)


def result_table(models: DataFrame, runs: DataFrame | None, cells: list[Cell], by: tuple[str, ...] = (), only_run: bool = False) -> DataFrame:
    """(ord, family, name, *by, cells) for models (key, name, family, ord, ...) and runs (model, ...). With `by` a model has a
    row for each of its values in the runs; with only_run or `by`, models without runs are left out."""
    base = models.select("ord", "family", "name", "key")
    if runs is None:
        return base.drop("key").withColumns({c.label: F.lit(DASH) for c in cells})
    got = runs.groupBy(F.col("model").alias("key"), *by).agg(*[cell_text(runs, c).alias(c.label) for c in cells])
    out = base.join(got, "key", "inner" if by or only_run else "left").drop("key")
    return out.fillna(DASH, [c.label for c in cells])


def gap(models: DataFrame, runs: DataFrame, metric: str, a: dict, b: dict, label: str) -> DataFrame:
    """(ord, `label`): the difference of two means with its sign; a dash where one of them is missing."""
    va, vb = _value(runs, metric, a), _value(runs, metric, b)
    d = F.lit(None).cast("double") if va is None or vb is None else F.avg(va) - F.avg(vb)
    got = runs.groupBy(F.col("model").alias("key")).agg(F.format_string("%+.2f", d).alias("text"), d.alias("d"))
    return models.join(got, "key", "left").select("ord", F.when(F.col("d").isNull(), DASH).otherwise(F.col("text")).alias(label))


def rate_table(models: DataFrame, runs: DataFrame, grid: list[float], fixed: dict[str, float] | None = None, metric: str = "val_top1") -> DataFrame:
    """(ord, family, chosen, values): the metric at each rate of the grid, and the rate that a family uses: a fixed one, else
    that of the best value (of equals the smallest rate), else a dash. runs: (family, lr, metric)."""
    lr, v = F.expr("try_cast(lr AS double)"), F.expr(f"try_cast(`{metric}` AS double)")
    rows = runs.select("family", lr.alias("gl_lr"), v.alias("gl_v"))
    near = lambda g: F.when(F.abs(F.col("gl_lr") - g) <= 1e-8 + 1e-5 * abs(g), F.col("gl_v"))
    wide = rows.withColumns({f"gl_{k}": near(g) for k, g in enumerate(grid)})
    texts = [cell_text(wide, Cell("", f"gl_{k}")) for k in range(len(grid))]
    best = F.min(F.when(F.col("gl_v").isNotNull(), F.struct((-F.col("gl_v")).alias("v"), F.col("gl_lr").alias("lr"))))["lr"]
    got = wide.groupBy("family").agg(F.concat_ws(" / ", *texts).alias("values"), best.cast("string").alias("best"))
    families = models.groupBy("family").agg(F.min("ord").alias("ord"))
    none = F.lit(" / ".join([DASH] * len(grid)))
    named = F.lit(None).cast("string")
    for name, rate in (fixed or {}).items():
        named = F.when(F.col("family") == name, F.lit(f"{rate:g} (fixed)")).otherwise(named)
    return families.join(got, "family", "left").select("ord", "family", F.coalesce(named, "best", F.lit(DASH)).alias("chosen"), F.coalesce("values", none).alias("values"))


def preprocessing_table(models: DataFrame, runs: DataFrame) -> DataFrame:
    """Modes of preprocessing for the models that were run, or the basic ones if none was; a mode that a model can't take is named so."""
    cells = [Cell(m, "test_top1", {"mode": m}) for m in ("stretch", "letterbox", "nonsquare")]
    out = result_table(models, runs, cells, only_run=True)
    if out.isEmpty():
        out = result_table(models.filter("basic"), runs, cells)
    square = models.select("ord", "square_only")
    return out.join(square, "ord").withColumn("nonsquare", F.when(F.col("square_only"), "(not applicable)").otherwise(F.col("nonsquare"))).drop("square_only", "family")


def resolution_table(models: DataFrame, runs: DataFrame, bins: list[str]) -> DataFrame:
    """Accuracy by bin of image size for the models that were run, and a last row with each bin's number of images."""
    out = result_table(models, runs, [Cell(b, "top1", {"bin": b}) for b in bins], only_run=True).drop("family")
    n = [F.coalesce(F.max(F.when(F.col("bin") == b, F.col("n_images"))).cast("string"), F.lit(DASH)).alias(b) for b in bins]
    return out.unionByName(runs.agg(*n).withColumns({"ord": F.lit(None).cast("int"), "name": F.lit("images")}))


def build_tables(models: DataFrame, runs: dict[str, DataFrame], s: dict) -> dict[str, DataFrame]:
    """All result tables of the stored runs, by experiment. Settings: seeds, folds, identity_shots, gender_shots, linear_shots,
    proto_draws, linear_draws, gallery_runs, restarts, retrieval_shots, retrieval_runs, datasets, grid, fixed_rates, bins."""
    folded = lambda n: -(-n // s["folds"]) * s["folds"]  # noqa: E731  draws are dealt evenly to the folds
    table = lambda e, cells, **kw: result_table(models, runs.get(e), cells, **kw)
    ci = lambda label, metric, where, n: Cell(label, metric, where, True, n)
    kinds = (("proto", "Proto"), ("lp", "LP"))
    out: dict[str, DataFrame] = {}
    if "E0" in runs:
        out["E0"] = preprocessing_table(models, runs["E0"])
    if "lr_sweep" in runs:
        out["LR"] = rate_table(models, runs["lr_sweep"], s["grid"], s.get("fixed_rates"))
    measures = ("top1", "top1_subject_mean", "top5", "macro_precision", "macro_recall", "macro_f1")
    out["E1"] = table("E1", [Cell(m, f"test_{m}", expected=s["seeds"]) for m in measures])
    if "model_info" in runs:
        size = result_table(models, runs["model_info"], [Cell("params_m", "params_m", digits=1), Cell("gmacs", "gmacs")])
        out["E1"] = size.join(out["E1"].drop("family", "name"), "ord")
    s2 = [Cell(f"{m} (S2)", f"test_{m}", {"split": "S2"}, expected=s["folds"]) for m in ("acc", "bal_acc", "f1", "auc", "acc_subject")]
    out["E2"] = table("E2", [*s2, Cell("acc (S1)", "test_acc", {"split": "S1"}, expected=s["seeds"])])
    if "E2" in runs:
        out["E2"] = out["E2"].join(gap(models, runs["E2"], "test_acc", {"split": "S1"}, {"split": "S2"}, "S1 - S2"), "ord")
    n3 = {"proto": s["proto_draws"], "lp": s["linear_draws"]}
    for name, metric in (("E3", "top1"), ("E3s", "top1_subject_mean")):
        out[name] = table("E3", [ci(f"{label} {k}-shot", metric, {"classifier": c, "shot": k}, n3[c]) for c, label in kinds for k in s["identity_shots"]])
    out["E3b"] = table("E3b", [ci(m, m, {}, s["gallery_runs"]) for m in ("rank1", "rank5", "rank10", "aucmc")])
    shots = {"proto": s["gender_shots"], "lp": s["linear_shots"]}
    out["E4"] = table("E4", [ci(f"{label} K={k}", "bal_acc", {"classifier": c, "shot": k}, folded(n3[c])) for c, label in kinds for k in shots[c]])
    out["E56"] = table("E56", [Cell(f"{t} {m}", m, {"task": t}, expected=s["restarts"]) for t, ms in (("gender", ("acc", "nmi")), ("identity", ("acc", "nmi", "ari"))) for m in ms])
    e7 = [ci(f"{k}-shot top1 ({v})", "rank1", {"variant": v, "shot": k}, s["retrieval_runs"]) for v in ("finetuned", "frozen") for k in s["retrieval_shots"]]
    out["E7"] = table("E7", e7)
    if "E7_verification" in runs:
        pairs = [Cell(f"{m} ({v})", m, {"variant": v}) for v in ("finetuned", "frozen") for m in ("eer", "tar_at_far")]
        out["E7"] = out["E7"].join(result_table(models, runs["E7_verification"], pairs).drop("family", "name"), "ord")
    if "E8" in runs:
        out["E8"] = table("E8", [Cell(f"{d} {m}", m, {"dataset": d}) for d in s["datasets"] for m in ("rank1", "rank5", "aucmc")], by=("variant",))
    if "resolution" in runs:
        out["resolution"] = resolution_table(models, runs["resolution"], s["bins"])
    return out
