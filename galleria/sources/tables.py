"""Typed readers and writers: CSV where only the empty field is null, features, registry, JSON, Markdown, LaTeX, the store."""

from __future__ import annotations

import contextlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.operators import summary

from .store import ResultStore  # noqa: F401


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A CSV with a header under a given schema: ids stay text, only an empty field is null."""
    try:
        return spark.read.schema(schema).option("header", True).option("nullValue", "").option("emptyValue", "").option("multiLine", True).option("escape", '"').csv(path)
    except Exception as e:
        raise FileNotFoundError(f"{path} can't be read; run the step that writes it first") from e


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder in one step: written beside its place, then moved there (an export; parquet is the store)."""
    spark = df.sparkSession
    tmp = f"{path}.tmp"
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(tmp)
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(p(path), True)
    if not fs.rename(p(tmp), p(path)):
        raise OSError(f"{path} can't be put in place")


def write_text(path: str, text: str) -> None:
    """A small driver-side file in one step."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=Path(path).parent)
    try:
        with os.fdopen(fd, "w") as f:
            f.write(text)
        os.replace(tmp, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(tmp)
        raise


def write_json(df: DataFrame, path: str) -> None:
    """The first row of a one-row table as a JSON document."""
    row = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).first()
    write_text(path, json.dumps(json.loads(row[0]) if row else {}, indent=2, ensure_ascii=False))


def save_features(df: DataFrame, path: str, meta: dict, half: bool = False) -> None:
    """(image_id, embedding) as parquet with its meta beside it; half rounds values to half precision as stored features are."""
    v = F.col("embedding").cast("array<double>")
    if half:
        # Eleven significant bits: scale by the power of two that leaves them before the point, round half even.
        e = lambda x: F.pow(F.lit(2.0), F.lit(10) - F.floor(F.log2(F.abs(x))))
        v = F.transform(v, lambda x: F.when(x == 0, x).otherwise(F.bround(x * e(x), 0) / e(x)))
    df.select("image_id", v.cast("array<float>").alias("embedding")).write.mode("overwrite").parquet(f"{path}/features")
    rows = df.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string")
    rows.coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_features(spark: SparkSession, path: str, ids: DataFrame, expect: dict | None = None) -> DataFrame:
    """Features of the ids (image_id); missing ids are a KeyError, a different meta a ValueError."""
    meta = json.loads("".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
    wrong = {k: (meta.get(k), v) for k, v in (expect or {}).items() if meta.get(k) != v}
    if wrong:
        raise ValueError(f"stored features differ: {wrong}")
    feats = spark.read.parquet(f"{path}/features")
    gone = ids.join(feats, "image_id", "left_anti").limit(3).collect()
    if gone:
        raise KeyError(f"no features for {[r['image_id'] for r in gone]}")
    return ids.join(feats, "image_id")


def registry(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Model registry as a dimension table with its order."""
    schema = "ord int, key string, name string, family string, basic boolean, lr_rep boolean, square_only boolean"
    full = [(k, r["key"], r.get("name", r["key"]), r["family"], bool(r.get("basic")), bool(r.get("lr_rep")), bool(r.get("square_only"))) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def select_models(models: DataFrame, selector: str) -> DataFrame:
    """all, basic, lr_rep, or keys joined by commas, in registry order."""
    if selector == "all":
        out = models
    elif selector in ("basic", "lr_rep"):
        out = models.filter(selector)
    else:
        keys = [k.strip() for k in selector.split(",") if k.strip()]
        have = {r["key"] for r in models.select("key").collect()}
        if unknown := [k for k in keys if k not in have]:
            raise KeyError(f"unknown models: {', '.join(unknown)}")
        out = models.filter(F.col("key").isin(keys))
    return out.orderBy("ord")


def families(models: DataFrame) -> DataFrame:
    return models.groupBy("family").agg(F.min("ord").alias("ord")).orderBy("ord").select("family")


def to_markdown(df: DataFrame, empty: str = "No results yet.") -> str:
    """A small result table as Markdown (its rows come to the driver)."""
    rows = df.collect()
    if not rows:
        return f"{empty}\n"
    line = lambda x: "| " + " | ".join("" if v is None else str(v) for v in x) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)]) + "\n"


LATEX = {"%": r"\%", "&": r"\&", "_": r"\_", "±": r"$\pm$"}


def to_latex(df: DataFrame, caption: str) -> str:
    esc = lambda v: "".join(LATEX.get(ch, ch) for ch in ("" if v is None else str(v)))
    cols = "ll" + "c" * max(0, len(df.columns) - 2)
    body = [" & ".join(map(esc, r)) + r" \\" for r in [df.columns, *df.collect()]]
    return "\n".join([r"\begin{table}", rf"\caption{{{esc(caption)}}}", rf"\begin{{tabular}}{{{cols}}}", r"\hline", body[0], r"\hline", *body[1:], r"\hline", r"\end{tabular}", r"\end{table}", ""])


def write_tables(tables: dict[str, DataFrame], out: str) -> None:
    """Each table as .md and .tex, and all of them in all_tables.md."""
    whole = []
    for name, df in tables.items():
        md = to_markdown(df)
        write_text(f"{out}/{name}.md", md)
        write_text(f"{out}/{name}.tex", to_latex(df, name))
        whole.append(f"## {name}\n\n{md}")
    write_text(f"{out}/all_tables.md", "\n".join(whole))


# The file of each experiment's summary, its keys besides the model, and whether it has 95 % intervals.
SUMMARIES = {
    "E0": ("E0_preprocessing", ["mode"], False),
    "lr_sweep": ("LR_sweep", ["lr"], False),
    "E1": ("E1_identity_supervised", ["split"], False),
    "E2": ("E2_gender_supervised", ["split"], False),
    "E3": ("E3_identity_fewshot", ["classifier", "shot"], True),
    "E3b": ("E3b_single_gallery", [], True),
    "E4": ("E4_gender_fewshot", ["classifier", "shot"], True),
    "E56": ("E5_E6_unsupervised", ["task"], False),
    "E7": ("E7_new_identity_retrieval", ["variant", "shot"], True),
    "E7_verification": ("E7_new_identity_verification", ["variant"], False),
    "E8": ("E8_cross_dataset", ["dataset", "variant"], False),
    "resolution": ("resolution_analysis", ["bin"], False),
    "S3_training": ("S3_training", [], False),
}


def write_summaries(runs: dict[str, DataFrame], models: DataFrame, out: str) -> list[str]:
    """A CSV folder per experiment that has runs, with means and deviations per model and keys, and a README that lists them.
    A summary whose experiment has no runs any more is removed. Returns the names written."""
    spark, listing = models.sparkSession, []
    for name, (file, keys, interval) in SUMMARIES.items():
        df, path = runs.get(name), f"{out}/{file}.csv"
        if df is None or df.isEmpty():
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            continue
        keys = [k for k in keys if k in df.columns]
        table = summary.summarise(df, keys, summary.metric_columns(df, keys), interval, models)
        write_csv(table.coalesce(1), path)
        listing.append((file, ", ".join(["model", *keys]), table.count()))
    lines = ["# Results", "", "Means (`_mean`), sample deviations (`_std`) and half 95 % intervals (`_ci95`) over `n_runs` runs that did not diverge.", "", "| File | One row per | Rows |", "|---|---|---|"]
    write_text(f"{out}/README.md", "\n".join([*lines, *[f"| `{f}.csv` | {k} | {n} |" for f, k, n in listing]]) + "\n")
    return [f for f, _, _ in listing]
