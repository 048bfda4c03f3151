"""The keyed result store: a parquet table in buckets of keys, of which a change rewrites those that it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.operators import summary
from galleria.session import Scratch

#: Columns of the store's own: bucket of the keys; change that wrote the row; the row's place in it.
BUCKET, CHANGE, PLACE = "gl_bucket", "gl_change", "gl_place"


class ResultStore:
    """Rows by key columns, compared as text; columns may be added at any time.

    A row lies in the bucket of its keys' hash, a partition folder. A change reads and rewrites only the buckets that hold its
    keys: the new content is written to the scratch folder first and then put in place by dynamic partition overwrite, so a
    job that fails on the way leaves the buckets as they were. Every row carries the number of its change and its place in it;
    the last of several matches is the one of the latest change. One writer at a time; readers may see a change's buckets
    come one after the other."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 16):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    # Reading

    def stored(self) -> DataFrame | None:
        """The table with the store's own columns."""
        try:
            return self.spark.read.option("mergeSchema", True).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return None
            raise

    def load(self) -> DataFrame | None:
        rows = self.stored()
        return None if rows is None else rows.drop(BUCKET, CHANGE, PLACE)

    def of_keys(self, match: dict) -> DataFrame | None:
        """The rows that match (as text); of one bucket alone if all keys are given. None matches an unknown column."""
        rows = self.stored()
        if rows is None:
            return None
        if set(self.keys) <= set(match):
            one = self.spark.range(1).select(self._bucket([F.lit(None if match[k] is None else str(match[k])) for k in self.keys])).first()[0]
            rows = rows.filter(F.col(BUCKET) == one)
        return summary.select_rows(rows, **match)

    def has(self, **match) -> bool:
        rows = self.of_keys(match)
        return rows is not None and not rows.isEmpty()

    def get(self, **match):
        """The last row that matches, or None."""
        rows = self.of_keys(match)
        if rows is None:
            return None
        own = [c for c in rows.columns if c not in (BUCKET, CHANGE, PLACE)]
        return rows.agg(F.max_by(F.struct(*own), F.struct(CHANGE, PLACE)).alias("row")).first()["row"]

    def should_skip(self, planned: DataFrame, facts: list[str], overwrite: bool = False) -> DataFrame:
        rows = self.stored()
        if overwrite or rows is None:
            return planned.withColumn("skip", F.lit(False))
        return summary.should_skip(rows, planned, self.keys, facts, [CHANGE, PLACE])

    # Changing

    def _bucket(self, keys: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.concat(F.lit("="), k.cast("string")), F.lit("")) for k in keys]), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def _marked(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """New rows with their bucket, change and place."""
        change = 0 if old is None else old.agg(F.coalesce(F.max(CHANGE), F.lit(-1))).first()[0] + 1
        return new.select("*", self._bucket([F.col(k) for k in self.keys]), F.lit(change).cast("long").alias(CHANGE), F.monotonically_increasing_id().alias(PLACE))

    def _put(self, old: DataFrame | None, left: DataFrame | None, new: DataFrame | None, touched: list[int]) -> None:
        """Buckets `touched` get the rows of left and new; where a column's type changes, the whole table is written."""
        was = None if old is None else old.schema
        if old is not None and new is not None:  # types that are not both numbers meet as text
            kinds = [(f.name, f.dataType, new.schema[f.name].dataType) for f in old.schema.fields if f.name in new.columns]
            text = {c: F.col(c).cast("string") for c, a, b in kinds if a != b and not (isinstance(a, T.NumericType) and isinstance(b, T.NumericType))}
            old, left, new = (x.withColumns(text) if text else x for x in (old, left, new))
        parts = [x for x in (left, new) if x is not None]
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        if was is not None and any(rows.schema[f.name].dataType != f.dataType for f in was.fields if f.name in rows.columns):
            rest = old.filter(~F.col(BUCKET).isin(touched))
            rows, touched = rows.unionByName(rest, allowMissingColumns=True), list(range(self.buckets))
        scratch = Scratch(self.spark)
        rows = scratch.keep(rows, "store")
        filled = {r[0] for r in rows.select(BUCKET).distinct().collect()}
        rows.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for b in set(touched) - filled:
            fs.delete(p(f"{self.path}/{BUCKET}={b}"), True)
        scratch.drop(rows)
        self.spark.catalog.refreshByPath(self.path)

    def upsert(self, new: DataFrame) -> None:
        """New rows take the place of those with their keys."""
        summary.need_columns(new, self.keys)
        scratch, old = Scratch(self.spark), self.stored()
        new = scratch.keep(self._marked(new, old), "new")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]
        if touched:
            have = new.select(*[F.col(k).cast("string").alias(f"gl_{k}") for k in self.keys]).distinct()
            on = reduce(lambda x, y: x & y, [F.col(k).cast("string").eqNullSafe(F.col(f"gl_{k}")) for k in self.keys])
            self._put(old, None if old is None else old.filter(F.col(BUCKET).isin(touched)).join(have, on, "left_anti"), new, touched)
        scratch.drop(new)

    def remove(self, **match) -> int:
        """Delete the rows that match (as text); their number."""
        hits = self.of_keys(match)
        counts = {} if hits is None else {r[BUCKET]: r["n"] for r in hits.groupBy(BUCKET).agg(F.count("*").alias("n")).collect()}
        if counts:
            old = self.stored()
            self._put(old, summary.remove(old.filter(F.col(BUCKET).isin(list(counts))), match)[0], None, list(counts))
        return sum(counts.values())

    def replace_rows(self, model: str, rows: DataFrame | None) -> None:
        """All rows of a model give way to `rows`; none deletes them."""
        if rows is None:
            self.remove(model=model)
            return
        scratch, old = Scratch(self.spark), self.stored()
        new = scratch.keep(self._marked(rows, old), "new")
        hits = None if old is None else summary.select_rows(old, model=model)
        touched = [r[0] for r in (new.select(BUCKET) if hits is None else new.select(BUCKET).union(hits.select(BUCKET))).distinct().collect()]
        if touched:
            self._put(old, None if old is None else summary.remove(old.filter(F.col(BUCKET).isin(touched)), {"model": model})[0], new, touched)
        scratch.drop(new)
