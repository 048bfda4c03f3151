"""Incremental work: rows not yet done under their fingerprint, a stream that upserts into a store, and duplicate groups that
grow batch by batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from galleria.operators.graph import connected_components
from galleria.operators.hamming import hamming_pairs
from galleria.operators.summary import best_per_group
from galleria.session import Scratch
from galleria.sources.store import ResultStore


def pending(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of wanted whose keys (with the fingerprint or digest among them) are not done: an anti-join, null-safe by text."""
    d = done.select(*[F.col(k).cast("string").alias(f"gl_{k}") for k in keys]).distinct()
    on = reduce(lambda a, b: a & b, [F.col(k).cast("string").eqNullSafe(F.col(f"gl_{k}")) for k in keys])
    return wanted.join(d, on, "left_anti")


def upsert_stream(stream: DataFrame, store: ResultStore, order: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch's latest row of each key replaces the stored one. A batch that is run again gives the same table."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert(best_per_group(batch, store.keys, order, store.keys[0]))

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


class DuplicateIndex:
    """Groups of near-duplicate images, kept as batches come: the same as a search over all images from scratch.

    Hashes are cached by (id, digest): only images that are new or have new content are hashed. They meet the stored hashes and
    each other; stored images do not meet again. New pairs are edges between new images and the labels of stored groups, and
    the components of this small graph are merged into the labels. An image whose content has changed may have held its group
    together, so its group is opened: its other members are paired among themselves anew. Stored state is two keyed tables in
    buckets; a batch rewrites the buckets that hold images which it changes."""

    def __init__(self, spark: SparkSession, path: str, distance: int, buckets: int = 16):
        self.spark, self.distance = spark, distance
        self.hashes = ResultStore(spark, f"{path}/hashes", ["id"], buckets)
        self.labels = ResultStore(spark, f"{path}/labels", ["id"], buckets)

    def add(self, items: DataFrame, hash_of: Callable[[DataFrame], DataFrame]) -> int:
        """Take in a batch (id, digest, subject), an id once. hash_of gives rows (id, ..., h) their hash. Returns how many were hashed."""
        scratch, old = Scratch(self.spark), self.hashes.load()
        todo = items.select("id", "digest", "subject")
        todo = todo if old is None else pending(todo, old, ["id", "digest"])
        todo = scratch.keep(items.join(todo.select("id"), "id", "left_semi"), "todo")
        fresh = scratch.keep(hash_of(todo).select("id", "h").join(todo.select("id", "digest", "subject"), "id"), "fresh")
        n = fresh.count()
        if not n:
            return 0
        if old is None:
            labels = opened = stored = None
        else:
            labels = self.labels.load()
            groups = labels.join(fresh.select("id"), "id", "left_semi").select("grp").distinct()
            members = labels.join(groups, "grp", "left_semi").select("id").join(fresh.select("id"), "id", "left_anti")
            opened = scratch.keep(old.join(members, "id", "left_semi"), "opened")
            rest = old.join(fresh.select("id"), "id", "left_anti").join(labels, "id")
            # A stored image stands for its group, unless the group is opened.
            stored = rest.join(members.withColumnRenamed("id", "open"), F.col("id") == F.col("open"), "left")
            stored = scratch.keep(stored.select("id", "digest", "subject", "h", F.coalesce("open", "grp").alias("node")), "stored")
        every = fresh.select("id", "subject", "h", F.col("id").alias("node"))
        every = every if old is None else every.unionByName(stored.select("id", "subject", "h", "node"))
        found = hamming_pairs(fresh, self.distance, every).filter("id_a <> id_b").select("id_a", "id_b")
        if opened is not None and not opened.isEmpty():
            found = found.unionByName(hamming_pairs(opened, self.distance).select("id_a", "id_b"))
        ends = every.drop("h")
        edges = found.join(ends.toDF("id_a", "sa", "a"), "id_a").join(ends.toDF("id_b", "sb", "b"), "id_b").filter("sa = sb").select("a", "b")
        joined = connected_components(edges, "a", "b", scratch).toDF("v", "label")
        loose = fresh.select("id") if old is None else fresh.select("id").unionByName(opened.select("id"))
        changed = loose.join(joined, F.col("id") == F.col("v"), "left").select("id", F.coalesce("label", "id").alias("grp"))
        if old is not None:
            moved = labels.join(loose, "id", "left_anti").join(joined, (F.col("grp") == F.col("v")) & (F.col("grp") != F.col("label")))
            changed = changed.unionByName(moved.select("id", F.col("label").alias("grp")))
        changed = scratch.keep(changed, "labels")
        self.hashes.upsert(fresh.select("id", "digest", "subject", "h"))
        self.labels.upsert(changed)
        return n

    def groups(self) -> DataFrame:
        """(id, subject, grp): grp is the smallest id of the group."""
        return self.hashes.load().select("id", "subject").join(self.labels.load(), "id")
