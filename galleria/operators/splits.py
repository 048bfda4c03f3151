"""Leak-free splits, folds and episodes.

All random choices order rows by an md5 of seed, parts and id: the same on every engine, partitioning and model. Splits with
exact counts that keep groups whole are a subset-sum per subject and run as one grouped map.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleria.functions import expr as X

from .catalog import encode_labels, require_empty


def folds(subjects: DataFrame, n: int, seed: int) -> DataFrame:
    """(subject, gender, fold): by gender in hash order, dealt in turn from a start that the seed gives."""
    if n < 3:
        raise ValueError("at least three folds are needed: train, validation and test")
    counts = {r["gender"]: r["n"] for r in subjects.groupBy("gender").agg(F.count("*").alias("n")).collect()}
    if len(counts) != 2 or min(counts.values()) < n:
        raise ValueError(f"both genders need at least {n} subjects, found {counts}")
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "gender")), 1, 4), 16, 10).cast("int")
    w = Window.partitionBy("gender").orderBy(X.hashed(seed, "subject"), "subject")
    return subjects.select("subject", "gender", F.pmod(start + F.row_number().over(w) - 1, F.lit(n)).cast("int").alias("fold"))


def fold_role(fold: Column, k: int, n: int) -> Column:
    return F.when(fold == k, "test").when(fold == (k + 1) % n, "val").otherwise("train")


def fold_pivot(assigned: DataFrame, genders: tuple[str, ...] = ("M", "F")) -> DataFrame:
    return assigned.groupBy("fold").pivot("gender", list(genders)).count().fillna(0)


def novel_split(subjects: DataFrame, share: float, seed: int) -> DataFrame:
    """(subject, gender, role): per gender round-half-even(n * share) novel subjects, at least one and not all."""
    n = F.count("*").over(Window.partitionBy("gender"))
    rn = F.row_number().over(Window.partitionBy("gender").orderBy(X.hashed(seed, "subject"), "subject"))
    novel = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(share), 0).cast("int")))
    return subjects.select("subject", "gender", F.when(rn <= novel, "novel").otherwise("train").alias("role"))


def load_folds(folds: DataFrame, images: DataFrame, n: int) -> DataFrame:
    """A stored (subject, fold), checked: each subject once, folds in 0..n-1, and all subjects of the images."""
    bad = folds.groupBy("subject").agg(F.count("*").alias("c"), F.min("fold").alias("a"), F.max("fold").alias("b"))
    require_empty(bad.filter((F.col("c") > 1) | F.col("a").isNull() | (F.col("a") < 0) | (F.col("b") >= n)), "subjects with more than one fold or a wrong one", "subject")
    require_empty(images.select("subject").distinct().join(folds, "subject", "left_anti"), "the folds are stale, subjects without one", "subject")
    return folds


def load_roles(roles: DataFrame, images: DataFrame) -> DataFrame:
    """A stored (subject, role), checked: each subject once, novel or train, and all subjects of the images."""
    bad = roles.groupBy("subject").agg(F.count("*").alias("c"), F.bool_and(F.coalesce(F.col("role").isin("novel", "train"), F.lit(False))).alias("ok"))
    require_empty(bad.filter("c > 1 OR NOT ok"), "subjects with more than one role or a wrong one", "subject")
    require_empty(images.select("subject").distinct().join(roles, "subject", "left_anti"), "the roles are stale, subjects without one", "subject")
    return roles


def frames_by_split(images: DataFrame, task: str | None = None) -> DataFrame:
    """Images of the three parts; with a task their label: subjects numbered in natural order, or gender (1 is female)."""
    kept = images.filter("split IN ('train', 'val', 'test')")
    if task is None:
        return kept
    return encode_labels(kept, "subject") if task == "identity" else kept.withColumn("label", X.gender_label(F.col("gender")))


def frames_by_fold(images: DataFrame, assigned: DataFrame, k: int, n: int) -> DataFrame:
    """images with a role from their subject's fold; a subject without a fold is an error."""
    out = images.join(assigned.select("subject", "fold"), "subject", "left")
    missing = out.filter("fold IS NULL").select("subject").limit(1).collect()
    if missing:
        raise ValueError(f"subject without a fold: {missing[0][0]}")
    return out.withColumn("role", fold_role(F.col("fold"), k, n))


def frames_for_novel(images: DataFrame, roles: DataFrame) -> DataFrame:
    """Images of the train subjects: their train and test parts train, val validates."""
    known = images.join(roles.filter("role = 'train'").select("subject"), "subject", "left_semi").filter("split <> 'excluded'")
    return known.withColumn("role", F.when(F.col("split") == "val", "val").otherwise("train"))


# Episodes


def distinct_group_order(images: DataFrame, seed: int, *parts: str) -> DataFrame:
    """images with `pick`: place in a draw per subject that takes one image of each group first, in hash order."""
    h = X.hashed(seed, *[F.lit(p) for p in parts], "image_id")
    inside = Window.partitionBy("subject", "group").orderBy("h", "image_id")
    order = Window.partitionBy("subject").orderBy("repeat", "h", "image_id")
    ranked = images.withColumn("h", h).withColumn("repeat", (F.row_number().over(inside) > 1).cast("int"))
    return ranked.withColumn("pick", F.row_number().over(order)).drop("h")


def identity_episode(images: DataFrame, shot: int, n_val: int, seed: int, episode: int) -> DataFrame:
    """(image_id, subject, role): `shot` support and n_val validation images per subject, from different groups as far as
    there are; the rest is test, without images of the chosen groups. A subject with too few images is an error."""
    few = images.groupBy("subject").agg(F.count("*").alias("n")).filter(F.col("n") <= shot + n_val).limit(1).collect()
    if few:
        raise ValueError(f"subject {few[0]['subject']} has {few[0]['n']} images; more than {shot + n_val} are needed")
    drawn = distinct_group_order(images, seed, str(episode))
    role = F.when(F.col("pick") <= shot, "support").when(F.col("pick") <= shot + n_val, "val").otherwise("test")
    chosen = F.max(F.when(F.col("pick") <= shot + n_val, 1).otherwise(0)).over(Window.partitionBy("subject", "group"))
    return drawn.withColumn("role", role).withColumn("hit", chosen).filter((F.col("role") != "test") | (F.col("hit") == 0)).select("image_id", "subject", "role")


def episode_counters(images: DataFrame, shot: int, n_val: int, seed: int, episode: int) -> DataFrame:
    """One row: subjects drawn without enough distinct groups, and subjects without test images."""
    groups = images.groupBy("subject").agg(F.countDistinct("group").alias("g"))
    test = identity_episode(images, shot, n_val, seed, episode).filter("role = 'test'").select("subject").distinct()
    none = groups.join(test, "subject", "left_anti").agg(F.count("*").alias("subjects_without_test"))
    return groups.agg(F.count_if(F.col("g") < shot + n_val).alias("subjects_without_distinct_groups")).crossJoin(none)


def gallery(images: DataFrame, shot: int, seed: int, run: int) -> DataFrame:
    return identity_episode(images, shot, 0, seed, run)


def gender_episode(pool: DataFrame, k: int, seed: int, episode: int) -> DataFrame:
    """(image_id, subject, gender): k subjects of each gender, one image each."""
    h = X.hashed(seed, F.lit(str(episode)), "image_id")
    one = pool.withColumn("h", h).withColumn("r", F.row_number().over(Window.partitionBy("subject").orderBy("h", "image_id"))).filter("r = 1")
    s = X.hashed(seed, F.lit(str(episode)), "subject")
    drawn = one.withColumn("s", s).withColumn("q", F.row_number().over(Window.partitionBy("gender").orderBy("s", "subject")))
    counts = {r["gender"]: r["n"] for r in pool.groupBy("gender").agg(F.countDistinct("subject").alias("n")).collect()}
    if len(counts) < 2 or min(counts.values()) < k:
        raise ValueError(f"{k} subjects of each gender are needed, found {counts}")
    return drawn.filter(F.col("q") <= k).select("image_id", "subject", "gender")


def capped(rows: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """A sample of n rows without replacement, in hash order (a sampling operator: its limit is its feature)."""
    return rows.orderBy(X.hashed(seed, id_col), id_col).limit(n)


# Exact splits that keep groups whole


class Sums:
    """The sums that subsets of some sizes reach: one bit set per prefix of the sizes, from which a subset is read back."""

    def __init__(self, sizes: list[int], most: int):
        self.sizes, window = sizes, (1 << (most + 1)) - 1
        self.reached = [1]
        for size in sizes:
            self.reached.append((self.reached[-1] | self.reached[-1] << size) & window)

    def largest(self) -> int:
        """The largest sum of at most `most`."""
        return self.reached[-1].bit_length() - 1

    def subset(self, total: int) -> list[int] | None:
        """Positions of a subset with this sum, or None: an item is taken where the sum is out of reach without it."""
        if total < 0 or not self.reached[-1] >> total & 1:
            return None
        out = []
        for k in range(len(self.sizes) - 1, -1, -1):
            if not self.reached[k] >> total & 1:
                out.append(k)
                total -= self.sizes[k]
        return out[::-1]


def take(groups: list[tuple[str, list[str]]], n: int) -> tuple[list[str], list[tuple[str, list[str]]], bool]:
    """(n images, the groups left, whether a group had to be cut): whole groups if any subset sums to n, else the smallest
    group that suffices gives the rest."""
    sizes = [len(x) for _, x in groups]
    sums = Sums(sizes, n)
    pick = sums.subset(n)
    if pick is not None:
        chosen = set(pick)
        return [i for k in pick for i in groups[k][1]], [g for k, g in enumerate(groups) if k not in chosen], False
    pick = sums.subset(sums.largest())
    chosen, short = set(pick), n - sum(sizes[k] for k in pick)
    donor = min((k for k in range(len(groups)) if k not in chosen and sizes[k] >= short), key=lambda k: (sizes[k], k))
    name, items = groups[donor]
    out = [i for k in pick for i in groups[k][1]] + items[:short]
    left = [g for k, g in enumerate(groups) if k not in chosen and k != donor] + [(name, items[short:])]
    return out, left, True


def exact_split(images: DataFrame, n_train: int, n_val: int, n_test: int, seed: int, keep_original: bool = True) -> DataFrame:
    """(image_id, subject, group, split, warning) per image (image_id, subject, group, orig_split).

    Exactly n_train and n_val images per subject, the rest is test; groups stay whole unless no subset of them fits, which is
    warned of. Subjects with fewer than n_train + n_val + n_test images are excluded. An original split with these counts is
    kept. Each subject is one grouped-map call; a subject's images are bounded by the catalogue."""
    if n_test < 1:
        raise ValueError("each subject needs a test image")
    least = n_train + n_val + n_test
    schema = "image_id string, subject string, `group` string, split string, warning string"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        subject = str(pdf["subject"].iloc[0])
        out = pd.DataFrame({"image_id": pdf["image_id"].astype(str), "subject": subject, "group": pdf["group"].astype(str), "split": "test", "warning": None})
        if len(pdf) < least:
            return out.assign(split="excluded", warning=f"{len(pdf)} images, {least} needed")
        have = pdf["orig_split"].value_counts()
        if keep_original and have.get("train", 0) == n_train and have.get("val", 0) == n_val and have.get("test", 0) == len(pdf) - n_train - n_val:
            return out.assign(split=pdf["orig_split"].to_numpy())
        key = lambda g: hashlib.md5(f"{seed}|{subject}|{g}".encode()).hexdigest()
        groups = sorted(((g, sorted(x)) for g, x in out.groupby("group")["image_id"]), key=lambda x: key(x[0]))
        train, groups, cut1 = take(groups, n_train)
        val, groups, cut2 = take(groups, n_val)
        split = {**dict.fromkeys(val, "val"), **dict.fromkeys(train, "train")}
        out["split"] = out["image_id"].map(split).fillna("test")
        if cut1 or cut2:
            out["warning"] = "a duplicate group had to be cut to reach exact counts"
        return out

    rows = images.select(F.col("image_id").cast("string"), F.col("subject").cast("string"), F.col("group").cast("string"), F.coalesce("orig_split", F.lit("")).alias("orig_split"))
    return rows.groupBy("subject").applyInPandas(one, schema)
