"""Experiments on stored features: few-shot, one image each, retrieval and verification of new people, clustering, other sets.

Each experiment is one plan over all its draws: the table of runs (shots x draws, bounded by the settings) meets the images,
and every measure is grouped by the run. Only model fits (k-means, the linear probe) are loops, one fit a step. Tables:
images (image_id, subject, group), vectors (image_id, v). Subjects are numbers (see catalog.encode_labels). Similarities are
rounded to nine digits, so that ties don't depend on the order of sums. Empty images give no rows; a vector that is missing
leaves its image out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galleria.functions import expr as X
from galleria.session import Scratch

from . import metrics, tiles, vector
from .metrics import By
from .splits import fold_role

DRAW: By = ("shot", "draw")


def runs(spark: SparkSession, shots: tuple[int, ...], draws: int) -> DataFrame:
    return spark.createDataFrame([(k, d) for k in shots for d in range(draws)], "shot int, draw int")


def draw(images: DataFrame, shots: tuple[int, ...], n_val: int, draws: int, seed: int, tag: str) -> DataFrame:
    """(shot, draw, image_id, subject, role): per subject `shot` support and n_val validation images, from different groups as
    far as there are; the rest is test, without images of the chosen groups. A subject with too few images is an error."""
    least = max(shots) + n_val
    few = images.groupBy("subject").agg(F.count("*").alias("n")).filter(F.col("n") <= least).limit(1).collect()
    if few:
        raise ValueError(f"subject {few[0]['subject']} has {few[0]['n']} images; more than {least} are needed")
    d = images.crossJoin(F.broadcast(runs(images.sparkSession, shots, draws))).withColumn("h", X.hashed(seed, F.lit(tag), *DRAW, "image_id"))
    of_group, of_subject = Window.partitionBy(*DRAW, "subject", "group"), Window.partitionBy(*DRAW, "subject")
    d = d.withColumn("again", (F.row_number().over(of_group.orderBy("h", "image_id")) > 1).cast("int"))
    d = d.withColumn("pick", F.row_number().over(of_subject.orderBy("again", "h", "image_id")))
    chosen = F.col("pick") <= F.col("shot") + n_val
    d = d.withColumn("hit", F.max(chosen.cast("int")).over(of_group)).filter(chosen | (F.col("hit") == 0))
    role = F.when(F.col("pick") <= F.col("shot"), "support").when(chosen, "val").otherwise("test")
    return d.select(*DRAW, "image_id", "subject", role.alias("role"))


def _featured(drawn: DataFrame, vectors: DataFrame, role: str, id_name: str, cls_name: str, *more: str) -> DataFrame:
    rows = drawn.filter(F.col("role") == role).join(vectors, "image_id")
    return rows.select(*more, *DRAW, F.col("image_id").alias(id_name), F.col("subject").alias(cls_name), "v")


def fewshot_identity(images: DataFrame, vectors: DataFrame, shots: tuple[int, ...], n_val: int, draws: int, seed: int, scratch: Scratch, linear_draws: int = 0) -> DataFrame:
    """(classifier, shot, draw, identity measures): class prototypes in every draw, the linear probe in the first linear_draws."""
    drawn = scratch.keep(draw(images, shots, n_val, draws, seed, "identity"), "draws")
    support, tests = (_featured(drawn, vectors, r, "probe", "cls") for r in ("support", "test"))
    labels = tests.select(*DRAW, "probe", F.col("cls").alias("y"))
    scores = vector.prototype_scores(support, tests.drop("cls"), DRAW).withColumn("score", F.round("score", 9))
    outcomes = scratch.keep(metrics.outcomes(scores, labels, DRAW), "outcomes")
    out = metrics.outcome_measures(outcomes, DRAW).withColumn("classifier", F.lit("proto"))
    val = _featured(drawn, vectors, "val", "probe", "cls")
    for k in shots:
        for d in range(linear_draws):
            of = lambda t: t.filter((F.col("shot") == k) & (F.col("draw") == d)).drop(*DRAW)  # noqa: E731, B023
            fitted, _ = vector.linear_probe(of(support).drop("probe"), of(val).drop("probe"), of(tests).drop("cls"))
            row = metrics.identity_metrics(fitted, of(labels)).withColumns({"shot": F.lit(k), "draw": F.lit(d), "classifier": F.lit("lp")})
            out = out.unionByName(row)
    return out


def _identified(gallery: DataFrame, probes: DataFrame, by: By, scratch: Scratch) -> DataFrame:
    best = vector.identity_scores(probes, gallery, by).withColumn("score", F.round("score", 9))
    return scratch.keep(metrics.identification_ranks(best, by), "ranks")


def single_gallery(images: DataFrame, vectors: DataFrame, draws: int, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """((draw, rank measures), (rank, mean cmc)): one image of each subject as its gallery."""
    drawn = scratch.keep(draw(images, (1,), 0, draws, seed, "gallery"), "draws")
    n = images.agg(F.countDistinct("subject")).first()[0]
    ranks = _identified(_featured(drawn, vectors, "support", "id", "cls"), _featured(drawn, vectors, "test", "id", "cls"), DRAW, scratch)
    curve = metrics.cmc(ranks, n, DRAW).groupBy("rank").agg(F.avg("cmc").alias("cmc"))
    return metrics.rank_summary(ranks, n, by=DRAW).drop("shot"), curve


def fewshot_gender(images: DataFrame, vectors: DataFrame, folds: DataFrame, n_folds: int, shots: tuple[int, ...], draws: int, seed: int, scratch: Scratch, linear_draws: int = 0) -> DataFrame:
    """(classifier, fold, shot, draw, gender measures): prototypes, and in the first linear_draws the linear probe, of `shot` subjects of each gender, one image each, from the training
    folds, measured on the test fold; the linear probe's strength is chosen on all images of the fold for validation. images need gender_label (1 is female); folds: (subject, fold). A fold with too few
    subjects of one gender for a shot is left out."""
    by = ("fold", *DRAW)
    spark = images.sparkSession
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), fold_role(F.col("own"), k, n_folds).alias("role")) for k in range(n_folds)])).alias("x")
    placed = images.join(folds.select("subject", F.col("fold").alias("own")), "subject").select("image_id", "subject", "gender_label", each)
    placed = placed.select(F.col("x.k").alias("fold"), F.col("x.role").alias("role"), "image_id", "subject", "gender_label")
    drawn = placed.filter("role = 'train'").crossJoin(F.broadcast(runs(spark, shots, draws)))
    h = lambda c: X.hashed(seed, F.lit("gender"), *by, c)
    one = F.row_number().over(Window.partitionBy(*by, "subject").orderBy("h", "image_id"))
    drawn = drawn.withColumn("h", h("image_id")).withColumn("r", one).filter("r = 1").withColumn("s", h("subject"))
    of_gender = Window.partitionBy(*by, "gender_label")
    drawn = drawn.withColumn("q", F.row_number().over(of_gender.orderBy("s", "subject"))).filter(F.col("q") <= F.col("shot"))
    full = drawn.groupBy(*by).agg(F.count("*").alias("n")).filter(F.col("n") == 2 * F.col("shot")).select(*by)
    support = drawn.join(full, list(by), "left_semi").join(vectors, "image_id").select(*by, F.col("gender_label").alias("cls"), "v")
    tests = placed.filter("role = 'test'").join(full, "fold").join(vectors, "image_id")
    scores = vector.prototype_scores(support, tests.select(*by, F.col("image_id").alias("probe"), "v"), by)
    p = scores.groupBy(*by, "probe").agg(F.round((F.sum(F.when(F.col("cls") == 1, F.col("score")).otherwise(-F.col("score"))) + 1) / 2, 9).alias("p"))
    truth = placed.filter("role = 'test'").select("fold", F.col("image_id").alias("probe"), "subject", F.col("gender_label").alias("y"))
    out = metrics.gender_metrics(scratch.keep(p.join(truth, ["fold", "probe"]), "gender-scores"), by=by).withColumn("classifier", F.lit("proto"))
    if not linear_draws:
        return out
    support = scratch.keep(support, "gender-support")
    val = placed.filter("role = 'val'").join(vectors, "image_id").select("fold", F.col("gender_label").alias("cls"), "v")
    probes = scratch.keep(vector.few_probes(support.filter(F.col("draw") < linear_draws), val, by, ("fold",)), "gender-probes")
    queries = placed.filter("role = 'test'").join(vectors, "image_id").select("fold", F.col("image_id").alias("probe"), X.l2_normalize(F.col("v")).alias("f"))
    margin = X.dot(F.col("f"), F.col("w")) + F.col("b")
    chance = queries.join(F.broadcast(probes), "fold").select(*by, "probe", F.round(1 / (1 + F.exp(-margin)), 9).alias("p"))
    fitted = metrics.gender_metrics(scratch.keep(chance.join(truth, ["fold", "probe"]), "gender-probe"), by=by)
    return out.unionByName(fitted.withColumn("classifier", F.lit("lp")))


def unsupervised(vectors: DataFrame, tasks: dict[str, DataFrame], restarts: int, seed: int, scratch: Scratch) -> DataFrame:
    """(task, restart, k, clustering measures): k-means into as many clusters as a task (image_id, y) has classes."""
    rows = []
    for name, truth in tasks.items():
        k = truth.agg(F.countDistinct("y")).first()[0]
        for r in range(restarts):
            found = scratch.keep(vector.kmeans(vectors, k, seed + r, id_col="image_id"), "clusters")
            one = metrics.clustering_metrics(found.join(truth, "image_id").select("y", "cluster"))
            rows.append(one.withColumns({"task": F.lit(name), "restart": F.lit(r), "k": F.lit(k)}))
    return reduce(lambda a, b: a.unionByName(b), rows)


def new_identity(images: DataFrame, vectors: DataFrame, roles: DataFrame, shots: tuple[int, ...], draws: int, seed: int, scratch: Scratch) -> DataFrame:
    """(variant, shot, draw, rank measures) of the novel subjects alone; vectors have a variant, roles are (subject, role)."""
    novel = images.join(roles.filter("role = 'novel'").select("subject"), "subject", "left_semi")
    drawn = scratch.keep(draw(novel, shots, 0, draws, seed, "new"), "draws")
    n = novel.agg(F.countDistinct("subject")).first()[0]
    by = ("variant", *DRAW)
    ranks = _identified(_featured(drawn, vectors, "support", "id", "cls", "variant"), _featured(drawn, vectors, "test", "id", "cls", "variant"), by, scratch)
    return metrics.rank_summary(ranks, n, by=by)


def new_identity_verification(images: DataFrame, vectors: DataFrame, roles: DataFrame, impostors: int, seed: int, scratch: Scratch, far: float = 0.01) -> DataFrame:
    """(variant, eer, tar_at_far, n_genuine, n_impostor) over pairs of the novel subjects: all genuine pairs of different groups
    and a sample of impostors. Scores are rounded to six digits; genuine ones are counted in tiles, so no table holds their pairs."""
    novel = images.join(roles.filter("role = 'novel'").select("subject"), "subject", "left_semi")
    ids = novel.select(F.col("image_id").alias("id"), F.col("subject").alias("cls"))
    unit = X.l2_normalize(F.col("v"))
    own = novel.filter("group IS NOT NULL").join(vectors, "image_id")
    blocks = tiles.blocks(own.select("variant", F.col("subject").alias("cls"), F.col("image_id").alias("id"), "group", *tiles.unit(own)), scratch, ("variant", "cls"))
    genuine = tiles.meet(blocks, None, _genuine_scores, "at long, n long", ("variant", "cls"), whole=True)
    genuine = genuine.groupBy("variant", "at").agg(F.sum("n").alias("n")).select("variant", F.lit(True).alias("same"), (F.col("at") / 1e6).alias("score"), "n")
    pairs = vector.impostor_pairs(ids, impostors, seed).select("id_a", "id_b")
    n = vectors.join(F.broadcast(pairs.select(F.col("id_a").alias("image_id")).union(pairs.select("id_b")).distinct()), "image_id").select("variant", "image_id", unit.alias("f"))
    strange = pairs.join(n.select("variant", F.col("image_id").alias("id_a"), F.col("f").alias("fa")), "id_a").join(n.select("variant", F.col("image_id").alias("id_b"), F.col("f").alias("fb")), ["variant", "id_b"])
    strange = strange.select("variant", F.lit(False).alias("same"), F.round(X.dot(F.col("fa"), F.col("fb")), 6).alias("score"), F.lit(1).cast("long").alias("n"))
    scored = scratch.keep(genuine.unionByName(strange), "pair-scores")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    counts = scored.groupBy("variant").agg(total(F.col("same")).alias("n_genuine"), total(~F.col("same")).alias("n_impostor"))
    side = lambda c: scored.filter(c).select("variant", "score", "n")
    return metrics.verification(side(F.col("same")), side(~F.col("same")), far, ("variant",)).join(counts, "variant")


def _genuine_scores(xs, ys: list[tiles.Block], met):
    """(score in millionths, pairs) of the pairs of an area that are of different groups."""
    counts = np.zeros(2_000_005, np.int64)
    for x in xs:
        for y in ys:
            if not met(x, y):
                continue
            a, b, ga, gb = x.matrix(), y.matrix(), x.flat("group"), y.flat("group")
            for i in range(0, len(x), tiles.STEP):
                ok = ga[i : i + tiles.STEP, None] != gb[None, :]
                if x.number == y.number:
                    ok &= np.arange(len(y))[None, :] > np.arange(i, min(i + tiles.STEP, len(x)))[:, None]
                counts += np.bincount(np.rint((a[i : i + tiles.STEP] @ b.T)[ok] * 1e6).astype(np.int64) + 1_000_002, minlength=len(counts))
    at = np.flatnonzero(counts)
    yield [at - 1_000_002, counts[at]]


def cross_dataset(images: DataFrame, vectors: DataFrame, overlap: DataFrame, scratch: Scratch) -> DataFrame:
    """(variant, rank1, rank5, ...): leave-one-out over another set without the subjects that overlap (subject)."""
    kept = images.join(overlap.select("subject").distinct(), "subject", "left_anti")
    n = kept.agg(F.countDistinct("subject")).first()[0]
    by = ("variant",)
    v = kept.join(vectors, "image_id").select("variant", F.col("image_id").alias("id"), F.col("subject").alias("cls"), "v")
    best = vector.identity_scores(v, None, by).withColumn("score", F.round("score", 9))
    ranks = scratch.keep(metrics.identification_ranks(best, by), "ranks")
    return metrics.rank_summary(ranks, n, (1, 5), by)
