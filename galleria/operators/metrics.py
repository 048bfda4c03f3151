"""Evaluation metrics over long-form tables. Percentages are times 100.

Scores are rows (probe, cls, score); labels are (probe, y). Ranking windows are partitioned by probe, so the tables may be
of any length; counts of classes and clusters are combined map-side. With `by`, the columns of a run (model, shot, episode),
a measure has one row for each run, all of them in one plan.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galleria.session import Scratch, ship

from .graph import connected_components

By = tuple[str, ...]

#: Most cells of a dense matrix of clusters x classes (8 bytes each); an assignment of more is an auction over the entries.
MAX_ASSIGNMENT = 16_000_000


def pct(c: Column) -> Column:
    return c * 100.0


def beside(a: DataFrame, b: DataFrame, by: By = ()) -> DataFrame:
    """Two tables of one row a run side by side."""
    return a.join(b, list(by)) if by else a.crossJoin(b)


def ranked(scores: DataFrame, by: By = ()) -> DataFrame:
    """Place of each class among a probe's scores; of equals the lower class is first."""
    w = Window.partitionBy(*by, "probe").orderBy(F.col("score").desc(), F.col("cls"))
    return scores.withColumn("place", F.row_number().over(w))


def predictions(scores: DataFrame, by: By = ()) -> DataFrame:
    """(probe, pred): the class of the highest score."""
    return ranked(scores, by).filter("place = 1").select(*by, "probe", F.col("cls").alias("pred"))


def top_lists(scores: DataFrame, k: int = 5) -> DataFrame:
    """(probe, pred, top, score): best class, the k best joined by spaces, and the best score."""
    r = ranked(scores).filter(F.col("place") <= k)
    top = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "cls"))), lambda s: s["cls"].cast("string")), " ")
    return r.groupBy("probe").agg(F.min_by("cls", "place").alias("pred"), top.alias("top"), F.max("score").alias("score"))


def topk_correct(scores: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(probe, y, hit): whether the true class is among the k highest."""
    own = ranked(scores).join(labels, "probe").filter(F.col("cls") == F.col("y")).select("probe", (F.col("place") <= k).alias("hit"))
    return labels.join(own, "probe", "left").select("probe", "y", F.coalesce("hit", F.lit(False)).alias("hit"))


def class_counts(pairs: DataFrame, labels: DataFrame | None = None, by: By = ()) -> DataFrame:
    """(cls, tp, fp, fn, support) over labels present in y (or given); pairs: (y, pred)."""
    c = pairs.groupBy(*by, "y", "pred").agg(F.count("*").alias("n"))
    true = c.groupBy(*by, F.col("y").alias("cls")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    said = c.groupBy(*by, F.col("pred").alias("cls")).agg(F.sum("n").alias("said"))
    base = true
    if labels is not None:
        base = (c.select(*by).distinct().crossJoin(labels) if by else labels).join(true, [*by, "cls"], "left")
    z = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    out = base.join(said, [*by, "cls"], "left")
    return out.select(*by, "cls", z(F.col("tp")).alias("tp"), (z(F.col("said")) - z(F.col("tp"))).alias("fp"), (z(F.col("support")) - z(F.col("tp"))).alias("fn"), z(F.col("support")).alias("support"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def prf_per_class(counts: DataFrame, by: By = ()) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, "cls", "support", pct(ratio(tp, tp + fp)).alias("precision"), pct(ratio(tp, tp + fn)).alias("recall"), pct(ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"))


def prf(counts: DataFrame, by: By = ()) -> DataFrame:
    """One row: macro and support-weighted precision, recall and F1; zero divisions are 0."""
    per = prf_per_class(counts, by)
    cols = []
    for m in ("precision", "recall", "f1"):
        cols.append(F.avg(m).alias(f"macro_{m}"))
        cols.append((F.sum(F.col(m) * F.col("support")) / F.when(F.sum("support") > 0, F.sum("support"))).alias(f"weighted_{m}"))
    return per.groupBy(*by).agg(*cols)


def outcomes(scores: DataFrame, labels: DataFrame, by: By = ()) -> DataFrame:
    """(probe, y, place, pred): the place of the true class (null if it has no score) and the class of the highest score."""
    on = [*by, "probe"]
    of = labels.join(ranked(scores, by), on, "left").groupBy(*on, "y")
    return of.agg(F.max(F.when(F.col("cls") == F.col("y"), F.col("place"))).alias("place"), F.max(F.when(F.col("place") == 1, F.col("cls"))).alias("pred"))


def outcome_measures(hits: DataFrame, by: By = ()) -> DataFrame:
    """One row: top1, top1_subject_mean, top5, top10, and macro / weighted precision, recall, F1 over the true classes."""
    share = lambda k: pct(F.avg(F.when(F.col("place") <= k, 1.0).otherwise(0.0)))
    per = hits.groupBy(*by, "y").agg(share(1).alias("s")).groupBy(*by).agg(F.avg("s").alias("top1_subject_mean"))
    top = hits.groupBy(*by).agg(share(1).alias("top1"), share(5).alias("top5"), share(10).alias("top10"))
    said = hits.filter("pred IS NOT NULL").select(*by, "y", "pred")
    return beside(beside(top, per, by), prf(class_counts(said, by=by), by), by)


def identity_metrics(scores: DataFrame, labels: DataFrame, by: By = ()) -> DataFrame:
    return outcome_measures(outcomes(scores, labels, by), by)


def roc_auc(rows: DataFrame, by: By = ()) -> DataFrame:
    """One row auc (percent, null for a single class) of (y, p): by counts of distinct scores, ties counted half.

    Rows are aggregated by score first; running counts go over score ranges in two levels, so no task holds all scores."""
    s = rows.groupBy(*by, "p").agg(F.sum((F.col("y") == 1).cast("long")).alias("a"), F.sum((F.col("y") != 1).cast("long")).alias("b"))
    s = running(s, "p", {"b": "less"}, by=by)
    u = F.sum(F.col("a") * (F.col("less") + F.col("b") / 2.0))
    n1, n0 = F.sum("a"), F.sum("b")
    return s.groupBy(*by).agg(F.when((n1 > 0) & (n0 > 0), pct(u / (n1 * n0))).alias("auc"))


def running(rows: DataFrame, order: str, sums: dict[str, str], buckets: int = 64, by: By = ()) -> DataFrame:
    """Sums of the rows before each (by an ordered double column), in two levels: ranges by quantiles, then inside each.

    Range bounds come from approximate quantiles; sums are exact whatever they are."""
    cuts = rows.select(F.percentile_approx(F.col(order).cast("double"), [k / buckets for k in range(1, buckets)], 1000).alias("q")).first()["q"] or []
    cuts = sorted({float(x) for x in cuts})
    if not cuts:
        bucket = F.lit(0)
    else:
        bucket = F.aggregate(F.array(*[F.lit(c) for c in cuts]), F.lit(0), lambda n, c: n + F.when(F.col(order) > c, 1).otherwise(0))
    tagged = rows.withColumn("gl_bucket", bucket)
    totals = tagged.groupBy(*by, "gl_bucket").agg(*[F.sum(c).alias(f"gl_{c}") for c in sums])
    over = Window.partitionBy(*(by or [F.lit(0)])).orderBy("gl_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most `buckets` rows
    before = totals.select(*by, "gl_bucket", *[F.coalesce(F.sum(f"gl_{c}").over(over), F.lit(0)).alias(f"gl_{c}") for c in sums])
    inner = Window.partitionBy(*by, "gl_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.join(before, [*by, "gl_bucket"])  # a row per run and bucket, so mostly broadcast
    for c, name in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(inner), F.lit(0)) + F.col(f"gl_{c}"))
    return out.drop("gl_bucket", *[f"gl_{c}" for c in sums])


def binary_counts(rows: DataFrame, by: By = ()) -> DataFrame:
    y, p = F.col("y") == 1, F.col("pred") == 1
    return rows.groupBy(*by).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))


def mcc(c: DataFrame, by: By = ()) -> DataFrame:
    """One row mcc (percent): 0 where the denominator is 0, null for a single true class."""
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    value = F.when(den > 0, pct((tp * tn - fp * fn) / den)).otherwise(F.lit(0.0))
    return c.select(*by, F.when((tp + fn > 0) & (tn + fp > 0), value).alias("mcc"))


def majority_vote(rows: DataFrame, by: By = ()) -> DataFrame:
    """(subject, y, vote) of (subject, y, pred): 1, 0, or -1 for a tie."""
    v = rows.groupBy(*by, "subject").agg(F.min("y").alias("y"), F.avg("pred").alias("v"))
    return v.select(*by, "subject", "y", F.when(F.col("v") > 0.5, 1).when(F.col("v") < 0.5, 0).otherwise(-1).alias("vote"))


def gender_metrics(rows: DataFrame, threshold: float = 0.5, names: tuple[str, str] = ("male", "female"), by: By = ()) -> DataFrame:
    """One row over (subject, y, p): acc, bal_acc, auc, mcc, per-class and macro / weighted P, R, F1, acc_subject."""
    d = rows.withColumn("pred", (F.col("p") >= threshold).cast("int"))
    c = binary_counts(d, by)
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    both = (tp + fn > 0) & (tn + fp > 0)
    base = c.select(
        *by, pct((tp + tn) / (tp + tn + fp + fn)).alias("acc"), F.when(both, pct((tp / (tp + fn) + tn / (tn + fp)) / 2)).alias("bal_acc"),
        pct(ratio(tn, tn + fn)).alias(f"precision_{names[0]}"), pct(ratio(tn, tn + fp)).alias(f"recall_{names[0]}"), pct(ratio(2 * tn, 2 * tn + fn + fp)).alias(f"f1_{names[0]}"),
        pct(ratio(tp, tp + fp)).alias(f"precision_{names[1]}"), pct(ratio(tp, tp + fn)).alias(f"recall_{names[1]}"), pct(ratio(2 * tp, 2 * tp + fp + fn)).alias(f"f1_{names[1]}"),
    )
    two = rows.sparkSession.createDataFrame([(0,), (1,)], "cls int")
    wide = prf(class_counts(d.select(*by, F.col("y").cast("int").alias("y"), "pred"), two, by), by)
    votes = majority_vote(d, by).groupBy(*by).agg(pct(F.avg((F.col("y") == F.col("vote")).cast("double"))).alias("acc_subject"))
    return reduce(lambda a, b: beside(a, b, by), [base, roc_auc(d.select(*by, "y", "p"), by), mcc(c, by), wide, votes])


# Clustering


def contingency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cluster", "y").agg(F.count("*").alias("n"))


def cluster_agreement(cont: DataFrame) -> DataFrame:
    """One row of nmi, ari, purity, homogeneity, completeness, v_measure (percent) from (cluster, y, n)."""
    pairs = lambda x: x * (x - 1) / 2.0
    n = F.col("n").cast("double")
    per_c = cont.groupBy("cluster").agg(F.sum("n").alias("a"), F.max("n").alias("m"))
    per_y = cont.groupBy("y").agg(F.sum("n").alias("b"))
    a, b, t = F.col("a").cast("double"), F.col("b").cast("double"), F.col("t")
    ent = lambda c: -F.sum(c / t * F.log(c / t))
    total = cont.agg(F.sum("n").cast("double").alias("t"))
    cc = per_c.crossJoin(F.broadcast(total)).agg(ent(a).alias("hc"), F.sum(pairs(a)).alias("pc"), F.sum("m").alias("best"))
    cy = per_y.crossJoin(F.broadcast(total)).agg(ent(b).alias("hy"), F.sum(pairs(b)).alias("py"))
    joint = cont.join(per_c, "cluster").join(per_y, "y").crossJoin(F.broadcast(total)).agg(
        F.sum(n / t * F.log(n * t / (a * b))).alias("mi"), F.sum(pairs(n)).alias("pn"), F.max("t").alias("t")
    )
    one = joint.crossJoin(cc).crossJoin(cy)
    hom = F.when(F.col("hy") <= 1e-15, F.lit(1.0)).otherwise(F.col("mi") / F.col("hy"))
    com = F.when(F.col("hc") <= 1e-15, F.lit(1.0)).otherwise(F.col("mi") / F.col("hc"))
    one = one.withColumn("h", hom).withColumn("c", com)
    v = F.when(F.col("h") + F.col("c") > 0, 2 * F.col("h") * F.col("c") / (F.col("h") + F.col("c"))).otherwise(F.lit(0.0))
    expected = F.col("pc") * F.col("py") / pairs(F.col("t"))
    top, bottom = F.col("pn") - expected, (F.col("pc") + F.col("py")) / 2 - expected
    return one.select(
        pct(v).alias("nmi"), pct(F.when(bottom == 0, F.lit(1.0)).otherwise(top / bottom)).alias("ari"), pct(F.col("best") / F.col("t")).alias("purity"),
        pct(F.col("h")).alias("homogeneity"), pct(F.col("c")).alias("completeness"), pct(v).alias("v_measure"),
    )


def assignment(weights: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) pairs of the largest total weight, one to one (shortest augmenting paths with potentials)."""
    flip = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if flip else weights).astype(np.float64)
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        dist, via = np.full(m, np.inf), np.full(m, -1)
        used = np.zeros(m, bool)
        row, col = i, -1
        path_rows = []
        lowest = 0.0
        while True:
            reach = lowest + cost[row] - u[row] - v
            better = ~used & (reach < dist)
            dist[better], via[better] = reach[better], col
            free = np.where(used, np.inf, dist)
            col = int(np.argmin(free))
            lowest = float(free[col])
            path_rows.append((row, col))
            used[col] = True
            if row_of[col] < 0:
                break
            row = int(row_of[col])
        done = used & (np.arange(m) != col)
        u[i] += lowest
        for c in np.flatnonzero(done):
            u[row_of[c]] += lowest - dist[c]
            v[c] -= lowest - dist[c]
        while col >= 0:
            prev = int(via[col])
            row_of[col] = row_of[prev] if prev >= 0 else i
            col = prev
    pairs = [(int(r), c) for c, r in enumerate(row_of) if r >= 0]
    return [(c, r) for r, c in pairs] if flip else pairs


def auction(row: np.ndarray, col: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) entries of the largest total weight, one to one, of positive integer weights given as entries: memory by
    entries, not by rows times columns.

    Rows bid for columns; epsilon falls by scaling. So that all can be matched at every epsilon, each row may also take a
    stand-in of its own, and the mirror of the table (a stand-in for each column, which takes that column or the stand-in of a
    row that wants it) takes what is left. With weights times (bidders + 1), an epsilon of 1 is exact."""
    rows, ri = np.unique(row, return_inverse=True)
    cols, ci = np.unique(col, return_inverse=True)
    n, m = len(rows), len(cols)
    total = n + m
    bidder = np.concatenate([ri, np.arange(n), n + np.arange(m), n + ci])
    thing = np.concatenate([ci, m + np.arange(n), np.arange(m), m + ri])
    worth = np.concatenate([weight.astype(np.int64) * (total + 1), np.zeros(n + m + len(ri), np.int64)])
    order = np.argsort(bidder, kind="stable")
    thing, worth = thing[order], worth[order]
    first = np.searchsorted(bidder[order], np.arange(total + 1))
    price, eps = np.zeros(total, np.int64), max(1, int(worth.max(initial=1)) // 4)
    while True:
        owner, has = np.full(total, -1), np.full(total, -1)
        todo = np.arange(total)
        while len(todo):
            per = first[todo + 1] - first[todo]
            at = np.repeat(first[todo], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            starts = np.cumsum(per) - per
            gain = worth[at] - price[thing[at]]
            best = np.maximum.reduceat(gain, starts)
            top = np.flatnonzero(gain == np.repeat(best, per))
            top = top[np.unique(np.repeat(np.arange(len(todo)), per)[top], return_index=True)[1]]  # one of each bidder's best
            gain[top] = np.iinfo(np.int64).min
            bid = price[thing[at[top]]] + best - np.maximum.reduceat(gain, starts) + eps
            want = thing[at[top]]
            rank = np.lexsort((bid, want))
            last = np.flatnonzero(np.r_[want[rank][1:] != want[rank][:-1], True])
            won, by = want[rank][last], todo[rank][last]
            lost = owner[won]
            has[lost[lost >= 0]] = -1
            owner[won], has[by], price[won] = by, won, bid[rank][last]
            todo = np.flatnonzero(has < 0)
        if eps == 1:
            return [(int(rows[i]), int(cols[has[i]])) for i in range(n) if has[i] < m]
        eps = max(1, eps // 5)


def hungarian(cont: DataFrame) -> DataFrame:
    """(cluster, y): the one-to-one mapping with the most agreeing rows.

    Clusters and classes that no rows connect have nothing to share out: each connected component of the contingency is one
    task's assignment, with a dense matrix up to MAX_ASSIGNMENT cells and by auction over its entries beyond."""
    scratch, dense = Scratch(cont.sparkSession), MAX_ASSIGNMENT
    ship(cont.sparkSession)
    cont = scratch.keep(cont.select("cluster", "y", "n"), "contingency")
    node = lambda c, side: F.concat(F.lit(side), F.col(c).cast("string"))
    parts = connected_components(cont.select(node("cluster", "c").alias("a"), node("y", "y").alias("b")), "a", "b", scratch)
    rows = cont.join(parts, node("cluster", "c") == F.col("vertex")).select("label", "cluster", "y", "n")
    schema = "cluster {}, y {}".format(*(cont.schema[k].dataType.simpleString() for k in ("cluster", "y")))

    def solve(t: pd.DataFrame) -> pd.DataFrame:
        (c, cs), (y, ys) = pd.factorize(t["cluster"], sort=True), pd.factorize(t["y"], sort=True)
        n = t["n"].to_numpy()
        if len(cs) * len(ys) <= dense:
            w = np.zeros((len(cs), len(ys)))
            w[c, y] = n
            found = assignment(w)
        else:
            found = auction(c, y, n)
        return pd.DataFrame({"cluster": [cs[a] for a, _ in found], "y": [ys[b] for _, b in found]})

    return rows.groupBy("label").applyInPandas(solve, schema)


def clustering_metrics(rows: DataFrame) -> DataFrame:
    """One row over (y, cluster): acc after the best mapping, agreement measures, P / R / F1 (an unmapped cluster is class -1)."""
    cont = contingency(rows)
    mapped = rows.join(hungarian(cont).withColumnRenamed("y", "m"), "cluster", "left").select("y", F.coalesce("m", F.lit(-1)).alias("pred"))
    acc = mapped.agg(pct(F.avg((F.col("y") == F.col("pred")).cast("double"))).alias("acc"))
    return acc.crossJoin(cluster_agreement(cont)).crossJoin(prf(class_counts(mapped)))


# Identification


def identification_ranks(best: DataFrame, by: By = ()) -> DataFrame:
    """(probe, y, rank, pred): rank = 1 + identities strictly above the true one; pred = true at rank 1, else the best."""
    own = F.max(F.when(F.col("cls") == F.col("y"), F.col("score"))).over(Window.partitionBy(*by, "probe"))
    t = best.withColumn("own", own)
    r = t.groupBy(*by, "probe", "y").agg(F.count_if(F.col("score") > F.col("own")).alias("above"), F.max(F.struct(F.col("score"), (-F.col("cls")).alias("c"))).alias("top"), F.max("own").alias("own"))
    rank = F.col("above") + 1
    return r.filter("own IS NOT NULL").select(*by, "probe", "y", rank.alias("rank"), F.when(rank == 1, F.col("y")).otherwise(-F.col("top.c")).alias("pred"))


def cmc(ranks: DataFrame, n_ids: int, by: By = ()) -> DataFrame:
    """(rank, cmc) for 1..n_ids: a running sum over counts of ranks, one row for each rank and run."""
    per = ranks.groupBy(*by, F.col("rank").cast("long").alias("rank")).agg(F.count("*").alias("n"))
    steps = ranks.sparkSession.range(1, n_ids + 1).select(F.col("id").alias("rank"))
    grid = per.select(*by).distinct().crossJoin(steps) if by else steps
    run = Window.partitionBy(*(by or [F.lit(0)]))
    upto = run.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = per.join(grid, [*by, "rank"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    got = got.select(*by, "rank", F.sum("n").over(upto).alias("s"), F.sum("n").over(run).alias("t"))
    return got.filter(F.col("rank") <= n_ids).select(*by, "rank", pct(F.col("s") / F.when(F.col("t") > 0, F.col("t"))).alias("cmc"))


def rank_summary(ranks: DataFrame, n_ids: int, at: tuple[int, ...] = (1, 5, 10), by: By = ()) -> DataFrame:
    """One row: rank@k, aucmc (closed form of the mean CMC), mrr, P / R / F1 over identities with probes, n_probe."""
    r = F.col("rank")
    cols = [pct(F.avg((r <= k).cast("double"))).alias(f"rank{k}") for k in at]
    cols += [pct(F.avg((n_ids - r + 1) / F.lit(float(n_ids)))).alias("aucmc"), pct(F.avg(1.0 / r)).alias("mrr"), F.count("*").alias("n_probe")]
    return beside(ranks.groupBy(*by).agg(*cols), prf(class_counts(ranks.select(*by, "y", "pred"), by=by), by), by)


# Verification


def verification(genuine: DataFrame, impostor: DataFrame, far: float = 0.01, by: By = ()) -> DataFrame:
    """One row eer, tar_at_far (percent) of (score) tables: thresholds are the scores and one above all; null if a side is empty. A column n
    counts the pairs of a score; without it a row is one."""
    n = lambda d: F.col("n") if "n" in d.columns else F.lit(1).cast("long")
    side = lambda d, g, i: d.select(*by, F.col("score").cast("double").alias("score"), (n(d) * g).alias("g"), (n(d) * i).alias("i"))
    d = side(genuine, 1, 0).unionByName(side(impostor, 0, 1)).groupBy(*by, "score").agg(F.sum("g").alias("g"), F.sum("i").alias("i"))
    total = d.groupBy(*by).agg(F.sum("g").alias("ng"), F.sum("i").alias("ni"))
    top = total.select(*by, F.lit(float("inf")).alias("score"), F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("i"))
    curve = running(d.unionByName(top), "score", {"g": "gb", "i": "ib"}, by=by)
    c = beside(curve, F.broadcast(total), by)  # a row a run
    some = (F.col("ng") > 0) & (F.col("ni") > 0)
    frr, fa = F.when(some, F.col("gb") / F.col("ng")), F.when(some, (F.col("ni") - F.col("ib")) / F.col("ni"))
    c = c.select(*by, "score", frr.alias("frr"), fa.alias("far"))
    met = F.when(F.col("frr").isNotNull(), F.struct(F.abs(F.col("frr") - F.col("far")).alias("d"), F.col("score"), ((F.col("frr") + F.col("far")) / 2).alias("e")))
    return c.groupBy(*by).agg(F.min(met).alias("b"), F.max(F.when(F.col("far") <= far, 1 - F.col("frr"))).alias("t")).select(
        *by, pct(F.col("b.e")).alias("eer"), F.when(F.col("b").isNotNull(), pct(F.coalesce("t", F.lit(0.0)))).alias("tar_at_far")
    )


# Summaries

# 0.975 quantiles of Student's t for 1 to 30 degrees of freedom.
T975 = [
    12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852,
    2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054, 2.085963447,
    2.079613845, 2.073873068, 2.068657610, 2.063898562, 2.059538553, 2.055529439, 2.051830516, 2.048407142, 2.045229642, 2.042272456,
]


def t975(df: Column) -> Column:
    """Quantile of Student's t: from the table, beyond it by the Cornish-Fisher series (error under 1e-6 from 31 on)."""
    z = 1.959963984540054
    g1, g2, g3 = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    d = df.cast("double")
    tail = z + g1 / d + g2 / (d * d) + g3 / (d * d * d) + g4 / (d * d * d * d)
    return F.when(df <= len(T975), F.element_at(F.array(*[F.lit(t) for t in T975]), F.greatest(F.least(df, F.lit(len(T975))), F.lit(1)).cast("int"))).otherwise(tail)


def mean_std(c: str | Column) -> tuple[Column, Column, Column]:
    """(mean, sample deviation with 0 for a single value, count) aggregates; null and NaN values are skipped."""
    v = F.col(c) if isinstance(c, str) else c
    v = F.when(~F.isnan(v), v)
    n = F.count(v)
    return F.avg(v), F.when(n == 1, F.lit(0.0)).otherwise(F.stddev_samp(v)), n


def ci95(std: Column, n: Column) -> Column:
    return F.when(n > 1, t975(n - 1) * std / F.sqrt(n)).when(n == 1, F.lit(0.0))
