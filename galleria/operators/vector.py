"""Vector analytics: prototypes, linear probe, k-means, similarities and pair sampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.functions import expr as X
from galleria.session import Scratch, ship

from . import tiles
from .dedup import centroids
from .metrics import By

#: Most cells (rows x dimensions) of a gallery or prototype table that is broadcast; larger ones are joined in tiles.
MAX_BROADCAST_CELLS = 20_000_000


def meet(many: DataFrame, few: DataFrame, key: str, cells: int, by: By = ()) -> DataFrame:
    """Each row of `many` with each row of `few` of the same run. A `few` of at most MAX_BROADCAST_CELLS goes to all tasks; a
    larger one is cut by `key` into slices of that size and `many` by rows into as many, and each pair of slices is a join key."""
    if cells <= MAX_BROADCAST_CELLS:
        return many.join(F.broadcast(few), list(by)) if by else many.crossJoin(F.broadcast(few))
    n = int(cells // MAX_BROADCAST_CELLS) + 1
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = many.withColumn("gl_i", F.pmod(F.xxhash64("probe"), F.lit(n)).cast("int")).withColumn("gl_j", every)
    right = few.withColumn("gl_j", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn("gl_i", every)
    return left.join(right, [*by, "gl_i", "gl_j"]).drop("gl_i", "gl_j")


def cells_of(vectors: DataFrame, column: str) -> int:
    return vectors.agg(F.coalesce(F.sum(F.size(column).cast("long")), F.lit(0))).first()[0]


def prototypes(support: DataFrame, by: By = ()) -> DataFrame:
    """(cls, c): the normalised mean of normalised support vectors (cls, v)."""
    c = centroids(support.select(*by, F.col("cls").alias("subject"), "v"), by)
    return c.select(*by, F.col("subject").alias("cls"), X.l2_normalize(F.col("c")).alias("c"))


def prototype_scores(support: DataFrame, queries: DataFrame, by: By = ()) -> DataFrame:
    """(probe, cls, score): cosine of every query (probe, v) with every class prototype."""
    p = prototypes(support, by)
    q = queries.select(*by, "probe", X.l2_normalize(F.col("v")).alias("f"))
    return meet(q, p, "cls", cells_of(p, "c"), by).select(*by, "probe", "cls", X.dot(F.col("f"), F.col("c")).alias("score"))


def identity_scores(probes: DataFrame, gallery: DataFrame | None = None, by: By = ()) -> DataFrame:
    """(probe, y, cls, score): the best cosine of each probe with each identity of the gallery, from (id, cls, v) tables.

    Without a gallery the probes are their own, each without itself (leave-one-out); vectors of a class of one are only
    distractors. Blocks of probes meet blocks of the gallery; an area of
    many blocks gives a row per probe and identity, not per pair."""
    scratch = Scratch(probes.sparkSession)
    table = lambda t, *more: tiles.spread(t).select(*by, "id", "cls", *tiles.unit(t), *more)
    if gallery is None:
        sizes = probes.groupBy(*by, "cls").agg((F.count("*") == 1).alias("alone"))
        left, right = tiles.blocks(table(probes.join(sizes, [*by, "cls"]), "alone"), scratch, by), None
    else:
        left, right = tiles.blocks(table(probes), scratch, by), tiles.blocks(table(gallery), scratch, by)
    own = right is None

    def area(xs, ys: list[tiles.Block], met):
        names, codes = np.unique(np.concatenate([y.flat("cls") for y in ys]), return_inverse=True)
        sides, done = [], 0
        for y in ys:
            code = codes[done : done + len(y)]
            done += len(y)
            order = np.argsort(code, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
            sides.append((y.number, y.matrix()[order], np.argsort(order), starts, code[order][starts]))
        for x in xs:
            ours = x.matrix()
            use = np.arange(len(x)) if not own else np.flatnonzero(~x.flat("alone"))
            for i in range(0, len(use), tiles.STEP):
                at = use[i : i + tiles.STEP]
                best = np.full((len(at), len(names)), -np.inf)
                for number, theirs, place, starts, code in sides:
                    s = ours[at] @ theirs.T
                    if own and x.number == number:
                        s[np.arange(len(at)), place[at]] = -np.inf
                    best[:, code] = np.maximum(best[:, code], np.maximum.reduceat(s, starts, axis=1))
                p, c = np.nonzero(best > -np.inf)
                yield [x.column("id").take(pa.array(at[p])), x.column("cls").take(pa.array(at[p])), names[c], best[p, c]]

    kind = lambda t, c: t.schema[c].dataType.simpleString()
    ddl = f"probe {kind(probes, 'id')}, y {kind(probes, 'cls')}, cls {kind(probes if gallery is None else gallery, 'cls')}, score double"
    found = tiles.meet(left, right, area, ddl, tuple(by), every=True, whole=True)
    return found.groupBy(*by, "probe", "y", "cls").agg(F.max("score").alias("score"))


#: Ranges of scores that a pass counts in, and scores of a range that are looked at one by one.
RANGES, FEW = 4096, 20_000
#: Digits to which rounded scores are counted as whole numbers: a task counts 2 * 10**digits / RANGES of them for a range.
MOST_DIGITS = 8


def _tile_scores(x: tiles.Block, y: tiles.Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(scores, whether genuine) of the pairs of two blocks, strip by strip; each pair of a block once."""
    a, b, ca, cb = x.matrix(), y.matrix(), x.flat("cls"), y.flat("cls")
    place, same = np.arange(len(y))[None, :], x.number == y.number
    for i in range(0, len(x), tiles.STEP):
        s, own = a[i : i + tiles.STEP] @ b.T, ca[i : i + tiles.STEP, None] == cb[None, :]
        if same:
            ok = place > np.arange(i, i + len(s))[:, None]
            yield s[ok], own[ok]
        else:
            yield s.ravel(), own.ravel()


def _count_pairs(blocks: DataFrame, digits: int | None, cuts: list[np.ndarray], few: bool) -> list:
    """Rows (range, or score if few; genuine; impostor) of all pairs with a score in the cuts (from the first on, below the last)."""

    def tile(x: tiles.Block, y: tiles.Block):
        for v, g in _tile_scores(x, y):
            v = v if digits is None else np.round(v, digits) + 0.0
            for k, cut in enumerate(cuts):
                inside = (v >= cut[0]) & (v < cut[-1])
                w, h = v[inside], g[inside]
                kinds, code = np.unique(w if few else np.searchsorted(cut, w, "right") - 1, return_inverse=True)
                n, m = (np.bincount(code, weights=z, minlength=len(kinds)).astype(np.int64) for z in (h, ~h))
                yield [np.full(len(kinds), k), kinds.astype(np.float64), n, m]

    return _summed(tiles.meet(blocks, None, tile, "k int, at double, g long, i long"))


def _summed(found: DataFrame) -> list:
    return found.groupBy("k", "at").agg(F.sum("g").alias("g"), F.sum("i").alias("i")).orderBy("k", "at").collect()


def _count_rounded(blocks: DataFrame, digits: int, width: int, ranges: list[int] | None = None) -> list:
    """Rows (k, at, genuine, impostor) of all pairs whose score is rounded to so many digits, so that scores are whole numbers:
    counts by ranges of `width` numbers (at: the range), or of each number (at) in some ranges (k: the place of the range)."""
    scale, zero = 10.0**digits, 10.0**digits + 0.5 + width  # scores are counted from -1 on, one range below it
    n_ranges = int((2 * zero) // width) + 2

    def area(xs, ys: list[tiles.Block], met):
        shape = (2, n_ranges) if ranges is None else (2, len(ranges) * (width + 1))
        counts = np.zeros(shape, np.int64)
        for x in xs:
            for y in ys:
                if not met(x, y):
                    continue
                for v, g in _tile_scores(x, y) if ranges is None else _near_scores(x, y, [((k * width - zero) / scale, ((k + 1) * width - zero) / scale) for k in ranges]):
                    t = v * scale + zero
                    at = (t / width).astype(np.int32)
                    if ranges is None:
                        counts[1] += np.bincount(at, minlength=n_ranges)
                        counts[0] += np.bincount(at[g], minlength=n_ranges)
                        continue
                    for j, k in enumerate(ranges):
                        inside = at == k
                        place = np.clip(t[inside].astype(np.int64) - k * width, 0, width) + j * (width + 1)
                        counts[1] += np.bincount(place, minlength=shape[1])
                        counts[0] += np.bincount(place[g[inside]], minlength=shape[1])
        at = np.flatnonzero(counts[1])
        k, number = (np.zeros(len(at), int), at) if ranges is None else np.divmod(at, width + 1)
        yield [k, number.astype(np.float64), counts[0][at], counts[1][at] - counts[0][at]]

    return _summed(tiles.meet(blocks, None, area, "k int, at double, g long, i long", whole=True))


def _near_scores(x: tiles.Block, y: tiles.Block, spans: list[tuple[float, float]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(scores, whether genuine) of the pairs of two blocks that may lie in a span: found in single precision, computed in double."""
    a, b, ca, cb = x.matrix(), y.matrix(), x.flat("cls"), y.flat("cls")
    slack, b32 = tiles.single_slack(a.shape[1]), b.astype(np.float32)
    for i in range(0, len(x), tiles.STEP):
        s = (a[i : i + tiles.STEP].astype(np.float32) @ b32.T).ravel()
        inside = np.zeros(len(s), bool)
        for low, high in spans:
            inside |= (s >= np.float32(low - slack)) & (s <= np.float32(high + slack))
        p, q = np.divmod(np.flatnonzero(inside), len(y))
        if x.number == y.number:
            once = q > p + i
            p, q = p[once], q[once]
        for j in range(0, len(p), 1 << 16):
            r, t = p[j : j + (1 << 16)] + i, q[j : j + (1 << 16)]
            yield np.einsum("ij,ij->i", a[r], b[t]), ca[r] == cb[t]


def verification_of_all_pairs(vectors: DataFrame, far: float = 0.01, digits: int | None = None) -> DataFrame:
    """One row eer, tar_at_far (percent) over all pairs of (id, cls, v), as metrics.verification has them, without a table of pairs.

    Tiles count genuine and impostor scores by ranges; only the ranges are kept in which the error rates cross and the false
    accepts fall to the target, and these are cut anew until their scores are few. A pass returns RANGES rows at most. Rounded to digits, scores are whole
    numbers: the second pass counts each number of the ranges kept."""
    n = tiles.spread(vectors).select("id", "cls", *tiles.unit(vectors))
    blocks = tiles.blocks(n, Scratch(vectors.sparkSession))
    cut = np.linspace(-1.0 - 1e-6, 1.0 + 1e-6, RANGES + 1)
    width = None if digits is None or digits > MOST_DIGITS else max(1, -(-2 * 10**digits // RANGES))
    rows = _count_pairs(blocks, digits, [cut], False) if width is None else _count_rounded(blocks, digits, width)
    genuine, impostor = sum(r["g"] for r in rows), sum(r["i"] for r in rows)
    if not genuine or not impostor:
        return vectors.sparkSession.createDataFrame([(None, None)], "eer double, tar_at_far double")
    frr, accept = (lambda g: g / genuine), (lambda i: (impostor - i) / impostor)  # of the numbers of scores below a threshold
    crossed = {"eer": lambda g, i: frr(g) >= accept(i), "tar": lambda g, i: accept(i) <= far}

    def narrow(rows: list, below: tuple[int, int], test) -> tuple[float, tuple[int, int], int]:
        """(the range after which the test first holds, counts below it, scores in it)."""
        g, i = below
        for r in rows:
            if test(g + r["g"], i + r["i"]):
                return r["at"], (g, i), r["g"] + r["i"]
            g, i = g + r["g"], i + r["i"]
        raise AssertionError("the test holds above all scores")

    state = {}
    for name, test in crossed.items():
        k, below, many = narrow(rows, (0, 0), test)
        state[name] = (cut[int(k)], cut[int(k) + 1], below, many) if width is None else (int(k), None, below, many)
    exact: dict[str, list] = {}
    if width is not None:
        found = _count_rounded(blocks, digits, width, [state[x][0] for x in state])
        exact = {x: [r for r in found if r["k"] == k] for k, x in enumerate(state)}
    while len(exact) < len(state):
        open_ = [x for x in state if x not in exact]
        few = {x: state[x][3] <= FEW or np.nextafter(state[x][0], 2) >= state[x][1] for x in open_}
        for mode in (True, False):
            names = [x for x in open_ if few[x] == mode]
            if not names:
                continue
            cuts = [np.array(state[x][:2]) if mode else np.unique(np.linspace(*state[x][:2], RANGES + 1)) for x in names]
            found = _count_pairs(blocks, digits, cuts, mode)
            for k, x in enumerate(names):
                own = [r for r in found if r["k"] == k]
                if mode:
                    exact[x] = own
                else:
                    at, below, many = narrow(own, state[x][2], crossed[x])
                    state[x] = (cuts[k][int(at)], cuts[k][int(at) + 1], below, many)
    # A threshold is a score; what it accepts is counted below it. After the last score of a range the next one stands.
    steps = {}
    for x, own in exact.items():
        g, i = state[x][2]
        steps[x] = [(g, i)]
        for r in own:
            g, i = g + r["g"], i + r["i"]
            steps[x].append((g, i))
    eer = min(((abs(frr(g) - accept(i)), k, (frr(g) + accept(i)) / 2) for k, (g, i) in enumerate(steps["eer"])))[2]
    tar = next((1 - frr(g) for g, i in steps["tar"] if accept(i) <= far), 0.0)
    return vectors.sparkSession.createDataFrame([(100.0 * eer, 100.0 * tar)], "eer double, tar_at_far double")


#: Ids of a piece of a class at least, and pieces of a class at most: an id is sent once for each piece of its class.
PIECE, PIECES = 1000, 16


def _all_genuine_pairs(vectors: DataFrame) -> DataFrame:
    """(id_a, id_b) of all pairs within a class: pieces of a class meet in pairs, each pair of pieces a join key, so that a class
    of any size is dealt to many tasks."""
    spark = vectors.sparkSession
    rows = vectors.select("cls", "id")
    sizes = rows.groupBy("cls").agg(F.least(F.lit(PIECES), F.ceil(F.count("*") / PIECE)).cast("int").alias("gl_n"))
    cut = rows.join(sizes, "cls").withColumn("gl_k", F.pmod(F.xxhash64("id"), F.col("gl_n")).cast("int"))
    width = max(16 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = ["cls", "i", "j"]
    x = cut.select("cls", F.col("id").alias("x"), F.col("gl_k").alias("i"), F.explode(F.expr("sequence(gl_k, gl_n - 1)")).alias("j"))
    y = cut.select("cls", F.col("id").alias("y"), F.col("gl_k").alias("j"), F.explode(F.expr("sequence(0, gl_k)")).alias("i"))
    met = x.repartition(width, *keys).join(y.repartition(width, *keys), keys).filter("x < y OR (i < j AND x > y)")
    return met.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def genuine_pairs(vectors: DataFrame, cap: int | None = None, seed: int = 0) -> DataFrame:
    """(id_a, id_b) within a class, id_a < id_b; with a cap a sample of them without repeats, of which no other pair is listed.

    The pairs of all classes are numbered: a class has those from the sum of n (n - 1) / 2 of the classes before it. Numbers are
    drawn by hash, without repeats the first `cap`; a number gives its class by its range and its two members by a square root."""
    if cap is None:
        return _all_genuine_pairs(vectors)
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    place = F.row_number().over(Window.partitionBy("cls").orderBy("id")) - 1
    members = scratch.keep(vectors.select("cls", "id", place.cast("long").alias("place")), "members")
    sizes = members.groupBy("cls").agg(F.count("*").alias("n")).filter("n > 1").withColumn("pairs", F.expr("n * (n - 1) div 2"))
    before = F.coalesce(F.sum("pairs").over(Window.partitionBy(F.lit(0)).orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per class
    ranges = scratch.keep(sizes.withColumn("first", before), "classes")
    total = ranges.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]
    if total <= cap:
        return genuine_pairs(vectors)
    # Ranges of numbers: a class lies in those that it overlaps, so numbers find their class by an equi-join.
    width = -(-total // NUMBER_RANGES)
    spread = ranges.withColumn("range", F.explode(F.expr(f"sequence(first div {width}, (first + pairs - 1) div {width})")))
    numbers = _drawn_numbers(spark, total, cap, seed).withColumn("range", F.expr(f"number div {width}"))
    drawn = numbers.join(spread, "range").filter("number >= first AND number < first + pairs")
    place_of = F.expr("number - first")
    high = F.floor((1 + F.sqrt(1.0 + 8.0 * place_of)) / 2).cast("long")  # the larger place j has the numbers from j (j - 1) / 2 on
    drawn = drawn.withColumn("k", place_of).withColumn("j", high)
    fix = F.when(F.expr("j * (j - 1) div 2 > k"), F.col("j") - 1).when(F.expr("(j + 1) * j div 2 <= k"), F.col("j") + 1).otherwise(F.col("j"))
    drawn = drawn.withColumn("j", fix).withColumn("i", F.expr("k - j * (j - 1) div 2")).select("cls", "i", "j")
    one = lambda side, out: members.select("cls", F.col("place").alias(side), F.col("id").alias(out))
    return drawn.join(one("i", "id_a"), ["cls", "i"]).join(one("j", "id_b"), ["cls", "j"]).select("id_a", "id_b")


#: Ranges of pair numbers in which classes are looked up.
NUMBER_RANGES = 4096


def _drawn_numbers(spark, total: int, cap: int, seed: int) -> DataFrame:
    """cap different numbers below total (which is larger): draws by hash, repeats left out, the first of the rest."""
    if total <= 4 * cap:
        return spark.range(total).select(F.col("id").alias("number")).orderBy(X.hashed(seed, "number"), "number").limit(cap)
    draw = F.pmod(F.conv(F.substring(X.hashed(seed, F.lit("genuine"), "draw"), 1, 15), 16, 10).cast("long"), F.lit(total))
    draws = spark.range(4 * cap + 64).select(F.col("id").alias("draw")).select("draw", draw.alias("number"))
    return draws.groupBy("number").agg(F.min("draw").alias("draw")).orderBy("draw").limit(cap).select("number")


def numbered(rows: DataFrame, order: str, out: str, ranges: int = 64) -> DataFrame:
    """Numbers from 0 in the order of a numeric column without ties: inside ranges, from where the ranges before it end."""
    cuts = rows.select(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 1000).alias("q")).first()["q"] or []
    cut = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    tagged = rows.withColumn("gl_r", cut)
    upto = Window.partitionBy(F.lit(0)).orderBy("gl_r").rowsBetween(Window.unboundedPreceding, -1)  # at most `ranges` rows
    start = tagged.groupBy("gl_r").agg(F.count("*").alias("n")).select("gl_r", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("gl_s"))
    inside = F.row_number().over(Window.partitionBy("gl_r").orderBy(order)) - 1
    return tagged.withColumn("gl_k", inside).join(start, "gl_r").withColumn(out, F.col("gl_s") + F.col("gl_k")).drop("gl_r", "gl_s", "gl_k")


def impostor_pairs(vectors: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, id_a, id_b): 3 n draws with replacement by hash over positions, those of different classes, the first n."""
    total = vectors.count()
    pos = numbered(vectors.select("id", "cls"), "id", "pos")
    at = lambda s: F.pmod(F.conv(F.substring(X.hashed(seed, F.lit(s), "draw"), 1, 12), 16, 10).cast("long"), F.lit(total))
    draws = vectors.sparkSession.range(3 * n).select(F.col("id").alias("draw")).select("draw", at("a").alias("pa"), at("b").alias("pb"))
    got = draws.join(pos.toDF("id_a", "ca", "pa"), "pa").join(pos.toDF("id_b", "cb", "pb"), "pb").filter("pa <> pb AND ca <> cb")
    return got.orderBy("draw").limit(n).select("draw", "id_a", "id_b")


def pair_scores(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (id_a, id_b) with the cosine of their vectors."""
    n = vectors.select("id", X.l2_normalize(F.col("v")).alias("f"))
    return pairs.join(n.toDF("id_a", "fa"), "id_a").join(n.toDF("id_b", "fb"), "id_b").withColumn("score", X.dot(F.col("fa"), F.col("fb"))).drop("fa", "fb")


def kmeans(vectors: DataFrame, k: int, seed: int, max_iter: int = 300, id_col: str = "id") -> DataFrame:
    """(id, cluster) by distributed Lloyd iterations on normalised vectors.

    The rows are not cached here: then the fit keeps its own vectors, ready to use, where a cached table would be decoded again
    in every iteration."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(id_col, array_to_vector(X.l2_normalize(F.col("v"))).alias("features"))
    n = rows.count()
    if not 1 <= k <= n:
        raise ValueError(f"k must lie in 1..{n}")
    if k == 1:
        return rows.select(id_col, F.lit(0).alias("cluster"))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, initSteps=2, solver="row").fit(rows)
    return model.transform(rows).select(id_col, F.col("prediction").alias("cluster"))


def linear_probe(support: DataFrame, val: DataFrame, queries: DataFrame, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0), max_iter: int = 200) -> tuple[DataFrame, float]:
    """((probe, cls, score), C): multinomial logistic regression on normalised vectors with L2; C is chosen on val (the smallest
    of equals), the model is fitted on support alone. Tables: support and val (cls, v), queries (probe, v)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def rows(d: DataFrame, *keep: str) -> DataFrame:
        return d.select(*keep, array_to_vector(X.l2_normalize(F.col("v"))).alias("features"))

    classes = [r["cls"] for r in support.select("cls").distinct().orderBy("cls").collect()]
    if len(classes) < 2:
        raise ValueError("a linear probe needs two classes")
    code = F.create_map(*[x for k, c in enumerate(classes) for x in (F.lit(c), F.lit(float(k)))])
    train = rows(support.withColumn("label", code[F.col("cls")]), "label").cache()
    held = rows(val.withColumn("label", code[F.col("cls")]), "label").filter("label IS NOT NULL").cache()
    n, best = train.count(), None
    for c in sorted(grid):
        lr = LogisticRegression(family="multinomial", elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * n), maxIter=max_iter, tol=1e-8)
        model = lr.fit(train)
        acc = model.transform(held).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
        if best is None or acc > best[0] + 1e-12:
            best = (acc, c, model)
    train.unpersist()
    held.unpersist()
    back = F.array(*[F.lit(c) for c in classes])
    scored = best[2].transform(rows(queries, "probe")).select("probe", F.posexplode(vector_to_array("probability")).alias("k", "score"))
    return scored.select("probe", F.element_at(back, F.col("k") + 1).alias("cls"), "score"), best[1]


def few_probe(z: np.ndarray, y: np.ndarray, reg: float, max_iter: int = 100) -> tuple[np.ndarray, float]:
    """(w, b) of the logistic regression of 0/1 labels on few rows: Newton steps, halved where they do not descend, on mean loss
    + reg / 4 |w|^2, which is linear_probe's objective for two classes."""
    n, d = z.shape
    a, t = np.hstack([z, np.ones((n, 1))]), 2.0 * y - 1.0
    ridge = np.r_[np.full(d, reg / 2), 0.0]
    loss = lambda x: np.logaddexp(0, -t * (a @ x)).mean() + x @ (ridge * x) / 2
    x = np.zeros(d + 1)
    for _ in range(max_iter):
        p = 0.5 * (1 + np.tanh(a @ x / 2))
        grad = a.T @ (p - y) / n + ridge * x
        step = np.linalg.lstsq((a.T * (p * (1 - p) / n)) @ a + np.diag(ridge), grad, rcond=None)[0]
        size, now = 1.0, loss(x)
        while loss(x - size * step) > now and size > 1e-9:
            size /= 2
        x = x - size * step
        if np.abs(size * step).max() < 1e-12:
            break
    return x[:-1], float(x[-1])


def few_probes(support: DataFrame, val: DataFrame, by: By, val_by: By, grid: tuple[float, ...] = (0.01, 0.1, 1.0, 10.0)) -> DataFrame:
    """(by, w, b): the linear probe of each run, whose support (by, cls 0 or 1, v) is a few rows of both classes: a run is one group
    and its fits one task's, instead of a fit of many jobs each. C is chosen on val (val_by, cls, v), the smallest of equals."""
    ship(support.sparkSession)

    def fit(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["cls", "f"], key=lambda c: c if c.name == "cls" else c.map(tuple))
        f, y = np.stack(t["f"].to_list()), t["cls"].to_numpy().astype(float)
        # w lies in the span of the rows.
        base = np.linalg.qr(f.T)[0]
        fits = [few_probe(f @ base, y, 1.0 / (c * len(y))) for c in sorted(grid)]
        run = {k: t[k].iloc[0] for k in by}
        return pd.DataFrame([{**run, "c": c, "w": (base @ w).tolist(), "b": b} for c, (w, b) in zip(sorted(grid), fits, strict=True)])

    rows = support.select(*by, "cls", X.l2_normalize(F.col("v")).alias("f"))
    schema = T.StructType([support.schema[k] for k in by]).add("c", "double").add("w", T.ArrayType(T.DoubleType())).add("b", "double")
    fits = Scratch(support.sparkSession).keep(rows.groupBy(*by).applyInPandas(fit, schema), "probes")
    held = val.select(*val_by, F.col("cls").alias("y"), X.l2_normalize(F.col("v")).alias("f"))
    right = ((X.dot(F.col("f"), F.col("w")) + F.col("b") > 0).cast("int") == F.col("y")).cast("double")
    tried = held.join(F.broadcast(fits), list(val_by)).groupBy(*by, "c").agg(F.round(F.avg(right), 12).alias("acc"))
    scored = fits.join(tried, [*by, "c"], "left").withColumn("acc", F.coalesce("acc", F.lit(0.0)))
    best = scored.groupBy(*by).agg(F.max(F.struct("acc", (-F.col("c")).alias("o"), "w", "b")).alias("x"))
    return best.select(*by, "x.w", "x.b")
