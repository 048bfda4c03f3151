"""Literal cases and contracts of the operators."""

import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleria.functions import expr as X
from galleria.operators import catalog, dedup, hamming, metrics, splits, summary, tiles, vector
from galleria.operators.graph import connected_components
from galleria.session import Scratch


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_hamming_cross_and_popcount(spark):
    a = spark.createDataFrame([(0, 0), (1, 1), (2, -1)], "id long, h long")
    b = spark.createDataFrame([(0, 3), (1, -2)], "id long, h long")
    assert rows(dedup.hamming_pairs(a, 1, b).select("id_a", "id_b")) == [(1, 0), (2, 1)]
    bits = spark.createDataFrame([(0,), (1,), (3,), (-1,)], "h long").select(X.hamming64(F.col("h"), F.lit(0)))
    assert [r[0] for r in bits.collect()] == [0, 1, 2, 64]


@pytest.mark.parametrize("distance", [0, 3, 6, 10, 12, 20])
@pytest.mark.parametrize("probed", [None, True, False])
def test_hamming_pairs_equal_brute_force(spark, distance, probed, monkeypatch):
    if probed and distance > 12:
        pytest.skip("more probes than pairs")
    monkeypatch.setattr(tiles, "LEAST", 16)
    r = random.Random(distance)
    hs = [r.getrandbits(64) for _ in range(60)]
    hs += [h ^ sum(1 << b for b in r.sample(range(64), r.randint(0, distance + 2))) for h in hs]
    signed = [h - (1 << 64) if h >> 63 else h for h in hs]
    df = spark.createDataFrame([*enumerate(signed), (500, None)], "id long, h long")
    want = {(i, j) for i, j in itertools.combinations(range(len(hs)), 2) if (hs[i] ^ hs[j]).bit_count() <= distance}
    got = rows(dedup.hamming_pairs(df, distance, probed=probed))
    assert len(got) == len(want) and {(x, y) for x, y, _ in got} == want and all(d == (hs[x] ^ hs[y]).bit_count() for x, y, d in got)
    even, odd = df.filter("id % 2 = 0"), df.filter("id % 2 = 1")
    cross = rows(dedup.hamming_pairs(even, distance, odd, probed=probed).select("id_a", "id_b"))
    assert cross == rows(spark.createDataFrame([(i, j) for i in range(0, len(hs), 2) for j in range(1, len(hs), 2) if (hs[i] ^ hs[j]).bit_count() <= distance] or [(-1, -1)], "a long, b long").filter("a >= 0"))


def test_hamming_of_few_varying_bits(spark):
    """Hashes of two bits, one of them constant, and equal hashes: every pair within the distance, no constant band."""
    for values, distance in (([0, 1, 1, 0, 1], 1), ([5] * 6, 3), ([0, 8, 0, 24], 1)):
        df = spark.createDataFrame(list(enumerate(values)), "id long, h long")
        want = sorted((i, j) for i, j in itertools.combinations(range(len(values)), 2) if (values[i] ^ values[j]).bit_count() <= distance)
        assert rows(dedup.hamming_pairs(df, distance).select("id_a", "id_b")) == want


def test_a_larger_table_takes_wider_bands():
    odds = dict.fromkeys(range(64), 0.5)
    for n in (10**5, 10**6, 10**9):
        bands = hamming.plan(odds, 10, n, n)
        assert sum(b.radius + 1 for b in bands) == 11 and sorted(k for b in bands for k in b.bits) == list(range(64))
    assert hamming.plan(odds, 30, 1000, 1000) is None and hamming.plan({}, 3, 1000, 1000) is None


def unit(r, n, d=64):
    v = r.normal(size=(n, d))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("least", [0.1, 0.6, 0.9, 0.99])
def test_cosine_pairs_equal_brute_force(spark, least, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 16)
    r = np.random.default_rng(int(least * 100))
    v = unit(r, 90, 16)
    v = np.concatenate([v, v[:40] + r.normal(size=(40, 16)) * r.choice([0.02, 0.05, 0.1, 0.2], (40, 1)), np.zeros((1, 16)), v[:3]])
    n = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    s = n @ n.T
    df = spark.createDataFrame([(f"i{k:03d}", f"s{k % 3}", x.tolist()) for k, x in enumerate(v)], "id string, subject string, v array<double>")
    name = lambda p: {(f"i{i:03d}", f"i{j:03d}") for i, j in p}
    every = [(i, j) for i, j in itertools.combinations(range(len(v)), 2) if s[i, j] >= least]
    found = lambda got: {(a, b) for a, b, _ in got}
    got = rows(dedup.cross_cosine_pairs(df.select("id", "v"), None, least))
    assert len(got) == len(every) and found(got) == name(every) and all(abs(c - s[int(a[1:]), int(b[1:])]) < 1e-9 for a, b, c in got)
    assert found(rows(dedup.cosine_pairs_within_groups(df, least))) == name([(i, j) for i, j in every if i % 3 == j % 3])
    a, b = df.filter("id < 'i060'").select("id", "v"), df.filter("id >= 'i060'").select("id", "v")
    assert found(rows(dedup.cross_cosine_pairs(a, b, least))) == name([(i, j) for i, j in every if i < 60 <= j])


def test_close_pairs_compute_a_tenth():
    """Of random directions with near copies, few pairs are worth a product at a cosine of 0.9."""
    r = np.random.default_rng(3)
    x = unit(r, 700)
    y = x + r.normal(size=x.shape) * 0.03
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    p, q, c, computed = tiles.cosines(x, y, 0.9)
    want = np.argwhere(x @ y.T >= 0.9)
    assert sorted(zip(p.tolist(), q.tolist())) == sorted(map(tuple, want.tolist())) and len(want) >= 700
    assert computed < 0.1 * len(x) * len(y)


def test_far_rings_do_not_meet(spark, monkeypatch):
    """Two bundles of directions at a right angle: no tile holds blocks of both."""
    monkeypatch.setattr(tiles, "LEAST", 8)
    r = np.random.default_rng(4)
    v = np.concatenate([np.eye(6)[[k]] + r.normal(size=(64, 6)) * 0.01 for k in (0, 3)])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    met = []
    meet = tiles.meet

    def spy(left, right, kernel, ddl, by=(), reach=None, every=False):
        seen = lambda x, y: iter([[x.column("id")[:1], y.column("id")[:1]]])
        met.extend(meet(left, right, seen, "a long, b long", by, reach, every).collect())
        return meet(left, right, kernel, ddl, by, reach, every)

    monkeypatch.setattr(tiles, "meet", spy)
    assert dedup.cross_cosine_pairs(df, None, 0.9).count() == 2 * 64 * 63 // 2
    assert met and all((r["a"] < 64) == (r["b"] < 64) for r in met)


@pytest.mark.parametrize("every", [False, True])
def test_blocks_are_sent_once_a_strip(spark, every, monkeypatch):
    """40 blocks: all pairs of blocks meet, and a block is in as many areas as there are strips, not in one for each block."""
    monkeypatch.setattr(tiles, "STRIPS", 4)
    rows_ = [(b, [{"id": b * 10 + k} for k in range(2)]) for b in range(40)]
    blocks = spark.createDataFrame(rows_, "block int, items array<struct<id:long>>")

    def area(xs, ys, met):
        xs = list(xs)
        yield [[len(xs) + len(ys)], [sum(met(x, y) for x in xs for y in ys)]]

    got = tiles.meet(blocks, None, area, "sent long, pairs long", every=every, whole=True).toPandas()
    assert got["pairs"].sum() == (1600 if every else 820) and got["sent"].sum() <= 2 * 40 * 4


def test_rounded_scores_take_two_passes(spark, monkeypatch):
    """Six digits: ranges, then the numbers of the two ranges kept."""
    passes, meet = [], tiles.meet
    monkeypatch.setattr(vector, "FEW", 3)
    monkeypatch.setattr(tiles, "meet", lambda *a, **k: passes.append(1) or meet(*a, **k))
    v = unit(np.random.default_rng(8), 60, 8)
    df = spark.createDataFrame([(k, k % 3, x.tolist()) for k, x in enumerate(v)], "id long, cls long, v array<double>")
    assert vector.verification_of_all_pairs(df, 0.1, 6).count() == 1 and len(passes) == 2


def test_matched_subjects_equal_overlap_of_pairs(spark, monkeypatch):
    """Items and subjects that match, of areas: an item and a subject once, and the overlap that the pairs give."""
    monkeypatch.setattr(tiles, "LEAST", 8)
    v = unit(np.random.default_rng(11), 80, 6)
    df = spark.createDataFrame([(k, k % 4, x.tolist()) for k, x in enumerate(v)], "id long, subject long, v array<double>")
    df = df.withColumn("h", F.expr("id * 37 % 64"))
    a, b, s = df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), df.select("id", "subject")
    cosines = dedup.cross_cosine_pairs(a.select("id", "v"), b.select("id", "v"), 0.3)
    near = dedup.hamming_pairs(a.select("id", "h"), 1, b.select("id", "h"))
    for pairs, matched in ((cosines, dedup.matched_by_cosine(a, b, 0.3)), (near, dedup.matched_by_hash(a, b, 1))):
        assert rows(matched.distinct()) == rows(pairs.join(s.toDF("id_b", "subject_b"), "id_b").select("id_a", "subject_b").distinct())
        assert rows(dedup.overlap_of_matched(matched, s, 2)) == rows(dedup.subject_overlap(pairs, s, s, 2))


def test_a_norm_is_computed_once_a_vector(spark):
    """The element's expression holds the norm as a value; zero, empty and missing vectors stay."""
    data = [([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)]
    df = spark.createDataFrame(data, "v array<double>").select(X.l2_normalize(F.col("v")).alias("n"))
    assert [r["n"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    assert tree.lower().count("sqrt(") == 1


def test_unknown_sizes_count_as_small(spark):
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "id_a long, id_b long")
    sizes = spark.createDataFrame([(0, 30), (1, 40), (2, None)], "id long, min_side int")
    assert rows(dedup.drop_small(pairs, sizes, 24).select("id_a", "id_b")) == [(0, 1)]


def test_groups_merge_within_subjects_only(spark):
    items = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a"), (3, "a"), (4, "b")], "id long, subject string")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "id_a long, id_b long")
    assert rows(dedup.duplicate_groups(items, pairs).select("id", "grp")) == [(0, 0), (1, 0), (2, 0), (3, 3), (4, 4)]
    empty = pairs.limit(0)
    assert rows(dedup.duplicate_groups(items, empty).select("id", "grp")) == [(k, k) for k in range(5)]


def test_components_of_a_long_chain(spark):
    n = 60
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    e = spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(n - 1)], "src long, dst long")
    assert {r["label"] for r in connected_components(e).collect()} == {0}


def test_identical_chain(spark):
    d = spark.createDataFrame(list(enumerate(["a", "b", "a", "", "", "a", "c", "b"])), "id long, digest string")
    assert rows(dedup.identical_file_pairs(d)) == [(0, 2), (1, 7), (2, 5)]


def test_leakage(spark):
    t = spark.createDataFrame([("s", 0, "train"), ("s", 0, "test"), ("s", 2, "test"), ("s", 2, "val")], "subject string, grp long, split string")
    r = dedup.leakage_report(t).first()
    assert (r["n_test"], r["n_test_with_train_duplicate"], r["test_leakage_rate"]) == (2, 1, 0.5)
    assert dedup.leakage_report(t.filter("split = 'train'")).first()["test_leakage_rate"] == 0.0


def test_outliers(spark):
    r = np.random.default_rng(0)
    v = [(k, "a", [1.0, 0.001 * float(r.normal()), 0.0]) for k in range(30)]
    v[7] = (7, "a", [0.0, 0.0, 1.0])
    v += [(100, "b", [1.0, 0.0, 0.0]), (101, "b", [0.0, 1.0, 0.0])]
    got = {x["id"]: x["z"] for x in dedup.outlier_scores(spark.createDataFrame(v, "id long, subject string, v array<double>")).collect()}
    assert min((z, i) for i, z in got.items() if z is not None)[1] == 7 and got[7] < -3
    assert got[100] is None and got[101] is None


def test_overlap(spark):
    r = random.Random(6)
    of_a, of_b = [r.choice("uvw") for _ in range(25)], [r.choice("klm") for _ in range(25)]
    met = {(r.randrange(25), r.randrange(25)) for _ in range(60)}
    images = {}
    for i, j in met:
        images.setdefault((of_a[i], of_b[j]), set()).add(i)
    a, b = (spark.createDataFrame(list(enumerate(x)), "id long, subject string") for x in (of_a, of_b))
    for least in (1, 4, 99):
        got = rows(dedup.subject_overlap(spark.createDataFrame(sorted(met), "id_a long, id_b long"), a, b, least))
        assert got == sorted((*k, len(x)) for k, x in images.items() if len(x) >= least)


def test_identity_metrics(spark):
    r = random.Random(9)
    y = [r.randrange(12) for _ in range(80)]
    scores = [[round(r.random(), 1) + (0.4 if c == k else 0) for c in range(12)] for k in y]
    order = [sorted(range(12), key=lambda c: (-s[c], c)) for s in scores]
    df = spark.createDataFrame([(i, c, x) for i, s in enumerate(scores) for c, x in enumerate(s)], "probe long, cls long, score double")
    got = metrics.identity_metrics(df, spark.createDataFrame(list(enumerate(y)), "probe long, y long")).first()
    share = lambda hits: 100 * sum(hits) / len(hits)
    for k in (1, 5, 10):
        assert got[f"top{k}"] == pytest.approx(share([c in o[:k] for c, o in zip(y, order)]))
    each = [share([o[0] == c for c, o in zip(y, order) if c == k]) for k in set(y)]
    assert got["top1_subject_mean"] == pytest.approx(sum(each) / len(each))


def test_gender_vote_and_single_class(spark):
    r = random.Random(12)
    people = {f"p{k}": k % 2 for k in range(9)}
    d = [(s, y, round(r.random(), 1)) for s, y in people.items() for _ in range(r.randint(1, 6))]
    got = metrics.gender_metrics(spark.createDataFrame(d, "subject string, y int, p double")).first()
    right = [int(p >= 0.5) == y for _, y, p in d]
    assert got["acc"] == pytest.approx(100 * sum(right) / len(right))
    votes = {s: [int(p >= 0.5) for t, _, p in d if t == s] for s in people}
    won = [2 * sum(v) != len(v) and (2 * sum(v) > len(v)) == bool(people[s]) for s, v in votes.items()]  # a tie is wrong
    assert got["acc_subject"] == pytest.approx(100 * sum(won) / len(won)) and any(2 * sum(v) == len(v) for v in votes.values())
    one = metrics.gender_metrics(spark.createDataFrame([x for x in d if x[1] == 1], "subject string, y int, p double")).first()
    assert one["auc"] is None and one["mcc"] is None and one["bal_acc"] is None


def test_auc_ties_equal_pair_counting(spark):
    r = random.Random(3)
    d = [(r.randint(0, 1), r.randint(0, 9) / 10) for _ in range(300)]
    pos, neg = [p for y, p in d if y], [p for y, p in d if not y]
    want = 100 * sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(spark.createDataFrame(d, "y int, p double")).first()[0] == pytest.approx(want)


def test_assignment_equals_brute_force():
    r = np.random.default_rng(5)
    for n, m in ((3, 3), (4, 2), (2, 5), (5, 5), (1, 1)):
        for _ in range(20):
            w = r.integers(0, 9, (n, m)).astype(float)
            got = sum(w[a, b] for a, b in metrics.assignment(w))
            a, b = np.nonzero(w)
            sold = metrics.auction(a, b, w[a, b]) if len(a) else []
            assert sum(w[x, y] for x, y in sold) == got and len({x for x, _ in sold}) == len(sold) == len({y for _, y in sold})
            k = min(n, m)
            want = max(sum(w[a, b] for a, b in zip(p, q)) for p in itertools.combinations(range(n), k) for q in itertools.permutations(range(m), k))
            assert got == want


@pytest.mark.parametrize("dense", [16_000_000, 0])
def test_clustering(spark, dense, monkeypatch):
    """Accuracy after the best of all mappings, and purity, of random clusterings, also of fewer clusters than classes."""
    monkeypatch.setattr(metrics, "MAX_ASSIGNMENT", dense)
    r = random.Random(4)
    for clusters, classes in ((4, 4), (2, 5), (5, 3), (1, 4)):
        y = [r.randrange(classes) for _ in range(40)]
        c = [(k if r.random() < 0.6 else r.randrange(9)) % clusters for k in y]
        both = list(zip(c, y))
        got = metrics.clustering_metrics(spark.createDataFrame([(b, a) for a, b in both], "y long, cluster long")).first()
        n = {x: both.count(x) for x in set(both)}
        if clusters <= classes:
            pairs = (list(zip(range(clusters), p)) for p in itertools.permutations(range(classes), clusters))
        else:
            pairs = (list(zip(p, range(classes))) for p in itertools.permutations(range(clusters), classes))
        assert got["acc"] == pytest.approx(100 * max(sum(n.get(x, 0) for x in p) for p in pairs) / 40)
        assert got["purity"] == pytest.approx(100 * sum(max(m for (a, _), m in n.items() if a == k) for k in set(c)) / 40)


def rates_by_force(genuine, impostor, far):
    """(eer, tar) over the scores and one above all as thresholds."""
    if not genuine or not impostor:
        return None, None
    curve = [(sum(g < t for g in genuine) / len(genuine), sum(i >= t for i in impostor) / len(impostor)) for t in [*sorted({*genuine, *impostor}), math.inf]]
    frr, accept = min(curve, key=lambda x: abs(x[0] - x[1]))
    return 100 * (frr + accept) / 2, 100 * max((1 - a for a, b in curve if b <= far), default=0.0)


def test_verification(spark):
    r = random.Random(7)
    t = lambda x: spark.createDataFrame([(v,) for v in x], "score double")
    for n, m in ((40, 60), (5, 1), (0, 4), (30, 30)):
        g, i = [round(r.gauss(0.4, 0.3), 1) for _ in range(n)], [round(r.gauss(0, 0.3), 1) for _ in range(m)]
        got = metrics.verification(t(g), t(i), 0.1).first()
        assert (got["eer"], got["tar_at_far"]) == pytest.approx(rates_by_force(g, i, 0.1))


@pytest.mark.parametrize("digits", [None, 1, 6])
@pytest.mark.parametrize("few", [3, 20_000])
def test_verification_of_all_pairs(spark, digits, few, monkeypatch):
    monkeypatch.setattr(vector, "FEW", few)
    monkeypatch.setattr(tiles, "LEAST", 16)
    r = np.random.default_rng(5)
    centres = unit(r, 5, 8)
    for spread, far in ((0.1, 0.01), (0.4, 0.05), (1.0, 0.2)):
        cls = r.integers(0, 5, 70)
        v = centres[cls] + r.normal(size=(70, 8)) * spread
        n = v / np.linalg.norm(v, axis=1, keepdims=True)
        s = n @ n.T
        s = s if digits is None else np.round(s, digits)
        pairs = list(itertools.combinations(range(70), 2))
        want = rates_by_force([s[i, j] for i, j in pairs if cls[i] == cls[j]], [s[i, j] for i, j in pairs if cls[i] != cls[j]], far)
        df = spark.createDataFrame([(k, int(c), x.tolist()) for k, (c, x) in enumerate(zip(cls, v))], "id long, cls long, v array<double>")
        assert tuple(vector.verification_of_all_pairs(df, far, digits).first()) == pytest.approx(want)
    one = df.filter("cls = 0")
    assert tuple(vector.verification_of_all_pairs(one).first()) == (None, None)


def test_identity_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tiles, "LEAST", 8)
    r = np.random.default_rng(6)
    data = [(d, k, int(r.integers(0, 5)) if k < 50 else 90 + k, r.normal(size=6).tolist()) for d in range(2) for k in range(53)]
    df = spark.createDataFrame(data, "draw int, id long, cls long, v array<double>")
    n = [np.array(x[3]) / np.linalg.norm(x[3]) for x in data]
    alone = {(d, c) for d, _, c, _ in data if sum(x[0] == d and x[2] == c for x in data) == 1}
    own, cross = {}, {}
    for (d, i, c, _), a in zip(data, n):
        for (e, j, k, _), b in zip(data, n):
            if d == e and i != j and (d, c) not in alone:
                own[d, i, c, k] = max(own.get((d, i, c, k), -2), float(a @ b))
            if d == e and i % 2 == 0 and j % 2 == 1:
                cross[d, i, c, k] = max(cross.get((d, i, c, k), -2), float(a @ b))
    for got, want in ((vector.identity_scores(df, None, ("draw",)), own), (vector.identity_scores(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ("draw",)), cross)):
        got = {tuple(x)[:4]: x["score"] for x in got.collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("few", [1, 7, 4096])
def test_order_statistics(spark, few):
    """Ties, one value, a wide and a tiny spread: every place against a sort."""
    r = random.Random(few)
    for values in ([3.5], [1.0] * 50, [r.choice([0.0, 1.0, 1e9]) for _ in range(300)], [r.gauss(0, 1) * 10.0 ** r.randint(-200, 200) for _ in range(400)], [1 + k * 2.0**-50 for k in range(200)]):
        want = sorted(values)
        ranks = sorted({0, len(values) - 1, len(values) // 2, len(values) // 3})
        got = catalog.order_statistics(spark.createDataFrame([(v,) for v in values], "x double").repartition(3), "x", ranks, cuts=5, few=few)
        assert got == {k: want[k] for k in ranks}
    r5 = [r.random() for _ in range(101)] + [None]
    got = catalog.describe(spark.createDataFrame([(v,) for v in r5], "x double"), "x").first()
    assert [got[k] for k in ("p5", "p25", "median", "p75", "p95")] == pytest.approx(np.percentile(r5[:-1], [5, 25, 50, 75, 95]).tolist())
    assert catalog.describe(spark.createDataFrame([(None,)], "x double"), "x").first()["median"] is None


def test_mean_std_and_summary(spark):
    agg = lambda x: spark.createDataFrame([(v,) for v in x], "v double").agg(*metrics.mean_std("v")).first()
    assert tuple(agg([1.0, 2.0, 3.0]))[:2] == (2, 1) and tuple(agg([5.0]))[:2] == (5, 0) and agg([])[0] is None
    runs = spark.createDataFrame([("m", "0.0003", 80.0, "ok"), ("m", "0.0003", 90.0, "ok"), ("m", "0.0003", None, "diverged")], "model string, lr string, top1 double, status string")
    s = summary.summarise(runs, [], ["top1"], confidence=True).first()
    assert (s["n_runs"], s["n_diverged"], s["top1_mean"], s["top1_std"], s["lr"]) == (2, 1, 85.0, 7.0711, "0.0003")
    assert s["top1_ci95"] == pytest.approx(63.531, abs=1e-3)


def test_text_forms(spark):
    f = lambda m, s, n, e=None: spark.range(1).select(X.plus_minus(F.lit(m).cast("double"), F.lit(s).cast("double"), F.lit(n), None if e is None else F.lit(e))).first()[0]
    assert f(2.0, 1.0, 3, 3) == "2.00 ± 1.00" and f(1.0, None, 1, 3) == "1.00 (n=1/3)" and f(None, None, 0) == "–"
    words = [f"{a}{b}{c}" for a in ("Img", "img_") for b in (3, 21, 100) for c in ("", "x07", "x8")]
    random.Random(3).shuffle(words)
    parts = lambda s: [int(x) if x.isdigit() else x.lower() for x in re.split(r"([0-9]+)", s)]
    names = spark.createDataFrame([(x,) for x in words], "s string").orderBy(X.natural_key(F.col("s")))
    assert [r[0] for r in names.collect()] == sorted(words, key=parts)
    w = spark.createDataFrame([(1.9,), (0.5,), (math.nan,)], "a double").select(X.suggest_width(F.col("a")))
    assert [r[0] for r in w.collect()] == [128, 224, 224]


def test_subset_sums():
    r = random.Random(31)
    for _ in range(200):
        sizes, most = [r.randint(1, 12) for _ in range(r.randint(0, 9))], r.randint(0, 40)
        sums = {sum(sizes[k] for k in p) for n in range(len(sizes) + 1) for p in itertools.combinations(range(len(sizes)), n)}
        got = splits.Sums(sizes, most)
        assert got.largest() == max(x for x in sums if x <= most)
        for total in range(most + 1):
            pick = got.subset(total)
            assert (pick is not None) == (total in sums) and (pick is None or sum(sizes[k] for k in pick) == total and len(set(pick)) == len(pick))


def split_counts(pdf):
    return {k: int((pdf["split"] == k).sum()) for k in ("train", "val", "test", "excluded")}


def test_exact_split_keeps_groups(spark):
    r = random.Random(2)
    data = [(f"{s}-{k}", s, f"{s}-g{r.randint(0, 30)}", "") for s in ("a", "b", "c") for k in range(60)]
    data += [(f"d-{k}", "d", f"d-{k}", "") for k in range(5)]
    df = spark.createDataFrame(data, "image_id string, subject string, `group` string, orig_split string")
    out = splits.exact_split(df, 30, 10, 10, 1).toPandas()
    for s in "abc":
        part = out[out.subject == s]
        assert split_counts(part) == {"train": 30, "val": 10, "test": 20, "excluded": 0}
        if part["warning"].isna().all():
            assert (part.groupby("group")["split"].nunique() == 1).all()
    assert set(out[out.subject == "d"]["split"]) == {"excluded"}
    again = splits.exact_split(df.repartition(7), 30, 10, 10, 1).toPandas()
    assert dict(zip(out.image_id, out.split)) == dict(zip(again.image_id, again.split))


def test_forced_split_cuts_one_group(spark):
    """Groups of 7, 7 and 7 images cannot give 10 and 3 in whole groups: one is cut, and only as far as needed."""
    df = spark.createDataFrame([(f"{g}{k}", "s", g, "") for g in "uvw" for k in range(7)], "image_id string, subject string, `group` string, orig_split string")
    out = splits.exact_split(df, 10, 3, 5, 1).toPandas()
    assert split_counts(out) == {"train": 10, "val": 3, "test": 8, "excluded": 0} and out["warning"].notna().all()
    assert (out[out.split == "train"].groupby("group").size() == 7).sum() == 1


def test_stored_folds_and_roles_are_checked(spark):
    images = spark.createDataFrame([("i1", "a"), ("i2", "b")], "image_id string, subject string")
    good = spark.createDataFrame([("a", 0), ("b", 2)], "subject string, fold int")
    assert splits.load_folds(good, images, 3).count() == 2
    for bad in ([("a", 0)], [("a", 0), ("b", 3)], [("a", 0), ("b", 1), ("b", 1)], [("a", 0), ("b", None)]):
        with pytest.raises(ValueError):
            splits.load_folds(spark.createDataFrame(bad, "subject string, fold int"), images, 3)
    roles = lambda rows: spark.createDataFrame(rows, "subject string, role string")
    assert splits.load_roles(roles([("a", "novel"), ("b", "train"), ("c", "train")]), images).count() == 3
    for bad in ([("a", "novel")], [("a", "novel"), ("b", "test")], [("a", "novel"), ("b", None)]):
        with pytest.raises(ValueError):
            splits.load_roles(roles(bad), images)


def test_sliced_meetings_equal_broadcast_ones(spark, monkeypatch):
    r = random.Random(8)
    v = spark.createDataFrame([(d, k, k % 4, [r.gauss(0, 1) for _ in range(6)]) for d in range(2) for k in range(30)], "draw int, id long, cls long, v array<double>")
    q = v.select("draw", F.col("id").alias("probe"), "v")
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in row) for row in df.collect())
    whole = key(vector.prototype_scores(v, q, ("draw",)))
    monkeypatch.setattr(vector, "MAX_BROADCAST_CELLS", 20)
    assert key(vector.prototype_scores(v, q, ("draw",))) == whole and len(whole) == 240


def test_numbered_rows(spark):
    from galleria.operators import vector

    ids = random.Random(2).sample(range(10**9), 500)
    got = vector.numbered(spark.createDataFrame([(k,) for k in ids], "id long").repartition(5), "id", "pos", ranges=7).collect()
    assert sorted((x["pos"], x["id"]) for x in got) == list(enumerate(sorted(ids)))


def test_folds_and_novel(spark):
    s = spark.createDataFrame([(f"m{k}", "M") for k in range(13)] + [(f"f{k}", "F") for k in range(22)], "subject string, gender string")
    got = rows(splits.folds(s, 4, 1).groupBy("fold", "gender").count())
    assert len(got) == 8 and all(n in ((3, 4) if g == "M" else (5, 6)) for _, g, n in got) and sum(n for _, _, n in got) == 35
    with pytest.raises(ValueError):
        splits.folds(s, 2, 1)
    for share in (0.01, 0.25, 0.5, 0.99):
        got = dict(rows(splits.novel_split(s, share, 1).filter("role = 'novel'").groupBy("gender").count()))
        assert got == {g: min(n - 1, max(1, round(n * share))) for g, n in (("M", 13), ("F", 22))}


def test_episode(spark):
    data = [(s * 20 + k, s, s * 20 + (0 if k == 1 else k)) for s in range(4) for k in range(20)]
    im = spark.createDataFrame(data, "image_id long, subject long, `group` long")
    ep = splits.identity_episode(im, 3, 2, 5, 0).join(im, ["image_id", "subject"]).toPandas()
    assert (ep.role == "support").sum() == 12 and (ep.role == "val").sum() == 8
    chosen = ep[ep.role != "test"]
    assert not set(zip(chosen.subject, chosen.group)) & set(zip(ep[ep.role == "test"].subject, ep[ep.role == "test"].group))
    blocked = spark.createDataFrame([(k, 0, k // 6) for k in range(12)], "image_id long, subject long, `group` long")
    c = splits.episode_counters(blocked, 1, 1, 5, 0).first()
    assert c["subjects_without_test"] == 1
    with pytest.raises(ValueError):
        splits.identity_episode(im, 19, 1, 5, 0)


def test_gender_labels(spark):
    s = spark.createDataFrame([("001",), ("002",)], "subject string")
    lab = lambda r: spark.createDataFrame(r, "subject string, gender string")
    assert rows(catalog.assign_gender(s, lab([("001", " f"), ("002 ", "M")])).select("subject", "gender")) == [("001", "F"), ("002", "M")]
    for bad in ([("001", "F")], [("001", "X"), ("002", "M")], [("001", "F"), ("001", "M"), ("002", "M")]):
        with pytest.raises(catalog.CatalogError):
            catalog.assign_gender(s, lab(bad)).collect()


def test_stale_splits(spark):
    im = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "2")], "image_id string, `group` string")
    sp = im.withColumn("split", F.lit("train"))
    assert catalog.load_split(sp, im).count() == 3
    for broken in (sp.filter("image_id <> 'a'"), sp.withColumn("group", F.lit("9")), sp.unionByName(spark.createDataFrame([("z", "1", "train")], "image_id string, `group` string, split string"))):
        with pytest.raises(catalog.CatalogError):
            catalog.load_split(broken, im)


def test_sampled_pairs(spark):
    ids = random.Random(1).sample(range(1000), 60)
    v = spark.createDataFrame([(i, k % 7 if k < 40 else k) for k, i in enumerate(ids)], "id long, cls long").repartition(4)
    cls = {r["id"]: r["cls"] for r in v.collect()}
    every = sorted((a, b) for a, b in itertools.combinations(sorted(ids), 2) if cls[a] == cls[b])
    assert sorted(rows(vector.genuine_pairs(v))) == every and sorted(rows(vector.genuine_pairs(v, len(every)))) == every
    for cap in (1, 7, 20, len(every) - 1):  # few of many pairs, and nearly all
        got = rows(vector.genuine_pairs(v, cap, 5))
        assert len(got) == cap and len(set(got)) == cap and set(got) <= set(every) and got == rows(vector.genuine_pairs(v.repartition(2), cap, 5))
    seen = {x for seed in range(12) for x in rows(vector.genuine_pairs(v, 20, seed))}
    assert len(seen) > 0.8 * len(every)
    imp = vector.impostor_pairs(v, 50, 1)
    assert imp.count() == 50 and all(cls[r["id_a"]] != cls[r["id_b"]] for r in imp.collect())


def test_constraints_of_vector_operators(spark):
    v = spark.createDataFrame([(k, k % 2, [float(k % 2), 1.0]) for k in range(10)], "id long, cls long, v array<double>")
    with pytest.raises(ValueError):
        vector.kmeans(v, 11, 1)
    assert vector.kmeans(v, 1, 1).count() == 10
    with pytest.raises(ValueError):
        vector.linear_probe(v.filter("cls = 0").select("cls", "v"), v.select("cls", "v"), v.select(F.col("id").alias("probe"), "v"))


def logistic_by_descent(x, y, k, c):
    """Weights and biases of the multinomial regression with c * losses + |weights|^2 / 2, by plain gradient descent."""
    n, d = x.shape
    w, b, want = np.zeros((d, k)), np.zeros(k), np.eye(k)[y]
    for _ in range(60_000):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 0.5 / (c * n) * (c * x.T @ (p - want) + w)
        b -= 0.5 / (c * n) * c * (p - want).sum(axis=0)
    return w, b


@pytest.mark.parametrize("classes", [2, 3])
def test_linear_probe_equals_descent(spark, classes):
    r = np.random.default_rng(classes)
    centres = unit(r, classes, 5)
    make = lambda n: [(int(k), centres[k] + r.normal(size=5) * 0.6) for k in r.integers(0, classes, n)]
    train, val, tests = make(45), make(40), make(30)
    norm = lambda rows: np.array([v / np.linalg.norm(v) for _, v in rows])
    frame = lambda rows, name: spark.createDataFrame([(k if name == "cls" else i, v.tolist()) for i, (k, v) in enumerate(rows)], f"{name} long, v array<double>")
    grid = (0.1, 1.0, 10.0)
    fits = {c: logistic_by_descent(norm(train), np.array([k for k, _ in train]), classes, c) for c in grid}
    right = {c: np.mean((norm(val) @ w + b).argmax(axis=1) == [k for k, _ in val]) for c, (w, b) in fits.items()}
    best = max(grid, key=lambda c: (right[c], -c))
    got, chosen = vector.linear_probe(frame(train, "cls"), frame(val, "cls"), frame(tests, "probe"), grid)
    assert chosen == best
    w, b = fits[best]
    z = norm(tests) @ w + b
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    assert all(abs(x["score"] - p[x["probe"], x["cls"]]) < 2e-3 for x in got.collect())


def test_kmeans_reaches_the_best_of_many_lloyds(spark):
    r = np.random.default_rng(8)
    centres = unit(r, 4, 6)
    v = np.concatenate([c + r.normal(size=(25, 6)) * 0.08 for c in centres])
    n = v / np.linalg.norm(v, axis=1, keepdims=True)

    def cost(label):
        return sum(((n[label == k] - n[label == k].mean(axis=0)) ** 2).sum() for k in set(label.tolist()))

    def lloyd(seed):
        at = n[np.random.default_rng(seed).choice(len(n), 4, replace=False)]
        for _ in range(100):
            label = ((n[:, None] - at[None]) ** 2).sum(axis=2).argmin(axis=1)
            at = np.array([n[label == k].mean(axis=0) if (label == k).any() else at[k] for k in range(4)])
        return label

    least = min((lloyd(s) for s in range(20)), key=cost)
    got = vector.kmeans(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), 4, 3).toPandas().sort_values("id")["cluster"].to_numpy()
    assert cost(got) == pytest.approx(cost(least)) and len({*zip(got.tolist(), least.tolist())}) == 4


def test_gender_linear_probe(spark):
    """Separable genders: the probe is right where the prototypes are, on each fold."""
    from galleria.operators import experiments
    from galleria.session import Scratch

    r = np.random.default_rng(2)
    data = [(s * 10 + i, s, s * 10 + i, s % 2, ((1.0 if s % 2 else -1.0) * np.eye(8)[0] + r.normal(size=8) * 0.05).tolist()) for s in range(12) for i in range(4)]
    images = spark.createDataFrame([x[:4] for x in data], "image_id long, subject long, `group` long, gender_label long")
    vectors = spark.createDataFrame([(x[0], x[4]) for x in data], "image_id long, v array<double>")
    folds = spark.createDataFrame([(s, s // 2 % 3) for s in range(12)], "subject long, fold int")
    got = experiments.fewshot_gender(images, vectors, folds, 3, (1, 2), 1, 5, Scratch(spark), linear_draws=1).collect()
    assert sorted((x["classifier"], x["fold"], x["shot"]) for x in got) == sorted((c, f, k) for c in ("lp", "proto") for f in range(3) for k in (1, 2))
    assert all(x["acc"] == 100 and x["auc"] == 100 for x in got)


def test_first_best_epoch(spark):
    log = spark.createDataFrame([("r", e, v) for e, v in enumerate([1.0, 3.0, 3.0, 2.0, 9.0])], "run string, epoch int, val double")
    assert tuple(summary.first_best_epoch(log, "val", 2).first()) == ("r", 1, 3)


@pytest.mark.parametrize("index_rows", [7, 1000])
def test_copies_of_a_hash_meet_once(spark, index_rows, monkeypatch):
    """Copies are written out at the end: the index holds each hash once, in slices and parts, and equals brute force."""
    monkeypatch.setattr(hamming, "INDEX_ROWS", index_rows)
    monkeypatch.setattr(hamming, "PROBING", 5)
    monkeypatch.setattr(hamming, "AT_ONCE", 50)
    r = random.Random(2)
    hs = [r.choice([0, 1, 3, 77, 1 << 40, r.getrandbits(20)]) for _ in range(90)]
    held = []
    df = spark.createDataFrame(list(enumerate(hs)), "id long, h long")
    want = sorted((i, j, (hs[i] ^ hs[j]).bit_count()) for i, j in itertools.combinations(range(90), 2) if (hs[i] ^ hs[j]).bit_count() <= 3)
    assert rows(dedup.hamming_pairs(df, 3, probed=True)) == sorted(want, key=repr)
    index = hamming.Index(np.array(sorted(set(hs)), np.uint64), hamming.Band(tuple(range(20)), 1))
    for p, q in index.met(np.array([1], np.uint64)):
        held += q.tolist()
    assert len(held) == len(set(held))


def test_counted_scores_equal_single_rows(spark):
    g, i = [0.9, 0.9, 0.7, 0.2], [0.1, 0.2, 0.2, 0.8]
    one = lambda s: spark.createDataFrame([(x,) for x in s], "score double")
    many = lambda s: one(s).groupBy("score").agg(F.count("*").alias("n"))
    assert rows(metrics.verification(many(g), many(i), 0.3)) == rows(metrics.verification(one(g), one(i), 0.3))


def test_a_told_count_stays_when_all_are_there(spark):
    from galleria.operators import reports

    runs = spark.createDataFrame([(1.0,), (3.0,)], "m double")
    text = lambda told: runs.agg(reports.cell_text(runs, reports.Cell("", "m", expected=2, told=told))).first()[0]
    assert text(False) == "2.00 ± 1.41" and text(True) == "2.00 ± 1.41 (n=2/2)"


def test_learning_rates_have_a_row_per_event(spark):
    from galleria.plans.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    assert QUERIES["learning_rates"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_pairs_of_one_class_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(vector, "PIECE", 5)
    df = spark.createDataFrame([(k, 1) for k in range(60)] + [(99, None)], "id long, cls long")
    pairs = vector.genuine_pairs(df)
    assert rows(pairs) == rows(spark.createDataFrame(list(itertools.combinations(range(60), 2)), "id_a long, id_b long"))
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 8


@pytest.mark.parametrize("together", [1, 1000])
def test_rows_of_a_key_look_their_neighbours_up_together(spark, together, monkeypatch):
    """Many rows of a band's key, one key of a third of them: each pair once, in one table and over two, as brute force has them."""
    monkeypatch.setattr(hamming, "SHARED", 0)
    monkeypatch.setattr(hamming, "PROBING", 20)
    monkeypatch.setattr(hamming, "TOGETHER", together)
    monkeypatch.setattr(hamming, "COMPARED", 64)
    r = random.Random(4)
    hs = [r.getrandbits(16) << 16 if k % 3 == 0 else r.choice([r.getrandbits(32), 5 | r.getrandbits(6) << 20]) for k in range(240)]
    assert all(b.shared(1) for b in hamming.plan({k: 0.5 for k in range(32)}, 4, 240, 240, True))
    df = spark.createDataFrame(list(enumerate(hs)), "id long, h long")
    d = lambda i, j: (hs[i] ^ hs[j]).bit_count()
    want = [(i, j, d(i, j)) for i, j in itertools.combinations(range(240), 2) if d(i, j) <= 4]
    assert len(want) > 50 and rows(dedup.hamming_pairs(df, 4, probed=True)) == sorted(want, key=repr)
    cross = rows(dedup.hamming_pairs(df.filter("id % 2 = 0"), 4, df.filter("id % 2 = 1"), probed=True))
    assert cross == sorted([(i, j, d(i, j)) for i in range(0, 240, 2) for j in range(1, 240, 2) if d(i, j) <= 4], key=repr)


def test_blocks_send_vectors_as_stored_and_normalise_them_in_the_task(spark, monkeypatch):
    """F7, F8: blocks hold single precision and norms, from which a task gets the numbers of l2_normalize()."""
    r = np.random.default_rng(3)
    data = [(k, k % 3, [0.0] * 5 if k == 7 else r.normal(size=5).tolist()) for k in range(60)]
    df = spark.createDataFrame(data, "id long, cls int, v array<float>")
    blocks = tiles.blocks(df.select("id", *tiles.unit(df)), Scratch(spark))
    got = tiles.meet(blocks, None, lambda x, y: iter([[x.flat("id"), pa.array(x.matrix().tolist())]]), "id long, u array<double>", every=True)
    assert {x["id"]: x["u"] for x in got.collect()} == {x["id"]: x["u"] for x in df.select("id", X.l2_normalize(F.col("v")).alias("u")).collect()}
    sent, meet = [], tiles.meet
    monkeypatch.setattr(tiles, "meet", lambda left, *a, **k: sent.append(left.schema["items"].dataType.elementType["v"].dataType) or meet(left, *a, **k))
    vector.identity_scores(df)
    dedup.matched_by_cosine(df.withColumnRenamed("cls", "subject"), df.withColumnRenamed("cls", "subject"), 0.9)
    dedup.cross_cosine_pairs(df, None, 0.9)
    assert sent == [T.ArrayType(T.FloatType())] * 3


def test_strips_grow_with_cores_not_with_rows(spark):
    """F7, F8: on 4 cores 6 strips a side, so each of 40 or 360 blocks is sent six times to either side."""

    def area(xs, ys, met):
        yield [[len(list(xs)) + len(ys)]]

    for n in (40, 360):
        blocks = spark.range(n).selectExpr("cast(id as int) block", "array(struct(id)) items")
        assert tiles.meet(blocks, None, area, "sent long", every=True, whole=True).agg(F.sum("sent")).first()[0] <= 2 * n * 6


def test_kmeans_fits_rows_that_are_not_decoded_in_every_iteration(spark, monkeypatch):
    """the fit keeps vectors itself only of a table that is not cached; the clusters are those of two bundles."""
    from pyspark.ml.clustering import KMeans

    kept, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: kept.append(rows.storageLevel.useMemory or rows.storageLevel.useDisk) or fit(self, rows))
    r = np.random.default_rng(5)
    v = np.concatenate([np.eye(4)[[k]] + r.normal(size=(20, 4)) * 0.01 for k in (0, 2)])
    found = vector.kmeans(spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>"), 2, 7)
    got = {x["id"]: x["cluster"] for x in found.collect()}
    assert kept == [False] and len(set(got.values())) == 2 and all(got[k] == got[k // 20 * 20] for k in got)


def test_few_probes_equal_the_linear_probe_of_each_run(spark, monkeypatch):
    """all runs in one job, with the scores of the fit of a run alone."""
    from pyspark.ml.classification import LogisticRegression

    r = np.random.default_rng(12)
    row = lambda k: (k % 2, (r.normal(size=4) + k % 2).tolist())
    support = spark.createDataFrame([(f, s, *row(k)) for f in range(2) for s in (1, 3) for k in range(2 * s)], "fold int, shot int, cls int, v array<double>")
    val = spark.createDataFrame([(f, *row(k)) for f in range(2) for k in range(20)], "fold int, cls int, v array<double>")
    queries = spark.createDataFrame([(k, row(k)[1]) for k in range(30)], "probe int, v array<double>")
    of = lambda t, **at: t.filter(" AND ".join(f"{k} = {x}" for k, x in at.items())).drop(*at)
    alone = vector.linear_probe(of(support, fold=1, shot=3), of(val, fold=1), queries)[0].filter("cls = 1")
    want = {x["probe"]: x["score"] for x in alone.collect()}
    monkeypatch.setattr(LogisticRegression, "fit", lambda *a: 1 / 0)
    got = {(x["fold"], x["shot"]): (np.array(x["w"]), x["b"]) for x in vector.few_probes(support, val, ("fold", "shot"), ("fold",)).collect()}
    assert sorted(got) == [(0, 1), (0, 3), (1, 1), (1, 3)]
    w, b = got[1, 3]
    for x in queries.collect():
        v = np.array(x["v"])
        assert abs(1 / (1 + np.exp(-(v / np.linalg.norm(v)) @ w - b)) - want[x["probe"]]) < 1e-4


def test_the_linear_probe_of_genders_is_chosen_on_all_validation_images(spark, monkeypatch):
    """a fold of 2,100 images for validation is met whole."""
    from galleria.operators import experiments

    images = spark.range(6300).selectExpr("id AS image_id", "id % 12 AS subject", "id AS `group`", "id % 2 AS gender_label")
    vectors = images.selectExpr("image_id", "array(image_id % 2 - 0.5D, 0.1D, image_id % 7 / 100D) AS v")
    folds = spark.range(12).selectExpr("id AS subject", "cast(floor(id / 2) % 3 AS int) AS fold")
    met, probes = [], vector.few_probes
    monkeypatch.setattr(vector, "few_probes", lambda support, val, *a: met.append(rows(val.groupBy("fold").count())) or probes(support, val, *a))
    got = experiments.fewshot_gender(images, vectors, folds, 3, (1,), 1, 5, Scratch(spark), linear_draws=1).filter("classifier = 'lp'")
    assert met == [[(0, 2100), (1, 2100), (2, 2100)]] and [x["acc"] for x in got.collect()] == [100.0] * 3


@pytest.mark.parametrize("told", [7, 1000])
def test_pairs_of_copies_are_written_out_by_many_tasks(spark, told, monkeypatch):
    """40 hashes of 30 copies each and one of 90, in one piece and in several: as brute force, in more tasks than the session's cores."""
    monkeypatch.setattr(hamming, "TOLD", told, raising=False)
    hs = [k * 7919 % 40 << 9 for k in range(1200)] + [1 << 30] * 90
    df = spark.createDataFrame([(k * 31 % 1291, h) for k, h in enumerate(hs)], "id long, h long")
    of = {k * 31 % 1291: h for k, h in enumerate(hs)}
    want = [(i, j, (of[i] ^ of[j]).bit_count()) for i, j in itertools.combinations(sorted(of), 2) if (of[i] ^ of[j]).bit_count() <= 1]
    pairs = dedup.hamming_pairs(df, 1, probed=True)
    assert rows(pairs) == sorted(want, key=repr)
    assert pairs.select(F.spark_partition_id().alias("p")).distinct().count() > spark.sparkContext.defaultParallelism


def test_a_task_of_a_hamming_join_holds_few_rows_of_either_side(spark, monkeypatch):
    """600 hashes, a third of them alike in all but 8 bits, in slices of 50: each pair once, and no task of all rows."""
    monkeypatch.setattr(hamming, "INDEX_ROWS", 50)
    monkeypatch.setattr(hamming, "SHARED", 0)
    dealt, run = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, *a: dealt.append(self) or run(self, *a))
    r = random.Random(8)
    hs = [r.getrandbits(8) << 16 if k % 3 == 0 else r.getrandbits(30) for k in range(600)]
    df = spark.createDataFrame(list(enumerate(hs)), "id long, h long")
    d = lambda i, j: (hs[i] ^ hs[j]).bit_count()
    want = [(i, j, d(i, j)) for i, j in itertools.combinations(range(600), 2) if d(i, j) <= 4]
    assert rows(dedup.hamming_pairs(df, 4, probed=True)) == sorted(want, key=repr)
    task = [c for c in dealt[0].columns if c != "hs"]
    assert dealt[0].groupBy(*task).agg(F.sum(F.size("hs")).alias("n")).agg(F.max("n")).first()[0] <= 100
    cross = rows(dedup.hamming_pairs(df.filter("id % 2 = 0"), 4, df.filter("id % 2 = 1"), probed=True))
    assert cross == sorted([(i, j, d(i, j)) for i in range(0, 600, 2) for j in range(1, 600, 2) if d(i, j) <= 4], key=repr)


def test_rows_that_met_a_subject_are_not_compared_again():
    """each (row, subject) once and as by brute force, small subjects together, a large one only until it is met."""
    r = np.random.default_rng(3)
    code = np.repeat(np.arange(7), [3, 1500, 40, 700, 300, 5, 2])
    x, y = (t / np.linalg.norm(t, axis=1)[:, None] for t in (r.normal(size=(90, 4)), r.normal(size=(len(code), 4))))
    y[5], y[1505] = np.nan, x[0]  # a vector that is no number hides no other
    work = []

    def near(a, b, starts):
        work.append(len(a) * len(b))
        return tiles.any_reached(a, b, starts, 0.9)

    cuts = dedup.pieces(code)
    assert [k for cut in cuts for k in range(*cut)] == list(range(len(code)))
    p, c = dedup.first_matches(x, y, code, cuts, near)
    with np.errstate(invalid="ignore"):
        i, j = np.nonzero(x @ y.T >= 0.9)
    assert sorted(zip(p.tolist(), c.tolist())) == sorted(set(zip(i.tolist(), code[j].tolist())))
    assert sum(work) < 0.6 * len(x) * len(y)
    assert len(dedup.first_matches(x, y[:0], code[:0], dedup.pieces(code[:0]), near)[0]) == 0


def test_reached_near_the_threshold():
    """What single precision can't tell is told in double, of every run."""
    x = np.array([[1.0, 0.0], [0.0, 1.0]])
    y = np.array([[0.5 + 1e-9, 1.0], [0.5 - 1e-9, 0.0], [0.5, 0.2], [0.1, 0.5 - 1e-9]])
    assert tiles.any_reached(x, y, np.array([0, 1, 3]), 0.5).tolist() == [[True, True], [True, False], [False, False]]
