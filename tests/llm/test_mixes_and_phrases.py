"""Mixing, collocations and the divergence audit against brute force: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from galleria.llm import collocations, divergence, mixing

SCHEMA = "doc_id long, text string, lang string, source string, n long, s int, term string, block long, first long, word string"


def corpus(n=160, seed=3):
    r = random.Random(seed)
    common = ["the", "of", "Red", "green", "apple", "tree", "Über", "naïve", "x1", "|"]
    texts = []
    for _ in range(n):
        w = [r.choice(common) if r.random() < 0.7 else f"w{r.randint(0, 60)}" for _ in range(r.randint(0, 50))]
        texts.append("".join(x + r.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", " red apple tree ", "\x0b"]) for x in w))
    texts += ["", None, "   ", "...", "the " * 400, "red apple tree of the " * 60, "a" * 5000, "long " + "word " * 30_000, "é.è,ê"]
    rows = [(k, t, [None, "en", "en", "fr", "é"][k % 5], [None, "s0", "s0", "s0", "s1", "", "Z"][r.randrange(7)], 5, 6, "clash", 7, 8, "w") for k, t in enumerate(texts)]
    return rows + [rows[4], rows[4], (None, "the red apple", "en", "s0", 1, 1, "t", 1, 1, "w"), (400, None, "xx", "only", 1, 1, "t", 1, 1, "w")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


# Divergence audit


def audit_by_force(rows, min_docs, top):
    terms = [(r[2] or "", r[3] or "", Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(r[1])))) for r in rows]
    df, sums, groups = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, c in terms:
        groups[lang].add(source)
        df.update((lang, t) for t in c)
        sums[lang, source].update(c)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (x, t), n in df.items() if x == lang and n >= min_docs)
        every = Counter()
        for s in sources:
            every.update({t: n for t, n in sums[lang, s].items() if t in kept})
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p, q = {s: share(sums[lang, s]) for s in sources}, share(every)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s))
            best = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if sums[lang, s][t] and p[s][t] > q[t])
            out |= {(lang, s, "pair", o.decode(), -v, k) for k, (v, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", t.decode(), -v, k) for k, (v, t) in enumerate(best[:top], 1)}
    return out


def audited(df, p):
    return [(r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.audit(df, p).collect()]


@pytest.mark.parametrize("bounds", [{}, {"HELD": 20, "CELLS": 7, "BLOCK": 300}, {"HELD": 20, "CELLS": 7, "MATRIX": 1}])
@pytest.mark.parametrize("min_docs", [1, 10, 1000])
def test_divergence_audit(docs, rows, min_docs, bounds, monkeypatch):
    for k, v in bounds.items():
        monkeypatch.setattr(divergence, k, v)
    got = audited(docs, divergence.Params(min_docs=min_docs, top_terms=4))
    assert len(got) == len(set(got)) and set(got) == audit_by_force(rows, min_docs, 4)


def test_divergence_of_large_counts_is_exact():
    r = random.Random(1)
    for _ in range(300):
        total = r.choice([r.randint(1, 9), r.randint(1, 9 * 10**15)])
        count = r.randint(0, total)
        assert int(divergence.share(np.array([count]), np.array([total]), 10**9)[0]) == 1 + 10**9 * count // total


def test_divergence_streams_runs_over_batches(spark):
    """A term in every document of many sources: its run is longer than a batch of the scan."""
    rows = [(k, f"the w{k % 7}", "en", f"s{k % 300}") for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(40)
    assert set(audited(df, divergence.Params())) == audit_by_force(rows, 10, 10)


# Collocations


def phrases_by_force(rows, p):
    f, total = Counter(), Counter()
    for r in rows:
        lang = "und" if r[2] is None else r[2]
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(r[1])):
            w = re.findall(r"[^ \t]+", piece)
            total[lang] += len(w)
            for k in range(1, p.longest + 1):
                f.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= p.min_count}
    covered = set()
    for (lang, w), n in found.items():
        for k in range(2, len(w)):
            covered |= {(lang, w[i : i + k]) for i in range(len(w) - k + 1) if 100 * n >= p.cover_percent * f[lang, w[i : i + k]]}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        if (lang, w) not in covered:
            score, _, l, r = min((p.unit * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, k, w.decode(), -a, l, r, total[lang], -s) for lang, x in out.items() for k, (s, a, w, l, r) in enumerate(sorted(x)[: p.top], 1)}


@pytest.mark.parametrize("given", [{}, {"min_count": 2}, {"min_count": 1, "top": 25}, {"min_count": 3, "longest": 3}, {"min_count": 3, "longest": 2, "cover_percent": 10}])
@pytest.mark.parametrize("held", [12 << 20, 900])
def test_collocations(docs, rows, given, held, monkeypatch):
    monkeypatch.setattr(collocations, "HELD", held)
    p = collocations.Params(**given)
    got = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(docs, p).collect()]
    want = phrases_by_force(rows, p)
    assert len(got) == len(want) and set(got) == want and want


def test_a_full_filter_changes_no_phrase(docs, rows, monkeypatch):
    monkeypatch.setattr(collocations, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(collocations, "BITS_LEAST", 6)
    monkeypatch.setattr(collocations, "BITS_MOST", 6)
    p = collocations.Params(min_count=2)
    got = {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(docs, p).collect()}
    assert got == phrases_by_force(rows, p)


def test_row_hash_is_sparks(spark):
    df = spark.sql("SELECT id * 7919 - 40 AS a, id * id * 1000003 AS b, xxhash64(id * 7919 - 40, id * id * 1000003) AS h FROM range(50)").toPandas()
    assert (collocations.row_hash(df["a"].to_numpy(), df["b"].to_numpy()).view(np.int64) == df["h"].to_numpy()).all()


# Mixing


def by_rank(names):
    return [(5, 2, 1)[k % 3] for k in range(len(names))]


def targets_by_force(sizes, percent, passes):
    """Reshare what is above, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = dict(zip(names, by_rank(names)))
    total, fixed = Fraction(sum(sizes.values()) * percent, 100), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        got = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if got[s] > passes * sizes[s]]
        if not above:
            return fixed | got
        fixed |= {s: Fraction(passes * sizes[s]) for s in above}


@pytest.mark.parametrize("given", [{}, {"block": 7, "slots": 5}, {"block": 1, "slots": 300}, {"block": 64, "slots": 16, "percent": 30}, {"block": 16, "percent": 199, "seed": 5}])
def test_mix(docs, rows, given):
    p = mixing.Params(**given)
    size = lambda t: len(re.findall(r"[^ \t-\r]+", t or ""))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets_by_force(sizes, p.percent, p.passes)
    got = mixing.taken(docs, by_rank, p).collect()
    assert Counter((r["id"], r["size"]) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    assert all(0 <= r["taken"] <= p.passes * r["size"] for r in got)
    assert Counter((r["source_size"], r["target"]) for r in got) == Counter((sizes[r[3]], float(want[r[3]])) for r in rows)
    source = {r[0]: r[3] for r in rows}
    taken = Counter()
    for r in got:
        taken[source[r["id"]]] += r["taken"]
    assert all(taken[s] == int(want[s]) for s in sizes)
    key = lambda x: tuple(repr(v) for v in x)
    again = mixing.taken(docs.repartition(2), by_rank, p).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))

    texts = Counter((r[0], r[3], r[1]) for r in rows)
    words = {k: re.findall(r"[^ \t-\r]+", k[2] or "") for k in texts}
    slots, per = defaultdict(list), Counter()
    for r in mixing.mix(docs, by_rank, p).collect():
        slots[r["shard"], r["slot"]].append((r["at"], r["length"], r["source"]))
        per[r["id"]] += r["length"]
        cut = re.findall(r"[^ \t-\r]+", r["text"])
        assert len(cut) == r["length"]
        assert any(w[r["start"] : r["start"] + r["length"]] == cut for k, w in words.items() if k[:2] == (r["id"], r["source"]))
    total = Counter()
    for r in got:
        total[r["id"]] += r["taken"]
    assert +per == +total
    for pieces in slots.values():  # gapless, of one source, of at most a block
        pieces.sort()
        assert len({s for _, _, s in pieces}) == 1
        assert [a for a, _, _ in pieces] == np.cumsum([0] + [n for _, n, _ in pieces])[:-1].tolist()
        assert sum(n for _, n, _ in pieces) <= p.block
    shards = Counter(s for s, _ in slots)
    assert all(n == p.slots for s, n in shards.items() if s < max(shards)) and sorted(shards) == list(range(len(shards)))


def test_slots_are_permutations():
    r = random.Random(2)
    for n in [1, 2, 3, 17, 64, 1000]:
        for key in (1, 2**40 + r.randrange(99)):
            got = mixing.permuted(np.arange(n), np.int64(n), np.uint64(key))
            assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(1000), np.int64(1000), np.uint64(1)).tolist() != mixing.permuted(np.arange(1000), np.int64(1000), np.uint64(2)).tolist()


@pytest.mark.parametrize("drawn", [[7, 0, 3, 10], [5, 5, 5, 5], [20, 0, 0, 0]])
def test_draws_are_brought_to_quota(drawn):
    plan = mixing.Plan(["a", "b", "c", "d"], [50, 50, 50, 50], [], np.zeros(4), np.array([5, 2, 10, 3]), np.array([5, 5, 5, 5]))
    drawn = np.array(drawn)
    s = np.repeat(np.arange(4), drawn)
    i = np.concatenate([np.arange(n) for n in drawn])
    got = sorted(zip(*(x.tolist() for x in mixing.dealt(i, s, drawn, plan, mixing.Params()))))
    assert got == [(k, j) for k, n in enumerate([5, 2, 10, 3]) for j in range(n)]


# All three


def test_empty_tables(none, spark):
    nothing = spark.createDataFrame([(1, None, "en", "s"), (2, " . ", None, None)], "doc_id long, text string, lang string, source string")
    assert not divergence.audit(none).collect() and not collocations.mine(none).collect()
    assert not mixing.taken(none, by_rank).collect() and not mixing.mix(none, by_rank).collect()
    assert not collocations.mine(nothing).collect() and not divergence.audit(nothing).collect()
    assert sorted((r["id"], r["size"], r["target"], r["taken"]) for r in mixing.taken(nothing, by_rank).collect()) == [(1, 0, 0.0, 0), (2, 1, 1.5, 1)]


def test_very_long_text(spark):
    """A text of 5 MB among short ones."""
    rows = [(1, "alpha beta gamma. " * 280_000, "en", "s0")] + [(k, "alpha beta delta", "en", f"s{k % 2}") for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert set(audited(df, divergence.Params(min_docs=1))) == audit_by_force(rows, 1, 10)
    p = collocations.Params()
    got = {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations.mine(df, p).collect()}
    assert got == phrases_by_force(rows, p)
    taken = {r["id"]: r["taken"] for r in mixing.taken(df, by_rank).collect()}
    assert sum(taken.values()) in range(int(1.5 * (840_000 + 174)) - 2, int(1.5 * (840_000 + 174)) + 1)


def test_a_block_of_lists_takes_few_bytes_a_word():
    """Phrases of four words of a block: positions and codes take 32 bits."""
    import tracemalloc

    r = np.random.default_rng(3)
    n, m = 400_000, 1000
    words = r.integers(0, m, n)
    order = np.argsort(words, kind="stable").astype(np.int32)
    every = lambda *keys: np.ones(len(keys[0]), bool)
    ids, sizes = np.arange(m), np.bincount(words, minlength=m).astype(np.int32)
    tracemalloc.start()
    (two, three, f) = next(iter(collocations.extended(ids, sizes, order, [every])))
    (left, right, g) = next(iter(collocations.extended(ids, sizes, order, [every, every])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert f.sum() == n - 2 and g.sum() == n - 3
    first = tuple(words[:4].tolist())
    at = np.flatnonzero((left == first[0] << 32 | first[1]) & (right == first[2] << 32 | first[3]))
    assert len(at) == 1 and g[at[0]] == sum(tuple(words[i : i + 4].tolist()) == first for i in range(n - 3))
    assert most < 100 * n


@pytest.mark.parametrize("segment", [1, 2, 7, 50])
def test_phrases_over_the_ends_of_segments_count_once(segment, monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", segment)
    words = np.random.default_rng(5).integers(0, 3, 60)
    places = np.arange(60) + np.arange(60) // 13  # a position is left out between pieces
    order = np.argsort(words, kind="stable")
    every = lambda *keys: np.ones(len(keys[0]), bool)
    at = dict(zip(places.tolist(), words.tolist(), strict=True))
    for k in (2, 3, 4):
        got, want = Counter(), Counter(tuple(at[p + j] for j in range(k)) for p in at if all(p + j in at for j in range(k)))
        for *keys, n in collocations.extended(np.arange(3), np.bincount(words), places[order].astype(np.int32), [every] * (k - 2)):
            for *key, f in zip(*(x.tolist() for x in keys), n.tolist(), strict=True):
                first, rest = (key[0] >> 32, key[0] & 0xFFFFFFFF), key[1:]
                got[first + (() if k == 2 else (rest[0],) if k == 3 else (rest[0] >> 32, rest[0] & 0xFFFFFFFF))] += f
        assert got == want
