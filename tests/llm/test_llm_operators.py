"""Every operator against brute force on a small table with nulls, empty, repeated and long texts and clashing columns."""

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from galleria.llm import decontaminate, html_extract, license_scan, ngram_join, packing, quality_rules, suffix_dedup, token_counts, tokens, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gl_text string, gl_t1 long, label int"
WORDS = [f"w{k}" for k in range(40)] + ["the", "of", "Ünder", "naïve", "12", "a,b"]


def corpus():
    r = random.Random(7)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))
    texts = [prose(r.randint(12, 160)) for _ in range(24)]
    base = prose(120)
    for _ in range(8):  # near copies
        w = base.split()
        for _ in range(2):
            w[r.randrange(len(w))] = "edit" + str(r.randint(0, 99))
        texts.append(" ".join(w))
    texts += [base] * 3
    passage = prose(80)
    texts += [prose(30) + " " + passage + "\n" + prose(30) for _ in range(5)]
    texts += ["", "   ", "one", "two words", "x" * 3000, "Is so. " * 300, passage + passage, "short line\n" * 4 + prose(20), "#*$ a|b <c> &d\n" + prose(12), None]
    rows = [(k, t, "en", f"s{k % 2}", len(t or ""), "clash", 5, 1) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], None, None, None, None, None, None), (None, None, "en", "s0", 0, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


TIGHT = {"frequent": 1, "very_frequent": 2, "small_bucket": 2, "block_sets": 3, "pivots": 2}


@pytest.mark.parametrize("k,percent,params", [(3, 90, {}), (5, 80, {}), (3, 90, TIGHT), (1, 60, TIGHT)])
def test_ngram_join(docs, rows, k, percent, params):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    ids = defaultdict(list)
    for r, g in zip(rows, group):
        if r[0] is not None:
            ids[g].append(r[0])
    want = Counter((r[0], len(s), r[0] if not s else min(ids[g], default=None)) for r, s, g in zip(rows, sets, group))
    got = ngram_join.join(docs, ngram_join.Params(words=k, percent=percent, **params))
    assert multiset(got, "doc_id", "n_shingles", "component_id") == want


def test_keep_one_judges_rows(spark):
    r = random.Random(5)
    a, b, c = (" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(60)) for _ in range(3))
    near = a.replace(a.split()[30], "edit")
    rows = [(3, b, "x"), (7, a, "x"), (7, b, "x"), (8, near, "x"), (9, c, "x"), (9, c, "x"), (9, c.upper(), "x"), (None, a, "x"), (5, "", "x"), (6, None, "x"), (5, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, gl_mi string").repartition(3)
    got = Counter((x["doc_id"], x["text"]) for x in ngram_join.keep_one(df).collect())
    one = next(iter({(9, c), (9, c.upper())} & set(got)))
    assert got == Counter([(3, b), (7, a), one, (None, a), (5, ""), (5, ""), (6, None)])


def removed(rows, n):
    raw = [(r[1] or "").encode() for r in rows]
    c = Counter(x[i : i + n] for x in raw for i in range(len(x) - n + 1))
    out = Counter()
    for r, x in zip(rows, raw):
        cover = bytearray(len(x))
        for i in range(len(x) - n + 1):
            if c[x[i : i + n]] > 1:
                cover[i : i + n] = b"\1" * n
        kept = bytes(b for b, m in zip(x, cover) if not m)
        runs = len(re.findall(b"\1+", bytes(cover)))
        out[r[0], len(x), sum(cover), runs, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("params", [{}, {"max_contexts": 1, "band": 7}, {"length": 120, "gram": 30, "symbol": 10}])
def test_suffix_dedup(docs, rows, params):
    p = suffix_dedup.Params(**params)
    got = suffix_dedup.removed(docs, p)
    assert multiset(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, p.length)


def test_texts_of_contexts_are_shuffled_once(spark, docs, rows, monkeypatch):
    """op8: where both sides are shuffled, texts meet what is wanted of them in one shuffle a side, repeated rows told apart in place."""
    plans, keep = {}, suffix_dedup.Scratch.keep

    def noted(scratch, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return keep(scratch, df, name)

    monkeypatch.setattr(suffix_dedup.Scratch, "keep", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = multiset(suffix_dedup.removed(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == removed(rows, 400)
    assert plans["bodies"].count("Exchange hashpartitioning") == 2


def test_repeats_by_bytes_or_words(docs, rows):
    """Texts with a 400-byte string or 51 words that start anywhere else too."""
    raw = [(r[1] or "").encode() for r in rows]
    by = Counter(x[i : i + 400] for x in raw for i in range(len(x) - 399))
    words = [x.split() for x in raw]
    runs = Counter(tuple(w[i : i + 51]) for w in words for i in range(len(w) - 50))
    want = Counter((r[0], any(by[x[i : i + 400]] > 1 for i in range(len(x) - 399)) or any(runs[tuple(w[i : i + 51])] > 1 for i in range(len(w) - 50))) for r, x, w in zip(rows, raw, words))
    assert multiset(suffix_dedup.removed(docs, passages=suffix_dedup.PASSAGES), "doc_id", "repeats") == want
    assert len({x for _, x in want}) == 2


def test_suffix_dedup_keeps_characters_whole(spark):
    a = "é" * 300
    df = spark.createDataFrame([(1, "x" + a, "s"), (2, "yz" + a, "s"), (3, "clean", "s")], "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in suffix_dedup.clean(df).collect()}
    assert got == {1: "x", 2: "yz", 3: "clean"}


def bench_rows(rows):
    w = rows[0][1].split()
    return [(1, " ".join(w[:14]).upper()), (2, "  ".join(w[2:13])), (30, "two words"), (4, "never seen words here at all by any document of this table"), (5, None), (6, ""), (7, ", ; .")]


@pytest.mark.parametrize("bound", [1_000_000, 2])
def test_decontamination(spark, docs, rows, bound):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    bench = [(i, words(t)) for i, t in bench_rows(rows)]
    want = Counter()
    for r in rows:
        w = words(r[1])
        hit, found = set(), set()
        for i, b in bench:
            k = min(10, len(b))
            wins = {tuple(b[x : x + k]) for x in range(len(b) - k + 1)} if b else set()
            for x in range(len(w) - k + 1):
                if tuple(w[x : x + k]) in wins:
                    hit |= set(range(x, x + k))
                    found.add(str(i))
        want[r[0], len(w), len(hit), tuple(sorted(found))] += 1
    table = spark.createDataFrame(bench_rows(rows), "item_id long, text string")
    got = decontaminate.mark(docs, table, max_broadcast=bound)
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()) == want
    left = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, table).collect()}
    assert 0 in left and left[1] == rows[1][1] and not decontaminate.mark(spark.createDataFrame([(0, left[0])], "doc_id long, text string"), table).first()["contaminated"]
    none_left = decontaminate.mark(docs, table.limit(0))
    assert none_left.filter("contaminated").isEmpty()


def test_packing(docs, rows):
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    got = packing.pack(docs, sequence=256, group_pieces=20).collect()
    want = Counter((r[0], len(ids := tok.encode(r[1] or "", add_special_tokens=False).ids + [2]), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))) for r in rows)
    by = defaultdict(list)
    for g in got:
        by[g["doc_id"], g["doc_tokens"]].append(g)
    seq = defaultdict(list)
    for g in got:
        seq[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in seq.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 256
    whole = {(r[0], r[1] or "") for r in rows if r[0] is not None}
    for i, t in whole:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        copies = sum(1 for r in rows if r[0] == i)
        parts = Counter((g["start"], g["length"], g["ids_crc32"]) for g in by[i, len(ids)])
        assert parts == Counter({(s, len(x := ids[s : s + 256]), zlib.crc32(struct.pack(f"<{len(x)}I", *x))): copies for s in range(0, len(ids), 256)})
    assert sum(g["length"] for g in got) == sum(n * c for (_, n, _), c in want.items())


def test_token_counts(spark, docs, rows):
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    n = [len(tok.encode(r[1] or "", add_special_tokens=False).ids) for r in rows]
    sums = token_counts.suffix_sums(token_counts.histogram(docs)).cache()
    assert {r["n_tokens"]: r["n_docs"] for r in sums.collect()} == dict(Counter(n))
    for r in sums.collect():
        x = r["n_tokens"]
        assert (r["docs_over"], r["tokens_over"], r["truncated_tokens"], r["total_tokens"]) == (sum(v > x for v in n), sum(v for v in n if v > x), sum(min(v, x) for v in n), sum(n))
    for r in token_counts.at_limits(sums, [0, 1, 77, 10**6]).collect():
        assert r["truncated_tokens"] == sum(min(v, r["context_limit"]) for v in n)
    q = {r["q"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.5, 1.0]).collect()}
    assert q == {0.5: sorted(n)[-(-len(n) // 2) - 1], 1.0: max(n)}


def test_quality_counts(docs, rows):
    want = Counter()
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        grams = Counter(tuple(w[x : x + 5]) for x in range(len(w) - 4))
        rep = {y for x in range(len(w) - 4) if grams[tuple(w[x : x + 5])] > 1 for y in range(x, x + 5)}
        lines = [x for x in (t or "").split("\n") if x.encode().split()]
        base = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        want[i, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep), base] += 1
    got = quality_rules.judge(docs)
    assert multiset(got, "id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("base_failed AND kept").isEmpty()


def hosts_with_boilerplate():
    """Hosts with 1 to 30 lines that most of their texts hold, and texts whose own words are 0 to 50 % of all; copies and near copies."""
    r = random.Random(2)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    data = []
    for shared in (1, 2, 5, 10, 30):
        for percent in (0, 1, 3, 5, 10, 50):
            host, lines = f"{shared}/{percent}", [prose(12) + " 7" for _ in range(shared)]
            for k in range(r.choice([20, 21, 22, 40])):
                own = round(sum(len(x.split()) for x in lines) * percent / (100 - percent))
                data.append(["\n".join([*[x.replace("7", str(k)).upper() if k % 3 else x for x in lines], prose(own)]), host])
    for k in range(200):  # stubs of one host: boilerplate, and a line of their own
        data.append([f"{STUB}\n{prose(4 + 3 * (k % 2))}", "stubs"])
    base = [prose(12) for _ in range(10)]
    for host, n in (("few near copies", 20), ("near copies", 60)):
        for k in range(n):
            w = [x.split() for x in base]
            w[k % 9][k % 12] = "edit" + prose(1)
            data += [["\n".join(" ".join(x) for x in w), host]] * (1 + k % 2)
    data += [[prose(40) + "\n" + base[9], "near copies" if k < 30 else "few near copies"] for k in range(45)]
    data += [[prose(40) + "\n" + base[9], None], ["", "stubs"], [None, None], [base[9], "near copies"]]
    return [(k, t, h) for k, (t, h) in enumerate(data)]


STUB = " ".join(f"menu{k}" for k in range(120))


@pytest.mark.parametrize("copies", [None, ngram_join.near_copies])
def test_quality_equals_brute_force(spark, copies):
    rows = hosts_with_boilerplate()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    want = {k: t for k, t, _ in quality_by_force(rows, near=copies is not None)}
    assert {x["doc_id"]: x["text"] for x in quality_rules.clean(df, copies=copies).collect()} == want
    assert {x["id"] for x in quality_rules.judge(df, copies=copies).collect() if x["kept"]} == set(want)
    hosts = Counter(h for k, _, h in rows if k in want)
    assert hosts["stubs"] == (200 if copies else 0) and hosts["few near copies"] == 45  # the stubs are alike: one of them stays later
    assert hosts["near copies"] == (30 + 90 if copies else 30)


def test_url_filter(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "a.example.net/en/x/")]
    hosts = ["net", "example.net", "WWW.Example.net", "xnet", "a.b.example.com", "com", "q.org", "a.example.net", ".net", "net.", "", "example.net:80"]
    paths = ["", "/", "/en/", "/en/x/1?y=/de/", "/de/a#b", "/fr/", "?q=/en/", "/EN/", "/fr"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x", "") for h in hosts for p in paths] + [None, "", "a://b://net/", "http://x.net\n/en/"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(urls)], "page_id long, url string, open string")

    def judge(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = re.split(r"[?#]", rest[cut:])[0]
        fit = [(len(r), r, v) for v, r in rules if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
        _, rule, verdict = max(fit, default=(0, None, "allow"))
        return host, path, rule, verdict

    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark, rules), chunks=3).collect()}
    assert got == {k: judge(u) for k, u in enumerate(urls)}
    url_filter.RULES_PER_RUN, before = 2, url_filter.RULES_PER_RUN
    try:
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rule_table(spark, rules), chunks=5).collect()}
    finally:
        url_filter.RULES_PER_RUN = before
    assert got == {k: judge(u) for k, u in enumerate(urls)}


def test_license_scan(spark, docs):
    filler = " ".join(f"z{k}" for k in range(90))
    mit = dict((t, x) for t, _, x in license_scan.TEMPLATES)["mit-permission"]
    cut = " ".join(w for k, w in enumerate(mit.split()) if k % 60 != 30)
    data = [(1, f"{filler} Released under the MIT License. {filler}"), (2, filler + " " + cut), (3, " ".join(mit.split()[:20])), (4, filler), (5, None), (6, "Released under the MIT"), (6, "released UNDER the mit, license")]
    few, license_scan.FEW_SHINGLES = license_scan.FEW_SHINGLES, license_scan.FEW_SHINGLES
    for bound in (few, 0):
        license_scan.FEW_SHINGLES = bound
        got = multiset(license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "template_id")
        assert got == {(1, "mit-short"): 1, (2, "mit-permission"): 1, (6, "mit-short"): 1}
    license_scan.FEW_SHINGLES = few
    assert license_scan.scan(docs).isEmpty()


def test_license_scan_equals_brute_force(spark):
    """All texts with a containment of at least 0.8 in a window of the template's class, with random edits about the limit."""
    r = random.Random(11)
    words = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    data, want = [], set()
    for k in range(300):
        name, _, text = license_scan.TEMPLATES[r.randrange(len(license_scan.TEMPLATES))]
        w = words(text)
        for _ in range(r.randint(0, max(1, len(w) // 25))):
            w[r.randrange(len(w))] = f"edit{k}"
        filler = [f"f{r.randint(0, 9999)}" for _ in range(r.randint(0, 120))]
        data.append((k, " ".join(filler + w + filler)))
    for k, t in data:
        doc = grams(words(t))
        for name, _, text in license_scan.TEMPLATES:
            ts = set(grams(words(text)))
            win = 4
            while win < 2 * len(ts):
                win *= 2
            if ts and max((len(ts & set(doc[i : i + win])) for i in range(0, max(1, len(doc)), win // 2)), default=0) >= 0.8 * len(ts):
                want.add((k, name))
    got = set(multiset(license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")), "doc_id", "template_id"))
    assert got <= want and len(got) >= 0.995 * len(want) and len(want) > 100


def test_clashing_columns(spark):
    """Columns with the names that operators use inside pass by."""
    r = random.Random(12)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 999)) for _ in range(n))
    same, item = prose(120), prose(12)
    names = "t1 t2 k1 k2 id y n html_text gl_id gl_t1 gl_t2 gl_spans gl_m1 gl_m2 gl_mi gl_stays gl_items gl_n_hit gl_from gl_to gl_flagged gl_kept gl_host gl_mh host rep v label".split()
    texts = [same, same + " more", prose(60) + " " + item, prose(60), "", None]
    rows = [(k, t, "s", len(t or ""), *[f"c{k}"] * len(names)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    for out, ids in (
        (quality_rules.clean(df), {0, 1, 2, 3}),
        (ngram_join.keep_one(df), {0, 2, 3, 4, 5}),
        (suffix_dedup.clean(df), {1, 2, 3, 4, 5}),
        (suffix_dedup.clean(df, suffix_dedup.PASSAGES), {1, 2, 3, 4, 5}),
        (decontaminate.remove(df, bench), {0, 1, 2, 3, 4, 5}),
        (decontaminate.remove(df, bench, max_broadcast=3), {0, 1, 2, 3, 4, 5}),
    ):
        got = out.collect()
        assert out.columns == df.columns and {x["doc_id"] for x in got} == ids and all(x[c] == f"c{x['doc_id']}" for x in got for c in names)
        assert all(x["n_chars"] == len(x["text"]) for x in got if x["text"] is not None)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int")
    assert toxicity.score(df, toxicity.fit(df, labels)).count() == 6
    page = spark.createDataFrame([(1, "<p>x</p>", "old")], "page_id long, html string, text string")
    assert html_extract.extract(page).columns == ["page_id", "text", "text_1"]


def random_page(r):
    """(html, blocks as (text, linked, boilerplate, article)) of a well-formed page built from a tree."""
    out, blocks, buf, linked = [], [], [], [0]

    def flush(boiler, article):
        text = " ".join("".join(buf).split())
        if text:
            blocks.append((text, linked[0], boiler, article))
        buf.clear()
        linked[0] = 0

    def words(links):
        t = " ".join(r.choice(["the", "of", "und", "le", "que", "stone", "river", "cloud"]) for _ in range(r.choice([1, 4, 30]))) + " "
        out.append(t)
        buf.append(t)
        linked[0] += len(t) if links else 0

    def node(depth, boiler, article):
        for _ in range(r.randint(1, 4)):
            kind = r.random()
            if depth > 4 or kind < 0.4:
                words(False)
            elif kind < 0.5:
                out.append("<a href='x'>")
                words(True)
                out.append("</a>")
            else:
                name, attrs, bad = r.choice([("div", "", 0), ("section", "", 0), ("div", " class='side-bar ad'", 1), ("nav", "", 1), ("article", "", 0), ("ul", "", 0), ("footer", "", 1)])
                flush(boiler, article)
                out.append(f"<{name}{attrs}>")
                inner = (boiler or bool(bad), article or name == "article")
                node(depth + 1, *inner)
                flush(*inner)
                out.append(f"</{name}>")

    node(0, False, False)
    flush(False, False)
    return "".join(out), blocks


def labels_by_force(blocks):
    """Every open block looks at all decided ones."""
    H = html_extract
    has = any(article and not boiler for _, _, boiler, article in blocks)
    first = []
    for text, linked, boiler, article in blocks:
        words = text.lower().split()
        stops = sum(w in H.STOP_WORDS for w in words) / len(words)
        if boiler or has and not article or linked > H.LINKS * len(text):
            first.append(H.BAD)
        elif len(text) < H.SHORT or stops < (H.STOPS_LOW if article else H.STOPS_HIGH):
            first.append(H.BAD if len(text) >= H.SHORT and not article and stops < H.STOPS_LOW else H.OPEN)
        else:
            first.append(H.GOOD)
    known = [k for k, x in enumerate(first) if x != H.OPEN and (not has or blocks[k][3] and not blocks[k][2])]
    out = []
    for k, x in enumerate(first):
        near = min((abs(d - k) for d in known), default=None)
        at = [first[d] for d in known if abs(d - k) == near]
        out.append(x if x != H.OPEN else max(at) if at else H.GOOD if blocks[k][3] else H.BAD)
    return out


def test_html_equals_brute_force():
    r = random.Random(77)
    seen = Counter()
    for _ in range(400):
        page, want = random_page(r)
        got = html_extract.blocks_of(page)
        assert [(b.text, b.linked, b.boiler, b.article) for b in got] == want
        marks = labels_by_force(want)
        assert html_extract.label(got) == marks
        assert html_extract.main_text(page) == " ".join(b[0] for b, m in zip(want, marks) if m == html_extract.GOOD)
        seen.update(marks)
    assert min(seen.values()) > 100


@pytest.mark.parametrize("page", ["<b>" * 30_000 + "x" + "</i>" * 30_000, "<i><div>" + "<b>" * 30_000 + "x" + "</i>" * 30_000, "<b>" * 30_000 + "<p></p>" * 15_000, "<li>" * 50_000, "<a '>" * 40_000])
def test_html_is_linear(page):
    began = time.process_time()
    html_extract.main_text(page)
    assert time.process_time() - began < 1.5


def test_html_nulls_and_repeats(spark):
    page = "<article><p>" + "the house of the sea and the wind " * 5 + "</p></article>"
    rows = [(1, page, "a"), (1, page, "a"), (2, None, "b"), (3, "", None), (None, "<p>", "c")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert Counter((r["page_id"], r[2]) for r in got.collect()) == Counter({(1, ("the house of the sea and the wind " * 5).strip()): 2, (2, ""): 1, (3, ""): 1, (None, ""): 1})


def test_toxicity_keeps_all_features(spark):
    """2,000 words each in five toxic texts only: all are kept, and each alone tells."""
    words = [f"vile{k:04d}x" for k in range(2000)]
    rows = [(5 * k + c, " ".join(words[(k * 50 + c * 400 + i) % 2000] for i in range(50)), 1) for c in range(5) for k in range(40)]
    rows = [(i, t, y) for i, (_, t, y) in enumerate(rows * 2)] + [(1000 + k, " ".join(f"calm{k % 97}n{j}" for j in range(30)), 0) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.select("doc_id", "toxic"))
    one = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "doc_id long, text string")
    assert model.known.size >= 2000
    scores = [x["score"] for x in toxicity.score(one, model).collect()]
    calm = [x["score"] for x in toxicity.score(df.filter("toxic = 0"), model).collect()]
    assert min(scores) > max(calm)


def test_toxicity(spark):
    r = random.Random(3)
    prose = lambda n: [f"v{r.randint(0, 3000)}" for _ in range(n)]
    data, labels = [], []
    for k in range(900):
        w, toxic = prose(60), k % 5 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["idiot", "grumf", "zarkle"]) if k % 2 else "blorp" + str(r.randint(0, 999))
        data.append((k, " ".join(w), 9.0))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*data, (None, None, None), (5000, "", 0.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model).collect()}
    assert len(got) == 902 and all(0 <= s <= 1 for s in got.values()) and got[5000] < 0.5
    held = [(k, y) for k, y in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == (y == 1) for k, y in held) >= 0.98 * len(held)
    unlabelled = toxicity.fit(docs, lab.limit(0))
    again = {x["doc_id"]: x["score"] for x in toxicity.score(docs, unlabelled).collect()}
    assert again[5000] < 0.5 and max(again.values()) > 0.5


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert ngram_join.join(none).isEmpty() and ngram_join.keep_one(none).isEmpty()
    assert suffix_dedup.removed(none).isEmpty() and quality_rules.judge(none).isEmpty() and quality_rules.clean(none).isEmpty()
    assert decontaminate.mark(none, bench).isEmpty() and packing.pack(none).isEmpty() and license_scan.scan(none).isEmpty()
    assert token_counts.suffix_sums(token_counts.histogram(none)).isEmpty()
    assert toxicity.score(none, toxicity.fit(none, none.select("doc_id", F.col("label").alias("toxic")))).isEmpty()
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).isEmpty() and url_filter.judge(pages, url_filter.rule_table(spark, [("block", "net/")])).isEmpty()


def test_pipeline_stages_keep_clean_documents(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    prose = lambda n: " ".join(r.choice(WORDS) + str(r.randint(0, 5000)) for _ in range(n))
    texts = [prose(90) for _ in range(12)]
    item = prose(15)
    near = texts[0].split()
    near[40] = "other"
    texts += [" ".join(near), texts[1], prose(90) + " " + item, "too short", None]
    for t, x in (("documents", [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]),):
        spark.createDataFrame(x, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / f"{t}.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, seen = df.columns, []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        out = str(tmp_path / name)
        df.write.parquet(out)
        df = spark.read.parquet(out)
        if name != "packing":
            assert df.columns == columns
            seen.append({x["doc_id"]: x["text"] for x in df.collect()})
    clean = set(range(3, 12))
    assert all(clean <= set(s) and all(s[k] == texts[k] for k in clean) for s in seen)
    assert set(seen[0]) == set(range(15)) and set(seen[1]) == set(range(12)) | {14}
    assert item not in seen[3][14] and set(df.select("doc_id").distinct().toPandas()["doc_id"]) == set(seen[3])


def test_pipeline_cuts_passages_of_over_50_words(spark):
    import corpus_pipeline

    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = {n: prose(n) for n in (30, 49, 51, 53, 57, 60)} | {52: " ".join(r.choice("abcdefghij") for _ in range(52))}
    texts = [f"{prose(90)} Q{k} {p} {k}Z {prose(90)}" for p in passages.values() for k in range(2)]
    both = [prose(90) + " Q3. " + passages[30] + " " + passages[49] + " Z3. " + prose(90)]  # neighbours that are too short each
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts + both)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "")
    got = {x["doc_id"]: (x["text"], x["n_chars"]) for x in df.collect()}
    assert set(got) == set(range(len(rows))) and all(n == len(t) for t, n in got.values())
    for k, n in enumerate(passages):
        for i in (2 * k, 2 * k + 1):
            want = texts[i] if n <= 50 else texts[i].replace(passages[n], "")
            assert "".join(got[i][0].split()) == "".join(want.split()), n
    assert got[len(texts)][0] == both[0]


def quality_by_force(rows, limit=20, near=False):
    """Rows that pass the rules, without lines that over `limit` texts of a host hold; near: texts that are alike count once."""
    normal = lambda x: b" ".join(re.sub(rb"[0-9]+", b"0", x.lower()).split())
    held = defaultdict(set)
    texts = sorted({t or "" for _, t, _ in rows})
    kind = dict(zip(texts, near_groups(texts) if near else texts))
    for _, t, host in rows:
        for line in (t or "").encode().split(b"\n"):
            if line.split():
                held[host, normal(line)].add(kind[t or ""])
    out = []
    for i, t, host in rows:
        w = (t or "").encode().split()
        grams = Counter(tuple(w[x : x + 5]) for x in range(len(w) - 4))
        again = {y for x in range(len(w) - 4) if grams[tuple(w[x : x + 5])] > 1 for y in range(x, x + 5)}
        if len(w) < 10 or 100 * len(again) > 20 * len(w):
            continue
        left = [x for x in t.encode().split(b"\n") if not x.split() or len(held[host, normal(x)]) <= limit]
        n = sum(len(x.split()) for x in left)
        if n >= 10 and n * 100 >= len(w) * 20:
            out.append((i, b"\n".join(left).decode(), host))
    return out


def near_groups(texts, k=5, percent=80):
    """A number for each text, equal for those that links join."""
    sets = []
    for t in texts:
        w = t.encode().lower().split()
        sets.append({tuple(w[x : x + k]) for x in range(len(w) - k + 1)} or {tuple(w)})
    group, of = list(range(len(texts))), defaultdict(list)
    for a, s in enumerate(sets):
        for b in {b for x in s for b in of[x]}:
            if group[a] != group[b] and 100 * len(s & sets[b]) >= percent * len(s | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
        for x in s:
            of[x].append(a)
    return group


def near_by_force(rows):
    """The row of the smallest id of each component."""
    least = {}
    for r, g in sorted(zip(rows, near_groups([t for _, t, _ in rows])), key=lambda x: x[0][0]):
        least.setdefault(g, r)
    return list(least.values())


def cut(text, marked, words):
    """text without its marked words; a run goes with what is between its words."""
    raw, out, last = text.encode(), [], 0
    k = 0
    while k < len(words):
        if marked[k]:
            first = k
            while k + 1 < len(words) and marked[k + 1]:
                k += 1
            out.append(raw[last : words[first].start()])
            last = words[k].end()
        k += 1
    return b"".join([*out, raw[last:]]).decode()


def passages_by_force(rows, n=51):
    at = [list(re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())) for _, t, _ in rows]
    runs = Counter(tuple(m.group() for m in w[x : x + n]) for w in at for x in range(len(w) - n + 1))
    out = []
    for (i, t, host), w in zip(rows, at):
        hit = [False] * len(w)
        for x in range(len(w) - n + 1):
            if runs[tuple(m.group() for m in w[x : x + n])] > 1:
                hit[x : x + n] = [True] * n
        left = cut(t, hit, w)
        if left.strip() or not any(hit):
            out.append((i, left, host))
    return out


def benchmark_by_force(rows, bench):
    find = lambda t: list(re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower()))
    items = [[m.group() for m in find(t)] for _, t in bench]
    out = []
    for i, t, host in rows:
        w = find(t)
        hit = [False] * len(w)
        for item in items:
            n = min(10, len(item))
            known = {tuple(item[x : x + n]) for x in range(len(item) - n + 1)} if item else set()
            for x in range(len(w) - n + 1):
                if tuple(m.group() for m in w[x : x + n]) in known:
                    hit[x : x + n] = [True] * n
        if sum(hit) <= len(w) / 2:
            out.append((i, cut(t, hit, w), host))
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Every row of run() on documents with boilerplate, copies, repeated passages, benchmark passages and broken rows."""
    import corpus_pipeline

    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    banner, item, short = prose(14) + " 2024", prose(24), prose(6)
    passages = [prose(n) for n in (50, 51, 58, 90)]
    texts = [prose(r.randint(40, 120)) + "\n" + banner.replace("2024", str(2000 + k)) for k in range(30)]  # boilerplate
    texts += [prose(2) + "\n" + banner]  # hardly anything else
    texts += [f"{prose(40)} {p}\n{prose(20)}" for p in passages for _ in range(3)]
    texts += [passages[3], f"{prose(8)}\n{passages[2]} {passages[3]} {prose(3)}"]
    near = texts[2].split(" ")
    near[10] = "Edited"
    texts += [" ".join(near), texts[3], texts[3].upper(), texts[31]]
    texts += [f"{prose(60)} ({item.upper()}), {prose(30)}", f"{prose(5)} {item}", f"{prose(30)} {short}. {prose(30)}", f"{prose(20)} {item[: len(item) // 2]} {prose(50)}"]
    texts += [prose(9000), "", "   \n ", None, prose(8), prose(6) + " one two three four five six" * 9]
    rows = [(k, t, "host") for k, t in enumerate(texts)]
    bench = [(1, item), (2, short), (3, None), (4, "")]
    table = [(k, t, "en", s, len(t or "")) for k, t, s in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = [rows]
    for step in (quality_by_force, near_by_force, passages_by_force, lambda x: benchmark_by_force(x, bench)):
        steps.append(step(steps[-1]))
    assert [len(x) for x in steps] == sorted((len(x) for x in steps), reverse=True) and len({tuple(x) for x in steps}) == 5
    tok = tokens.encoder(tokens.default_tokenizer()).tokenizer
    want, size = Counter(), packing.SEQUENCE
    for i, t, _ in steps[-1]:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        for s in range(0, len(ids), size):
            want[i, s, len(x := ids[s : s + size]), zlib.crc32(struct.pack(f"<{len(x)}I", *x)), len(ids)] += 1
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert multiset(got, "doc_id", "start", "length", "ids_crc32", "doc_tokens") == want
    seq = defaultdict(list)
    for x in got.collect():
        seq[x["sequence_id"]].append((x["offset"], x["length"]))
    assert all([o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= size for p in seq.values())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_decontamination_takes_one_worker_a_task(spark):
    """Passages are looked up and cut in one map where the benchmark is one slice; an encoder leaves the workers of other tasks."""
    from galleria.llm import common, decontaminate, tokens

    some = spark.createDataFrame([(1, "a b c d e f g h i j k", 21)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    for most, maps in ((1 << 20, 1), (1, 2)):
        out = decontaminate.remove(some, items, max_share=1.0, max_broadcast=most)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == maps
        assert [r["text"].split() for r in out.collect()] == [["k"]]
    kept = tokens.encoder(tokens.default_tokenizer())
    common.take_over(True)
    assert tokens.encoder(tokens.default_tokenizer()) is kept
    common.take_over(False)
    assert not tokens.held()
