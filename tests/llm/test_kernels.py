"""Kernels against plain Python."""

import os

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from galleria.llm import html_extract as H
from galleria.llm import kernels as K
from galleria.llm import ngram_join, packing, quality_rules, suffix_dedup
from galleria.llm.suffix_array import lcp_array, suffix_array

os.environ["TOKENIZERS_PARALLELISM"] = "false"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(body):
    s = [*body, 0]
    sa = suffix_array(s)
    assert sa == sorted(range(len(s)), key=lambda i: s[i:])
    for k, n in enumerate(lcp_array(s, sa)):
        if k:
            a, b = s[sa[k - 1] :], s[sa[k] :]
            assert n == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab \t\n\x0b1é,A", max_size=20)), min_size=1, max_size=6))
def test_words(texts):
    buf, offs = K.text_buffers(pa.array(texts, pa.string()))
    w = K.Words(buf, offs, K.NOT_SPACE)
    data = buf.tobytes()
    for d, t in enumerate(texts):
        got = [data[a:b] for a, b in zip(w.starts[w.first[d] : w.first[d + 1]], w.ends[w.first[d] : w.first[d + 1]])]
        assert got == (t or "").encode().split()
    h = w.hashes()
    assert len(set(h.tolist())) == len({data[a:b] for a, b in zip(w.starts, w.ends)})


PIECES = ["a", "B", "\x0b", " ", "\n", "\x1c", "\x85", "\xa0", "é", "É", "é", "́", "'s", "'", "1", "2", "<|endoftext|>", "<", "|", "Σ", "İ", "你", " ", "!", "##", "😀", "\x00", "ß", "×", "ñ"]


@pytest.fixture(scope="module")
def enc():
    from galleria.llm import tokens

    return tokens.encoder(tokens.default_tokenizer())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_encoding_equals_the_tokenizer(enc, text):
    buf, offs = K.text_buffers(pa.array([text, "x", text]))
    ids, at = enc.encode(K.Words(buf, offs, K.NOT_SPACE), offs)
    assert ids[at[2] : at[3]].tolist() == ids[: at[1]].tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_first_fit_decreasing(sizes):
    bins, offs = packing.first_fit_decreasing(np.array(sizes, np.int64), 50)
    open_ = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b = next((k for k, used in enumerate(open_) if used + sizes[i] <= 50), len(open_))
        if b == len(open_):
            open_.append(0)
        assert (bins[i], offs[i]) == (b, open_[b])
        open_[b] += sizes[i]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=0, max_size=40), min_size=1, max_size=6))
def test_repeated_runs_of_contexts(texts):
    """Runs of 6 bytes that two texts hold at the same place from an anchor at their start."""
    p = suffix_dedup.Params(length=6, gram=2, symbol=2)
    bodies = [t.encode() for t in texts]
    ctx, start = suffix_dedup.repeated_starts(bodies, [0] * len(bodies), [1] * len(bodies), p)
    want = {(i, s) for i, a in enumerate(bodies) for s in range(len(a) - 5) if any(i != j and b[s : s + 6] == a[s : s + 6] for j, b in enumerate(bodies))}
    assert set(zip(ctx.tolist(), start.tolist())) == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc", min_size=0, max_size=200))
def test_anchors_cover_every_run(text):
    p = suffix_dedup.Params(length=20, gram=5, symbol=4)
    buf = np.frombuffer(text.encode(), np.uint8)
    at, _ = suffix_dedup.anchors(K.Rolling(buf), np.array([0, len(buf)]), p)
    for s in range(len(text) - 19):
        assert any(s <= a <= s + 15 for a in at)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 400), min_size=1, max_size=120), st.integers(0, 12), st.integers(0, 12), st.sampled_from([80, 90]), st.sampled_from([0, 5, 9]), st.randoms())
def test_similar_sets_share_an_index_entry(base, drop, add, percent, top, rnd):
    p = ngram_join.Params(percent=percent)
    a = sorted(base)
    b = sorted((set(a) - set(rnd.sample(a, min(drop, len(a) - 1)))) | {1000 + k for k in range(add)})
    if len(set(a) & set(b)) * 100 < percent * len(set(a) | set(b)) or a == b:
        return
    powers = lambda x: np.array([(0, 6, 10)[v * mult % 7 % 3] for v in x], np.int64)
    for mult in (0, 1, 3):
        ka, kb = (set(ngram_join.index_keys(np.array(x, np.uint64), powers(x) if mult < 3 else powers(x) * 0 + top, p).tolist()) for x in (a, b))
        assert ka & kb
    assert ngram_join.sketch_distance(*(ngram_join.sketch(np.array(x, np.uint64)) for x in (a, b))) <= len(set(a) ^ set(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(1, 12), min_size=1, max_size=10), min_size=1, max_size=12), st.sampled_from([60, 80]))
def test_solve(sets, percent):
    """Components of a block whose sets all share a bucket."""
    n = np.array([len(x) for x in sets], np.int64)
    k, ones = len(sets), np.ones(len(sets), np.int64)
    links = ngram_join.solve(n, np.array([t for x in sets for t in sorted(x)]), ones, ones, np.arange(k), ones * 0, percent)
    assert len(links) < k and all(len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j]) for i, j in links)

    def groups(pairs):
        of = list(range(k))
        for i, j in pairs:
            of = [of[i] if x == of[j] else x for x in of]
        return {frozenset(i for i in range(k) if of[i] == g) for g in set(of)}

    every = [(i, j) for i in range(k) for j in range(i) if len(sets[i] & sets[j]) * 100 >= percent * len(sets[i] | sets[j])]
    assert groups(links) == groups(every)


def test_line_normal_form():
    assert quality_rules.normal_line(b" Page 12  of\t345 ") == b"page 0 of 0"


ARTICLE = "This is the story of a man who was in the house and it was the best of the days that he had seen for a long time."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        (f"<nav><a href=x>Menu</a></nav><article><h1>T &amp; U</h1><p><b>Short.<br><p>{ARTICLE}</article><footer>c</footer>", f"T & U Short. {ARTICLE}"),
        (f'<body class="has-sidebar"><div id=main><h1>Title</h1><p>{ARTICLE}</p></div><div class="comment-list"><p>{ARTICLE}</p></div>', f"Title {ARTICLE}"),
        (f'<article><p>{ARTICLE}</p><script>var t = "</p><p>no</p>";</script><div class="ad-box">Buy</div><form>Name</form><!-- <p>no</p> --><p>one\n  two&nbsp;three</article>', f"{ARTICLE} one two three"),
        (f'<p hidden>no</p><div><p>{ARTICLE}<p>End.</div><ul><li><a href="/a">aaaa</a><li><a href="/b">bbbb</a></ul>', f"{ARTICLE} End."),
        ("<p>a<b", ""),
    ],
)
def test_html(page, text):
    assert H.main_text(page) == text


def test_no_runs_cover_nothing():
    from galleria.llm import suffix_dedup

    none = np.zeros(0, np.int64)
    assert [len(x) for x in suffix_dedup._covers(none, none, 400)] == [0, 0, 0]


def test_equal_places_of_a_batch_go_on_once():
    """op8: copies of a text in a batch send a place once, and rows that the bitmap leaves out not at all."""
    from types import SimpleNamespace

    keep = suffix_dedup._keep_rows(SimpleNamespace(value=SimpleNamespace(may_hold=lambda h: h > 1)), 0, True)()
    got = list(keep(pa.record_batch({"c1": [1, 2, 2, 3], "pos": [5, 6, 6, 7]})))
    assert [sorted(zip(*[c.to_pylist() for c in cols])) for cols in got] == [[(2, 6), (3, 7)]]
    assert not list(keep(pa.record_batch({"c1": [1], "pos": [5]})))
