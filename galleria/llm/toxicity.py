"""Toxicity: weak supervision by many lexicon and pattern voters.

1. Voters. Lexicon voters are words, pattern voters are word beginnings of 4 to 10 bytes, and either kind may ask for a
   density: at least `dense_count` such words and one in `dense_every`. Besides a built-in lexicon they are mined: what
   stands in toxic labelled rows and hardly in others. A voter votes "toxic" or abstains.
2. Label model. A generative model has, for each voter, the probability of its vote given each label; the given label is one
   more voter, of fixed accuracy. Expectation-maximisation estimates accuracies and posterior labels. Correlations of
   voters (a beginning and the words that have it) are estimated from what the posterior leaves unexplained; a voter's
   evidence is divided by the number of voters it moves with.
3. Classifier. A logistic regression over the features is trained on the posterior labels and scores every document.

Fitting reads a bounded sample of labelled rows: at most `max_toxic` toxic and `max_other` other ones, chosen by a hash of
the id, and returns to the driver the counts of features that at least `min_support` toxic rows of it hold, and its votes, one
entry each. No feature that passes is left out; how many do is bounded by the sample. Scoring is map-only over whole texts;
its model is a broadcast of the features and their weights.

Defined results: null or empty text has no features and gets the score of the bias; rows with label null are not used;
contradicting labels of an id count each; repeated rows are scored each; without any toxic label the built-in lexicon
alone votes; an empty table gives an empty result. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import map_arrow

# Built-in lexicon.
LEXICON = (
    "asshole bastard clown degenerate disgusting dumbass fool idiot imbecile jerk loser moron pathetic scum scumbag stupid trash vermin worthless "
    "abschaum arschloch dummkopf trottel vollidiot connard crétin ordure salaud basura escoria estúpido imbécil"
).split()

HEADS = (4, 5, 6, 7, 8, 9, 10)


@dataclass(frozen=True)
class Params:
    max_toxic: int = 4_000
    max_other: int = 12_000
    min_support: int = 5  #: toxic rows that hold a mined feature
    max_false_share: float = 0.1  #: of the rows that hold it, those not toxic
    dense_count: int = 2
    dense_every: int = 150
    label_accuracy: float = 0.98
    rounds: int = 15
    steps: int = 400
    ridge: float = 1e-4


def feature_hashes(w: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, word of each): words, and their beginnings."""
    n = len(w)
    out, of = [w.hashes()], [np.arange(n)]
    if n:
        h, lens, p = np.zeros(n, np.uint64), w.ends - w.starts, K.powers(0, max(HEADS))
        live = np.arange(n)
        for k in range(max(HEADS)):
            live = live[lens[live] > k]
            h[live] += K.BYTE2[w.buf[w.starts[live] + k]] * p[k]
            if k + 1 in HEADS:
                out.append(K.mix(h[live] + np.uint64(((k + 1) * 0x51ED270B27B4F3CF) & K.M64)))
                of.append(live)
    return np.concatenate(out), np.concatenate(of)


def _words(buf: np.ndarray, offs: np.ndarray) -> K.Words:
    return K.Words(K.LOWER[buf], offs, K.ALNUM)


def lexicon_hashes() -> np.ndarray:
    raw = " ".join(LEXICON).encode()
    return _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes()


def is_held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(y, text) of at most max_toxic + max_other labelled rows that aren't held out; the ids come first and are broadcast."""
    rows = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("lid"), (F.col(label_col) > 0).cast("int").alias("y"))
    rows = rows.filter(~is_held_out("lid")).withColumn("h", F.xxhash64("lid", F.lit(5)))
    toxic = rows.filter("y = 1").orderBy("h", "lid").limit(p.max_toxic)
    other = rows.filter("y = 0").orderBy("h", "lid").limit(p.max_other)
    picked = F.broadcast(toxic.unionByName(other).select("lid", "y"))
    return docs.select(F.col(id_col).alias("did"), F.col(text_col).cast("string").alias("text")).join(picked, F.col("did") == F.col("lid")).select("y", "text")


def text_features(w: K.Words, only: np.ndarray | None, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature hash, text, whether dense) of the features that the texts hold, each once; only: sorted hashes to look for."""
    h, of = feature_hashes(w)
    doc = w.doc()[of] if len(of) else of
    if only is not None:
        small = np.zeros(1 << 16, bool)
        small[(only & np.uint64(0xFFFF)).astype(np.int64)] = True
        pick = np.flatnonzero(small[(h & np.uint64(0xFFFF)).astype(np.int64)])
        pick = pick[np.isin(h[pick], only)]
        h, doc = h[pick], doc[pick]
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    h, doc = h[at], doc[at]
    dense = (times >= p.dense_count) & (times * p.dense_every >= w.counts[doc])
    return np.concatenate([h, h[dense]]), np.concatenate([doc, doc[dense]]), np.concatenate([np.zeros(len(h), bool), np.ones(int(dense.sum()), bool)])


def _count(only: np.ndarray | None, p: Params):
    """Per block: of each feature, the rows and toxic rows of the sample that hold it."""

    def make():
        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            y = batch.column(0).to_numpy()
            for i, j, b, o in K.blocks(buf, offs):
                h, doc, dense = text_features(_words(b, o), only, p)
                for kind in (False, True):
                    pick = dense == kind
                    uniq, back = np.unique(h[pick], return_inverse=True)
                    if len(uniq):
                        yield [uniq, np.full(len(uniq), kind), np.bincount(back), np.bincount(back, weights=y[i:j][doc[pick]]).astype(np.int64)]

        return fn

    return make


@dataclass
class Features:
    """Mined features: sorted hashes, and for each its column as a plain and as a dense one (-1: none)."""

    hashes: np.ndarray
    plain: np.ndarray
    dense: np.ndarray
    size: int

    @classmethod
    def of(cls, h: np.ndarray, dense: np.ndarray) -> Features:
        uniq, back = np.unique(h, return_inverse=True)
        cols = [np.full(len(uniq), -1, np.int64), np.full(len(uniq), -1, np.int64)]
        for c, (b, d) in enumerate(zip(back.tolist(), dense.tolist(), strict=True)):
            cols[int(d)][b] = c
        return cls(uniq, cols[0], cols[1], len(h))


def present(w: K.Words, known: Features, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of every known feature that a text holds, by text."""
    h, doc, dense = text_features(w, known.hashes, p)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(known.hashes, h)
    col = np.where(dense, known.dense[at], known.plain[at])
    ok = col >= 0
    order = np.lexsort((col[ok], doc[ok]))
    return doc[ok][order], col[ok][order]


def _votes(known: Features, p: Params):
    def make():
        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            for i, j, b, o in K.blocks(buf, offs):
                doc, col = present(_words(b, o), known, p)
                yield [batch.column(0).slice(i, j - i), K.list_column(col.astype(np.int32), np.bincount(doc, minlength=j - i), pa.int32())]

        return fn

    return make


@dataclass
class Votes:
    """Which voters each row of the sample has, as two columns sorted by row: as much memory as there are votes."""

    row: np.ndarray
    col: np.ndarray
    rows: int
    voters: int

    def of_rows(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=weight[self.col], minlength=self.rows)

    def of_voters(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=weight[self.row], minlength=self.voters)

    def together(self, step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(voter, other voter, rows that both have) of every two voters that share rows."""
        per = np.bincount(self.row, minlength=self.rows)
        first = np.cumsum(per) - per
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for r in range(0, self.rows, step):
            n, at = per[r : r + step], first[r : r + step]
            one = np.repeat(np.arange(len(n)), n * n)
            k = np.arange(len(one)) - np.repeat(np.cumsum(n * n) - n * n, n * n)
            a, b = self.col[at[one] + k // n[one]].astype(np.int64), self.col[at[one] + k % n[one]]
            new, m = np.unique((a * self.voters + b)[a < b], return_counts=True)
            both, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate([counts, m]), minlength=len(both)).astype(np.int64)
            keys = both
        return keys // self.voters, keys % self.voters, counts


def label_model(votes: Votes, given: np.ndarray, p: Params) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of each row, evidence of each voter, voters it moves with)."""
    sure = np.log(p.label_accuracy / (1 - p.label_accuracy)) * np.where(given == 1, 1.0, -1.0)
    post = np.where(given == 1, p.label_accuracy, 1 - p.label_accuracy)
    moves = np.ones(votes.voters)
    evidence = np.zeros(votes.voters)
    i, j, both = votes.together()
    held = np.bincount(votes.col, minlength=votes.voters)
    for _ in range(p.rounds):
        parts = np.stack([post, 1 - post])
        sums = np.stack([votes.of_voters(x) for x in parts])  # votes by label
        a = (sums[0] + 0.5) / (parts[0].sum() + 1)
        b = (sums[1] + 0.05) / (parts[1].sum() + 1)
        # What two voters share beyond their common label is correlation; voters that share no row have none.
        given_label, square = np.stack([a, b]), parts @ parts.T
        lift = lambda x, y: np.einsum("ki,ki->i", sums[:, x], given_label[:, y])  # noqa: E731, B023
        drawn = lambda x, y: np.einsum("ki,kl,li->i", given_label[:, x], square, given_label[:, y])  # noqa: E731, B023
        every = np.arange(votes.voters)
        sd = np.sqrt(np.maximum((held - 2 * lift(every, every) + drawn(every, every)) / votes.rows, 1e-12))
        corr = (both - lift(i, j) - lift(j, i) + drawn(i, j)) / votes.rows / (sd[i] * sd[j])
        corr = np.where(corr > 0.2, corr, 0)
        moves = 1.0 + np.bincount(i, weights=corr, minlength=votes.voters) + np.bincount(j, weights=corr, minlength=votes.voters)
        evidence = np.log(a / b) / moves
        silent = np.log((1 - a) / (1 - b)) / moves
        prior = np.log((parts[0].sum() + 1) / (parts[1].sum() + 1))
        odds = prior + sure + silent.sum() + votes.of_rows(evidence - silent)
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    return post, evidence, moves


def logistic(x: Votes, y: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels (Adam, full batch; sparse rows keep few weights moving)."""
    n, m = x.rows, x.voters
    w, bias = np.zeros(m + 1, np.float64), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    w[m] = bias
    m1, m2 = np.zeros(m + 1), np.zeros(m + 1)
    for t in range(1, p.steps + 1):
        z = x.of_rows(w[:m]) + w[m]
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = np.append(x.of_voters(r) + p.ridge * w[:m], r.sum())
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-9)
    return w[:m], float(w[m])


@dataclass
class Model:
    known: Features
    weights: np.ndarray
    bias: float
    params: Params


def fit(docs: DataFrame, labels: DataFrame, p: Params | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    from galleria.session import Scratch

    p = p or Params()
    sample = Scratch(docs.sparkSession).keep(labelled_sample(docs, labels, p, id_col, text_col, label_col), "labelled")
    counts = "h long, dense boolean, k long, t long"
    sum_up = lambda df: df.groupBy("h", "dense").agg(F.sum("k").alias("k"), F.sum("t").alias("t"))
    toxic = sum_up(map_arrow(sample.filter("y = 1"), _count(None, p), counts)).filter(~F.col("dense") & (F.col("t") >= p.min_support))
    cand = toxic.select("h").toArrow()["h"].to_numpy().view(np.uint64)
    lex = np.unique(lexicon_hashes())
    got = sum_up(map_arrow(sample, _count(np.union1d(cand, lex), p), counts)).toArrow()
    h, dense, k, t = got["h"].to_numpy().view(np.uint64), got["dense"].to_numpy(zero_copy_only=False), got["k"].to_numpy(), got["t"].to_numpy()
    built_in = np.isin(h, lex) & ~dense
    false_share = (k - t + 0.5) / (k + 1)
    ok = (built_in & (2 * t >= k)) | ((t >= p.min_support) & (false_share <= p.max_false_share))
    best = np.flatnonzero(ok)
    best = best[np.argsort(h[best], kind="stable")]
    if not len(best):  # nothing to learn from: the built-in lexicon alone
        return Model(Features.of(lex, np.zeros(len(lex), bool)), np.full(len(lex), 8.0), -4.0, p)
    known = Features.of(h[best], dense[best])
    rows = map_arrow(sample, _votes(known, p), "y int, f array<int>").toArrow()
    y = rows["y"].to_numpy().astype(np.float64)
    lists = rows["f"].combine_chunks()
    per = np.diff(lists.offsets.to_numpy())
    votes = Votes(np.repeat(np.arange(len(y)), per), lists.flatten().to_numpy(), len(y), known.size)
    post, _, _ = label_model(votes, y, p)
    w, bias = logistic(votes, post, p)
    return Model(known, w, bias, p)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score: a row per row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        m = shared.value

        def fn(batch: pa.RecordBatch):
            buf, offs = K.text_buffers(batch.column(1))
            for i, j, b, o in K.blocks(buf, offs):
                doc, col = present(_words(b, o), m.known, m.params)
                z = m.bias + np.bincount(doc, weights=m.weights[col], minlength=j - i)
                yield [batch.column(0).slice(i, j - i), 1 / (1 + np.exp(-np.clip(z, -30, 30)))]

        return fn

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_arrow(rows, make, f"`{id_col}` {kind}, score double")
