"""Toxicity scores by gradient-boosted trees over dense features, with isotonic calibration.

The lexicon holds the words that mark toxic documents among the labelled ones, and the stems (word
beginnings of 4 to 7 letters) that are much more frequent in them, both by the log-odds of document
frequency. Features of a text: density and number of lexicon hits, of stem hits, and of hits that appear only
after undoing look-alike digits, separators and stretched letters, proximity of hits to words of the
second person, and densities of capitals, capital words, exclamation marks, punctuation, mixed
letter-digit words, stretched letters and the second person. Trees of small depth are boosted on the logistic loss over
histogram bins; isotonic regression on labelled documents that the trees did not see maps their sums
to probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import crc_of_id, durable, hash_share, slices, table

WORD = re.compile(r"\w+")
MIXED = re.compile(r"[^\W\d_][0-9@$!*.\-]+[^\W\d_]|[0-9@$][^\W\d_]|[^\W\d_][0-9@$]")
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
CAPS = re.compile(r"[A-ZÀ-Þ]")
CAP_WORD = re.compile(r"\b[A-ZÀ-Þ]{3,}\b")
PUNCT = re.compile(r"[^\w\s]")
# fixed values: words of the second person in the languages at hand
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine euch ihr tú ti usted ustedes vosotros".split())
NEAR = 5
FEATURES = 14
STEMS = range(4, 8)


def plain(word: str) -> str:
    """A word with look-alikes, separators and stretched letters undone."""
    w = word.lower().translate(LOOKALIKE)
    w = "".join(c for c in w if c.isalpha())
    return STRETCHED.sub(r"\1", w)


def mixed_words(text: str) -> list[str]:
    """Words, between white space, with digits or symbols among their letters."""
    out, last = [], 0
    for m in MIXED.finditer(text):
        if m.start() < last:
            continue
        lo, hi = m.start(), m.end()
        while lo > last and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        out.append(text[lo:hi])
        last = hi
    return out


@dataclass(frozen=True)
class Lexicon:
    words: frozenset[str]
    stems: frozenset[str]
    heads: frozenset[str]  # first letters of the stems, to pass over other words quickly

    def stem(self, word: str) -> bool:
        return word[: STEMS[0]] in self.heads and any(word[:k] in self.stems for k in STEMS)


def marks(text: str | None) -> set[str]:
    """Words of a text, and their stems with a mark."""
    words = set(WORD.findall(text.lower())) if isinstance(text, str) else set()
    return words | {w[:k] + "^" for w in words for k in STEMS if len(w) >= k}


def features(text: str | None, known: Lexicon) -> list[float]:
    """The dense features of one text; all 0 for null and empty texts."""
    if not text:
        return [0.0] * FEATURES
    lexicon = known.words
    toks = WORD.findall(text.lower())
    n, chars = max(1, len(toks)), len(text)
    at = [i for i, w in enumerate(toks) if w in lexicon]
    spots = mixed_words(text)
    hidden = sum(1 for s in spots if plain(s) in lexicon and not any(w in lexicon for w in WORD.findall(s.lower())))
    stretched = STRETCHED.findall(text)
    if stretched:
        hidden += sum(1 for w in toks if STRETCHED.search(w) and w not in lexicon and STRETCHED.sub(r"\1", w) in lexicon)
    second = sum(1 for w in toks if w in SECOND)
    near = sum(1 for i in at if any(w in SECOND for w in toks[max(0, i - NEAR) : i + NEAR + 1]))
    stems = sum(1 for w in toks if w[: STEMS[0]] in known.heads and known.stem(w))
    hits = len(at) + hidden
    return [
        stems / n,
        math.log1p(stems),
        hits / n,
        math.log1p(hits),
        math.log1p(hidden),
        hidden / n,
        near / n,
        math.log1p(near),
        second / n,
        len(CAPS.findall(text)) / chars,
        len(CAP_WORD.findall(text)) / n,
        text.count("!") / n,
        len(PUNCT.findall(text)) / chars,
        (len(spots) + len(stretched)) / n,
    ]


def learn_lexicon(docs: Counter, toxic: Counter, n_docs: int, n_toxic: int, size: int = 64, least: int = 5, z: float = 4.0) -> Lexicon:
    """Words and stems (marked ^) whose document frequency is significantly higher among toxic documents, by log-odds
    over its standard error: words that mark a document almost surely, and stems that do so by their number."""
    words, stems = [], []
    for w, t in toxic.items():
        c = docs[w] - t
        if t < least:
            continue
        a, b, x, y = t + 0.5, n_toxic - t + 0.5, c + 0.5, n_docs - n_toxic - c + 0.5
        odds = math.log(a / b) - math.log(x / y)
        sure = odds / math.sqrt(1 / a + 1 / b + 1 / x + 1 / y)
        if w[-1] == "^":
            if sure >= 1.25 * z and odds >= 1.5:
                stems.append((-sure, w[:-1]))
        elif sure >= z and t / (t + c) >= 0.9:
            words.append((-t, w))
    kept = frozenset(w for _, w in sorted(stems)[: 4 * size])
    return Lexicon(frozenset(w for _, w in sorted(words)[:size]), kept, frozenset(w[: STEMS[0]] for w in kept))


@dataclass
class Tree:
    """A complete binary tree in arrays: feature and threshold of inner nodes, then leaf values."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(self.depth):
            right = x[np.arange(len(x)), self.feature[node]] > self.threshold[node]
            node = 2 * node + 1 + right
        return self.leaf[node - (2**self.depth - 1)]


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, lam: float, least: float) -> Tree:
    inner = 2**depth - 1
    feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
    node = np.zeros(len(grad), dtype=np.int64)
    for level in range(depth):
        for k in range(2**level - 1, 2 ** (level + 1) - 1):
            rows = np.flatnonzero(node == k)
            best = (1e-9, 0, np.inf, None)
            g_all, h_all = grad[rows].sum(), hess[rows].sum()
            for f, cut in enumerate(edges):
                if not len(rows) or not len(cut):
                    continue
                b = binned[rows, f]
                g, h = np.cumsum(np.bincount(b, grad[rows], len(cut) + 1))[:-1], np.cumsum(np.bincount(b, hess[rows], len(cut) + 1))[:-1]
                gain = g**2 / (h + lam) + (g_all - g) ** 2 / (h_all - h + lam) - g_all**2 / (h_all + lam)
                gain[(h < least) | (h_all - h < least)] = -1
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], f, cut[at], at)
            feature[k], threshold[k] = best[1], best[2]
            right = binned[rows, best[1]] > best[3] if best[3] is not None else np.zeros(len(rows), dtype=bool)
            node[rows] = 2 * k + 1 + right
    leaf = np.zeros(2**depth)
    where = node - inner
    g, h = np.bincount(where, grad, 2**depth), np.bincount(where, hess, 2**depth)
    leaf[:] = -g / (h + lam)
    return Tree(feature, threshold, leaf, depth)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> tuple[float, list[Tree]]:
    """Start value and trees of a logistic boosting."""
    edges = [np.unique(np.quantile(c[c > c.min()], np.linspace(0, 1, bins)))[:-1] if (c > c.min()).any() else np.array([]) for c in x.T]
    edges = [np.unique(np.append((c.min() + c[c > c.min()].min()) / 2, e)) if (c > c.min()).any() else e for c, e in zip(x.T, edges)]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for c, e in zip(x.T, edges)])
    rest = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(rest / (1 - rest)))
    total, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        t = _grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), depth, 1.0, 0.5)
        t.leaf *= rate
        out.append(t)
        total += t.predict(x)
    return start, out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: scores and their non-decreasing probabilities, as knots."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order], y[order]):
        if blocks and blocks[-1][3] == s:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a[0], blocks[-1][1] + a[1], blocks[-1][2], a[3]]
    knots = [(s, v / n) for v, n, lo, hi in blocks for s in ((lo,) if lo == hi else (lo, hi))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


@dataclass
class Model:
    lexicon: Lexicon
    start: float
    trees: list[Tree]
    knots: tuple[np.ndarray, np.ndarray]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.start + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.raw(np.array([features(t, self.lexicon) for t in texts], dtype=np.float64).reshape(-1, FEATURES))
        # calibrated probability, with the raw one mixed in a little so that order survives inside the steps
        return np.clip(0.98 * np.interp(raw, *self.knots) + 0.02 / (1 + np.exp(-raw)), 0.0, 1.0)


def train(x: np.ndarray, y: np.ndarray, apart: np.ndarray, lexicon: Lexicon) -> Model:
    """Trees from the rows not set ``apart``, calibration from those (from all if they lack a class)."""
    fit = ~apart if len(set(y[~apart])) == 2 else np.ones(len(y), dtype=bool)
    start, trees = boost(x[fit], y[fit])
    model = Model(lexicon, start, trees, (np.array([0.0]), np.array([0.0])))
    cal = apart if len(set(y[apart])) == 2 else np.ones(len(y), dtype=bool)
    return Model(lexicon, start, trees, isotonic(model.raw(x[cal]), y[cal]))


def score_toxicity(docs: DataFrame, labelled: DataFrame, sample_docs: int = 12_000) -> DataFrame:
    """(doc_id, score, predicted) for every row of ``docs``.

    ``labelled`` (doc_id, toxic) names the rows of ``docs`` to learn from; null labels are ignored. ``sample_docs``
    bounds the labelled documents that the fit reads, chosen by a hash of the id. Null and empty texts get the
    score of all-zero features; without two classes of labels the score is the labelled share; repeated rows are
    each scored; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    labels = labelled.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    share = min(1.0, sample_docs / max(1, n))
    chosen = lambda df: df.where(hash_share(F.col("doc_id"), "toxicity") < share)
    sample = durable(chosen(docs.select("doc_id", "text")).join(chosen(labels), "doc_id"))

    def vocabulary(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            every, bad = Counter(), Counter()
            for t, y in zip(pdf["text"], pdf["toxic"]):
                own = marks(t)
                every.update(own)
                if y == 1:
                    bad.update(own)
            rows = [(w, c, bad[w]) for w, c in every.items()]
            yield pd.DataFrame(rows, columns=["word", "df", "tf"])

    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    words = (
        sample.select("text", F.col("toxic").cast("int")).mapInPandas(vocabulary, "word string, df bigint, tf bigint")
        .groupBy("word").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).where("tf >= 5 and tf >= 0.2 * df")
    )
    rows = words.collect()
    lexicon = learn_lexicon(Counter({r["word"]: r["df"] for r in rows}), Counter({r["word"]: r["tf"] for r in rows}), size["n"], size["t"])

    def measure(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"apart": pdf["apart"], "toxic": pdf["toxic"], "x": [features(t if isinstance(t, str) else None, lexicon) for t in pdf["text"]]})

    apart = (F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0).alias("apart")
    got = sample.select(apart, F.col("toxic").cast("int"), "text").mapInPandas(measure, "apart boolean, toxic int, x array<double>").toPandas()
    model: Model | float
    if got["toxic"].nunique() == 2:
        model = train(np.array(got["x"].tolist(), dtype=np.float64), got["toxic"].to_numpy(np.float64), got["apart"].to_numpy(bool), lexicon)
    else:
        model = float(got["toxic"].mean()) if len(got) else 0.0
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in slices(parts):
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": m.predict(texts) if isinstance(m, Model) else np.full(len(texts), m)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = table(spark, sf_dir, "labels").where(crc_of_id() % 5 != 0).select("doc_id", "toxic")
    got = score_toxicity(table(spark, sf_dir, "documents"), learn)
    return got.select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", "predicted")
