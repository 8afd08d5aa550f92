"""Quality classifier from weak labels.

Overlapping heuristic labellers vote junk, fine or nothing on every document. Expectation-maximisation
over the table of vote patterns (at most 4 ** 8 rows, counted over all documents) estimates how each
labeller votes on junk and on fine documents, and how common junk is; a pattern's posterior is the weak label. The
posteriors train a linear scorer over hashed features, frequencies of character-class 4-grams and binned
statistics, which then scores every document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import durable, hash_share, table, unused

BUCKETS = 1 << 12
STATS = ("symbols", "letters", "upper", "ends", "distinct", "top", "lines", "packed")
# fixed values: (fine up to, junk from) for each statistic; between the two a labeller does not vote
CUTS = {
    "symbols": (0.03, 0.08),  # share of characters that are neither letters, digits, white space nor .,;:'"-()
    "letters": (0.08, 0.2),  # share of characters other than white space that are no letters
    "upper": (0.2, 0.5),  # share of letters that are capitals
    "ends": (0.25, 0.6),  # share of words that end in a symbol
    "distinct": (0.55, 0.8),  # share of words that repeat an earlier word of the text, against that expected of its length
    "top": (0.15, 0.3),  # share of the most frequent word
    "lines": (0.2, 0.5),  # share of repeated 3-word sequences
    "packed": (0.7, 0.85),  # share of bytes that compression saves
}
FEW = 8  # with fewer words, statistics of repetition say nothing
PLAIN = frozenset(".,;:'\"-()?’“”«»¿¡–—…")


def statistics(text: str | None) -> list[float | None]:
    """One number for each of STATS, None where the text is too short for it."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [None] * len(STATS)
    kinds = Counter(text)
    symbols = sum(c for k, c in kinds.items() if not (k.isalnum() or k.isspace() or k in PLAIN))
    letters = sum(c for k, c in kinds.items() if k.isalpha())
    upper = sum(c for k, c in kinds.items() if k.isupper())
    blank = sum(c for k, c in kinds.items() if k.isspace())
    out: list[float | None] = [symbols / chars, 1 - letters / (chars - blank), upper / letters if letters >= 10 else None]
    out.append(sum(1 for w in words if not (w[-1].isalnum() or w[-1] in PLAIN)) / n)
    if n < FEW:
        return [*out, None, None, None, None]
    count = Counter(words)
    usual = min(0.75, 0.06 * n**0.33)  # repetition that running text of the length has anyway
    out.append(max(0.0, (1 - len(count) / n - usual) / (1 - usual)))
    out.append(max(count.values()) / n)
    grams = list(zip(words, words[1:], words[2:]))
    out.append(1 - len(set(grams)) / len(grams))
    raw = text.encode()
    out.append(1 - len(zlib.compress(raw, 1)) / len(raw) if len(raw) >= 300 else None)
    return out


def votes(stats: list[float | None]) -> str:
    """A character for each labeller: j for junk, f for fine, - for undecided, . for a text too short to be judged."""
    out = ""
    for name, x in zip(STATS, stats):
        fine, junk = CUTS[name]
        out += "." if x is None else "j" if x >= junk else "f" if x <= fine else "-"
    return out


def em(patterns: dict[str, int], rounds: int = 50, strength: float = 0.02) -> dict[str, float]:
    """Posterior of junk for each vote pattern. Priors weigh ``strength`` of all documents: labellers are right more often than not."""
    keys = list(patterns)
    if not keys:
        return {}
    n = np.array([patterns[k] for k in keys], dtype=np.float64)
    marks = np.array([["jf-.".index(c) for c in k] for k in keys])  # the last one is missing, and says nothing
    prior_junk, prior_fine = np.array([0.45, 0.25, 0.3]), np.array([0.02, 0.78, 0.2])
    weight = max(1.0, strength * n.sum())
    post = np.clip((marks == 0).sum(axis=1) - 0.25 * (marks == 1).sum(axis=1) / marks.shape[1], 0.02, 0.98)
    for _ in range(rounds):
        junk = (n @ post + 0.1 * weight) / (n.sum() + weight)
        logs = np.full(len(keys), np.log(junk / (1 - junk)))
        for j in range(marks.shape[1]):
            votes_junk = np.bincount(marks[:, j], n * post, 4)[:3] + weight * prior_junk
            votes_fine = np.bincount(marks[:, j], n * (1 - post), 4)[:3] + weight * prior_fine
            says = np.log(votes_junk / votes_junk.sum()) - np.log(votes_fine / votes_fine.sum())
            logs += np.append(says, 0.0)[marks[:, j]]
        post = 1 / (1 + np.exp(-np.clip(logs, -30, 30)))
    return dict(zip(keys, post.tolist()))


_CLASS = np.full(256, 3, dtype=np.int64)  # other symbols
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[list(b"abcdefghijklmnopqrstuvwxyz") + list(range(128, 256))] = 1
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_CLASS[list(b"0123456789")] = 4
_CLASS[list(b".,;:'\"-()?")] = 5
_CLASS[list(b"!")] = 6
_CLASS[list(b"|")] = 7


def hashed(text: str | None, stats: list[float | None]) -> np.ndarray:
    """BUCKETS features: half for the square roots of 4-gram frequencies, hashed, half for binned statistics, hashed."""
    out = np.zeros(BUCKETS)
    c = _CLASS[np.frombuffer((text or "").encode(), dtype=np.uint8)]
    half = BUCKETS // 2
    if len(c) >= 4:
        g = ((c[:-3] * 8 + c[1:-2]) * 8 + c[2:-1]) * 8 + c[3:]
        out[:half] = np.sqrt(np.bincount((g * 0x9E3779B1 >> 7) % half, minlength=half) / len(g))
    for name, x in zip(STATS, stats):
        if x is None:
            continue
        level = int(min(x, 1.0) * 20)
        out[half + zlib.crc32(f"{name}={level}".encode()) % half] = 0.5
    return out


def fit_linear(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Weights (last one the intercept) of a logistic regression on soft labels, by accelerated gradient steps.

    A row of ``x`` holds the places of its features that are not 0, at least one, and their values; nothing dense is made of them."""
    size, first = BUCKETS + 1, np.cumsum([0] + [len(at) + 1 for at, _ in x])[:-1]
    at = np.concatenate([part for places, _ in x for part in (places, [BUCKETS])]).astype(np.int64)
    value = np.concatenate([part for _, values in x for part in (values, [1.0])]).astype(np.float64)
    row = np.repeat(np.arange(len(x)), np.diff(np.append(first, len(at))))
    step = 4.0 / (np.add.reduceat(value * value, first).max() + l2)
    w = z = np.zeros(size)
    for k in range(rounds):
        off = 1 / (1 + np.exp(-np.clip(np.add.reduceat(value * z[at], first), -30, 30))) - y
        nxt = z - step * (np.bincount(at, value * off[row], size) / len(y) + l2 * z)
        z = nxt + k / (k + 3) * (nxt - w)
        w = nxt
    return w


def _fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Weights from the rows (y, at, x) of a bounded sample, in one executor's task."""
    rows = [r for p in parts for r in p.itertuples(index=False, name=None)]
    if rows:
        rows.sort(key=lambda r: (r[0], len(r[1])))  # much the same sums whatever the order of arrival
        yield pd.DataFrame({"weights": [fit_linear([r[1:] for r in rows], np.array([r[0] for r in rows]))]})


def classify(docs: DataFrame, sample_docs: int = 3_000, threshold: float = 0.5) -> DataFrame:
    """``docs`` with _rl_quality (0 to 1, higher is better), _rl_weak (posterior of being fine) and _rl_keep.

    Null, empty and blank texts have quality 0 and are not kept: there is nothing to learn from. Very short texts
    are judged by the labellers that can vote. Ties and repeated rows are scored alike; an empty table gives no
    rows; all other columns pass as they came, but columns of the three names give way to the new ones. ``sample_docs`` bounds the weakly labelled rows that fit the scorer
    (chosen by a hash of the text; about that many); votes are counted over all documents.
    """
    spark = docs.sparkSession

    def vote(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"pattern": [votes(statistics(t if isinstance(t, str) else None)) for t in pdf["text"]], "h": pdf["h"]})

    text_hash = F.xxhash64(F.col("text"), F.lit("quality"))
    voted = durable(docs.where(F.col("text").isNotNull()).select("text", text_hash.alias("h")).mapInPandas(vote, "pattern string, h bigint").groupBy("pattern", "h").count())
    patterns = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.sum("count").alias("n")).collect()}
    posterior = em(patterns)
    total = voted.count()  # different texts
    share = min(1.0, sample_docs / max(1, total))
    chosen = docs.where(F.col("text").isNotNull() & (hash_share(text_hash, "sample") < share)).dropDuplicates(["text"])

    def build(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for t in pdf["text"]:
                s = statistics(t)
                x = hashed(t, s)
                at = np.flatnonzero(x)
                rows.append((posterior.get(votes(s), 0.5), at.astype(np.int32), x[at].astype(np.float32)))
            yield pd.DataFrame(rows, columns=["y", "at", "x"])

    built = chosen.select("text").mapInPandas(build, "y double, at array<int>, x array<float>")
    fitted = built.repartition(1).mapInPandas(_fit, "weights array<double>").collect()  # one row, or none
    weights = np.array(fitted[0]["weights"]) if fitted else np.zeros(BUCKETS + 1)
    shared = spark.sparkContext.broadcast((weights, posterior))

    @F.pandas_udf("struct<quality:double,weak:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        w, post = shared.value
        out = []
        for t in texts:
            if not isinstance(t, str) or not t.strip():
                out.append((0.0, 0.0))
                continue
            s = statistics(t)
            junk = 1 / (1 + np.exp(-np.clip(hashed(t, s) @ w[:-1] + w[-1], -30, 30)))
            out.append((1 - float(junk), 1 - post.get(votes(s), 0.5)))
        return pd.DataFrame(out, columns=["quality", "weak"])

    own = unused(docs) + "score"
    kept = [c for c in docs.columns if c not in ("_rl_quality", "_rl_weak", "_rl_keep")]
    scored = docs.select(*kept, score(F.col("text")).alias(own))
    quality = F.col(f"{own}.quality")
    return scored.select(*kept, quality.alias("_rl_quality"), F.col(f"{own}.weak").alias("_rl_weak"), (quality >= threshold).alias("_rl_keep"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.col("_rl_quality").alias("quality"), F.col("_rl_weak").alias("weak_label"), F.col("_rl_keep").alias("keep"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their columns; null, empty and blank texts go.

    Repeated rows are judged alike; an empty table gives no rows; other columns pass unread."""
    own = unused(docs)
    named = {c: c if c not in ("_rl_quality", "_rl_weak", "_rl_keep") else own + c for c in docs.columns}
    return classify(docs.withColumnsRenamed({c: n for c, n in named.items() if c != n})).where("_rl_keep").select(*[F.col(n).alias(c) for c, n in named.items()])
