"""Language identification by segmentation-marginalised unigrams.

The pieces are the letter pieces of a fixed public vocabulary, in lower case. Every language
has a probability for each piece; the probability of a word is the sum over all its segmentations into
pieces of the product of their probabilities, which a forward algorithm computes. A character that no
piece covers is a piece of its own with a small fixed probability. The piece probabilities are estimated
by expectation-maximisation (forward-backward counts), on a bounded sample of labelled documents, and
smoothed with those of all languages together. A text's score adds up its words' log-probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import crc_of_id, hash_share, slices, table

RUNS = re.compile(r"[^\W\d_]+")  # letters, and the few numerals that are neither digits nor letters
START = "▁"
LONG = 256  # from here on words are summed one at a time
UNKNOWN = 1e-7
BASE = np.uint64(0x9E3779B97F4A7C15)
CELLS = 1 << 20  # characters handled at once


def vocabulary(path: str) -> list[str]:
    """Letter pieces of a sentencepiece model, in lower case, with the mark of a word's start."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size())}
    return sorted(p for p in pieces if p and all(c == START or c.isalpha() for c in p))


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters of a text, in lower case."""
    out = []
    for run in RUNS.findall(text.lower()):
        out += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return out


class Pieces:
    """Hash table from code point strings to piece numbers; 0 stands for no piece."""

    def __init__(self, pieces: list[str]):
        self.n = len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        self.number = {p: i for i, p in enumerate(pieces, 1)}
        self.levels = []
        keys = np.array([_hash(p) for p in pieces], dtype=np.uint64)
        left = np.arange(len(pieces))
        bits = 18
        while len(left):
            slot = _slot(keys[left], bits, len(self.levels))
            held, first = np.unique(slot, return_index=True)
            key, num = np.zeros(1 << bits, dtype=np.uint64), np.zeros(1 << bits, dtype=np.int32)
            key[held], num[held] = keys[left[first]], left[first] + 1
            self.levels.append((bits, key, num))
            left = np.setdiff1d(left, left[first])
            bits = 14

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(h.shape, dtype=np.int32)
        for i, (bits, key, num) in enumerate(self.levels):
            at = _slot(h, bits, i)
            out = np.where(key[at] == h, num[at], out)
        return out


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def _slot(h: np.ndarray, bits: int, level: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * level) >> np.uint64(64 - bits)).astype(np.int64)


def blocks(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions in ``words`` and code points, (words, length), of words of one length, in blocks of bounded size."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, cuts):
        size = max(1, int(lengths[group[0]])) if len(group) else 1
        step = max(1, CELLS // size)
        for at in range(0, len(group), step):
            part = group[at : at + step]
            text = "".join([words[i] for i in part])
            yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(part), size).astype(np.uint64) + np.uint64(1)


def arcs(points: np.ndarray, pieces: Pieces) -> Iterator[tuple[int, list[tuple[int, np.ndarray]]]]:
    """For every end place 1..length: the lengths and piece numbers of the pieces that may end there."""
    size = points.shape[1]
    running: list[np.ndarray] = []  # hashes of the substrings that end at the last place, by length
    with np.errstate(over="ignore"):
        for end in range(1, size + 1):
            c = points[:, end - 1]
            running = [c] + [h * BASE + c for h in running[: min(pieces.longest, end) - 1]]
            yield end, [(n + 1, pieces.find(h)) for n, h in enumerate(running)]


def forward(points: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language, (words, languages); ``probs`` is (pieces, languages)."""
    rows, langs = len(points), probs.shape[1]
    recent = [np.ones((rows, langs))]  # of the last places, latest first
    scale = np.zeros((rows, langs))
    for end, ends in arcs(points, pieces):
        total = np.zeros((rows, langs))
        for n, number in ends:
            p = probs[number]
            if n == 1:
                p = np.where(number[:, None] > 0, p, UNKNOWN)
            total += recent[n - 1] * p
        recent = [total, *recent][: pieces.longest]
        if end % 8 == 0:
            top = np.maximum(recent[0], 1e-300)
            scale += np.log(top)
            recent = [r / top for r in recent]
    return scale + np.log(np.maximum(recent[0], 1e-300))


def forward_long(word: str, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """The same for one long word, whose steps a table of pieces takes faster than arrays of one row would."""
    number, longest = pieces.number, pieces.longest
    recent, scale = [np.ones(probs.shape[1])], np.zeros(probs.shape[1])
    for end in range(1, len(word) + 1):
        one = number.get(word[end - 1])
        total = recent[0] * (probs[one] if one else UNKNOWN)
        for n in range(2, min(longest, end) + 1):
            k = number.get(word[end - n : end])
            if k:
                total = total + recent[n - 1] * probs[k]
        recent = [total, *recent[: longest - 1]]
        if end % 8 == 0:
            top = np.maximum(total, 1e-300)
            scale += np.log(top)
            recent = [r / top for r in recent]
    return scale + np.log(np.maximum(recent[0], 1e-300))


def expected(points: np.ndarray, weight: np.ndarray, pieces: Pieces, probs: np.ndarray) -> np.ndarray:
    """Expected piece counts by forward-backward, with one weight for each word and language; words up to 64 code points."""
    rows, size = points.shape
    found = [e for _, e in arcs(points, pieces)]
    langs = probs.shape[1]
    counts = np.zeros((pieces.n, langs))
    for k in range(langs):
        p = np.where(np.arange(pieces.n) > 0, probs[:, k], 0.0)
        alpha, beta = np.zeros((size + 1, rows)), np.zeros((size + 1, rows))
        alpha[0], beta[size] = 1.0, 1.0
        value = lambda n, number: np.where(number > 0, p[number], UNKNOWN if n == 1 else 0.0)
        for end in range(1, size + 1):
            for n, number in found[end - 1]:
                alpha[end] += alpha[end - n] * value(n, number)
        for end in range(size, 0, -1):
            for n, number in found[end - 1]:
                beta[end - n] += beta[end] * value(n, number)
        whole = weight[:, k] / np.maximum(alpha[size], 1e-300)
        for end in range(1, size + 1):
            for n, number in found[end - 1]:
                counts[:, k] += np.bincount(number, alpha[end - n] * value(n, number) * beta[end] * whole, minlength=pieces.n)
    counts[0] = 0
    return counts


@dataclass(frozen=True)
class Model:
    langs: list[str]
    pieces: Pieces
    probs: np.ndarray
    prior: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        usual = np.array([i for i, w in enumerate(words) if len(w) < LONG], dtype=np.int64)
        for part, points in blocks([START + words[i] for i in usual]):
            out[usual[part]] = forward(points, self.pieces, self.probs)
        for i, w in enumerate(words):
            if len(w) >= LONG:
                out[i] = forward_long(START + w, self.pieces, self.probs)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of each text; 'und' and 0 for texts without letters."""
        known: dict[str, int] = {}
        ids, ends = [], [0]
        for t in texts:
            ids += [known.setdefault(w, len(known)) for w in letter_runs(t)] if isinstance(t, str) else []
            ends.append(len(ids))
        per_word = self.word_scores(list(known))
        sums = np.zeros((len(texts), len(self.langs)))
        which = np.repeat(np.arange(len(texts)), np.diff(ends))
        numbers = np.array(ids, dtype=np.int64)
        for k in range(len(self.langs)):
            sums[:, k] = np.bincount(which, per_word[numbers, k], minlength=len(texts)) if len(numbers) else 0.0
        logp = sums + self.prior
        best = logp.argmax(axis=1)
        score = 1.0 / np.exp(logp - logp.max(axis=1, keepdims=True)).sum(axis=1)
        some = np.diff(ends) > 0
        return [self.langs[b] if s else "und" for b, s in zip(best, some)], np.where(some, score, 0.0)


def train(counts: pd.DataFrame, prior: dict[str, int], vocab: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """Model from word counts (lang, word, n). Runs of 64 letters or more, which are hardly words, take no part in the fit;
    their expectations would need scaled sums. They are scored like others."""
    langs = sorted(prior)
    pieces = Pieces(vocab)
    probs = np.full((pieces.n, len(langs)), 1.0 / pieces.n)
    probs[0] = 0.0
    wide = counts.pivot_table(index="word", columns="lang", values="n", aggfunc="sum", fill_value=0).reindex(columns=langs, fill_value=0)
    wide = wide[wide.index.str.len() < 64]
    words, weight = [START + w for w in wide.index], wide.to_numpy(np.float64)
    for _ in range(rounds):
        seen = np.zeros_like(probs)
        for part, points in blocks(words):
            for at in range(0, len(part), 1 << 14):
                seen += expected(points[at : at + (1 << 14)], weight[part[at : at + (1 << 14)]], pieces, probs)
        own = seen / np.maximum(seen.sum(axis=0), 1.0)
        shared = (seen.sum(axis=1) + 0.01) / (seen.sum() + 0.01 * pieces.n)
        probs = (1 - smooth) * own + smooth * shared[:, None]
        probs[0] = 0.0
    return Model(langs, pieces, probs, np.log(np.array([prior[x] for x in langs]) / sum(prior.values())))


def identify(docs: DataFrame, learn_from: DataFrame, vocabulary_path: str, docs_per_language: int = 400) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs``.

    ``learn_from`` (doc_id, text, lang) is the labelled part; ``docs_per_language`` bounds the documents of each
    language that the fit reads, chosen by a hash of the id. Texts that are null or have no letter are 'und' with
    score 0, and so are all if nothing is labelled. Ties go to the first language in alphabetical order; repeated
    rows are each scored; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    labelled = learn_from.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    prior = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    model = None
    if prior:
        share = reduce(lambda c, x: F.when(F.col("lang") == x, min(1.0, docs_per_language / prior[x])).otherwise(c), prior, F.lit(0.0))
        chosen = labelled.where(hash_share(F.col("doc_id"), "langid") < share)

        def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                rows = [(lang, w) for lang, t in zip(pdf["lang"], pdf["text"]) for w in letter_runs(t)]
                if rows:
                    yield pd.DataFrame(rows, columns=["lang", "word"]).groupby(["lang", "word"]).size().reset_index(name="n")

        counts = chosen.select("lang", "text").mapInPandas(split, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")).toPandas()
        model = train(counts, prior, vocabulary(vocabulary_path))
    shared = spark.sparkContext.broadcast(model)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in slices(parts, rows=2_000):
            names, scores = m.predict(list(pdf["text"])) if m else (["und"] * len(pdf), np.zeros(len(pdf)))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": names, "score": scores})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, lang_pred string, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    got = identify(docs, docs.where(crc_of_id() % 4 != 2), str(public_tokenizers.path("piece_bpe_32k.model")))
    return got.select("doc_id", (crc_of_id() % 4 == 2).alias("held_out"), "lang_pred", "score")
