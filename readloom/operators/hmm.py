"""Jumping hidden Markov model: reads as mosaics of ancestors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forward(read: np.ndarray, ancestors: np.ndarray, rho: float, mu: float, eps: float, letters: int = 2) -> np.ndarray:
    """Probability of the read's first letters and its ancestor at each place, (places, ancestors).

    Between places the ancestor jumps with probability rho to a uniformly drawn one; a haplotype letter differs from
    the ancestor's with probability mu and a read letter from the haplotype's with eps, evenly over the others."""
    k = len(ancestors)
    same = (1 - mu) * (1 - eps) + mu * eps / (letters - 1)
    emit = np.where(ancestors.T == read[:, None], same, (1 - same) / (letters - 1))
    out = np.zeros((len(read), k))
    out[0] = emit[0] / k
    for j in range(1, len(read)):
        out[j] = emit[j] * ((1 - rho) * out[j - 1] + rho * out[j - 1].sum() / k)
    return out


def log_likelihood(read: np.ndarray, ancestors: np.ndarray, rho: float, mu: float, eps: float, letters: int = 2) -> float:
    return float(np.log(forward(read, ancestors, rho, mu, eps, letters)[-1].sum()))


def brute_force(read: np.ndarray, ancestors: np.ndarray, rho: float, mu: float, eps: float, letters: int = 2) -> float:
    """The same by summing over every sequence of ancestors."""
    k, total = len(ancestors), 0.0
    same = (1 - mu) * (1 - eps) + mu * eps / (letters - 1)
    for z in product(range(k), repeat=len(read)):
        p = 1.0 / k
        for j, a in enumerate(z):
            if j:
                p *= (1 - rho) * (a == z[j - 1]) + rho / k
            p *= same if ancestors[a][j] == read[j] else (1 - same) / (letters - 1)
        total += p
    return total


def constellations(n: int, length: int, letters: int = 2) -> Iterator[np.ndarray]:
    """Every (n, length) matrix over the letters."""
    for cells in product(range(letters), repeat=n * length):
        yield np.array(cells, dtype=np.int64).reshape(n, length)


def _windows(codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A read in windows of n letters, (windows, n), and the length of each; the last one is filled up."""
    count = -(-len(codes) // n)
    out = np.full(count * n, -2, dtype=np.int8)
    out[: len(codes)] = codes
    return out.reshape(count, n), np.minimum(n, len(codes) - n * np.arange(count))


def window_logliks(windows: np.ndarray, lengths: np.ndarray, ancestors: np.ndarray, rho: float, mu: float, eps: float, letters: int) -> np.ndarray:
    """``log_likelihood`` of the first letters, as many as its length, of each window, all windows at a time."""
    k = len(ancestors)
    same = (1 - mu) * (1 - eps) + mu * eps / (letters - 1)
    order = np.argsort(-lengths, kind="stable")
    windows, out = windows[order], np.zeros(len(order))
    active = len(order) - np.searchsorted(np.sort(lengths), np.arange(windows.shape[1]), side="right")  # windows longer than a place
    cur = np.full((len(order), k), 1 / k)
    for j, m in enumerate(active):
        if not m:
            break
        if j:
            cur = (1 - rho) * cur[:m] + rho / k  # rows sum to one
        cur = cur * np.where(ancestors[:, j] == windows[:m, j, None], same, (1 - same) / (letters - 1))
        sums = cur.sum(axis=1)
        out[:m] += np.log(sums)
        cur /= sums[:, None]
    back = np.empty(len(order))
    back[order] = out
    return back


def score_reads(reads: DataFrame, ancestors: list[str], rho: float = 0.05, mu: float = 0.01, eps: float = 0.01, letters: str = "ACGT") -> DataFrame:
    """(read_id, loglik) of each whole read, letter by letter from the ancestors' first.

    A read longer than the shortest ancestor is cut into windows of that length, each of which starts at the
    ancestors' first letter; the log-likelihoods of its windows are added. Reads without letters have 0."""
    n = min(map(len, ancestors))
    if not n:
        raise ValueError("an ancestor has no letters")
    code = np.full(256, -2, dtype=np.int8)
    for i, c in enumerate(letters):
        code[ord(c)] = i
    anc = np.array([[letters.find(c) for c in a[:n]] for a in ancestors], dtype=np.int8)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = np.zeros(len(pdf))
            cut = [_windows(code[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)], n) for s in pdf["seq"]]
            if cut:
                of = np.repeat(np.arange(len(cut)), [len(w) for w, _ in cut])
                found = window_logliks(np.concatenate([w for w, _ in cut]), np.concatenate([m for _, m in cut]), anc, rho, mu, eps, len(letters))
                np.add.at(out, of, found)
            yield pd.DataFrame({"read_id": pdf["read_id"], "loglik": out})

    return reads.select("read_id", "seq").mapInPandas(run, f"read_id {reads.schema['read_id'].dataType.simpleString()}, loglik double")


def total(scored: DataFrame) -> DataFrame:
    return scored.agg(F.sum("loglik").alias("loglik"))
