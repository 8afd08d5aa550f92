"""Secret scan: fixed patterns, and a randomness test battery over key-like tokens.

Patterns give the base spans. Beyond them every maximal run of key characters is a candidate if it is
20 characters or longer, mixes digits with letters and overlaps no base span; runs without a digit are words more often
than keys, and runs that hold both + or / and - or _ fit no encoding: neither are tested. The encoding is the
smallest alphabet that holds it, and three tests ask whether it looks drawn uniformly from that
alphabet: chi-squared uniformity (over as many equal bins as its length supports), runs about the
alphabet's middle, and lag-one serial correlation. Fisher's method combines their p-values.

A random token's p-value is uniform, a structured token's is near 0. Within each class of encoding and
length the share of random tokens is estimated from the upper half of all p-values of the corpus
(Storey's estimate), and the threshold is the smallest one at which the expected share of structured
tokens among those reported stays under ``rate``: short classes, whose tests have little power, get
higher thresholds than long ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import durable, slices, table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
KEYWORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
PLACES = tuple({c: i for i, c in enumerate(a)} for a in ALPHABETS)
LENGTHS = (24, 32, 48, 64, 128)
BINS = 50


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, kind number, kind, end) of the fixed patterns, by start and kind."""
    if not text:
        return []
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(token: str) -> int | None:
    """Number of the smallest alphabet that holds the token, if it mixes digits with letters."""
    chars = set(token)
    digits = sum(c in DIGITS for c in chars)
    letters = sum(c.isalpha() for c in chars)
    if not digits or not letters:
        return None
    fits = [i for i, p in enumerate(PLACES) if chars <= p.keys()]
    return min(fits, key=lambda i: (len(ALPHABETS[i]), i)) if fits else None


def randomness(token: str, enc: int) -> float:
    """Combined p-value of uniformity, runs and serial correlation; small means structured."""
    size = len(ALPHABETS[enc])
    x = [PLACES[enc][c] for c in token]
    n = len(x)
    bins = min(size, max(2, n // 5))
    seen = [0] * bins
    for v in x:
        seen[v * bins // size] += 1
    wide = [0] * bins
    for v in range(size):
        wide[v * bins // size] += 1
    chi = sum((o - n * w / size) ** 2 / (n * w / size) for o, w in zip(seen, wide))
    dof = bins - 1
    spread = 2 / (9 * dof)  # Wilson-Hilferty
    p_chi = 0.5 * math.erfc(((chi / dof) ** (1 / 3) - (1 - spread)) / math.sqrt(spread) / math.sqrt(2))
    high = [v * 2 >= size for v in x]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _normal_tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 0.0
    centre = sum(x) / n
    power = sum((v - centre) ** 2 for v in x)
    lag = sum((u - centre) * (v - centre) for u, v in zip(x, x[1:]))
    p_lag = _normal_tail((lag / power + 1 / n) * math.sqrt(n)) if power else 0.0
    half = -sum(math.log(max(p, 1e-12)) for p in (p_chi, p_runs, p_lag))
    return math.exp(-half) * (1 + half + half * half / 2)


def candidates(text: str | None, base: list[tuple[int, int, int]]) -> list[dict]:
    """Key-like tokens outside the base spans (in order of their starts), with class and p-value."""
    taken: list[list[int]] = []  # base spans, those that overlap as one
    for s, _, e in base:
        if taken and s < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, k = [], 0
    for m in TOKEN.finditer(text or ""):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if k < len(taken) and taken[k][0] < m.end():
            continue
        enc = encoding(m[0])
        if enc is None:
            continue
        cls = enc * (len(LENGTHS) + 1) + sum(m.end() - m.start() >= x for x in LENGTHS)
        p = randomness(m[0], enc)
        out.append({"start": m.start(), "end": m.end(), "cls": cls, "bin": min(BINS - 1, int(p * BINS))})
    return out


def thresholds(counts: dict[tuple[int, int], int], rate: float) -> list[int]:
    """Smallest p-value bin that is reported, for each class; from counts by (class, bin)."""
    out = []
    for cls in range(len(ALPHABETS) * (len(LENGTHS) + 1)):
        per = [counts.get((cls, b), 0) for b in range(BINS)]
        random = min(float(sum(per)), (sum(per[BINS // 2 :]) + 0.5) * 2)  # of that class, all p-values together
        at = 1  # under 1/BINS a token always counts as structured
        while at < BINS and (up := sum(per[at:])) and max(0.0, up - random * (1 - at / BINS)) / up > rate:
            at += 1
        out.append(at)
    return out


SPAN = "struct<start:int,ord:int,kind:string,end:int>"
SCANNED = f"base array<{SPAN}>, cands array<struct<start:int,end:int,cls:int,bin:int>>, base_sha256 string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base spans, their digest and the candidates, for every row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in slices(parts):
            base, cands, sha = [], [], []
            for text in pdf["text"]:
                text = text if isinstance(text, str) else ""
                found = base_spans(text)
                base.append([{"start": s, "ord": k, "kind": KINDS[k], "end": e} for s, k, e in found])
                cands.append(candidates(text, found))
                sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found).encode()).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "base": base, "cands": cands, "base_sha256": sha})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {id_type}, {SCANNED}")


def find_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """(doc_id, base, base_sha256, found) per row: ``found`` holds all spans (start, ord, kind, end), base ones included.

    Null and empty texts have none; repeated rows are each scanned; an empty table gives no rows; other
    columns are not read. The corpus-wide table of p-values has at most 48 x 50 rows, whatever the input.
    """
    seen = durable(scan(docs))
    hist = seen.select(F.explode("cands").alias("c")).groupBy("c.cls", "c.bin").count().collect()
    least = F.array(*[F.lit(x) for x in thresholds({(r["cls"], r["bin"]): r["count"] for r in hist}, rate)])
    kept = F.transform(
        F.filter("cands", lambda c: c["bin"] >= F.element_at(least, c["cls"] + 1)),
        lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("ord"), F.lit(KINDS[3]).alias("kind"), c["end"].alias("end")),
    )
    return seen.select("doc_id", "base", "base_sha256", F.array_sort(F.concat("base", kept)).alias("found"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = find_secrets(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return got.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), "base_sha256", spans.alias("spans"))
