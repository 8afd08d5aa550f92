"""Layout and alignment of reads: dynamic programming, gap propagation, strand choice."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import lanes
from readloom.operators.aggregates import numbered

IUPAC_BITS = {k: sum(1 << "ACGT".index(c) for c in v) for k, v in S.IUPAC.items()}


def substitution(a: str, b: str, match: float = 5.0, mismatch: float = -4.0) -> np.ndarray:
    """Scores of every pair of letters: a match where the sets of bases meet."""
    x, y = (np.array([IUPAC_BITS.get(c.upper(), 0) for c in s], dtype=np.int64) for s in (a, b))
    return np.where((x[:, None] & y[None, :]) > 0, match, mismatch)


def align(a: str, b: str, opening: float = 6.0, extension: float = 3.0, mode: str = "global", scores: np.ndarray | None = None, free_ends: bool = True) -> tuple[float, str, str]:
    """Best alignment with affine gaps (three states): (score, a, b with gaps).

    A gap of n costs opening + (n - 1) extension. ``global`` leaves end gaps free unless ``free_ends`` is False;
    ``local`` is the best-scoring part. Ties prefer pairing, then gaps in b. One row of the table is filled at a time;
    the gap state along the row is a running maximum, so that a row is a few array operations.
    """
    sub = substitution(a, b) if scores is None else scores
    n, m = len(a), len(b)
    if mode == "local":
        free_ends = True
    neg = -1e18
    steps = np.arange(m + 1) * extension
    pair = np.full((n + 1, m + 1), neg)
    up, left = np.full((n + 1, m + 1), neg), np.full((n + 1, m + 1), neg)
    pair[0, 0] = 0.0
    edge = lambda k: 0.0 if free_ends else -(opening + (k - 1) * extension)
    for i in range(1, n + 1):
        up[i, 0] = edge(i)
    for j in range(1, m + 1):
        left[0, j] = edge(j)
    for i in range(1, n + 1):
        before = np.maximum(np.maximum(pair[i - 1], up[i - 1]), left[i - 1])
        if mode == "local":
            before = np.maximum(before, 0.0)
        pair[i, 1:] = before[:-1] + sub[i - 1]
        o, e = (0.0, 0.0) if free_ends and mode == "global" else (opening, extension)
        cost_o, cost_e = np.full(m + 1, opening), np.full(m + 1, extension)
        cost_o[m], cost_e[m] = (o, e)  # a gap past the end of b
        up[i, 1:] = np.maximum(np.maximum(pair[i - 1, 1:], left[i - 1, 1:]) - cost_o[1:], up[i - 1, 1:] - cost_e[1:])
        go, ge = (0.0, 0.0) if free_ends and mode == "global" and i == n else (opening, extension)
        start = np.maximum(pair[i], up[i])
        run = np.maximum.accumulate(start[:-1] + steps[:-1] * (ge / extension if extension else 0.0))
        left[i, 1:] = run - go - steps[:-1] * (ge / extension if extension else 0.0)
    best = np.maximum(np.maximum(pair, up), left)
    if mode == "local":
        i, j = np.unravel_index(int(pair.argmax()), pair.shape)
        if pair[i, j] <= 0:
            return 0.0, "", ""
        score = float(pair[i, j])
    else:
        i, j = n, m
        score = float(best[n, m])
    x, y = [], []
    at = 0 if mode == "local" else int(np.argmax([pair[i, j], up[i, j], left[i, j]]))
    while i > 0 or j > 0:
        if at == 0:
            here = pair[i, j] - sub[i - 1, j - 1]
            i, j = i - 1, j - 1
            x.append(a[i])
            y.append(b[j])
            if mode == "local" and abs(here) < 1e-9 and max(pair[i, j], up[i, j], left[i, j]) <= 1e-9:
                break
            if i == 0 and j == 0:
                break
            at = int(np.argmax([pair[i, j], up[i, j], left[i, j]]))
        elif at == 1:
            if j == 0:
                x.append(a[i - 1])
                y.append("-")
                i -= 1
                continue
            o, e = (0.0, 0.0) if free_ends and mode == "global" and j == m else (opening, extension)
            options = [pair[i - 1, j] - o, up[i - 1, j] - e, left[i - 1, j] - o]
            x.append(a[i - 1])
            y.append("-")
            i -= 1
            at = int(np.argmax(options))
        else:
            if i == 0:
                x.append("-")
                y.append(b[j - 1])
                j -= 1
                continue
            o, e = (0.0, 0.0) if free_ends and mode == "global" and i == n else (opening, extension)
            options = [pair[i, j - 1] - o, up[i, j - 1] - o, left[i, j - 1] - e]
            x.append("-")
            y.append(b[j - 1])
            j -= 1
            at = int(np.argmax(options))
    return score, "".join(reversed(x)), "".join(reversed(y))


def align_linear(a: str, b: str, gap: float, match: float, mismatch: float, mode: str = "global", scores: np.ndarray | None = None) -> tuple[float, str, str]:
    """The same with a linear gap cost and end gaps that count."""
    sub = scores if scores is not None else np.where(np.array(list(a))[:, None] == np.array(list(b))[None, :], match, mismatch) if a and b else np.zeros((len(a), len(b)))
    return align(a, b, gap, gap, mode, sub, free_ends=False)


def profile_scores(profile: list[dict[str, float]], b: str, match: float = 4.0, mismatch: float = -4.0) -> np.ndarray:
    """Expected score of every place of a profile against every letter."""
    return np.array([[sum(p * (match if c == d else mismatch) for c, p in place.items()) for d in b] for place in profile], dtype=np.float64).reshape(len(profile), len(b))


def _spread(reads: DataFrame) -> DataFrame:
    """Reads dealt evenly: an alignment costs far more than moving its read, and files split by bytes, not by work."""
    n = int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reads.select("read_id", "seq").repartition(n, "read_id")


_BIT = np.array([IUPAC_BITS.get(chr(c).upper(), 0) for c in range(128)], dtype=np.int64)


def _bits(s: str) -> np.ndarray:
    if s.isascii():
        return _BIT[np.frombuffer(s.encode(), dtype=np.uint8)]
    return np.array([IUPAC_BITS.get(c.upper(), 0) for c in s], dtype=np.int64)


TOGETHER = 4096  # reads that are aligned at a time


def reverse_complement(s: str) -> str:
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def _better_strands(reference: str, texts: list[str], opening: float, extension: float) -> list[tuple[bool, float, str, str]]:
    """(is_reverse, score, ref_row, read_row) of each text: both strands are scored, one is traced back."""
    costs, n = lanes.Costs(opening, extension), len(reference)
    both = [*texts, *map(reverse_complement, texts)]
    ref, codes = lanes.codes_of(_bits(reference), costs), [lanes.codes_of(_bits(s), costs) for s in both]
    score, place, beyond = lanes.scores(ref, lanes.groups(codes, n, costs.span(n), costs), len(both), costs, ends=True) if costs.fits and n else (np.zeros(len(both)), None, None)
    k = len(texts)
    best = np.where(score[:k] > score[k:], np.arange(k), np.arange(k, 2 * k))
    good = best[score[best] > 0]
    rows = dict(zip(good.tolist(), lanes.trace(reference, ref, [both[i] for i in good], [codes[i] for i in good], score[good], place[good], beyond[good], costs))) if len(good) else {}
    out = []
    for i, b in enumerate(best.tolist()):
        if b in rows:
            out.append((b >= k, float(score[b]), *rows[b]))
        else:
            forward, back = (align(reference, both[x], opening, extension) for x in (i, i + k))
            out.append((False, *forward) if forward[0] > back[0] else (True, *back))
    return out


def best_strand(reads: DataFrame, reference: str, opening: float = 6.0, extension: float = 3.0) -> DataFrame:
    """(read_id, is_reverse, score, ref_row, read_row): the better strand of each read; ties go to the reverse one."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), TOGETHER):
                some = pdf.iloc[lo : lo + TOGETHER]
                own = dict.fromkeys(some["seq"])  # equal reads have one alignment
                rows = pd.DataFrame(_better_strands(reference, list(own), opening, extension), columns=["is_reverse", "score", "ref_row", "read_row"])
                at = dict(zip(own, range(len(own))))
                found = rows.iloc[[at[s] for s in some["seq"]]].reset_index(drop=True)
                found.insert(0, "read_id", some["read_id"].to_numpy())
                yield found

    kind = reads.schema["read_id"].dataType.simpleString()
    return _spread(reads).mapInPandas(run, f"read_id {kind}, is_reverse boolean, score double, ref_row string, read_row string")


def span(a: str, b: str) -> int:
    """Columns of an alignment between its end gaps."""
    first = max(len(x) - len(x.lstrip("-")) for x in (a, b))
    last = min(len(x.rstrip("-")) for x in (a, b))
    return max(0, last - first)


def scores_against(clones: list[str], read: str, opening: float = 6.0, extension: float = 3.0, match: float = 5.0, mismatch: float = -4.0) -> np.ndarray:
    """Scores of the global alignments of a read with several texts, end gaps free: those of ``align``, for all texts at a time,
    a row of all their tables a step and nothing to trace back by."""
    sizes, m = np.array([len(c) for c in clones], dtype=np.int64), len(read)
    out = np.zeros(len(clones))
    if not m or not len(clones):
        return out
    longest = int(sizes.max())
    letters = np.zeros((len(clones), longest), dtype=np.int64)
    for k, c in enumerate(clones):
        letters[k, : len(c)] = _bits(c)
    order = np.argsort(-sizes, kind="stable")  # texts that go on are the first rows
    letters, left_over = letters[order], sizes[order]
    own = _bits(read)
    rows = {b: np.where((own & b) > 0, match, mismatch) for b in np.unique(letters)}
    steps = np.arange(m + 1) * extension
    pair = np.full((len(clones), m + 1), -1e18)
    pair[:, 0] = 0.0
    up, left = np.full_like(pair, -1e18), np.zeros_like(pair)
    left[:, 0] = -1e18
    for i in range(longest):
        live = int((left_over > i).sum())
        pair, up, left = pair[:live], up[:live], left[:live]
        best = np.maximum(np.maximum(pair, up), left)
        opened = np.maximum(pair, left)
        new_up = np.maximum(opened - opening, up - extension)
        new_up[:, m] = np.maximum(opened[:, m], up[:, m])  # past the read's end a gap costs nothing
        new_up[:, 0] = 0.0
        new_pair = np.full_like(pair, -1e18)
        new_pair[:, 1:] = best[:, :-1] + np.stack([rows[b] for b in letters[:live, i]])
        start = np.maximum(new_pair, new_up)
        new_left = np.full_like(left, -1e18)
        new_left[:, 1:] = np.maximum.accumulate(start[:, :-1] + steps[:-1], axis=1) - opening - steps[:-1]
        pair, up, left = new_pair, new_up, new_left
        for k in range(live - 1, -1, -1):
            if left_over[k] > i + 1:
                break
            out[order[k]] = start[k].max()  # then the rest of the read costs nothing
    return out


def _matrix(clones: list[str], reads: list[str], opening: float, extension: float) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """The score of each read (rows) with each clone, and by clone what ``lanes.trace`` needs, if the costs are whole numbers."""
    costs, n = lanes.Costs(opening, extension), max(map(len, clones), default=0)
    if not costs.fits or not n:
        return np.array([scores_against(clones, s, opening, extension) for s in reads]).reshape(len(reads), len(clones)), []
    codes = [lanes.codes_of(_bits(s), costs) for s in reads]
    gs = list(lanes.groups(codes, n, costs.span(n), costs))
    found = [lanes.scores(lanes.codes_of(_bits(c), costs), gs, len(reads), costs, ends=True) if c else (np.zeros(len(reads), dtype=np.int64), None, None) for c in clones]
    return np.stack([f[0] for f in found], axis=1).astype(np.float64), found


def _best(clones: list[str], reads: list[str], opening: float, extension: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each read the first clone of the best score, that score, and the columns of their alignment between its end gaps."""
    score, found = _matrix(clones, reads, opening, extension)
    best, width, costs = score.argmax(axis=1), np.zeros(len(reads), dtype=np.int32), lanes.Costs(opening, extension)
    top = score[np.arange(len(reads)), best]
    for k in np.unique(best):
        own = np.flatnonzero(best == k)
        traced = own[top[own] > 0] if found else own[:0]
        rest = np.setdiff1d(own, traced)
        if len(traced):
            ref, texts = lanes.codes_of(_bits(clones[k]), costs), [reads[i] for i in traced]
            width[traced] = [span(*r) for r in lanes.trace(clones[k], ref, texts, [lanes.codes_of(_bits(s), costs) for s in texts], *(f[traced] for f in found[k]), costs)]
        for i in rest:
            width[i] = span(*align(clones[k], reads[i], opening, extension)[1:])
    return best, top, width


def cross_scores(reads: DataFrame, clones: dict[str, str], opening: float = 6.0, extension: float = 3.0) -> DataFrame:
    """(read_id, clone, score): every read against every clone; clones go to each task, and one read meets all of them at once."""
    names, texts = list(clones), list(clones.values())

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), TOGETHER // 4):
                some = pdf.iloc[lo : lo + TOGETHER // 4]
                own = dict(zip(dict.fromkeys(some["seq"]), range(len(some))))  # equal reads have the same scores
                found = _matrix(texts, list(own), opening, extension)[0]
                for k in range(0, len(some), 256):
                    part = some.iloc[k : k + 256]
                    at = [own[s] for s in part["seq"]]
                    yield pd.DataFrame({"read_id": np.repeat(part["read_id"].to_numpy(), len(names)), "clone": names * len(part), "score": found[at].ravel()})

    kind = reads.schema["read_id"].dataType.simpleString()
    return _spread(reads).mapInPandas(run, f"read_id {kind}, clone string, score double")


def best_clones(reads: DataFrame, clones: dict[str, str], opening: float = 6.0, extension: float = 3.0) -> DataFrame:
    """(read_id, clone, score, span): the clone that each read fits best, the last name of equal ones, and the columns of their
    alignment between its end gaps. Only that alignment is traced back."""
    names = sorted(clones, reverse=True)
    texts = [clones[n] for n in names]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for lo in range(0, len(pdf), TOGETHER // 4):
                some = pdf.iloc[lo : lo + TOGETHER // 4]
                own = dict(zip(dict.fromkeys(some["seq"]), range(len(some))))
                best, score, width = _best(texts, list(own), opening, extension)
                at = np.array([own[s] for s in some["seq"]])
                yield pd.DataFrame({"read_id": some["read_id"].to_numpy(), "clone": [names[b] for b in best[at]], "score": score[at], "span": width[at]})

    kind = reads.schema["read_id"].dataType.simpleString()
    return _spread(reads).mapInPandas(run, f"read_id {kind}, clone string, score double, span int")


def align_pairs(df: DataFrame, method: str = "global", a: str = "a", b: str = "b", opening: float = 6.0, extension: float = 3.0, gap: float = 4.0, match: float = 4.0, mismatch: float = -4.0) -> DataFrame:
    """``df`` with the alignment of its columns ``a`` and ``b``: score, row_a, row_b.

    ``global`` (end gaps free) and ``local`` have affine gaps and IUPAC letters; ``global-linear`` and ``local-linear`` take any
    letters and a linear gap cost; for ``profile``, column ``a`` holds a string like as[df]g, whose places stand for evenly
    shared letters, and end gaps count. Nulls align as empty texts."""
    linear = method in ("global-linear", "local-linear")
    if not linear and method not in ("global", "local", "profile"):
        raise ValueError(f"no method {method}")

    def one(x: str | None, y: str | None) -> tuple[float, str, str]:
        x, y = x or "", y or ""
        if linear:
            return align_linear(x, y, gap, match, mismatch, method.split("-")[0])
        if method == "profile":
            places = [p[1:-1] if p[0] == "[" else p for p in re.findall(r"\[[^\]]+\]|.", x)]
            scores = profile_scores([{c: p.count(c) / len(p) for c in p} for p in places], y, match, mismatch)
            return align_linear("".join(p[0] for p in places), y, gap, match, mismatch, scores=scores)
        return align(x, y, opening, extension, method)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            got = [one(x, y) for x, y in zip(pdf[a], pdf[b])]
            yield pdf.assign(score=[g[0] for g in got], row_a=[g[1] for g in got], row_b=[g[2] for g in got])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{fields}, score double, row_a string, row_b string")


def spread_insertions(rows: DataFrame, width: int) -> DataFrame:
    """(read_id, row): reads of one region (read_id, row of ``width`` letters with n for what they lack, insertions as array of
    (at, text)) as one alignment. Every place where any read has an insertion opens as many columns as the longest of them
    has, before that place; reads without it hold gaps there, and n becomes a gap."""
    each = rows.select(F.explode("insertions").alias("i")).groupBy("i.at").agg(F.max(F.length("i.text")).alias("n"))
    opened = each.agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("o")).scalar()  # no more than ``width`` places
    own = F.map_from_entries(F.transform("insertions", lambda i: F.struct(i["at"], i["text"])))
    piece = lambda o: F.rpad(F.coalesce(F.try_element_at(own, o["at"]), F.lit("")), o["n"], "-")
    step = lambda acc, o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.substring(F.col("row"), acc["at"] + 1, o["at"] - acc["at"]), piece(o)).alias("out"))
    laid = F.aggregate(F.coalesce("_open", F.array().cast("array<struct<at:int,n:int>>")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return rows.withColumn("_open", opened).select("read_id", F.translate(F.concat(laid["out"], F.substring(F.col("row"), laid["at"] + 1, F.lit(width))), "n", "-").alias("row"))


def columns_of(pairs: DataFrame) -> DataFrame:
    """Alignment columns (read_id, col, r, q, ref_pos): ref_pos counts the reference letters so far."""
    long = pairs.select("read_id", F.posexplode(F.zip_with(S.chars(F.col("ref_row")), S.chars(F.col("read_row")), lambda r, q: F.struct(r.alias("r"), q.alias("q")))).alias("col", "x"))
    w = Window.partitionBy("read_id").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    return long.select("read_id", "col", "x.r", "x.q").withColumn("ref_pos", F.sum((F.col("r") != "-").cast("int")).over(w))


def max_insertions(columns: DataFrame) -> DataFrame:
    """(ref_pos, longest): longest insertion after each reference place over all reads."""
    per = columns.where("r = '-'").groupBy("read_id", "ref_pos").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("ref_pos").agg(F.max("n").cast("long").alias("longest"))


_GAP, _NONE = ord("-"), 0x110000  # no letter has that number


def _numbers(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _laid(ref_row: str | None, read_row: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an alignment: which columns are insertions, the reference letters so far and the read's letter at each column."""
    r, q = _numbers(ref_row or ""), _numbers(read_row or "")
    inserted = r == _GAP
    if len(q) < len(r):  # letters that aren't there leave gaps in insertions, and nothing elsewhere
        q = np.concatenate([q, np.where(inserted[len(q) :], _GAP, _NONE).astype(np.uint32)])
    return inserted, np.cumsum(~inserted), q[: len(r)]


def _text(numbers: np.ndarray) -> str:
    return numbers[numbers != _NONE].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def longest_insertions(pairs: DataFrame) -> np.ndarray:
    """The longest insertion after each number of reference letters, over all reads; as many as the last one needs.

    A task keeps one number a reference place, whatever the number of its reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for r, q in zip(batch.column("ref_row").to_pylist(), batch.column("read_row").to_pylist()):
                inserted, at, _ = _laid(r, q)
                n = np.bincount(at[inserted])
                if len(n) > len(most):
                    most = np.concatenate([most, np.zeros(len(n) - len(most), dtype=np.int64)])
                np.maximum(most[: len(n)], n, out=most[: len(n)])
        own = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(most[own])], ["ref_pos", "longest"])

    each = pairs.select("ref_row", "read_row").mapInArrow(run, "ref_pos long, longest long")
    got = each.groupBy("ref_pos").agg(F.max("longest").alias("longest")).toArrow()  # no more than the reference's places
    at, n = got.column("ref_pos").to_numpy(), got.column("longest").to_numpy()
    out = np.zeros(int(at.max()) + 1 if len(at) else 1, dtype=np.int64)
    out[at] = n
    return out


def overlaps(pairs: DataFrame) -> DataFrame:
    """The same alignments (read_id, ref_row, read_row) between their first and last pair of letters: what a read has before or
    after the reference goes, the reference's own letters stay and meet gaps there."""

    def cut(ref_row: str | None, read_row: str | None) -> tuple[str | None, str | None]:
        if ref_row is None:
            return None, None
        inserted, _, q = _laid(ref_row, read_row)
        both = np.flatnonzero(~inserted & (q != _GAP) & (q != _NONE))
        inside = np.zeros(len(q), dtype=bool)
        if len(both):
            inside[both[0] : both[-1] + 1] = True
        stay = inside | ~inserted
        return _text(_numbers(ref_row)[stay]), _text(np.where(inside, q, _GAP)[stay])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                rows = [cut(r, q) for r, q in zip(some.column("ref_row").to_pylist(), some.column("read_row").to_pylist())]
                yield pa.RecordBatch.from_arrays([some.column("read_id"), *(pa.array([x[k] for x in rows], pa.string()) for k in (0, 1))], ["read_id", "ref_row", "read_row"])

    kind = pairs.schema["read_id"].dataType.simpleString()
    return pairs.select("read_id", "ref_row", "read_row").mapInArrow(run, f"read_id {kind}, ref_row string, read_row string")


def propagate_gaps(pairs: DataFrame, pad: bool = True, both: bool = False) -> DataFrame:
    """Multiple alignment (read_id, row) from pairwise ones (read_id, ref_row, read_row) on a common reference.

    With ``pad`` every insertion opens columns in all rows, filled from the left; without, insertions are dropped, and reads
    without a column have no row. With ``both`` the former is there as ``padded`` beside the latter. Rows are laid out one by
    one, so that no letter leaves its read; unless insertions are dropped the pairs are read twice."""
    longest = pairs.sparkSession.sparkContext.broadcast(longest_insertions(pairs)) if pad or both else None

    def padded(ref_row: str | None, read_row: str | None) -> str:
        inserted, at, q = _laid(ref_row, read_row)
        last = int(at[-1]) if len(at) else 0
        opened = np.zeros(last + 1, dtype=np.int64)
        known = longest.value[: last + 1]
        opened[: len(known)] = known
        begin = np.concatenate([[0], np.cumsum(opened[:-1]) + np.arange(last)])  # of each place's letter; place 0 has none
        out = np.full(int(begin[last] + opened[last] + (last > 0)), _GAP, dtype=np.uint32)
        column = np.arange(len(at))
        first = np.searchsorted(at, at, side="left")  # the place's letter, or the first insertion before all letters
        out[begin[at] + column - first] = q
        return _text(out)

    def merged(ref_row: str | None, read_row: str | None) -> str | None:
        inserted, at, q = _laid(ref_row, read_row)
        return _text(q[~inserted]) if len(at) else None

    lays = {"row": merged, "padded": padded} if both else {"row": padded if pad else merged}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                some = batch.slice(lo, 200)
                own = list(zip(some.column("ref_row").to_pylist(), some.column("read_row").to_pylist()))
                rows = [pa.array([lay(r, q) for r, q in own], pa.string()) for lay in lays.values()]
                yield pa.RecordBatch.from_arrays([some.column("read_id"), *rows], ["read_id", *lays])

    kind = pairs.schema["read_id"].dataType.simpleString()
    fields = "".join(f", {c} string" for c in lays)
    return pairs.select("read_id", "ref_row", "read_row").mapInArrow(run, f"read_id {kind}{fields}").where("row is not null")


def protein_layout(reads: DataFrame) -> DataFrame:
    """(read_id, row, place): proteins of the frame-trimmed reads, padded to common length and ordered by start."""
    cut = reads.select("read_id", F.floor((F.col("start") + 2) / 3).cast("int").alias("codon"), S.translate_codons(S.cut_frame(F.col("seq"), F.col("start"))).alias("protein"))
    width = cut.agg(F.max(F.col("codon") + F.length("protein")).alias("w")).scalar()
    row = F.concat(F.repeat(F.lit("-"), F.col("codon")), "protein", F.repeat(F.lit("-"), (width - F.col("codon") - F.length("protein")).cast("int")))
    return numbered(cut.select("read_id", row.alias("row"), "codon"), [F.col("codon"), F.col("read_id")]).drop("codon")
