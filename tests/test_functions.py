"""Scalar functions and filters on small cases."""

import itertools
import random

from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import filters as P


def one(spark, *cols, **lits):
    df = spark.range(1)
    for k, v in lits.items():
        df = df.withColumn(k, F.lit(v))
    return tuple(df.select(*cols).first())


def test_strings(spark):
    got = one(
        spark,
        S.reverse_complement(F.col("s")),
        S.count_char(F.col("s"), "A"),
        S.codons(F.col("s")),
        S.translate_codons(F.lit("ATGTAAGCNGG")),
        S.iupac_of(F.array(F.lit("G"), F.lit("A"), F.lit("G"))),
        S.ambiguous_blocks(F.lit("a[bc]d")),
        s="ACGTNA",
    )
    assert got == ("TNACGT", 2, ["ACG", "TNA"], "M*X", "R", [["a"], ["b", "c"], ["d"]])


def test_genetic_code_and_ambiguity(spark):
    assert len(S.CODE) == 64 and S.CODE.count("*") == 3
    assert one(spark, S.amino(F.lit("TGG")), S.amino(F.lit("AAA")), S.amino_ambiguous(F.lit("GCN")), S.amino_ambiguous(F.lit("AAN")), F.size(S.resolve(F.lit("NNN")))) == ("W", "K", "A", "[KN]", 64)


def test_hamming(spark):
    a, b = F.lit("ACGTN-A"), F.lit("ACCTNGN")
    got = one(spark, S.hamming(a, b), S.hamming_missing(a, b), S.normalised_distance(F.lit("--"), F.lit("AC")), S.hamming(F.lit(""), F.lit("A")))
    assert got[0] == 3 and tuple(got[1]) == (2, 3) and got[2] == 100.0 and got[3] == 0


def test_summary_against_loop(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ACGT-N") for _ in range(12)), "".join(rng.choice("ACGT-N") for _ in range(12))) for _ in range(60)] + [("-" * 12, "ACGT" * 3)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    for r in df.select("i", "a", "b", S.summary(F.col("a"), F.col("b")).alias("s"), S.mutations(F.col("a"), F.col("b")).alias("m"), S.backfill(F.col("a"), F.col("b")).alias("f")).collect():
        a, b = r["a"], r["b"]
        span = lambda s: (next((k for k, c in enumerate(s, 1) if c != "-"), 0), max((k for k, c in enumerate(s, 1) if c != "-"), default=0))
        lo, hi = max(span(a)[0], span(b)[0]), min(span(a)[1], span(b)[1])
        cols = [(a[k - 1], b[k - 1]) for k in range(max(lo, 1), hi + 1)] if hi >= lo and lo > 0 else []
        want = (lo, hi, sum(x == y != "-" for x, y in cols), sum(x != y and not {x, y} & {"-", "N"} for x, y in cols), sum(x == "-" != y for x, y in cols), sum(x != "-" == y for x, y in cols))
        assert (r["s"]["start"], r["s"]["stop"]) == want[:2]
        if lo > 0:
            assert tuple(r["s"])[2:] == want[2:], (a, b)
        assert r["m"] == ",".join(f"{x}{k}{y}" for k, (x, y) in enumerate(zip(a, b), 1) if x != y and y not in "-N")
        s0, s1 = span(b)
        assert r["f"] == "".join((x if y == "-" else y) for k, (x, y) in enumerate(zip(a, b), 1) if s0 <= k <= s1 and x != "-")


def test_cigar_and_window(spark):
    seq, ops = F.lit("AACCGGTT"), S.cigar(F.lit("2S2M1I1D3M"))
    assert [tuple(x) for x in one(spark, ops)[0]] == [(2, "S"), (2, "M"), (1, "I"), (1, "D"), (3, "M")]
    full = S.expand_cigar(seq, ops)
    assert one(spark, full, S.to_window(full, F.lit(5), 4, 12), S.to_window(full, F.lit(5), 7, 9), S.to_window(full, F.lit(50), 7, 9)) == ("CC-GTT", "nCC-GTTnn", "-GT", "nnn")
    assert one(spark, S.mask_quality(F.lit("ACGT"), F.lit("!'IJ")), S.mask_quality(F.lit("ACGT"), F.lit("*"))) == ("NCGT", "ACGT")


def test_filters(spark):
    df = spark.createDataFrame([(1, "ACGTACGTAC" + "TT"), (2, "ACGTACGTAA" + "GG"), (3, "TTGATATACA" + "CC"), (4, "AC")], "read_id int, seq string")
    got = {r["read_id"]: (r["sample"], r["strand"], r["trimmed"]) for r in P.demultiplex(df, {"x": "ACGTACGTAC"}, {"y": "TTGATATACA"}).collect()}
    assert got == {1: ("x", "+", "TT"), 2: ("x", "+", "GG"), 3: ("y", "-", None), 4: (None, None, None)}
    assert {r["part_id"]: r["seq"] for r in P.halves(df.where("read_id = 4")).collect()} == {"4-a": "A", "4-b": "C"}
    rows = spark.createDataFrame([("XXACXGTXX",), ("X" * 5,), ("AXXXXXXXXXXXA",)], "seq string")
    assert [r["seq"] for r in P.interior_uncovered(rows).collect()] == ["XXACXGTXX"]
    assert P.gap_share(spark.createDataFrame([("--A-CGTACGTAC",)], "seq string"), 0.1, interior=True).count() == 1
    assert spark.createDataFrame([("1",), ("-2.5e3",), ("x1",), (".",)], "v string").where(P.is_numeric(F.col("v"))).count() == 2
    assert P.signed(spark.createDataFrame([(1.0, 2.0)], "a double, b double"), [2, -1]).first() == (2.0, -1.0)


def test_frame_cut(spark):
    df = spark.createDataFrame([(k, "ABCDEF") for k in range(6)], "start int, seq string")
    got = {r["start"]: r["c"] for r in df.select("start", S.cut_frame(F.col("seq"), F.col("start")).alias("c")).collect()}
    assert all(got[k] == "ABCDEF"[(-k) % 3 :] for k in got)
    assert len(list(itertools.islice(S.IUPAC, 20))) == 15
