"""Column functions over sequences: strings of letters, gaps and missing symbols."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the standard genetic code, codons in TCAG order; IUPAC codes
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def chars(s: Column) -> Column:
    """Letters of a string; none for the empty string."""
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def reverse_complement(s: Column) -> Column:
    return F.reverse(F.translate(s, "ACGT", "TGCA"))


def count_char(s: Column, c: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))


def codons(s: Column) -> Column:
    """Whole codons in order; an incomplete last one is left out. One pass over the string."""
    return F.regexp_extract_all(s, F.lit("..."), F.lit(0))


def amino(codon: Column) -> Column:
    """Letter of a codon over ACGT; X for any other."""
    a, b, c = (_instr4(F.substring(codon, i, 1)) for i in (1, 2, 3))
    return F.when((a >= 0) & (b >= 0) & (c >= 0), F.substring(F.lit(CODE), a * 16 + b * 4 + c + 1, F.lit(1))).otherwise(F.lit("X"))


def _instr4(c: Column) -> Column:
    return F.instr(F.lit("TCAG"), c) - 1


def translate_codons(s: Column) -> Column:
    """Protein of a sequence from its first letter; stop is *."""
    return F.array_join(F.transform(codons(s), amino), "")


def resolve(codon: Column) -> Column:
    """All codons over ACGT that an IUPAC codon stands for."""
    table = F.create_map(*[x for k, v in IUPAC.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    sets = [F.element_at(table, F.substring(codon, i, 1)) for i in (1, 2, 3)]
    two = F.flatten(F.transform(sets[0], lambda a: F.transform(sets[1], lambda b: F.concat(a, b))))
    return F.flatten(F.transform(two, lambda ab: F.transform(sets[2], lambda c: F.concat(ab, c))))


def amino_ambiguous(codon: Column) -> Column:
    """Letter of an IUPAC codon; several possible ones in sorted order between brackets."""
    every = F.array_sort(F.array_distinct(F.transform(resolve(codon), amino)))
    return let(every, lambda got: F.when(F.size(got) == 1, F.element_at(got, 1)).otherwise(F.concat(F.lit("["), F.array_join(got, ""), F.lit("]"))))


def iupac_of(letters: Column) -> Column:
    """Code of a set of bases, given as an array."""
    table = F.create_map(*[F.lit(x) for k, v in IUPAC.items() for x in (v, k)])
    return F.element_at(table, F.array_join(F.array_sort(F.array_distinct(letters)), ""))


def _count(a: Column, b: Column, test) -> Column:
    return F.size(F.filter(F.zip_with(chars(a), chars(b), test), lambda x: x)).cast("long")


def hamming(a: Column, b: Column) -> Column:
    """Differences up to the shorter length."""
    n = F.least(F.length(a), F.length(b))
    return _count(F.substring(a, F.lit(1), n), F.substring(b, F.lit(1), n), lambda x, y: x != y)


def hamming_missing(a: Column, b: Column, missing: str = "N") -> Column:
    """Struct (dist, match) over the places where neither is missing."""
    both = lambda x, y: (x != missing) & (y != missing)
    return F.struct(_count(a, b, lambda x, y: both(x, y) & (x != y)).alias("dist"), _count(a, b, lambda x, y: both(x, y) & (x == y)).alias("match"))


def normalised_distance(a: Column, b: Column, missing: str = "-") -> Column:
    """Differing share of the comparable places; 100 if there is none."""
    h = hamming_missing(a, b, missing)
    n = h["dist"] + h["match"]
    return F.when(n > 0, h["dist"] / n).otherwise(F.lit(100.0))


def inner(a: Column) -> tuple[Column, Column]:
    """First and last letter that is no gap, from 1; 0 and 0 if all are gaps."""
    n = F.length(a)
    first = n - F.length(F.ltrim(a, F.lit("-"))) + 1
    last = F.length(F.rtrim(a, F.lit("-")))
    return F.when(last > 0, first).otherwise(0), last


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _codes(a: Column, b: Column) -> Column:
    """A letter for each column: = equal, x different, i gap in a, d gap in b, - gap in both, n missing."""
    code = lambda x, y: (
        F.when((x == "-") & (y == "-"), "-").when(x == "-", "i").when(y == "-", "d").when(x == y, "=").when((x == "N") | (y == "N"), "n").otherwise("x")
    )
    return F.array_join(F.zip_with(chars(a), chars(b), code), "")


def summary(a: Column, b: Column) -> Column:
    """Of an alignment with reference a and read b: start and stop of the part gap-free at both ends, then ident,
    mismatches, insertions (gap in a) and deletions (gap in b) inside it."""

    def spans(c: Column) -> Column:
        n = F.length(c)
        first = lambda gap: F.when(F.length(F.trim(c, F.lit(gap))) > 0, n - F.length(F.ltrim(c, F.lit(gap))) + 1).otherwise(0)
        last = lambda gap: F.length(F.rtrim(c, F.lit(gap)))
        return F.struct(F.greatest(first("i-"), first("d-")).alias("start"), F.least(last("i-"), last("d-")).alias("stop"), c.alias("c"))

    def cut(s: Column) -> Column:
        mid = F.substring(s["c"], s["start"], F.greatest(s["stop"] - s["start"] + 1, F.lit(0)))
        return F.struct(s["start"].alias("start"), s["stop"].alias("stop"), mid.alias("mid"))

    def counts(s: Column) -> Column:
        n = lambda c: count_char(s["mid"], c).cast("long")
        return F.struct(
            s["start"].cast("long").alias("start"), s["stop"].cast("long").alias("stop"),
            n("=").alias("ident"), n("x").alias("mismatches"), n("i").alias("insertions"), n("d").alias("deletions"),
        )

    return let(let(let(_codes(a, b), spans), cut), counts)


def mutations(ref: Column, read: Column, offset: int = 0) -> Column:
    """Differences as A90I: letter of the reference, place from 1, letter of the read; gaps and N of the read are passed over."""
    zipped = F.zip_with(chars(ref), chars(read), lambda r, q: F.struct(r.alias("r"), q.alias("q")))
    named = F.transform(zipped, lambda x, i: F.when((x["r"] != x["q"]) & ~x["q"].isin("-", "N"), F.concat(x["r"], (i + 1 + offset).cast("string"), x["q"])))
    return F.array_join(F.filter(named, lambda m: m.isNotNull()), ",")


def backfill(ref: Column, read: Column) -> Column:
    """The read inside its span with deletions filled by the reference; insertions are dropped."""
    first, last = inner(read)

    def fill(bound: Column) -> Column:  # the span is computed once, not for every letter
        zipped = F.zip_with(chars(ref), chars(read), lambda r, q: F.struct(r.alias("r"), q.alias("q")))
        inside = lambda i: (i + 1 >= bound["first"]) & (i + 1 <= bound["last"])
        return F.transform(zipped, lambda x, i: F.when(inside(i) & (x["r"] != "-"), F.when(x["q"] == "-", x["r"]).otherwise(x["q"])))

    kept = let(F.struct(first.alias("first"), last.alias("last")), fill)
    return F.array_join(F.filter(kept, lambda m: m.isNotNull()), "")


def cut_frame(seq: Column, start: Column) -> Column:
    """The sequence from its first whole codon, given its 0-based start."""
    skip = F.when(start % 3 == 0, 0).when(start % 3 == 1, 2).otherwise(1)
    return F.substring(seq, skip + 1, F.greatest(F.length(seq) - skip, F.lit(0)))


def cigar(s: Column) -> Column:
    """Operations of a CIGAR string: array of (n, op)."""
    parts = F.regexp_extract_all(s, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "[0-9]+", 0).cast("int").alias("n"), F.substring(p, -1, 1).alias("op")))


def mask_quality(seq: Column, qual: Column, cutoff: int = 6) -> Column:
    """Letters of phred (ASCII less 33) under the cutoff become N; a quality of * keeps them."""
    masked = F.zip_with(chars(seq), chars(qual), lambda b, q: F.when(F.ascii(q) - 33 < cutoff, F.lit("N")).otherwise(b))
    return F.when(qual == "*", seq).otherwise(F.array_join(masked, ""))


def expand_cigar(seq: Column, ops: Column, gap: str = "-") -> Column:
    """Read on the reference's places: matches copied, deletions gaps, insertions and clips left out."""
    step = lambda acc, o: F.struct(
        F.when(o["op"].isin("M", "=", "X", "I", "S"), acc["at"] + o["n"]).otherwise(acc["at"]).alias("at"),
        F.concat(
            acc["out"],
            F.when(o["op"].isin("M", "=", "X"), F.substring(seq, acc["at"], o["n"])).when(o["op"].isin("D", "N"), F.repeat(F.lit(gap), o["n"])).otherwise(F.lit("")),
        ).alias("out"),
    )
    return F.aggregate(ops, F.struct(F.lit(1).alias("at"), F.lit("").alias("out")), step)["out"]


def to_window(aligned: Column, pos: Column, start: int, stop: int, pad: str = "n") -> Column:
    """An expanded read at reference place ``pos`` (from 0) cut to [start, stop] and padded."""
    width = stop - start + 1
    lead = F.greatest(pos - start, F.lit(0))
    cut = F.substring(aligned, F.greatest(F.lit(start) - pos, F.lit(0)) + 1, F.greatest(F.lit(width) - lead, F.lit(0)))
    return F.rpad(F.concat(F.repeat(F.lit(pad), F.least(lead, F.lit(width))), cut), width, pad)


def ambiguous_blocks(s: Column) -> Column:
    """Letters of a string like as[df]g: one array of letters for each place."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"\[[^\]]*\]|."), F.lit(0)), lambda p: chars(F.translate(p, "[]", "")))


PACK = 10  # symbols a number, of three bits each


def pack(s: Column) -> Column:
    """Symbols ACGT-N as an array of numbers, ten symbols a number; other symbols count as N, a short last number is filled with N."""
    digits = F.rpad(F.translate(F.regexp_replace(F.upper(s), "[^ACGTN-]", "N"), "ACGT-N", "012345"), (F.ceil(F.length(s) / PACK) * PACK).cast("int"), "5")
    parts = F.regexp_extract_all(digits, F.lit("." * PACK), F.lit(0))
    return F.transform(parts, lambda p: F.conv(p, 8, 10).cast("long"))


def packed_hamming(a: Column, b: Column) -> Column:
    """Places where two packed sequences differ and neither is missing."""
    ones = F.lit(int("1" * PACK, 8)).cast("long")
    some = lambda x: x.bitwiseOR(F.shiftright(x, 1)).bitwiseOR(F.shiftright(x, 2)).bitwiseAND(ones)  # noqa: E731  a bit for each symbol that is not 0
    missing = F.lit(int("5" * PACK, 8)).cast("long")
    differ = lambda x, y: F.bit_count(some(x.bitwiseXOR(y)).bitwiseAND(some(x.bitwiseXOR(missing))).bitwiseAND(some(y.bitwiseXOR(missing))))
    return F.aggregate(F.zip_with(a, b, differ), F.lit(0).cast("long"), lambda acc, n: acc + n)


def expand_on_reference(seq: Column, ops: Column, pos: Column, ref: Column) -> Column:
    """Read on the reference's places, from 0-based ``pos``: deletions of whole codons are gaps, others take the reference's
    letters; insertions are left out, all other letters are copied."""

    def step(acc: Column, o: Column) -> Column:
        copied = ~o["op"].isin("D", "I")
        gap = F.when(o["n"] % 3 == 0, F.repeat(F.lit("-"), o["n"])).otherwise(F.substring(ref, acc["ref"], o["n"]))
        return F.struct(
            F.when(o["op"] == "D", acc["at"]).otherwise(acc["at"] + o["n"]).alias("at"),
            F.when(o["op"] == "I", acc["ref"]).otherwise(acc["ref"] + o["n"]).alias("ref"),
            F.concat(acc["out"], F.when(o["op"] == "D", gap).when(copied, F.substring(seq, acc["at"], o["n"])).otherwise(F.lit(""))).alias("out"),
        )

    start = F.struct(F.lit(1).alias("at"), (pos + 1).cast("int").alias("ref"), F.lit("").alias("out"))
    return F.aggregate(ops, start, step)["out"]


def insertions(seq: Column, ops: Column, pos: Column, start: int, stop: int) -> Column:
    """Insertions of a read at 0-based ``pos`` as array of (at, text), ``at`` counted from ``start``; those that lie in [start, stop)."""

    def step(acc: Column, o: Column) -> Column:
        here = F.struct((acc["ref"] - start).alias("at"), F.substring(seq, acc["at"], o["n"]).alias("text"))
        inside = (o["op"] == "I") & (acc["ref"] >= start) & (acc["ref"] + o["n"] < stop)
        return F.struct(
            F.when(o["op"].isin("M", "=", "X", "I", "S"), acc["at"] + o["n"]).otherwise(acc["at"]).alias("at"),
            F.when(o["op"].isin("M", "=", "X", "D", "N"), acc["ref"] + o["n"]).otherwise(acc["ref"]).alias("ref"),
            F.when(inside, F.concat(acc["out"], F.array(here))).otherwise(acc["out"]).alias("out"),
        )

    none = F.array().cast("array<struct<at:int,text:string>>")
    return F.aggregate(ops, F.struct(F.lit(1).alias("at"), pos.cast("int").alias("ref"), none.alias("out")), step)["out"]
