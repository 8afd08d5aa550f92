"""Counts per position, consensus, diversity and other aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators.state import durable


def distinct_reads(reads: DataFrame, keys: list[str], limit: int | None = None, ident: str = "read_id") -> DataFrame:
    """Equal reads as one object with its weight; with a limit, overflow opens further objects (column part)."""
    if limit is None:
        return reads.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(ident))
    return reads.withColumn("part", F.floor((rank - 1) / limit)).groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("weight"))


def base_counts(bases: DataFrame, *keys: str) -> DataFrame:
    return bases.groupBy(*keys, "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def plurality(counts: DataFrame, keys: list[str], skip: tuple[str, ...] = ()) -> DataFrame:
    """Most frequent base per key; the smallest letter on ties."""
    return counts.where(~F.col("base").isin(*skip)).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), "base")).alias("x")).select(*keys, F.col("x.base").alias("base"), (-F.col("x.m")).alias("n"))


def majority_vote(votes: DataFrame, missing: str = "N", none: str = "X") -> DataFrame:
    """(read_id, pos, base) from (read_id, pos, base) votes: the most frequent, smallest on ties, none if all are missing."""
    counted = votes.groupBy("read_id", "pos", "base").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("read_id", "pos").agg(F.min(F.when(F.col("base") != missing, F.struct((-F.col("n")).alias("m"), "base"))).alias("x"))
    return best.select("read_id", "pos", F.coalesce("x.base", F.lit(none)).alias("base"))


def consensus(bases: DataFrame, most_gaps: float = 0.8) -> DataFrame:
    """(pos, base): plurality of the letters; columns with a share of gaps of at least ``most_gaps`` are left out."""
    c = base_counts(bases)
    share = c.groupBy("pos").agg((F.sum(F.when(F.col("base") == "-", F.col("n")).otherwise(0)) / F.sum("n")).alias("gaps"))
    kept = c.join(share.where(F.col("gaps") < most_gaps), "pos")
    return plurality(kept, ["pos"], ("-", "N")).select("pos", "base")


def consensus_by_plurality(bases: DataFrame, letters: str = "ACGT-") -> DataFrame:
    """(pos, base): the most frequent of the letters where it is more frequent than one of all but one would be by chance."""
    c = base_counts(bases.where(F.col("base").isin(*letters)))
    total = c.groupBy("pos").agg(F.sum("n").alias("all"))
    return plurality(c, ["pos"]).join(total, "pos").where(F.col("n") > F.col("all") / (len(letters) - 1)).select("pos", "base")


def fill_uncovered(haps: DataFrame, symbol: str = ".") -> DataFrame:
    """(seq): different haplotypes (seq, of one length) after uncovered places take the consensus letter, the most frequent
    one and the smallest of equally frequent ones; a place that none covers keeps its mark."""
    own = haps.select("seq")
    columns = own.select(F.posexplode(F.split("seq", "")).alias("pos", "base")).groupBy("pos", "base").agg(F.count(F.lit(1)).alias("n"))
    best = plurality(columns, ["pos"], (symbol,)).select("pos", "base")
    # as long as one haplotype
    line = best.agg(F.map_from_entries(F.collect_list(F.struct("pos", "base"))).alias("m")).scalar()
    filled = F.transform(F.split("seq", ""), lambda c, i: F.when(c == symbol, F.coalesce(F.try_element_at("_line", i), c)).otherwise(c))
    return own.withColumn("_line", line).select(F.array_join(filled, "").alias("seq")).distinct()


def pileup(reads: DataFrame, *keys: str) -> DataFrame:
    """Per key: covered places, their depths added up, and the largest depth. Depth is a running sum over interval ends."""
    ends = F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).cast("long").alias("pos"), F.lit(-1).alias("d"))))
    events = reads.select(*keys, ends.alias("e")).groupBy(*keys, F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy(*keys).orderBy("pos")
    steps = events.select(*keys, F.sum("d").over(w).alias("depth"), (F.lead("pos").over(w) - F.col("pos")).alias("n")).where("depth > 0")
    return steps.groupBy(*keys).agg(F.sum("n").alias("covered"), F.sum(F.col("depth") * F.col("n")).alias("depth"), F.max("depth").alias("deepest"))


def coverage(reads: DataFrame) -> DataFrame:
    """(pos, cov): reads over each position, by +1/-1 events and a running sum over positions with an event.

    Intervals between events have constant depth and are expanded afterwards, so that work does not grow with read length."""
    events = reads.select(F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("stop") + 1).cast("long").alias("pos"), F.lit(-1).alias("d")))).alias("e")).groupBy(F.col("e.pos").alias("pos")).agg(F.sum("e.d").alias("d"))
    steps = running_totals(events, "pos", ["d"], "next").select("pos", F.col("d_until").alias("cov"), "next").where("cov > 0")
    return steps.select(F.explode(F.sequence("pos", F.col("next") - 1)).alias("pos"), "cov")


def histogram(df: DataFrame, column: str, start: float, stop: float, bins: int) -> DataFrame:
    """(bin, n): counts in (lo, hi] intervals, zeros included; a value equal to the start is in none."""
    step = (stop - start) / bins
    counted = df.where((F.col(column) > start) & (F.col(column) <= stop)).groupBy((F.ceil((F.col(column) - start) / step) - 1).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return df.sparkSession.range(bins).select(F.col("id").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def shares(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """``share`` of each row in the sum of its key; 0 where the sum is 0."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col(value) / total))


def box_data(history: DataFrame, support: float = 0.0) -> DataFrame:
    """Quartiles of haplotypes' shares over the iterations (hap, iter, reads), of those seen in more than ``support`` of them.

    Every iteration must hold the same reads; if their sums differ the table is refused, as a null ``constant`` row would hide it."""
    sums = history.groupBy("iter").agg(F.sum("reads").alias("all"))
    constant = sums.agg((F.min("all") == F.max("all")).alias("c"), F.count(F.lit(1)).alias("n")).first()
    if constant["c"] is False:
        raise ValueError("some reads are missing in an iteration")
    own = shares(history, "reads", "iter").groupBy("hap")
    quarters = F.percentile("share", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    box = own.agg(F.countDistinct("iter").alias("support"), quarters.alias("q")).where(F.col("support") > support * constant["n"])
    return box.select("hap", "support", *[F.col("q")[i].alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def roc_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, fpr, tpr): rates of negatives and positives with at least each score that occurs. Counts are summed within
    ranges of scores, and the ranges' totals put before them, so that no task holds all scores."""
    c = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("q"))
    run = running_totals(c.withColumn("order", -F.col("score")), "order", ["p", "q"])
    total = c.agg(F.struct(F.sum("p").alias("p"), F.sum("q").alias("q")).alias("t")).scalar()
    return run.select("score", (F.col("q_until") / total["q"]).alias("fpr"), (F.col("p_until") / total["p"]).alias("tpr"))


def running_totals(df: DataFrame, order: str, values: list[str], following: str | None = None) -> DataFrame:
    """Each row with the sums of the values over all rows up to it (value_until), in the order of a column without ties;
    with a name for it, also the order's value in the row that follows.

    Rows are dealt by ranges of the order; a range sums its own rows and adds the totals of the ranges before it."""
    dealt = durable(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.min(order).alias("_first"), *[F.sum(v).alias(f"_{v}") for v in values])
    ranges = Window.orderBy("_part")  # a row for each range
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("_part", F.lead("_first").over(ranges).alias("_then"), *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_{v}") for v in values])
    own = Window.partitionBy("_part").orderBy(order)
    out = [(F.col(f"_{v}") + F.sum(v).over(own.rowsBetween(Window.unboundedPreceding, 0))).alias(f"{v}_until") for v in values]
    if following:
        out.append(F.coalesce(F.lead(order).over(own), F.col("_then")).alias(following))
    return dealt.join(F.broadcast(base), "_part").select(*df.columns, *out)


def numbered(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 1, in the order of columns that leave no ties; ranges are numbered apart
    and follow each other."""
    dealt = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    base = parts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(base), "_part").withColumn(name, (F.col("_before") + rank).cast("long")).select(*df.columns, name)


def entropy(counts: DataFrame, *keys: str) -> DataFrame:
    """Shannon entropy in bits of the counts n of each key."""
    total = counts.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return total.select(*keys, (F.log2("all") - F.col("s") / F.col("all")).alias("entropy"))


def divergence(a: DataFrame, b: DataFrame, letters: list[str], pseudo: float = 1.0) -> DataFrame:
    """(pos, kl): symmetrised Kullback-Leibler divergence in bits per position of two (pos, base, n), with pseudo-counts."""
    wide = lambda df, name: df.groupBy("pos").agg(*[(F.sum(F.when(F.col("base") == x, F.col("n")).otherwise(0)) + pseudo).alias(f"{name}{i}") for i, x in enumerate(letters)])
    both = wide(a, "p").join(wide(b, "q"), "pos")
    k = range(len(letters))
    sp, sq = sum((F.col(f"p{i}") for i in k), F.lit(0.0)), sum((F.col(f"q{i}") for i in k), F.lit(0.0))
    terms = [((F.col(f"p{i}") / sp) - (F.col(f"q{i}") / sq)) * F.log2((F.col(f"p{i}") / sp) / (F.col(f"q{i}") / sq)) for i in k]
    return both.select("pos", sum(terms, F.lit(0.0)).alias("kl"))


def simpson(df: DataFrame, value: str) -> DataFrame:
    """Simpson index and its standard error from abundances."""
    t = df.agg(F.sum(value).cast("double").alias("n"), F.sum(F.pow(value, 2)).alias("s2"), F.sum(F.pow(value, 3)).alias("s3"))
    d = F.col("s2") / F.pow("n", 2)
    var = 4 * (F.col("s3") / F.pow("n", 3) - d * d) / F.col("n")
    return t.select(d.alias("simpson"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("se"))


def codon_usage(reads: DataFrame) -> DataFrame:
    return reads.select(F.explode(S.codons(F.col("seq"))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


# fixed values: codons that one substitution turns into a stop codon, each with the weight of such a change
STOP_WEIGHTS = {
    "AAA": 3, "AAG": 3, "AGA": 3, "CAA": 3, "CAG": 3, "CGA": 3, "GAA": 3, "GAG": 3, "GGA": 3,
    "TAC": 1.5, "TAT": 1.5, "TCA": 1.5, "TCG": 3, "TGC": 3, "TGG": 3, "TGT": 3, "TTA": 1.5, "TTG": 3,
}
STOPS = ("TAG", "TGA", "TAA")


def stop_codon_rate(reads: DataFrame, parents: DataFrame, excluded: list[int] = ()) -> DataFrame:
    """(stops, weighted, sensitive, rate): stop codons in the frame of reads (start, seq) outside the excluded sites; each
    weighs as the parent codon of its site (site from 0, parent) does; divided by the number of codons that one change
    turns into a stop."""
    codons = reads.select(F.floor((F.col("start") + 2) / 3).alias("first"), F.posexplode(S.codons(S.cut_frame(F.col("seq"), F.col("start")))).alias("i", "codon"))
    counted = codons.groupBy((F.col("first") + F.col("i")).cast("long").alias("site"), "codon").agg(F.count(F.lit(1)).alias("n"))
    weight = F.create_map(*[F.lit(x) for k, v in STOP_WEIGHTS.items() for x in (k, float(v))])
    own = counted.join(parents.select("site", "parent"), "site", "left").withColumn("stop", F.col("codon").isin(*STOPS) & ~F.col("site").isin(*excluded))
    total = own.agg(
        F.coalesce(F.sum(F.when(F.col("stop"), F.col("n"))), F.lit(0)).alias("stops"),
        F.coalesce(F.sum(F.when(F.col("stop"), F.col("n") * F.coalesce(F.try_element_at(weight, F.col("parent")), F.lit(0.0)))), F.lit(0.0)).alias("weighted"),
        F.coalesce(F.sum(F.when(F.col("codon").isin(*STOP_WEIGHTS), F.col("n"))), F.lit(0)).alias("sensitive"),
    )
    return total.withColumn("rate", F.try_divide("weighted", "sensitive"))


def top_haplotypes(reads: DataFrame, n: int = 10, least: float = 0.0) -> DataFrame:
    """(seq, n, share) of the most frequent sequences."""
    c = reads.groupBy("seq").agg(F.count(F.lit(1)).alias("n"))
    total = reads.agg(F.count(F.lit(1)).alias("t")).scalar()
    return c.withColumn("share", F.col("n") / total).where(F.col("share") >= least).orderBy(F.desc("n"), "seq").limit(n)


def cooccurrence(words: DataFrame, sites: list[str]) -> DataFrame:
    """Observed joint frequency over the product of the marginals, for each combination of the site columns."""
    total = words.agg(F.count(F.lit(1)).alias("t")).scalar()
    joint = words.groupBy(*sites).agg(F.count(F.lit(1)).alias("n")).withColumn("all", total)
    product = F.lit(1.0)
    for s in sites:
        m = words.groupBy(s).agg(F.count(F.lit(1)).alias(f"m_{s}"))
        joint = joint.join(m, s)
        product = product * F.col(f"m_{s}") / F.col("all")
    return joint.select(*sites, "n", ((F.col("n") / F.col("all")) / product).alias("odds"))


def gap_runs(rows: DataFrame, low: int = 2, high: int = 30) -> DataFrame:
    """(run, n): non-overlapping gap runs of each length inside the flanks."""
    inside = rows.select(F.trim("seq", F.lit("-")).alias("s"))
    runs = inside.select(F.explode(F.regexp_extract_all("s", F.lit("-+"), F.lit(0))).alias("r")).groupBy(F.length("r").alias("k")).agg(F.count(F.lit(1)).alias("c"))
    each = runs.select(F.explode(F.sequence(F.lit(low), F.lit(high))).alias("run"), "k", "c")
    return each.groupBy("run").agg(F.sum(F.floor(F.col("k") / F.col("run")) * F.col("c")).cast("long").alias("n"))


def correct_gaps(bases: DataFrame) -> DataFrame:
    """Bases with the gaps filled in columns that hold one letter and gaps only; missing counts as a gap."""
    own = bases.withColumn("base", F.when(F.col("base") == "N", "-").otherwise(F.col("base")))
    letters = own.groupBy("pos").agg(F.min(F.when(F.col("base") != "-", F.col("base"))).alias("lo"), F.max(F.when(F.col("base") != "-", F.col("base"))).alias("hi"))
    only = letters.where("lo = hi").select("pos", F.col("lo").alias("fill"))
    return own.join(only, "pos", "left").withColumn("fixed", F.coalesce((F.col("base") == "-") & F.col("fill").isNotNull(), F.lit(False))).withColumn("base", F.when(F.col("fixed"), F.col("fill")).otherwise(F.col("base"))).drop("fill")


def most_common(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """Mode of a column per key, smallest on ties."""
    c = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), column)).alias("x")).select(*keys, F.col(f"x.{column}").alias("mode"), (-F.col("x.m")).alias("n"))


def rank_sum_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve from average ranks; scores are counted before they are ranked."""
    c = df.groupBy(score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("p"), F.count(F.lit(1)).alias("n"))
    r = running_totals(c, score, ["n"]).withColumn("rank", F.col("n_until") - F.col("n") + (F.col("n") + 1) / 2)
    t = r.agg(F.sum(F.col("p") * F.col("rank")).alias("s"), F.sum("p").alias("np"), F.sum(F.col("n") - F.col("p")).alias("nn"))
    return t.select(((F.col("s") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * F.col("nn"))).alias("auc"))


def kolmogorov_smirnov(df: DataFrame, value: str, group: str) -> DataFrame:
    """Largest distance of the two groups' empirical distributions (group 0 and 1)."""
    c = df.groupBy(value).agg(F.sum(F.when(F.col(group) == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col(group) == 1, 1).otherwise(0)).alias("b"))
    total = c.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b")).alias("t")).scalar()
    run = running_totals(c, value, ["a", "b"])
    return run.agg(F.max(F.abs(F.col("a_until") / total["a"] - F.col("b_until") / total["b"])).alias("ks"))


def gap_free_share(c: Column) -> Column:
    return 1 - S.count_char(c, "-") / F.nullif(F.length(c), F.lit(0))
