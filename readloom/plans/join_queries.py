"""Queries of joins, graphs and frequency estimation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import align, em, graph, joins
from readloom.operators.aggregates import numbered
from readloom.operators.state import durable
from readloom.plans import adapters as A
from readloom.plans.adapters import with_
from readloom.plans.registry import query

LEAST = 30
LINES = 10_000_000  # of a text; more would give two lines one id


def _few(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """Batches cut into a few rows each: Python holds the texts of no more at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        pa.default_memory_pool().release_unused()


def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two successive lines of a text as one read, at the place of the first one among the text's letters.

    A text makes its reads by itself, so that they can be made again wherever they are looked at."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            ids, starts, seqs = zip(*rows)
            sizes = [len(s) for s in seqs]
            stops = [a + n - 1 for a, n in zip(starts, sizes)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(seqs, pa.binary()).cast(pa.string()), pa.array(sizes, pa.int32()), pa.array(stops, pa.int32())], ["read_id", "start", "seq", "len", "stop"])

        for batch in _few(batches):
            rows, size = [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                lines = [x.translate(A.TABLE, A.OTHERS) for x in text.encode().split(b"\n")]
                if len(lines) > LINES:
                    raise ValueError("a text has too many lines")
                at = 0
                for i, x in enumerate(lines):
                    both = x + lines[i + 1] if i + 1 < len(lines) else x
                    if both:
                        rows.append((doc * LINES + i, at, both))
                        size += len(both)
                    at += len(x)
                if size > 1 << 20:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    docs = A.spread(A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")).where("text is not null and doc_id is not null")
    return docs.mapInArrow(run, "read_id long, start int, seq string, len int, stop int")


FRAGMENTS = f"""ln AS (SELECT doc_id, i - 1 AS i, translate(upper(regexp_replace(ls[i], '[^A-Za-z]', '', 'g')), '{A.LETTERS}', '{A.FOUR}') AS s FROM
 (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
 fr AS (SELECT read_id, CAST(start AS INTEGER) AS start, seq, CAST(length(seq) AS INTEGER) AS len, CAST(start + length(seq) - 1 AS INTEGER) AS stop FROM
 (SELECT doc_id * {LINES} + i AS read_id, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
 s || coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY i), '') AS seq FROM ln) WHERE length(seq) > 0)"""


@query(
    "j01_p04_windowed_reads",
    with_("reads")
    + """, w AS (SELECT 1 + m * 50 AS wstart FROM range(0, (SELECT CAST(4 * (max(stop + 1) // 200 + 1) AS BIGINT) FROM reads)) r(m)),
 j AS (SELECT wstart, read_id, start, stop, seq, least(stop + 1, wstart + 199) - greatest(start + 1, wstart) + 1 AS ov FROM reads JOIN w ON start + 1 <= wstart + 199 AND stop + 1 >= wstart)
 SELECT CAST(wstart AS BIGINT) AS wstart, read_id, md5(rpad(repeat('N', greatest(start + 1 - wstart, 0)) || substr(seq, greatest(wstart - start, 1), ov), 200, 'N')) AS wseq FROM j WHERE ov > 170""",
)
def j01(spark, sf):
    return joins.windowed_reads(A.reads(spark, sf), 200, 4).select("wstart", "read_id", F.md5("wseq").alias("wseq"))


@query(
    "j02_containment",
    "WITH "
    + FRAGMENTS
    + """, u AS (SELECT start, seq, len, stop, min(read_id) AS read_id FROM fr GROUP BY ALL),
 k AS (SELECT r.read_id FROM u r WHERE NOT EXISTS (SELECT 1 FROM u s WHERE s.start <= r.start AND s.stop >= r.stop AND s.read_id <> r.read_id AND substr(s.seq, r.start - s.start + 1, r.len) = r.seq))
 SELECT read_id FROM k""",
)
def j02(spark, sf):
    return joins.remove_contained(fragments(spark, sf)).select("read_id")


@query(
    "j03_overlap_edges",
    "WITH "
    + FRAGMENTS
    + f""" SELECT r.read_id AS src, s.read_id AS dst FROM fr r JOIN fr s ON r.start < s.start AND r.stop < s.stop AND r.stop - s.start + 1 >= {LEAST} AND s.len >= {LEAST}
 WHERE substr(r.seq, s.start - r.start + 1, 16) = substr(s.seq, 1, 16) AND substr(r.seq, s.start - r.start + 1) = substr(s.seq, 1, r.stop - s.start + 1)""",
)
def j03(spark, sf):
    return joins.overlaps(durable(fragments(spark, sf)), LEAST)


WHOLE = f"hp AS (SELECT read_id AS hap_id, seq FROM (SELECT doc_id AS read_id, {A._MAP % ('', A.FOUR)} AS seq FROM documents) WHERE length(seq) > 0)"


def _whole(spark, sf):
    """All letters of each text, as haplotypes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            seqs = [t.encode().translate(A.TABLE, A.OTHERS) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("hap_id"), pa.array(seqs, pa.binary()).cast(pa.string())], ["hap_id", "seq"])

    docs = A.spread(A.table(spark, sf, "documents").select(F.col("doc_id").cast("long").alias("hap_id"), "text"))
    return docs.where("text is not null").mapInArrow(run, "hap_id long, seq string").where("length(seq) > 0")


@query("j04_compatibility", "WITH " + FRAGMENTS + ", " + WHOLE + " SELECT read_id, hap_id FROM fr JOIN hp ON substr(hp.seq, fr.start + 1, least(16, fr.len)) = substr(fr.seq, 1, 16) AND length(hp.seq) > fr.stop WHERE substr(hp.seq, fr.start + 1, fr.len) = fr.seq")
def j04(spark, sf):
    return joins.compatible(fragments(spark, sf), _whole(spark, sf))


@query("j05_lock_step", "SELECT a.doc_id AS read_id, length(b.text) AS forward, length(a.text) - length(replace(a.text, 'a', '')) AS backward FROM documents a JOIN documents b USING (doc_id)")
def j05(spark, sf):
    d = A.table(spark, sf, "documents")
    one, two = d.select(F.col("doc_id").alias("read_id"), F.length("text").cast("long").alias("forward")), d.select(F.col("doc_id").alias("read_id"), S.count_char(F.col("text"), "a").cast("long").alias("backward"))
    return joins.lock_step(one, two)


@query("j07_unexplained", "WITH " + FRAGMENTS + ", " + WHOLE + ", ok AS (SELECT DISTINCT read_id FROM fr JOIN hp ON hap_id % 2 = 0 AND substr(hp.seq, fr.start + 1, least(16, fr.len)) = substr(fr.seq, 1, 16) AND substr(hp.seq, fr.start + 1, fr.len) = fr.seq) SELECT count(*) AS lost FROM fr WHERE read_id NOT IN (SELECT read_id FROM ok)")
def j07(spark, sf):
    f = fragments(spark, sf)
    members, held = joins.compatible_classes(f, _whole(spark, sf).where("hap_id % 2 = 0"))  # some haplotypes only, so that reads are lost
    return em.explained(f.select("read_id"), members.join(held.select("first").distinct(), "first", "left_semi"))[1]


@query("j10_paired_ends", with_("reads") + "SELECT CAST(read_id AS VARCHAR) AS read_id, md5(substr(seq, 1, len // 2)) AS first, md5(substr(seq, len // 2 + 1)) AS second FROM reads")
def j10(spark, sf):
    from readloom.operators.filters import halves

    return joins.paired_ends(halves(A.reads(spark, sf))).select("read_id", F.md5("first").alias("first"), F.md5("second").alias("second"))


WINDOWED = """w AS (SELECT 1 + m * 67 AS wstart FROM range(0, (SELECT CAST(max(stop + 1) // 67 + 1 AS BIGINT) FROM reads)) r(m)),
 j AS (SELECT wstart, read_id, start, seq, least(stop + 1, wstart + 200) - greatest(start + 1, wstart) + 1 AS ov FROM reads JOIN w ON start + 1 <= wstart + 200 AND stop + 1 >= wstart),
 ws AS (SELECT wstart, read_id, rpad(repeat('N', greatest(start + 1 - wstart, 0)) || substr(seq, greatest(wstart - start, 1), ov), 201, 'N') AS s FROM j WHERE ov > 171)"""


@query(
    "j11_haplotype_support",
    with_("reads", then=WINDOWED)
    + """, x AS (SELECT wstart, read_id, s, length(s) - length(ltrim(s, 'N')) AS a, length(rtrim(s, 'N')) AS b FROM ws), h AS (SELECT wstart, min(read_id) AS hap_id, s, any_value(a) AS a, any_value(b) AS b FROM x GROUP BY wstart, s)
 SELECT CAST(h.wstart AS BIGINT) AS wstart, hap_id, count(*) AS support FROM h JOIN x ON h.wstart = x.wstart AND substr(h.s, 61, 30) = substr(x.s, 61, 30)
 WHERE substr(h.s, CAST(greatest(h.a, x.a) + 1 AS BIGINT), CAST(least(h.b, x.b) - greatest(h.a, x.a) AS BIGINT)) = substr(x.s, CAST(greatest(h.a, x.a) + 1 AS BIGINT), CAST(least(h.b, x.b) - greatest(h.a, x.a) AS BIGINT)) GROUP BY ALL""",
)
def j11(spark, sf):
    return joins.haplotype_support(joins.windowed_reads(A.reads(spark, sf), 201, 3))


@query(
    "j13_alignment_map",
    with_("pairs")
    + """, lp AS (SELECT read_id, unnest(range(1, length(a) + 1)) AS pos, unnest(string_split(a, '')) AS x, unnest(string_split(b, '')) AS y FROM prs)
 SELECT CASE WHEN x = '-' AND y = '-' THEN 3 WHEN x = '-' THEN 1 WHEN y = '-' THEN 2 ELSE 0 END::BIGINT AS kind, count(*) AS n, CAST(sum(j1) AS BIGINT) AS s1, CAST(sum(j2) AS BIGINT) AS s2 FROM
 (SELECT x, y, sum(CASE WHEN x <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos) AS j1, sum(CASE WHEN y <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos) AS j2 FROM lp) GROUP BY 1""",
)
def j13(spark, sf):
    from readloom.plans.aggregate_queries import long_pairs

    w = Window.partitionBy("read_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    run = lambda c: F.sum((F.col(c) != "-").cast("long")).over(w)
    kind = F.when((F.col("x") == "-") & (F.col("y") == "-"), 3).when(F.col("x") == "-", 1).when(F.col("y") == "-", 2).otherwise(0).cast("long")
    m = long_pairs(spark, sf).select(kind.alias("kind"), run("x").alias("j1"), run("y").alias("j2"))
    return m.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("j1").alias("s1"), F.sum("j2").alias("s2"))


@query("j15_label_lookup", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)")
def j15(spark, sf):
    return A.table(spark, sf, "documents").select("doc_id", "lang").join(A.table(spark, sf, "labels").select("doc_id", F.col("quality")), "doc_id")


@query(
    "j16_nearest_graph",
    """WITH s AS (SELECT p_partkey AS i, [p_brand, CAST(p_size AS VARCHAR), CAST(floor(p_retailprice / 50) AS VARCHAR), p_type] AS obs FROM part),
 d AS (SELECT a.i, b.i AS j, CAST(a.obs[1] <> b.obs[1] AS INT) + CAST(a.obs[2] <> b.obs[2] AS INT) + CAST(a.obs[3] <> b.obs[3] AS INT) + CAST(a.obs[4] <> b.obs[4] AS INT) AS d FROM s a JOIN s b ON a.i <> b.i),
 n AS (SELECT i, j FROM (SELECT *, min(d) OVER (PARTITION BY i) AS m FROM d) WHERE d = m) SELECT i, j FROM n UNION SELECT j, i FROM n""",
)
def j16(spark, sf):
    p = A.table(spark, sf, "part")
    return joins.nearest_graph(p.select(F.col("p_partkey").alias("i"), F.array("p_brand", F.col("p_size").cast("string"), F.floor(F.col("p_retailprice") / 50).cast("string"), "p_type").alias("obs")), 4)


@query("f24_distance_matrix", with_("haps") + "SELECT a.hap_id AS i, b.hap_id AS j, CAST(hamming(substr(a.seq, 1, least(length(a.seq), length(b.seq))), substr(b.seq, 1, least(length(a.seq), length(b.seq)))) AS BIGINT) AS d FROM haps a, haps b WHERE length(a.seq) > 0 AND length(b.seq) > 0")
def f24(spark, sf):
    return joins.distance_matrix(A.haps(spark, sf).where("length(seq) > 0").select(F.col("hap_id").alias("i"), "seq"), S.hamming)


EDGES = "ed AS (SELECT o_custkey AS a, o_orderkey AS b FROM orders), e AS (SELECT l_orderkey AS src, 1000000000 + l_partkey AS dst FROM lineitem UNION SELECT 2000000000 + o_custkey, o_orderkey FROM orders UNION SELECT 3000000000 + c_nationkey, 2000000000 + c_custkey FROM customer)"


def order_graph(spark, sf):
    """A DAG of nations, customers, orders and parts."""
    li, o, c = (A.table(spark, sf, n) for n in ("lineitem", "orders", "customer"))
    return (
        li.select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 1000000000).alias("dst"))
        .unionByName(o.select((F.col("o_custkey") + 2000000000).alias("src"), F.col("o_orderkey").alias("dst")))
        .unionByName(c.select((F.col("c_nationkey") + F.lit(3000000000)).alias("src"), (F.col("c_custkey") + 2000000000).alias("dst")))
        .distinct()
    )


@query("u09_transitive_closure", "WITH RECURSIVE " + EDGES + ", t(anc, desc_) AS (SELECT src, dst FROM e UNION SELECT t.anc, e.dst FROM t JOIN e ON e.src = t.desc_) SELECT anc, desc_ AS \"desc\" FROM t")
def u09(spark, sf):
    return graph.closure(order_graph(spark, sf))


SHORTCUTS = ", s AS (SELECT src, dst FROM e UNION SELECT 3000000000 + c_nationkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F')"


@query(
    "u10_transitive_reduction",
    "WITH RECURSIVE " + EDGES + SHORTCUTS + ", t(a, d) AS (SELECT src, dst FROM s UNION SELECT t.a, s.dst FROM t JOIN s ON s.src = t.d) SELECT src, dst FROM s WHERE NOT EXISTS (SELECT 1 FROM s m JOIN t ON t.a = m.dst WHERE m.src = s.src AND t.d = s.dst)",
)
def u10(spark, sf):
    o = A.table(spark, sf, "orders").where("o_orderstatus = 'F'")
    c = A.table(spark, sf, "customer")
    extra = c.join(o, F.col("c_custkey") == F.col("o_custkey")).select((F.col("c_nationkey") + F.lit(3000000000)).alias("src"), F.col("o_orderkey").alias("dst"))
    edges = order_graph(spark, sf).unionByName(extra).distinct()
    return graph.reduction(edges, graph.closure(edges))


NODES = ", n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"


@query("u11_u0c_source_and_sink", "WITH " + EDGES + NODES + " SELECT src, dst FROM e UNION ALL SELECT -1, id FROM n WHERE id NOT IN (SELECT dst FROM e) UNION ALL SELECT id, -2 FROM n WHERE id NOT IN (SELECT src FROM e)")
def u11(spark, sf):
    e = order_graph(spark, sf)
    nodes = e.select(F.col("src").alias("read_id")).union(e.select("dst")).distinct()
    return graph.with_ends(e, nodes)


@query(
    "u12_path_counts",
    "WITH " + EDGES + ", c AS (SELECT dst AS node, 1.0 AS n FROM e WHERE src >= 3000000000), o AS (SELECT dst AS node, sum(n) AS n FROM c JOIN e ON src = node GROUP BY dst), p AS (SELECT dst AS node, sum(n) AS n FROM o JOIN e ON src = node GROUP BY dst) SELECT node, CAST(n AS DOUBLE) AS paths FROM p",
)
def u12(spark, sf):
    e = order_graph(spark, sf)
    roots = e.where("src >= 3000000000").select(F.lit(-1).cast("long").alias("src"), F.col("src").alias("dst")).distinct()
    return graph.path_counts(e.unionByName(roots)).where("node between 1000000000 and 1999999999")


def _chains(spark, sf):
    f = fragments(spark, sf)
    e = durable(joins.overlaps(f, LEAST))
    at = durable(graph.placed(f))
    return f, at, graph.chain_cover(e.select(F.col("src").alias("anc"), F.col("dst").alias("desc")), at, e)


@query("u14_chain_cover")
def u14(spark, sf):
    return _chains(spark, sf)[2]


@query("u16_chain_sequences")
def u16c(spark, sf):
    f, at, chains = _chains(spark, sf)
    return graph.path_sequences(chains, f, at=at)


@query("u16_path_sequences", "WITH " + WHOLE + " SELECT hap_id AS chain, md5(seq) AS seq FROM hp")
def u16(spark, sf):
    f = durable(fragments(spark, sf))
    chains = f.select(F.floor(F.col("read_id") / LINES).alias("chain"), (F.col("read_id") % LINES).cast("int").alias("place"), "read_id")
    return graph.path_sequences(chains, f).select("chain", F.md5("seq").alias("seq"))


@query("u13_all_paths", "SELECT '-1,' || CAST(3000000000 + c_nationkey AS VARCHAR) || ',' || CAST(2000000000 + c_custkey AS VARCHAR) || ',' || CAST(o_orderkey AS VARCHAR) || ',' || CAST(1000000000 + l_partkey AS VARCHAR) || ',-2' AS path FROM customer JOIN orders ON o_custkey = c_custkey JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) ON l_orderkey = o_orderkey")
def u13(spark, sf):
    e = order_graph(spark, sf)
    first = e.where("src >= 3000000000").select(F.lit(-1).cast("long").alias("src"), F.col("src").alias("dst")).distinct()
    last = e.where("dst between 1000000000 and 1999999999").select(F.col("dst").alias("src"), F.lit(-2).cast("long").alias("dst")).distinct()
    return graph.all_paths(durable(e.unionByName(first).unionByName(last))).select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("u15_u0b_o05_united_haplotypes")
def u15(spark, sf):
    f = fragments(spark, sf)  # made again where they are looked at, without those that others contain
    lost = durable(joins.contained(f))
    e = durable(joins.overlaps(f, LEAST, without=lost))
    return graph.haplotypes(joins.nearly(f, lost).join(lost, "read_id", "left_anti"), e, restarts=3)


EM = "cp AS (SELECT l_orderkey AS read_id, l_suppkey AS hap_id, 1 AS n FROM lineitem GROUP BY ALL), p0 AS (SELECT hap_id, 1.0 / count(*) OVER () AS p FROM (SELECT DISTINCT hap_id FROM cp))"


def _em_round(k: int) -> str:
    return f""", j{k} AS (SELECT read_id, hap_id, n, p, sum(p) OVER (PARTITION BY read_id) AS whole FROM cp JOIN p{k - 1} USING (hap_id)), u{k} AS (SELECT hap_id, sum(n * p / whole) AS u FROM j{k} GROUP BY hap_id),
 p{k} AS (SELECT hap_id, u / sum(u) OVER () AS p FROM u{k})"""


def _compat(spark, sf):
    return A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_suppkey").alias("hap_id"), F.lit(1).alias("n")).distinct()


@query("a14_u17_em_three_rounds", "WITH " + EM + "".join(_em_round(k) for k in (1, 2, 3)) + " SELECT hap_id, round(p, 6) AS p FROM p3")
def a14(spark, sf):
    return em.frequencies(_compat(spark, sf), rounds=3).select("hap_id", F.round("p", 6).alias("p"))


@query("k04_frequency_ranks", "WITH " + EM + _em_round(1) + " SELECT row_number() OVER (ORDER BY round(p, 9) DESC, hap_id) AS rank, hap_id, round(p, 6) AS p FROM p1 WHERE p > 0")
def k04(spark, sf):
    p = em.frequencies(_compat(spark, sf), rounds=1)
    ranked = numbered(p.withColumn("q", F.round("p", 9)), [F.desc("q"), F.col("hap_id")], "rank")
    return ranked.select("rank", "hap_id", F.round("p", 6).alias("p"))


# alignments of two names; scores by the same recurrence in SQL

NAMES = "p AS (SELECT n_name AS a, r_name AS b FROM nation, region)"


def _alignment_sql(local: bool) -> str:
    least = "greatest(0.0, {})" if local else "{}"
    edge = "0.0" if local else "-4.0 * j"
    first = "0.0" if local else "row[1] - 4.0"
    cand = f"CASE WHEN k = 0 THEN {first} ELSE greatest(row[k] + CASE WHEN substr(a, i + 1, 1) = substr(b, k, 1) THEN 4.0 ELSE -4.0 END, row[k + 1] - 4.0) END - 4.0 * (j - k)"
    new = "list_transform(range(0, length(b) + 1), lambda j: " + least.format(f"list_max(list_transform(range(0, j + 1), lambda k: {cand}))") + ")"
    rows = f"WITH RECURSIVE {NAMES}, t(a, b, i, row) AS (SELECT a, b, CAST(0 AS BIGINT), list_transform(range(0, length(b) + 1), lambda j: CAST({edge} AS DOUBLE)) FROM p UNION ALL SELECT a, b, i + 1, list_transform({new}, lambda x: CAST(x AS DOUBLE)) FROM t WHERE i < length(a))"
    return rows + (" SELECT a, b, max(list_max(row)) AS score FROM t GROUP BY a, b" if local else " SELECT a, b, row[length(b) + 1] AS score FROM t WHERE i = length(a)")


def _names(spark, sf):
    n, r = A.table(spark, sf, "nation").select(F.col("n_name").alias("a")), A.table(spark, sf, "region").select(F.col("r_name").alias("b"))
    return n.crossJoin(r)  # the cases themselves: 25 by 5 names


@query("u03_global_linear_scores", _alignment_sql(False))
def u03(spark, sf):
    return align.align_pairs(_names(spark, sf), "global-linear").select("a", "b", "score")


@query("u04_local_linear_scores", _alignment_sql(True))
def u04(spark, sf):
    return align.align_pairs(_names(spark, sf), "local-linear").select("a", "b", "score")


@query("u02_local_affine_alignments")
def u02(spark, sf):
    h = A.haps(spark, sf).where("length(seq) > 0")
    nxt = h.select((F.col("hap_id") - 1).alias("hap_id"), F.col("seq").alias("b"))
    return align.align_pairs(h.withColumnRenamed("seq", "a").join(nxt, "hap_id"), "local").select("hap_id", "score", "row_a", "row_b")


@query("u05_profile_scores", _alignment_sql(False))
def u05(spark, sf):
    # a profile of one letter a place is a text, so that the same recurrence checks it
    return align.align_pairs(_names(spark, sf).withColumn("p", F.regexp_replace("a", "(.)", "[$1]")), "profile", a="p").select("a", "b", "score")


@query(
    "f16_padded_rows",
    with_("bases")
    + """, c AS (SELECT read_id, pos, base, sum(CASE WHEN base <> 'N' THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos) AS rp FROM bases),
 pt AS (SELECT read_id, rp, count(*) FILTER (WHERE base = 'N') AS k, max(CASE WHEN base <> 'N' THEN base END) AS base FROM c GROUP BY read_id, rp),
 mx AS (SELECT rp, max(k) AS m FROM pt GROUP BY rp), m0 AS (SELECT coalesce(max(m), 0) AS m0 FROM mx WHERE rp = 0)
 SELECT read_id, md5(CASE WHEN min(rp) > 0 THEN repeat('-', CAST(any_value(m0) AS BIGINT)) ELSE '' END || string_agg(coalesce(base, '') || repeat('N', k) || repeat('-', m - k), '' ORDER BY rp)) AS row FROM pt JOIN mx USING (rp), m0 GROUP BY read_id""",
)
def f16p(spark, sf):
    # an endless reference, with N of a read as insertions
    row = A.rows(spark, sf).where("length(seq) > 0").select("read_id", F.regexp_replace("seq", "[^N]", "A").alias("r"), F.col("seq").alias("read_row"))
    pairs = row.select("read_id", F.translate("r", "N", "-").alias("ref_row"), "read_row")
    return align.propagate_gaps(pairs).select("read_id", F.md5("row").alias("row"))
