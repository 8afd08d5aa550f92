"""Joins, graphs, alignment, sampling, models: brute force, invariants and recovery of planted truth."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.functions import seq as S
from readloom.operators import aggregates, align, em, filters, graph, hmm, joins, lanes, pipeline, places, randomised, report, sampler


def reads_of(spark, rows):
    df = spark.createDataFrame(rows, "read_id long, start int, seq string")
    return df.withColumn("len", F.length("seq")).withColumn("stop", F.col("start") + F.col("len") - 1)


def test_containment_and_overlap_by_brute_force(spark):
    rng = random.Random(4)
    genome = "".join(rng.choice("ACGT") for _ in range(60))
    rows = []
    for i in range(120):
        a, n = rng.randrange(50), rng.randrange(3, 30)
        s = list(genome[a : a + n])
        if rng.random() < 0.3:
            s[rng.randrange(len(s))] = "A"
        rows.append((i, a, "".join(s)))
    rows += [(500, *rows[0][1:]), (501, *rows[0][1:])]
    df = reads_of(spark, rows)
    agree = lambda x, y: y[2][x[1] - y[1] : x[1] - y[1] + len(x[2])] == x[2]
    covers = lambda y, x: y[1] <= x[1] and y[1] + len(y[2]) >= x[1] + len(x[2]) and agree(x, y)
    want = {x[0] for x in rows if not any(covers(y, x) and ((y[1], y[2]) != (x[1], x[2]) or y[0] < x[0]) for y in rows if y[0] != x[0])}
    assert {r["read_id"] for r in joins.remove_contained(df).collect()} == want
    edges = set()
    for x, y in itertools.permutations(rows, 2):
        n = x[1] + len(x[2]) - y[1]
        if x[1] < y[1] and x[1] + len(x[2]) < y[1] + len(y[2]) and n >= 5 and x[2][-n:] == y[2][:n]:
            edges.add((x[0], y[0]))
    assert {tuple(r) for r in joins.overlaps(df, 5).collect()} == edges and edges


def test_windows_and_range_join(spark):
    rows = [(i, s, "A" * n) for i, (s, n) in enumerate([(0, 10), (3, 4), (9, 1), (17, 12), (40, 2)])]
    df = reads_of(spark, rows)
    got = {(r["read_id"], r["wstart"], r["overlap"]) for r in joins.windows_of(df, 6, 2).collect()}
    want = {(i, w, min(s + n, w + 5) - max(s + 1, w) + 1) for i, s, q in rows for n in [len(q)] for w in range(1, 70, 3) if min(s + n, w + 5) - max(s + 1, w) + 1 > 0}
    assert got == want
    other = df.select(F.col("read_id").alias("rid"), F.col("start").alias("rstart"), F.col("stop").alias("rstop"))
    pairs = sorted((r["read_id"], r["rid"]) for r in joins.range_join(df, other, 4).collect())
    assert pairs == sorted((a[0], b[0]) for a in rows for b in rows if a[1] < b[1] + len(b[2]) and b[1] < a[1] + len(a[2]))
    plan = joins.range_join(df, other, 4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan


def test_compatibility(spark):
    df = reads_of(spark, [(1, 0, "AC"), (2, 1, "CG"), (3, 2, "TT"), (4, 3, "A")])
    haps = spark.createDataFrame([(10, "ACGA"), (11, "TCGT")], "hap_id long, seq string")
    assert {tuple(r) for r in joins.compatible(df, haps).collect()} == {(1, 10), (2, 10), (2, 11), (4, 10)}


def small_dag(rng, n=10):
    return sorted({(a, b) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.25})


def paths_from(edges, a):
    out = {a: [[a]]}
    todo = [[a]]
    done = []
    while todo:
        p = todo.pop()
        nxt = [b for x, b in edges if x == p[-1]]
        done.append(p)
        todo += [p + [b] for b in nxt]
    return done or out


def test_graph_by_brute_force(spark):
    rng = random.Random(9)
    edges = small_dag(rng)
    nodes = spark.range(10).select(F.col("id").alias("read_id"))
    e = spark.createDataFrame(edges, "src long, dst long")
    reach = {(p[0], p[-1]) for a in range(10) for p in paths_from(edges, a) if len(p) > 1}
    pairs = graph.closure(e)
    assert {tuple(r) for r in pairs.collect()} == reach
    want = {(a, b) for a, b in edges if not any((a, c) in set(edges) and (c, b) in reach for c in range(10))}
    red = graph.reduction(e, pairs)
    assert {tuple(r) for r in red.collect()} == want
    full = graph.with_ends(e, nodes)
    fe = [tuple(r) for r in full.collect()]
    every = [p for p in paths_from(fe, -1) if p[-1] == -2]
    counts = {r["node"]: r["paths"] for r in graph.path_counts(full).collect()}
    assert counts[-2] == len(every)
    assert sorted(tuple(r["path"]) for r in graph.all_paths(full).collect()) == sorted(map(tuple, every))
    with pytest.raises(ValueError):
        graph.all_paths(full, most=1)
    assert graph.one_path(full) in every
    chains = graph.chain_cover(pairs, nodes, e).toPandas()
    assert sorted(chains["read_id"]) == list(range(10))
    for _, c in chains.groupby("chain"):
        ids = list(c.sort_values("place")["read_id"])
        assert all((a, b) in reach for a, b in zip(ids, ids[1:]))
    widest = max(len(s) for k in range(1, 11) for s in itertools.combinations(range(10), k) if not any((a, b) in reach for a, b in itertools.permutations(s, 2)))
    assert chains["chain"].nunique() == widest  # fewest chains equal the largest antichain


def test_chain_cover_makes_its_closure(spark, monkeypatch):
    rounds, keep = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rounds.append(1) or keep(df))
    cross = [(1, 3), (2, 3), (3, 4), (3, 5)]
    ids = random.Random(4).sample(range(10, 1000), 400)  # one long path, in any order of its ids
    edges = spark.createDataFrame([*cross, *zip(ids, ids[1:])], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in [*range(1, 7), *ids]], "read_id long")
    label = {r["read_id"]: r["component"] for r in graph.components(edges, nodes).collect()}
    assert label == {i: 1 for i in range(1, 6)} | {6: 6} | {i: min(ids) for i in ids}
    pairs = edges.withColumnsRenamed({"src": "anc", "dst": "desc"})
    for seed in (None, 3):
        chains = {}
        for r in sorted(graph.chain_cover(pairs, nodes, edges, seed).collect(), key=lambda r: r["place"]):
            chains.setdefault(r["chain"], []).append(r["read_id"])
        assert sorted(map(len, chains.values())) == [1, 2, 3, 400] and chains[6] == [6] and chains[ids[0]] == ids  # 1 3 4, 2 5 or the like
    assert len(rounds) <= 45


def test_overlaps_without_some_reads(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ACGT") for _ in range(200)) for _ in range(2)]
    rows = []
    for i in range(90):
        a, n = rng.randrange(150), rng.randrange(12, 45)
        rows.append((i, a, texts[i % 2][a : a + n]))
    reads = reads_of(spark, rows)
    lost = spark.createDataFrame([(i,) for i in range(0, 90, 7)], "read_id long")
    want = {(i, j) for i, a, s in rows for j, b, t in rows if i % 7 and j % 7 and min(len(s), len(t)) >= 10 and a < b and a + len(s) < b + len(t) and a + len(s) - b >= 10 and s[b - a :] == t[: a + len(s) - b]}
    assert {tuple(r) for r in joins.overlaps(reads, 10, without=lost).collect()} == want and len(want) > 50


def test_only_the_smallest_haplotypes_are_kept(spark):
    reads = reads_of(spark, [(i, i % 5, t) for i, t in enumerate(["ACGT", "AACC", "GGTT", "ACGT", "CCGT", "TTTT", "AACC"] * 3)])
    every = sorted({"." * r["start"] + r["seq"] for r in reads.collect()})
    none = spark.createDataFrame([], "src long, dst long")
    for most in (3, 21):
        assert [r["seq"] for r in graph.haplotypes(reads, none, most=most).collect()] == every[:most]


def test_a_component_is_held_in_few_bytes_a_pair():
    import tracemalloc

    import pyarrow as pa

    n = 1000
    a, d = np.triu_indices(n, 1)
    columns = [np.full(len(a), 7), -a, a + 100, d + 100]  # ranked from the last to the first
    columns = [np.concatenate([x, y]) for x, y in zip(columns, ([7, 8], [1 - n, 0], [n + 99, 5], [n + 99, 5]))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 10_000], pa.int64()) for c in columns], ["component", "by", "anc", "desc"]) for lo in range(0, len(a) + 2, 10_000)]
    tracemalloc.start()
    c, children, names = next(found := graph._apart(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert c == 7 and names == list(range(n + 99, 99, -1)) and [len(x) for x in children] == list(range(n))
    assert next(found) == (8, [[]], [5]) and next(found, None) is None
    assert peak < 32 * len(a)


def test_matching_by_bits():
    rng = random.Random(11)
    for _ in range(60):
        left = [[v for v in range(6) if rng.random() < 0.3] for _ in range(6)]
        got = graph.bipartite_matching([sum(1 << v for v in some) for some in left])
        assert all(v in left[u] for u, v in got.items()) and len(set(got.values())) == len(got)
        best = {frozenset()}
        for some in left:
            best |= {taken | {v} for taken in best for v in some if v not in taken}
        assert len(got) == max(map(len, best))


def test_haplotypes_of_a_long_path(spark, monkeypatch):
    rounds, keep = [], graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: rounds.append(1) or keep(df))
    text = "".join(random.Random(5).choice("ACGT") for _ in range(130))
    reads = reads_of(spark, [(i, i, text[i : i + 8]) for i in range(120)])
    edges = spark.createDataFrame([(i, i + 1) for i in range(119)], "src long, dst long")
    for most in (5, 1):  # all paths; covers made longer
        assert [r["seq"] for r in graph.haplotypes(reads, edges, most=most).collect()] == [text[:127]]
    assert len(rounds) <= 30


def test_path_sequences(spark):
    df = reads_of(spark, [(1, 2, "ACGT"), (2, 4, "GTAA"), (3, 10, "CC")])
    chains = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 3)], "chain long, place int, read_id long")
    assert graph.path_sequences(chains, df, 14).first()["seq"] == "..ACGTAA..CC.."


def exhaustive(a, b, opening, extension, free):
    """Best global score over all alignments, by recursion on states."""
    from functools import lru_cache

    sub = align.substitution(a, b)

    @lru_cache(None)
    def best(i, j, state):
        if i == len(a) and j == len(b):
            return 0.0
        out = []
        if i < len(a) and j < len(b):
            out.append(sub[i, j] + best(i + 1, j + 1, 0))
        if i < len(a):
            cost = 0 if free and j in (0, len(b)) else extension if state == 1 else opening
            out.append(best(i + 1, j, 1) - cost)
        if j < len(b):
            cost = 0 if free and i in (0, len(a)) else extension if state == 2 else opening
            out.append(best(i, j + 1, 2) - cost)
        return max(out)

    return best(0, 0, 0)


def test_alignment_scores():
    rng = random.Random(6)
    for _ in range(150):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 8))) for _ in range(2))
        for free in (True, False):
            score, x, y = align.align(a, b, 6.0, 3.0, free_ends=free)
            assert abs(score - exhaustive(a, b, 6.0, 3.0, free)) < 1e-9, (a, b, free)
            assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        score, x, y = align.align(a, b, 6.0, 3.0, mode="local")
        want = max([0.0] + [exhaustive(a[i:j], b[k:m], 6.0, 3.0, False) for i in range(len(a)) for j in range(i + 1, len(a) + 1) for k in range(len(b)) for m in range(k + 1, len(b) + 1)])
        assert abs(score - want) < 1e-9
        assert x.replace("-", "") in a and y.replace("-", "") in b
    assert align.align_linear("ACGT", "AGT", 4, 4, -4)[0] == 8
    profile = [{"A": 1.0}, {"C": 0.5, "G": 0.5}]
    assert align.profile_scores(profile, "AC").tolist() == [[4, -4], [-4, 0]]


def test_both_strands_of_many_texts_at_once(monkeypatch):
    rng = random.Random(8)
    one, asked = align.align, []
    monkeypatch.setattr(align, "align", lambda *a: asked.append(a) or one(*a))
    for cut in (lanes.CUT, 1):  # whole texts; lanes as short as they can be
        monkeypatch.setattr(lanes, "CUT", cut)
        for n in (1, 2, 5, 9, 20):
            for _ in range(8):
                letters = rng.choice(["ACGT", "AC", "ACGTNR", "A"])
                text = lambda k: "".join(rng.choice(letters) for _ in range(k))
                ref, texts = text(n), [text(rng.choice([1, 2, 3, 5, 15, 40, 90, 150])) for _ in range(10)]
                opening, extension = rng.choice([(6.0, 3.0), (3.0, 3.0), (5.0, 2.0), (4.5, 2.0)])
                for s, got in zip(texts, align._better_strands(ref, texts, opening, extension)):
                    forward, back = one(ref, s, opening, extension), one(ref, align.reverse_complement(s), opening, extension)
                    assert got == ((False, *forward) if forward[0] > back[0] else (True, *back)), (ref, s)
    asked.clear()
    ref = "".join(rng.choice("ACGT") for _ in range(60))
    align._better_strands(ref, ["".join(rng.choice("ACGT") for _ in range(400)) for _ in range(50)], 6.0, 3.0)
    assert not asked  # none by itself


def test_msa_pad_and_merge(spark):
    pairs = spark.createDataFrame([(1, "AC-GT", "ACTGT"), (2, "ACGT", "A-GT"), (3, "AC--GT", "ACTTGA"), (4, "-ACGT", "TACGT")], "read_id long, ref_row string, read_row string")
    padded = {r["read_id"]: r["row"] for r in align.propagate_gaps(pairs).collect()}
    assert padded == {1: "-ACT-GT", 2: "-A---GT", 3: "-ACTTGA", 4: "TAC--GT"}
    merged = {r["read_id"]: r["row"] for r in align.propagate_gaps(pairs, pad=False).collect()}
    assert merged == {1: "ACGT", 2: "A-GT", 3: "ACGA", 4: "ACGT"}


def test_msa_without_moving_letters(spark):
    pairs = spark.createDataFrame([(1, "--AC", "TGAC"), (2, "AC", "A\u00fc"), (3, "--", "GT"), (4, "", ""), (5, None, None), (6, "A-C-", "AT")], "read_id long, ref_row string, read_row string")
    padded, merged = align.propagate_gaps(pairs), align.propagate_gaps(pairs, pad=False)
    assert {r["read_id"]: r["row"] for r in padded.collect()} == {1: "TGA-C-", 2: "--A-\u00fc-", 3: "GT", 4: "--", 5: "--", 6: "--AT-"}
    assert {r["read_id"]: r["row"] for r in merged.collect()} == {1: "AC", 2: "A\u00fc", 3: "", 6: "A"}
    for rows in (padded, merged):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Generate" not in plan  # no row for each letter


def test_msa_of_overlaps(spark):
    rows = [(1, "--AC-GT", "TTACTGT"), (2, "ACGT---", "A-GTCCC"), (3, "AC--GT", "-CTTG-"), (4, "ACGT--", "----AC"), (5, None, None), (6, "A-CGT", "--CGT")]
    cut = align.overlaps(spark.createDataFrame(rows, "read_id long, ref_row string, read_row string")).cache()
    got = {r["read_id"]: (r["ref_row"], r["read_row"]) for r in cut.collect()}
    assert got == {1: ("AC-GT", "ACTGT"), 2: ("ACGT", "A-GT"), 3: ("AC--GT", "-CTTG-"), 4: ("ACGT", "----"), 5: (None, None), 6: ("ACGT", "-CGT")}
    both = {r["read_id"]: (r["row"], r["padded"]) for r in align.propagate_gaps(cut, both=True).collect()}
    assert both == {1: ("ACGT", "ACT-GT"), 2: ("A-GT", "A---GT"), 3: ("-CG-", "-CTTG-"), 4: ("----", "------"), 6: ("-CGT", "-C--GT")}


def test_em(spark):
    compat = spark.createDataFrame([(i, h, 1) for i, hs in enumerate([(1,), (1,), (1, 2), (2,), (1, 2), (1,)]) for h in hs], "read_id long, hap_id long, n int")
    a = {1: 0, 2: 0}
    p = {1: 0.5, 2: 0.5}
    last = -1e9
    for _ in range(4):
        a = {1: 3 + 2 * p[1], 2: 1 + 2 * p[2]}
        p = {k: v / sum(a.values()) for k, v in a.items()}
    got = em.frequencies(compat, rounds=4)
    assert all(abs(r["p"] - p[r["hap_id"]]) < 1e-9 for r in got.collect())
    for k in (1, 2, 3):
        now = em.log_likelihood(compat, em.frequencies(compat, rounds=k))
        assert now >= last
        last = now
    assert abs({r["hap_id"]: r["p"] for r in em.frequencies(compat).collect()}[1] - 0.75) < 1e-2


def test_em_without_joins_of_reads(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, h, 1 + i % 3) for i in range(400) for h in rng.sample([3, 7, 10**10, 12, -4, 9], rng.randrange(1, 5))]
    compat = spark.createDataFrame(rows, "read_id long, hap_id long, n int").cache()
    results = []
    for most in (em.MOST_HAPS, 0):  # frequencies in every task; joined
        monkeypatch.setattr(em, "MOST_HAPS", most)
        steps = []
        one = em.step
        monkeypatch.setattr(em, "step", lambda *a: steps.append(a) or one(*a))
        got = [{r["hap_id"]: r["p"] for r in em.frequencies(compat, **how).collect()} for how in ({"rounds": 3}, {"most": 4, "tolerance": 0.0}, {"tolerance": 0.05}, {"tolerance": 1e-3, "kill": 0.1})]
        monkeypatch.setattr(em, "step", one)
        results.append(got)
        assert bool(steps) == (most == 0)
    for a, b in zip(*results):
        assert a.keys() == b.keys() and all(abs(a[h] - b[h]) < 1e-9 for h in a)


def test_sampler_recovers_planted_mix():
    rng = random.Random(3)
    a = "".join(rng.choice("ACGT") for _ in range(60))
    b = "".join(c if k % 6 else "ACGT"[("ACGT".index(c) + 1) % 4] for k, c in enumerate(a))
    noisy = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in s)
    reads = [noisy(a) for _ in range(80)] + [noisy(b) for _ in range(20)]
    got = sampler.sample_window(reads, [1] * 100, iterations=60, seed=5)
    top = [h for h, p, n in got["support"] if p >= 0.9 and n >= 5]
    assert set(top) == {a, b}
    corrected = [h for h, _ in got["reads"]]
    assert sum(h == a for h in corrected[:80]) >= 78 and sum(h == b for h in corrected[80:]) >= 18
    assert sampler.sample_window(reads, [1] * 100, iterations=10, seed=5) == sampler.sample_window(reads, [1] * 100, iterations=10, seed=5)
    b1, b2 = sampler.proposal(0.97, 0.9)
    assert abs(b1 + (sampler.B - 1) * b2 - 1) < 1e-12


def test_local_correction(spark):
    rng = random.Random(8)
    hap = "".join(rng.choice("ACGT") for _ in range(40))
    rows = [(i, 0, hap if i % 7 else hap[:5] + ("A" if hap[5] != "A" else "C") + hap[6:]) for i in range(40)]
    fixed, sampled = sampler.local_correction(reads_of(spark, rows), width=20, shifts=2, iterations=40)
    out = {r["read_id"]: (r["start"], r["seq"]) for r in fixed.collect()}
    assert len(out) == 40 and sum(v == (0, hap) for v in out.values()) >= 34
    assert sampler.proposals(sampled).count() == sampled.select("wstart").distinct().count()
    again, _ = sampler.local_correction(reads_of(spark, rows), 20, 2, 5, done=sampled.select("wstart").distinct())
    assert again.count() == 0


def test_hmm_invariant_and_brute_force():
    rng = np.random.default_rng(2)
    anc = rng.integers(0, 2, (2, 3))
    for length in (1, 2, 3):
        total = sum(np.prod([hmm.forward(r, anc[:, :length], 0.2, 0.1, 0.05)[-1].sum() for r in m]) for m in hmm.constellations(2, length))
        assert abs(total - 1) < 1e-12
        for j in range(length):  # summed over all read sets, place j leaves the free letters after it
            part = sum(np.prod([hmm.forward(r, anc[:, :length], 0.2, 0.1, 0.05)[j].sum() for r in m]) for m in hmm.constellations(2, length))
            assert abs(part - 2 ** (2 * (length - j - 1))) < 1e-9
    for m in hmm.constellations(1, 3):
        assert abs(hmm.forward(m[0], anc, 0.2, 0.1, 0.05)[-1].sum() - hmm.brute_force(m[0], anc, 0.2, 0.1, 0.05)) < 1e-12


def test_simulation_and_permutation(spark):
    a, b = "ACGT" * 20, "TTGA" * 20
    sim = randomised.simulate_reads(spark, [a, b], 4000, 20, 0.05, shares=[0.8, 0.2]).toPandas()
    assert abs((sim.clone == 0).mean() - 0.8) < 0.03 and (sim.seq.str.len() == 20).all()
    wrong = np.mean([x != y for r in sim.itertuples() for x, y in zip(r.seq, (a, b)[r.clone][r.start : r.start + 20])])
    assert abs(wrong - 0.05) < 0.01
    rec = randomised.simulate_recombinants(spark, a, b, 500, 40, 5).toPandas()
    assert all(r.seq == a[: r.split] + b[r.split :] for r in rec.itertuples()) and abs(rec.split.mean() - 40) < 1
    amb = spark.createDataFrame([(1, "ACRN"), (2, "YA")], "i long, s string").select("i", randomised.resolve_ambiguous(F.col("s"), F.col("i")).alias("s"))
    assert all(set(r["s"]) <= set("ACGT") for r in amb.collect())
    shuffled = spark.createDataFrame([(1, "AACCGT")], "i long, s string").select(randomised.shuffle_sequence(F.col("s"), F.col("i"))).first()[0]
    assert sorted(shuffled) == sorted("AACCGT")
    pts = spark.createDataFrame([(i, "b", [i // 20]) for i in range(40)], "i long, block string, obs array<long>")
    g = joins.nearest_graph(pts, 1)
    lab = pts.select("i", (F.col("i") >= 20).cast("string").alias("label"))
    p = randomised.permutation_test(g, lab, 50).first()
    assert p["p_value"] < 0.05


def test_reports(spark):
    clones = {"a": "ACGTTGCAACGTACCA", "b": "TTTTCCCCGGGGAAAA"}
    half = clones["a"][:8] + clones["b"][8:]
    r = spark.createDataFrame([(1, clones["a"]), (2, half)], "read_id long, seq string")
    assert [x["read_id"] for x in report.recombinants(r, clones).collect()] == [2]
    assert report.best_split(half, clones["a"], clones["b"], 4, 12)[0] == 8
    haps = spark.createDataFrame([(clones["a"], 3.0), ("CCC", 1.0)], "seq string, reads double")
    named = spark.createDataFrame(list(clones.items()), "clone string, seq string")
    assert {(x["clone"], x["percent"]) for x in report.match_clones(haps, named).collect()} == {("a", 75.0), ("unmatched", 25.0)}
    assert report.amplicon_span("AAACCCGGGTTT", "CCCGG") == (4, 8)
    back = clones["a"][::-1].translate(str.maketrans("ACGT", "TGCA"))
    o = report.oriented(spark.createDataFrame([(1, back)], "read_id long, seq string"), clones["a"])
    assert o.first()["seq"] == clones["a"]
    pairs = spark.createDataFrame([(1, "ATGAAATTT", "ATGAGATTT"), (2, "ATGAAATTT", "ATGAAATTT")], "read_id long, ref_row string, read_row string")
    assert {(x["signature"], x["n"]) for x in report.codon_variants(pairs).collect()} == {("K2R", 1), ("", 1)}
    merged = report.merge_missing(spark.createDataFrame([(1, 1, "ACN"), (1, 2, "ACG"), (1, 3, "TCG")], "wstart long, hap_id long, seq string"))
    assert {tuple(x) for x in merged.collect()} == {(1, 1), (2, 1), (3, 3)}


def test_backfilled_rows_without_looking_at_each_letter(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("AC--\u00fc") for _ in range(n))
    rows = [(text(rng.randrange(12)), text(rng.randrange(12))) for _ in range(300)] + [(None, "A"), ("A-C", None), ("", ""), ("AC", "--")]
    pairs = spark.createDataFrame(rows, "ref_row string, read_row string")
    first = S.inner(F.col("read_row"))[0]
    start = F.length(F.replace(F.substring(F.col("ref_row"), F.lit(1), F.greatest(first - 1, F.lit(0))), F.lit("-"), F.lit("")))
    want = pairs.select(S.backfill(F.col("ref_row"), F.col("read_row")).alias("f"), start.alias("s"), F.replace("ref_row", F.lit("-"), F.lit("")).alias("ref"))
    got = report._filled(pairs)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert "transform" not in got._jdf.queryExecution().executedPlan().toString()


def test_classifier(spark):
    rng = np.random.default_rng(0)
    rows = [(float(y), [float(v) for v in rng.normal(2 * y, 1, 3)]) for y in (0, 1) for _ in range(80)]
    df = spark.createDataFrame(rows, "label double, features array<double>")
    for lasso in (False, True):
        scored = report.linear_classifier(df, df, lasso=lasso)
        assert aggregates.rank_sum_auc(scored, "score", "label").first()["auc"] > 0.95
    assert len(report.lasso_path(df, [0.01, 0.1]).collect()) == 2


def test_vote_and_gaps(spark):
    votes = spark.createDataFrame([(1, 1, "A"), (1, 1, "C"), (1, 2, "N"), (1, 3, "T"), (1, 3, "T"), (1, 3, "A")], "read_id long, pos long, base string")
    assert {(r["pos"], r["base"]) for r in aggregates.majority_vote(votes).collect()} == {(1, "A"), (2, "X"), (3, "T")}
    cov = aggregates.coverage(reads_of(spark, [(1, 0, "AAA"), (2, 2, "CC"), (3, 9, "G")]))
    assert {tuple(r) for r in cov.collect()} == {(0, 1), (1, 1), (2, 2), (3, 1), (9, 1)}
    b = spark.createDataFrame([(1, 1, "A"), (2, 1, "-"), (3, 1, "N"), (1, 2, "A"), (2, 2, "C"), (3, 2, "-")], "read_id long, pos long, base string")
    fixed = aggregates.correct_gaps(b)
    assert fixed.where("fixed").count() == 2 and {r["base"] for r in fixed.where("pos = 1").collect()} == {"A"}


def test_whole_reads_are_scored(spark):
    rng = np.random.default_rng(3)
    anc = ["".join(rng.choice(list("ACGT"), n)) for n in (12, 15, 13)]
    reads = {i: "".join(rng.choice(list("ACGTN"), n)) for i, n in enumerate((0, 1, 12, 13, 24, 40))}
    got = {r["read_id"]: r["loglik"] for r in hmm.score_reads(spark.createDataFrame(list(reads.items()), "read_id long, seq string"), anc).collect()}
    number = lambda s, other: np.array(["ACGT".find(c) if c in "ACGT" else other for c in s])
    for i, s in reads.items():
        parts = [s[k : k + 12] for k in range(0, len(s), 12)]
        want = sum(hmm.log_likelihood(number(p, -2), np.stack([number(a[: len(p)], -1) for a in anc]), 0.05, 0.01, 0.01, 4) for p in parts)
        assert abs(got[i] - want) < 1e-9
    with pytest.raises(ValueError):
        hmm.score_reads(spark.createDataFrame([(1, "A")], "read_id long, seq string"), ["ACGT", ""])


def letters(rng, n, of="ACGT"):
    return "".join(rng.choice(of) for _ in range(n))


def test_recombinants_of_planted_halves(spark):
    """Halves of two clones are found; whole copies, noisy copies and poor reads are not."""
    rng = random.Random(12)
    clones = {k: letters(rng, 160) for k in "abc"}
    rows, planted = [], set()
    for i in range(12):
        x, y = rng.sample("abc", 2)
        rows.append((i, clones[x][:80] + clones[y][80:]))
        planted.add(i)
    noisy = lambda s: "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in s)
    rows += [(100 + i, noisy(clones[rng.choice("abc")])) for i in range(12)]
    rows += [(200 + i, letters(rng, 160)) for i in range(40)]
    got = report.recombinants(spark.createDataFrame(rows, "read_id long, seq string"), clones).collect()
    assert {r["read_id"] for r in got} == planted
    assert all(r["best_a"] != r["best_b"] and r["gain"] > 0.05 for r in got)


def test_scores_of_many_clones_at_once():
    rng = random.Random(3)
    for _ in range(150):
        clones = [letters(rng, rng.randrange(1, 25), "ACGTN") for _ in range(rng.randrange(1, 5))]
        read = letters(rng, rng.randrange(1, 30)) if rng.random() < 0.5 else clones[0][2:15] or "A"
        assert np.allclose(align.scores_against(clones, read), [align.align(c, read)[0] for c in clones])
    assert align.scores_against(["ACG"], "").tolist() == [0.0]


def best_by_hand(a, b, gap, match, mismatch, local):
    row = [0.0 if local else -gap * j for j in range(len(b) + 1)]
    top = max(row)
    for i, x in enumerate(a, 1):
        new = [0.0 if local else -gap * i]
        for j, y in enumerate(b, 1):
            v = max(row[j - 1] + (match if x == y else mismatch), row[j] - gap, new[-1] - gap)
            new.append(max(v, 0.0) if local else v)
        row = new
        top = max(top, *row)
    return top if local else row[-1]


def test_many_reads_meet_many_clones_at_once(spark, monkeypatch):
    rng = random.Random(31)
    text = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    clones = {f"c{k}": text(rng.randrange(1, 30)) for k in range(6)}
    clones["c9"] = clones["c0"]  # the last name of equal ones
    reads = ["", "A", *(text(rng.randrange(1, 200)) for _ in range(40)), *clones.values()]
    names = sorted(clones, reverse=True)
    texts = [clones[n] for n in names]
    want = np.array([[align.align(c, s)[0] for c in texts] for s in reads])
    with monkeypatch.context() as m:
        m.setattr(align, "scores_against", None)  # no read by itself
        assert np.array_equal(align._matrix(texts, reads, 6.0, 3.0)[0], want)
        best, top, width = align._best(texts, reads, 6.0, 3.0)
    assert best.tolist() == want.argmax(axis=1).tolist() and top.tolist() == want.max(axis=1).tolist()
    assert width.tolist() == [align.span(*align.align(texts[b], s)[1:]) for b, s in zip(best, reads)]
    assert np.array_equal(align._matrix(texts, reads, 4.5, 2.0)[0], [[align.align(c, s, 4.5, 2.0)[0] for c in texts] for s in reads])
    df = spark.createDataFrame(list(enumerate(reads)), "read_id long, seq string")
    assert {tuple(r) for r in align.cross_scores(df, clones).collect()} == {(i, n, w) for i in range(len(reads)) for n, w in zip(names, want[i])}


def test_pairwise_forms(spark):
    rng = random.Random(5)
    rows = [(i, letters(rng, rng.randrange(0, 12)), letters(rng, rng.randrange(0, 12))) for i in range(40)] + [(99, None, "ACG")]
    df = spark.createDataFrame(rows, "i long, a string, b string")
    for method, local in (("global-linear", False), ("local-linear", True)):
        for r in align.align_pairs(df, method).collect():
            a, b = r["a"] or "", r["b"] or ""
            assert r["score"] == best_by_hand(a, b, 4.0, 4.0, -4.0, local), (method, a, b)
            x, y = r["row_a"], r["row_b"]
            assert len(x) == len(y) and x.replace("-", "") in a and y.replace("-", "") in b
            worth = sum(-4.0 if "-" in p else 4.0 if p[0] == p[1] else -4.0 for p in zip(x, y))
            assert worth == r["score"]
    for r in align.align_pairs(df, "local").collect():
        x, y = r["row_a"], r["row_b"]
        assert r["score"] >= 0 and x.replace("-", "") in (r["a"] or "") and y.replace("-", "") in (r["b"] or "")
        runs = "".join("g" if c == "-" else "h" if d == "-" else "m" for c, d in zip(x, y))
        gaps = [len(list(v)) for k, v in itertools.groupby(runs) if k in "gh"]
        assert r["score"] == sum(5.0 if c == d else -4.0 for c, d in zip(x, y) if "-" not in (c, d)) - sum(6 + 3 * (n - 1) for n in gaps)
    p = align.align_pairs(spark.createDataFrame([("A[CG]T", "ACT"), ("A[CG]T", "AT"), ("[AC][AC]", "GG")], "a string, b string"), "profile").collect()
    assert [r["score"] for r in p] == [8.0, 4.0, -8.0]
    with pytest.raises(ValueError):
        align.align_pairs(df, "other")


def test_nearest_neighbours_by_brute_force(spark):
    rng = random.Random(6)
    obs = {i: [rng.choice("abcd"), rng.choice("abcd"), rng.choice(["x", "y", None])] for i in range(60)} | {99: ["q", "r", "s"]}
    got = {tuple(r) for r in joins.nearest_graph(spark.createDataFrame(list(obs.items()), "i long, obs array<string>"), 3).collect()}
    d = lambda a, b: sum(x != y for x, y in zip(obs[a], obs[b]))
    want = set()
    for i in obs:
        low = min(d(i, j) for j in obs if j != i)
        want |= {p for j in obs if j != i and d(i, j) == low for p in ((i, j), (j, i))}
    assert got == want
    m = joins.distance_matrix(spark.createDataFrame([(1, "ACG"), (2, "AG")], "i long, seq string"), S.hamming)
    assert {tuple(r) for r in m.collect()} == {(1, 1, 0), (1, 2, 1), (2, 1, 1), (2, 2, 0)}


def test_votes_are_counted_in_their_read(spark):
    rng = random.Random(13)
    reads = [(i, rng.randrange(4), rng.randrange(8, 20)) for i in range(20)]
    rows = [(w, "read", i, "".join(rng.choice("ACGT-NN") for _ in range(9)), rng.choice((0.5, 0.9))) for i, _, _ in reads[:18] for w in (1, 4, 7, 10)]
    want = set()
    for i, a, b in reads:
        text = ""
        for p in range(a, b + 1):
            said = [h[p - w + 1] for w, _, j, h, q in rows if j == i and q > 0.8 and 0 <= p - w + 1 < 9 and h[p - w + 1] != "N"]
            text += min(said, key=lambda c: (-said.count(c), c)) if said else "X"
        inner = text.strip("X")
        if inner and inner.count("X") <= 2:
            want.add((i, a + len(text) - len(text.lstrip("X")), inner))
    got = sampler.correct_reads(spark.createDataFrame(reads, "read_id long, start int, stop int"), spark.createDataFrame(rows, "wstart long, kind string, read_id long, hap string, posterior double"), most_uncovered=2)
    assert want and {tuple(r) for r in got.collect()} == want
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()  # no row for each letter


def test_merges_up_to_missing_by_brute_force(spark):
    rng = random.Random(14)
    base = ["".join(rng.choice("ACGT") for _ in range(70)) for _ in range(3)]
    rows = []
    for i in rng.sample(range(1000), 120):
        s = list(rng.choice(base))
        for k in rng.sample(range(70), rng.choice((0, 0, 1, 3, 30))):
            s[k] = rng.choice("NNNNA")
        rows.append((rng.choice((1, 68)), i, "".join(s)))
    rows += [(1, 2000, "N" * 70), (68, 2001, base[0]), (68, 2002, base[0]), (1, 2003, base[0][:69])]
    want, kept = set(), []
    for w, i, s in sorted(rows, key=lambda r: r[1]):
        into = next((j for v, j, t in kept if v == w and len(s) == len(t) and all(x == y or "N" in (x, y) for x, y in zip(s, t))), i)
        want.add((i, into))
        if into == i:
            kept.append((w, i, s))
    got = report.merge_missing(spark.createDataFrame(rows, "wstart long, hap_id long, seq string"))
    assert len(kept) < 100 and {tuple(r) for r in got.collect()} == want


def test_windowed_clones_by_brute_force(spark, monkeypatch):
    rng = random.Random(15)
    text = lambda: "".join(rng.choice("ACGTN-") for _ in range(rng.choice((8, 8, 6))))
    haps = [(w, t, float(rng.randrange(1, 5))) for w in (1, 4, 7) for t in {text() for _ in range(40)} | {"N" * 8}]
    clones = [(w, f"c{k}", text()) for w in (1, 4) for k in range(12)]
    want = {}
    for w, h, n in haps:
        found = []
        for v, name, c in clones:
            if v == w:
                both = [(x, y) for x, y in zip(h, c) if "N" not in (x, y)]
                found.append((sum(x != y for x, y in both) / len(both) if both else 100.0, name))
        if found and min(found)[0] <= 0.5:
            want[w, min(found)[1]] = want.get((w, min(found)[1]), 0.0) + n
    h, c = spark.createDataFrame(haps, "wstart long, hap string, freq double"), spark.createDataFrame(clones, "wstart long, clone string, cseq string")
    got = report.windowed_clones(h, c, 0.5)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == want
    assert "MapInPandas" in got._jdf.queryExecution().executedPlan().toString()  # no row for each pair
    monkeypatch.setattr(report, "MOST_CLONES", 3)
    assert {(r[0], r[1]): r[2] for r in report.windowed_clones(h, c, 0.5).collect()} == want


def test_haplotype_support_by_brute_force(spark):
    rng = random.Random(12)
    base = ["".join(rng.choice("ACGT") for _ in range(70)) for _ in range(3)]
    rows = []
    for i in range(80):
        s = list(rng.choice(base))
        for k in rng.sample(range(70), rng.choice((0, 0, 0, 1, 3, 40))):
            s[k] = "N"
        rows.append((rng.choice((1, 68)), i, "".join(s)))
    rows += [(1, 100, "N" * 70), (68, 101, base[0]), (68, 102, base[0]), (1, 103, base[0][:69])]
    fits = lambda a, b: len(a) == len(b) and all(x == y or "N" in (x, y) for x, y in zip(a, b))
    first = {}
    for w, i, s in rows:
        first[w, s] = min(i, first.get((w, s), i))
    want = {(w, i, sum(v == w and fits(s, t) for v, _, t in rows)) for (w, s), i in first.items()}
    got = joins.haplotype_support(spark.createDataFrame(rows, "wstart long, read_id long, wseq string"))
    assert {tuple(r) for r in got.collect()} == want


def test_windows_are_cut_without_walking(spark):
    rows = [(1, 0, 3, "ACGT"), (2, 2, 13, "ACGTACGTACGT"), (3, 5, None, "AC"), (4, 7, 8, "AC")]
    got = joins.windowed_reads(spark.createDataFrame(rows, "read_id long, start int, stop int, seq string"), 6, 3, 0.5)
    assert {(r["wstart"], r["wend"], r["read_id"], r["wseq"]) for r in got.collect()} == {(1, 6, 1, "ACGTNN"), (1, 6, 2, "NNACGT")} | {(w, w + 5, 2, ("ACGTACGTACGT"[w - 3 : w + 3]).ljust(6, "N")) for w in (3, 5, 7, 9, 11)}
    assert "substring" not in got._jdf.queryExecution().executedPlan().toString()


def test_equal_up_to_missing_by_brute_force(spark):
    rng = random.Random(7)
    base = [letters(rng, 70) for _ in range(4)]
    hide = lambda s: "".join("N" if rng.random() < rng.choice([0.0, 0.02, 0.3]) else c for c in s)
    rows = [(w, i, hide(rng.choice(base))) for w in (1, 2) for i in range(25)] + [(1, 99, "N" * 70)]
    haps = [(w, f"h{i}", hide(rng.choice(base))) for w in (1, 2) for i in range(10)]
    got = {tuple(r) for r in joins.equal_but_missing(spark.createDataFrame(rows, "wstart long, read_id long, seq string"), spark.createDataFrame([(w, f"{w}{h}", s) for w, h, s in haps], "wstart long, hap_id string, seq string")).collect()}
    want = {(i, f"{v}{h}") for w, i, s in rows for v, h, t in haps if w == v and all(a == b or "N" in (a, b) for a, b in zip(s, t))}
    assert got == want and len(want) > 20


def test_lock_step_refuses_single_ids(spark):
    a, b = spark.createDataFrame([(1, 2.0), (2, 3.0)], "read_id long, x double"), spark.createDataFrame([(1, 5.0), (2, 6.0)], "read_id long, y double")
    assert {tuple(r) for r in joins.lock_step(a, b).collect()} == {(1, 2.0, 5.0), (2, 3.0, 6.0)}
    with pytest.raises(Exception, match="not on both sides: 2"):
        joins.lock_step(a, b.where("read_id = 1")).collect()


def test_running_totals_and_places(spark):
    rng = random.Random(1)
    values = rng.sample(range(10_000), 500)
    df = spark.createDataFrame([(v, v % 7) for v in values], "k long, n long").repartition(5)
    want, total = {}, 0
    for v in sorted(values):
        total += v % 7
        want[v] = total
    assert {r["k"]: r["n_until"] for r in aggregates.running_totals(df, "k", ["n"]).collect()} == want
    places = {r["k"]: r["place"] for r in aggregates.numbered(df, [F.desc("k")]).collect()}
    assert places == {v: i for i, v in enumerate(sorted(values, reverse=True), 1)}


def test_box_data_refuses_missing_reads(spark):
    rows = [("a", 1, 8), ("b", 1, 2), ("a", 2, 6), ("b", 2, 4)]
    got = {r["hap"]: (r["low"], r["median"], r["high"]) for r in aggregates.box_data(spark.createDataFrame(rows, "hap string, iter int, reads long")).collect()}
    assert got == {"a": (0.6, 0.7, 0.8), "b": (0.2, 0.30000000000000004, 0.4)} or all(abs(x - y) < 1e-12 for k, v in got.items() for x, y in zip(v, {"a": (0.6, 0.7, 0.8), "b": (0.2, 0.3, 0.4)}[k]))
    with pytest.raises(ValueError):
        aggregates.box_data(spark.createDataFrame([*rows, ("a", 3, 1)], "hap string, iter int, reads long"))


def test_all_paths_and_united_covers(spark):
    edges = [(-1, 1), (-1, 2), (1, 3), (2, 3), (3, 4), (3, 5), (4, -2), (5, -2)]
    e = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(tuple(r["path"]) for r in graph.all_paths(e).collect()) == [(-1, a, 3, b, -2) for a in (1, 2) for b in (4, 5)]
    with pytest.raises(ValueError):
        graph.all_paths(e, most=3)
    seqs = {1: (0, "AACC"), 2: (0, "TTCC"), 3: (2, "CCGG"), 4: (4, "GGAA"), 5: (4, "GGTT")}
    reads = reads_of(spark, [(i, s, t) for i, (s, t) in seqs.items()])
    inner = e.where("src > 0 and dst > 0")
    every = {a + "CCGG" + b for a in ("AA", "TT") for b in ("AA", "TT")}
    assert {r["seq"] for r in graph.haplotypes(reads, inner, 8).collect()} == every
    some = {r["seq"] for r in graph.haplotypes(reads, inner, 8, most=3, restarts=6).collect()}  # four paths: covers are united
    assert some <= every and 2 <= len(some) <= 3
    assert {s[:2] for s in some} == {"AA", "TT"} and {s[-2:] for s in some} == {"AA", "TT"}


def test_unexplained_reads_and_filled_haplotypes(spark):
    haps = spark.createDataFrame([("AACC..",), ("AACCGG",), ("..CCGT",)], "seq string")
    filled = sorted(r["seq"] for r in aggregates.fill_uncovered(haps).collect())
    assert filled == ["AACCGG", "AACCGT"]  # the first becomes the second one, and is there once
    reads = reads_of(spark, [(1, 0, "AACC"), (2, 2, "CCGG"), (3, 2, "CCGG"), (4, 2, "CCGT"), (5, 1, "TTTT"), (6, 5, "GA")])
    freq, lost = em.estimate(reads, haps)
    assert lost == 2
    p = {r["seq"]: r["p"] for r in freq.collect()}
    assert abs(p["AACCGG"] - 2 / 3) < 0.02 and abs(p["AACCGT"] - 1 / 3) < 0.02


def test_window_parameters(spark):
    rng = random.Random(2)
    rows = [(i, 0, letters(rng, 40)) for i in range(12)]
    w = joins.windowed_reads(reads_of(spark, rows), 20, 1)
    own = spark.createDataFrame([(1, 0.5, 7), (21, 0.5, 12)], "wstart long, alpha double, iterations int")
    got = sampler.sample_windows(w, 30, parameters=own).where("kind = 'trace'").groupBy("wstart").agg(F.max("iter").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(1, 7), (21, 12)}
    assert filters.pending(w, own.where("wstart = 1")).select("wstart").distinct().collect()[0][0] == 21


def test_insertions_are_spread(spark):
    cigar = lambda s: S.cigar(F.lit(s))
    rows = spark.createDataFrame([("r1", "AACTGG", "2M1I3M", 0), ("r2", "AATGG", "5M", 0), ("r3", "AACCCTG", "2M3I2M", 0), ("r4", "ATG", "1M1D2M", 1)], "read_id string, seq string, cigar string, pos int")
    own = rows.select("read_id", S.to_window(S.expand_cigar(F.col("seq"), S.cigar(F.col("cigar")), "n"), F.col("pos"), 0, 5).alias("row"), S.insertions(F.col("seq"), S.cigar(F.col("cigar")), F.col("pos"), 0, 6).alias("insertions"))
    got = {r["read_id"]: r["row"] for r in align.spread_insertions(own, 6).collect()}
    assert got == {"r1": "AAC--TGG-", "r2": "AA---TGG-", "r3": "AACCCTG--", "r4": "-A----TG-"}
    ref = "AACCGGTTAACC"
    laid = spark.range(1).select(S.expand_on_reference(F.lit("AAGG"), cigar("2M2D1M1I1M"), F.lit(0), F.lit(ref)), S.expand_on_reference(F.lit("AAGG"), cigar("2M3D2M"), F.lit(0), F.lit(ref)))
    assert tuple(laid.first()) == ("AACCG", "AA---GG")


def test_packed_distance(spark):
    rng = random.Random(1)
    rows = [(i, letters(rng, n, "ACGT-N"), letters(rng, n, "ACGT-N")) for i, n in enumerate((0, 1, 9, 10, 11, 35))]
    got = spark.createDataFrame(rows, "i long, a string, b string").select("i", S.packed_hamming(S.pack(F.col("a")), S.pack(F.col("b"))).alias("d"), S.hamming_missing(F.col("a"), F.col("b"))["dist"].alias("e"))
    assert all(r["d"] == r["e"] for r in got.collect())


def test_radial_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2))
    rows = [([float(v) for v in p], float((p**2).sum() > 1.2)) for p in x]  # a ring, which no line parts
    df = spark.createDataFrame(rows, "features array<double>, label double")
    auc = lambda d: aggregates.rank_sum_auc(report.linear_classifier(d, d), "score", "label").first()["auc"]
    assert auc(report.random_features(df, 2, 0.7, 64)) > 0.95 > 0.75 > auc(df)


def test_whole_way_recovers_a_mixture(spark):
    """1000 reads of a mixture of 80 to 20: the two sequences come out on top with shares within 0.05."""
    rng = random.Random(9)
    a = letters(rng, 240)
    b = "".join("ACGT"["ACGT".index(c) ^ 1] if i % 24 == 11 else c for i, c in enumerate(a))
    reads = randomised.simulate_reads(spark, [a, b], 1000, 200, 0.01, shares=[0.8, 0.2])
    haps, lost = pipeline.haplotype_frequencies(reads, a, pipeline.Settings(width=90, iterations=100, alpha=0.1))
    top = sorted(((r["p"], r["seq"]) for r in haps.collect()), reverse=True)
    share = lambda s: sum(p for p, t in top if t == s)
    assert {t for _, t in top[:2]} == {a, b}, top[:4]
    assert abs(share(a) - 0.8) < 0.05 and abs(share(b) - 0.2) < 0.05, (top[:4], lost)


def test_clusters_must_name_a_shared_folder():
    from types import SimpleNamespace as Space

    from readloom.operators import state

    jsc = Space(sc=lambda: Space(getCheckpointDir=lambda: Space(isDefined=lambda: False)))
    conf = Space(get=lambda key: None)
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            state.shared_folder(Space(sparkContext=Space(_jsc=jsc, getConf=lambda: conf, master=master)))


def test_nearest_groups_are_the_nearest_graph(spark):
    rng = random.Random(16)
    df = spark.createDataFrame([(i, [rng.choice("abcd"), rng.choice("abcdef"), rng.choice(["x", "y", None])]) for i in range(50)] + [(99, ["q", "r", "s"])], "i long, obs array<string>")
    groups, edges = joins.nearest_groups(df, 3)
    held = {}
    for first, i in groups.collect():
        held.setdefault(first, set()).add(i)
    inside = {p for g in held.values() for p in itertools.permutations(g, 2)}
    outside = {tuple(r) for r in edges.collect()}
    assert inside and outside and not inside & outside and all(first == min(g) for first, g in held.items())
    assert inside | outside == {tuple(r) for r in joins.nearest_graph(df, 3).collect()}


def test_permuted_places_are_even_and_need_no_labellings(spark):
    for n in (1, 2, 5, 16, 17, 1000):
        assert sorted(randomised.dealt_places(np.arange(n), n, 7)) == list(range(n))
    seen = np.zeros((5, 5))
    pairs = np.zeros((5, 5))
    for key in range(5000):
        p = randomised.dealt_places(np.arange(5), 5, key)
        seen[np.arange(5), p] += 1
        pairs[p[0], p[3]] += 1
    assert abs(seen / 1000 - 1).max() < 0.15 and abs(pairs[~np.eye(5, dtype=bool)] / 250 - 1).max() < 0.3
    rng = random.Random(3)
    nodes = spark.createDataFrame([(i, [i // 8], rng.choice(["a", "b", "c", None])) for i in range(64)], "i long, obs array<long>, label string")
    groups, edges = joins.nearest_groups(nodes, 1)
    graph, labels = joins.nearest_graph(nodes, 1), nodes.select("i", "label")
    label = {r["i"]: r["label"] for r in labels.collect()}
    whole, parts = (randomised.permutation_test(g, labels, 300, groups=h) for g, h in ((graph, None), (edges, groups)))
    plan = whole._jdf.queryExecution().analyzed().toString()
    assert "explode" not in plan.lower()
    got = whole.first()
    assert got == parts.first()
    pairs = [(i, j) for i in range(64) for j in range(i + 1, 64) if i // 8 == j // 8]
    stat = lambda lab: sum(lab[i] is not None and lab[i] == lab[j] for i, j in pairs)
    assert got["statistic"] == stat(label)
    null = []
    for _ in range(2000):
        v = list(label.values())
        rng.shuffle(v)
        null.append(stat(dict(zip(label, v))))
    assert abs(got["p_value"] - np.mean([t >= got["statistic"] for t in null])) < 0.12
    assert randomised.permutation_test(graph.limit(0), labels, 10).first()["p_value"] is None


def test_texts_meet_at_places_by_brute_force(spark):
    rng = random.Random(21)
    genome = [letters(rng, 700) for _ in range(3)]
    haps = [(i, "".join(rng.choice(genome)[a : a + 50] for a in range(0, rng.choice([100, 700, 650]), 50))) for i in range(20)] + [(90, genome[0]), (91, ""), (92, genome[0])]
    cut = lambda g, a, n: (a, g[a : a + n])
    reads = [cut(rng.choice(genome), rng.randrange(690), rng.choice([1, 2, 7, 15, 16, 17, 31, 40, 100, 513, 700])) for _ in range(150)]
    reads += reads[:20] + [(3, genome[1][3:60] + "A"), (699, "AC")]
    df = reads_of(spark, [(i, a, s) for i, (a, s) in enumerate(reads)])
    hp = spark.createDataFrame(haps, "hap_id long, seq string")
    want = {(i, h) for i, (a, s) in enumerate(reads) for h, t in haps if t[a : a + len(s)] == s}
    members, held = joins.compatible_classes(df, hp)
    first = {r["read_id"]: r["first"] for r in members.collect()}
    assert {i: min(j for j, other in enumerate(reads) if other == r) for i, r in enumerate(reads)} == first
    pairs = [tuple(r) for r in held.collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {(i, h) for i, h in want if first[i] == i}  # copies are not paired
    got = [tuple(r) for r in joins.compatible(df, hp).collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 200


def test_filters_hold_all_and_few_others(spark):
    df = spark.range(20000).select(F.xxhash64("id").alias("h"))
    f = places.Filter(df, 20000)
    inside, outside = (np.array([r[0] for r in d.collect()], dtype=np.int64).view(np.uint64) for d in (df, spark.range(20000).select(F.xxhash64("id", F.lit(1)))))
    assert len(f.held(inside)) == 20000 and len(f.held(outside)) < 100


def test_memory_of_a_window_grows_with_its_reads(spark):
    import tracemalloc

    rng = random.Random(9)
    seqs = sorted({letters(rng, 60) for _ in range(3000)})
    tracemalloc.start()
    got = sampler.sample_window(seqs, [1] * len(seqs), iterations=1, seed=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got["reads"]) == len(seqs) and peak < 40e6  # reads times clusters are 72 MB


def test_agreeing_by_brute_force(spark, monkeypatch):
    rng = random.Random(31)
    base = ["".join(rng.choice("ACGT-ü") for _ in range(70)) for _ in range(4)]
    rows = []
    for k in range(300):
        s = list(rng.choice(base)[: rng.choice((70, 70, 61))])
        for at in rng.sample(range(len(s)), rng.choice((0, 0, 1, 4, 9, 20, 45))):
            s[at] = rng.choice("NNNNNNA")
        rows.append((rng.choice((1, 68)), "".join(s)))
    rows += [(1, "N" * 70), (68, base[0]), (68, base[0]), (1, ("N" + "A" * 15) * 4 + "A" * 6), (1, "A" * 69 + "N")]
    want = {(w, a, b) for w, a in rows for v, b in rows if w == v and a != b and len(a) == len(b) and all(x == y or "N" in (x, y) for x, y in zip(a, b))}
    named = {hashlib.md5(s.encode()).digest(): s for _, s in rows}
    for together, few in ((50_000, 20_000), (20, 3)):
        monkeypatch.setattr(joins, "TOGETHER", together)
        monkeypatch.setattr(joins, "FEW_ROWS", few)
        got = [(r["wstart"], named[bytes(r["a"])], named[bytes(r["b"])]) for r in joins.agreeing(spark.createDataFrame(rows, "wstart int, seq string")).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 300


def test_agreeing_without_replicas_of_texts(spark, monkeypatch):
    rng = random.Random(32)
    rows = []  # no two of them agree, many have no whole block in common
    for k in range(400):
        s = [rng.choice("ACGT") for _ in range(201)]
        for at in rng.sample(range(201), 8):
            s[at] = "N"
        rows.append((1, "".join(s)))
    plans = []
    keep = joins.durable
    monkeypatch.setattr(joins, "durable", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    assert joins.agreeing(spark.createDataFrame(rows, "wstart long, seq string")).isEmpty()
    assert not any("arrays_overlap" in p for p in plans)  # texts aren't joined by the blocks that they lack
