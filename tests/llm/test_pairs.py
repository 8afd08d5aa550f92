"""Line dedup, SimHash, decontamination and nearest neighbours against brute force, and awkward rows."""

import math
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from readloom.llm import decontam, linededup, mih, simhash
from readloom.llm.common import connected_components, table
from tests.llm.helpers import LONG, SF, messy, rows_of


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1040)] + [(-5, -7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    s = Sets()
    for a, b in edges:
        if a is not None:
            s.join(a, b)
    assert all(s.find(n) == c for n, c in got.items())
    assert {n for e in edges if None not in e and e[0] != e[1] for n in e} == set(got)
    wide = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), together=0).collect()}
    assert wide == got  # by contraction
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text, n=3):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    fp = {i: plain_fingerprint(t) for i, t in docs}
    s = Sets()
    for i, _ in docs:
        for j, _ in docs:
            if i < j and (fp[i] ^ fp[j]).bit_count() <= 2:
                s.join(i, j)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op6(spark, SF).collect()}
    assert got == {i: (f"{fp[i]:016x}", s.find(i)) for i, _ in docs}


def test_simhash_chain_and_fingerprint_of_spark_hash(spark):
    chain = [0b111 << 60, (0b111 << 60) | 1, (0b111 << 60) | 7, (0b111 << 60) | 31, 0]
    u = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in chain], "fp long")
    for hot in (1_000, 1):  # the second way is for segment values with many holders
        comp = {r["node"]: r["component"] for r in connected_components(simhash.links(u, hot=hot)).collect()}
        assert len(set(comp.values())) == 1 and len(comp) == 4
    assert spark.range(1).select(F.xxhash64(F.lit("héllo wörld x"))).first()[0] % (1 << 64) == xxhash.xxh64_intdigest("héllo wörld x".encode(), 42)


def test_links_against_all_pairs(spark):
    """Dense fingerprints, so that many lie within two bits and many share a segment."""
    rng = random.Random(8)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for _ in range(400):
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    s = Sets()
    for i, x in enumerate(signed):
        s.find(x)
        for y in signed[:i]:
            if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 2:
                s.join(x, y)
    u = spark.createDataFrame([(x,) for x in signed], "fp long")
    for hot in (1_000, 3):
        comp = {r["node"]: r["component"] for r in connected_components(simhash.links(u, hot=hot)).collect()}
        assert all(comp.get(x, x) == s.find(x) for x in signed) and len(comp) > 300


def test_sketches_and_keys_follow_similarity():
    """Shares of equal sketch bits and equal table keys are those of the similarity; no pair of 0.8 is far apart."""
    rng = np.random.default_rng(4)
    bits = lambda x: np.unpackbits(simhash.set_sketch(x).view(np.uint8))
    for similarity in (0.5, 0.8, 0.95):
        equal, shared, far = [], [], 0
        for _ in range(60):
            n = 360
            common = round(similarity * n)
            h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, n, dtype=np.uint64)
            extra = (n - common) // 2
            a, b = np.sort(h[: common + extra]), np.sort(np.concatenate([h[:common], h[common + extra :]]))
            equal.append((bits(a) == bits(b)).mean())
            shared.append((simhash.set_keys(a) == simhash.set_keys(b)).mean())
            far += (bits(a) != bits(b)).sum() > simhash._APART
        assert abs(np.mean(equal) - (1 + similarity) / 2) < 0.01
        assert abs(np.mean(shared) - similarity**simhash.ROWS) < 0.05
        assert far == 0 if similarity >= 0.8 else far > 50


def test_rows_of_one_id_with_other_texts_stay(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b), (3, a + " end")], "doc_id long, text string")
    assert rows_of(simhash.simhash_stage(spark, docs, SF), "doc_id", "text") == sorted([(1, a), (1, b)])


def test_simhash_awkward_rows_and_stage(spark):
    got = rows_of(simhash.near_duplicates(messy(spark)), "doc_id", "component_id")
    assert len(got) == 10 and (6, 1) in got and (3, 2) in got and (4, 2) in got and (2, 2) in got
    kept = simhash.simhash_stage(spark, messy(spark), SF)
    assert kept.columns == messy(spark).columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 5, 8, 9]
    assert simhash.near_duplicates(messy(spark).limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        kind, at = rng.randrange(3) if s else 0, rng.randrange(max(1, len(s)))
        if kind == 0:
            s.insert(at, rng.choice("abcé"))
        elif kind == 1:
            s.pop(at)
        else:
            s[at] = rng.choice("abcé")
    return "".join(s)


def test_banded_distance():
    rng = random.Random(5)
    for _ in range(4000):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        b = mutate(rng, a, rng.randrange(4))
        for k in (1, 2, 3):
            assert linededup.within(a, b, k) == (edit_distance(a, b) <= k), (a, b, k)


def test_line_links_against_brute_force(spark):
    rng = random.Random(7)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(40, 60))) for _ in range(25)]
    lines = [x.strip() for x in base + [mutate(rng, rng.choice(base), rng.randrange(1, 5)) for _ in range(120)]]
    lines = [x for x in dict.fromkeys(lines) if len(x) >= 40]
    docs = spark.createDataFrame([(i, "\n".join(lines[i::7])) for i in range(7)], "doc_id long, text string")
    got = {(r["a"], r["b"]) for r in linededup.line_links(docs).collect()}
    want = set()
    for i, x in enumerate(lines):
        for y in lines[i + 1 :]:
            if edit_distance(x, y) <= 2:
                want.add(tuple(sorted((linededup.line_id(x), linededup.line_id(y)))))
    assert got == want and len(want) > 20
    assert {(r["a"], r["b"]) for r in linededup.line_links(docs, broadcast_ids=0).collect()} == want


def test_line_classes_and_stage(spark):
    one, near, other = "This line is repeated in a number of documents, word for word.", "This line is repeated in a number of documents, word for word!", "Another line that is quite unlike the first one and stays alone here."
    docs = spark.createDataFrame([(3, f"{one}\n{other}\nshort"), (2, near), (5, f"{one}\n  {one} \nshort one"), (7, None), (8, "")], "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["n_links"], r["kept"]) for r in linededup.line_classes(docs).collect()}
    assert got == {(2, 0): (2, 1, True), (3, 0): (2, 1, False), (3, 1): (3, 0, True), (3, 2): (3, 0, True), (5, 0): (2, 1, False), (5, 1): (2, 1, False), (5, 2): (5, 0, True)}
    stage = linededup.line_stage(spark, docs.withColumn("n_chars", F.length("text").cast("long")).withColumn("id", F.lit(1)), SF)
    assert stage.columns == ["doc_id", "text", "n_chars", "id"]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage.collect()} == {2: (near, len(near)), 3: (f"{other}\nshort", len(other) + 6), 5: ("short one", 9), 7: (None, None), 8: ("", 0)}


def test_line_awkward_rows(spark):
    got = linededup.line_classes(messy(spark))
    rows = rows_of(got, "doc_id", "line_no", "kept")
    assert (5, 0, True) in rows and (6, 0, False) in rows and rows.count((1, 0, True)) == 2 and (None, 0, True) in rows
    assert linededup.line_classes(messy(spark).limit(0)).count() == 0
    assert linededup.line_stage(spark, messy(spark), SF).count() == 9  # document 6 holds nothing of its own, 9 one letter


def test_decontamination_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(decontam.OP10_SQL).df().sort_values("doc_id").reset_index(drop=True)
    got = decontam.op10(spark, SF).toPandas().sort_values("doc_id").reset_index(drop=True)[want.columns]
    assert got.equals(want.astype(got.dtypes.to_dict())) and want.contaminated.any()
    by_shuffle = decontam.decontaminate(table(spark, SF, "documents"), table(spark, SF, "benchmark"), broadcast_rows=10)
    assert rows_of(by_shuffle, "doc_id", "n_words", "n_hit", "n_items") == sorted(map(tuple, want[["doc_id", "n_words", "n_hit", "n_items"]].values.tolist()), key=repr)


def test_decontamination_cases(spark):
    words = [f"w{i}" for i in range(30)]
    items = spark.createDataFrame([(1, " ".join(words[:15])), (2, "Tiny ITEM"), (3, " ".join(words[:15])), (4, None), (5, "--"), (1, " ".join(words[:15])), (10, " ".join(words[20:30])), (None, "nameless item here"), (None, "another nameless one")], "item_id long, text string")
    docs = spark.createDataFrame(
        [
            (1, "x " + " ".join(words[2:13]) + " y"),  # 11 of the item's words: two windows
            (2, " ".join(words[2:11])),  # nine: no window
            (3, "a tiny, item; TINY item"),
            (4, None),
            (5, ""),
            (6, " ".join(words[20:30] + words[20:30])),
            (6, " ".join(words[20:30] + words[20:30])),
            (None, "tiny item"),
            (7, LONG),
            (8, "Été tiny É item"),
            (9, "a nameless item here, and ANOTHER nameless one; here"),
        ],
        "doc_id long, text string",
    ).withColumn("w", F.lit(1))
    for rows in (200_000, 3):  # by broadcast, and by shuffle
        got = decontam.decontaminate(docs, items, broadcast_rows=rows)
        res = sorted(((r["doc_id"] or -1, r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got.collect()))
        assert res == [(-1, 2, 2, ("2",)), (1, 13, 11, ("1", "3")), (2, 9, 0, ()), (3, 5, 4, ("2",)), (4, 0, 0, ()), (5, 0, 0, ()), (6, 20, 20, ("10",)), (6, 20, 20, ("10",)), (7, 24000, 0, ()), (8, 4, 0, ()), (9, 9, 6, ())]
        assert [r["n_items"] for r in got.where("doc_id = 9").collect()] == [1]
    empty = decontam.decontaminate(docs, items.limit(0))
    assert empty.count() == 11 and empty.where("contaminated").count() == 0
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    for rows in (200_000, 3):
        plan = decontam.decontaminate(docs, items, broadcast_rows=rows)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan


def test_decontamination_stage_keeps_columns(spark):
    d = messy(spark)
    got = decontam.decontaminate_stage(spark, d, SF)
    assert got.columns == d.columns and got.count() == d.count()


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("shard", F.lit(0))


@pytest.mark.parametrize("shard_rows", [32_768, 300])
def test_nearest_recall_and_scores(spark, shard_rows):
    v = table(spark, "/root/testdata/sf0.1", "embeddings")
    queries = v.where("vec_id % 100 = 0")
    got = mih.search(v, queries, shard_rows=shard_rows, block_rows=8 if shard_rows == 300 else 2048).collect()
    rows = v.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        want = set(ids[np.lexsort((ids, d))[:10]])
        own = sorted(found[q])
        assert [k for k, _, _ in own] == list(range(1, 11))
        assert all(math.isclose(s, d[ids == i][0], rel_tol=1e-12) for _, i, s in own)
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
        hits += len(want & {i for _, i, _ in own})
    assert hits / (10 * (ids % 100 == 0).sum()) >= 0.9


def test_nearest_awkward_vectors(spark):
    rows = [(100, [1.0, 0.0], 1), (200, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [0.0, 0.0], 1), (5, None, 1), (6, [float("nan"), 1.0], 1), (7, [float("inf"), 1.0], 1), (8, [None, 1.0], 1), (9, [-1.0, 0.5], None), (300, [0.0, 0.0], 1)]
    v = _vectors(spark, rows)
    got = rows_of(mih.search(v, v.where("vec_id % 100 = 0")), "query_id", "rank", "vec_id")
    assert got == [(100, 1, 3), (100, 2, 200), (100, 3, 9), (200, 1, 3), (200, 2, 100), (200, 3, 9)]
    assert mih.search(v.limit(0), v).count() == 0 and mih.search(v, v.limit(0)).count() == 0


def test_pigeonhole_holds_the_radius():
    """All codes within (ball + 1) m - 1 bits are fetched, and exactly those that some table holds in the ball."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 32))
    x[100:400] = x[0] + rng.standard_normal((300, 32)) * rng.random((300, 1))  # some that are near
    codes = mih.fit(x, rotations=2)
    shard = mih.Shard(np.arange(3000), x, codes)
    assert (shard.ids == np.arange(3000)).all()
    c = codes.encode(x)
    within = 0
    for i in range(20):
        for ball in (0, 1, 2, 3):
            got = set(shard.fetched(c[i], ball).tolist())
            parts = mih.POPCOUNT[c ^ c[i]].astype(int)
            assert got == set(np.flatnonzero((parts <= ball).any(axis=1)).tolist())
            near = set(np.flatnonzero(parts.sum(axis=1) <= (ball + 1) * c.shape[1] - 1).tolist())
            assert near <= got
            within += len(near) - 1
    assert within > 50


def test_index_prunes():
    """On the given vectors, spread evenly in 64 dimensions, at most a fifth of the rows is fetched."""
    import pandas as pd

    t = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").sort_values("vec_id")
    x, ids = np.array(t["embedding"].tolist(), dtype=np.float64), t["vec_id"].to_numpy()
    codes = mih.fit(x)
    shard = mih.Shard(ids, x, codes)
    at = range(0, len(x), 20)
    code = codes.encode(x[list(at)])
    shares = [len(shard.fetched(c, codes.ball)) / len(x) for c in code]
    found = 0
    for i, c in zip(at, code):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        found += len(set(ids[np.lexsort((ids, d))[:10]]) & set(shard.nearest(ids[i], x[i], c, codes, 10)[0]))
    assert np.mean(shares) <= 0.2 and found / (10 * len(code)) >= 0.9


def test_repeated_candidates_take_one_place(spark):
    rng = random.Random(6)
    near = lambda: [1.0 + rng.gauss(0, 0.05), *(rng.gauss(0, 0.05) for _ in range(15))]
    rows = [(100, [1.0] + [0.0] * 15, 1)] + [(1, [1.0] + [0.01] * 15, 1)] * 12 + [(i, near(), 1) for i in range(2, 26)]
    v = _vectors(spark, rows)
    for shard_rows in (65_536, 10):
        got = rows_of(mih.search(v, v.where("vec_id = 100"), shard_rows=shard_rows), "rank", "vec_id")
        dist = {i: math.sqrt(sum((np.float64(np.float32(a)) - np.float64(np.float32(b))) ** 2 for a, b in zip(x, rows[0][1]))) for i, x, _ in rows[1:]}
        assert sorted(got) == [(r, i) for r, i in enumerate(sorted(dist, key=lambda i: (dist[i], i))[:10], 1)]
    twice = _vectors(spark, [(100, [1.0, 0.0], 1), (7, [0.9, 0.0], 1), (7, [0.5, 0.0], 1), (100, [0.0, 1.0], 2)])
    assert rows_of(mih.search(twice, twice.where("vec_id = 100")), "query_id", "rank", "vec_id") == [(100, 1, 7), (100, 2, 7)]


def test_stage_catches_near_copies(spark):
    rng = random.Random(11)
    sets = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    passage = " ".join(f"p{i}" for i in range(30))
    texts = []
    for d in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(" ".join(words))
        for changes in (1, 2, 3, 5, 8, 12):
            copy = list(words)
            for at in rng.sample(range(len(copy)), changes):
                copy[at] = f"new{rng.randrange(9999)}"
            texts.append(" ".join(copy))
        texts.append(" ".join(words[:80]) + " " + passage)
    rng.shuffle(texts)
    s = Sets()
    planted = 0
    grams = [sets(t) for t in texts]
    for i, a in enumerate(grams):
        s.find(i)
        for j, b in enumerate(grams[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                s.join(i, j)
                planted += len(a & b) <= 0.95 * len(a | b)
    assert planted > 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.simhash_stage(spark, docs, SF).collect())
    assert kept == [i for i in range(len(texts)) if s.find(i) == i]


def test_short_lines_are_deduplicated(spark, tmp_path):
    short, near, long = "All rights reserved.", "All rights reserved!", "A line of more than forty characters, which only one text holds."
    docs = spark.createDataFrame([(1, f"{long} 1\n{short}\n}}\n\n"), (2, f"{short}\n{long} and a different end\n}}"), (3, f"{near}\nDone\n  {short}\t"), (4, "Done\n}\nx")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["kept"]) for r in linededup.op5(spark, str(tmp_path)).collect()}
    first = {(1, 0): True, (1, 1): True, (1, 2): True, (2, 1): True, (3, 0): True, (3, 1): True, (4, 2): True}
    assert got == {at: (*at, True) for at in first} | {(2, 0): (1, 1, False), (3, 2): (1, 1, False), (2, 2): (1, 2, False), (4, 0): (3, 1, False), (4, 1): (1, 2, False)}
    left = {r["doc_id"]: r["text"] for r in linededup.line_stage(spark, docs, SF).collect()}
    assert left == {1: f"{long} 1\n{short}\n}}\n\n", 2: f"{long} and a different end\n}}", 3: f"{near}\nDone", 4: "}\nx"}


def test_kept_and_unique_lines_always_stay(spark):
    """Two documents that share twenty lines differing in a number, one of them with a line of its own besides."""
    lines = [f"This template line stands in either document, under number {i:02d}." for i in range(20)]
    one, two = "\n".join(lines), "\n".join([*lines[::-1], "And this line stands here alone, at the end of one document."])
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.line_stage(spark, docs, SF).collect()} == {1: lines[0], 2: "And this line stands here alone, at the end of one document."}
    long = "\n".join([lines[0]] * 50 + ["unique words " * 40])
    docs = spark.createDataFrame([(1, lines[0]), (2, long)], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.line_stage(spark, docs, SF).collect()} == {1: lines[0], 2: "unique words " * 40}


def test_features_against_plain_hashes():
    """Equal segments have equal keys, wherever they stand; sketches count groups of characters."""
    rng = random.Random(9)
    lines = ["".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(40, 90))) for _ in range(300)]
    sketch, keys = linededup.features(lines, 2)
    meaning = {}
    for line, own in zip(lines, keys.tolist()):
        for (_, i, indexed, at, size), key in zip(linededup.probes(len(line), 2), own):
            assert meaning.setdefault(key, (i, indexed, line[at : at + size])) == (i, indexed, line[at : at + size])
    assert len(set(meaning.values())) == len(meaning)
    again, same = linededup.features(lines[::-1], 2)
    assert (again[::-1] == sketch).all() and (same[::-1] == keys).all()
    for line, s in zip(lines[:50], sketch.tolist()):
        counts = [0] * 16
        for c in line:
            counts[(ord(c) * 2654435761 & 0xFFFFFFFF) >> 28] += 1
        assert s % (1 << 64) == sum((c & 15) << (4 * g) for g, c in enumerate(counts))


def test_own_paragraphs_stay(spark):
    shared, own = "This long passage stands in more than one document, word for word. " * 8, "Its own few words."
    docs = spark.createDataFrame([(1, shared), (2, f"{shared}\n{own}"), (3, f"\n{shared}\n\t\n")], "doc_id long, text string")
    stage = dict(__import__("corpus_pipeline").STAGES)["line_dedup"]
    assert {r["doc_id"]: r["text"] for r in stage(spark, docs, SF).collect()} == {1: shared, 2: own}
