"""Secret scan, quality, language, tokens, mixing and toxicity: brute force, exactness, held-out accuracy, awkward rows."""

import hashlib
import math
import random
import re
import zlib
from itertools import product

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import langid, mixing, quality, secrets, tokencount, toxicity
from readloom.llm.common import table
from tests.llm.helpers import LONG, SF, SF2, SF3, messy, rows_of

tokenizers = pytest.importorskip("public_tokenizers")


def plain_spans(text):
    out = []
    for k, (name, pattern, ok) in enumerate(
        [
            ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 12),
            ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
            ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
        ]
    ):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in pattern.finditer(text or "") if ok(m)]
    return [x for _, _, x in sorted(out)]


def test_secrets_against_plain_scan(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF2, "documents").collect()}
    for r in secrets.op1(spark, SF2).collect():
        base = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == base
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")]


def test_secret_edges():
    for t in ("secret: token: aaaaaaaaaaaa", "PASSWORD='abcdefghijkl", "ſecret=abcdefghijklm", "tOKen = x AKIAAKIA" + "A" * 10, "é" * 3 + "deadbeefdeadbeef", "apikey=abc api_key:\"" + "z" * 12, "AKIA" + "B" * 13, "token=token=abcdefghijkl"):
        assert [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in secrets.base_spans(t)] == plain_spans(t), t


def test_randomness_battery(spark):
    rng = random.Random(2)
    alphabet = secrets.ALPHABETS[5]
    keys = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(300)]
    ps = [secrets.randomness(k, 5) for k in keys]
    assert 0.4 < np.mean(ps) < 0.6 and np.mean(np.array(ps) < 0.1) < 0.17  # uniform for random tokens
    assert secrets.randomness("ab1" * 14, secrets.encoding("ab1" * 14)) < 0.01
    assert secrets.encoding("abcdefabcdefabcdefabcdef") is None and secrets.encoding("1" * 30) is None
    docs = [(i, f"note {k} end") for i, k in enumerate(keys)] + [(1000 + i, "path chapter1" + "section2" * 4 + f"verse{i}") for i in range(100)]
    got = {r["doc_id"]: [s["kind"] for s in r["found"]] for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum("random" in got[i] for i in range(300)) > 270
    assert sum("random" in got[1000 + i] for i in range(100)) < 5


def plain_threshold(per, rate):
    """Smallest bin from 1 on whose tail holds at most the wanted share of structured tokens; the random ones are twice the
    upper half, evenly spread, and no more than all."""
    n = len(per)
    random_ones = min(sum(per), 2 * (sum(per[n // 2 :]) + 0.5))
    for at in range(1, n):
        reported = sum(per[at:])
        if not reported or max(0.0, reported - random_ones * (n - at) / n) <= rate * reported:
            return at
    return n


def test_thresholds_against_plain_version():
    rng = random.Random(5)
    for _ in range(40):
        counts = {}
        for cls in rng.sample(range(48), 6):
            structured, random_ones = rng.randrange(0, 400), rng.randrange(0, 400)
            for _ in range(random_ones):
                k = (cls, rng.randrange(secrets.BINS))
                counts[k] = counts.get(k, 0) + 1
            for _ in range(structured):
                k = (cls, min(secrets.BINS - 1, int(rng.expovariate(0.4))))
                counts[k] = counts.get(k, 0) + 1
        got = secrets.thresholds(counts, 0.05)
        assert got == [plain_threshold([counts.get((cls, b), 0) for b in range(secrets.BINS)], 0.05) for cls in range(48)]


def plain_candidates(text, base):
    """Tokens that overlap no base span, each compared with all of them."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        if all(m.end() <= s or e <= m.start() for s, _, e in base) and secrets.encoding(m[0]) is not None:
            out.append((m.start(), m.end()))
    return out


def test_candidates_against_plain_version():
    rng = random.Random(6)
    part = lambda: rng.choice(["token=abcdefghijklmnop ", "deadbeef" * 3, "a1B2" * 6, " x ", "AKIA" + "Z9" * 10, "password: hunter2hunter2hunter2", "q7" * 12 + ",", "secret=" + "f0" * 12])
    for _ in range(200):
        text = "".join(part() for _ in range(rng.randrange(0, 12)))
        base = secrets.base_spans(text)
        assert [(c["start"], c["end"]) for c in secrets.candidates(text, base)] == plain_candidates(text, base)


def test_secret_awkward_rows(spark):
    got = secrets.find_secrets(messy(spark))
    assert got.count() == 10 and got.where("doc_id = 8").select(F.size("base")).first()[0] == 1
    assert secrets.find_secrets(messy(spark).limit(0)).count() == 0


def test_quality_against_labels(spark):
    labels = table(spark, SF2, "labels").withColumnRenamed("quality", "gold")
    pdf = quality.op3(spark, SF2).join(labels, "doc_id").toPandas()
    assert pdf[pdf.gold == 1].keep.mean() > 0.95 and pdf[pdf.gold == 0].keep.mean() < 0.05


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    junk = rng.random(20_000) < 0.2
    counts = {}
    for j in junk:
        p = "".join("-" if rng.random() < 0.3 else ("j" if (rng.random() < (0.8 if j else 0.05)) else "f") for _ in range(8))
        counts[p] = counts.get(p, 0) + 1
    post = quality.em(counts)
    n = sum(counts.values())
    assert abs(sum(c * post[p] for p, c in counts.items()) / n - 0.2) < 0.03
    assert post["jjjjjjjj"] > 0.99 and post["ffffffff"] < 0.01
    assert quality.em({}) == {}


def plain_statistics(text):
    """The eight statistics, each by its definition."""
    words, chars = (text or "").split(), list(text or "")
    if not words:
        return dict.fromkeys(quality.STATS)
    solid = [c for c in chars if not c.isspace()]
    letters = [c for c in chars if c.isalpha()]
    odd = lambda c: not (c.isalnum() or c.isspace() or c in ".,;:'\"-()?’“”«»¿¡–—…")
    out = dict.fromkeys(quality.STATS)
    out["symbols"] = sum(map(odd, chars)) / len(chars)
    out["letters"] = 1 - len(letters) / len(solid)
    if len(letters) >= 10:
        out["upper"] = sum(c.isupper() for c in letters) / len(letters)
    out["ends"] = sum(odd(w[-1]) for w in words) / len(words)
    if len(words) < 8:
        return out
    usual = min(0.75, 0.06 * len(words) ** 0.33)
    out["distinct"] = max(0.0, (1 - len(set(words)) / len(words) - usual) / (1 - usual))
    out["top"] = max(words.count(w) for w in set(words)) / len(words)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    out["lines"] = 1 - len(set(grams)) / len(grams)
    raw = text.encode()
    if len(raw) >= 300:
        out["packed"] = 1 - len(zlib.compress(raw, 1)) / len(raw)
    return out


def plain_votes(stats):
    cuts = quality.CUTS
    return "".join("." if x is None else "j" if x >= cuts[k][1] else "f" if x <= cuts[k][0] else "-" for k, x in stats.items())


def plain_em(patterns, rounds=50, strength=0.02):
    """Expectation-maximisation with loops and dictionaries."""
    total = sum(patterns.values())
    weight = max(1.0, strength * total)
    post = {p: min(0.98, max(0.02, p.count("j") - 0.25 * p.count("f") / len(p))) for p in patterns}
    prior = ({"j": 0.45, "f": 0.25, "-": 0.3}, {"j": 0.02, "f": 0.78, "-": 0.2})
    for _ in range(rounds):
        junk = (sum(n * post[p] for p, n in patterns.items()) + 0.1 * weight) / (total + weight)
        tables = []
        for j in range(len(next(iter(patterns)))):
            seen = ({m: weight * v for m, v in prior[0].items()}, {m: weight * v for m, v in prior[1].items()})
            for p, n in patterns.items():
                if p[j] != ".":
                    seen[0][p[j]] += n * post[p]
                    seen[1][p[j]] += n * (1 - post[p])
            tables.append(tuple({m: v / sum(t.values()) for m, v in t.items()} for t in seen))
        for p in patterns:
            odds = math.log(junk / (1 - junk)) + sum(math.log(tables[j][0][m] / tables[j][1][m]) for j, m in enumerate(p) if m != ".")
            post[p] = 1 / (1 + math.exp(-max(-30, min(30, odds))))
    return post


def plain_hashed(text, stats):
    """Square roots of the frequencies of hashed 4-grams of character classes, and one bin for each statistic."""
    kind = lambda b: 0 if b in b"\t\n\v\f\r " else 2 if 65 <= b <= 90 else 1 if 97 <= b <= 122 or b > 127 else 4 if 48 <= b <= 57 else 5 if b in b".,;:'\"-()?" else 6 if b == 33 else 7 if b == 124 else 3
    c, half = [kind(b) for b in (text or "").encode()], quality.BUCKETS // 2
    out = {}
    for i in range(len(c) - 3):
        g = c[i] * 512 + c[i + 1] * 64 + c[i + 2] * 8 + c[i + 3]
        at = (g * 0x9E3779B1 >> 7) % half
        out[at] = out.get(at, 0) + 1
    out = {at: math.sqrt(n / (len(c) - 3)) for at, n in out.items()}
    for name, x in stats.items():
        if x is not None:
            out[half + zlib.crc32(f"{name}={int(min(x, 1.0) * 20)}".encode()) % half] = 0.5
    return out


def plain_fit(rows, labels, rounds=200, l2=1e-4):
    """The same accelerated steps over sparse rows, in double precision."""
    step = 4.0 / (max(sum(v * v for v in r.values()) for r in rows) + 1 + l2)
    size = quality.BUCKETS + 1
    w = z = np.zeros(size)
    for k in range(rounds):
        grad = np.zeros(size)
        for r, y in zip(rows, labels):
            at, v = np.array(list(r) + [size - 1]), np.array([*r.values(), 1.0])
            off = 1 / (1 + math.exp(-max(-30, min(30, float(v @ z[at]))))) - y
            grad[at] += off * v
        nxt = z - step * (grad / len(rows) + l2 * z)
        z, w = nxt + k / (k + 3) * (nxt - w), nxt
    return w


def plain_scores(docs):
    """Quality of every document (doc_id to text) by the plain parts; all of them fit the scorer."""
    stats = {i: plain_statistics(t) for i, t in docs.items()}
    patterns = {}
    for i, t in docs.items():
        if t is not None:
            patterns[plain_votes(stats[i])] = patterns.get(plain_votes(stats[i]), 0) + 1
    post = plain_em(patterns)
    vectors = {i: plain_hashed(t, stats[i]) for i, t in docs.items()}
    first = {t: i for i, t in reversed(docs.items()) if t is not None}  # each text once
    w = plain_fit([vectors[i] for i in first.values()], [post[plain_votes(stats[i])] for i in first.values()])
    junk = lambda v: 1 / (1 + math.exp(-max(-30, min(30, sum(x * w[at] for at, x in v.items()) + w[-1]))))
    return {i: 1 - junk(vectors[i]) if t and t.strip() else 0.0 for i, t in docs.items()}


def plain_quality(docs):
    return {i: docs[i] for i, q in plain_scores(docs).items() if q >= 0.5}


def test_quality_against_plain_version(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    want = plain_scores(docs)
    got = {r["doc_id"]: (r["quality"], r["keep"]) for r in quality.op3(spark, SF).collect()}
    assert got.keys() == want.keys()
    assert all(abs(q - want[i]) < 1e-3 and (k == (want[i] >= 0.5) or abs(want[i] - 0.5) < 1e-3) for i, (q, k) in got.items())
    assert 0 < sum(k for _, k in got.values()) < len(got)


def test_em_and_votes_against_plain_version():
    rng = random.Random(4)
    counts = {}
    for _ in range(2000):
        p = "".join(rng.choices("jf-.", (1, 6, 2, 1))[0] for _ in range(8)) if rng.random() < 0.8 else "".join(rng.choices("jf-.", (6, 1, 2, 1))[0] for _ in range(8))
        counts[p] = counts.get(p, 0) + 1
    a, b = quality.em(counts), plain_em(counts)
    assert all(abs(a[p] - b[p]) < 1e-9 for p in counts)
    for t in ("", "a b", "One two three four five six seven eight nine ten. " * 9, "!!! ### $$$ x 1 2 3 4 5 6", "É" * 20 + " é"):
        plain = plain_statistics(t)
        got = quality.statistics(t)
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-12) for x, y in zip(got, plain.values()))
        assert quality.votes(got) == plain_votes(plain)
        v = quality.hashed(t, got)
        assert np.allclose(v, [plain_hashed(t, plain).get(i, 0.0) for i in range(quality.BUCKETS)])


def test_quality_awkward_rows(spark):
    d = messy(spark)
    got = {(r["doc_id"], r["_rl_keep"]) for r in quality.classify(d).collect()}
    assert {(2, False), (3, False), (4, False)} <= got and quality.classify(d).count() == 10
    stage = quality.quality_stage(spark, d, SF)
    assert stage.columns == d.columns and 2 not in {r["doc_id"] for r in stage.collect()}
    assert quality.classify(d.limit(0)).count() == 0


def test_forward_against_all_segmentations():
    vocab = langid.vocabulary(str(tokenizers.path("piece_bpe_32k.model")))
    import pandas as pd

    counts = pd.DataFrame([("en", "thing", 5), ("fr", "école", 4), ("en", "the", 9)], columns=["lang", "word", "n"])
    m = langid.train(counts, {"en": 14, "fr": 4}, vocab, rounds=2)
    words = ["thing", "él", "ownß", "аб", "x"]
    for k in range(2):
        p = dict(zip(vocab, m.probs[1:, k]))
        for w, got in zip(words, m.word_scores(words)[:, k]):
            s, total = langid.START + w, 0.0
            for cuts in product((0, 1), repeat=len(s) - 1):
                parts, at = [], 0
                for i, c in enumerate(cuts, 1):
                    if c:
                        parts.append(s[at:i])
                        at = i
                parts.append(s[at:])
                total += math.prod(p.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) or (langid.UNKNOWN if len(x) == 1 else 0.0) for x in parts)
            assert math.isclose(got, math.log(max(total, 1e-300)), rel_tol=1e-9)


def test_language_held_out(spark):
    got = langid.op4(spark, SF2).join(table(spark, SF2, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    assert got[got.held_out].eval("lang == lang_pred").mean() > 0.98
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out))
    assert got.score.between(0, 1).all()


def test_long_words_and_letters():
    """Long runs are summed like short ones; what is alphanumeric but neither digit nor letter is no letter."""
    import pandas as pd

    vocab = langid.vocabulary(str(tokenizers.path("piece_bpe_32k.model")))
    m = langid.train(pd.DataFrame([("en", "thing", 5), ("fr", "école", 4)], columns=["lang", "word", "n"]), {"en": 5, "fr": 4}, vocab, rounds=2)
    rng = random.Random(3)
    for n in (1, 7, 40, 300):
        w = "".join(rng.choice("aeinotrsßж") for _ in range(n))
        (part, points), = langid.blocks([langid.START + w])
        assert np.allclose(langid.forward(points, m.pieces, m.probs)[0], langid.forward_long(langid.START + w, m.pieces, m.probs), rtol=1e-9)
    assert langid.letter_runs("½ ² Ⅷ 12_") == [] and langid.letter_runs("aⅧb c²") == ["a", "b", "c"]
    assert m.predict(["½ ² Ⅷ", "thing " + "x" * 400])[0][0] == "und"


def plain_expected(word, weight, p):
    """Expected piece counts of one word, by all its segmentations."""
    ways = []
    for cuts in product((0, 1), repeat=len(word) - 1):
        parts, at = [], 0
        for i, c in enumerate((*cuts, 1), 1):
            if c:
                parts.append(word[at:i])
                at = i
        ways.append((parts, math.prod(p.get(x, langid.UNKNOWN if len(x) == 1 else 0.0) for x in parts)))
    total = sum(v for _, v in ways)
    out = {}
    for parts, v in ways:
        for x in parts:
            if x in p:
                out[x] = out.get(x, 0.0) + weight * v / total
    return out


def test_expected_counts_against_all_segmentations():
    vocab = langid.vocabulary(str(tokenizers.path("piece_bpe_32k.model")))
    pieces = langid.Pieces(vocab)
    rng = np.random.default_rng(2)
    probs = rng.random((pieces.n, 2)) / pieces.n
    probs[0] = 0.0
    words, weight = [langid.START + w for w in ("nation", "école", "xжx")], np.array([[2.0, 1.0], [0.0, 3.0], [1.0, 1.0]])
    got = np.zeros_like(probs)
    for part, points in langid.blocks(words):
        got += langid.expected(points, weight[part], pieces, probs)
    for k in range(2):
        p, want = dict(zip(vocab, probs[1:, k])), {}
        for w, n in zip(words, weight[:, k]):
            for x, v in plain_expected(w, n, p).items():
                want[x] = want.get(x, 0.0) + v
        assert all(math.isclose(got[pieces.number[x], k], v, rel_tol=1e-9, abs_tol=1e-12) for x, v in want.items())
        assert math.isclose(got[:, k].sum(), sum(want.values()), rel_tol=1e-9)


def test_language_awkward_rows(spark):
    path = str(tokenizers.path("piece_bpe_32k.model"))
    d = messy(spark)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(d, d, path).collect()}
    assert got[2] == got[3] == got[4] == "und" and got[5] == "en"
    assert langid.identify(d.limit(0), d, path).count() == 0
    assert {r["lang_pred"] for r in langid.identify(d, d.limit(0), path).collect()} == {"und"}


def test_tokens_are_the_library_counts(spark):
    path = str(tokenizers.path("word_bpe_49k.json"))
    tok = tokencount._tokenizer(path)
    odd = ["a<|endoftext|>b <|startoftext|>", "\x1c\x1d a\x85b\xa0c", "é ́x", "Σας ΣΣ", "it's 123 don't　x", "İ", "\U0001f600" * 5 + "\r\n\tq", "", "  \n "]
    texts = odd + [r["text"] for r in table(spark, SF, "documents").collect()]
    want = [len(tok.encode(t, add_special_tokens=False)) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunk, overlap in ((1 << 16, 512), (200, 16), (40, 2)):
        got = dict(rows_of(tokencount.token_counts(docs, path, chunk=chunk, overlap=overlap), "doc_id", "n_tokens"))
        assert [got[i] for i in range(len(texts))] == want
    rng = random.Random(1)
    draw = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    for solid in ("ab1" * 500, "a" * 3000, draw("abcdefghijklmnop", 20_000), draw([chr(c) for c in range(0x4E00, 0x9FA5)], 20_000), draw("eaoú̈ ", 9000), draw("ab 's't.,\n\t1é́ΣςİK😀", 9000)):
        want = len(tok.encode(solid, add_special_tokens=False))  # texts without spaces are spliced inside their words
        assert [tokencount.count_long(tok, solid, chunk, overlap) for chunk, overlap in ((1000, 64), (300, 4))] == [want, want]


def test_token_awkward_rows(spark):
    got = tokencount.token_counts(messy(spark), str(tokenizers.path("word_bpe_49k.json")))
    by = {r["doc_id"]: r for r in got.collect()}
    assert got.count() == 10 and by[2]["n_tokens"] == by[3]["n_bytes"] == 0 and by[5]["over_limit"] and by[5]["n_bytes"] == len(LONG)
    assert tokencount.token_counts(messy(spark).limit(0), str(tokenizers.path("word_bpe_49k.json"))).count() == 0


def test_mixing_against_sql_and_targets(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF2}/documents.parquet'")
    want = con.execute(f"select doc_id, copy_no from ({mixing.OP8_SQL})").fetchall()
    assert sorted(rows_of(mixing.op8(spark, SF2), "doc_id", "copy_no")) == sorted(want)
    d = spark.range(40_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, "none").otherwise("hot").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.replicate(d, {"rare": 0.5, "hot": 0.5}).groupBy("source").count().collect()}
    assert set(n) == {"rare", "hot"} and all(abs(v - 20_000) < 900 for v in n.values())


def test_mixing_large_means_and_awkward_rows(spark):
    d = spark.range(2_001).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").otherwise("many").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.replicate(d, {"one": 0.5, "many": 0.5}).groupBy("source").count().collect()}
    assert abs(n["one"] - 1000) < 150
    m = messy(spark)
    got = mixing.replicate(m)
    assert got.columns == [*(c for c in m.columns if c != "copy_no"), "copy_no"]
    copies = [r["copy_no"] for r in got.where("doc_id = 1").collect()]
    assert all(copies.count(c) == 2 for c in set(copies))
    assert mixing.replicate(m.limit(0)).count() == 0


def test_many_copies_of_one_row(spark):
    """Beyond one block, and at the borders of blocks of blocks."""
    import unittest.mock

    for n in (1, 3, 4, 5, 15, 16, 17, 63, 64, 65, 200):
        with unittest.mock.patch.object(mixing, "BLOCK", 4):
            got = mixing._numbers(spark.createDataFrame([(n,)], "n long"), "n", "k").select("k").collect()
        assert sorted(r["k"] for r in got) == list(range(n))
    d = spark.range(1_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, "one").otherwise("many").alias("source"))
    n = {r["source"]: r["count"] for r in mixing.replicate(d, {"one": 0.999, "many": 0.001}).groupBy("source").count().collect()}
    assert 900 < n["one"] < 1100 and n.get("many", 0) < 12


def test_toxicity_held_out(spark):
    got = toxicity.op9(spark, SF3).join(table(spark, SF3, "labels"), "doc_id").toPandas()  # large enough for some dozen held-out toxic rows
    held = got[got.held_out]
    assert held[held.toxic == 1].predicted.mean() >= 0.9 and held[held.toxic == 0].predicted.mean() < 0.05
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_isotonic_and_boosting():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = (x[:, 0] * x[:, 1] > 0.3).astype(float)
    start, trees = toxicity.boost(x, y)
    raw = start + sum(t.predict(x) for t in trees)
    assert ((raw > 0) == (y == 1)).mean() > 0.95
    knots, p = toxicity.isotonic(raw, y)
    assert (np.diff(p) >= 0).all() and (np.diff(knots) >= 0).all()
    a, b = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert np.interp([1, 2, 3, 4], a, b).tolist() == [0, 0.5, 0.5, 1]


def plain_features(text, words, stems):
    """The dense features, each by its definition."""
    if not text:
        return [0.0] * toxicity.FEATURES
    low = re.findall(r"\w+", text.lower())
    n = max(1, len(low))
    hit = [i for i, w in enumerate(low) if w in words]
    spots = toxicity.mixed_words(text)
    hidden = sum(toxicity.plain(x) in words and not set(re.findall(r"\w+", x.lower())) & words for x in spots)
    long = re.compile(r"([^\W\d_])\1{2,}")
    hidden += sum(bool(long.search(w)) and w not in words and long.sub(r"\1", w) in words for w in low)
    you = [i for i, w in enumerate(low) if w in toxicity.SECOND]
    near = sum(any(abs(i - j) <= 5 for j in you) for i in hit)
    stem = sum(any(w[:k] in stems for k in (4, 5, 6, 7)) for w in low)
    log = math.log1p
    caps = sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in text)
    return [
        stem / n, log(stem), (len(hit) + hidden) / n, log(len(hit) + hidden), log(hidden), hidden / n, near / n, log(near), len(you) / n,
        caps / len(text), len(re.findall(r"\b[A-ZÀ-Þ]{3,}\b", text)) / n, text.count("!") / n, sum(not (c.isalnum() or c == "_" or c.isspace()) for c in text) / len(text),
        (len(spots) + len(long.findall(text))) / n,
    ]


def test_features_against_plain_version(spark):
    words, stems = frozenset({"idiot", "the", "stupid"}), frozenset({"stup", "hous", "idioti"})
    known = toxicity.Lexicon(words, stems, frozenset(w[:4] for w in stems))
    texts = [None, "", "You idi0t! you st.u.p1d THE house-thing", "stuuuupid IDIOTS ÀÉÎ 4you @you", "a1b2 " * 40, "x" * 300 + "1" + "y" * 300]
    texts += [r["text"] for r in table(spark, SF, "documents").collect()]
    assert all(np.allclose(toxicity.features(t, known), plain_features(t, words, stems)) for t in texts)
    assert toxicity.mixed_words("ab " + "x" * 50 + "1" + "y" * 50 + " c") == ["x" * 50 + "1" + "y" * 50]


def plain_tree(x, g, h, edges, depth):
    """A tree as nested tuples, by trying all cuts; a leaf is a number."""
    best, lam = (1e-9, None, None), 1.0
    score = lambda rows: sum(g[i] for i in rows) ** 2 / (sum(h[i] for i in rows) + lam)
    rows = range(len(x))
    if depth and len(x):
        for f, cuts in enumerate(edges):
            for c in cuts:
                a, b = [i for i in rows if x[i][f] <= c], [i for i in rows if x[i][f] > c]
                if sum(h[i] for i in a) >= 0.5 and sum(h[i] for i in b) >= 0.5:
                    gain = score(a) + score(b) - score(rows)
                    if gain > best[0] + 1e-12:
                        best = (gain, f, c)
    if best[1] is None:
        return -sum(g) / (sum(h) + lam)
    _, f, c = best
    part = lambda keep: [[v[i] for i in rows if keep(x[i][f])] for v in (x, g, h)]
    return f, c, plain_tree(*part(lambda v: v <= c), edges, depth - 1), plain_tree(*part(lambda v: v > c), edges, depth - 1)


def test_boosting_against_plain_version():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((60, 2)), 2)
    y = (x[:, 0] + 0.3 * rng.random(60) > 0.7).astype(float)
    start, trees = toxicity.boost(x, y, trees=3, depth=2, bins=6)
    cuts = []
    for c in x.T:
        above = c[c > c.min()]
        cuts.append(sorted({(c.min() + above.min()) / 2, *np.unique(np.quantile(above, np.linspace(0, 1, 6)))[:-1]}))
    total = np.full(60, math.log(y.mean() / (1 - y.mean())))
    assert math.isclose(start, total[0])
    down = lambda t, row: t if isinstance(t, float) else down(t[2] if row[t[0]] <= t[1] else t[3], row)
    for tree in trees:
        p = 1 / (1 + np.exp(-total))
        plain = plain_tree(x.tolist(), (p - y).tolist(), np.maximum(p * (1 - p), 1e-6).tolist(), cuts, 2)
        step = np.array([0.3 * down(plain, row) for row in x.tolist()])
        assert np.allclose(tree.predict(x), step)
        total += step


def test_toxicity_awkward_rows(spark):
    d = messy(spark)
    labels = spark.createDataFrame([(1, 0), (6, 1), (6, None), (None, 1), (5, 0)], "doc_id long, toxic int").withColumn("text", F.lit("clash"))
    got = toxicity.score_toxicity(d, labels)
    assert got.count() == 10 and got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score_toxicity(d.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(d, labels.limit(0)).collect()} == {0.0}
