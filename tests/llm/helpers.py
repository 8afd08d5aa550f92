"""Small tables with every awkward row."""

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"
SF3 = "/root/testdata/sf0.1"
LONG = "lorem ipsum dolor sit amet consectetur " * 4000
CLASH = ["id", "fp", "entry", "component", "root", "key", "w", "h", "pos", "word", "score", "mean", "shard", "block", "label", "pattern", "spans", "rows", "n", "rank", "copy_no", "_rl_u", "_rl_n", "_rl_key", "_rl_base", "_rl_source", "_rl_cdf", "_rl_id", "_rl_hash", "_rl_text", "_rl_drop", "_rl_score", "_rl_quality", "_rl_weak", "_rl_keep", "_rl__u", "lead", "node", "text_hash", "keys"]


def messy(spark, extra=True):
    """Null, empty, blank and very long texts, ties, repeated rows, a null id, clashing columns."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 10),
        (1, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "a", 10),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (4, " \n\t ", "fr", "a", 3),
        (5, LONG, "en", "b", len(LONG)),
        (6, "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf today.", "en", "b", 10),
        (None, "Zwei Zeilen ohne Nummer und ohne Sinn, aber lang genug für den Vergleich.", "de", "b", 5),
        (8, "élan vital \U0001f600 İstanbul ſ K  token: abcdefghijklmnop\n\n" + "x" * 50, "fr", "c", 7),
        (9, "a", "es", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        for c in CLASH:
            df = df.withColumn(c, F.lit("clash"))
    return df


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
