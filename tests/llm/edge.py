"""Tables that every operator must handle: nulls, empty and long texts, repeats, clashing extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, n_words string, bucket int, label string, rank int"

BASE = "the quick brown fox jumps over the lazy dog while seven wizards juggle bright lamps under a pale winter moon and nobody minds at all"


def rows():
    texts = [
        None,
        "",
        " \n\t ",
        "a",
        BASE,
        BASE,
        BASE + " twice",
        BASE.replace(" ", "  ").upper(),
        "Ünïcödé ★ 日本語 " * 40,
        "x" * 300_000,
        "long words again and again " * 8_000,
        "!!! ??? ...",
    ]
    out = [(i, t, ["en", None, "de", "fr"][i % 4], [None, "s0", "s1"][i % 3], None if t is None else len(t), 0.5, "x", "y", 1, "z", 2) for i, t in enumerate(texts)]
    return [*out, out[4], (None, BASE, "en", "s0", 1, 0.1, "x", "y", 1, "z", 2), (None, None, None, None, None, None, None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    made = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(12)] + [(3, None, None), (None, 1, 1), (4, 0, 1), (4, 1, 0), (5, 7, 7)]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int")


def frame(spark, texts, lang=None):
    return spark.createDataFrame([(i, t, (lang or {}).get(i)) for i, t in enumerate(texts)], "doc_id long, text string, lang string")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def by_id(df):
    return {r["doc_id"]: r for r in df.where(F.col("doc_id").isNotNull()).collect()}
