from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import similarity as sim
from corvane.functions.text import tokens


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@given(st.text("abcde ", max_size=40), st.text("abcde ", max_size=40))
def test_subsequence_equals_the_table(a, b):
    assert sim.subsequence(a, b) == common(a, b)


def plain_sort(a, b):
    return sim.indel(" ".join(sorted(a.split())), " ".join(sorted(b.split()))) if a and b else 0.0


def plain_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = (" ".join(sorted(v)) for v in (x & y, x - y, y - x))
    if both and (not one or not two):
        return 1.0
    texts = [f"{both} {one}".strip(), f"{both} {two}".strip()]
    return max([sim.indel(*texts), *[sim.indel(both, t) for t in texts if both]])


def test_token_ratios(spark):
    rows = [("b a", "a b"), ("", "a"), ("abcd", "abxd"), ("a b c", "b a"), ("", ""), ("x", "y"), ("fuzzy was bear", "fuzzy wuzzy"), ("a a b", "b c"), ("é à", "à ü"), ("one two three", "two four")]
    df = spark.createDataFrame(rows, "a string, b string")
    words = lambda c: tokens(F.col(c))
    got = df.select(
        "a",
        "b",
        sim.token_sort_ratio(*[F.array_join(F.array_sort(words(c)), " ") for c in "ab"]).alias("s"),
        sim.token_set_ratio(*[F.array_sort(F.array_distinct(words(c))) for c in "ab"]).alias("t"),
    ).collect()
    assert [(r["s"], r["t"]) for r in got] == [(plain_sort(r["a"], r["b"]), plain_set(r["a"], r["b"])) for r in got]
    assert [r["t"] for r in got[:4]] == [1.0, 0.0, 0.75, 1.0]
