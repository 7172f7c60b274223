import math
import random
import re
from collections import defaultdict

import edge
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import jaccard as op
from corvane.llm import text as tx
from corvane.llm.components import components


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def brute(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    owners = defaultdict(list)
    for i, own in enumerate(sets):
        for s in own:
            owners[s].append(i)
    for i, own in enumerate(sets):
        for j in {j for s in own for j in owners[s] if j < i}:
            both = len(own & sets[j])
            if 100 * both >= 85 * (len(own) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def near_copies(seed, groups=6, copies=30, n=80):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        body = [f"g{g}w{rng.randrange(400)}" for _ in range(n + 10 * g)]
        for _ in range(copies):
            own = list(body)
            for _ in range(rng.randrange(6)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
            out.append(" ".join(own))
            if rng.random() < 0.5:
                body[rng.randrange(len(body))] = f"d{rng.randrange(10_000)}"
    passage = " ".join(f"p{i}" for i in range(60))
    out += [f"{passage} " + " ".join(f"u{i}x{j}" for j in range(rng.randrange(1, 40))) for i in range(60)]
    out += [out[i] for i in range(0, len(out), 3)] + ["one", "one", "one two three", "ONE two three", "", None]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("long", "frequent", "pivots"), [(64, 32, 2), (4, 3, 1), (2, 2, 1), (1000, 1000, 2)])
def test_against_all_pairs(spark, monkeypatch, long, frequent, pivots):
    for name, value in (("LONG", long), ("FREQUENT", frequent), ("PIVOTS", pivots), ("BLOCK", 16 if long < 64 else 1024), ("CHUNK_TOKENS", 3000)):
        monkeypatch.setattr(op, name, value)
    texts = near_copies(long)
    assert result(op.join(edge.frame(spark, texts))) == brute(texts)


def test_few_pairs_and_many_pairs_alike(spark, monkeypatch):
    texts = near_copies(5, groups=2)
    monkeypatch.setattr(op, "FEW_PAIRS", 0)
    assert result(op.join(edge.frame(spark, texts))) == brute(texts)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_linked_sets_share_a_signature(data):
    """Whatever the classes of tokens: similar sets meet in a signature."""
    size = data.draw(st.integers(6, 120))
    rng = random.Random(data.draw(st.integers(0, 10**6)))
    a = set(range(size))
    b = set(a)
    while True:
        c = set(b)
        c.discard(rng.randrange(size)) if rng.random() < 0.5 else c.add(rng.randrange(10_000, 20_000))
        if 100 * len(a & c) < 85 * len(a | c):
            break
        b = c
        if rng.random() < 0.05:
            break
    values = {t: rng.getrandbits(63) for t in a | b}
    count = {t: (1 if (t not in a or t not in b) and rng.random() < 0.5 else rng.choice([2, 5, 31, 32, 90, 128])) for t in a | b}

    def made(own):
        shared = sorted((count[t], values[t]) for t in own if count[t] > 1)
        alone = len(own) - len(shared)
        if alone > op.spare(len(own)):
            return None
        return set(op.signatures(len(own), alone, np.array([v for _, v in shared], np.uint64), np.array([c for c, _ in shared], np.uint8)).tolist())

    x, y = made(a), made(b)
    assert x is not None and y is not None and (x & y or a == b)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    up = {v: v for e in edges for v in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    lonely = {v for v in up if root(v) == v and v not in got}
    assert got == {v: root(v) for v in up if v not in lonely}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_edges(spark):
    rows = op.join(edge.documents(spark)).collect()
    assert len(rows) == len(edge.rows())
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (1, 3)
    assert got[4] == got[5] == got[7] == (22, 4) and got[6][1] == 4
    assert sorted(r["n_shingles"] for r in rows if r["doc_id"] is None) == [0, 22]
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert op.join(edge.none(spark)).count() == 0


def test_one_document_of_each_group_stays(spark):
    docs = edge.documents(spark)
    kept = op.representatives(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=lambda i: (i is None, i or 0))
    assert ids == [0, 1, 2, 3, 4, 8, 9, 10, 11, None, None]


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(5, a), (5, b), (2, b), (9, a), (7, "other words here today")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in op.join(docs).collect()} == {(5, 2), (2, 2), (9, 2), (7, 7)}


@pytest.mark.parametrize("text", ["one", "one two", "one two three", "one two three four"])
def test_a_short_text_alone_in_its_slice(spark, text):
    long = "many other words stand here " * 50_000
    assert result(op.join(edge.frame(spark, [text]).coalesce(1))) == {0: (1, 0)}
    # behind a text of over 1 MB a short one gets a slice of its own
    assert result(op.join(edge.frame(spark, [long, text, text]).coalesce(1))) == brute([long, text, text])
    none = spark.createDataFrame([(None, text), (1, long)], "doc_id long, text string").repartition(2, "doc_id")
    assert {(r["doc_id"], r["n_shingles"]) for r in op.join(none).collect()} == {(None, 1), (1, 5)}


def test_words_that_cancel_in_a_polynomial_are_told_apart(spark):
    signs = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = ("".join("ab"[s ^ flip] for s in signs) for flip in (0, 1))
    texts = [f"{one} x y z", f"{two} x y z", f"{one} {two}", f"{two} {one}", f"{one} x y z"]
    got = edge.by_id(op.join(edge.frame(spark, texts)))
    assert [got[k]["component_id"] for k in range(5)] == [0, 1, 2, 3, 0]
    data, offsets = tx.raw(pa.array([f"{one} {two}", "ab ba aab aba baa " + "a" * 64 + " " + "a" * 65 + " " + "a" * 128]))
    starts, ends, _ = tx.words(data, offsets)
    assert len(set(tx.word_hashes(data, starts, ends).tolist())) == len(starts) == 10


def small_exchange(monkeypatch, one_level):
    for name, value in (("ONE_LEVEL", one_level), ("RANGE_TOKENS", 60), ("CHUNK_TOKENS", 400), ("CAP", 5)):
        monkeypatch.setattr(op, name, value)


@pytest.fixture
def short_batches(spark):
    """A chunk for every few rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    spark.conf.set(name, "8")
    yield
    spark.conf.set(name, was)


def exchange_docs(spark, n):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    common = " ".join(words[:12])
    bases = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) + (f" {common}" if i % 3 == 0 else "") for i in range(n // 3 + 1)]
    texts = [bases[i // 3] + [" tail", "", " x y"][i % 3] for i in range(n)]
    return edge.frame(spark, texts).repartition(3, "doc_id").select("doc_id", "text").cache()


def test_two_levels_give_what_one_gives(spark, monkeypatch, short_batches):
    docs = exchange_docs(spark, 150)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    small_exchange(monkeypatch, 1 << 30)
    one = edge.collected(op.exchanged(docs, size).groupBy("chunk").applyInArrow(op._sets, op._SETS))
    joined = edge.collected(op.join(docs))
    small_exchange(monkeypatch, 2)
    two = edge.collected(op.exchanged(docs, size).groupBy("chunk").applyInArrow(op._sets, op._SETS))
    assert one == two and sum(r[4] is not None for r in one) > 20
    assert edge.collected(op.join(docs)) == joined


def test_blobs_grow_with_the_input_and_not_its_square(spark, monkeypatch, short_batches):
    made = {}
    for n in (100, 1600):
        docs = exchange_docs(spark, n)
        size = docs.selectExpr("sum(octet_length(text))").first()[0]
        small_exchange(monkeypatch, 2)
        buckets = int(size / 4 // op.RANGE_TOKENS)
        fan = math.isqrt(buckets - 1) + 1
        width = op._HASHES // fan**2 + 1
        groups = max(1, int(size / 4 // op.CHUNK_TOKENS // fan))
        wide = op.tokens(docs, fan, fan * width).withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(groups))).cache()
        narrow = wide.groupBy("bucket", "part").applyInArrow(op._narrowed(fan, width), op._WIDE)
        chunks = wide.select("chunk").distinct().count()
        made[n] = wide.where("kind = 0").count(), narrow.where("kind = 0").count(), chunks * buckets, size
    growth = made[1600][3] / made[100][3]
    assert made[1600][2] > 0.8 * growth**2 * made[100][2] / 2  # chunks times ranges, as in one level
    for level in (0, 1):
        assert made[1600][level] < 1.3 * growth**1.5 * made[100][level]
        assert made[1600][level] < made[1600][2] / 2


def test_chunks_rows_are_dealt_over_all_ranges():
    for buckets in (8, 64, 96, 100):
        homes = {op._home(task << 32 | n, buckets) for task in range(buckets) for n in range(2)}
        assert homes == set(range(buckets))


def test_equal_sets_of_several_chunks_are_indexed_once(spark):
    texts = [" ".join(f"w{k * k % 97}x{j}" for k in range(30)) for j in range(3)]
    docs = spark.createDataFrame([(i, texts[i % 3]) for i in range(60)], "doc_id long, text string").repartition(6)
    every = op.exchanged(docs, 1).groupBy("chunk").applyInArrow(op._sets, op._SETS).cache()
    sets = every.where("tokens is not null").withColumnRenamed("doc_id", "doc")
    least = every.groupBy("mark").agg(F.min("doc_id").alias("class_id"))
    rows = every.join(least, "mark").select("doc_id", "class_id", op._same().alias("same"))
    assert sets.count() > 3
    made = op._index(sets, op._standing(rows))
    assert {r["doc"] for r in made.select("doc").distinct().collect()} == {0, 1, 2}
    assert {r["component_id"] for r in op.join(docs).collect()} == {0, 1, 2}


def test_copies_of_a_text_dont_enter_the_exchange(spark, monkeypatch):
    taken, whole = [], op.exchanged

    def exchanged(*args):
        out = whole(*args)
        taken.extend(int(i) for r in out.where("kind = 1").collect() for i in np.frombuffer(bytes(r["tokens"]), np.int64))
        return out

    monkeypatch.setattr(op, "exchanged", exchanged)
    texts = near_copies(3, groups=2, copies=5)
    own = len(texts)
    texts = [t for _ in range(5) for t in texts] + ["", " \t\n", None, "\x0b", "one", "ONE", "one"]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = result(op.join(spark.createDataFrame(rows, "doc_id long, text string")))
    want = brute(texts)
    assert got == want
    least = len({t for t in texts if (t or "").strip()}) + 4  # each text once, and the four without words
    assert least <= len(taken) < least + 20 < 4 * own and len(set(taken)) == len(taken)
    # of rows that share a doc_id none is passed over
    taken.clear()
    one = 5 * own + 4
    both = [*rows, (0, "one"), (one + 1, texts[3])]
    made = op.join(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert len(made) == len(both) and sorted(taken).count(0) == 2 and taken.count(one + 1) == 2
    of = {i: {r["component_id"] for r in made if r["doc_id"] == i} for i in range(len(texts))}
    assert all(len(c) == 1 for c in of.values()) and of[0] == of[own] == of[one] == of[one + 2] and of[one + 1] == of[3]
    assert sorted(r["n_shingles"] for r in made if r["doc_id"] == 0) == [1, want[0][0]]
