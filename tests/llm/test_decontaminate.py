import hashlib
import re
import time

import edge
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import decontaminate as op


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, window):
    w, hit, found = words(text), set(), set()
    for name, item in items:
        own = words(item)
        n = min(window, len(own))
        for i in range(len(own) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == own[i : i + n]:
                    hit |= set(range(j, j + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


def test_against_brute_force(spark, sf_dir):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(str(r[0]), r[1]) for r in bench.collect()]
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["item_ids"]) for r in op.report(docs, bench).collect()}
    texts = dict(docs.select("doc_id", "text").collect())
    grams = {tuple(words(t)[i : i + 10]) for _, t in items for i in range(max(1, len(words(t)) - 9))}
    for k, (n, n_hit, names) in got.items():
        w = words(texts[k])
        assert n == len(w)
        if any(tuple(w[i : i + 10]) in grams for i in range(len(w))):
            assert (n, n_hit, names) == brute(texts[k], items, 10)
        else:
            assert n_hit == 0
    assert any(v[1] for v in got.values())


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=24), max_size=5), st.text("ab ", max_size=60), st.integers(1, 5))
def test_automaton(items, text, window):
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = op.Automaton([(k, t.encode()) for k, t in named], window)
    spans, found = automaton.match(op.words(text.encode()))
    n, n_hit, names = brute(text, named, window)
    covered = set()
    for a, b in spans:
        covered |= set(range(a, b))
    assert len(covered) == n_hit == sum(b - a for a, b in spans)
    assert sorted(automaton.names[i] for i in found) == names


def test_several_automata_equal_one(spark, sf_dir, monkeypatch):
    docs, bench = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = edge.collected(op.report(docs, bench))
    split = op.automata
    monkeypatch.setattr(op, "automata", lambda b, w: split(b, w, 100))
    assert edge.collected(op.report(docs, bench)) == whole
    cleaned = edge.collected(op.remove(docs, bench))
    monkeypatch.undo()
    assert edge.collected(op.remove(docs, bench)) == cleaned


def test_repetitive_items_take_linear_time():
    took = []
    for n in (25_000, 100_000):
        began = time.perf_counter()
        automaton = op.Automaton([("1", b"a " * n), ("2", b"a a a")])
        spans, found = automaton.match([b"a"] * n)
        took.append(time.perf_counter() - began)
        assert spans == [(0, n)] and len(found) == 2
    assert took[1] < 10 * took[0]


def test_halves_that_a_cut_joins_are_cut_too(spark):
    item = [f"i{k}" for k in range(10)]
    clean = [f"c{k}" for k in range(60)]
    nested = " ".join([*clean, *item[:5], *item[:3], *item, *item[3:], *item[5:], *clean])
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    left = op.remove(edge.frame(spark, [nested]), bench)
    assert left.first()["text"].split() == clean * 2
    assert not op.report(left, bench).first()["contaminated"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ", max_size=16), min_size=1, max_size=4), st.text("ab ", max_size=80))
def test_nothing_is_left_to_cut(items, text):
    automaton = op.Automaton([(str(i), t.encode()) for i, t in enumerate(items)], 3)
    data = text.encode()
    while spans := automaton.match(op.words(data))[0]:
        less = op.cleaned(data, spans)
        assert len(op.words(less)) == len(op.words(data)) - sum(b - a for a, b in spans)
        data = less
    assert brute(data.decode(), [(str(i), t) for i, t in enumerate(items)], 3)[1] == 0


def test_several_texts_of_one_item_count_once(spark):
    bench = spark.createDataFrame([(1, "red green"), (1, "blue white"), (2, "blue white")], "item_id long, text string")
    got = op.report(edge.frame(spark, ["red green blue white", "blue red"]), bench).orderBy("doc_id").collect()
    assert [(r["n_hit"], r["n_items"], r["item_ids"]) for r in got] == [(4, 2, ["1", "2"]), (0, 0, [])]


def test_spans_are_cut_and_mostly_hit_documents_go(spark):
    item = " ".join(f"w{i}" for i in range(12))
    clean = " ".join(f"c{i}" for i in range(40))
    docs = edge.frame(spark, [f"{clean}. W0, {item[3:]}! Tail {clean}", item, clean, None, ""])
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (7, item)], "item_id long, text string")
    got = edge.by_id(op.remove(docs, bench))
    assert set(got) == {0, 2, 3, 4}
    assert got[0]["text"] == f"{clean}. ! Tail {clean}" and got[2]["text"] == clean and got[3]["text"] is None
    assert not any(r["contaminated"] for r in op.report(op.remove(docs, bench), bench).collect())


def test_edges(spark):
    bench = spark.createDataFrame([(1, edge.BASE), (2, "a"), (None, "x"), (3, " ")], "item_id long, text string")
    got = edge.by_id(op.report(edge.documents(spark), bench))
    nothing = hashlib.sha256(b"").hexdigest()
    assert (got[0]["n_words"], got[0]["items_sha256"], got[0]["contaminated"]) == (0, nothing, False)
    assert got[3]["item_ids"] == ["2"] and got[4]["n_hit"] == 25 and got[7]["item_ids"] == ["1", "2"]
    assert op.report(edge.documents(spark), bench).count() == len(edge.rows())
    assert op.report(edge.none(spark), bench).count() == 0
    assert op.report(edge.documents(spark), bench.limit(0)).where("contaminated").count() == 0
    assert op.remove(edge.documents(spark), bench).columns == edge.documents(spark).columns
