import hashlib
import itertools

import edge
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import pieces as op

library = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def both():
    path = public.path(op.MODEL)
    return op.Pieces.load(path), library.SentencePieceProcessor(model_file=path)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("abeinst \n▁<0x>é", max_size=120))
def test_encoding_equals_the_library(both, text):
    own, other = both
    ids = own.encode(text)
    assert ids == list(other.encode(text))
    assert own.decode(ids).decode() == other.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 700) | st.integers(3, 31_999), max_size=20))
def test_decoding_any_ids_equals_the_library(both, ids):
    own, other = both
    assert own.decode(ids).decode() == other.decode(ids)


@pytest.mark.parametrize("ids", [[197, 1, 131], [1, 197, 131], [2, 1], [1, 300, 1, 197], [197, 131, 1, 300]])
def test_control_ids_end_a_run_of_bytes(both, ids):
    own, other = both
    assert own.decode(ids).decode() == other.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("abeinst \n▁<0x>é語", max_size=120))
def test_digests_by_segment_equal_the_library(both, text):
    own, other = both
    for _ in range(2):  # the second time all segments are kept
        ids = list(other.encode(text))
        assert own.digested(text) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(other.decode(ids).encode()).hexdigest())


def test_undoing_merges_tells_what_merging_does(both):
    own = both[0]
    own.encode("a")
    assert all(set(p) == {op.BLANK} for p in own._unordered)
    pieces = sorted(own._reached - own._unordered)
    assert all(half in own._reached for p in pieces if len(p) > 1 for half in own._halves[p])
    near = [(p[:i], p[i:]) for p in pieces[::7] for i in range(1, len(p)) if {p[:i], p[i:]} <= own._reached - own._unordered]
    for left, right in [*zip(pieces[::5], reversed(pieces[::5])), *zip(pieces[::9], pieces[::9]), *near]:
        assert own._stay(left, right) == (own.merged(left + right) == [left, right])


@pytest.mark.parametrize("vocabulary", [{"a": 0, "b": 0, "ab": -1, "ba": -1, "aba": -2}, {"a": 0, "b": 0, "ab": -5, "aba": -1, "bab": -6}])
def test_equal_and_unordered_scores_are_merged_as_they_are(vocabulary):
    own = op.Pieces([(p, float(s), op.NORMAL) for p, s in vocabulary.items()])
    own._prepare()
    for n in range(1, 9):
        for text in map("".join, itertools.product("ab", repeat=n)):
            assert own.segment(text) == tuple(own.ids[p] for p in own.merged(text))


def test_backtracking_without_cuts_gives_the_same(both):
    own, other = both
    text = "Some words  with   gaps " * 30
    own.encode("")
    cuts, own._cuts = own._cuts, False
    try:
        assert own.encode(text) == list(other.encode(text))
    finally:
        own._cuts = cuts


def test_whole_table(spark, sf_dir, both):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in op.digest(docs).collect():
        ids = both[1].encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()


def test_edges(spark, both):
    got = edge.by_id(op.digest(edge.documents(spark)))
    nothing = hashlib.sha256(b"").hexdigest()
    for k in (0, 1):
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (0, nothing, nothing)
    assert got[9]["n_tokens"] == len(both[1].encode("x" * 300_000))
    assert op.digest(edge.documents(spark)).count() == len(edge.rows()) and op.digest(edge.none(spark)).count() == 0
    assert {r["doc_id"]: len(r["ids"]) for r in op.encode(edge.documents(spark)).collect()}[4] == got[4]["n_tokens"]
