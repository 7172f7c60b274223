import re
import zlib
from collections import Counter

import edge
import numpy as np
from pyspark.sql import functions as F

from corvane.llm import rules, shard

SF = "/root/testdata/sf0.01"


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    seen = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = {j for i in range(n - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    for r in rules.base(docs).collect():
        assert tuple(r[n] for n in NAMES) == base(texts[r["doc_id"]])


def covariance(rows):
    m = rows.mean(0)
    return m, (rows - m).T @ (rows - m) / len(rows) + np.diag(np.square(rules.FLOORS))


def distances(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def independent_mcd(x, starts=200, seed=0):
    """The covariance of least determinant over exact subsets, from many random small subsets; no grid, no medians."""
    rng, h, best = np.random.default_rng(seed), int(np.ceil(rules.SHARE * len(x))), None
    for _ in range(starts):
        m, c = covariance(x[rng.choice(len(x), x.shape[1] + 1, replace=False)])
        was = np.inf
        for _ in range(100):
            m, c = covariance(x[np.argsort(distances(x, m, c), kind="stable")[:h]])
            now = np.linalg.slogdet(c)[1]
            if was - now < 1e-9:
                break
            was = now
        if best is None or now < best[0]:
            best = now, m, c
    return best


def vectors(rows):
    return np.array([[np.log(r["n_words"]), np.log((r["word_chars"] + 1) / r["n_words"]), np.log1p(100 * r["n_symbols"] / r["n_words"]), np.sqrt(r["n_repeat_words"] / r["n_words"]), np.log1p(r["n_dup_lines"])] for r in rows])


def test_verdicts_against_an_independent_mcd(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("source", F.lit("all"))
    langs = dict(docs.select("doc_id", "lang").collect())
    own = [r for r in rules.apply(docs).collect() if langs[r["doc_id"]] == "en" and not r["base_failed"]]
    assert len(own) >= rules.LEAST_ROWS and {r["level"] for r in own} == {2}
    x = vectors(own)
    _, m, c = independent_mcd(x)
    d2 = distances(x, m, c)
    scale = max(1.0, np.sort(d2)[int(np.ceil(rules.SHARE * len(x))) - 1] / rules.QUARTILE)
    want = distances(x, *covariance(x[d2 <= rules.INNER * scale]))
    got = np.array([r["distance"] for r in own])
    assert np.mean((want <= rules.CUTOFF) == [r["kept"] for r in own]) > 0.99
    assert np.median(np.abs(want - got) / (want + 1)) < 0.05


def test_determinant_is_as_small_as_an_independent_search_finds(spark):
    rng = np.random.default_rng(2)
    mix = rng.normal(size=(5, 5))
    for share, shift in ((0.2, 9), (0.24, 4)):
        x = rng.normal(size=(600, 5)) @ mix
        far = int(share * len(x))
        x[:far] = rng.normal(size=(far, 5)) * 0.3 + shift * mix[0]
        rows = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{c} double" for c in rules.STATISTICS))
        got = {r["start"]: r["det"] for r in rules.concentrated(rows).collect()}
        least, m, c = independent_mcd(x, 100)
        assert sorted(got) == [0, 1, 2] and abs(min(got.values()) - least) < 0.06
        est = rules.estimates(rows.withColumn("base_failed", F.lit(False))).first()
        centre = np.array([est[f"m{i}"] for i in range(5)])
        inverse = np.array([[est[f"w{i}{j}"] if j <= i else 0.0 for j in range(5)] for i in range(5)])
        d = ((x - centre) @ inverse.T) ** 2
        if shift == 9:
            assert d.sum(1)[:far].min() > d.sum(1)[far:].mean() * 3


def test_small_groups_use_wider_estimates(spark):
    rows = [(i, " ".join(f"w{(i * 7 + k) % 97}{k}" for k in range(25 + i % 20)), lang, source) for i, (lang, source) in enumerate([("en", "a")] * 210 + [("en", "b")] * 5 + [("de", None)] * 3 + [(None, "a")] * 2)]
    got = rules.apply(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).orderBy("doc_id").collect()
    assert [r["level"] for r in got] == [2] * 210 + [1] * 5 + [0] * 5 and all(r["kept"] for r in got)


def test_clean_documents_stay_and_junk_goes(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    marked = rules.apply(docs).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    shares = dict(map(tuple, marked))
    assert shares[1] > 0.99 and shares[0] < 0.1


def test_rules_edges(spark):
    docs = edge.documents(spark)
    got = edge.by_id(rules.apply(docs))
    assert rules.apply(docs).count() == len(edge.rows()) and rules.apply(edge.none(spark)).count() == 0
    texts = {r[0]: r[1] for r in edge.rows()}
    assert all(tuple(got[k][n] for n in NAMES) == base(texts[k]) for k in got)
    assert not any(r["kept"] for r in got.values() if r["base_failed"])


def shards(df):
    return df.orderBy("shard", "slot").collect()


def whole(rows, n):
    assert {r["law"] for r in rows} == {"bytes"} and all(r["grown_shard"] is None for r in rows)
    for s in range(n):
        assert [r["slot"] for r in rows if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))


def test_shards_are_near_equal_and_gapless(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    rows = shards(shard.assign(docs))
    whole(rows, shard.SHARDS)
    assert len(rows) == len(texts) and all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    load = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], shard.SHARDS)
    assert np.abs(load / load.mean() - 1).max() < 2 * shard.TOLERANCE + max(r["size"] for r in rows) / load.mean()
    homes = {}
    for r in rows:
        homes.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= shard.SHARDS


def test_a_hot_text_is_split(spark):
    docs = edge.frame(spark, ["same text"] * 3000 + [f"text {i}" for i in range(1000)])
    rows = shards(shard.assign(docs, 8))
    whole(rows, 8)
    load = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 8)
    assert load.max() / load.mean() < 1.02 and len(rows) == 4000


def test_order_does_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert edge.collected(shard.assign(docs)) == edge.collected(shard.assign(docs.repartition(7)))


def test_shard_edges(spark):
    docs = edge.documents(spark)
    rows = shards(shard.assign(docs))
    whole(rows, shard.SHARDS)
    assert len(rows) == len(edge.rows()) and all(r["size"] == 1 and r["text_crc32"] == 0 for r in rows if r["doc_id"] in (0, 1))
    assert shard.assign(edge.none(spark)).count() == 0


def test_whole_rows_reach_the_shards(spark, tmp_path):
    docs = edge.documents(spark)
    found = shard.write(docs, str(tmp_path / "shards"), 4)
    got = found.collect()
    assert sorted((tuple(r["row"]) for r in got), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert found.select("row.*").columns == docs.columns
    digest = sorted((r["shard"], r["slot"], r["doc_id"], r["size"], r["text_crc32"]) for r in shard.assign(docs, 4).collect() if r["doc_id"] is not None)
    assert digest == sorted((r["shard"], r["slot"], r["row"]["doc_id"], len((r["row"]["text"] or "").encode()) + 1, zlib.crc32((r["row"]["text"] or "").encode())) for r in got if r["row"]["doc_id"] is not None)
    folders = {int(p.name.removeprefix("shard=")) for p in (tmp_path / "shards").iterdir() if p.is_dir()}
    assert folders == {r["shard"] for r in got}


def test_long_texts_make_small_buckets(spark, monkeypatch):
    monkeypatch.setattr(shard, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(shard, "LEAST_BUCKETS", 2)
    docs = edge.frame(spark, ["same long text " * 100] * 300 + [f"text {i} " * 300 for i in range(200)])
    keys = shard.keyed(docs).cache()
    assert shard._histogram(keys, shard.plan(keys, 2).bounds)[:, 0].max() <= 40_000
    whole(shards(shard.assign(docs, 2)), 2)


def brute_load(docs, n):
    """Bytes of each shard when the ordered rows are cut where the bytes below come nearest to the targets."""
    sizes = [len((t or "").encode()) + 1 for t in docs]
    return sum(sizes) / n, max(sizes)


def test_many_identical_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(shard, "BUCKET_ROWS", 100)
    texts = ["the same row again"] * 4000 + [f"text number {i}" for i in range(2000)]
    docs = spark.createDataFrame([(7 if i < 4000 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, slot string").repartition(5)
    own = shard.plan(shard.keyed(docs).cache(), 8)
    assert own.parts.max() >= 8
    rows = shards(shard.assign(docs, 8))
    whole(rows, 8)
    ideal, widest = brute_load(texts, 8)
    load = np.bincount([r["shard"] for r in rows], [r["size"] for r in rows], 8)
    assert np.abs(load - ideal).max() < 0.15 * ideal + widest and len(rows) == 6000
    assert sorted((r["doc_id"], r["text_crc32"]) for r in rows) == sorted((7 if i < 4000 else i, zlib.crc32(t.encode())) for i, t in enumerate(texts))


def test_splitters_against_brute_force(spark):
    """Every splitter comes as near to its target as the tolerance and one row allow, over rows sorted in one place."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    order = sorted((r["h"], r["doc_id"], r["size"]) for r in shard.keyed(docs).collect())
    below = np.cumsum([0, *(x[2] for x in order)])
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard.assign(docs).collect()}
    assert [got[x[1]] for x in order] == sorted(got.values())  # the shards follow the order
    for k in range(1, shard.SHARDS):
        cut = below[sum(got[x[1]][0] < k for x in order)]
        target = below[-1] * k / shard.SHARDS
        assert abs(cut - target) <= shard.TOLERANCE * below[-1] / shard.SHARDS + max(x[2] for x in order)


def test_the_number_of_buckets_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(shard, "BUCKET_ROWS", 1)
    monkeypatch.setattr(shard, "LEAST_BUCKETS", 4)
    monkeypatch.setattr(shard, "MOST_BUCKETS", 40)
    keys = shard.keyed(edge.frame(spark, [f"text {i}" for i in range(3000)])).cache()
    assert len(shard.plan(keys, 2).first) < 40 + 4 * shard.PROBES
