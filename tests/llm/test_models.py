"""Learned operators: held-out accuracy, decoding against plain formulas, edge cases."""

import re
import textwrap
import zlib

import edge
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import language, licences, pseudolik, quality, toxicity
from corvane.llm import text as tx

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    y = np.array(y)
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


# --- quality ---------------------------------------------------------------


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    truth = dict(labels.select("doc_id", "quality").collect())
    rows = quality.scores(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [(r["score"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert auc(*map(np.array, zip(*held, strict=True))) > 0.95
    assert np.mean([s >= 0.7 for s, y in held if y == 1]) > 0.97


def test_quality_learns_nothing_from_held_out_labels(tables):
    docs, labels = tables
    flipped = labels.withColumn("quality", (1 - labels["quality"]).cast("int")).where(quality.held_out()).unionByName(labels.where(~quality.held_out()))
    assert edge.collected(quality.scores(docs, labels)) == edge.collected(quality.scores(docs, flipped))


def plain_features(text):
    """Words (a repeated one as a mark), their pairs and runs of 3 and 4 characters, as texts."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    words = [None if i and w == words[i - 1] else w for i, w in enumerate(words)]
    runs = [("run", text[i : i + n]) for n in (3, 4) for i in range(len(text) - n + 1)]
    return [*words, *zip(words, words[1:], strict=False), *runs, "end"]


def test_features_are_words_pairs_and_characters():
    texts = ["one two two two öne", "two two", "", "ab", "日本語 日本語", "one two"]
    values, bounds = quality.features(*tx.raw(pa.array(texts)))
    plain = [plain_features(t)[:-1] for t in texts]
    for own, want in zip([values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], plain, strict=True):
        assert len(own) == len(want)
    seen = lambda k: set(values[bounds[k] : bounds[k + 1]].tolist())
    assert len(seen(0)) == len(set(plain[0])) and len(seen(1)) == len(set(plain[1]))
    assert len(seen(0) & seen(1)) == len(set(plain[0]) & set(plain[1])) and seen(5) - seen(0) == set()


def test_scores_are_the_softmax_of_the_average():
    texts, y = ["good words here", "### $$$ %%%", "more good words", "$$$ ###"] * 6, np.array([1, 0, 1, 0] * 6)
    vectors, output = quality.learned(texts, y, 2, 0.2, 7)
    weights = quality.train(texts, y.tolist(), 2, 0.2, 7)
    data, offsets = tx.raw(pa.array(["good ###", "", "words"]))
    values, bounds = quality.features(data, offsets)
    for a, b, got in zip(bounds, bounds[1:], quality.score(weights, data, offsets), strict=False):
        average = vectors[[*values[a:b], quality._END]].astype(float).mean(0)
        z = np.exp(output @ average)
        assert abs(z[1] / z.sum() - got) < 1e-5


def test_quality_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    own, output, part = rng.normal(size=(6, 8)), rng.normal(size=(2, 8)), np.array([0.1, 0.2, 0.3, 0.1, 0.1, 0.2])

    def loss(a, b):
        z = np.exp(b @ (part @ a))
        return -np.log(z[1] / z.sum())

    for k, got in enumerate(quality.slopes(own, output, part, 1)):
        for r, c in [(0, 0), (1, 3), (len(got) - 1, 7)]:
            step = np.zeros(got.shape)
            step[r, c] = 1e-5
            pair = [(own + s * step, output) if k == 0 else (own, output + s * step) for s in (1, -1)]
            assert abs((loss(*pair[0]) - loss(*pair[1])) / 2e-5 - got[r, c]) < 1e-6


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, "b", "en")] * 50 + [(1, "a", "en"), (2, "x" * (quality.MAX_TEXT + 1), "en"), (3, None, "de")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    got = sorted(tuple(r) for r in quality.labelled(docs, labels, "quality").select("doc_id", "label", "text").collect())
    assert got == [(1, 1, "a"), (3, 0, "")]
    assert quality.labelled(docs, labels, "quality", max_rows=1).count() <= 1
    assert language.learn(docs).langs in (["en"], [])


def test_quality_does_not_depend_on_batches():
    texts = ["one two three", "", "ünïcödé words", "a", "one two three"]
    weights = quality.train(["good", "bad"] * 5, [1, 0] * 5)
    whole = quality.score(weights, *tx.raw(pa.array(texts)))
    single = [quality.score(weights, *tx.raw(pa.array([t])))[0] for t in texts]
    assert whole.tolist() == single


def test_quality_edges(spark):
    docs, labels = edge.documents(spark), edge.labels(spark)
    rows = quality.scores(docs, labels).collect()
    assert len(rows) == len(edge.rows()) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.scores(edge.none(spark), labels).count() == 0
    assert {r["score"] for r in quality.scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.accepted(docs, labels.limit(0), cutoff=0.6).count() == 0
    kept = quality.accepted(docs, labels.limit(0), cutoff=0.4)
    assert kept.columns == docs.columns and kept.count() == len(edge.rows())


# --- toxicity --------------------------------------------------------------


def test_toxicity_on_unseen_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = dict(labels.where("doc_id % 4 = 1").select("doc_id", "toxic").collect())
    got = [(r["toxic"], truth[r["doc_id"]]) for r in toxicity.scores(docs, labels.where("doc_id % 4 <> 1")).collect() if r["doc_id"] in truth]
    assert np.mean([bool(p) for p, y in got if y]) > 0.9 and np.mean([bool(p) for p, y in got if not y]) < 0.01


def toxic_sample(seed=4):
    """Two kinds of toxic texts in two languages, told by their own words, among clean ones."""
    rng = np.random.default_rng(seed)
    plain = [f"wort{i}" for i in range(60)]
    own = [["vilest", "grubby", "moldy"], ["schuftig", "widerlich", "fies"]]
    texts, toxic = [], []
    for k in range(240):
        kind = [0, 1, None, None][k % 4]
        picked = list(rng.choice(plain, 12)) + ([] if kind is None else list(rng.choice(own[kind], 2)))
        texts.append(" ".join(rng.permutation(picked)))
        toxic.append(int(kind is not None))
    return texts, toxic


def test_kinds_are_learned_from_the_rows():
    texts, toxic = toxic_sample()
    chain = toxicity.Chain(texts, toxic)
    a, b, c = (chain(toxicity.words(t)) for t in (b"a moldy grubby thing", b"ein fies widerlich ding", b"wort1 wort2 wort3"))
    assert a[-1] > 0.9 and b[-1] > 0.9 and c[-1] < 0.1
    assert np.argmax(a[:-1]) != np.argmax(b[:-1]) and max(c[:-1]) < 0.3


def plain_chain(chain, texts, toxic):
    """The chain in dense numpy: presence of the chosen words, full-batch Adam, earlier columns from models of the other folds."""
    x = np.array([[w in toxicity.words(t.encode()) for w in chain.ids] for t in texts], float)
    y = np.array(toxic, float)
    kind = np.full(len(y), -1)
    kind[y > 0] = toxicity.kinds([np.flatnonzero(r) for r in x[y > 0]], x.shape[1])

    def fit(a, t):
        share = (t.sum() + 1) / (len(t) + 2)
        w, b = np.zeros(a.shape[1]), float(np.log(share / (1 - share)))
        if t.min() == t.max():
            return w, b
        weight, b = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean())) / len(t), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for k in range(1, toxicity.ROUNDS + 1):
            slope = weight * (1 / (1 + np.exp(-np.clip(a @ w + b, -35, 35))) - t)
            g = np.append(a.T @ slope + 1e-6 * w, slope.sum())
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            step = toxicity.RATE * m / (1 - 0.9**k) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            w, b = w - step[:-1], b - step[-1]
        return w, b

    fold, models = np.arange(len(y)) % toxicity.FOLDS, []
    for k in range(toxicity.CATEGORIES + 1):
        t = (kind == k).astype(float) if k < toxicity.CATEGORIES else y
        models.append(fit(x, t))
        unseen = np.zeros(len(y))
        for f in range(toxicity.FOLDS):
            w, b = fit(x[fold != f], t[fold != f])
            unseen[fold == f] = 1 / (1 + np.exp(-(x[fold == f] @ w + b)))
        x = np.column_stack([x, unseen])
    return models


def test_chain_equals_a_plain_one():
    texts, toxic = toxic_sample(5)
    chain = toxicity.Chain(texts, toxic)
    for own, (w, b) in zip(chain.models, plain_chain(chain, texts, toxic), strict=True):
        assert np.allclose(own.w, w, atol=1e-5) and abs(own.b - b) < 1e-5
    found, p = toxicity.words(b"grubby schuftig wort3"), []
    at = [i for w, i in chain.ids.items() if w in found]
    for own in chain.models:
        p.append(1 / (1 + np.exp(-(own.w[at].sum() + np.dot(own.w[len(chain.ids) :], p) + own.b))))
    assert np.allclose(chain(found), p)


def test_toxicity_edges(spark):
    docs, labels = edge.documents(spark), edge.labels(spark)
    rows = toxicity.scores(docs, labels).collect()
    assert len(rows) == len(edge.rows()) and all(0 <= r["score"] <= 1 and r["toxic"] == (r["score"] >= 0.4) == bool(r["predicted"]) for r in rows)
    assert len({tuple(r)[1:] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1  # without words
    assert {(r["score"] < 1e-9, r["toxic"]) for r in toxicity.scores(docs, labels.limit(0)).collect()} == {(True, False)}
    assert toxicity.scores(edge.none(spark), labels).count() == 0
    kept = toxicity.accepted(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(edge.rows())


# --- language --------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = dict(docs.select("doc_id", "lang").collect())
    rows = language.predict(docs).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) > 0.95


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 30])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    distance = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(distance) >= (2 ** max(0, n - 2) if n <= 5 else 5) and set(np.unique(code)) == {-1.0, 1.0}


def plain_bits(model, texts, langs):
    """The bits' classifiers by the same descent in dense double precision, one bit at a time."""
    x = np.concatenate([language.features(*tx.raw(pa.array([t]))) for t in texts]).astype(float)
    y, out = [model.langs.index(v) for v in langs], []
    for bit in model.code.T:
        sign, w, b, speed_w, speed_b = bit[y], np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
        for _ in range(language.ROUNDS):
            slope = -sign / (1 + np.exp(sign * (x @ w + b))) / len(x)
            speed_w, speed_b = 0.9 * speed_w - 4.0 * (x.T @ slope + 1e-4 * w), 0.9 * speed_b - 4.0 * slope.sum()
            w, b = w + speed_w, b + speed_b
        out.append((w, b))
    return out


def test_bits_are_logistic_classifiers_of_the_codewords():
    texts, langs = ["ab ab ab", "xy xy xz", "qr qr qs", "ab ba", "xy zy"] * 4, ["a", "x", "q", "a", "x"] * 4
    model = language.Model(texts, langs)
    for k, (w, b) in enumerate(plain_bits(model, texts, langs)):
        assert np.allclose(model.w[:, k], w, atol=2e-3) and abs(model.b[k] - b) < 2e-3


def test_decoding_is_the_least_weighted_loss():
    model = language.Model(["ab ab ab", "xy xy xy", "qr qr qr"] * 5, ["a", "x", "q"] * 5)
    data, offsets = tx.raw(pa.array(["ab ab", "qr"]))
    margin = language.features(data, offsets) @ model.w + model.b
    loss = np.array([[(model.trust[k] * np.exp(-model.code[k] * m)).sum() for k in range(3)] for m in margin])
    assert model.predict(data, offsets)[0].tolist() == loss.argmin(1).tolist()


def test_language_edges(spark):
    docs = edge.documents(spark)
    got = edge.by_id(language.predict(docs))
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0.0 for k in (0, 1, 2, 11))
    assert language.predict(docs).count() == len(edge.rows()) and language.predict(edge.none(spark)).count() == 0
    one = edge.frame(spark, ["abc def", "1 2", "xyz"] * 4, {i: "xx" for i in range(12)})
    assert {r["lang_pred"] for r in language.predict(one).collect()} == {"xx", "und"}


# --- licences --------------------------------------------------------------


def plain_scan(text):
    """Families of one text, from the definition."""
    own, found = licences.model(), {}
    for block in re.split(r"\n(?:[ \t\x0b\f\r]*\n)+", text or ""):
        words = licences.tokens(block)
        runs = [words[i : i + size] for size, step in ((2 * licences.REACH, licences.REACH), (licences.REACH, licences.STEP)) for i in range(0, max(len(words) - (size - step), 1), step)]
        lines = [w for w in map(licences.tokens, block.split("\n")) if 0 < len(w) <= 2 * licences.REACH]
        for unit in lines + runs:
            p = own.probabilities(unit)
            family = own.classes[int(p.argmax())]
            if family != licences.UNKNOWN and p.max() >= licences.LEAST_PROBABILITY and any(t.confirms(set(licences.grams(unit))) for t in licences.TEMPLATES[family]):
                found[" ".join(unit)] = (family, p.max())
    return found


def test_scan_equals_the_plain_scan(spark):
    texts = ["Released under the MIT License.", "Hello\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License\n\nbye", "he lost his driving license", "Licensed under CC BY-NC 4.0. and more", "GNU General Public License v3 warranty", None, "", "no such words", "x " * 70 + "SPDX-License-Identifier: MIT " + "y " * 70, "Mozilla\nPublic\nLicense"]
    rows = edge.by_id(licences.scan(edge.frame(spark, texts)))
    for k, text in enumerate(texts):
        want, r = plain_scan(text), rows[k]
        assert r["families"] == ",".join(sorted({f for f, _ in want.values()}))
        assert r["n_licences"] == sum(p["confirmed"] for p in r["paragraphs"]) == r["n_candidates"] - r["n_unconfirmed"]
        for p in r["paragraphs"]:
            if p["confirmed"]:
                family, probability = want[p["paragraph"]]
                assert p["family"] == family and abs(p["probability"] - probability) < 1e-9
    assert [rows[k]["n_paragraphs"] for k in (0, 1, 5, 6)] == [1, 2, 0, 0] and rows[1]["families"] == "apache,mit" and rows[8]["families"] == "mit"


def test_licence_families_of_the_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = licences.scan(docs).select("doc_id", "families").collect()
    texts = dict(docs.select("doc_id", "text").collect())
    marks = {"mit": "MIT License", "apache": "Apache License", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC"}
    assert all(r["families"].split(",") == sorted(f for f, m in marks.items() if m in texts[r["doc_id"]]) or not r["families"] for r in found)
    assert all(r["families"] for r in found if any(m in texts[r["doc_id"]] for m in marks.values()))


#: Wordings that the model has not learned from.
UNSEEN = {
    "// SPDX-License-Identifier: BSD-2-Clause": "bsd",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */": "gpl",
    "# SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl",
    "SPDX-License-Identifier: Apache-2.0": "apache",
    "SPDX-License-Identifier: CC-BY-SA-4.0": "cc-by-sa",
    "MIT-Lizenz": "mit",
    "Dieses Programm steht unter der MIT-Lizenz.": "mit",
    "Distribué sous licence GPL, version 3": "gpl",
    "Publicado bajo licencia MIT": "mit",
    "This work is CC0.": "public-domain",
    "Eclipse Public License 2.0": "epl",
    "Mozilla Public License 2.0": "mpl",
    "Code is made available under the terms of the Mozilla Public License Version 2.0": "mpl",
    "Published under the GNU Lesser General Public License, version 3 or later": "lgpl",
    "Distributed under the MIT license, see LICENSE for the text.": "mit",
    "You may use this under the Apache License, Version 2.0 (the \"License\")": "apache",
    "The code is licensed under the BSD 3-Clause License": "bsd",
    "All content is available under a Creative Commons Attribution-ShareAlike 3.0 license": "cc-by-sa",
    "Copyright 2021 X. Licensed under the GNU Affero General Public License v3.0": "agpl",
    "Distributed under the Boost Software License, Version 1.0. See accompanying file": "boost",
    "This is released into the public domain by its author": "public-domain",
    "See the ISC license for details": "isc",
    "Use governed by a BSD-style license found in the LICENSE file of this project.": "bsd",
    "Eclipse Public License 2.0 applies to the accompanying materials": "epl",
}
NOT_THEIRS = [
    "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: EUPL-1.2", "please read the license before you use this software", "the warranty of the machine ended", "Copyright 2019 by the authors",
    "er fuhr mit der Lizenz nach Hause", "we met at the public library of the general", "This font is licensed under the SIL Open Font License, Version 1.1.", "released under the Microsoft Public License", "an Apache helicopter needs a license",
    "a business with a license to sell software to the public", "licensed under the Common Public Attribution License", "the Eclipse was seen by the general public", "your driving license, version 2.0, was issued by the state", "Permission to park here is granted by the city for a fee",
    "Licensed under CC BY-ND 4.0", "GNU Free Documentation License, Version 1.3", "Released under the Business Source License 1.1", "subject to the Oracle Master Agreement", "the mit entrance exam asks for no license",
]


def test_unseen_notices_and_calibration(spark):
    texts = [*UNSEEN, *NOT_THEIRS]
    rows = edge.by_id(licences.scan(edge.frame(spark, texts)))
    assert {t: rows[k]["families"] for k, t in enumerate(UNSEEN)} == UNSEEN
    assert [t for k, t in enumerate(NOT_THEIRS, len(UNSEEN)) if rows[k]["families"]] == []
    own = licences.model()
    p = np.array([own.probabilities(licences.tokens(t)) for t in texts])
    right = np.array([own.classes[int(row.argmax())] == UNSEEN.get(t, licences.UNKNOWN) for t, row in zip(texts, p, strict=True)])
    assert abs(p.max(1).mean() - right.mean()) < 0.15  # as sure as it is right
    assert ((p.max(1) - right) ** 2).mean() < 0.15


def test_wrapped_notices_are_found(spark):
    notices = {
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    }
    prose = "we tell of the house and the people that lived in it for many years\nand of the city with all its streets and the money of a day\n" * 9
    texts, want = [], []
    for family, notice in notices.items():
        for width in (16, 35, 66, 72, 300):
            wrapped = textwrap.fill(notice, width)
            for text in (wrapped, prose + wrapped + "\n" + prose, "# " + wrapped.replace("\n", "\r\n# "), "first\n \n" + wrapped + "\n\nlast"):
                texts.append(text)
                want.append(family)
    rows = edge.by_id(licences.scan(edge.frame(spark, texts)))
    assert [rows[i]["families"] for i in range(len(texts))] == want


def test_the_gate_passes_over_nothing_that_a_template_confirms():
    gate = set(licences.gate())
    for texts in licences.TEMPLATES.values():
        for t in texts:
            assert len(t.text.split()) <= licences.REACH
            assert gate & {w for k in t.keys for w in k.split()} and set(t.keys) <= set(licences.grams(t.text.split()))
            assert t.confirms(set(licences.grams(t.text.split())))


def test_the_scan_has_no_exchange_and_no_python(spark, capsys):
    licences.scan(edge.documents(spark)).explain("simple")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_what_no_template_confirms_is_judged_too(spark):
    texts = ["AGPL", "BSL 1.0", "the cat sat on the mat"]
    rows, own, told = edge.by_id(licences.scan(edge.frame(spark, texts))), licences.model(), []
    for k, text in enumerate(texts):
        p = own.probabilities(licences.tokens(text))
        told.append(own.classes[int(p.argmax())] != licences.UNKNOWN and p.max() >= licences.LEAST_PROBABILITY)
        assert (rows[k]["n_licences"], rows[k]["n_unconfirmed"], rows[k]["families"]) == (0, int(told[-1]), "")
    assert any(told) and not all(told)


def test_licence_bound_passes_over_no_licence(spark):
    own, docs = licences.model(), edge.frame(spark, ["Mr. X.. said: v2.0 .net a.b..c ... Straße\tMIT_license." + "x." * 50_000 + "1" * 200_000, "No.", ".", ""])
    assert [r["w"] for r in docs.select("doc_id", licences._tokens(F.col("text")).alias("w")).orderBy("doc_id").collect()] == [licences.tokens(r["text"]) for r in docs.orderBy("doc_id").collect()]
    numbers, rng, told = licences.Numbers(own), np.random.default_rng(4), 0
    for _ in range(3_000):  # grams of all kinds at random: whatever has the least probability reaches the bound
        words = [numbers.words[i] for i in rng.integers(0, len(numbers.words), int(rng.integers(1, 2 * licences.REACH)))]
        code = [numbers.buckets[zlib.crc32(w.encode()) % licences.BUCKETS][w] for w in words]
        found = {*code, *(n for a, b in zip(code, code[1:], strict=False) if (n := numbers.pairs[a].get(str(b))))}
        p = own.probabilities(words)
        assert np.allclose(own._softmax((numbers.weights[sorted(found)].sum(0) + own.bias)[None])[0], p)
        if own.classes[int(p.argmax())] != licences.UNKNOWN and p.max() >= licences.LEAST_PROBABILITY:
            told += 1
            assert numbers.bias + numbers.most[sorted(found)].sum() >= 0
    assert 100 < told < 2_900


def test_licence_edges(spark):
    rows = licences.scan(edge.documents(spark)).collect()
    assert len(rows) == len(edge.rows()) and not any(r["families"] or r["n_candidates"] for r in rows)
    assert {r["n_paragraphs"] for r in rows if r["doc_id"] in (0, 1, 2)} == {0}
    assert licences.scan(edge.none(spark)).count() == 0


# --- pseudo-likelihood -----------------------------------------------------


def plain_log_probability(codes, network, tokens, i):
    """The masked token's, from the definition: a hidden layer, and one factor for each branch of the path."""
    side = pseudolik.SIDE
    around = [0] * side + list(tokens.seen) + [0] * side
    hidden = network.bias[0].astype(float)
    for scale, o in zip(network.scales, [*range(-side, 0), *range(1, side + 1)], strict=True):
        hidden = hidden + scale.astype(float) * network.inputs[around[i + side + o]]
    hidden, out = np.tanh(hidden), 0.0
    for k in range(codes.length[tokens.number[i]]):
        node, branch = divmod(int(codes.paths[k][tokens.number[i]]), 2)
        z = float(network.outputs[node] @ hidden + network.lean[node, 0])
        out -= np.log1p(np.exp(z if branch else -z))
    return out


def small_codes(seed=0, words=40):
    rng = np.random.default_rng(seed)
    return pseudolik.Codes([(int(h), int(n)) for h, n in zip(rng.integers(-(1 << 62), 1 << 62, words), rng.integers(2, 99, words), strict=True)], 3000)


def small_network(codes, seed=0):
    rng, network = np.random.default_rng(seed), pseudolik.Network(codes)
    network.outputs += rng.normal(0, 0.3, network.outputs.shape).astype(np.float32)
    network.bias += rng.normal(0, 0.3, network.bias.shape).astype(np.float32)
    return network


def test_scores_are_the_sum_over_all_tokens(spark):
    texts = ["abab, abab!", "ba", "", None, "zzzz zz", "abab, abab!", "Ünï 日本 x" + "y" * 200] * 3 + ["once", "twofold"]
    docs = edge.frame(spark, texts).coalesce(1)
    got = edge.by_id(pseudolik.scores(docs))
    counts = {r["h"]: r["n"] for r in pseudolik.token_counts(docs).collect()}
    total = sum(counts.values())
    codes = pseudolik.Codes(sorted(((h, n) for h, n in counts.items() if n > 1), key=lambda x: (-x[1], x[0])), total)
    network, spelled = pseudolik.train(docs, spark.sparkContext.broadcast(codes), total)
    for k, t in enumerate(texts):
        tokens = codes.numbered(pa.array([t]))
        want = sum(plain_log_probability(codes, network, tokens, i) for i in range(len(tokens.number))) + spelled[tokens.symbol].sum()
        assert got[k]["n_tokens"] == len(tokens.number) and abs(got[k]["log_prob"] - want) < 1e-3 * max(1, len(tokens.number))
    assert got[0]["n_tokens"] == 4 and got[0]["log_prob"] == got[5]["log_prob"] and got[2]["mean_log_prob"] is None
    symbols = [ord("o") << 8 | ord("n"), ord("c") << 8 | ord("e"), pseudolik._END, ord("t") << 8 | ord("w"), ord("o") << 8 | ord("f"), ord("o") << 8 | ord("l"), pseudolik._SINGLE + ord("d")]
    assert codes.numbered(pa.array(["once twofold"])).symbol.tolist() == symbols
    seen = {x: symbols.count(x) for x in symbols}
    assert np.allclose(spelled[symbols], [np.log((seen[x] + 1) / (len(symbols) + len(spelled))) for x in symbols]) and abs(np.exp(spelled).sum() - 1) < 1e-9


def test_token_probabilities_sum_to_one():
    codes = small_codes()
    network = small_network(codes)
    live = np.flatnonzero(codes.length)
    row = np.tile([5, 30, 900, 0, 2, 0, 0], len(live)).astype(np.int32)
    whole = np.exp(network.log_probabilities(codes, live, row, np.arange(len(live)) * 7 + 3))
    assert len(live) == codes.nodes + 1 == 41 and abs(whole.sum() - 1) < 1e-4


def test_learned_gradient_is_the_slope_of_the_loss():
    codes = small_codes()
    network, rng = small_network(codes), np.random.default_rng(1)
    number = rng.choice(np.flatnonzero(codes.length), 60).astype(np.int32)
    tokens = pseudolik.Numbered(number, np.where(number == 1, codes.size + 7, number).astype(np.int32), np.array([0, 25, 60]), number[:0], number[:0])
    ((_, _, number, row, place),) = pseudolik.parts(tokens, 100)
    for name, (at, slope, n) in network.slopes(codes, number, row, place).items():
        summed = np.zeros_like(getattr(network, name))
        np.add.at(summed, at, slope)
        for r in rng.choice(np.unique(at), 3):
            values, c = getattr(network, name), int(rng.integers(summed.shape[1]))
            was, loss = values[r, c], []
            for step in (0.02, -0.02):
                values[r, c] = was + step
                loss.append(-network.log_probabilities(codes, number, row, place).sum())
            values[r, c] = was
            assert abs((loss[0] - loss[1]) / 0.04 - summed[r, c]) < 1e-2 + 1e-2 * abs(summed[r, c]), name
        assert n.min() > 0


def test_first_levels_learn_as_the_deeper_ones_do():
    codes = small_codes()
    network, number = small_network(codes), np.random.default_rng(6).choice(np.flatnonzero(codes.length), 60).astype(np.int32)
    assert codes.above == len({int(s) >> 1 for row in codes.paths[: pseudolik.DENSE] for s in row[codes.length > 0]}) < codes.nodes
    tokens = pseudolik.Numbered(number, number, np.array([0, 60]), number[:0], number[:0])
    ((_, _, number, row, place),) = pseudolik.parts(tokens, 100)
    hidden = network.hidden(row)[1][place].astype(float)
    slopes, leans, met = np.zeros(network.outputs.shape), np.zeros(codes.nodes), np.zeros(codes.nodes, int)
    for h, n in zip(hidden, number, strict=True):
        for step in codes.paths[: codes.length[n], n]:
            sign = 1 - 2 * (int(step) & 1)
            error = -sign / (1 + np.exp(sign * (network.outputs[step >> 1] @ h + network.lean[step >> 1, 0])))
            slopes[step >> 1] += error * h
            leans[step >> 1] += error
            met[step >> 1] += 1
    found = network.slopes(codes, number, row, place)
    for name, want in (("outputs", slopes), ("lean", leans[:, None])):
        at, slope, n = found[name]
        assert sorted(at) == np.flatnonzero(met).tolist() and np.array_equal(n, met[at])
        assert np.allclose(slope, want[at], atol=1e-4)


@pytest.mark.parametrize("runs", [1, 3, 40, 400])
def test_long_and_short_runs_have_the_sums_of_their_rows(runs):
    rng = np.random.default_rng(runs)
    rows, weights = rng.normal(size=(400, 20)).astype(np.float32), rng.normal(size=400).astype(np.float32)
    edge = np.append(0, np.sort(rng.choice(np.arange(1, 400), runs - 1, replace=False)))
    want = [sum(weights[i] * rows[i].astype(float) for i in range(a, b)) for a, b in zip(edge, [*edge[1:], 400], strict=True)]
    assert np.allclose(pseudolik._run_sums(rows, weights, edge), want, atol=1e-4)


def test_long_texts_are_worked_in_pieces_that_see_each_other():
    codes = small_codes()
    network = small_network(codes)
    number = np.random.default_rng(3).choice(np.flatnonzero(codes.length), 500).astype(np.int32)
    tokens = pseudolik.Numbered(number, number, np.array([0, 0, 300, 500]), number[:0], number[:0])
    whole = [network.log_probabilities(codes, *x[2:]) for x in pseudolik.parts(tokens, 1000)]
    pieces = [network.log_probabilities(codes, *x[2:]) for x in pseudolik.parts(tokens, 7)]
    assert np.allclose(np.concatenate(whole), np.concatenate(pieces), atol=1e-6)


def test_parts_are_averaged_by_how_often_they_met_a_row():
    messages = [pseudolik._message("bias", 0, 1, np.array([3, 7]), np.array([1, 2]), np.array([[1.0], [2.0]])), pseudolik._message("bias", 0, 1, np.array([7, 9]), np.array([6, 1]), np.array([[12.0], [5.0]]))]
    got = pa.Table.from_batches(list(pseudolik._added([pseudolik._batch([m]) for m in messages]))).to_pylist()
    assert len(got) == 1 and np.frombuffer(got[0]["rows"], np.int32).tolist() == [3, 7, 9]
    assert np.frombuffer(got[0]["met"], np.int64).tolist() == [1, 8, 1] and np.frombuffer(got[0]["sums"], np.float32).tolist() == [1, 14, 5]


def test_odd_text_scores_lower(spark):
    rng = np.random.default_rng(2)
    texts = ["the cat sat on the mat and the dog sat on the log "] * 60 + ["".join(rng.choice(list("acdeghlmnost "), 400)) for _ in range(6)]
    got = edge.by_id(pseudolik.scores(edge.frame(spark, texts)))
    assert max(got[k]["mean_log_prob"] for k in range(60, 66)) < got[0]["mean_log_prob"] - 0.5


def test_pseudo_likelihood_edges(spark):
    assert pseudolik.scores(edge.documents(spark)).count() == len(edge.rows())
    assert pseudolik.scores(edge.none(spark)).count() == 0
    assert {r["log_prob"] for r in pseudolik.scores(edge.frame(spark, [None, ""])).collect()} == {0.0}


def test_minority_scripts_are_scored_as_language(spark):
    common = "".join(chr(c) for c in range(33, 127)).lower()
    rng = np.random.default_rng(6)
    russian = "кошка сидит на окне и смотрит на птиц "
    texts = [common * 600] * 6 + [russian * 8] * 40 + ["".join(rng.permutation(list(russian * 8))) for _ in range(4)] + ["日本語の文章", "中国語の文書", "हिन्दी में", "العربية لغ"]
    got = edge.by_id(pseudolik.scores(edge.frame(spark, texts)))
    assert max(got[k]["mean_log_prob"] for k in range(46, 50)) < got[6]["mean_log_prob"] - 0.1
    assert len({round(got[k]["log_prob"], 6) for k in range(46, 54)}) == 8


def test_spelling_tells_all_tokens_apart():
    codes = pseudolik.Codes([], 10)
    rng = np.random.default_rng(7)
    texts = ["".join(chr(c) for c in rng.choice([97, 98, 0xE9, 0x44F, 0x628], int(rng.integers(1, 6)))) for _ in range(500)]
    tokens = codes.numbered(pa.array([*texts, None, "", " \n", "日", "語", "!"]))
    assert len(tokens.number) == 503 and tokens.bounds[-4] == 500 and set(tokens.number) == {1}
    spelled = [tuple(tokens.symbol[tokens.owner == k]) for k in range(503)]
    assert len(set(spelled)) == len(set(texts)) + 3


def test_tokens_are_runs_marks_and_characters():
    texts = ["Hello, wörld_1!", "日本 語a", "x" * 150, "", "привет мир"]
    data, offsets = tx.raw(pa.array(texts))
    starts, ends, where = pseudolik.tokens(tx.LOWER[data], offsets)
    got = [[bytes(data[a:b]).decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(where, where[1:], strict=False)]
    assert got == [["Hello", ",", "wörld_1", "!"], ["日", "本", "語", "a"], ["x" * 64, "x" * 64, "x" * 22], [], ["привет", "мир"]]
