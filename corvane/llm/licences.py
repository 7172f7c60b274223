"""Licence scan: a trained paragraph classifier confirmed by templates.

A softmax regression over sparse word 1- and 2-grams (proximal gradient with an
L1 penalty), trained on the driver on variants of the notices below, gives each
paragraph a licence family or "unknown".  Its temperature is fitted on notices
that a model hasn't learned from, so that its probabilities are honest for
wordings of others.  A prediction counts only if a template of the family
confirms it: all the template's key grams (in brackets below) and LEAST_SHARE
of its words are in the paragraph.

A paragraph is a run of lines up to a blank one.  It is read in runs of
2 * REACH words, one at every REACH words, so that a notice of up to REACH
words is seen whole however it is wrapped, in runs of REACH words, one at every
STEP words, which hold less of the prose around it, and line by line, so that
neighbouring notices are told apart.  Lines of more than 2 * REACH words are
only read in runs.  Each confirmed line is a licence; a confirmed run adds one
if no line of the text and no earlier run has confirmed its family.

The classifier judges every paragraph, run and line: first by a bound on its
margin (the largest weights of the grams beyond those of "unknown"), and what
the bound can't tell from a licence by the sums of all classes.  What it takes for a
licence and no template confirms is unconfirmed; of the unconfirmed runs of a
family the first counts, if no line has the family and no run confirms it.
What only a template fits is unconfirmed too, where it is a line.
The scan itself is DataFrame expressions: no shuffle, no Python.

Cases: a null or empty text has no paragraphs and no families.  Families of
equal probability go by their order in ``classes``.  Long texts are scanned
whole.  Repeated rows get equal results, an empty table none; columns other
than doc_id and text are never read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Probability that a family must reach, and share of a template's words that must be found.
LEAST_PROBABILITY = 0.5
LEAST_SHARE = 0.6
UNKNOWN = "unknown"
#: Words of a notice that a run surely holds whole: more than the longest template has.
REACH = 24
#: Words from one short run to the next.
STEP = 8
#: Parts of the table of words, each looked through from its beginning.
BUCKETS = 64

#: Notices by family with their key grams in brackets (fixed values: the usual wording of public licences).
NOTICES = {
    "agpl": [
        "this program is licensed under the [gnu affero] general public license version 3",
        "redistribute it and or modify it under the terms of the [gnu affero] general public license as published by the free software foundation",
        "[affero general] public license",
    ],
    "apache": [
        "licensed under the [apache license] version 2.0",
        "you may not use this file except in compliance with the license [apache license]",
        "[apache software] license",
        "distributed under the [apache 2.0] [license]",
    ],
    "boost": ["distributed under the [boost software] license version 1.0", "[boost software] license"],
    "bsd": [
        "[redistribution] and use in source and [binary forms] with or without modification are permitted",
        "use of this source code is governed by a [bsd style] license that can be found in the license file",
        "released under the [bsd] 3 clause [license]",
        "licensed under the [bsd] 2 clause [license]",
        "neither the name of the copyright holder nor the names of its [contributors] may be used to [endorse] or promote products",
    ],
    "cc-by": [
        "this work is licensed under a [creative commons] [attribution 4.0] international license",
        "licensed under [cc by] [by 4.0]",
        "licensed under [cc by] [by 3.0]",
    ],
    "cc-by-nc": [
        "this work is licensed under a [creative commons] [attribution noncommercial] 4.0 international license",
        "licensed under [cc by] [by nc] 4.0",
    ],
    "cc-by-sa": [
        "this work is licensed under a [creative commons] [attribution sharealike] 4.0 international license",
        "licensed under [cc by] [by sa] 4.0",
        "text is available under the [creative commons] [attribution sharealike] license",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the [eclipse public] license 2.0",
        "[eclipse public] license",
    ],
    "gpl": [
        "this work is licensed under the [gnu general] public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the [gnu general] public license",
        "[gnu general] public license",
        "you should have received a copy of the [gnu general] public license along with this program",
        "licensed under the [gnu gpl] version 2 or later",
    ],
    "isc": [
        "[permission] to use copy modify and or distribute this software for any purpose with or without [fee] is hereby granted",
        "licensed under the [isc license]",
    ],
    "lgpl": [
        "this library is licensed under the [gnu lesser] general public license version 2.1",
        "redistribute it and or modify it under the terms of the [gnu lesser] general public license",
        "[lesser general] public license",
        "[gnu library] general public license",
    ],
    "mit": [
        "released under the [mit license]",
        "[permission] is hereby [granted] free of charge to any person [obtaining] a copy of this software",
        "licensed under the terms of the [mit license] see the file for details",
        "the above copyright notice and this [permission notice] shall be included in all copies or [substantial portions] of the software",
    ],
    "mpl": [
        "this source code form is subject to the terms of the [mozilla public] license v 2.0",
        "licensed under the [mozilla public] license 2.0",
        "[mozilla public] license",
    ],
    "public-domain": [
        "this work has been [dedicated] to the [public domain] under cc0 1.0",
        "this work is [cc0]",
        "licensed under the [creative commons] [cc0] 1.0 universal public domain dedication",
        "this is free and [unencumbered] software released into the public domain",
        "released into the [public domain]",
        "the author [waives] all copyright and related rights in this work worldwide",
    ],
    "zlib": [
        "[altered] source versions must be [plainly marked] as such and must not be misrepresented as being the original software",
        "licensed under the [zlib license]",
    ],
}
#: Short names by family, as licence words stand beside them in several languages (fixed values).
NAMES = {"agpl": ["agpl"], "apache": ["apache"], "boost": ["bsl 1.0"], "bsd": ["bsd"], "epl": ["epl"], "gpl": ["gpl"], "isc": ["isc"], "lgpl": ["lgpl"], "mit": ["mit"], "mpl": ["mpl"], "zlib": ["zlib"]}
LICENCE_WORDS = ["license", "licence", "lizenz", "licencia", "licenza", "licensed"]
#: Identifiers of machine-readable tags by family, in words (fixed values).
TAGS = {
    "agpl": ["agpl 3.0 only", "agpl 3.0 or later"],
    "apache": ["apache 2.0"],
    "boost": ["bsl 1.0"],
    "bsd": ["bsd 2 clause", "bsd 3 clause"],
    "cc-by": ["cc by 4.0", "cc by 3.0"],
    "cc-by-nc": ["cc by nc 4.0"],
    "cc-by-sa": ["cc by sa 4.0", "cc by sa 3.0"],
    "epl": ["epl 1.0", "epl 2.0"],
    "gpl": ["gpl 2.0", "gpl 2.0 only", "gpl 2.0 or later", "gpl 3.0", "gpl 3.0 only", "gpl 3.0 or later"],
    "isc": ["isc"],
    "lgpl": ["lgpl 2.1", "lgpl 2.1 only", "lgpl 2.1 or later", "lgpl 3.0 only", "lgpl 3.0 or later"],
    "mit": ["mit"],
    "mpl": ["mpl 1.1", "mpl 2.0"],
    "public-domain": ["cc0 1.0", "unlicense"],
    "zlib": ["zlib"],
}

#: Sentences with the same words that grant nothing, and notices of licences that are in no family (fixed values).
OTHER = [
    "he renewed his driving license last week",
    "the license of the restaurant was not extended by the city",
    "all rights reserved no part may be copied without permission",
    "she asked for permission to leave the room early",
    "the warranty of the machine ended after two years",
    "copyright law protects authors for many years",
    "please read the license before you use this software",
    "a license fee is due every year",
    "the state will redistribute the money among the regions",
    "the institute of technology opened a new general public library",
    "this work was released under a new name",
    "the commercial version of the work is sold under license",
    "the attribution of the painting to the master is doubtful",
    "they were licensed to sell food in public",
    "copyright 2019 by the authors",
    "use of this file is subject to the terms of the contract",
    "er fuhr mit seiner lizenz nach hause und kam mit der lizenz zurueck",
    "con licencia de su padre salió de la casa",
    "the mozilla project and the eclipse project held a public meeting",
    "an apache helicopter landed near the city",
    "the gnu is a large animal of the plains",
    "we compare the gpl with other terms in this book",
    "permission is granted to copy this document under the terms of the gnu free documentation license version 1.3",
    "this font software is licensed under the sil open font license version 1.1",
    "licensed under the european union public licence v 1.2",
    "this is licensed under the artistic license 2.0",
    "licensed under the microsoft public license",
    "subject to the common development and distribution license version 1.0",
    "licensed under the business source license 1.1",
    "this software is licensed under the server side public license",
    "licensed under the academic free license version 3.0",
    "use is governed by the end user license agreement of the company",
    "spdx license identifier ofl 1.1",
    "spdx license identifier eupl 1.2",
    "spdx license identifier licenseref proprietary",
    "licensed under cc by nd 4.0",
    "the software is provided as is without warranty of any kind",
]

#: Words that stand around notices of any kind (fixed values).
AROUND = "as published by the free software foundation either version of the license or at your option any later version distributed in the hope that it will be useful without any warranty see file for details copyright holder all code".split()
#: Words that prose consists of, around notices and without them (fixed values).
PROSE = "the of and in a to that it for with its all we by on is are was many one from at".split()
#: Words that plain prose has often: the last that a gate consists of.
COMMON = set("a an and any are as be been by bsd can cc code commons contributors copy creative dedicated domain except fee file for form forms found free gnu granted has have holder in into is it license licensed may mit name no not notice of or person program public released source terms that the this to under use used with work you".split())

_SPACE = " \t\n\x0b\f\r"


def _listed() -> dict[str, list[str]]:
    """Every family's notices, its short names beside licence words, and its tags."""
    out = {family: list(texts) for family, texts in NOTICES.items()}
    for family, names in NAMES.items():
        for name in names:
            last, first = name.split()[-1], name.split()[0]
            for word in LICENCE_WORDS[:-1]:
                out[family].append(" ".join([*name.split()[:-1], f"[{last} {word}]"]))
                out[family].append(" ".join([f"[{word} {first}]", *name.split()[1:]]))
    for family, tags in TAGS.items():
        for tag in tags:
            parts = tag.split()
            key = [f"[identifier {parts[0]}]", *[f"[{a} {b}]" for a, b in zip(parts, parts[1:], strict=False)][:2]]
            out[family].append(" ".join(["spdx", "license", *key]))
    return out


class Template:
    """A notice's words, in order, and its keys: words or pairs that a paragraph must have."""

    def __init__(self, notice: str) -> None:
        self.keys = re.findall(r"\[([^\]]+)\]", notice)
        self.text = re.sub(r"\b(\S+) (?=\1\b)", "", notice.replace("[", "").replace("]", ""))
        self.words = list(dict.fromkeys(self.text.split()))
        self.least = math.ceil(LEAST_SHARE * len(self.words) - 1e-9)

    def confirms(self, found: set[str]) -> bool:
        return set(self.keys) <= found and sum(w in found for w in self.words) >= self.least


TEMPLATES = {family: [Template(t) for t in texts] for family, texts in _listed().items()}


def gate() -> list[str]:
    """Of each template a word of its keys: what has none of them is confirmed by no template."""
    words = [[w for k in t.keys for w in k.split()] for texts in TEMPLATES.values() for t in texts]
    times = {w: sum(w in own for own in words) for own in words for w in own}
    return sorted({min(own, key=lambda w: (w in COMMON, -times[w], w)) for own in words})


def grams(words: list[str]) -> list[str]:
    """Distinct words and neighbouring pairs, as the scan forms them."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def _variants(rng: np.random.Generator, words: list[str], fillers: list[str], n: int) -> list[list[str]]:
    out = [list(words)]
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.07]
        extra = [fillers[i] for i in rng.integers(0, len(fillers), int(rng.integers(0, 36)))]
        at = int(rng.integers(0, len(extra) + 1))
        out.append([*extra[:at], *kept, *extra[at:]])
    return out


class Model:
    """Weights by gram, one for each class in ``classes`` (the last is UNKNOWN), and a bias."""

    FOLDS = 4

    def __init__(self, seed: int = 5, variants: int = 8, rounds: int = 200) -> None:
        rng = np.random.default_rng(seed)
        self.classes = [*TEMPLATES, UNKNOWN]
        fillers = sorted({w for s in OTHER for w in s.split()} | set(AROUND)) + PROSE * 6
        last, rows, group = len(self.classes) - 1, [], []
        notices = [(t.text, k) for k, texts in enumerate(TEMPLATES.values()) for t in texts] + [(t, last) for t in OTHER]
        for number, (text, k) in enumerate(notices):
            own = [(v, k) for v in _variants(rng, text.split(), fillers, variants)]
            rows += own
            group += [number] * len(own)
        every = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.words})
        mixed = [([every[i] for i in rng.integers(0, len(every), int(rng.integers(3, 20)))], last) for _ in range(200)]
        group += range(len(notices), len(notices) + len(mixed))
        rows += mixed
        seen: dict[str, set[int]] = {}
        for (words, _), number in zip(rows, group, strict=True):
            for g in grams(words):
                seen.setdefault(g, set()).add(number)
        names = sorted(g for g, of in seen.items() if " " not in g or len(of) > 1 or any(g in t.text for texts in TEMPLATES.values() for t in texts))
        number = {g: i for i, g in enumerate(names)}
        x = np.zeros((len(rows), len(names)), np.float32)
        for row, (words, _) in zip(x, rows, strict=True):
            row[[number[g] for g in grams(words) if g in number]] = 1
        y = np.eye(len(self.classes), dtype=np.float32)[[k for _, k in rows]]
        fold = np.array(group) % self.FOLDS  # whole notices are held out, not only variants of them
        unseen = np.zeros(y.shape)
        for f in range(self.FOLDS):
            w, b = self._fit(x[fold != f], y[fold != f], rounds)
            unseen[fold == f] = x[fold == f] @ w + b
        self.temperature = min((0.25 * 1.1**k for k in range(40)), key=lambda t: -np.log(np.maximum((self._softmax(unseen / t) * y).sum(1), 1e-12)).mean())
        w, b = self._fit(x, y, rounds)
        used = np.flatnonzero(np.abs(w).max(1) > 0.02)
        self.grams = [names[i] for i in used]
        self.weights, self.bias = np.round(w[used] / self.temperature, 4).astype(float), np.round(b / self.temperature, 4).astype(float)
        self._number = {g: i for i, g in enumerate(self.grams)}

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @classmethod
    def _fit(cls, x: np.ndarray, y: np.ndarray, rounds: int, rate: float = 3.0, penalty: float = 5e-4) -> tuple[np.ndarray, np.ndarray]:
        """Accelerated proximal gradient: the L1 penalty leaves most grams without weight."""
        w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
        before, at = w, w
        for k in range(rounds):
            error = (cls._softmax(x @ at + b) - y) / len(x)
            step = at - rate * (x.T @ error)
            w = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
            at, before = w + k / (k + 3) * (w - before), w
            b -= rate * error.sum(0)
        return w, b

    def probabilities(self, words: list[str]) -> np.ndarray:
        at = [i for g in grams(words) if (i := self._number.get(g)) is not None]
        return self._softmax((self.weights[at].sum(0) + self.bias)[None])[0]


_MODEL: list[Model] = []


def model() -> Model:
    """The model, trained once in a process from the fixed notices (a few seconds)."""
    if not _MODEL:
        _MODEL.append(Model())
    return _MODEL[0]


def tokens(paragraph: str) -> list[str]:
    """A paragraph's words: lower case, runs of letters, digits and inner dots."""
    return [w for w in re.sub(r"\.(?=[^a-z0-9]|$)", " ", re.sub(r"[^a-z0-9.]+", " ", paragraph.lower())).split(" ") if w]


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _tokens(line: Column) -> Column:
    """As ``tokens``, in one pass: a dot belongs to a word if a letter or digit follows."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"(?:\.?[a-z0-9]++)++"), F.lit(0))


def _grams(words: Column) -> Column:
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, pairs))


class Numbers:
    """The model's grams by number: 0 is any other word, then the words that they consist of, then the pairs.

    ``weights`` has a row for each number, and ``most`` the largest weight of a
    family beyond that of UNKNOWN there: their sum bounds every family's margin.
    """

    def __init__(self, own: Model) -> None:
        self.words = sorted({w for g in own.grams for w in g.split()})
        number = {g: i for i, g in enumerate([*self.words, *(g for g in own.grams if " " in g)], 1)}
        self.buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
        self.pairs: list[dict[str, int]] = [{} for _ in range(len(self.words) + 1)]
        self.weights = np.zeros((len(number) + 1, len(own.classes)))
        for w in self.words:
            self.buckets[zlib.crc32(w.encode()) % BUCKETS][w] = number[w]
        for g, row in zip(own.grams, own.weights, strict=True):
            self.weights[number[g]] = row
            if " " in g:
                first, second = g.split(" ")
                self.pairs[number[first]][str(number[second])] = number[g]
        self.most = (self.weights[:, :-1] - self.weights[:, -1:]).max(1)
        self.bias = float((own.bias[:-1] - own.bias[-1]).max())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_candidates (what the classifier or a template takes for a licence), n_licences, n_unconfirmed, families and the paragraphs read."""
    own = model()
    numbers = Numbers(own)
    weights = _literal(numbers.weights.tolist(), "array<array<double>>")
    most = _literal(numbers.most.tolist(), "array<double>")
    buckets, pairs = (_literal(maps, "array<map<string,int>>") for maps in (numbers.buckets, numbers.pairs))
    bias = _literal(own.bias.tolist(), "array<double>")
    names = _literal(own.classes, "array<string>")
    kind = "struct<words:array<string>,keys:array<string>,least:int>"
    each = {f: [{"words": t.words, "keys": t.keys, "least": t.least} for t in texts] for f, texts in TEMPLATES.items()}
    by_family = _literal(each, f"map<string,array<{kind}>>")
    every = _literal([t for texts in each.values() for t in texts], f"array<{kind}>")
    vocabulary = sorted({g for texts in each.values() for t in texts for g in t["words"] + t["keys"]})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def confirms(t: Column, hits: Column) -> Column:
        return (t["least"] <= F.size(hits)) & (F.size(F.array_intersect(t["keys"], hits)) == F.size(t["keys"])) & (F.size(F.array_intersect(t["words"], hits)) >= t["least"])

    def numbered(w: Column) -> Column:
        return F.when(w.isin(numbers.words), F.try_element_at(F.get(buckets, (F.crc32(w) % BUCKETS).cast("int")), w)).otherwise(0)

    def paired(of_words: Column) -> Column:
        """The number of each word and the next one as a pair: none after the last."""
        following = F.slice(of_words, 2, F.size(of_words))
        return F.zip_with(of_words, following, lambda a, b: F.when((a > 0) & (b > 0), F.coalesce(F.try_element_at(F.get(pairs, a), b.cast("string")), F.lit(0))).otherwise(0))

    def distinct(of_words: Column, of_pairs: Column) -> Column:
        return F.array_remove(F.array_distinct(F.concat(of_words, of_pairs)), 0)

    def near(found: Column) -> Column:
        """Whether some family's margin over UNKNOWN may reach zero: without that no family has the least probability."""
        return F.aggregate(found, F.lit(numbers.bias), lambda acc, g: acc + F.get(most, g)) > -1e-6

    def lines(block: Column) -> Column:
        own_words = F.transform(F.split(block, "\n"), _tokens)
        return F.transform(own_words, lambda w: F.struct(w.alias("words"), F.transform(w, numbered).alias("numbers")))

    def runs(x: Column) -> Column:
        def of(size: int, every: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(F.size(x["words"]) - (size - every), F.lit(1)), F.lit(every))
            return F.transform(starts, lambda i: F.struct(i.alias("at"), F.lit(size).alias("size"), distinct(F.slice(x["numbers"], i, size), F.slice(x["pairs"], i, size - 1)).alias("found")))

        met = F.filter(F.concat(of(2 * REACH, REACH), of(REACH, STEP)), lambda r: near(r["found"]))
        return F.transform(met, lambda r: F.struct(F.slice(x["words"], r["at"], r["size"]).alias("words"), r["found"].alias("found"), F.lit(False).alias("line")))

    def judged(x: Column) -> Column:
        """With the classes' sums and the grams of templates."""
        z = F.aggregate(x["found"], bias, lambda acc, g: F.zip_with(acc, F.get(weights, g), lambda a, b: a + b))
        return F.struct(x["words"].alias("words"), F.filter(_grams(x["words"]), lambda g: g.isin(vocabulary)).alias("hits"), x["line"].alias("line"), z.alias("z"))

    def named(x: Column) -> Column:
        total = F.aggregate(x["z"], F.lit(0.0), lambda acc, v: acc + F.exp(v - x["top"]))
        family = F.try_element_at(names, F.array_position(x["z"], x["top"]).cast("int"))
        return F.struct(F.array_join(x["words"], " ").alias("paragraph"), family.alias("family"), (1 / total).alias("probability"), x["hits"].alias("hits"), x["line"].alias("line"))

    def settled(x: Column) -> Column:
        """With whether the classifier takes it for a licence and a template of the family confirms it."""
        told = (x["probability"] >= LEAST_PROBABILITY) & (x["family"] != UNKNOWN)
        sure = told & F.exists(F.coalesce(F.try_element_at(by_family, x["family"]), F.array().cast(f"array<{kind}>")), lambda t: confirms(t, x["hits"]))
        return F.struct(x["paragraph"].alias("paragraph"), x["family"].alias("family"), x["probability"].alias("probability"), sure.alias("confirmed"), x["line"].alias("line"), told.alias("told"), x["hits"].alias("hits"))

    blocks = F.filter(F.split(text, r"\n(?:[ \t\x0B\f\r]*\n)+"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blocks.alias("_blocks"))
    df = df.select("doc_id", F.size("_blocks").cast("long").alias("n_paragraphs"), F.transform("_blocks", lines).alias("_blocks"))
    of_lines = F.filter(F.flatten("_blocks"), lambda x: F.size(x["words"]).between(1, 2 * REACH))
    of_lines = F.transform(of_lines, lambda x: F.struct(x["words"].alias("words"), distinct(x["numbers"], paired(x["numbers"])).alias("found"), F.lit(True).alias("line")))
    # a line that has no gate word is confirmed by no template
    of_lines = F.filter(of_lines, lambda x: near(x["found"]) | F.exists(x["words"], lambda w: w.isin(gate())))
    whole = F.transform("_blocks", lambda b: F.struct(F.flatten(b["words"]).alias("words"), F.flatten(b["numbers"]).alias("numbers")))
    whole = F.transform(whole, lambda x: F.struct(x["words"].alias("words"), x["numbers"].alias("numbers"), paired(x["numbers"]).alias("pairs")))
    read = F.transform(F.concat(of_lines, F.flatten(F.transform(whole, runs))), judged)
    read = F.transform(read, lambda x: x.withField("top", F.array_max(x["z"])))
    df = df.select("doc_id", "n_paragraphs", F.transform(F.transform(read, named), settled).alias("_read"))
    # what the classifier takes for a licence, confirmed or not, and the lines that a template fits though the classifier doesn't
    df = df.withColumn("_read", F.filter("_read", lambda x: x["told"] | (x["line"] & F.exists(every, lambda t: confirms(t, x["hits"])))))
    for field, own, runs_of in (("confirmed", "_own", "_sure"), ("told", "_met", "_told")):
        df = df.withColumn(own, F.transform(F.filter("_read", lambda x: x["line"] & x[field]), lambda x: x["family"]))  # noqa: B023
        df = df.withColumn(runs_of, F.filter("_read", lambda x: ~x["line"] & x[field]))  # noqa: B023
    # of the runs of a family that no line confirms, the first stands for it
    df = df.withColumn("_first", F.transform("_sure", lambda x: x["family"]))
    first = F.filter("_sure", lambda x, i: ~F.array_contains("_own", x["family"]) & (F.array_position("_first", x["family"]) == i + 1))
    # and of those of a family that nothing confirms and no line has, the first is unconfirmed
    df = df.withColumn("_second", F.transform("_told", lambda x: x["family"]))
    second = F.filter("_told", lambda x, i: ~F.array_contains("_met", x["family"]) & ~F.array_contains("_first", x["family"]) & (F.array_position("_second", x["family"]) == i + 1))
    paragraphs = F.transform(F.concat(F.filter("_read", lambda x: x["line"]), first, second), lambda x: x.dropFields("line", "told", "hits"))
    df = df.withColumn("paragraphs", paragraphs)
    sure = F.filter("paragraphs", lambda x: x["confirmed"])
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",")
    return df.select(
        "doc_id",
        "n_paragraphs",
        F.size("paragraphs").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_licences"),
        (F.size("paragraphs") - F.size(sure)).cast("long").alias("n_unconfirmed"),
        families.alias("families"),
        "paragraphs",
    )
