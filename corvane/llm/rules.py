"""Quality rules: base limits, then robust multivariate outliers.

All of it is DataFrame expressions.  Each text becomes a vector of transformed
statistics.  For each language and source the minimum-covariance-determinant
estimate is sought by concentration steps from three starts (medians and
absolute deviations, mean and covariance, spatial signs): distances from the
current centre, the three quarters of the rows that lie nearest, their mean and
covariance, and again until no determinant falls any more.  The start of least
determinant is taken, and a reweighted estimate over all rows within the 97.5 %
limit follows.  Rows beyond ``CUTOFF`` are rejected.

Nothing of a group meets in one task but pre-aggregated sums: the share that
lies nearest is found from counts by (group, grid cell of the distance), exact
on the grid and of bounded length.  Groups with fewer rows than ``LEAST_ROWS``
use their language's estimate, and small languages that of all rows; ``level``
tells which (2, 1, 0).  All covariances are regularised by ``FLOORS``: half the
smallest change of a statistic that means something is added to its spread.

Cases: a null text has no words and fails the base limits.  A null language or
source is a group value of its own.  Rows that fail the base limits don't take
part in estimates.  Constant statistics are no trouble, thanks to the floors.
Starts of equal determinant go by their order.  If no row is left for an
estimate nothing is rejected; an empty table gives no rows.  Repeated rows
count as often as they occur and get equal verdicts; columns other than doc_id,
text, lang and source are never read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.runtime import cut, packed

WINDOW = 8
LEAST_WORDS = 20
#: Repeated words in hundredths of all words, beyond which a text fails.
MOST_REPEATED = 30
STATISTICS = ["x0", "x1", "x2", "x3", "x4"]
#: Rows that a group needs for an estimate of its own: forty for each statistic.
LEAST_ROWS = 40 * len(STATISTICS)
#: Share of the rows that an estimate rests on; concentration steps at most, and the
#: fall of a determinant's logarithm below which it has settled.
SHARE, STEPS, SETTLED = 0.75, 12, 1e-3
#: Cells of the distance grid for each doubling (natural logarithm times this).
CELLS = 32
#: Half the change of each statistic that means something in a text of 100 words: its
#: length doubled, one character more a word of five, one symbol, one repeated window
#: (8 words and the next), one repeated line.
FLOORS = [math.log(2) / 2, math.log(6 / 5) / 2, math.log1p(1) / 2, math.sqrt(9 / 100) / 2, math.log1p(1) / 2]
#: Chi-square quantiles for 5 degrees of freedom: 0.75, 0.975 and 1 - 1e-6 (fixed values).
QUARTILE, INNER, CUTOFF = 6.6257, 12.8325, 35.8882

_SPACE = " \t\n\x0b\f\r"
_SPACES = "[ \\t\\n\\x0B\\f\\r]+"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _words() -> Column:
    inner = F.btrim(_text(), F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACES))


def _neighbours(a: Column, size: Column) -> Column:
    """Whether each element's h equals the one before it; the first has none before."""
    return F.concat(F.array(F.lit(False)), F.zip_with(F.slice(a, 1, size - 1), F.slice(a, 2, size - 1), lambda x, y: x["h"] == y["h"]))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words of windows that occur twice or more.

    Windows are told apart by a 64-bit hash of their words' hashes.  Only texts
    in which the number of distinct windows falls short are looked at further.
    """
    df = df.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    hashed = F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_h"), i, WINDOW)))
    df = df.withColumn("_w", F.when(F.size("_h") > WINDOW, hashed)).drop("_h")
    at = F.sequence(F.lit(0), F.size("_w") - 1)
    placed = F.array_sort(F.zip_with("_w", at, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_z", F.when(F.size("_w") > F.size(F.array_distinct("_w")), placed)).drop("_w")
    df = df.withColumn("_e", F.when(F.col("_z").isNotNull(), _neighbours(F.col("_z"), F.size("_z"))))
    after = F.concat(F.slice("_e", 2, F.size("_z") - 1), F.array(F.lit(False)))
    twice = F.zip_with("_z", F.zip_with("_e", after, lambda x, y: x | y), lambda z, f: F.struct(z["i"].alias("i"), f.alias("f")))
    places = F.array_sort(F.transform(F.filter(twice, lambda x: x["f"]), lambda x: x["i"]))
    first = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    covered = F.aggregate(places, first, lambda s, i: F.struct((i + WINDOW).alias("to"), (s["n"] + i + WINDOW - F.greatest(s["to"], i)).alias("n")), lambda s: s["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_z", "_e")


def base(docs: DataFrame) -> DataFrame:
    """The counts of every row, base_failed, and the group columns lang and source."""
    lines = F.filter(F.split(_text(), "\n"), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    df = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
        _words().alias("_words"),
        F.char_length(F.regexp_replace(_text(), "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")).drop("_lines")
    df = df.withColumns({"n_words": F.size("_words").cast("long"), "word_chars": F.char_length(F.concat_ws("", "_words")).cast("long")})
    df = _repeat_words(df).drop("_words")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _vector() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "x0": F.log(n),
        "x1": F.log((F.col("word_chars") + 1) / n),
        "x2": F.log1p(100 * F.col("n_symbols") / n),
        "x3": F.sqrt(F.col("n_repeat_words") / n),
        "x4": F.log1p(F.col("n_dup_lines").cast("double")),
    }


#: Groups up to which a table of a row for each is broadcast: some 250 bytes a row.
BROADCAST_GROUPS = 20_000


def _held(groups: DataFrame) -> DataFrame:
    """A written table of groups, broadcast to its join if its counted rows allow it; else the join deals both sides."""
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def _nearest(df: DataFrame, keys: list[str], value: str, share: float) -> DataFrame:
    """For each group the least grid cell up to which ``share`` of its rows lie.

    Cells are counted and written first: the window then meets a group's few
    hundred cells and not every task's share of them.
    """
    cells = packed(df.groupBy(*keys, value).agg(F.count("*").alias("_n")))
    run = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    cells = cells.withColumns({"_run": F.sum("_n").over(run), "_all": F.sum("_n").over(whole)})
    return cells.where(F.col("_run") >= F.ceil(share * F.col("_all"))).groupBy(*keys).agg(F.min(value).alias("_to"))


def _grouped(stats: DataFrame) -> DataFrame:
    """Adds ``grp``, the group whose estimate a row uses, and its ``level``."""
    able = stats.where("not base_failed")
    own = packed(able.groupBy("lang", "source").agg(F.count("*").alias("_own")))
    named = own.toDF("_l", "_s", "_own").withColumn("_wide", F.sum("_own").over(Window.partitionBy("_l")))
    level = F.when(F.col("_own") >= LEAST_ROWS, 2).when(F.col("_wide") >= LEAST_ROWS, 1).otherwise(0)
    named = named.select("_l", "_s", level.alias("level"))
    grp = F.when(F.col("level") == 2, F.to_json(F.struct(F.lit(2).alias("of"), "_l", "_s"))).when(F.col("level") == 1, F.to_json(F.struct(F.lit(1).alias("of"), "_l"))).otherwise("all")
    named = packed(named.withColumn("grp", grp))
    joined = stats.join(_held(named), F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left").drop("_l", "_s")
    return joined.withColumns({"grp": F.coalesce("grp", F.lit("all")), "level": F.coalesce("level", F.lit(0))})


_P = range(len(STATISTICS))
_ESTIMATE = [*[f"m{i}" for i in _P], *[f"w{i}{j}" for i in _P for j in range(i + 1)]]


def _estimate(rows: DataFrame, keys: list[str], floors: list[float] | None = None) -> DataFrame:
    """For each group the mean, the inverse Cholesky factor of the covariance plus floors, and the logarithm of its determinant."""
    floors = FLOORS if floors is None else floors
    sums = [F.avg(x).alias(f"m{i}") for i, x in enumerate(STATISTICS)]
    sums += [F.avg(F.col(STATISTICS[i]) * F.col(STATISTICS[j])).alias(f"c{i}{j}") for i in _P for j in range(i + 1)]
    est = packed(rows.groupBy(*keys).agg(*sums))
    for i in _P:
        for j in range(i + 1):
            value = F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}") + (F.lit(floors[i] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                value = value - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(F.greatest(value, F.lit(1e-9))) if i == j else value / F.col(f"l{j}{j}"))
    for j in _P:
        est = est.withColumn(f"w{j}{j}", 1 / F.col(f"l{j}{j}"))
        for i in range(j + 1, len(_P)):
            value = sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j + 1, i)), F.col(f"l{i}{j}") * F.col(f"w{j}{j}"))
            est = est.withColumn(f"w{i}{j}", -value / F.col(f"l{i}{i}"))
    est = est.withColumn("det", sum((2 * F.log(f"l{i}{i}") for i in _P), F.lit(0.0)))
    return packed(est.select(*keys, *_ESTIMATE, "det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from its group's estimate."""
    total = F.lit(0.0)
    for i in range(len(STATISTICS)):
        y = sum((F.col(f"w{i}{j}") * (F.col(STATISTICS[j]) - F.col(f"m{j}")) for j in range(i + 1)), F.lit(0.0))
        total = total + y * y
    return total


def _cell(value: Column) -> Column:
    return F.floor(CELLS * F.log(value + 1e-6)).cast("int")


def _spread(rows: DataFrame, values: list[Column], name: str) -> DataFrame:
    """For each group the median of each value on a grid, as name0, name1 ..."""
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.floor(v * 256).cast("int").alias("v")) for i, v in enumerate(values)])
    long = rows.select("grp", F.explode(each).alias("e")).select("grp", "e.i", "e.v")
    middle = _nearest(long, ["grp", "i"], "v", 0.5).groupBy("grp").pivot("i", list(_P)).agg(F.first(F.col("_to") / 256))
    return packed(middle.toDF("grp", *[f"{name}{i}" for i in _P]))


def _starts(rows: DataFrame) -> DataFrame:
    """(grp, start, estimate): where the concentration steps of each group begin."""
    medians = _spread(rows, [F.col(x) for x in STATISTICS], "m")
    spread = _spread(rows.join(_held(medians), "grp"), [F.abs(F.col(x) - F.col(f"m{i}")) for i, x in enumerate(STATISTICS)], "s")
    plain = medians.join(spread, "grp")
    for i, floor in enumerate(FLOORS):
        for j in range(i + 1):
            plain = plain.withColumn(f"w{i}{j}", 1 / F.sqrt((1.4826 * F.col(f"s{i}")) ** 2 + floor**2) if i == j else F.lit(0.0))
    plain = packed(plain.select("grp", *_ESTIMATE))
    # directions alone, from the medians in units of their spread
    ways = rows.join(_held(plain), "grp").withColumns({f"z{i}": F.col(f"w{i}{i}") * (F.col(x) - F.col(f"m{i}")) for i, x in enumerate(STATISTICS)})
    length = F.sqrt(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in _P), F.lit(1e-12)))
    signs = _estimate(ways.select("grp", *[(F.col(f"z{i}") / length).alias(x) for i, x in enumerate(STATISTICS)]), ["grp"], [0.1] * len(STATISTICS))
    own = plain.select("grp", *[f"m{i}" for i in _P], *[F.col(f"w{i}{i}").alias(f"u{i}") for i in _P])
    turned = signs.drop("det", *[f"m{i}" for i in _P]).join(own, "grp").select("grp", *[f"m{i}" for i in _P], *[(F.col(f"w{i}{j}") * F.col(f"u{j}")).alias(f"w{i}{j}") for i in _P for j in range(i + 1)])
    every = [plain, _estimate(rows, ["grp"]).drop("det"), turned]
    return packed(reduce(DataFrame.unionByName, [x.withColumn("start", F.lit(k)) for k, x in enumerate(every)]))


def concentrated(rows: DataFrame) -> DataFrame:
    """(grp, start, estimate, det) after the concentration steps from every start."""
    est, before = _starts(rows), None
    for _ in range(STEPS):
        placed = rows.join(_held(est.select("grp", "start", *_ESTIMATE)), "grp").withColumn("cell", _cell(_distance())).select("grp", "start", "cell", *STATISTICS)
        scale = packed(_nearest(placed.select("grp", "start", "cell"), ["grp", "start"], "cell", SHARE))
        est = _estimate(placed.join(_held(scale), ["grp", "start"]).where("cell <= _to").select("grp", "start", *STATISTICS), ["grp", "start"])
        if before is not None:
            fall = est.join(before, ["grp", "start"]).agg(F.max(F.col("was") - F.col("det"))).first()[0]
            if fall is None or fall < SETTLED:
                break
        before = est.select("grp", "start", F.col("det").alias("was"))
    return est


def estimates(stats: DataFrame) -> DataFrame:
    """The reweighted estimate of each group, scaled so that distances compare with chi-square quantiles."""
    rows = stats.where("not base_failed").select("grp", *STATISTICS)
    every = concentrated(rows)
    best = every.groupBy("grp").agg(F.min(F.struct("det", "start")).alias("b")).select("grp", F.col("b.start").alias("start"))
    est = packed(every.join(best, ["grp", "start"]).select("grp", *_ESTIMATE))
    placed = rows.join(_held(est), "grp").withColumn("d2", _distance()).withColumn("cell", _cell(F.col("d2")))
    scale = _nearest(placed.select("grp", "cell"), ["grp"], "cell", SHARE).select("grp", F.greatest(F.lit(1.0), F.exp((F.col("_to") + 1) / CELLS) / QUARTILE).alias("scale"))
    return _estimate(placed.join(_held(packed(scale)), "grp").where(F.col("d2") <= INNER * F.col("scale")).select("grp", *STATISTICS), ["grp"])


def apply(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the squared distance and the estimate's level of every row."""
    stats = cut(base(docs))
    stats = _grouped(stats.withColumns(_vector()))
    est = estimates(cut(stats.select("grp", "base_failed", *STATISTICS)))
    judged = stats.join(_held(est), "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance", "level")
