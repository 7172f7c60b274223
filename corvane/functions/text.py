"""Text expressions: word characters as Unicode has them, tokens, n-grams, accents."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word character: a letter or number of any script, or an underscore.
WORD = r"[\p{L}\p{N}_]"
#: White space of any kind.
SPACE = r"[\s\x1C-\x1F\x85\p{Z}]"
_EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def java(pattern: str) -> str:
    """A pattern in which \\b, \\w, \\s and \\d mean the same on every JVM, for every script."""
    out = pattern.replace(r"\b", _EDGE).replace(r"[^\w\s\-\/]", r"[^\p{L}\p{N}_\s\x1C-\x1F\x85\p{Z}\-/]").replace(r"[^\w\s]", r"[^\p{L}\p{N}_\s\x1C-\x1F\x85\p{Z}]")
    return out.replace(r"\d", r"\p{Nd}").replace(r"\s", SPACE) if "[^" not in out else out.replace(r"\d", r"\p{Nd}")


def _plain(text: str | None) -> str | None:
    if text is None or text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(T.StringType())
def strip_accents(texts: pd.Series) -> pd.Series:
    """Compatibility decomposition without the combining marks; Spark has no such function."""
    return texts.map(_plain)


def text(column: Column | str) -> Column:
    """The column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def squeeze(column: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(column, f"{SPACE}+", " "))


def tokens(column: Column) -> Column:
    """Words of a squeezed text; none of an empty one."""
    return F.filter(F.split(column, " "), lambda t: t != "")


def words_of(values: list[str]) -> Column:
    """A literal array of strings."""
    return F.array(*[F.lit(v) for v in values])


def any_of(values: list[str]) -> str:
    return "|".join(re.escape(v) for v in values)


def among(column: Column, values: list[str]) -> Column:
    return column.isin(*values)


def first(column: Column) -> Column:
    """The first element or the empty string."""
    return F.coalesce(F.try_element_at(column, F.lit(1)), F.lit(""))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` refers to it."""

    def once(x: Column) -> Column:
        return use(x)

    return F.element_at(F.transform(F.array(value), once), 1)


def _grams(column: Column, n: int, kind: str, gram: Callable[[Column, Column], Column], whole: Callable[[Column], Column]) -> Column:
    def made(plain: Column) -> Column:
        size = F.char_length(plain)
        every = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: gram(plain, i))
        return F.when(size == 0, F.array().cast(kind)).when(size < n, F.array(whole(plain))).otherwise(F.array_distinct(every))

    return bind(F.lower(F.regexp_replace(column, f"{SPACE}+", "")), made)


def ngrams(column: Column, n: int) -> Column:
    """Distinct n-grams of a text's lower-cased characters without white space.

    A shorter text is its own and only n-gram, an empty one has none.
    """
    return _grams(column, n, "array<string>", lambda plain, i: F.substr(plain, i, F.lit(n)), lambda plain: plain)


def trigram_codes(column: Column) -> Column:
    """``ngrams(column, 3)`` as numbers: code points of 21 bits each, so that equal codes are equal 3-grams."""

    def code(plain: Column, i: Column | int) -> Column:
        points = [F.ascii(F.substr(plain, F.lit(k) + i, F.lit(1))).cast("long") for k in range(3)]
        return F.shiftleft(points[0], 42) + F.shiftleft(points[1], 21) + points[2]

    return _grams(column, 3, "array<bigint>", code, lambda plain: code(plain, 1))


def is_indic(column: Column) -> Column:
    """Whether the text has a character of one of the Indic scripts."""
    from corvane.functions.vocab import INDIC_SCRIPTS

    return F.coalesce(column, F.lit("")).rlike("|".join(rf"\p{{Is{s}}}" for s in INDIC_SCRIPTS))


def ascii_fold(column: Column) -> Column:
    """The text's ASCII characters alone, for comparing with byte-based engines."""
    return F.regexp_replace(column, r"[^\x00-\x7F]", "")
