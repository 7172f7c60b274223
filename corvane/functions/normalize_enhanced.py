"""Normalisers of variant C: lighter on names, writing address words out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import vocab
from corvane.functions.normalize import bare, is_null_like, locality_tokens, numeric_tokens
from corvane.functions.text import any_of, first, java, squeeze, strip_accents, text, tokens


def country(column: Column) -> Column:
    """Known names by their usual spelling, others in upper case, missing ones UNKNOWN."""
    trimmed = F.trim(column)
    known = F.create_map(*[F.lit(x) for pair in vocab.COUNTRIES_ENHANCED.items() for x in pair])
    return F.when(is_null_like(trimmed, vocab.NULL_LIKE_ENHANCED), F.lit("UNKNOWN")).otherwise(F.coalesce(F.try_element_at(known, F.lower(trimmed)), F.upper(trimmed)))


def name(column: Column) -> Column:
    out = F.lower(strip_accents(text(column)))
    out = squeeze(F.regexp_replace(F.regexp_replace(out, "&", " and "), java(r"[^\w\s]"), " "))
    return F.when(is_null_like(F.trim(column), vocab.NULL_LIKE_ENHANCED), F.lit("")).otherwise(out)


def core_name(column: Column) -> Column:
    """The name without legal words at its end and one article at its front; one word always stays."""
    out = F.regexp_replace(text(column), f"^(\\S+(?: \\S+)*?)(?: (?:{any_of(vocab.LEGAL_WORDS_ENHANCED)}))+$", "$1")
    return F.regexp_replace(out, "^(?:the|a|an) (?=.)", "")


def address(column: Column) -> Column:
    """An address in lower case without accents; abbreviations written out word by word."""
    clean = squeeze(F.regexp_replace(F.lower(strip_accents(text(column))), "[#,.]", " "))
    known = F.create_map(*[F.lit(x) for pair in vocab.ABBREVIATIONS.items() for x in pair])

    def full(t: Column) -> Column:
        plain = F.regexp_replace(t, "^[ ,./-]+|[ ,./-]+$", "")
        return F.coalesce(F.try_element_at(known, plain), plain)

    words = F.filter(F.transform(tokens(clean), full), lambda t: t != "")
    return F.when(is_null_like(F.trim(column), vocab.NULL_LIKE_ENHANCED), F.lit("")).otherwise(F.array_join(words, " "))


def postal_code(column: Column, land: Column) -> Column:
    """The last number with the country's postal length, else the last of five or six digits."""
    clean = F.reverse(F.transform(tokens(text(column)), bare))
    upper = F.upper(F.coalesce(land, F.lit("")))
    six = F.try_element_at(F.filter(clean, lambda t: t.rlike(r"^[1-9]\p{Nd}{5}$")), F.lit(1))
    five = F.try_element_at(F.filter(clean, lambda t: t.rlike(r"^\p{Nd}{5}$")), F.lit(1))
    either = F.try_element_at(F.filter(clean, lambda t: t.rlike(r"^\p{Nd}{5,6}$")), F.lit(1))
    own = F.when(upper.isin("INDIA", "IN"), six).when(upper.isin("US", "USA", "FRANCE", "FR"), five)
    return F.coalesce(own, either, F.lit(""))


def building_no(column: Column) -> Column:
    """First token of one to six digits."""
    return first(F.filter(F.transform(tokens(text(column)), bare), lambda t: t.rlike(r"^\p{Nd}{1,6}$")))


def localities(column: Column) -> Column:
    return locality_tokens(column, vocab.LOCALITY_STOP_ENHANCED)


__all__ = ["address", "building_no", "core_name", "country", "localities", "name", "numeric_tokens", "postal_code"]
