"""Scalar text functions and predicates as Column expressions; all but the composed form stay in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes.
JAPANESE = "[ぁ-ゖァ-ヺ一-龯]"
ENGLISH = "[A-Za-z]"
NUMBER = "[0-9]"
SYMBOL_OR_NUMBER = r"\A[!-@\[-`{-~]*\z"
NAME = r"\A[\p{L}\p{M}\p{N}\p{Zs}\t\n\r./-]*\z"
SPACE = r"(?U)\s+"
EDGES = r"(?U)^\s+|\s+$"


def col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def composed(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def recomposed(text: Column | str) -> Column:
    """The composed form (NFC) of a text with a character from U+0300 on, as only such can change; null for the others."""
    t = col(text)
    return F.pandas_udf(composed, "string")(F.when(t.rlike(r"[^\x00-\x{2FF}]"), t))


def canonical(text: Column | str) -> Column:
    """The composed form (NFC), by which canonically equivalent texts are equal.

    The JVM offers no such function to expressions. Only texts with a character from
    U+0300 on can change, and only they are sent to Python; the others go as nulls.
    """
    return F.coalesce(recomposed(text), col(text))


def trimmed(text: Column | str) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(col(text), EDGES, "")


def one_line(text: Column | str) -> Column:
    """Carriage returns dropped, other runs of white space one space, trimmed."""
    return trimmed(F.regexp_replace(F.regexp_replace(col(text), "\r", ""), SPACE, " "))


def collapsed(text: Column | str) -> Column:
    """Runs of white space, ideographic spaces too, one space; trimmed."""
    return trimmed(F.regexp_replace(col(text), SPACE, " "))


def fragments(text: Column | str) -> Column:
    """Array of the trimmed parts between line ends, tabs and double spaces; empty ones dropped."""
    return F.filter(F.transform(F.split(col(text), r"[\n\r\t]|  "), trimmed), lambda x: x != "")


def lines(text: Column | str) -> Column:
    """Array of lines; every kind of line end counts."""
    return F.split(col(text), r"\R")


def clusters(text: Column | str) -> Column:
    """Length in grapheme clusters. Below U+0300 each code point is one, but for a carriage return before a line feed."""
    t = col(text)
    return F.when(~t.rlike(r"[^\x00-\x0C\x0E-\x{2FF}]"), F.length(t)).otherwise(F.regexp_count(t, F.lit(r"\X")))


def n_bytes(text: Column | str) -> Column:
    return F.octet_length(col(text))


def let(value: Column, make) -> Column:
    """``make`` of a value that is computed once; a column used inside a lambda is else computed for each element."""
    return F.element_at(F.transform(F.array(value), make), 1)


def char_ngrams(text: Column | str, n: int = 3) -> Column:
    """Character n-grams; a shorter text is its own, an empty one has none."""

    grams = lambda t: F.regexp_extract_all(t, F.lit(r"(?s)(?=(.{%d}))." % n), 1)
    return let(col(text), lambda t: F.when(t == "", F.array().cast("array<string>")).when(F.length(t) < n, F.array(t)).otherwise(grams(t)))


def count_japanese(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(JAPANESE))


def count_english(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(ENGLISH))


def count_numbers(text: Column | str) -> Column:
    return F.regexp_count(col(text), F.lit(NUMBER))


def is_symbol_or_number(text: Column | str) -> Column:
    """Only ASCII symbols and digits; true of the empty text. A space is neither."""
    return col(text).rlike(SYMBOL_OR_NUMBER)


def is_name(text: Column | str) -> Column:
    """Only letters, digits, white space, full stop, slash and hyphen."""
    return col(text).rlike(NAME)


def seeded_hash(text: Column | str, seed: int) -> Column:
    """One of a family of 64-bit hashes."""
    return F.xxhash64(col(text), F.lit(seed))


def similar_partial(shorter: Column, longer: Column) -> Column:
    """Whether two inputs share 60 % of the shorter one's length, two characters at least, from the start."""
    n = F.length(shorter)
    need = F.greatest(F.lit(2), F.ceil(n * 3 / 5).cast("int"))
    return (n >= 2) & (F.length(longer) > n) & (F.left(shorter, need) == F.left(longer, need))


def close_in_length(shorter: Column, longer: Column) -> Column:
    """Whether the shorter has 70 % of the longer's length; integers, so exact."""
    return F.length(shorter) * 10 >= F.length(longer) * 7


def positional_jaccard(a: Column | str, b: Column | str) -> Column:
    """Share of equal places of two arrays, of the shorter's length; 0 if one is empty."""
    a, b = col(a), col(b)
    n = F.least(F.size(a), F.size(b))
    same = F.size(F.filter(F.zip_with(F.slice(a, 1, F.greatest(n, F.lit(0))), F.slice(b, 1, F.greatest(n, F.lit(0))), lambda x, y: x == y), lambda x: x))
    return F.when(n > 0, same / n).otherwise(F.lit(0.0))


def length_within(text: Column | str, least: int, most: int | None = None) -> Column:
    """Non-empty, and between the lengths, in grapheme clusters."""
    n = clusters(text)
    return (n >= max(least, 1)) & (n <= most if most is not None else F.lit(True))


def app_of(file_name: Column | str) -> Column:
    """A file's name without its extension."""
    return F.regexp_replace(col(file_name), r"\.[^.]*$", "")


def extension_of(file_name: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(file_name), r"\.([^.]*)$", 1))


def import_name(file_name: Column | str, at: Column) -> Column:
    """The name under which an import is recorded."""
    return F.concat(F.lit("imported_"), col(file_name), F.lit("_"), at.cast("long").cast("string"), F.lit(".jsonl"))


def label(text: Column | str) -> Column:
    return F.substring(col(text), 1, 10)


def composite_key(app: Column | str, text: Column | str) -> Column:
    """The two joined by a hyphen, for parity only: pairs can collide, so operators group by both columns."""
    return F.concat_ws("-", col(app), col(text))


def from_reference_seconds(seconds: Column | str) -> Column:
    """Timestamp of seconds since 2001-01-01 UTC."""
    return F.timestamp_micros(((col(seconds) + F.lit(978307200.0)) * 1000000).cast("bigint"))


def to_reference_seconds(ts: Column | str) -> Column:
    return F.unix_micros(col(ts)) / F.lit(1e6) - F.lit(978307200.0)
