"""Fill-in-the-middle examples by escaped marker injection.

A text's units are its lines. A delimiter that no text can hold once it is escaped
is put after each unit by one regular expression; counting it gives the number of
units, and the parts up to its k-th place are the prefix, the middle and the
suffix. All of it is column expressions, row by row: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = r"[^\n]*\n|[^\n]+"
#: After each unit, and before a letter that stands for one of the two in a text.
DELIMITER, ESCAPE = "\x01", "\x02"


def escaped(text: Column) -> Column:
    """``text`` without delimiters; the escape is followed by a letter wherever it stands."""
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """What was escaped, without the delimiters that were put in since."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def draw(digest: Column, k: int) -> Column:
    """The k-th group of 8 hex digits, unsigned."""
    return F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint")


def assembled(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column) -> Column:
    """The example: the text itself, or the three parts after their markers, prefix first or suffix first."""
    first, second, third = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    psm, spm = F.concat(first, prefix, second, suffix, third, middle), F.concat(second, suffix, first, prefix, third, middle)
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)


def restored(form: Column, output: Column) -> Column:
    """The text of an example, from the example and its form alone.

    A text of the two marked forms holds no marker, and none can arise where a part
    meets a marker, as ``<`` only begins one; so each marker's first place is its own.
    """

    def between(start: str, end: str | None) -> Column:
        after = F.substring(output, F.locate(start, output) + len(start), F.length(output))
        return after if end is None else F.substring_index(after, end, 1)

    psm = F.concat(between(PREFIX, SUFFIX), between(MIDDLE, None), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), between(MIDDLE, None), between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def transform(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """``doc_id, n, form, prefix, middle, suffix, output`` of each row of ``documents``.

    The cuts and the form are drawn from the id alone, so a run that is repeated or
    a task that is run again gives the same examples, and rows of one id are cut by
    the same draws. ``rate`` in 100 documents are transformed, ``spm`` in 100 of
    these with the suffix first. A null text counts as empty and a null id as the
    empty text. An empty text, one that holds a marker, and one that isn't drawn
    stay as they are: ``form`` is ``plain`` and the parts are null. An empty table
    gives an empty result; other columns don't matter.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), digest.alias("digest"))
    marked = rows.withColumn("marked", F.regexp_replace(escaped(F.col("text")), UNIT, "$0" + DELIMITER))
    counted = marked.withColumn("n", (F.length("marked") - F.length(F.replace("marked", F.lit(DELIMITER), F.lit("")))).cast("bigint"))
    cuts = [F.pmod(draw(F.col("digest"), k), F.col("n") + 1).cast("int") for k in (0, 1)]
    holds = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    plain = (F.col("text") == "") | holds | (draw(F.col("digest"), 2) % 100 >= rate)
    form = F.when(plain, "plain").when(draw(F.col("digest"), 3) % 100 < spm, "spm").otherwise("psm")
    ranked = counted.select("id", "text", "marked", "n", form.alias("form"), F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))
    # the parts end after the a-th and the b-th delimiter, which aren't part of the first two
    upto = ranked.withColumn("one", F.call_function("substring_index", "marked", F.lit(DELIMITER), "a")).withColumn("two", F.call_function("substring_index", "marked", F.lit(DELIMITER), "b"))
    middle, suffix = F.expr("substring(two, length(one) + 1)"), F.expr("substring(marked, length(two) + 1)")
    parts = upto.select("id", "text", "n", "form", unescaped(F.col("one")).alias("prefix"), unescaped(middle).alias("middle"), unescaped(suffix).alias("suffix"))
    shown = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix", "middle", "suffix")]
    return parts.select(F.col("id").alias(id_col), "n", "form", *shown, assembled(*(F.col(c) for c in ("form", "prefix", "middle", "suffix", "text"))).alias("output"))


def digests(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256`` of each row; lengths in code points, null if plain."""
    done = transform(documents, id_col, text_col, **settings)
    sizes = [F.length(c).cast("bigint").alias(f"{c}_chars") for c in ("prefix", "middle")]
    back = restored(F.col("form"), F.col("output"))
    return done.select(id_col, "n", "form", *sizes, F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
