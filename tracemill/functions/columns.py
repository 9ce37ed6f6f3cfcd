"""Column helpers: missing values, rounding, names, tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Objectives of this size or more mark a failed evaluation.
SENTINEL = 1e8


def nan_to_null(df: DataFrame) -> DataFrame:
    """Every NaN of a floating-point column as null, so that one value stands for missing."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def stamped(column: str | Column) -> Column:
    """True where an id is there and not empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c != "", F.lit(False))


def round_half_even(column: str | Column, digits: int = 10) -> Column:
    return F.bround(column, digits)


def words(text: str | Column) -> Column:
    """Corpus tokens: split at white space, all but letters, digits, _ and - dropped, lower-cased, empty ones out."""
    cleaned = F.transform(F.split(text, r"\s+"), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}_\-]", "")))
    return F.filter(cleaned, lambda w: w != "")


def normal_title(text: str | Column) -> Column:
    """Lower case, entities for & < > undone, asterisks out, single spaces."""
    out = F.col(text) if isinstance(text, str) else text
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(F.lower(F.replace(out, F.lit("*"), F.lit(""))), r"\s+", " "))


def slug(text: str | Column) -> Column:
    """Runs of anything but ASCII letters and digits as one underscore."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_")


def token_estimate(text: str | Column) -> Column:
    """A third of the characters and four: what a message is taken to cost."""
    return F.floor(F.char_length(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))) / 3).cast("long") + 4


def content_revision(text: str | Column) -> Column:
    """First eight hex digits of the text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 8)


def natural_key(text: str | Column) -> list[Column]:
    """Sort keys under which H2 stands before H10, and a2b3 before a2b10: each run of digits counts as a number, which stands before text; the text itself decides between equals."""
    c = F.col(text) if isinstance(text, str) else text

    def part(p: Column) -> Column:
        digits = F.regexp_replace(p, "^0+(?=.)", "")
        return F.when(p.rlike("^[0-9]"), F.concat(F.lit("\u0000"), F.lpad(F.length(digits).cast("string"), 9, "0"), digits)).otherwise(p)

    return [F.transform(F.regexp_extract_all(c, F.lit("([0-9]+|[^0-9]+)"), 1), part), c]
