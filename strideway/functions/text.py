"""Cleaning and parsing of source text, as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What the two match normalisers leave out (they differ on purpose), and the words for yes and no.
STRIPPED_FOR_RECORDS = r"[\s　・,，.。()（）-]"
STRIPPED_FOR_FACILITIES = r"[\s　・,，、()（）]"
YES, NO = ("有", "○"), ("無", "×")
WEEKDAY_SEPARATOR = " / "
#: What is taken off the ends of a text: the white space and line ends of Unicode, and the byte order mark.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def match_text(c: Column, stripped: str = STRIPPED_FOR_RECORDS) -> Column:
    """NFKC, lower case, without separators; blank text gives ''. Spark has no normaliser of its own."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(c, F.lit("")))), stripped, "")


def ascii_match_text(c: Column, stripped: str = STRIPPED_FOR_RECORDS) -> Column:
    """The same for text that is known to be ASCII, without Python."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), stripped, "")


def nullable(c: Column, null_word: str | None = None) -> Column:
    """Trimmed text; blank (or exactly null_word) is null."""
    t = trimmed(c)
    out = F.nullif(t, F.lit(""))
    return F.nullif(out, F.lit(null_word)) if null_word else out


def mark(c: Column) -> Column:
    """有 or ○ is true, 無 or × false, anything else unknown."""
    t = trimmed(c)
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def tristate(c: Column) -> Column:
    """Exactly true or false; anything else is null. What is neither of them, nor blank, nor exactly `null`, is an error."""
    t = trimmed(c)
    return F.when(t == "true", True).when(t == "false", False)


def tristate_invalid(c: Column) -> Column:
    return ~F.coalesce(trimmed(c), F.lit("")).isin("true", "false", "null", "")


def number(c: Column) -> Column:
    """A plain decimal number, or null; the guard keeps out NaN, Infinity and type suffixes."""
    t = trimmed(c)
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def compact_id(*parts: Column) -> Column:
    """Parts joined by -, blanks as 0, without anything but letters, digits and -."""
    full = [F.coalesce(F.nullif(F.trim(p), F.lit("")), F.lit("0")) for p in parts]
    return F.regexp_replace(F.concat_ws("-", *full), r"[^\p{L}\p{N}-]", "")


def year_month(c: Column) -> Column:
    """yyyymm as yyyy-mm, where it is six digits."""
    return F.when(c.rlike(r"^\d{6}$"), F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2)))


def opening_hours(*days: Column) -> Column:
    """Distinct cells that aren't blank, in order."""
    filled = F.filter(F.array(*[F.nullif(F.trim(d), F.lit("")) for d in days]), lambda d: d.isNotNull())
    return F.nullif(F.array_join(F.array_distinct(filled), WEEKDAY_SEPARATOR), F.lit(""))


def hours_between(start: Column, end: Column, note: Column) -> Column:
    """From start to end, where either is known, with 不明 for one that isn't, and the note behind."""
    known = lambda c: F.coalesce(nullable(c), F.lit("不明"))
    span = F.when(nullable(start).isNotNull() | nullable(end).isNotNull(), F.concat(known(start), F.lit("〜"), known(end)))
    return F.concat(span, F.coalesce(F.concat(F.lit("（"), nullable(note), F.lit("）")), F.lit("")))


def instant(c: Column) -> Column:
    """An ISO date and time with seconds and an offset, on a real calendar day; anything else is null."""
    shape = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,3})?(Z|[+-]\d{2}:\d{2})$"
    return F.when(c.rlike(shape), F.try_to_timestamp(c))


def iso_text(ts: Column) -> Column:
    return F.date_format(F.to_utc_timestamp(ts, F.expr("current_timezone()")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def evidence_ok(c: Column, urn_prefix: str) -> Column:
    """No reference at all, one under urn_prefix, or an https address."""
    return c.isNull() | c.startswith(urn_prefix) | F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")) == "https", F.lit(False))


def formula_safe(c: Column) -> Column:
    """Text that a spreadsheet won't take for a formula."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)
