"""Title functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators U+001C-U+001F.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse_space(t: Column) -> Column:
    """Runs of white space become one space; none at either end."""
    return F.trim(F.regexp_replace(t, _SPACE, " "))


def plain_apostrophes(t: Column) -> Column:
    return F.translate(collapse_space(t), "‘’ʼ`", "''''")


def without_suffix(t: Column) -> Column:
    """Without a trailing "(disambiguation)" in any case, once."""
    return F.regexp_replace(plain_apostrophes(t), r"(?i)\s+\(disambiguation\)$", "")


def fold(t: Column) -> Column:
    """Case folding: differs from Unicode's full table on about 200 code points, mostly Cherokee."""
    # The replacement changes nothing; it keeps the optimizer from taking lower(upper(x)) for lower(x).
    return F.lower(F.replace(F.upper(F.lower(t)), F.lit("\u0000"), F.lit("\u0000")))


def family_key(t: Column) -> Column:
    """Titles that may name the same page share this key."""
    return fold(without_suffix(t))


def is_title_case(t: Column) -> Column:
    """No lower-case letter after a character without case, no upper-case letter after one with case."""
    cased = r"[\p{IsLowercase}\p{IsUppercase}\p{Lt}]"
    return ~t.rlike(rf"(?<!{cased})\p{{IsLowercase}}|(?<={cased})[\p{{IsUppercase}}\p{{Lt}}]")


def preference(t: Column) -> Column:
    """The smaller, the better as the name of a family: no suffix, title case, short, then by folded text."""
    s = plain_apostrophes(t)
    return F.struct(
        F.when(without_suffix(t) != s, 1).otherwise(0).alias("suffixed"),
        F.when(is_title_case(s), -1).otherwise(0).alias("cased"),
        F.length(without_suffix(t)).alias("length"),
        fold(s).alias("folded"),
    )


def match_key(t: Column) -> Column:
    """Key under which requested and returned titles are matched: underscores are spaces, case is folded."""
    return fold(collapse_space(F.replace(t, F.lit("_"), F.lit(" "))))


def page_path(t: Column) -> Column:
    """Percent-encoded title with underscores for spaces; parentheses stay."""
    out = F.url_encode(F.replace(t, F.lit(" "), F.lit("_")))
    for a, b in (("%28", "("), ("%29", ")"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def category_name(t: Column) -> Column:
    """Without a leading "Category:", once."""
    return F.regexp_replace(t, "^Category:", "")
