"""Text, date and key expressions. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim every kind of white space; Spark's own trim only takes blanks."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for NULL, empty and white-space-only text."""
    return F.coalesce(strip(c) == "", F.lit(True))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_of(*cols: Column | str) -> Column:
    """The first alternative that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in cols])


def eq_ci(c: Column | str, value: str | Column) -> Column:
    value = F.lit(value) if isinstance(value, str) else value
    return F.lower(_col(c)) == F.lower(value)


def contains_ci(c: Column | str, term: str, pattern: bool = False) -> Column:
    """Case-insensitive containment. `pattern=True` gives LIKE wildcards their meaning."""
    if pattern:
        return F.lower(_col(c)).like(f"%{term.lower()}%")
    return F.lower(_col(c)).contains(term.lower())


def starts_with_any(c: Column | str, prefixes: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(_col(c), F.lit(p)) for p in prefixes])


def has_word(c: Column | str, words: Sequence[str]) -> Column:
    """One of the words or phrases occurs, not just as part of a longer word."""
    return F.lower(_col(c)).rlike(r"\b(" + "|".join(map(_quoted, words)) + r")\b")


def after_last(c: Column | str, phrase: str) -> Column:
    return F.substring_index(_col(c), phrase, -1)


def drop_words(c: Column | str, words: Sequence[str]) -> Column:
    """Remove whole words and collapse the gaps they leave."""
    without = F.regexp_replace(_col(c), r"\b(" + "|".join(map(_quoted, words)) + r")\b", " ")
    return strip(F.regexp_replace(without, r"\s+", " "))


def split_first(c: Column | str, separator: str) -> Column:
    """Split at the first occurrence only: an array of one or two texts."""
    return F.split(_col(c), _quoted(separator), 2)


def _quoted(text: str) -> str:
    return r"\Q" + text + r"\E"


def preview(c: Column | str, length: int) -> Column:
    """The first characters, with dots where something was cut off."""
    c = _col(c)
    return F.when(F.length(c) > length, F.concat(F.substring(c, 1, length), F.lit("..."))).otherwise(c)


def template_url(prefix: str, c: Column | str, suffix: str) -> Column:
    """prefix + lower-cased code + suffix; NULL for a NULL code."""
    return F.concat(F.lit(prefix), F.lower(_col(c)), F.lit(suffix))


def override(value: Column | str, key: Column | str, exceptions: Mapping[str, str]) -> Column:
    """Replace a looked-up value for a few listed keys."""
    out = _col(value)
    for k, v in reversed(list(exceptions.items())):
        out = F.when(_col(key) == k, F.lit(v)).otherwise(out)
    return out


def surrogate_key(source: str | Column, *cols: Column | str) -> Column:
    """A 36-character key that is the same on every run for the same business key."""
    source = F.lit(source) if isinstance(source, str) else source
    parts = [F.coalesce(_col(c).cast("string"), F.lit("\x00")) for c in cols]
    digest = F.md5(F.concat_ws("\x1f", source, *parts))
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts])


def parse_day(c: Column | str) -> Column:
    """The day before a blank or `T`; NULL when it is not a date. Months and days may have one digit."""
    day = F.regexp_extract(_col(c), r"^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})(?:[ T]|$)", 1)
    return F.to_date(F.try_to_timestamp(day, F.lit("yyyy-M-d")))


def day_text(c: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.date_format(_col(c), pattern)


def to_int(c: Column | str) -> Column:
    """Whole number when the text consists of digits only, else NULL."""
    c = _col(c)
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))


def percent_match(similarity: Column | str) -> Column:
    s = _col(similarity)
    shown = F.concat(F.round(s * 100, 0).cast("bigint").cast("string"), F.lit("% match"))
    return F.when(s != 0, shown)
