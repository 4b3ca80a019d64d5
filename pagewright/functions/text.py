"""Text and hash functions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"


def strip(c: Column) -> Column:
    """All white space at both ends, as tabs and newlines too."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), 0)


def tokens(c: Column) -> Column:
    """How many stretches without white space there are."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def title_case(c: Column) -> Column:
    """A capital after every sign that is no letter, small letters else: ``core-web`` is ``Core-Web``, where initcap has ``Core-web``."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")


def keywords(c: Column, stop: tuple[str, ...]) -> Column:
    """Distinct lower-case words of over 3 letters that aren't stop words."""
    return F.array_distinct(F.filter(words(F.lower(c)), lambda w: (F.length(w) > 3) & ~w.isin(*stop)))


def hash64(c: Column) -> Column:
    """The low 64 bits of MD5 as a signed number."""
    return F.conv(F.substring(F.md5(c), 17, 16), 16, -10).cast("bigint")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
