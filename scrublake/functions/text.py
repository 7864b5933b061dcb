"""Text functions that follow a browser's rules: its white space, ASCII word boundaries, rounding half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A browser's white space, its \b over ASCII words, and "not glued to a letter or digit".
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
B = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
NUM_START = r"(?<![A-Za-z0-9])"
NUM_END = r"(?![A-Za-z0-9])"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def collapse(x: Column) -> Column:
    """White space runs become a space; none at the ends."""
    return F.trim(F.regexp_replace(x, f"{WS}+", " "))


def or_else(*xs: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in xs), F.lit(""))


def fingerprint(x: Column) -> Column:
    """Lower-case letters and digits with look-alikes folded together."""
    return F.translate(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""), "oilzsbgau", "111258940")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """Whether the digits of x, 13 to 19 of them, pass the Luhn check."""
    d = digits(x)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded half up, also below zero."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5) / scale


def around(text: Column, start: Column, end: Column, window: int = 48) -> Column:
    """The text from ``window`` characters before start to as many after end, collapsed."""
    begin = F.greatest(start - window, F.lit(0))
    return collapse(F.substring(text, begin + 1, F.least(F.length(text), end + window) - begin))


def matches(text: Column, pattern: str) -> Column:
    """All matches of a pattern that can't be empty, in order: array of value, start, end (in characters, end exclusive).

    Spark gives matches without places; what lies between them, from a split by the same pattern, gives these.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, v: F.struct(v.alias("value"), F.length(g).alias("gap"), F.length(v).alias("size")))
    empty = F.array().cast("array<struct<value:string,start:int,end:int>>")
    walked = F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, m: F.struct(
            (acc["at"] + m["gap"] + m["size"]).alias("at"),
            F.concat(acc["out"], F.array(F.struct(m["value"].alias("value"), (acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["size"]).alias("end")))).alias("out"),
        ),
    )
    return walked["out"]
