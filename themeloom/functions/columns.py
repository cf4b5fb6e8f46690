"""Column functions: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
HEX = "0123456789abcdef"


def r6(x: Column | str) -> Column:
    """Rounded to six places, without a negative zero."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def terms(text: Column | str) -> Column:
    """Lower-case words of two characters or more; null text has null terms."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays of numbers; null if either is null or their lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.when(size.isNotNull(), F.lit(0.0)))


def hash_vector(term: Column | str) -> Column:
    """32 odd integers from -15 to 15, the hex digits of the term's md5: a random projection whose sums are exact."""
    digits = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.substring(F.md5(term), i + 1, F.lit(1)))
    return F.transform(digits, lambda c: F.instr(F.lit(HEX), c) * 2 - 17)


def clean(text: Column | str, most: int = 300) -> Column:
    """White space collapsed; beyond `most` characters, cut and followed by three dots."""
    x = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def dress_html(text: Column | str, most: int = 900) -> Column:
    """Spaces collapsed, cut to `most` characters, the five characters that HTML reserves escaped."""
    x = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, most)
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#39")):
        x = F.replace(x, F.lit(c), F.lit(f"&{name};"))
    return x


def strip_think(text: Column | str) -> Column:
    """Without what stands between <think> and </think>."""
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
