"""Column helpers: counter-based randomness, Python-like text functions, and formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space only, so that Spark and DuckDB agree.
SPACE = r"[ \t\n\r\f\x0B]"


def hex_number(hexed: Column, digits: int) -> Column:
    """The number that the first hex digits write (13 digits fit a long and a double)."""
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("long")


def uniform(*parts: Column | str | int | float) -> Column:
    """A number in [0, 1) that depends on its parts only: the same for any partitioning or order of calls."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in cols])
    return hex_number(F.md5(text), 13) / F.lit(float(2**52))


def limit(p: Column) -> Column:
    """The 13 hex digits under which lie the hashes of ``uniform`` numbers below ``p``, a number in [0, 1)."""
    return F.lower(F.lpad(F.hex(F.ceil(p * F.lit(float(2**52)))), 13, "0"))


def below(text: Column, limit: Column | str) -> Column:
    """Whether the ``uniform`` number of a text is below the one of a ``limit``: digits are compared and no number is made of them."""
    return F.md5(text) < limit


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are evaluated once, however often later expressions use them."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    with_all = df.select("*", F.explode(F.array(made)).alias("__fixed"))
    return with_all.select(*df.columns, *[F.col(f"__fixed.{n}").alias(n) for n in columns])


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def words_only(text: Column) -> Column:
    """Lower-case letters and digits of ASCII; anything else is one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def fingerprint(question: Column) -> Column:
    return F.substring(F.sha2(words_only(question), 256), 1, 16)


def text_fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def ratio(part: Column, whole: Column) -> Column:
    """Their quotient, 0 for an empty whole."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def signed_gap(correct: Column, wrong: Column) -> Column:
    """Relative difference of the lengths of two squeezed texts."""
    c, w = F.length(squeezed(correct)), F.length(squeezed(wrong))
    return (c - w).cast("double") / F.greatest(c, w, F.lit(1)).cast("double")


def finite(x: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def signed(x: Column, digits: int = 3) -> Column:
    return F.format_string(f"%+.{digits}f", x)


def percent(x: Column) -> Column:
    return F.format_string("%.1f%%", x * 100)


def interval(lo: Column, hi: Column) -> Column:
    """An interval as text; n/a without one."""
    text = F.concat(F.lit("["), signed(lo), F.lit(", "), signed(hi), F.lit("]"))
    return F.when(lo.isNull() | hi.isNull() | F.isnan(lo) | F.isnan(hi), "n/a").otherwise(text)


def redacted(text: Column, secrets: list[str]) -> Column:
    """Each non-empty secret replaced literally."""
    for secret in secrets:
        if secret:
            text = F.replace(text, F.lit(secret), F.lit("[redacted]"))
    return text
