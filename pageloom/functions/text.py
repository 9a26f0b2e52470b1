"""Text helpers shared by extraction, validation and page summaries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lets import shared

# Whitespace as Python's str.strip() sees it: Unicode White_Space plus the four
# ASCII separators U+001C..U+001F, which Java's class leaves out.
WS = r"[\s\x1c-\x1f]"


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{WS}+|{WS}+\z", "")


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"(?U){WS}+", " "))


def is_blank(c: Column) -> Column:
    """NULL or whitespace only."""
    return ~F.coalesce(c.cast("string").rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def sha_prefix(c: Column, n: int = 16) -> Column:
    return F.substring(F.sha2(c, 256), 1, n)


def clip(c: Column, n: int) -> Column:
    """First ``n`` characters, with an ellipsis when something was cut off."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def looks_hashed(token: Column) -> Column:
    """A build-hash token: it has a digit and four hex characters in a row."""
    low = F.lower(token)
    return low.rlike(r"(?U)\d") & low.rlike("[0-9a-f]{4,}")


HASHED_PLACEHOLDER = "·hashed"


def stable_token(token: Column) -> Column:
    """Replace every hashed run of ``[A-Za-z0-9_-]`` at the token start by a placeholder."""
    head = F.regexp_extract(token, r"\A[A-Za-z0-9_-]+", 0)
    return F.when(
        (head != "") & looks_hashed(head),
        F.concat(F.lit(HASHED_PLACEHOLDER), F.substr(token, F.length(head) + 1)),
    ).otherwise(token)


def html_escape(c: Column) -> Column:
    """Escape text for element content and double-quoted attributes."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, entity in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def percent(rate: Column) -> Column:
    """Whole percent with ties to even, e.g. 0.125 -> '12%'."""
    return F.concat(F.bround(rate * 100, 0).cast("bigint").cast("string"), F.lit("%"))


@shared
def float_text(d: Column) -> Column:
    """A double in its shortest decimal form: '1.0', '150000.5', '1e+16', '1.5e-05'."""
    size = F.abs(d)
    plain = d.cast("string")
    digits = d.cast("decimal(38,18)").cast("string")
    spelled = F.regexp_replace(F.regexp_replace(digits, r"0+\z", ""), r"\.\z", ".0")
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"\A(-?[\d.]+)E", 1), r"\.0\z", "")
    sign = F.when(F.contains(plain, F.lit("E-")), F.lit("-")).otherwise(F.lit("+"))
    power = F.regexp_extract(plain, r"E-?(\d+)\z", 1)
    power = F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power)
    return (
        F.when(plain.rlike("[A-Z]{2}|NaN|Inf"), F.lower(plain))
        .when(~F.contains(plain, F.lit("E")), plain)
        .when((size >= 1e-4) & (size < 1e16), spelled)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, power))
    )
