"""Free-form date text to ISO text, without a Python worker."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

from .lets import let, shared
from .text import trim_ws

_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
# Clock part at the end of the text: hour, minute, second, fraction, am/pm, zone.
_CLOCK = (
    r"(?i)(?:(?<=\d)T|\A|[\s,]+)(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
    r"\s*(am|pm|a\.m\.|p\.m\.)?\s*(Z|UTC|GMT|[+-]\d{2}:?\d{2}|[+-]\d{2})?\z"
)
_COMPACT_CLOCK = r"\A(\d{8})T(\d{2})(\d{2})(\d{2})?(Z|[+-]\d{2}:?\d{2})?\z"

# Day layouts that name a complete date: pattern and the group numbers of (year, month, day).
_NUMERIC = [
    (r"\A(\d{4})[-/. ](\d{1,2})[-/. ](\d{1,2})\z", 1, 2, 3),
    (r"\A(\d{4})(\d{2})(\d{2})\z", 1, 2, 3),
]
_NAMED = [
    (rf"\A(\d{{1,2}}) {_MONTH} (\d{{4}})\z", 3, 2, 1),
    (rf"\A{_MONTH} (\d{{1,2}}) (\d{{4}})\z", 3, 1, 2),
    (rf"\A(\d{{4}}) {_MONTH} (\d{{1,2}})\z", 1, 2, 3),
]
_SLASHED = r"\A(\d{1,2})[-/. ](\d{1,2})[-/. ](\d{4})\z"
_MONTH_YEAR = rf"\A{_MONTH} (\d{{4}})\z"
_YEAR = r"\A(\d{4})\z"
_WEEKDAY = r"(?i)\A(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+"
_MONTH_WORDS = (
    r"\b(?:(jan)(?:uary)?|(feb)(?:ruary)?|(mar)(?:ch)?|(apr)(?:il)?|(may)|(jun)e?|(jul)y?|(aug)(?:ust)?"
    r"|(sep)(?:t(?:ember)?)?|(oct)(?:ober)?|(nov)(?:ember)?|(dec)(?:ember)?)\b\.?"
)
_SHORT_MONTH = " $1$2$3$4$5$6$7$8$9$10$11$12 "


def _num(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _month_no(name: Column) -> Column:
    return ((F.instr(F.lit("janfebmaraprmayjunjulaugsepoctnovdec"), name) + 2) / 3).cast("int")


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("int").alias("y"), month.cast("int").alias("m"), day.cast("int").alias("d"))


def _month_first(d: Column) -> Column:
    """Month first; swapped when the first number cannot be a month."""
    pair = F.struct(_num(d, _SLASHED, 1).alias("a"), _num(d, _SLASHED, 2).alias("b"))
    swap = lambda p: (p["a"] > 12) & (p["b"] <= 12)
    return let(
        pair,
        lambda p: _day(
            _num(d, _SLASHED, 3), F.when(swap(p), p["b"]).otherwise(p["a"]), F.when(swap(p), p["a"]).otherwise(p["b"])
        ),
    )


def _partial(d: Column, as_of: dt.date) -> list[tuple[Column, Column]]:
    """Layouts with missing parts, filled from ``as_of`` (the day is clipped to the month)."""
    year, month = _num(d, _MONTH_YEAR, 2), _month_no(F.regexp_extract(d, _MONTH_YEAR, 1))
    zero = F.lit(0)
    month_end = F.dayofmonth(F.last_day(F.to_date(F.try_make_timestamp(year, month, F.lit(1), zero, zero, zero))))
    return [
        (d.rlike(_MONTH_YEAR), _day(year, month, F.least(month_end, F.lit(as_of.day)))),
        (d.rlike(_YEAR), _day(_num(d, _YEAR, 1), F.lit(as_of.month), F.lit(as_of.day))),
        (d == "", _day(F.lit(as_of.year), F.lit(as_of.month), F.lit(as_of.day))),
    ]


def _day_parts(d: Column, as_of: dt.date | None) -> Column:
    """(y, m, d) of a day text, NULL when no layout fits."""
    named = d.rlike("[a-z]")
    layouts = [
        (named & d.rlike(p), _day(_num(d, p, y), _month_no(F.regexp_extract(d, p, m)), _num(d, p, g)))
        for p, y, m, g in _NAMED
    ]
    layouts += [(d.rlike(p), _day(_num(d, p, y), _num(d, p, m), _num(d, p, g))) for p, y, m, g in _NUMERIC]
    layouts.append((d.rlike(_SLASHED), _month_first(d)))
    if as_of is not None:
        layouts += _partial(d, as_of)
    out = F.when(*layouts[0])
    for layout in layouts[1:]:
        out = out.when(*layout)
    return out


def _spread_compact(t: Column) -> Column:
    """20240501T101112 with its clock written out."""
    part = lambda i: F.regexp_extract(t, _COMPACT_CLOCK, i)
    second = let(part(4), lambda s: F.when(s != "", F.concat(F.lit(":"), s)).otherwise(F.lit("")))
    spelled = F.concat(part(1), F.lit("T"), part(2), F.lit(":"), part(3), second, part(5))
    return F.when(t.rlike(_COMPACT_CLOCK), spelled).otherwise(t)


def _plain_day(d: Column) -> Column:
    """Day text in lower case, ordinals and punctuation gone, month names shortened."""
    letters = lambda x: x.rlike("[a-z]")
    spaced = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, _MONTH_WORDS, _SHORT_MONTH), r"[\s,\-/]+", " "))
    return let(
        F.regexp_replace(F.lower(d), r"(?<=\d)(?:st|nd|rd|th)\b", ""),
        lambda x: F.when(letters(x) & x.rlike(_MONTH_WORDS), spaced(x)).otherwise(F.regexp_replace(F.trim(x), r",\z", "")),
    )


def _no_clock(t: Column) -> Column:
    nothing, zero = F.lit(""), F.lit(0)
    return F.struct(
        _plain_day(t).alias("day"), zero.alias("hour"), zero.alias("minute"), zero.alias("second"),
        nothing.alias("micros"), nothing.alias("half"), nothing.alias("zone"),
    )


def _pieces(t: Column) -> Column:
    """Day text and clock parts; only text with a colon can hold a clock."""
    return F.when(F.contains(t, F.lit(":")), _with_clock(t)).otherwise(_no_clock(t))


def _with_clock(t: Column) -> Column:
    clock = lambda i: F.regexp_extract(t, _CLOCK, i)
    number = lambda i: F.coalesce(clock(i).try_cast("int"), F.lit(0))
    return F.struct(
        _plain_day(F.regexp_replace(t, _CLOCK, "")).alias("day"),
        number(1).alias("hour"), number(2).alias("minute"), number(3).alias("second"),
        F.rpad(F.substring(clock(4), 1, 6), 6, "0").alias("micros"),
        F.lower(F.regexp_replace(clock(5), r"\.", "")).alias("half"),
        F.upper(clock(6)).alias("zone"),
    )


def _hour(p: Column) -> Column:
    return (
        F.when((p["half"] == "pm") & (p["hour"] < 12), p["hour"] + 12)
        .when((p["half"] == "am") & (p["hour"] == 12), F.lit(0))
        .otherwise(p["hour"])
    )


def _offset(zone: Column) -> Column:
    minutes = F.when(F.length(zone) > 3, F.substring(zone, -2, 2)).otherwise(F.lit("00"))
    return (
        F.when(zone == "", F.lit(""))
        .when(zone.isin("Z", "UTC", "GMT"), F.lit("+00:00"))
        .otherwise(F.concat(F.substring(zone, 1, 3), F.lit(":"), minutes))
    )


def _iso(p: Column, day: Column) -> Column:
    hour = _hour(p)
    stamp = F.try_make_timestamp(day["y"], day["m"], day["d"], hour, p["minute"], p["second"])
    bad_half = (p["half"] != "") & ((p["hour"] > 12) | (p["hour"] == 0))
    text = F.concat(
        F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", day["y"], day["m"], day["d"], hour, p["minute"], p["second"]),
        F.when(p["micros"].isin("", "000000"), F.lit("")).otherwise(F.concat(F.lit("."), p["micros"])),
        _offset(p["zone"]),
    )
    return F.when(stamp.isNotNull() & ~bad_half & (p["second"] < 60), text)


# Days written out in full, each with how its ISO form is put together.
_YEARS, _MONTHS = "[1-9][0-9]{3}", "JanFebMarAprMayJunJulAugSepOctNovDec"
_NAMES = (
    "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?"
    "|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_ISO_DAY = rf"\A{_YEARS}-[0-9]{{2}}-[0-9]{{2}}\z"
_MONTH_FIRST_DAY = rf"\A(?:0[1-9]|1[0-2])/[0-9]{{2}}/{_YEARS}\z"
_NAMED_DAY = rf"\A{_NAMES} [0-9]{{1,2}}, {_YEARS}\z"
_DAY_NAMED = rf"\A[0-9]{{1,2}} {_NAMES} {_YEARS}\z"


def _full_day(c: Column) -> Column:
    """ISO form of a day in one of the usual full layouts; it may be no day of the calendar. Other texts give NULL."""
    year, word = F.substring(c, -4, 4), lambda i: F.split_part(c, F.lit(" "), F.lit(i))
    month = lambda name: F.substr(F.lit("01 02 03 04 05 06 07 08 09 10 11 12"), F.instr(F.lit(_MONTHS), F.substring(name, 1, 3)), F.lit(2))
    spelled = lambda y, m, d: F.concat(y, F.lit("-"), m, F.lit("-"), F.lpad(d, 2, "0"))
    return (
        F.when(c.rlike(_ISO_DAY), c)
        .when(c.rlike(_MONTH_FIRST_DAY), spelled(year, F.substring(c, 1, 2), F.substring(c, 4, 2)))
        .when(c.rlike(_DAY_NAMED), spelled(year, month(word(2)), word(1)))
        .when(c.rlike(_NAMED_DAY), spelled(year, month(word(1)), F.replace(word(2), F.lit(","), F.lit(""))))
    )


@shared
def iso_date(c: Column, as_of: dt.date | None = None) -> Column:
    """ISO text of a free-form date or date-time; NULL when it is not one.

    Ambiguous numeric dates read month first, an offset is kept, and words around
    the date make it NULL. Partial dates ('May 2024', '2024', '10:30') need
    ``as_of`` to fill the missing parts and are NULL without it.
    """
    # The common case: a full day and nothing else.
    whole = lambda day: F.when(day.try_cast("date").isNotNull(), F.concat(day, F.lit("T00:00:00"))).otherwise(_free_form(c, as_of))
    return let(_full_day(c), whole)


def _free_form(c: Column, as_of: dt.date | None) -> Column:
    day_first = lambda t: F.when(t.rlike(r"\A\d"), t).otherwise(F.regexp_replace(t, _WEEKDAY, ""))
    text = let(let(trim_ws(c), day_first), _spread_compact)
    return let(let(text, _pieces), lambda p: let(_day_parts(p["day"], as_of), lambda d: _iso(p, d)))
