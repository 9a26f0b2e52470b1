"""Checking one extracted value against an item field: typed value or error text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..model import ItemField
from .lets import let, shared
from .urls import http_url

_INT_TEXT = r"\A\s*[+-]?\d+(?:_\d+)*(?:\.0+)?\s*\z"
_DATE = r"\A(\d{4})-(\d{2})-(\d{2})"
_DATETIME = _DATE + r"(?:[Tt _](\d{2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*([Zz]|[+-]\d{2}:?\d{2})?)?\z"
_LOCAL = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\z"
_EPOCH = r"\A\s*[+-]?\d+(?:\.\d+)?\s*\z"


def _check_str(v: Column, kind: Column) -> Column:
    return F.struct(v.alias("value"), F.when(kind != "str", F.lit("Input should be a valid string")).alias("error"))


def _check_int(v: Column, kind: Column) -> Column:
    number = v.try_cast("double")
    digits = F.regexp_replace(F.regexp_replace(F.trim(v), r"\.0+\z", ""), "_", "")
    value = (
        F.when(kind == "bool", F.when(F.lower(v) == "true", 1).otherwise(0).cast("bigint"))
        .when(kind == "float", F.when(number == F.floor(number), number.try_cast("bigint")))
        .when(kind == "int", v.try_cast("bigint"))
        .when(v.rlike(_INT_TEXT), digits.try_cast("bigint"))
    )
    base = "Input should be a valid integer, "
    problem = (
        F.when(kind == "float", F.lit(base + "got a number with a fractional part"))
        .when((kind == "str") & ~v.rlike(_INT_TEXT), F.lit(base + "unable to parse string as an integer"))
        .otherwise(F.lit("Unable to parse input string as an integer, exceeded maximum size"))
    )
    return let(value, lambda i: F.struct(i.alias("value"), F.when(i.isNull(), problem).alias("error")))


def _iso_datetime(v: Column) -> Column:
    """Struct of ISO text and instant for an ISO date or date-time, NULL otherwise."""
    part = lambda i: F.regexp_extract(v, _DATETIME, i)
    num = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    pieces = F.struct(
        part(1).alias("y"), part(2).alias("mo"), part(3).alias("d"), num(4).alias("h"), num(5).alias("mi"), num(6).alias("s"),
        F.rpad(F.substring(part(7), 1, 6), 6, "0").alias("micros"), F.upper(part(8)).alias("zone"),
    )

    def zone_text(z: Column) -> Column:
        spaced = F.when(z.rlike(r"\A[+-]\d{4}\z"), F.concat(F.substring(z, 1, 3), F.lit(":"), F.substring(z, 4, 2))).otherwise(z)
        return F.when(z.isin("+00:00", "-00:00", "+0000", "-0000"), F.lit("Z")).otherwise(spaced)

    def spell(p: Column) -> Column:
        clock = F.format_string("%s-%s-%sT%02d:%02d:%02d", p["y"], p["mo"], p["d"], p["h"], p["mi"], p["s"])
        fraction = F.when(p["micros"].isin("", "000000"), F.lit("")).otherwise(F.concat(F.lit("."), p["micros"]))
        real = F.try_make_timestamp(p["y"].cast("int"), p["mo"].cast("int"), p["d"].cast("int"), p["h"], p["mi"], p["s"])
        texts = F.struct(F.concat(clock, fraction).alias("local"), zone_text(p["zone"]).alias("zone"))
        return F.when(
            real.isNotNull() & (p["s"] < 60),
            let(
                texts,
                lambda t: F.struct(
                    F.concat(t["local"], t["zone"]).alias("text"),
                    F.concat(t["local"], F.when(t["zone"] == "", F.lit("Z")).otherwise(t["zone"])).try_cast("timestamp").alias("stamp"),
                ),
            ),
        )

    # The common case, as the date transform writes it: a full local time.
    plain = let(
        F.concat(v, F.lit("Z")).try_cast("timestamp"),
        lambda s: F.when(s.isNotNull(), F.struct(v.alias("text"), s.alias("stamp"))),
    )
    return F.when(v.rlike(_LOCAL), plain).when(v.rlike(_DATETIME), let(pieces, spell))


def _epoch_datetime(v: Column) -> Column:
    """The same struct for epoch seconds, or milliseconds when the number is large."""

    def spell(seconds: Column) -> Column:
        # Rendered by its UTC parts, so the text does not follow the session time zone.
        day = F.floor(seconds / 86400)
        rest = seconds - day * 86400
        micros = F.round((rest - F.floor(rest)) * 1000000).cast("int")
        text = F.concat(
            F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM-dd"),
            F.format_string(
                "T%02d:%02d:%02d", F.floor(rest / 3600), F.pmod(F.floor(rest / 60), F.lit(60)), F.pmod(F.floor(rest), F.lit(60))
            ),
            F.when(micros > 0, F.format_string(".%06d", micros)).otherwise(F.lit("")),
            F.lit("Z"),
        )
        return F.struct(text.alias("text"), F.timestamp_micros((seconds * 1000000).cast("bigint")).alias("stamp"))

    scaled = let(v.try_cast("double"), lambda s: F.when(F.abs(s) > 2e10, s / 1000).otherwise(s))
    return F.when(v.rlike(_EPOCH), let(scaled, spell))


def _check_datetime(v: Column, kind: Column) -> Column:
    found = F.coalesce(
        F.when(kind == "str", _iso_datetime(v)), F.when(kind.isin("str", "int", "float"), _epoch_datetime(v))
    )
    message = F.lit("Input should be a valid datetime or date")
    return let(
        found,
        lambda x: F.struct(x["text"].alias("value"), F.when(x.isNull(), message).alias("error"), x["stamp"].alias("stamp")),
    )


def _check_url(v: Column, kind: Column) -> Column:
    return let(
        http_url(v),
        lambda u: F.struct(
            u["value"].alias("value"),
            F.when(kind != "str", F.lit("URL input should be a string or URL")).otherwise(u["error"]).alias("error"),
        ),
    )


_CHECKS = {"str": _check_str, "int": _check_int, "datetime": _check_datetime, "url": _check_url}
# What a required field says about NULL.
_NULL_TEXT = {
    "str": "Input should be a valid string",
    "int": "Input should be a valid integer",
    "datetime": "Input should be a valid datetime",
    "url": "URL input should be a string or URL",
}


@shared
def _check_tagged(x: Column, field_kind: str, required: bool) -> Column:
    v, kind = x["v"], x["k"]
    present = lambda c: _CHECKS[field_kind](c, kind)
    if required:
        missing = F.when(kind == "absent", F.lit("Field required")).otherwise(F.lit(_NULL_TEXT[field_kind]))
    else:
        missing = F.lit(None).cast("string")

    def settle(r: Column) -> Column:
        error = F.when(v.isNull(), missing).otherwise(r["error"])
        good = v.isNotNull() & r["error"].isNull()
        out = [F.when(good, r["value"]).alias("value"), error.alias("error")]
        if field_kind == "datetime":
            out.append(F.when(good, r["stamp"]).alias("stamp"))
        return F.struct(*out)

    return let(present(v), settle)


def check_typed(field: ItemField, c: Column) -> Column:
    """``check_value`` of a column that has the field's own type, text or whole numbers: only NULL can be wrong with it."""
    missing = F.lit(_NULL_TEXT[field.kind]) if field.required else F.lit(None).cast("string")
    value = c.cast("bigint") if field.kind == "int" else c
    return F.struct(value.alias("value"), F.when(c.isNull(), missing).alias("error"))


def check_value(field: ItemField, v: Column, kind: Column) -> Column:
    """Check value text ``v`` of kind ``kind`` ('str', 'int', 'float', 'bool', 'absent').

    Struct of ``value`` (NULL when unusable), ``error`` (NULL when acceptable) and,
    for a datetime, the instant ``stamp``.
    """
    judged = _check_tagged(F.struct(v.alias("v"), kind.alias("k")), field.kind, field.required)
    # A value of the field's own kind goes without the lambda: only NULL can be wrong with a text, nothing with a whole number.
    if field.kind == "str":
        return F.when(kind == "str", check_typed(field, v)).otherwise(judged)
    if field.kind == "int":
        number = v.try_cast("bigint")
        return F.when((kind == "int") & number.isNotNull(), check_typed(field, number)).otherwise(judged)
    return judged
