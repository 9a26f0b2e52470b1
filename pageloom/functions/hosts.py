"""ASCII form of international host names, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .lets import let

#: Fixed values of the encoding (RFC 3492, section 5).
BASE, LOW, HIGH, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

_STATE = "struct<code:bigint,delta:bigint,bias:bigint,done:bigint,text:string>"


def _div(a: Column, b: Column) -> Column:
    return F.floor(a / b).cast("bigint")


def _digits(delta: Column, bias: Column) -> Column:
    """``delta`` as digits of varying weight, lowest first; a label of 63 characters needs no more than eight."""

    def step(acc: Column, k: Column) -> Column:
        t = F.least(F.greatest(k - bias, F.lit(LOW)), F.lit(HIGH)).cast("bigint")
        digit = lambda d: F.substring(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))
        more = let(
            t,
            lambda t: F.when(acc["rest"] < t, F.struct(F.lit(-1).cast("bigint").alias("rest"), F.concat(acc["text"], digit(acc["rest"])).alias("text"))).otherwise(
                F.struct(_div(acc["rest"] - t, BASE - t).alias("rest"), F.concat(acc["text"], digit(t + (acc["rest"] - t) % (BASE - t))).alias("text"))),
        )
        return F.when(acc["rest"] < 0, acc).otherwise(more).cast("struct<rest:bigint,text:string>")

    start = F.struct(delta.alias("rest"), F.lit("").alias("text")).cast("struct<rest:bigint,text:string>")
    return F.aggregate(F.sequence(F.lit(BASE), F.lit(BASE * 8), F.lit(BASE)).cast("array<bigint>"), start, step, lambda acc: acc["text"])


def _adapted(delta: Column, count: Column, first: Column) -> Column:
    """The next bias."""
    scaled = let(F.when(first, _div(delta, F.lit(DAMP))).otherwise(_div(delta, F.lit(2))), lambda d: d + _div(d, count))
    start = lambda d: F.struct(d.alias("d"), F.lit(0).cast("bigint").alias("k")).cast("struct<d:bigint,k:bigint>")
    step = lambda acc, _: F.when(
        acc["d"] > (BASE - LOW) * HIGH // 2, F.struct(_div(acc["d"], F.lit(BASE - LOW)).alias("d"), (acc["k"] + BASE).alias("k"))
    ).otherwise(acc).cast("struct<d:bigint,k:bigint>")
    finish = lambda acc: acc["k"] + _div((BASE - LOW + 1) * acc["d"], acc["d"] + SKEW)
    return let(scaled, lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(8)), start(d), step, finish))


def bootstring(label: Column) -> Column:
    """A label's ASCII characters, a hyphen, and where its other characters go: one sweep over the label per distinct other character."""
    state = lambda code, delta, bias, done, text: F.struct(
        code.alias("code"), delta.alias("delta"), bias.alias("bias"), done.alias("done"), text.alias("text")).cast(_STATE)

    def whole(codes: Column) -> Column:
        plain = F.filter(codes, lambda c: c < FIRST_CODE)
        others = F.array_sort(F.array_distinct(F.filter(codes, lambda c: c >= FIRST_CODE)))
        ascii_part = F.array_join(F.transform(plain, lambda c: F.char(c)), "")
        start = state(F.lit(FIRST_CODE), F.lit(0), F.lit(FIRST_BIAS), F.size(plain), F.when(F.size(plain) > 0, F.concat(ascii_part, F.lit("-"))).otherwise(F.lit("")))

        def char(acc: Column, c: Column) -> Column:
            put = state(acc["code"], F.lit(0), _adapted(acc["delta"], acc["done"] + 1, acc["done"] == F.size(plain)), acc["done"] + 1,
                        F.concat(acc["text"], _digits(acc["delta"], acc["bias"])))
            return F.when(c == acc["code"], put).when(c < acc["code"], state(acc["code"], acc["delta"] + 1, acc["bias"], acc["done"], acc["text"])).otherwise(acc)

        def sweep(acc: Column, code: Column) -> Column:
            begin = state(code, acc["delta"] + (code - acc["code"]) * (acc["done"] + 1), acc["bias"], acc["done"], acc["text"])
            return F.aggregate(codes, begin, char, lambda a: state(a["code"] + 1, a["delta"] + 1, a["bias"], a["done"], a["text"]))

        return F.aggregate(others, start, sweep, lambda acc: acc["text"])

    return let(F.transform(F.split(label, ""), lambda c: F.ascii(c).cast("bigint")), whole)


def ascii_host(host: Column) -> Column:
    """``host`` in lower case with each label beyond ASCII in its ``xn--`` form; the wide full stops part labels as well.

    Labels are taken as they are written (in lower case): combining sequences and compatibility characters are not composed or folded.
    """
    label = lambda part: F.when(part.rlike(r"[^\x00-\x7f]"), F.concat(F.lit("xn--"), bootstring(part))).otherwise(part)
    folded = F.regexp_replace(F.lower(host), "[。．｡]", ".")
    return F.when(host.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(F.split(folded, r"\."), label), ".")).otherwise(F.lower(host))
