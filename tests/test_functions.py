"""Scalar functions against the standard library and fixed cases."""

import datetime as dt
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from pageloom.functions import text as tx
from pageloom.functions.dates import _free_form, _full_day, iso_date
from pageloom.functions.transforms import TRANSFORMS, apply_transform
from pageloom.functions.hosts import ascii_host
from pageloom.functions.urls import http_url, resolve_url
from pageloom.model import ItemField
from pageloom.functions.coerce import check_value


def column(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", fn(F.col("v")).alias("out")).orderBy("i").collect()]


def test_url_resolution_equals_urljoin(spark):
    bases = ["https://h.ex/a/b?q=1#f", "", "https://h.ex", "https://h.ex/a/", "/p/q", "https://h.ex/a//b/c"]
    refs = ["/x", "x", "../../../x", "?z=2", "#t", "", "//o.ex/p", "mailto:a@b", "javascript:void(0)", "x?", "./y/../z",
            "/a//b/../c", "https:foo", " x ", "..", ".", "a/./", "http://q/x", "x;y", "/..", "x#"]
    pairs = [(b, r) for b in bases for r in refs]
    df = spark.createDataFrame(pairs, "b string, r string")
    for row in df.select("b", "r", resolve_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u == urljoin(row.b, row.r), (row.b, row.r)


DATES = {
    "2024-05-01": "2024-05-01T00:00:00", "2024-05-01T10:20:30Z": "2024-05-01T10:20:30+00:00",
    "2024-05-01T10:20:30+02:00": "2024-05-01T10:20:30+02:00", "2024-05-01 10:20": "2024-05-01T10:20:00",
    "2024-05-01T10:20:30.5": "2024-05-01T10:20:30.500000", "01/02/2024": "2024-01-02T00:00:00",
    "13/02/2024": "2024-02-13T00:00:00", "May 1, 2024": "2024-05-01T00:00:00", "May 1st, 2024": "2024-05-01T00:00:00",
    "Sept 3 2021": "2021-09-03T00:00:00", "Wed, 01 May 2024 10:20:30 GMT": "2024-05-01T10:20:30+00:00",
    "20240501": "2024-05-01T00:00:00", "20240501T101112": "2024-05-01T10:11:12", "31.12.2023": "2023-12-31T00:00:00",
    "3 September 2020 5:07 pm": "2020-09-03T17:07:00", "Posted 2024-05-01": None, "": None, "2024-02-30": None,
    "May 2024": None, "2024": None, "10:30": None, "10:61": None,
}


def test_iso_date(spark):
    assert dict(zip(DATES, column(spark, list(DATES), iso_date))) == DATES


def test_full_days_are_read_without_the_free_form(spark):
    names = ["Jan", "March", "may", "June", "Sept", "September", "Dec", "Foo"]
    texts = [f"{d} {m} {y}" for m in names for d in ("0", "7", "29", "31", "32") for y in ("2023", "0999")]
    texts += [f"{m} {d}, {y}" for m in names for d in ("0", "7", "29", "31", "1st") for y in ("2024", "0999")]
    texts += [f"{a:02d}/{b:02d}/{y}" for a in (0, 2, 12, 13) for b in (0, 12, 13, 29, 31) for y in ("2023", "2024")]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "2024-02-30", "07/03/2024\n"]], "t string")
    seen = df.select("t", iso_date(F.col("t")).alias("a"), _free_form(F.col("t"), None).alias("b")).collect()
    assert [r for r in seen if r["a"] != r["b"]] == []
    short = spark.createDataFrame([("03/07/2024",), ("March 7, 2024",), ("7 Mar 2024",)], "t string").select(_full_day(F.col("t")).alias("d"))
    assert {r["d"] for r in short.collect()} == {"2024-03-07"}


def test_iso_date_fills_partial_dates_from_as_of(spark):
    as_of = dt.date(2024, 3, 31)
    got = column(spark, ["Feb 2024", "2022", "10:30"], lambda c: iso_date(c, as_of))
    assert got == ["2024-02-29T00:00:00", "2022-03-31T00:00:00", "2024-03-31T10:30:00"]


@pytest.mark.parametrize(
    "name, cases",
    [
        ("trim", {"  a b ": "a b", "\x1cq\x1f": "q"}),
        ("collapse_ws", {" a \n\t b ": "a b"}),
        ("lower", {"ABC": "abc"}),
        ("upper", {"abc": "ABC"}),
        ("int", {"$150,000 – $190,000": 150000, "2024-05-01": 2024, "a-5": -5, "-1,2,3.50": -123, ".5": 5, "none": None, "99999999999999999999": None}),
        ("float", {"from 1,234.5 up": 1234.5, "n/a": None}),
        ("bool", {" Yes ": True, "off": False, "": False, "maybe": None, "1": True}),
    ],
)
def test_transforms(spark, name, cases):
    got = column(spark, list(cases), lambda c: apply_transform(name, c, F.lit("")))
    assert dict(zip(cases, got)) == cases


def test_transforms_pass_null_and_reject_unknown_names(spark):
    for name in TRANSFORMS:
        assert column(spark, [None], lambda c: apply_transform(name, c, F.lit("https://h.ex/"))) == [None]
    with pytest.raises(ValueError, match="'shout' is not one of"):
        apply_transform("shout", F.lit("x"), F.lit(""))


def test_float_text_is_spelled_like_python(spark):
    values = [1.0, 0.1, 1e7, 123456789.25, 1e15, 1e16, 1.5e-5, 0.0001, 1e22, -2.5e-10, 150000.0, 3.14]
    assert column(spark, values, tx.float_text, "double") == [str(v) for v in values]


def test_hashed_tokens(spark):
    cases = {"css-1a2b3c": True, "jss12ab": True, "deadbeef": False, "fade": False, "page-2024": True, "job-card": False}
    assert dict(zip(cases, column(spark, list(cases), tx.looks_hashed))) == cases
    assert column(spark, ["css-1a2b3c", "job-card"], tx.stable_token) == ["·hashed", "job-card"]


def test_percent_rounds_half_to_even(spark):
    assert column(spark, [0.125, 2 / 3, 1.0, 0.375], tx.percent, "double") == ["12%", "67%", "100%", "38%"]


def test_http_url(spark):
    cases = {
        "HTTP://Example.COM": ("http://example.com/", None), "https://a.b:443/x y": ("https://a.b/x%20y", None),
        "https://a.b/ü?q=é": ("https://a.b/%C3%BC?q=%C3%A9", None), "http://a.b/a/../b#f g": ("http://a.b/b#f%20g", None),
        "ftp://x": (None, "URL scheme should be 'http' or 'https'"),
        "/rel": (None, "Input should be a valid URL, relative URL without a base"),
        "": (None, "Input should be a valid URL, input is empty"),
    }
    assert {k: tuple(v) for k, v in zip(cases, column(spark, list(cases), http_url))} == cases


@pytest.mark.parametrize(
    "field_kind, kind, cases",
    [
        ("int", "str", {"12": 12, "1.0": 1, " 12 ": 12, "+5": 5, "1_000": 1000, "1.5": None, "150,000": None, "": None, "1e3": None}),
        ("int", "bool", {"true": 1, "false": 0}),
        ("int", "float", {"3.0": 3, "3.5": None}),
        ("str", "int", {"5": None}),
        ("str", "str", {"": "", "x": "x"}),
        ("datetime", "str", {"2024-05-01": "2024-05-01T00:00:00", "2024-05-01T10:20:30Z": "2024-05-01T10:20:30Z", "2024-05-01 10:20+02:00": "2024-05-01T10:20:00+02:00",
                             "1714521600": "2024-05-01T00:00:00Z", "1714521600000": "2024-05-01T00:00:00Z", "May 1, 2024": None, "": None, "2024-02-30": None}),
    ],
)
def test_item_field_checks(spark, field_kind, kind, cases):
    got = column(spark, list(cases), lambda c: check_value(ItemField("f", field_kind), c, F.lit(kind)))
    for (text, want), r in zip(cases.items(), got):
        assert (r.value, r.error is None) == (want, want is not None), text


def test_missing_values(spark):
    one = lambda field, kind: column(spark, [None], lambda c: check_value(field, c, F.lit(kind)))[0].error
    assert one(ItemField("f", "str"), "absent") == "Field required"
    assert one(ItemField("f", "str"), "str") == "Input should be a valid string"
    assert one(ItemField("f", "int", required=False), "absent") is None


def test_ascii_host_agrees_with_the_codec(spark):
    names = ["bücher.example", "MÜNCHEN.Example", "日本語。jp", "пример.испытание", "a-ü-b.x", "ü", "例え.テスト", "straße.de", "☃.net", "😀x😀.org", "plain.example", "", "aáàâäãåb.c",
             "ما.قطر", "x" * 40 + "é" + "y" * 15 + ".z"]
    want = {n: ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in n.lower().replace("。", ".").split(".")) for n in names}
    assert dict(zip(names, column(spark, names, ascii_host))) == want
