"""URL splitting, reference resolution and output normalisation as Columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .hosts import ascii_host
from .lets import let, shared

# Generic URL parts (RFC 3986, appendix B), one pattern per part.
_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"(?s)\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(.*)\z"


@shared
def split_url(url: Column) -> Column:
    """Struct of scheme, netloc, path, query and fragment; an absent part is ''."""
    clean = F.regexp_replace(F.regexp_replace(url, r"\A[\x00-\x20]+", ""), r"[\t\r\n]", "")

    def parts(c: Column) -> Column:
        return let(
            F.regexp_extract(c, _AFTER_SCHEME, 1),
            lambda rest: F.struct(
                F.lower(F.regexp_extract(c, _SCHEME, 1)).alias("scheme"),
                F.regexp_extract(rest, r"\A//([^/?#]*)", 1).alias("netloc"),
                F.regexp_extract(rest, r"\A(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
                F.regexp_extract(rest, r"\A[^?#]*\?([^#]*)", 1).alias("query"),
                F.regexp_extract(rest, r"(?s)\A[^#]*#(.*)\z", 1).alias("fragment"),
            ),
        )

    return let(clean, parts)


def host_of(url: Column) -> Column:
    """Network location of a URL ('' when it has none)."""
    return split_url(url)["netloc"]


def remove_dots(path: Column) -> Column:
    """Fold the '.' and '..' segments of a path."""
    parts = F.split(path, "/", -1)
    last = F.element_at(parts, -1)
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
    return F.array_join(closed, "/")


def _tidy(path: Column) -> Column:
    return F.when(path.rlike(r"(?:\A|/)\.{1,2}(?:/|\z)"), remove_dots(path)).otherwise(path)


def build_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when(
        (netloc != "") & (path != "") & ~F.startswith(path, F.lit("/")), F.concat(F.lit("/"), path)
    ).otherwise(path)
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(F.lit("")),
        rooted,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit("")),
    )


# Schemes whose references resolve hierarchically (fixed values, generic URL syntax).
_HIERARCHICAL = ["", "file", "ftp", "http", "https", "sftp", "ws", "wss"]


def _relative(b: Column, r: Column) -> Column:
    """Path of reference ``r`` resolved against base ``b``."""
    base_dir = F.regexp_extract(b["path"], r"(?s)\A(.*/)?", 0)
    # A joined relative path loses its empty middle segments; a rooted one keeps them.
    joined = F.when(F.startswith(r["path"], F.lit("/")), r["path"]).otherwise(
        F.regexp_replace(F.concat(base_dir, r["path"]), r"(?<!\A)/{2,}", "/")
    )
    resolved = let(let(joined, _tidy), lambda p: F.when(p == "", F.lit("/")).otherwise(p))
    return F.when(r["path"] == "", b["path"]).otherwise(resolved)


def _resolve(ref: Column, b: Column, r: Column) -> Column:
    scheme = F.when(r["scheme"] == "", b["scheme"]).otherwise(r["scheme"])
    query = F.when((r["path"] == "") & (r["query"] == ""), b["query"]).otherwise(r["query"])
    return (
        F.when((scheme != b["scheme"]) | ~scheme.isin(_HIERARCHICAL), ref)
        .when(r["netloc"] != "", build_url(scheme, r["netloc"], r["path"], r["query"], r["fragment"]))
        .otherwise(let(_relative(b, r), lambda path: build_url(scheme, b["netloc"], path, query, r["fragment"])))
    )


# The common case: a rooted path without dots, blanks, query or fragment, on an http page.
_ROOTED = r"\A(?!.*/\.)/(?!/)[^\x00-\x20?#;]*\z"
_ORIGIN = r"\A(https?://[^/?#\s]+)"


@shared
def _resolve_pair(pair: Column) -> Column:
    base, ref = pair["base"], pair["ref"]
    return (
        F.when(ref.isNull(), F.lit(None).cast("string"))
        .when(ref.rlike(_ROOTED) & F.coalesce(base.rlike(_ORIGIN), F.lit(False)), F.concat(F.regexp_extract(base, _ORIGIN, 1), ref))
        .when(F.coalesce(base, F.lit("")) == "", ref)
        .when(ref == "", base)
        .otherwise(let(split_url(base), lambda b: let(split_url(ref), lambda r: _resolve(ref, b, r))))
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve ``ref`` against the page url ``base`` (RFC 3986 reference resolution).

    An empty or NULL base leaves the reference alone; NULL stays NULL.
    """
    return _resolve_pair(F.struct(base.alias("base"), ref.alias("ref")))


def _percent_encode(c: Column, unsafe: str) -> Column:
    """Percent-encode the characters matched by the class ``unsafe`` as UTF-8 bytes."""
    encoded = F.array_join(
        F.transform(
            F.split(c, "", -1),
            lambda ch: F.when(ch == " ", F.lit("%20")).when(ch.rlike(unsafe), F.url_encode(ch)).otherwise(ch),
        ),
        "",
    )
    return F.when(c.rlike(unsafe), encoded).otherwise(c)


def _authority(p: Column) -> Column:
    """User part, lower-cased host and port of a netloc."""
    return let(
        F.regexp_extract(p["netloc"], r"(?s)\A(?:(.*)@)?(.*)\z", 2),
        lambda rest: F.struct(
            F.regexp_extract(p["netloc"], r"(?s)\A(.*@)?", 1).alias("user"),
            F.lower(F.regexp_replace(rest, r":\d*\z", "")).alias("host"),
            F.regexp_extract(rest, r":(\d*)\z", 1).alias("port"),
        ),
    )


def _http_value(p: Column, a: Column) -> Column:
    default = ((p["scheme"] == "http") & (a["port"] == "80")) | ((p["scheme"] == "https") & (a["port"] == "443"))
    port = F.when((a["port"] == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), a["port"]))
    path = F.when(p["path"] == "", F.lit("/")).otherwise(_tidy(p["path"]))
    return build_url(
        p["scheme"],
        F.concat(a["user"], ascii_host(a["host"]), port),
        let(path, lambda c: _percent_encode(c, r'[^\x21-\x7e]|["<>`{}]')),
        _percent_encode(p["query"], r"[^\x21-\x7e]|[\"<>']"),
        _percent_encode(p["fragment"], r'[^\x21-\x7e]|["<>`]'),
    )


def _http_error(text: Column, p: Column, a: Column) -> Column:
    return (
        F.when(text == "", F.lit("Input should be a valid URL, input is empty"))
        .when(F.length(text) > 2083, F.lit("URL should have at most 2083 characters"))
        .when(p["scheme"] == "", F.lit("Input should be a valid URL, relative URL without a base"))
        .when(~p["scheme"].isin("http", "https"), F.lit("URL scheme should be 'http' or 'https'"))
        .when(a["host"] == "", F.lit("Input should be a valid URL, empty host"))
        .when(a["host"].rlike(r"[\s<>^|%]"), F.lit("Input should be a valid URL, invalid domain character"))
    )


# A url that is already in output form: lower-case host, no port, no dots, nothing to encode.
_CLEAN = r"\A(?!.*/\.)https?://[a-z0-9.\-]+/(?:[\x21\x24-\x26\x28-\x3b=?-\x5b\x5d_a-z~])*\z"


@shared
def http_url(c: Column) -> Column:
    """Check and normalise an absolute http/https url: struct of ``value`` and ``error``.

    Scheme and host are lower-cased, a default port is dropped, an empty path
    becomes '/', dot segments are folded and unsafe characters percent-encoded.
    International host names get their ASCII form. ``error`` is NULL for a good url.
    """
    text = F.regexp_replace(c, r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")

    def judge(t: Column, p: Column, a: Column) -> Column:
        return let(
            _http_error(t, p, a),
            lambda e: F.struct(F.when(e.isNull(), _http_value(p, a)).alias("value"), e.alias("error")),
        )

    def slow(t: Column) -> Column:
        return let(split_url(t), lambda p: let(_authority(p), lambda a: judge(t, p, a)))

    as_is = lambda t: F.struct(t.alias("value"), F.lit(None).cast("string").alias("error"))
    return let(text, lambda t: F.when(t.rlike(_CLEAN) & (F.length(t) <= 2083), as_is(t)).otherwise(slow(t)))
