"""URL helpers as Column expressions (regular expressions only, so bad input gives null)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import as_column, built_once, let

_SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"
_ORIGIN = r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)"
_HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]*)"
_PATH = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)"


def origin(url) -> Column:
    return F.nullif(F.regexp_extract(as_column(url), _ORIGIN, 1), F.lit(""))


@built_once
def hostname(url) -> Column:
    return F.lower(F.regexp_extract(as_column(url), _HOST, 1))


def pathname(url) -> Column:
    path = F.regexp_extract(as_column(url), _PATH, 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def valid_url(url) -> Column:
    """Would the standard URL constructor accept it? Relative references are not valid."""
    col = F.btrim(as_column(url), F.lit("\t\n\x0b\f\r "))
    web = (
        r"(?i)^(?:https?|ftp|wss?):[/\\]*(?:[^/\\?#@]*@)?"
        r"(?:\[[0-9a-f:.]+\]|[^\s\x00-\x20#%/:<>?@\[\\\]^|]+)(?::(?:0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5]))?)?"
        r"(?:[/\\?#].*)?$"
    )
    other = r"(?is)^(?!(?:https?|ftp|wss?):)[a-z][a-z0-9+.\-]*:.*"
    return F.coalesce(col.rlike(web) | col.rlike(other), F.lit(False))


# Characters a URL may hold as they are; the rest is percent-encoded.
_LITERAL = r"!#-;=?-_a-z|~{}"


def encode_url(text: Column) -> Column:
    """Percent-encode what a URL may not hold literally; leave the rest as it is."""

    def coded(value: Column) -> Column:
        parts = F.regexp_extract_all(value, F.lit(f"[{_LITERAL}]++|[^{_LITERAL}]++"), F.lit(0))
        code = F.transform(
            parts,
            lambda p: F.when(p.rlike(f"^[{_LITERAL}]"), p).otherwise(
                F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
            ),
        )
        return F.when(value.rlike(f"[^{_LITERAL}]"), F.array_join(code, "")).otherwise(value)

    return let(text, coded)


def _without_dots(path: Column) -> Column:
    steps = F.aggregate(
        F.slice(F.split(path, "/"), 2, 1 << 30),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.regexp_replace(F.concat(F.lit("/"), F.array_join(steps, "/"), tail), "^//$", "/")
    return F.when(path.rlike(r"/\.\.?(?:/|$)"), joined).otherwise(path)


def _normal(url: Column) -> Column:
    """Lower-case scheme and host, default path, no dot segments."""

    def normal(value: Column) -> Column:
        base = F.lower(F.regexp_extract(value, _ORIGIN, 1))
        rest = F.regexp_extract(value, r"^[^?#]*([?#].*)?$", 1)
        fixed = F.concat(base, let(pathname(value), _without_dots), rest)
        return F.when(value.rlike(r"(?i)^(?:https?|ftp|wss?)://"), fixed).otherwise(value)

    return let(url, normal)


@built_once
def resolve_url(href, base) -> Column:
    """The absolute URL of `href` on page `base`; null without an absolute base to resolve against."""
    base = as_column(base)

    def joined(ref: Column) -> Column:
        top = origin(base)
        page = F.regexp_extract(base, r"^([^?#]*)", 1)
        return (
            F.when(ref.rlike(_SCHEME), ref)
            .when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([a-zA-Z][^:/]*:)", 1), ref))
            .when(ref.startswith("/"), F.concat(top, ref))
            .when(ref.startswith("?"), F.concat(page, F.when(page == top, F.lit("/")).otherwise(F.lit("")), ref))
            .when(ref.startswith("#") | (ref == ""), F.concat(F.regexp_extract(base, "^([^#]*)", 1), ref))
            .otherwise(F.concat(top, F.regexp_extract(pathname(base), r"^(.*/)", 1), ref))
        )

    return encode_url(_normal(let(F.btrim(as_column(href), F.lit("\t\n\x0b\f\r ")), joined)))


def is_external(absolute_url, page_url) -> Column:
    return ~hostname(absolute_url).eqNullSafe(hostname(page_url))


def escape_css(text) -> Column:
    """Escape a value for a quoted CSS string: a backslash before backslash and single quote, and the code point in hex
    for what is not printable ASCII, with a space after it where a hex digit or space would follow."""
    quoted = F.regexp_replace(as_column(text), r"([\\'])", r"\\$1")
    odd = r"[^\x20-\x7E]"
    parts = F.regexp_extract_all(quoted, F.lit(rf"(?s)({odd}|[\x20-\x7E]+)"), F.lit(1))
    code = lambda p: F.regexp_replace(F.hex(F.encode(p, "UTF-32")), "^0+", "")
    # A NUL has no other zeros to lose.
    escaped = F.transform(parts, lambda p: F.when(p.rlike(odd), F.concat(F.lit("\\"), F.coalesce(F.nullif(code(p), F.lit("")), F.lit("0")), F.lit(" "))).otherwise(p))
    joined = F.regexp_replace(F.array_join(escaped, ""), r"(\\[0-9A-F]{1,6})\x20(?![0-9a-fA-F\x20])", "$1")
    return F.when(quoted.rlike(odd), joined).otherwise(quoted)
