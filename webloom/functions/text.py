"""Text helpers with JavaScript string semantics, as built-in Column expressions."""

from __future__ import annotations

import functools
import html.entities
import json

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points JavaScript's \s and trim() treat as white space.
JS_SPACE = (
    "\t\n\x0b\f\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set for patterns. Ranges keep the class small: it is tested for every character of a text.
JS_SPACE_CLASS = "[\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000\ufeff]"

# Marks the seams between text runs while a page's text is decoded in one go.
SEAM = "\u0001"


def built_once(function):
    """Keep what a column builder returns for names and constants: such expressions are not bound to any DataFrame, and
    building one takes hundreds of calls into the JVM."""
    kept: dict = {}

    @functools.wraps(function)
    def build(*args, **kwargs):
        given = (*args, *kwargs.values())
        if any(isinstance(a, Column) for a in given):
            return function(*args, **kwargs)
        key = (id(SparkContext._gateway), args, tuple(sorted(kwargs.items())))
        if key not in kept:
            kept[key] = function(*args, **kwargs)
        return kept[key]

    return build


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


@built_once
def trim_js(text) -> Column:
    return F.btrim(as_column(text), F.lit(JS_SPACE))


@built_once
def collapse_ws(text) -> Column:
    return trim_js(F.regexp_replace(as_column(text), JS_SPACE_CLASS + "++", " "))


def non_empty(text) -> Column:
    """The text, or null when it is empty (JavaScript's `||` chain)."""
    return F.nullif(as_column(text), F.lit(""))


def truncate(text, limit: int) -> Column:
    col = as_column(text)
    return F.when(F.length(col) > limit, F.concat(F.left(col, F.lit(limit)), F.lit("..."))).otherwise(
        F.coalesce(col, F.lit(""))
    )


def js_length(text) -> Column:
    """Length in UTF-16 units, as JavaScript counts: characters beyond the basic plane count twice."""
    col = as_column(text)
    return F.length(col) + F.length(F.regexp_replace(col, r"[^\x{10000}-\x{10FFFF}]", ""))


def contains_ci(haystack, needle) -> Column:
    return F.contains(F.lower(as_column(haystack)), F.lower(as_column(needle)))


def let(value: Column, body) -> Column:
    """`body(value)` with the value worked out once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Separates the entries of the entity table.
_ENTRY = "\u0002"


def _named_entity(ref: Column) -> Column:
    """Look a name up in the HTML table, kept as one text: a map of its 2,231 names would be far more to ship."""
    # The usual ones first: the search scans from the front.
    usual = ["amp;", "lt;", "gt;", "quot;", "nbsp;", "apos;", "copy;", "middot;", "hellip;", "mdash;", "ndash;"]
    names = dict.fromkeys([*usual, *html.entities.html5])
    table = F.lit(_ENTRY + "".join(f"{name}={html.entities.html5[name]}{_ENTRY}" for name in names))
    entry = F.concat(F.lit(_ENTRY), ref, F.lit("="))
    return let(
        F.instr(table, entry),
        lambda at: F.when(at > 0, F.substring_index(F.substring(table, at + F.length(entry), F.lit(8)), _ENTRY, 1)),
    )


def _windows_1252() -> dict[int, str]:
    out = {}
    for code in range(0x80, 0xA0):
        try:
            out[code] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            out[code] = chr(code)
    return out


def _numeric_entity(ref: Column) -> Column:
    hexa = F.lower(F.regexp_extract(ref, r"^#[xX]0*+([0-9a-fA-F]{1,6});?$", 1))
    deci = F.regexp_extract(ref, r"^#0*+([0-9]{1,7});?$", 1)
    code = F.conv(F.when(hexa != "", hexa).otherwise(F.conv(deci, 10, 16)), 16, 10).cast("bigint")
    remap = F.from_json(
        F.lit(json.dumps({str(k): v for k, v in _windows_1252().items()})), "map<string,string>"
    )
    bad = code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF)
    return (
        F.when(bad, F.lit("\ufffd"))
        .when(code.between(0x80, 0x9F), F.try_element_at(remap, code.cast("string")))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


@built_once
def decode_entities(text, attribute: bool = False) -> Column:
    """Replace character references. In attributes a reference needs its semicolon."""
    col = as_column(text)
    # Some old names also count in text without their semicolon; the longest one wins.
    bare = sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    end, old = (";", "") if attribute else (";?+", "|" + "|".join(bare))
    reference = f"&(?:#[0-9]++{end}|#[xX][0-9a-fA-F]++{end}|[a-zA-Z][a-zA-Z0-9]*+;{old})"
    parts = F.regexp_extract_all(col, F.lit(reference + "|[^&]++|&"), F.lit(0))

    def one(part: Column) -> Column:
        ref = F.substring(part, F.lit(2), F.length(part))
        numeric = F.when(F.length(part) > 2, _numeric_entity(ref))
        value = F.when(part.startswith("&#"), numeric).otherwise(_named_entity(ref))
        if not attribute:
            # An unknown name may still begin with an old one.
            start = F.regexp_extract(part, f"^&({'|'.join(bare)})", 1)
            value = F.coalesce(value, F.concat(_named_entity(start), F.substring(part, F.length(start) + 2, F.length(part))))
        return F.when(part.startswith("&"), F.coalesce(value, part)).otherwise(part)

    # Without a reference the text comes back as it is, in one part.
    return F.array_join(F.transform(parts, one), "")


@built_once
def decode_runs(runs) -> Column:
    """Decode an array of text runs through one pass over the joined text."""
    return F.split(decode_entities(F.array_join(runs, SEAM)), SEAM, -1)
