"""Reading attributes from the raw open tag, e.g. `<a class="btn" href='/x'>`."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from webloom.functions.text import as_column, built_once, decode_entities

VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)"""
NAME = r"[^\s/>][^\s/>=]*+"
# Group 1 is the name, group 2 the value with its quotes.
ATTRIBUTE = rf"[\s/]*+({NAME})(?:\s*+=\s*+({VALUE})?+)?+"


def _skip_to(name: str) -> str:
    """Pattern from the tag's start up to and including its first attribute called `name`."""
    here = re.escape(name) + r"(?=[\s=/>])"
    return rf"(?i)^<[a-z][^\s/>]*+(?:[\s/]*+(?!{here}){NAME}(?:\s*+=\s*+{VALUE}?+)?+)*+[\s/]*+{here}"


# The references that matter in attribute values under test, `&amp;` last so nothing is decoded twice.
_BASIC_REFERENCES = [("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]


@built_once
def has_attr(name: str, raw="raw") -> Column:
    raw = as_column(raw)
    found = raw.rlike(_skip_to(name))
    # Most tags do not even mention the name, which is far cheaper to see. The pattern folds ASCII letters only.
    return F.contains(F.lower(raw), F.lit(name.lower())) & found if name.isascii() else found


@built_once
def attr(name: str, raw="raw") -> Column:
    """Value of the first attribute with this name; '' when it has none, null when absent.

    Meant for tests on many rows: it runs two patterns and decodes the basic references only. Where several
    attributes of few rows are wanted, use `attr_map`.
    """
    raw = as_column(raw)
    whole = _skip_to(name) + r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+))?+)?+[\s\S]*$"""
    value = F.regexp_replace(raw, whole, "$1$2$3")
    plain = value
    for reference, char in _BASIC_REFERENCES:
        plain = F.replace(plain, F.lit(reference), F.lit(char))
    value = F.when(F.contains(raw, F.lit("&")), plain).otherwise(value)
    return F.when(has_attr(name, raw), value)


def class_list(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), r"[\t\n\f\r ]+"), lambda c: c != "")


@built_once
def has_class(name: str, raw="raw") -> Column:
    return attr("class", raw).rlike(rf"(?:^|[\t\n\f\r ]){re.escape(name)}(?:$|[\t\n\f\r ])")


def _unquote(value: Column) -> Column:
    quoted = value.startswith('"') | value.startswith("'")
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


@built_once
def attr_map(raw="raw") -> Column:
    """All attributes as a map: names lower-cased, the first of a repeated name wins."""
    body = F.regexp_replace(as_column(raw), r"^<[a-zA-Z][^\s/>]*+|>$", "")
    names = F.transform(F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(1)), F.lower)
    values = F.regexp_extract_all(body, F.lit(ATTRIBUTE), F.lit(2))
    pairs = F.transform(
        values,
        lambda v, i: F.struct(
            F.get(names, i).alias("key"),
            decode_entities(_unquote(v), attribute=True).alias("value"),
            i.alias("at"),
        ),
    )
    first = F.filter(pairs, lambda p: F.array_position(names, p["key"]) == p["at"] + 1)
    return F.map_from_entries(F.transform(first, lambda p: F.struct(p["key"], p["value"])))
