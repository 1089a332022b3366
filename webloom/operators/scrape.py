"""Schema-driven scraping: one item per container match, typed fields, fallbacks and validation."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.css import match, parse_selector
from webloom.functions.text import non_empty, trim_js
from webloom.functions.url import origin, resolve_url
from webloom.operators import crawl
from webloom.operators.extract import with_attrs
from webloom.plans.nodes import Dom, parse, with_html, with_text
from webloom.plans.scale import first_rows


def extract_currency(text: Column) -> Column:
    """The first number of a price text, thousands separators removed, as text."""
    number = F.regexp_extract(text, r"(-?\d[\d,]*(?:\.\d+)?)", 1)
    return non_empty(F.replace(number, F.lit(","), F.lit("")))


# Named transforms: text column -> text column. Extend with register_transform.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {"extractCurrency": extract_currency}


def register_transform(name: str, function: Callable[[Column], Column]) -> None:
    TRANSFORMS[name] = function


def site_pages(pages: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """The stored pages of the site a spec names."""
    base = (spec.get("target") or {}).get("baseUrl")
    return pages.where(origin("url") == F.lit(base.rstrip("/"))) if base else pages


def select_pages(pages: DataFrame, spec: dict[str, Any]) -> DataFrame:
    """The pages a spec is about, as far as that can be told without their links: its site, the start page only for
    `single`, at most maxPages by page_id. Which pages `multi` reaches is up to `crawl.walk`."""
    target = spec.get("target") or {}
    kind = (spec.get("navigation") or {}).get("type")
    pages = site_pages(pages, spec)
    if kind == "single" and target.get("baseUrl"):
        pages = pages.where(F.col("url") == F.lit(crawl.start_url(spec)))
    if target.get("maxPages") is not None and kind != "multi":
        # Ids are ranked, not pages.
        first = first_rows(pages.select("page_id"), ["page_id"], target["maxPages"])
        pages = pages.join(first, "page_id", "left_semi")
    return pages


def _is_scope(selector: str) -> bool:
    chains = parse_selector(selector)
    return len(chains) == 1 and len(chains[0]) == 1 and chains[0][0].scope


def _raw_value(field: dict[str, Any]) -> Column:
    """What the matched element holds, as text; null when there is nothing."""
    kind = field["type"]
    of = lambda name: F.try_element_at("attrs", F.lit(name))
    if kind == "html":
        value = F.col("html")
    elif kind == "attribute" or field.get("attribute"):
        value = of((field.get("attribute") or "").lower())
    elif kind == "url":
        value = resolve_url(of("href"), "base")
    elif kind == "image":
        value = resolve_url(of("src"), "base")
    else:
        value = trim_js("text")
    return non_empty(value)


def _typed(kind: str, value: Column) -> Column:
    if kind == "number":
        return value.try_cast("double")
    if kind == "date":
        return F.try_to_timestamp(value)
    return value


def _has_type(kind: str, value: Column) -> Column:
    text = value.cast("string")
    if kind == "number":
        return text.try_cast("double").isNotNull()
    if kind == "date":
        return F.try_to_timestamp(text).isNotNull()
    if kind == "boolean":
        return text.try_cast("boolean").isNotNull()
    return F.lit(True)


def _breaks(rules: dict[str, Any], value: Column) -> Column:
    """Is a present value outside the constraint?"""
    number = value.cast("string").try_cast("double")
    broken = F.lit(False)
    if "min" in rules:
        broken = broken | F.coalesce(number < float(rules["min"]), F.lit(True))
    if "max" in rules:
        broken = broken | F.coalesce(number > float(rules["max"]), F.lit(True))
    if "pattern" in rules:
        broken = broken | ~value.cast("string").rlike(rules["pattern"])
    if "enum" in rules:
        broken = broken | ~value.cast("string").isin([str(v) for v in rules["enum"]])
    return value.isNotNull() & broken


def _error(kind: str, field: str, selector: str, message: str, when: Column) -> Column:
    return F.when(
        when,
        F.struct(
            F.lit(kind).alias("type"),
            F.lit(field).alias("field"),
            F.lit(selector).alias("selector"),
            F.lit(message).alias("message"),
        ),
    )


def scraped(dom: Dom, spec: dict[str, Any]) -> DataFrame:
    """All container matches: page_id, page_url, pos, data (struct of fields), errors (array)."""
    fields: dict[str, dict[str, Any]] = spec["selectors"]["fields"]
    names = {n: f"_f{i}" for i, n in enumerate(fields)}
    selectors = {"_container": spec["selectors"]["container"]}
    selectors |= {names[n]: f["selector"] for n, f in fields.items() if not _is_scope(f["selector"])}
    rows = with_text(match(dom.nodes, selectors).where(" or ".join(selectors)), dom.docs)
    if any(f["type"] == "html" for f in fields.values()):
        rows = with_html(rows, dom.docs)
    # A field is the first match inside its container, even if that holds nothing: the next one in the page, if it
    # starts before the container ends. So each match is read once and nothing is paired.
    found = []
    for n, f in fields.items():
        value = F.struct(F.col("pos").alias("at"), _raw_value(f).alias("value"))
        if _is_scope(f["selector"]):
            found.append(F.when(F.col("_container"), value).alias(names[n]))
        else:
            found.append(F.when(F.col(names[n]), value).alias(names[n]))
    read = with_attrs(rows).select("page_id", F.col("url").alias("page_url"), "pos", "end", "_container", *found)
    following = [
        F.col(names[n]) if _is_scope(f["selector"]) else F.expr(f"lead({names[n]}) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)").alias(names[n])
        for n, f in fields.items()
    ]
    raw = read.select("page_id", "page_url", "pos", "end", "_container", *following).where("_container")
    inside = [
        F.when((F.col(f"{names[n]}.at") < F.col("end")) | F.lit(_is_scope(f["selector"])), F.col(f"{names[n]}.value")).alias(names[n])
        for n, f in fields.items()
    ]
    raw = raw.select("page_id", "page_url", F.col("pos").alias("outer_pos"), *inside)

    filled = []
    for n, f in fields.items():
        value = F.col(names[n])
        if f.get("transform"):
            if f["transform"] not in TRANSFORMS:
                raise ValueError(f"unknown transform: {f['transform']}")
            value = TRANSFORMS[f["transform"]](value)
        if f.get("fallback") is not None:
            value = F.coalesce(value, F.lit(str(f["fallback"])))
        filled.append(value.alias(names[n]))
    raw = raw.select("page_id", "page_url", "outer_pos", *filled)

    validation = spec.get("validation") or {}
    required = {n for n, f in fields.items() if f.get("required")} | set(validation.get("requiredFields") or [])
    errors = []
    for n, f in fields.items():
        text, value = F.col(names[n]), _typed(f["type"], F.col(names[n]))
        about = (n, f["selector"])
        errors.append(
            _error("extraction", *about, f"{n} is not a {f['type']}", text.isNotNull() & value.isNull())
        )
        if n in required:
            errors.append(_error("validation", *about, f"{n} is required", value.isNull()))
        wanted = (validation.get("dataTypes") or {}).get(n)
        if wanted:
            wrong = value.isNotNull() & ~_has_type(wanted, value)
            errors.append(_error("validation", *about, f"{n} is not a {wanted}", wrong))
        rules = (validation.get("constraints") or {}).get(n)
        if rules:
            errors.append(_error("validation", *about, f"{n} is out of bounds", _breaks(rules, value)))
    for n in sorted(required - set(fields)):
        errors.append(_error("validation", n, "", f"{n} is required", F.lit(True)))
    data = F.struct(*[_typed(f["type"], F.col(names[n])).alias(n) for n, f in fields.items()])
    none = F.array().cast("array<struct<type:string,field:string,selector:string,message:string>>")
    return raw.select(
        "page_id",
        "page_url",
        F.col("outer_pos").alias("pos"),
        data.alias("data"),
        (F.array_compact(F.array(*errors)) if errors else none).alias("errors"),
    )


def items(rows: DataFrame, spec: dict[str, Any] | None = None) -> DataFrame:
    """Valid items; with a spec's maxItems, the first ones by page_id and position."""
    valid = rows.where(~F.exists("errors", lambda e: e["type"] == "validation")).select(
        "page_id", "page_url", "pos", "data"
    )
    limit = ((spec or {}).get("target") or {}).get("maxItems")
    return first_rows(valid, ["page_id", "pos"], limit) if limit is not None else valid


def errors(rows: DataFrame) -> DataFrame:
    """One row per error."""
    return rows.select("page_id", "page_url", "pos", F.explode("errors").alias("e")).select(
        "page_id", "page_url", "pos", "e.*"
    )


def scrape_rows(pages: DataFrame, spec: dict[str, Any], partitions: int | None = None) -> DataFrame:
    """All container matches (see `scraped`) of the pages a spec selects. Pages that cannot count are dropped before any
    parsing; `multi` follows pagination and links from the start page over the stored pages (see `crawl.walk`)."""
    chosen = select_pages(pages, spec)
    dom = parse(chosen, partitions)
    if (spec.get("navigation") or {}).get("type") == "multi" and (spec.get("target") or {}).get("baseUrl"):
        reached = crawl.walk(chosen, dom, spec).select("page_id")
        dom = Dom(*[part.join(reached, "page_id", "left_semi") for part in (dom.nodes, dom.docs)])
    return scraped(dom, spec)


def scrape(pages: DataFrame, spec: dict[str, Any], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Items and errors of the pages a spec selects. `partitions` as for `parse`."""
    rows = scrape_rows(pages, spec, partitions)
    return items(rows, spec), errors(rows)


def scrape_summary(rows: DataFrame) -> DataFrame:
    """page_count, item_count and error_count of a scrape."""
    bad = F.exists("errors", lambda e: e["type"] == "validation")
    per_page = rows.groupBy("page_id").agg(
        F.count(F.when(~bad, 1)).alias("items"), F.sum(F.size("errors")).alias("errors")
    )
    return per_page.agg(
        F.count("*").alias("page_count"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("item_count"),
        F.coalesce(F.sum("errors"), F.lit(0)).alias("error_count"),
    )
