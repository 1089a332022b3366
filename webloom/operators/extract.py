"""Page extractors: each takes a Dom and returns a DataFrame keyed by page_id and pos."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.attrs import attr, attr_map, class_list, has_attr
from webloom.functions.css import simple
from webloom.functions.text import built_once, collapse_ws, js_length, non_empty, trim_js, truncate
from webloom.functions.url import is_external, resolve_url
from webloom.plans.nodes import Dom, contained, is_hidden, with_ancestors, with_text
from webloom.plans.scale import worked_out

# What the page extractors select.
HEADINGS = "h1, h2, h3, h4, h5, h6"
MAIN_CONTENT = 'main, [role="main"], article, .content, #content'
BUTTONS = (
    'button, [role="button"], input[type="button"], input[type="submit"], a.btn, a[href^="javascript:"], '
    '[class*="button"]'
)
INPUTS = 'input:not([type="hidden"]):not([type="button"]):not([type="submit"]), textarea, select'
LINKS = 'a[href]:not([href^="#"]):not([href^="javascript:"]):not([href^="mailto:"])'
LANDMARKS = '[role="main"], [role="navigation"], [role="search"], main, nav, article'
IMAGES = 'img[src]:not([src=""]), [role="img"][aria-label]'
NAVIGATION_UI = 'nav, header, footer, [role="navigation"]'
MAIN_AREA = 'main, [role="main"], #main, article'
PROMINENT = "h1, h2, h3, li"
FORM_FIELDS = "input, select, textarea"
SUBMITS = 'button[type="submit"], input[type="submit"]'
HEADING_LIMIT, LINK_LIMIT, LANDMARK_LIMIT, MAIN_LIMIT, MAIN_FALLBACK_LIMIT = 200, 100, 150, 10_000, 5_000


def context(nodes: DataFrame) -> DataFrame:
    """Nodes with what the extractors need to know about their surroundings; unused flags are pruned."""
    flagged = with_ancestors(
        nodes,
        {
            "hidden": is_hidden(),
            "in_nav": F.col("tag") == "nav",
            "in_navigation": simple(NAVIGATION_UI),
            "in_main": simple(MAIN_AREA),
            "in_prominent": simple(PROMINENT),
        },
    )
    next_image = F.expr(
        "lead(CASE WHEN tag = 'img' THEN pos END) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pos)"
    )
    return flagged.select("*", F.coalesce(next_image < F.col("end"), F.lit(False)).alias("has_image"))


@dataclass(frozen=True)
class Rule:
    """An extractor that looks at one element at a time: which ones, which columns, which rows to keep."""

    test: Callable[[], Column]
    fields: Callable[[], list[Column]]
    keep: Callable[[Callable[[str], Column]], Column] = lambda f: F.lit(True)

    def rows(self, dom: Dom) -> DataFrame:
        picked = with_attrs(with_text(context(dom.nodes).where(self.test()), dom.docs))
        return worked_out(picked.select("page_id", "pos", *self.fields())).where(self.keep(F.col))


def with_attrs(elements: DataFrame) -> DataFrame:
    """Add `attrs`, and the link target as `target`, as columns, so that each is worked out once."""
    mapped = elements.select("*", attr_map().alias("attrs"))
    if "base" not in elements.columns:
        return mapped
    return mapped.select("*", _target().alias("target"))


@built_once
def _target() -> Column:
    return F.when(F.col("tag") == "a", resolve_url(_a("href"), "base"))


@built_once
def _a(name: str) -> Column:
    return F.try_element_at("attrs", F.lit(name))


def _text() -> Column:
    return trim_js("text")


def _id() -> Column:
    return F.coalesce(_a("id"), F.lit("")).alias("id")


def _attributes(*names: str) -> Column:
    return F.struct(*[non_empty(_a(name)).alias(name) for name in names]).alias("attributes")


@built_once
def css_path(tag="tag") -> Column:
    """#id, else .firstClass, else the tag."""
    named = non_empty(_a("id"))
    first = F.get(class_list(_a("class")), F.lit(0))
    return F.coalesce(F.concat(F.lit("#"), named), F.concat(F.lit("."), first), F.col(tag))


@built_once
def _buttons() -> list[Column]:
    return [
        F.col("tag").alias("tag_name"),
        _id(),
        class_list(_a("class")).alias("classes"),
        F.coalesce(non_empty(_text()), non_empty(_a("value")), _a("aria-label"), F.lit("")).alias("text"),
        _attributes("type", "name"),
        (~F.col("hidden")).alias("is_visible"),
        F.coalesce(non_empty(_a("role")), F.lit("button")).alias("role"),
        css_path().alias("selector"),
    ]


@built_once
def _links() -> list[Column]:
    href = F.coalesce("target", F.lit(""))
    return [
        F.lit("a").alias("tag_name"),
        truncate(_text(), LINK_LIMIT).alias("text"),
        href.alias("href"),
        (~F.col("hidden")).alias("is_visible"),
        is_external(href, "url").alias("is_external"),
        F.struct(href.alias("href")).alias("attributes"),
    ]


@built_once
def _landmarks() -> list[Column]:
    return [
        F.col("tag").alias("tag_name"),
        F.coalesce(non_empty(_a("role")), F.col("tag")).alias("role"),
        _id(),
        (~F.col("hidden")).alias("is_visible"),
        F.left(_text(), F.lit(LANDMARK_LIMIT)).alias("content"),
    ]


def _pixels(name: str) -> Column:
    return F.regexp_extract(_a(name), r"^\s*(\d+)", 1).try_cast("int").alias(name)


@built_once
def _images() -> list[Column]:
    return [
        _a("src").alias("src"),
        non_empty(_a("alt")).alias("alt"),
        non_empty(_a("title")).alias("title"),
        _pixels("width"),
        _pixels("height"),
        non_empty(_a("aria-label")).alias("aria_label"),
        (~F.col("hidden")).alias("is_visible"),
    ]


@built_once
def _frames() -> list[Column]:
    no_box = F.coalesce(_pixels("width") == 0, F.lit(False)) | F.coalesce(_pixels("height") == 0, F.lit(False))
    return [
        non_empty(_a("src")).alias("src"),
        non_empty(_a("title")).alias("title"),
        non_empty(_a("width")).alias("width"),
        non_empty(_a("height")).alias("height"),
        (~F.col("hidden") & ~no_box).alias("is_visible"),
    ]


@built_once
def link_score() -> Column:
    """How prominent a content link is."""
    names = class_list(_a("class"))
    call_to_action = (
        F.array_contains(names, "button")
        | (F.coalesce(_a("role"), F.lit("")) == "button")
        | F.exists(names, lambda c: F.contains(c, F.lit("btn")))
    )
    points = [
        (F.col("in_main"), 10),
        (F.length(_text()) > 20, 5),
        (F.col("in_prominent"), 3),
        (F.col("has_image"), 2),
        (call_to_action, 2),
    ]
    return reduce(lambda total, p: total + F.when(p[0], p[1]).otherwise(0), points, F.lit(0))


@built_once
def _navigation() -> list[Column]:
    return [
        _text().alias("text"),
        F.coalesce("target", F.lit("")).alias("href"),
        F.col("in_navigation").alias("is_navigation"),
        link_score().alias("score"),
    ]


def _has_text(f: Callable[[str], Column]) -> Column:
    return f("text") != ""


RULES: dict[str, Rule] = {
    "buttons": Rule(lambda: simple(BUTTONS), _buttons, _has_text),
    "links": Rule(lambda: simple(LINKS), _links, lambda f: _has_text(f) & (f("href") != "")),
    "landmarks": Rule(lambda: simple(LANDMARKS), _landmarks),
    "headings": Rule(
        lambda: F.col("tag").isin(HEADINGS.split(", ")),
        lambda: [
            F.substring("tag", 2, 1).cast("int").alias("level"),
            truncate(_text(), HEADING_LIMIT).alias("text"),
        ],
        _has_text,
    ),
    "images": Rule(
        lambda: simple(IMAGES),
        _images,
        lambda f: f("is_visible")
        & (F.coalesce(f("width"), F.lit(1)) > 0)
        & (F.coalesce(f("height"), F.lit(1)) > 0)
        & ((F.coalesce(f("src"), F.lit("")) != "") | f("aria_label").isNotNull()),
    ),
    "frames": Rule(lambda: F.col("tag") == "iframe", _frames),
    "navigation": Rule(
        lambda: (F.col("tag") == "a") & has_attr("href"),
        _navigation,
        lambda f: (js_length(f("text")) >= 2)
        & (f("href") != "")
        & ~F.startswith(f("href"), F.lit("#"))
        & ~F.startswith(f("href"), F.lit("javascript:")),
    ),
}


def buttons(dom: Dom) -> DataFrame:
    return RULES["buttons"].rows(dom)


def links(dom: Dom) -> DataFrame:
    return RULES["links"].rows(dom)


def landmarks(dom: Dom) -> DataFrame:
    return RULES["landmarks"].rows(dom)


def headings(dom: Dom) -> DataFrame:
    return RULES["headings"].rows(dom)


def images(dom: Dom) -> DataFrame:
    return RULES["images"].rows(dom).drop("is_visible")


def frames(dom: Dom) -> DataFrame:
    return RULES["frames"].rows(dom)


def navigation_order(page_key: str = "page_id") -> Column:
    """Content links by score, ties in document order, then the links of navigation areas."""
    by = Window.partitionBy(page_key).orderBy(
        "is_navigation", F.when(~F.col("is_navigation"), -F.col("score")), "pos"
    )
    return F.row_number().over(by)


def navigation(dom: Dom, with_score: bool = False) -> DataFrame:
    ranked = RULES["navigation"].rows(dom).select("*", navigation_order().alias("rank"))
    return ranked if with_score else ranked.drop("score")


def first_per_page(nodes: DataFrame, test: Column) -> DataFrame:
    """The first element in document order that passes, per page."""
    row = F.struct("pos", "end", "tag", "raw")
    return nodes.where(test).groupBy("page_id").agg(F.min_by(row, "pos").alias("first")).select("page_id", "first.*")


def _per_page(dom: Dom, test: Column, value: Column, name: str) -> DataFrame:
    """One string per page from its first matching element, '' without one."""
    found = with_text(first_per_page(dom.nodes, test), dom.docs).select("page_id", value.alias(name))
    return dom.docs.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce(name, F.lit("")).alias(name)
    )


def title(dom: Dom) -> DataFrame:
    return _per_page(dom, F.col("tag") == "title", collapse_ws("text"), "title")


def url(dom: Dom) -> DataFrame:
    return dom.docs.select("page_id", "url")


def meta_description(dom: Dom) -> DataFrame:
    return _per_page(dom, simple('meta[name="description"]'), trim_js(attr("content")), "meta_description")


def main_content(dom: Dom, max_text: int | None = MAIN_LIMIT) -> DataFrame:
    text = truncate(collapse_ws("text"), max_text or MAIN_FALLBACK_LIMIT)
    return _per_page(dom, simple(MAIN_CONTENT), text, "main_content")


def _in_order(value: Column, name: str, when: Column | None = None) -> Column:
    """Aggregate: the values in document order; no array where there are none."""
    item = F.struct(F.col("pos"), value.alias("value"))
    items = F.sort_array(F.collect_list(F.when(when, item) if when is not None else item))
    return F.transform(items, lambda i: i["value"]).alias(name)


def tables(dom: Dom) -> DataFrame:
    """headers, rows and caption per table; a nested table's cells also count for the tables around it."""
    tag, dom = F.col("tag"), dom.having("table")
    parts = contained(
        dom.nodes.where(tag.isin("table", "tr", "td", "th", "caption")),
        {
            "header": (tag == "table", tag == "th"),
            "caption": (tag == "table", tag == "caption"),
            "row": (tag == "table", tag == "tr"),
            "cell": (tag == "tr", tag == "td"),
        },
        alone={"table": tag == "table"},
    )
    kind = F.col("kind")
    parts = with_text(parts, dom.docs).withColumn("text", _text())
    # Per row: its cells and the tables it lies in. Per table: headers and caption.
    keyed = parts.withColumn("of_row", kind.isin("row", "cell")).withColumn(
        "key", F.when(kind == "row", F.col("pos")).otherwise(F.col("outer_pos"))
    )
    grouped = keyed.groupBy("page_id", "of_row", "key").agg(
        _in_order(F.col("text"), "cells", kind == "cell"),
        F.collect_list(F.when(kind == "row", F.col("outer_pos"))).alias("tables"),
        _in_order(F.col("text"), "headers", kind == "header"),
        F.min_by(F.when(kind == "caption", F.col("text")), F.when(kind == "caption", F.col("pos"))).alias("caption"),
    )
    spread = grouped.select(
        "page_id",
        F.col("key").alias("pos"),
        F.explode(F.when(F.col("of_row"), F.col("tables")).otherwise(F.array("key"))).alias("table_pos"),
        "of_row",
        "cells",
        "headers",
        "caption",
    )
    real_row = F.col("of_row") & (F.size("cells") > 0)
    return (
        spread.groupBy("page_id", "table_pos")
        .agg(
            F.first(F.when(~F.col("of_row") & (F.size("headers") > 0), F.col("headers")), True).alias("headers"),
            _in_order(F.col("cells"), "rows", real_row),
            F.first("caption", True).alias("caption"),
        )
        .withColumnRenamed("table_pos", "pos")
    )


def lists(dom: Dom) -> DataFrame:
    """type and items of lists outside nav with more than one item; nested items count for the outer list too."""
    tag, dom = F.col("tag"), dom.having("ul", "ol")
    flagged = context(dom.nodes).where(tag.isin("ul", "ol", "li")).select(*dom.nodes.columns, "in_nav")
    items = contained(flagged, {"item": (tag.isin("ul", "ol") & ~F.col("in_nav"), tag == "li")})
    items = with_text(items.drop("in_nav", "raw"), dom.docs).withColumn("text", _text())
    return (
        items.groupBy("page_id", "outer_pos", F.col("outer.tag").alias("type"))
        .agg(_in_order(F.col("text"), "items", F.col("text") != ""), F.count("*").alias("_n"))
        .where("_n > 1")
        .select("page_id", F.col("outer_pos").alias("pos"), "type", "items")
    )


def _label_for(text: Column) -> Column:
    """Window: the first label whose `for` names this element's id."""
    is_label = F.col("tag") == "label"
    ref = F.when(is_label, attr("for")).otherwise(attr("id"))
    same = Window.partitionBy("page_id", F.coalesce(ref, F.lit("")))
    found = F.min_by(F.when(is_label, text), F.when(is_label, F.col("pos"))).over(same)
    return F.when(~is_label & (F.coalesce(ref, F.lit("")) != ""), found)


def inputs(dom: Dom) -> DataFrame:
    """Visible kinds of form control with their label and value."""
    tag, dom = F.col("tag"), dom.having("input", "textarea", "select")
    is_input = simple(INPUTS)
    flagged = context(dom.nodes).select(*dom.nodes.columns, "hidden").where(is_input | tag.isin("label", "option"))
    # A select's value is that of its selected option, the last one marked or else the first.
    parts = contained(flagged, {"option": (tag == "select", tag == "option")}, alone={"self": is_input | (tag == "label")})
    parts = with_text(parts, dom.docs).withColumn("text", _text())
    option = F.coalesce(attr("value"), collapse_ws("text"))
    is_option = F.col("kind") == "option"
    own = Window.partitionBy("page_id", "outer_pos")
    marked = F.max_by(F.when(is_option & has_attr("selected"), option), F.when(is_option & has_attr("selected"), F.col("pos"))).over(own)
    first = F.min_by(F.when(is_option, option), F.when(is_option, F.col("pos"))).over(own)
    chosen = parts.select("*", F.coalesce(marked, first).alias("_chosen")).where("kind = 'self'")
    labeled = chosen.select("*", _label_for(F.col("text")).alias("_label")).where("tag <> 'label'")
    checked_kind = F.lower(F.coalesce(_a("type"), F.lit(""))).isin("checkbox", "radio")
    value = (
        F.when(tag == "select", F.col("_chosen"))
        .when(tag == "textarea", F.col("text"))
        .otherwise(F.coalesce(_a("value"), F.when(checked_kind, F.lit("on"))))
    )
    return with_attrs(labeled).select(
        "page_id",
        "pos",
        tag.alias("tag_name"),
        _id(),
        F.coalesce(non_empty(_a("type")), tag).alias("type"),
        non_empty(_a("name")).alias("name"),
        non_empty(_a("placeholder")).alias("placeholder"),
        F.coalesce("_label", F.lit("")).alias("label"),
        _attributes("type", "name", "placeholder"),
        (~F.col("hidden")).alias("is_visible"),
        non_empty(value).alias("value"),
    )


def forms(dom: Dom, ref: Column | None = None) -> DataFrame:
    """Forms with their fields, labels by `for` or by an enclosing label, and the submit text.

    `ref` is worked out for each form, field and submit control (its columns, attrs, text and hidden, and `kind`) and
    adds `form_ref`, `input_refs` and `submit_ref`, the last null without such a control.
    """
    tag, dom = F.col("tag"), dom.having("form")
    is_field, is_submit = simple(FORM_FIELDS), simple(SUBMITS)
    nodes = dom.nodes if ref is None else context(dom.nodes).select(*dom.nodes.columns, "hidden")
    relevant = nodes.where(tag.isin("form", "label") | is_field | is_submit)
    texts = with_text(relevant, dom.docs).drop("url", "base")
    labeled = texts.select("*", _label_for(F.col("text")).alias("_for"))
    parts = contained(
        labeled,
        {"field": (tag == "form", is_field), "submit": (tag == "form", is_submit), "wrap": (tag == "label", is_field)},
        outer=["text"],
        alone={"form": tag == "form"},
    )
    kind = F.col("kind")
    wraps = (kind == "wrap") & (F.col("outer.text") != "")
    near = F.max_by(F.when(wraps, F.col("outer.text")), F.when(wraps, F.col("outer_pos"))).over(
        Window.partitionBy("page_id", "pos")
    )
    parts = parts.select("*", near.alias("_near")).where("kind <> 'wrap'")
    # Without the control's own text, its first occurrence only.
    at = F.instr(trim_js("_near"), F.col("text"))
    rest = F.when(
        (F.col("text") != "") & (at > 0),
        F.concat(
            F.substring(trim_js("_near"), F.lit(1), at - 1),
            F.substring(trim_js("_near"), at + F.length("text"), F.length("_near")),
        ),
    ).otherwise(trim_js("_near"))
    label = F.when(F.col("_for") != "", trim_js("_for")).otherwise(trim_js(rest))
    field = F.struct(
        F.coalesce(non_empty(_a("type")), tag).alias("type"),
        _a("name").alias("name"),
        non_empty(_a("id")).alias("id"),
        non_empty(_a("placeholder")).alias("placeholder"),
        _a("required").isNotNull().alias("required"),
        label.alias("label"),
    )
    own_text = F.coalesce(non_empty(trim_js("text")), non_empty(_a("value")), F.lit("Submit"))
    form = F.struct(
        non_empty(_a("id")).alias("id"),
        _a("action").alias("action"),
        F.coalesce(non_empty(F.upper(_a("method"))), F.lit("GET")).alias("method"),
    )
    # No part is a link, so none has a target.
    parts = with_attrs(parts).withColumn("target", F.lit(None).cast("string"))
    given = [] if ref is None else [ref.alias("ref")]
    first = lambda k: F.min_by(F.when(kind == k, F.col("ref")), F.when(kind == k, F.col("pos"))).alias(f"{k}_ref")
    refs = [] if ref is None else [first("form"), first("submit"), _in_order(F.col("ref"), "input_refs", kind == "field")]
    return (
        parts.select("page_id", "outer_pos", "kind", "pos", field.alias("field"), own_text.alias("own"), form.alias("form"), *given)
        .groupBy("page_id", "outer_pos")
        .agg(
            F.first(F.when(kind == "form", F.col("form")), True).alias("form"),
            _in_order(F.col("field"), "inputs", kind == "field"),
            F.coalesce(
                F.min_by(F.when(kind == "submit", F.col("own")), F.when(kind == "submit", F.col("pos"))), F.lit("Submit")
            ).alias("submit_text"),
            *refs,
        )
        .select("page_id", F.col("outer_pos").alias("pos"), "form.*", "inputs", "submit_text", *(["form_ref", "input_refs", "submit_ref"] if refs else []))
    )


# The extractor registry, in registration order. Values take a Dom and return a DataFrame keyed by page_id.
REGISTRY: dict[str, Callable[[Dom], DataFrame]] = {
    "title": title,
    "url": url,
    "metaDescription": meta_description,
    "buttons": buttons,
    "inputs": inputs,
    "links": links,
    "landmarks": landmarks,
    "headings": headings,
    "mainContent": main_content,
    "tables": tables,
    "lists": lists,
    "images": images,
    "frames": frames,
    "navigation": navigation,
    "forms": forms,
}


BUILT_IN = dict(REGISTRY)


def register(name: str, extractor: Callable[[Dom], DataFrame]) -> None:
    """Add or replace an extractor. Its rows are keyed by page_id and pos, or, if they have no pos, hold one value per
    page in their other column."""
    REGISTRY[name] = extractor


def applicable(**_config) -> list[str]:
    """Names of the extractors that apply to a configuration: all of them."""
    return list(REGISTRY)


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests)
