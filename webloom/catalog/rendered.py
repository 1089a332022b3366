"""Queries over pages rendered from part, lineitem and customer; their SQL reads the source tables alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.catalog import fixtures as fx
from webloom.operators import crawl, extract, scrape, snapshot
from webloom.plans.nodes import parse
from webloom.sources.spec import normal_spec


def _big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def tables_roundtrip(spark, sf_dir):
    tables = extract.tables(parse(fx.order_pages(spark, sf_dir)))
    return tables.select(
        "page_id",
        "caption",
        F.array_join("headers", "|").alias("headers"),
        F.size("rows").cast("bigint").alias("row_count"),
        F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";").alias("cells"),
    )


def lists_roundtrip(spark, sf_dir):
    lists = extract.lists(parse(fx.customer_lists(spark, sf_dir)))
    return lists.select("page_id", "type", F.size("items").cast("bigint").alias("item_count"), F.array_join("items", "|").alias("items"))


def forms_roundtrip(spark, sf_dir):
    forms = extract.forms(parse(fx.customer_forms(spark, sf_dir)))
    rows = forms.select("page_id", "id", "action", "method", "submit_text", F.posexplode("inputs").alias("field", "i"))
    return rows.select(
        "page_id", "id", "action", "method", "submit_text", *_big("field"), "i.type", "i.name",
        F.col("i.id").alias("field_id"), "i.placeholder", "i.required", "i.label",
    )


def inputs_roundtrip(spark, sf_dir):
    inputs = extract.inputs(parse(fx.customer_forms(spark, sf_dir)))
    return inputs.select("page_id", "tag_name", "id", "type", "name", "placeholder", "label", "is_visible", "value")


def buttons_roundtrip(spark, sf_dir):
    buttons = extract.buttons(parse(fx.button_pages(spark, sf_dir)))
    return buttons.select(
        "page_id", "tag_name", "id", F.array_join("classes", " ").alias("classes"), "text", "is_visible", "role", "selector",
        F.col("attributes.type").alias("type"), F.col("attributes.name").alias("name"),
    )


def images_roundtrip(spark, sf_dir):
    images = extract.images(parse(fx.media_pages(spark, sf_dir)))
    # Nullable numbers are compared as text.
    size = [F.col(c).cast("string").alias(c) for c in ("width", "height")]
    return images.select("page_id", "src", "alt", *size, "aria_label")


def frames_roundtrip(spark, sf_dir):
    return extract.frames(parse(fx.media_pages(spark, sf_dir))).select("page_id", "src", "title", "width", "is_visible")


def scored_links(spark, sf_dir):
    links = extract.navigation(parse(fx.score_pages(spark, sf_dir)), with_score=True)
    return links.select("page_id", *_big("rank", "score"), "text", "href", "is_navigation")


def described_pages(spark, sf_dir):
    return extract.meta_description(parse(fx.score_pages(spark, sf_dir)))


def compact_lists(spark, sf_dir):
    lists = snapshot.compact_lists(parse(fx.customer_lists(spark, sf_dir)))
    return lists.select("page_id", *_big("rank"), "root", "item_count", "item_link_selector", F.array_join("samples", "|").alias("samples"))


def compact_forms(spark, sf_dir):
    forms = snapshot.compact_forms(parse(fx.customer_forms(spark, sf_dir)), max_fields=2)
    return forms.select("page_id", *_big("rank"), "id", "method", F.size("fields").cast("bigint").alias("fields"), "submit_text")


def snapshot_references(spark, sf_dir):
    """Where the references of each form lead, and whether the view names any that its map does not hold."""
    snap = snapshot.model_snapshot(parse(fx.customer_forms(spark, sf_dir)))
    form = F.col("compact.forms")[0]
    used = F.concat(
        F.transform("compact.controls", lambda c: c["ref_id"]),
        F.array(form["form"]["ref_id"], form["submit"]["ref_id"]),
        F.transform(form["fields"], lambda f: f["input"]["ref_id"]),
    )
    of = lambda ref: F.col("ref_map")[ref["ref_id"]]["selector"]
    return snap.select(
        "page_id",
        of(form["form"]).alias("form"),
        of(form["submit"]).alias("submit"),
        form["submit"]["name"].alias("submit_name"),
        F.array_join(F.transform(form["fields"], lambda f: F.concat(F.coalesce(f["label"], F.lit("-")), F.lit(">"), of(f["input"]))), "|").alias("fields"),
        F.size("ref_map").cast("bigint").alias("refs"),
        F.size(F.array_except(used, F.map_keys("ref_map"))).cast("bigint").alias("missing"),
    )


def compact_pagination(spark, sf_dir):
    return snapshot.compact_pagination(parse(fx.register_pages(spark, sf_dir))).select("page_id", "role", "name", "href")


# The first dialect, with every type of field, every rule and every kind of error.
REGISTER_SPEC = normal_spec(
    {
        "name": "spare parts",
        "description": "entries of a register of spare parts",
        "target": {"baseUrl": fx.SITE},
        "selectors": {
            "container": "article.entry",
            "fields": {
                "part": {"selector": "h3.name", "type": "text", "required": True},
                "cost": {"selector": "p.price", "type": "number", "transform": "extractCurrency"},
                "checked": {"selector": "time", "type": "date"},
                "sheet": {"selector": "a.sheet", "type": "url"},
                "drawing": {"selector": "figure img", "type": "image"},
                "code": {"selector": ":scope", "type": "attribute", "attribute": "data-code"},
                "markup": {"selector": "figure", "type": "html"},
                "millimetres": {"selector": ".size", "type": "number", "transform": "extractCurrency", "fallback": "10"},
                "shelf": {"selector": ".shelf", "type": "text", "fallback": "not shelved"},
                "grade": {"selector": "b.grade", "type": "text"},
                "boxed": {"selector": "i.boxed", "type": "text"},
            },
        },
        "output": {"format": "json", "filename": "parts_{timestamp}"},
        "validation": {
            "requiredFields": ["cost"],
            "dataTypes": {"boxed": "boolean", "cost": "number"},
            "constraints": {"millimetres": {"min": 2, "max": 45}, "grade": {"enum": ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY"]}, "code": {"pattern": r"^SP-\d+[02-9]$"}},
        },
    }
)
# The second dialect: item root, fields as a list, :scope.
DRAWING_SPEC = normal_spec(
    {
        "name": "drawings",
        "target": {"baseUrl": fx.SITE},
        "selectors": {
            "itemRoot": 'img[src$=".svg"]',
            "fields": [{"name": "file", "selector": ":scope", "attr": "src"}, {"name": "kind", "selector": ":scope", "attr": "class"}],
        },
        "output": {"filename": "drawings", "format": "jsonl"},
    }
)
# What to follow: the pages of the register, and from the entries the pages of their makers.
MULTI_SPEC = normal_spec(
    {
        **REGISTER_SPEC,
        "target": {"baseUrl": fx.SITE, "startPath": "/register?page=2"},
        "navigation": {"type": "multi", "followLinks": True, "maxDepth": 3, "allowedDomains": ["parts-register.example"], "excludedPaths": ["/makers/7"]},
        "selectors": {
            **REGISTER_SPEC["selectors"],
            "pagination": {"nextButton": "nav a[rel=next]", "pageIndicator": "nav", "maxPages": 5},
            "links": [{"selector": "a.maker", "attribute": "href", "filter": r"/makers/\d+$", "follow": True}],
        },
        "pagination": {"strategy": "next-button"},
    }
)
GRAPH_SPEC = {
    "navigation": {"maxDepth": 40, "allowedDomains": ["parts-register.example"], "excludedPaths": ["/cart"]},
}


def _scraped(spark, sf_dir):
    return scrape.scraped(parse(fx.register_pages(spark, sf_dir)), REGISTER_SPEC)


def scrape_products(spark, sf_dir):
    items, _ = scrape.scrape(fx.register_pages(spark, sf_dir), REGISTER_SPEC)
    return items.select("page_id", "page_url", "data.*").withColumn("checked", F.date_format("checked", "yyyy-MM-dd"))


def scrape_second_dialect(spark, sf_dir):
    items, _ = scrape.scrape(fx.register_pages(spark, sf_dir), DRAWING_SPEC)
    return items.select("page_id", "data.*")


def scrape_fallbacks(spark, sf_dir):
    rows = _scraped(spark, sf_dir)
    return rows.groupBy("data.shelf", (F.col("data.millimetres") == 10).alias("ten")).agg(F.count("*").alias("items"))


def scrape_errors(spark, sf_dir):
    return scrape.errors(_scraped(spark, sf_dir)).select("page_id", "page_url", "type", "field", "selector", "message")


def scrape_summary(spark, sf_dir):
    return scrape.scrape_summary(_scraped(spark, sf_dir))


def scrape_first_items(spark, sf_dir):
    """maxPages and maxItems: the first items of the first pages."""
    spec = {**REGISTER_SPEC, "target": {**REGISTER_SPEC["target"], "maxPages": 3, "maxItems": 20}}
    items, _ = scrape.scrape(fx.register_pages(spark, sf_dir), spec)
    return items.select("page_id", "data.part", "data.cost")


def _all_pages(spark, sf_dir):
    return fx.register_pages(spark, sf_dir).unionByName(fx.maker_pages(spark, sf_dir))


def walked_pages(spark, sf_dir):
    """Pages that the pagination (five pages of a run) and three links reach from the third page of the register."""
    pages = _all_pages(spark, sf_dir)
    return crawl.walk(pages, parse(pages), MULTI_SPEC).select("page_id", "url", *_big("round", "number"))


def scrape_multi(spark, sf_dir):
    """Items of the pages that a `multi` spec visits."""
    items, _ = scrape.scrape(_all_pages(spark, sf_dir), MULTI_SPEC)
    return items.select("page_id", "data.code", "data.cost")


def scrape_numbered(spark, sf_dir):
    """Pagination by numbers in URLs, stopped by the number of pages and of items."""
    spec = {
        **MULTI_SPEC, "target": {**MULTI_SPEC["target"], "startPath": "/register?page=1", "maxPages": 6, "maxItems": 50},
        "selectors": REGISTER_SPEC["selectors"], "pagination": {"strategy": "url-pattern"},
    }
    items, _ = scrape.scrape(_all_pages(spark, sf_dir), spec)
    return items.select("page_id", "data.code", "data.cost")


def spec_links(spark, sf_dir):
    links = crawl.link_rows(parse(fx.register_pages(spark, sf_dir)), MULTI_SPEC)
    return links.select("page_id", "url", "text", "follow")


def page_chain(spark, sf_dir):
    return crawl.page_chain(parse(fx.register_pages(spark, sf_dir)), "[rel=next]").select(
        "page_id", "url", "next_url", "first_url", *_big("position")
    )


def crawl_depth(spark, sf_dir):
    pages = fx.graph_pages(spark, sf_dir)
    seeds = pages.where("page_id = 0").select("url")
    return crawl.crawl_pages(pages, parse(pages), seeds, GRAPH_SPEC).select("page_id", "url", *_big("depth"))


def discovered_links(spark, sf_dir):
    """The frontier of the link graph beyond its stored pages."""
    pages = fx.graph_pages(spark, sf_dir)
    found = crawl.discover_links(parse(pages), GRAPH_SPEC, visited=pages.select("url"))
    return found.select("url", "text", "follow", *_big("priority"))


_SITE = f"'{fx.SITE}"
_ENTRY = """
entry AS (
  SELECT p_partkey // 24 AS page_id, p_partkey AS k, nullif(CASE WHEN p_partkey % 50 = 7 THEN '' ELSE p_name END, '') AS part,
         CASE WHEN p_partkey % 40 = 11 THEN NULL ELSE round(p_retailprice, 2) END AS cost,
         CASE WHEN p_partkey % 30 <> 4 THEN '20' || (p_partkey % 20 + 10) || '-07-04' END AS checked,
         CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) ELSE 10.0 END AS millimetres,
         CASE WHEN p_partkey % 2 = 0 THEN 'rack B & C' ELSE 'not shelved' END AS shelf, p_type AS grade,
         CASE WHEN p_partkey % 25 = 3 THEN 'perhaps' WHEN p_partkey % 2 = 0 THEN 'true' ELSE 'false' END AS boxed,
         'SP-' || p_partkey AS code, CAST(substr(p_brand, 7, 2) AS BIGINT) AS maker
  FROM part),
wrong AS (
  SELECT *, [CASE WHEN part IS NULL THEN 'part' END, CASE WHEN cost IS NULL THEN 'cost' END, CASE WHEN millimetres NOT BETWEEN 2 AND 45 THEN 'millimetres' END,
    CASE WHEN grade = 'PROMO' THEN 'grade' END, CASE WHEN boxed = 'perhaps' THEN 'boxed' END, CASE WHEN code LIKE '%1' OR length(code) < 5 THEN 'code' END] AS fields FROM entry),
valid AS (SELECT * FROM wrong WHERE len(list_filter(fields, lambda f: f IS NOT NULL)) = 0)"""
_URL = f"{_SITE}/register?page=' || page_id"
# Pages reached from page 2 by runs of five pages and three links between makers.
_WALKED = f"""
RECURSIVE {_ENTRY},
register AS (SELECT DISTINCT page_id, page_id - 1 AS number FROM entry WHERE page_id BETWEEN 2 AND 6),
makers AS (SELECT DISTINCT maker AS m FROM entry),
linked AS (
  SELECT DISTINCT maker AS m, 1 AS round FROM entry JOIN register USING (page_id) WHERE k % 10 = 0 AND NOT starts_with('/makers/' || maker, '/makers/7')
  UNION SELECT l.m + 1, l.round + 1 FROM linked l JOIN makers ON makers.m = l.m + 1 WHERE l.round < 3 AND NOT starts_with('/makers/' || (l.m + 1), '/makers/7')),
walked AS (
  SELECT page_id, {_URL} AS url, 0::BIGINT AS round, number::BIGINT AS number FROM register
  UNION ALL SELECT 1000000000 + m, {_SITE}/makers/' || m, min(round)::BIGINT, 1 FROM linked GROUP BY m)"""


ORACLES = {
    "tables_roundtrip": """
WITH t AS (
  SELECT l_orderkey, count(*) AS row_count, string_agg(l_linenumber || ',part ' || l_partkey || ',' || l_returnflag, ';' ORDER BY l_linenumber, l_partkey || ' <td>' || l_returnflag) AS cells
  FROM lineitem GROUP BY 1)
SELECT l_orderkey // 10 AS page_id, 'Order ' || l_orderkey AS caption, 'Line|Part|Flag' AS headers, row_count, cells FROM t""",
    "lists_roundtrip": """
WITH c AS (SELECT c_custkey // 20 AS page_id, *, c_custkey % 5 = 0 AS nested FROM customer)
SELECT page_id, 'ul' AS type, sum(CASE WHEN nested THEN 3 ELSE 1 END)::BIGINT AS item_count,
       string_agg(CASE WHEN nested THEN c_name || c_mktsegment || 'nation ' || c_nationkey || '|' || c_mktsegment || '|nation ' || c_nationkey
                       ELSE c_name END, '|' ORDER BY c_custkey) AS items
FROM c GROUP BY 1
UNION ALL SELECT page_id, 'ol', 2, c_mktsegment || '|nation ' || c_nationkey FROM c WHERE nested""",
    "forms_roundtrip": """
SELECT c_custkey AS page_id, 'f' || c_custkey AS id, '/save/' || c_custkey AS action, 'POST' AS method, 'Save ' || c_custkey AS submit_text,
       field, CASE field WHEN 0 THEN 'input' WHEN 1 THEN 'select' WHEN 2 THEN 'textarea' WHEN 3 THEN 'hidden' ELSE 'submit' END AS type,
       CASE field WHEN 0 THEN 'name' WHEN 1 THEN 'segment' WHEN 2 THEN 'note' WHEN 3 THEN 'key' END AS name,
       CASE field WHEN 0 THEN 'name' || c_custkey END AS field_id, CASE field WHEN 0 THEN 'Your name' END AS placeholder,
       field = 0 AS required, CASE field WHEN 0 THEN 'Name of ' || c_custkey WHEN 1 THEN 'Segment' END AS label
FROM customer, (SELECT unnest(range(0, 5)) AS field)""",
    "inputs_roundtrip": """
SELECT c_custkey AS page_id, tag_name, CASE tag_name WHEN 'input' THEN 'name' || c_custkey ELSE '' END AS id, tag_name AS type,
       CASE tag_name WHEN 'input' THEN 'name' WHEN 'select' THEN 'segment' ELSE 'note' END AS name,
       CASE tag_name WHEN 'input' THEN 'Your name' END AS placeholder,
       CASE tag_name WHEN 'input' THEN 'Name of ' || c_custkey ELSE '' END AS label, TRUE AS is_visible,
       CASE tag_name WHEN 'input' THEN c_name WHEN 'select' THEN c_mktsegment ELSE 'nation ' || c_nationkey END AS value
FROM customer, (SELECT unnest(['input', 'select', 'textarea']) AS tag_name)""",
    "buttons_roundtrip": """
WITH b AS (SELECT p_partkey AS page_id, p_partkey % 7 AS kind, 'Buy ' || p_name AS text FROM part)
SELECT page_id, ['button', 'div', 'input', 'input', 'a', 'a', 'span'][kind + 1] AS tag_name,
       CASE kind WHEN 0 THEN 'b' || page_id ELSE '' END AS id,
       ['', 'big buy', '', '', 'btn primary', '', 'my-button'][kind + 1] AS classes, text, TRUE AS is_visible, 'button' AS role,
       CASE kind WHEN 0 THEN '#b' || page_id ELSE ['', '.big', 'input', 'input', '.btn', 'a', '.my-button'][kind + 1] END AS selector,
       CASE kind WHEN 0 THEN 'button' WHEN 2 THEN 'button' WHEN 3 THEN 'submit' END AS type, CASE kind WHEN 2 THEN 'buy' END AS name FROM b
UNION ALL SELECT page_id, 'button', '', 'x', 'Hidden', FALSE, 'button', '.x', NULL, NULL FROM b""",
    "images_roundtrip": """
SELECT p_partkey AS page_id, '/i/' || p_partkey || '.png' AS src, p_name AS alt, CAST(p_size AS VARCHAR) AS width, '20' AS height, NULL AS aria_label FROM part
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, 'icon ' || p_partkey FROM part""",
    "frames_roundtrip": """
SELECT p_partkey AS page_id, '/f/' || p_partkey AS src, p_brand AS title, '300' AS width, TRUE AS is_visible FROM part
UNION ALL SELECT p_partkey, NULL, NULL, '0', FALSE FROM part""",
    "scored_links": f"""
SELECT p_partkey AS page_id, rank, score, text, {_SITE}' || CASE WHEN rank = 6 THEN '/home' ELSE path || p_partkey END AS href, rank = 6 AS is_navigation
FROM part, (VALUES (1::BIGINT, 12::BIGINT, 'call', '/call/'), (2, 12, 'image', '/image/'), (3, 5, 'a text of more than twenty characters', '/long/'),
  (4, 3, 'head', '/head/'), (5, 0, 'plain', '/plain/'), (6, 5, 'Home page of the store', '')) AS l(rank, score, text, path)""",
    "described_pages": "SELECT p_partkey AS page_id, 'parts & more' AS meta_description FROM part",
    "compact_lists": """
WITH c AS (SELECT c_custkey // 20 AS page_id, *, c_custkey % 5 = 0 AS nested FROM customer),
top AS (SELECT page_id, 1::BIGINT AS rank, 'ul' AS root, sum(CASE WHEN nested THEN 3 ELSE 1 END)::BIGINT AS item_count, NULL::VARCHAR AS item_link_selector,
        arg_min(c_name || c_mktsegment || 'nation ' || c_nationkey || '|' || c_mktsegment || '|nation ' || c_nationkey, c_custkey) AS samples FROM c GROUP BY 1)
SELECT * FROM top
UNION ALL SELECT page_id, 2, 'ol', 2, NULL, arg_min(c_mktsegment || '|nation ' || c_nationkey, c_custkey) FROM c WHERE nested GROUP BY 1""",
    "compact_forms": "SELECT c_custkey AS page_id, 1::BIGINT AS rank, 'f' || c_custkey AS id, 'POST' AS method, 2::BIGINT AS fields, 'Save ' || c_custkey AS submit_text FROM customer",
    "snapshot_references": """
        SELECT c_custkey AS page_id, '#f' || c_custkey AS form, 'input' AS submit, 'Save ' || c_custkey AS submit_name,
            'Name of ' || c_custkey || '>#name' || c_custkey || '|Segment>select|->textarea|->input|->input' AS fields, 6::BIGINT AS refs, 0::BIGINT AS missing
        FROM customer
    """,
    "compact_pagination": f"""
SELECT DISTINCT p_partkey // 24 AS page_id, 'link' AS role, 'Next' AS name, {_SITE}/register?page=' || (p_partkey // 24 + 1) AS href
FROM part WHERE p_partkey // 24 < (SELECT max(p_partkey) // 24 FROM part)""",
    "scrape_products": f"""
WITH {_ENTRY}
SELECT page_id, {_URL} AS page_url, part, cost, checked, {_SITE}/sheets/' || k AS sheet, {_SITE}/drawings/' || k || '.svg' AS drawing, code,
       '<img src="/drawings/' || k || '.svg">' AS markup, millimetres, shelf, grade, boxed
FROM valid""",
    "scrape_second_dialect": "SELECT p_partkey // 24 AS page_id, '/drawings/' || p_partkey || '.svg' AS file, NULL::VARCHAR AS kind FROM part",
    "scrape_fallbacks": f"WITH {_ENTRY} SELECT shelf, millimetres = 10 AS ten, count(*) AS items FROM entry GROUP BY ALL",
    "scrape_errors": f"""
WITH {_ENTRY},
said(field, selector, message) AS (VALUES ('part', 'h3.name', 'part is required'), ('cost', 'p.price', 'cost is required'), ('millimetres', '.size', 'millimetres is out of bounds'),
  ('grade', 'b.grade', 'grade is out of bounds'), ('boxed', 'i.boxed', 'boxed is not a boolean'), ('code', ':scope', 'code is out of bounds'))
SELECT page_id, {_URL} AS page_url, 'validation' AS type, field, selector, message FROM (SELECT page_id, unnest(fields) AS field FROM wrong) JOIN said USING (field)
UNION ALL SELECT page_id, {_URL}, 'extraction', 'checked', 'time', 'checked is not a date' FROM entry WHERE checked IS NULL""",
    "scrape_summary": f"""
WITH {_ENTRY}
SELECT count(DISTINCT page_id) AS page_count, (SELECT count(*) FROM valid) AS item_count,
       CAST(sum(len(list_filter(fields, lambda f: f IS NOT NULL))) + count(*) FILTER (WHERE checked IS NULL) AS BIGINT) AS error_count
FROM wrong""",
    "scrape_first_items": f"WITH {_ENTRY} SELECT page_id, part, cost FROM valid WHERE page_id < 3 ORDER BY k LIMIT 20",
    "walked_pages": f"WITH {_WALKED} SELECT page_id, url, round, number FROM walked",
    # A maker's page has an entry too, with a code that breaks the pattern and so counts as an error, not as an item.
    "scrape_multi": f"WITH {_WALKED} SELECT page_id, code, cost FROM valid WHERE page_id BETWEEN 2 AND 6",
    "scrape_numbered": f"WITH {_ENTRY} SELECT page_id, code, cost FROM valid WHERE page_id BETWEEN 1 AND 6 ORDER BY k LIMIT 50",
    "spec_links": f"WITH {_ENTRY} SELECT page_id, {_SITE}/makers/' || maker AS url, 'Brand#' || maker AS text, TRUE AS follow FROM entry WHERE k % 10 = 0",
    "page_chain": f"""
WITH p AS (SELECT DISTINCT p_partkey // 24 AS page_id FROM part)
SELECT page_id, {_URL} AS url, CASE WHEN page_id < (SELECT max(page_id) FROM p) THEN {_SITE}/register?page=' || (page_id + 1) END AS next_url,
       {_SITE}/register?page=0' AS first_url, page_id + 1 AS position FROM p""",
    "crawl_depth": f"""
WITH RECURSIVE d AS (
  SELECT 0::BIGINT AS k, 0::BIGINT AS depth
  UNION ALL SELECT c_custkey, depth + 1 FROM d JOIN customer ON c_custkey BETWEEN k * 10 + 1 AND k * 10 + 10)
SELECT k AS page_id, {_SITE}/c/' || k AS url, depth FROM d""",
    "discovered_links": f"""
SELECT {_SITE}/c/' || c AS url, 'child' AS text, TRUE AS follow, 3::BIGINT AS priority
FROM (SELECT unnest(range(c_custkey * 10 + 1, c_custkey * 10 + 11)) AS c FROM customer) WHERE c NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT {_SITE}/c/-1', 'parent', TRUE, 0""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
