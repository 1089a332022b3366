"""Queries that resolve actions on rendered pages, with SQL over the source tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.catalog import fixtures as fx
from webloom.functions.attrs import attr
from webloom.operators import resolve
from webloom.plans.nodes import parse
from webloom.plans.scale import merged


def _action(kind, element, value):
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(
        F.lit(kind).alias("type"), text(element).alias("element"), text(value).alias("value"), F.lit(None).cast("string").alias("description")
    )


def _pick(key, options):
    return F.coalesce(*[F.when(key % len(options) == i, o) for i, o in enumerate(options)])


def form_actions(spark, sf_dir):
    """One action per customer's form, of eight kinds."""
    k = F.col("c_custkey")
    s = k.cast("string")
    lit = F.lit
    options = [
        _action("click", F.concat(lit("#name"), s), None),
        _action("input", lit("input.missing"), lit("x")),
        _action("click", F.concat(lit("form#f"), s), None),
        _action("input", lit("#zip"), lit("x")),
        _action("click", lit("input[type=submit]"), None),
        _action("click", lit("button.save"), lit("save")),
        _action("wait", None, None),
        _action("click", lit("div:hover"), None),
    ]
    return fx.table(spark, sf_dir, "customer").select(k.alias("action_id"), k.alias("page_id"), _pick(k, options).alias("action"))


def resolve_elements(spark, sf_dir):
    dom = parse(fx.customer_forms(spark, sf_dir))
    resolved = resolve.resolve_elements(form_actions(spark, sf_dir), dom)
    return resolved.select("action_id", F.col("pos").cast("string").alias("pos"), "strategy", "selector", "unsupported_selector")


def resolution_trace(spark, sf_dir):
    dom = parse(fx.customer_forms(spark, sf_dir))
    resolved = resolve.resolve_elements(form_actions(spark, sf_dir), dom)
    return resolve.resolution_trace(resolved).select("action_id", F.col("priority").cast("bigint").alias("priority"), "strategy", "hit")


def resolve_links(spark, sf_dir):
    """Clicks on links to data sheets: by selector, by link text, by part of the target, and in vain."""
    k = F.col("p_partkey")
    s = k.cast("string")
    options = [
        _action("click", F.concat(F.lit('a[href="/sheets/'), s, F.lit('"]')), None),
        _action("click", F.lit('a[href="/missing"]'), F.lit("DATA SHEET")),
        _action("click", F.concat(F.lit('a[href="(/sheets/'), s, F.lit(')"]')), None),
        _action("click", F.lit('a[href="/none"]'), None),
    ]
    page = F.floor(k / fx.PER_PAGE).cast("bigint")
    actions = fx.table(spark, sf_dir, "part").select(k.alias("action_id"), page.alias("page_id"), _pick(k, options).alias("action"))
    dom = parse(fx.register_pages(spark, sf_dir))
    resolved = resolve.resolve_elements(actions, dom)
    targets = dom.nodes.where("tag = 'a'").select("page_id", "pos", attr("href").alias("href"))
    return resolved.join(merged(targets), ["page_id", "pos"], "left").select("action_id", "strategy", "selector", "href")


def _button_selectors(spark, sf_dir):
    k = F.col("p_partkey")
    options = [F.concat(F.lit("#b"), k.cast("string")), F.lit("button"), F.lit(".my-button"), F.lit("input.none")]
    return fx.table(spark, sf_dir, "part").select(k.alias("page_id"), _pick(k, options).alias("selector"))


def element_exists(spark, sf_dir):
    return resolve.element_exists(_button_selectors(spark, sf_dir), parse(fx.button_pages(spark, sf_dir)))


def element_info(spark, sf_dir):
    found = resolve.element_info(_button_selectors(spark, sf_dir), parse(fx.button_pages(spark, sf_dir)))
    return found.withColumn("is_visible", F.col("is_visible").cast("string"))


def _form_selectors(spark, sf_dir):
    """A structural selector per customer's form: descendants, children, siblings, lists, :not and :has-text."""
    k = F.col("c_custkey")
    options = [
        F.lit("form input"), F.lit("form > label > select"), F.lit("div > p"), F.lit("label, textarea"), F.lit("label + input"),
        F.concat(F.lit('label:has-text("NAME OF '), k.cast("string"), F.lit('")')), F.lit("input:not([type=hidden]):not([type=submit])"), F.lit("label ~ input[type]"),
    ]
    return fx.table(spark, sf_dir, "customer").select(k.alias("page_id"), _pick(k, options).alias("selector"))


def structural_info(spark, sf_dir):
    found = resolve.element_info(_form_selectors(spark, sf_dir), parse(fx.customer_forms(spark, sf_dir)))
    return found.select("page_id", "selector", "found", "count", "tag_name")


def structural_exists(spark, sf_dir):
    found = resolve.element_exists(_form_selectors(spark, sf_dir), parse(fx.customer_forms(spark, sf_dir)))
    return found.select("page_id", "selector", "exists", "count")


def structural_best_match(spark, sf_dir):
    wanted = _form_selectors(spark, sf_dir).withColumnRenamed("selector", "reference")
    return resolve.best_match(wanted, parse(fx.customer_forms(spark, sf_dir)))


def structural_elements(spark, sf_dir):
    asked = _form_selectors(spark, sf_dir)
    actions = asked.select(F.col("page_id").alias("action_id"), "page_id", _action("click", F.col("selector"), None).alias("action"))
    found = resolve.resolve_elements(actions, parse(fx.customer_forms(spark, sf_dir)))
    return found.select("action_id", F.col("pos").cast("string").alias("pos"), "strategy", "selector", "unsupported_selector")


def suggest_selectors(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("page_id"), F.when(F.col("c_custkey") % 2 == 0, "input.none").otherwise("#button").alias("selector")
    )
    found = resolve.suggest_selectors(wanted, parse(fx.customer_forms(spark, sf_dir)))
    return found.select("page_id", "selector", F.array_join("suggestions", ",").alias("suggestions"))


def close_matches(spark, sf_dir):
    wanted = fx.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("#"), F.substring(F.col("p_partkey").cast("string"), 1, 1))).otherwise(F.lit(".bu")).alias("selector"),
    )
    found = resolve.close_matches(wanted, parse(fx.button_pages(spark, sf_dir)))
    return found.select(
        "page_id", "selector", F.col("rank").cast("bigint").alias("rank"), "tag_name", "id", F.array_join("classes", " ").alias("classes"), "text"
    )


def visible_buttons(spark, sf_dir):
    found = resolve.visible_buttons(parse(fx.button_pages(spark, sf_dir)))
    return found.select("page_id", F.col("rank").cast("bigint").alias("rank"), "tag_name", "id", "text", "selector")


def best_match(spark, sf_dir):
    k = F.col("c_custkey")
    references = ["name", "segment", "nation", "zzz", "input[type=text]"]
    wanted = fx.table(spark, sf_dir, "customer").select(k.alias("page_id"), _pick(k, [F.lit(r) for r in references]).alias("reference"))
    return resolve.best_match(wanted, parse(fx.customer_forms(spark, sf_dir)))


def _fallback_actions(spark, sf_dir):
    k = F.col("c_custkey")
    lit = F.lit
    options = [
        _action("input", lit("#search-box"), lit("shoes")),
        _action("click", lit("#go"), lit("Sign in")),
        _action("input", lit("#other"), lit("x")),
        _action("click", lit(".menu-link"), lit("x")),
        _action("click", lit("#other"), lit("x")),
        _action("click", lit("#Search"), lit("x")),
    ]
    return fx.table(spark, sf_dir, "customer").select(k.alias("action_id"), k.alias("page_id"), _pick(k, options).alias("action"))


def fallback_purposes(spark, sf_dir):
    actions = _fallback_actions(spark, sf_dir)
    purpose = resolve.fallback_purpose("action.type", "action.element", "action.value")
    rows = actions.select("action_id", purpose.alias("purpose"))
    return rows.select("action_id", "purpose", F.size(resolve.fallback_selectors("purpose")).cast("bigint").alias("selectors"))


def fallback_elements(spark, sf_dir):
    found = resolve.try_fallbacks(_fallback_actions(spark, sf_dir), parse(fx.customer_forms(spark, sf_dir)))
    return found.select("action_id", "purpose", F.col("pos").cast("string").alias("pos"), "selector")


def find_by_text(spark, sf_dir):
    """Intended mode: the button or link that says so. As written, the first button or link of the page comes back."""
    wanted = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.upper("p_name").alias("text"))
    dom = parse(fx.button_pages(spark, sf_dir))
    intended = resolve.find_by_text(wanted, dom, "intended").select(F.lit("intended").alias("mode"), "page_id", "text", "pos")
    written = resolve.find_by_text(wanted, dom).select(F.lit("reference").alias("mode"), "page_id", "text", "pos")
    return intended.unionByName(written).select("mode", "page_id", "text", F.col("pos").cast("bigint").alias("pos"))


_KIND = "c_custkey % 8"
_B = "b AS (SELECT p_partkey AS page_id, p_partkey % 7 AS kind, 'Buy ' || p_name AS text, p_name FROM part)"
_ASKED = "asked AS (SELECT p_partkey AS page_id, ['#b' || p_partkey, 'button', '.my-button', 'input.none'][p_partkey % 4 + 1] AS selector FROM part)"

# What each of _form_selectors means on a form: how many elements, the first one's tag, and its place.
_STRUCTURAL = """asked AS (
  SELECT c_custkey, ['form input', 'form > label > select', 'div > p', 'label, textarea', 'label + input', 'label:has-text("NAME OF ' || c_custkey || '")',
    'input:not([type=hidden]):not([type=submit])', 'label ~ input[type]'][c_custkey % 8 + 1] AS selector,
    [3, 1, 0, 3, 1, 1, 1, 2][c_custkey % 8 + 1] AS n, ['INPUT', 'SELECT', NULL, 'LABEL', 'INPUT', 'LABEL', 'INPUT', 'INPUT'][c_custkey % 8 + 1] AS tag_name,
    [9, 11, NULL, 7, 9, 7, 9, 18][c_custkey % 8 + 1] AS pos
  FROM customer)"""

ORACLES = {
    "structural_info": f"WITH {_STRUCTURAL} SELECT c_custkey AS page_id, selector, n > 0 AS found, CAST(n AS BIGINT) AS count, tag_name FROM asked",
    "structural_exists": f"WITH {_STRUCTURAL} SELECT c_custkey AS page_id, selector, n > 0 AS exists, CAST(n AS BIGINT) AS count FROM asked",
    "structural_best_match": f"WITH {_STRUCTURAL} SELECT c_custkey AS page_id, selector AS reference, CASE WHEN n > 0 THEN selector END AS match FROM asked",
    "structural_elements": f"""
WITH {_STRUCTURAL}
SELECT c_custkey AS action_id, CAST(pos AS VARCHAR) AS pos, CASE WHEN n > 0 THEN 'DirectSelector' END AS strategy, CASE WHEN n > 0 THEN selector END AS selector,
  FALSE AS unsupported_selector FROM asked""",
    "resolve_elements": f"""
SELECT c_custkey AS action_id, CAST([9, 16, 6, 16, 19, 19, NULL, NULL][{_KIND} + 1] AS VARCHAR) AS pos,
  ['DirectSelector', 'InputPattern', 'DirectSelector', 'SingleElement', 'DirectSelector', 'RoleBased', NULL, NULL][{_KIND} + 1] AS strategy,
  ['#name' || c_custkey, 'textarea', 'form#f' || c_custkey, 'single-input-fallback', 'input[type=submit]', 'role=button[name="save"]', NULL, NULL][{_KIND} + 1] AS selector,
  {_KIND} = 7 AS unsupported_selector
FROM customer""",
    "resolution_trace": f"""
WITH t(kind, priority, strategy, hit) AS (VALUES (0, 100::BIGINT, 'DirectSelector', TRUE), (1, 100, 'DirectSelector', FALSE), (1, 70, 'InputPattern', TRUE),
  (2, 100, 'DirectSelector', TRUE), (3, 100, 'DirectSelector', FALSE), (3, 90, 'IdSelector', FALSE), (3, 40, 'SingleElement', TRUE),
  (4, 100, 'DirectSelector', TRUE), (5, 100, 'DirectSelector', FALSE), (5, 60, 'RoleBased', TRUE), (7, 100, 'DirectSelector', FALSE), (7, 40, 'SingleElement', FALSE))
SELECT c_custkey AS action_id, priority, strategy, hit FROM customer JOIN t ON kind = {_KIND}""",
    "resolve_links": """
SELECT p_partkey AS action_id, ['DirectSelector', 'LinkStrategy', 'LinkStrategy', NULL][p_partkey % 4 + 1] AS strategy,
  ['a[href="/sheets/' || p_partkey || '"]', 'link[text="DATA SHEET"]', 'a[href*="(/sheets/' || p_partkey || ')"]', NULL][p_partkey % 4 + 1] AS selector,
  ['/sheets/' || p_partkey, '/sheets/' || (p_partkey // 24 * 24), '/sheets/' || p_partkey, NULL][p_partkey % 4 + 1] AS href
FROM part""",
    "element_exists": f"""
WITH {_B}, {_ASKED},
found AS (SELECT *, CASE WHEN selector LIKE '#b%' THEN CASE WHEN kind = 0 THEN 1 ELSE 0 END WHEN selector = 'button' THEN 2 + CASE WHEN kind = 0 THEN 1 ELSE 0 END
          WHEN selector = '.my-button' THEN CASE WHEN kind = 6 THEN 1 ELSE 0 END ELSE 0 END AS n FROM b JOIN asked USING (page_id))
SELECT page_id, selector, n > 0 AS exists, CAST(n AS BIGINT) AS count,
  CASE WHEN n > 0 THEN NULL WHEN selector = '.my-button' AND kind = 1 THEN 'Try instead: [role=button]'
       WHEN selector = '.my-button' AND kind = 3 THEN 'Try instead: input[type=submit]' END AS suggestion
FROM found""",
    "element_info": f"""
WITH {_B}, {_ASKED},
i AS (SELECT *, CASE WHEN selector LIKE '#b%' THEN CASE WHEN kind = 0 THEN 1 ELSE 0 END WHEN selector = 'button' THEN 2 + CASE WHEN kind = 0 THEN 1 ELSE 0 END
          WHEN selector = '.my-button' THEN CASE WHEN kind = 6 THEN 1 ELSE 0 END ELSE 0 END AS n FROM b JOIN asked USING (page_id))
SELECT page_id, selector, n > 0 AS found, CAST(n AS BIGINT) AS count, CASE WHEN n > 0 THEN 'true' END AS is_visible,
  CASE WHEN n > 0 THEN CASE WHEN selector = '.my-button' THEN 'SPAN' ELSE 'BUTTON' END END AS tag_name,
  CASE WHEN n > 0 THEN CASE WHEN kind = 0 AND selector <> '.my-button' THEN text ELSE '' END END AS text
FROM i""",
    "suggest_selectors": """
SELECT c_custkey AS page_id, CASE WHEN c_custkey % 2 = 0 THEN 'input.none' ELSE '#button' END AS selector,
  CASE WHEN c_custkey % 2 = 0 THEN 'textarea' ELSE 'input[type=submit]' END AS suggestions FROM customer""",
    "close_matches": f"""
WITH {_B}
SELECT page_id, '#' || left(CAST(page_id AS VARCHAR), 1) AS selector, 1::BIGINT AS rank, 'BUTTON' AS tag_name, 'b' || page_id AS id, '' AS classes, text
FROM b WHERE page_id % 2 = 0 AND kind = 0
UNION ALL SELECT page_id, '.bu', 1, CASE kind WHEN 1 THEN 'DIV' ELSE 'SPAN' END, NULL, CASE kind WHEN 1 THEN 'big buy' ELSE 'my-button' END,
  CASE kind WHEN 1 THEN text ELSE '' END FROM b WHERE page_id % 2 = 1 AND kind IN (1, 6)""",
    "visible_buttons": f"""
WITH {_B}
SELECT page_id, 1::BIGINT AS rank, ['BUTTON', 'DIV', NULL, NULL, 'A'][kind + 1] AS tag_name, CASE kind WHEN 0 THEN 'b' || page_id END AS id, text,
  CASE kind WHEN 0 THEN '#b' || page_id WHEN 1 THEN '.big' ELSE '.btn' END AS selector FROM b WHERE kind IN (0, 1, 4)
UNION ALL SELECT page_id, CASE WHEN kind IN (0, 1, 4) THEN 2 ELSE 1 END, 'BUTTON', NULL, NULL, 'BUTTON' FROM b""",
    "best_match": """
SELECT c_custkey AS page_id, ['name', 'segment', 'nation', 'zzz', 'input[type=text]'][c_custkey % 5 + 1] AS reference,
  ['#name' || c_custkey, 'select[name="segment"]', 'html', NULL, 'textarea'][c_custkey % 5 + 1] AS match FROM customer""",
    "fallback_purposes": """
SELECT c_custkey AS action_id, ['search-input', 'submit-button', 'general-input', 'navigation', 'general-button', 'search-button'][c_custkey % 6 + 1] AS purpose,
  CAST([10, 9, 5, 7, 5, 8][c_custkey % 6 + 1] AS BIGINT) AS selectors FROM customer""",
    "fallback_elements": """
SELECT c_custkey AS action_id, ['search-input', 'submit-button', 'general-input', 'navigation', 'general-button', 'search-button'][c_custkey % 6 + 1] AS purpose,
  CAST([NULL, 19, 16, NULL, NULL, 19][c_custkey % 6 + 1] AS VARCHAR) AS pos,
  [NULL, 'input[type="submit"]', 'textarea', NULL, NULL, 'input[type="submit"]'][c_custkey % 6 + 1] AS selector FROM customer""",
    "find_by_text": f"""
WITH {_B}
SELECT 'intended' AS mode, page_id, upper(p_name) AS text, 6::BIGINT AS pos FROM b WHERE kind IN (0, 1, 4, 5)
UNION ALL SELECT 'reference', page_id, upper(p_name), CASE WHEN kind IN (0, 1, 4, 5) THEN 6 WHEN kind IN (2, 3) THEN 7 ELSE 8 END FROM b""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
