"""Queries over agent messages and action logs made from the events table, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.catalog import fixtures as fx
from webloom.operators import actions, history
from webloom.plans.scale import number_rows


def _parsed(spark, sf_dir):
    return actions.parse_actions(fx.action_text(spark, sf_dir))


def _log(spark, sf_dir):
    """The log with each user's actions numbered in time order."""
    log = fx.unnumbered_log(spark, sf_dir).withColumnRenamed("seq", "event_id")
    at = F.unix_micros("ts")
    return number_rows(log.withColumn("at", at), ["session_id"], "at", then=["event_id"]).drop("at")


def _history(spark, sf_dir):
    return fx.history_lines(_log(spark, sf_dir))


def _parsed_by(spark, sf_dir, method):
    rows = _parsed(spark, sf_dir).where(F.col("method") == method)
    return rows.select("session_id", "seq", "action.*")


def parse_actions_json(spark, sf_dir):
    return _parsed_by(spark, sf_dir, "json")


def parse_actions_embedded(spark, sf_dir):
    return _parsed_by(spark, sf_dir, "embedded_json")


def parse_actions_key_value(spark, sf_dir):
    return _parsed_by(spark, sf_dir, "key_value")


def parse_actions_help(spark, sf_dir):
    return _parsed_by(spark, sf_dir, "help")


def parse_actions_loose(spark, sf_dir):
    """Loose patterns as intended; as written they find nothing here."""
    rows = actions.parse_actions(fx.action_text(spark, sf_dir), mode="intended").where("method = 'loose'")
    return rows.select("session_id", "seq", "action.type", "action.direction", "action.element")


def parse_conversations(spark, sf_dir):
    """Conversations hold no actions: every turn comes out unparsed."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return actions.unparsed(actions.parse_actions(turns)).select("conv_id", "turn")


def parse_report(spark, sf_dir):
    return actions.parse_report(_parsed(spark, sf_dir))


def action_checks(spark, sf_dir):
    checked = actions.check_action(_parsed(spark, sf_dir).where("action is not null"))
    return checked.groupBy("valid", F.array_join("problems", ";").alias("problems"), "action.selectorType").agg(
        F.count("*").alias("actions")
    )


def action_defaults(spark, sf_dir):
    """Defaults over the numbered log: clicks get the page's URL unless they have one."""
    log = fx.unnumbered_log(spark, sf_dir)
    a = F.col("action")
    bare = F.struct(
        a["type"].alias("type"),
        F.when(F.col("seq") % 2 == 0, a["previousUrl"]).alias("previousUrl"),
        F.when(F.col("seq") % 3 == 0, F.lit(0.0)).when(F.col("seq") % 3 == 1, F.lit(7.0)).alias("maxWait"),
        F.lit(None).cast("string").alias("selectorType"),
        F.lit(None).cast("string").alias("question"),
    )
    page = F.concat(F.lit("https://page.example/"), F.col("session_id").cast("string"))
    rows = log.select("session_id", "seq", bare.alias("action"), page.alias("page_url"))
    return actions.action_defaults(rows).select("session_id", "seq", "action.*")


def selector_checks(spark, sf_dir):
    """Is the action's element among the interactive ones, exactly or as a part?"""
    log = fx.unnumbered_log(spark, sf_dir).where("action.element is not null")
    k = F.substring("action.element", 3, 1)
    listed = F.array(F.lit("#e0"), F.lit("form #e1 input"), F.lit("#e3x"))
    rows = log.withColumn("interactive", listed)
    checked = actions.missing_from_state(rows)
    return checked.groupBy(k.alias("k"), actions.verify_selector(F.col("action.element"), F.col("interactive")).alias("known"), "missing_element").agg(
        F.count("*").alias("actions")
    )


def numbered_log(spark, sf_dir):
    return _log(spark, sf_dir).select("session_id", "event_id", "seq")


def numbered_log_in_ranges(spark, sf_dir):
    """The same numbers with every user cut into ranges of at most about 20 rows."""
    log = fx.unnumbered_log(spark, sf_dir).withColumnRenamed("seq", "event_id").withColumn("at", F.unix_micros("ts"))
    return number_rows(log, ["session_id"], "at", max_rows=20).select("session_id", "event_id", "seq")


def redundant_actions(spark, sf_dir):
    return history.is_redundant(_log(spark, sf_dir)).select("session_id", "seq", "action.type", "redundant")


def action_feedback(spark, sf_dir):
    return history.action_feedback(_log(spark, sf_dir)).where("feedback <> ''").select("session_id", "seq", "feedback")


def repeated_patterns(spark, sf_dir):
    """Every target that was clicked is a pattern of its own."""
    found = history.ranked_patterns(history.repeated_patterns(_history(spark, sf_dir), mode="intended"))
    return found.select("session_id", "pattern", "count", "success", F.col("rank").cast("bigint").alias("rank"))


def repeated_patterns_intended(spark, sf_dir):
    found = history.repeated_patterns(_history(spark, sf_dir), mode="intended")
    return found.select("session_id", "pattern", "count", "success")


def compressed_history(spark, sf_dir):
    return history.compress_history(_history(spark, sf_dir), max_items=9)


def run_stats(spark, sf_dir):
    return history.run_stats(fx.unnumbered_log(spark, sf_dir))


def verified_actions(spark, sf_dir):
    """Outcomes against what the log says was seen afterwards."""
    log = fx.unnumbered_log(spark, sf_dir)
    number = F.col("seq") % 4
    current = F.concat(F.lit("https://x.example/"), number.cast("string"), F.lit("?from=log"))
    observed = F.concat(F.lit("v"), number.cast("string"))
    rows = log.withColumn("current_url", current).withColumn("observed_value", observed)
    return history.verify_actions(rows).groupBy("action.type", "verified", F.col("url_changed").cast("string").alias("url_changed")).agg(F.count("*").alias("actions"))


def verify_navigate(spark, sf_dir):
    """Every page against a target made from the next page's URL, its own, its path, and nothing."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    kind = F.col("page_id") % 5
    target = (
        F.when(kind == 0, F.col("url"))
        .when(kind == 1, F.regexp_replace("url", r"[?#].*$", ""))
        .when(kind == 2, F.concat(F.col("url"), F.lit("/more")))
        .when(kind == 3, F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1))
        .otherwise(F.lit(""))
    )
    return pages.select("page_id", history.verify_navigate("url", target).alias("arrived"))


def text_matches(spark, sf_dir):
    """Each document's text compared with that of the first document of the same length."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "n_chars", "text")
    firsts = documents.groupBy("n_chars").agg(F.min(F.struct("doc_id", "text")).alias("first"))
    pairs = documents.join(firsts, documents["n_chars"].eqNullSafe(firsts["n_chars"]))
    return pairs.select(documents["doc_id"], F.col("first.doc_id").alias("first_id"), history.text_similarity("text", "first.text").cast("bigint").alias("similarity"))


_K = "json_extract_string(props, '$.k')"
_ID = "user_id AS session_id, event_id AS seq"
_NULLS = "CAST(NULL AS VARCHAR)"


def _action(**fields: str) -> str:
    names = ["type", "element", "value", "description", "question", "previousUrl", "selectorType", "maxWait", "operation", "note", "direction"]
    return ", ".join(f'{fields.get(n, _NULLS)} AS "{n}"' for n in names)


_LOG = """
log AS (
  SELECT user_id AS session_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq,
         CASE event_type WHEN 'click' THEN 'click' WHEN 'view' THEN 'navigate' WHEN 'signup' THEN 'input' WHEN 'purchase' THEN 'wait' ELSE 'scroll' END AS type,
         CASE WHEN event_type IN ('click', 'signup') THEN '#e' || k END AS element,
         CASE event_type WHEN 'signup' THEN 'v' || k WHEN 'view' THEN 'https://x.example/' || k END AS value,
         CASE WHEN event_type = 'error' THEN 'fail' WHEN value > 20 THEN 'partial' ELSE 'success' END AS result
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 4 AS k FROM events))"""
# Log rows with what a row has in common with the three before it.
_SAME = ", ".join(
    f"""coalesce(type = lag(type, {i}) OVER w AND CASE type WHEN 'click' THEN element IS NOT DISTINCT FROM lag(element, {i}) OVER w
  WHEN 'input' THEN element IS NOT DISTINCT FROM lag(element, {i}) OVER w AND value IS NOT DISTINCT FROM lag(value, {i}) OVER w
  WHEN 'navigate' THEN value IS NOT DISTINCT FROM lag(value, {i}) OVER w WHEN 'wait' THEN TRUE ELSE FALSE END, FALSE) AS s{i}"""
    for i in (1, 2, 3)
)
_SAME_LOG = f"same AS (SELECT *, {_SAME} FROM log WINDOW w AS (PARTITION BY session_id ORDER BY seq))"
_LINES = """
lines AS (
  SELECT session_id, seq, CASE type WHEN 'click' THEN 'Clicked ' || element || CASE WHEN result = 'success' THEN ' successfully' ELSE '' END
    WHEN 'input' THEN 'Input ''' || value || ''' to ' || element WHEN 'navigate' THEN 'Navigated to: ' || value ELSE 'Did ' || type END AS line,
    CASE type WHEN 'click' THEN 'clicking ' || left(element, 1) WHEN 'input' THEN 'inputting text to ' || element WHEN 'navigate' THEN 'navigating' END AS pattern,
    type <> 'click' AS success
  FROM log)"""
# As intended, the whole target of a click counts, and whether it succeeded.
_INTENDED = _LINES.replace("left(element, 1)", "element").replace("type <> 'click' AS success", "type <> 'click' OR result = 'success' AS success")
_PATTERNS = """
patterns AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY count DESC, first_seen) AS rank FROM (
    SELECT session_id, pattern, count(*) AS count, arg_max(success, seq) AS success, min(seq) AS first_seen
    FROM lines WHERE pattern IS NOT NULL GROUP BY ALL))"""

ORACLES = {
    "parse_actions_json": f"""
SELECT {_ID}, {_action(type="'click'", element=f"'a[href=\"https://x.example/' || {_K} || '\"]'", description=f"'a. https://x.example/' || {_K}", selectorType="'css'", maxWait=f"CAST({_K} AS DOUBLE)")}
FROM events WHERE event_id % 5 = 0""",
    "parse_actions_embedded": f"""
SELECT {_ID}, {_action(type='event_type', element=f"'#e' || {_K}", selectorType="'css'", maxWait='5000.0::DOUBLE')} FROM events WHERE event_id % 5 = 1""",
    "parse_actions_key_value": f"""
SELECT {_ID}, {_action(type='event_type', element=f"'#box ' || {_K}", value=f"'v ' || {_K}", selectorType="'css'", maxWait='5000.0::DOUBLE')}
FROM events WHERE event_id % 5 = 2""",
    "parse_actions_help": f"""
SELECT {_ID}, {_action(type="'sendHumanMessage'", question=f"'I am Not Sure what to do about ' || event_type || ' ' || {_K}", selectorType="'css'", maxWait='1000.0::DOUBLE')}
FROM events WHERE event_id % 5 = 3""",
    "parse_actions_loose": f"""
SELECT {_ID}, event_type AS type, {_NULLS} AS direction, {_NULLS} AS element FROM events WHERE event_id % 5 IN (3, 4) AND event_type = 'click'""",
    "parse_conversations": "SELECT conv_id, turn FROM conversations",
    "parse_report": """
SELECT user_id AS session_id, ['json', 'embedded_json', 'key_value', 'help', 'none'][event_id % 5 + 1] AS method, count(*) AS messages
FROM events GROUP BY ALL""",
    "action_checks": """
SELECT problems = '' AS valid, problems, 'css' AS "selectorType", count(*) AS actions FROM (
  SELECT CASE WHEN event_id % 5 IN (1, 2) AND event_type <> 'click' THEN 'type: ' || event_type ELSE '' END AS problems FROM events WHERE event_id % 5 <> 4)
GROUP BY ALL""",
    "action_defaults": f"""
WITH {_LOG}
SELECT session_id, event_id AS seq, type,
       CASE WHEN type = 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'https://x.example/0' ELSE 'https://page.example/' || session_id END
            WHEN event_id % 2 = 0 THEN 'https://x.example/0' END AS "previousUrl",
       CASE WHEN event_id % 3 = 1 THEN 7.0::DOUBLE ELSE 5000.0::DOUBLE END AS "maxWait", 'css' AS "selectorType", {_NULLS} AS question
FROM log""",
    "selector_checks": f"""
WITH {_LOG}
SELECT substr(element, 3, 1) AS k, element <> '#e2' AS known, element <> '#e0' AS missing_element, count(*) AS actions
FROM log WHERE element IS NOT NULL GROUP BY ALL""",
    "numbered_log": f"WITH {_LOG} SELECT session_id, event_id, seq FROM log",
    "numbered_log_in_ranges": f"WITH {_LOG} SELECT session_id, event_id, seq FROM log",
    "redundant_actions": f"""
WITH {_LOG}, {_SAME_LOG} SELECT session_id, seq, type, CAST(s1 AS INT) + CAST(s2 AS INT) + CAST(s3 AS INT) >= 2 AS redundant FROM same""",
    "action_feedback": f"""
WITH {_LOG}, {_SAME_LOG}
SELECT session_id, seq, 'NOTICE: You''ve ' || CASE type
  WHEN 'click' THEN 'repeatedly tried to click "' || element || '" without success. Try a different element or action type.'
  WHEN 'input' THEN 'repeatedly tried to input "' || value || '" into "' || element || '". Try a different field or value.'
  WHEN 'navigate' THEN 'repeatedly tried to navigate to "' || value || '". Try a different URL or action type.'
  ELSE 'used multiple wait actions in succession. Try a more productive action now.' END AS feedback
FROM same WHERE s1 OR s2""",
    "repeated_patterns": f"WITH {_LOG}, {_INTENDED}, {_PATTERNS} SELECT session_id, pattern, count, success, rank FROM patterns WHERE count > 1",
    "repeated_patterns_intended": f"WITH {_LOG}, {_INTENDED}, {_PATTERNS} SELECT session_id, pattern, count, success FROM patterns WHERE count > 1",
    "compressed_history": f"""
WITH {_LOG}, {_LINES}, {_PATTERNS},
told AS (SELECT * FROM patterns WHERE count > 2),
sizes AS (SELECT session_id, count(*) AS n, coalesce(any_value(notes), 0) AS notes,
          greatest(least(3, 9 - 1 - coalesce(any_value(notes), 0)), 0) AS recent
          FROM lines LEFT JOIN (SELECT session_id, count(*) AS notes FROM told GROUP BY 1) USING (session_id) GROUP BY 1)
SELECT session_id, seq AS item, line FROM lines JOIN sizes USING (session_id) WHERE n <= 9 OR seq = 0
UNION ALL SELECT session_id, rank, 'Tried ' || pattern || ' ' || count || ' times ' || CASE WHEN success THEN 'successfully' ELSE 'without success' END
  FROM told JOIN sizes USING (session_id) WHERE n > 9
UNION ALL SELECT session_id, notes + 1 + seq - (n - recent), line FROM lines JOIN sizes USING (session_id) WHERE n > 9 AND seq >= n - recent""",
    "run_stats": f"""
WITH {_LOG}
SELECT session_id, count(*) AS total_actions, count(*) FILTER (WHERE result = 'success') AS successful_actions,
       printf('%.1f%%', count(*) FILTER (WHERE result = 'success') / count(*) * 100) AS success_rate,
       CAST(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS BIGINT) || 's' AS duration
FROM log GROUP BY 1""",
    "verified_actions": f"""
WITH {_LOG}
SELECT type, CASE type WHEN 'click' THEN TRUE WHEN 'input' THEN value = 'v' || event_id % 4
    WHEN 'navigate' THEN value = 'https://x.example/' || event_id % 4 WHEN 'wait' THEN TRUE ELSE FALSE END AS verified,
  CASE type WHEN 'click' THEN 'true' END AS url_changed, count(*) AS actions
FROM log GROUP BY ALL""",
    "verify_navigate": "SELECT page_id, page_id % 5 <> 2 OR regexp_matches(url, '[?#]') AS arrived FROM pages",
    "text_matches": """
SELECT d.doc_id, f.doc_id AS first_id, CAST(d.text IS NOT DISTINCT FROM f.text AS BIGINT) AS similarity
FROM documents d JOIN (SELECT n_chars, arg_min(text, doc_id) AS text, min(doc_id) AS doc_id FROM documents GROUP BY n_chars) f ON d.n_chars IS NOT DISTINCT FROM f.n_chars""",
}

QUERIES = {name: globals()[name] for name in ORACLES}
