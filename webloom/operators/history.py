"""Action history: repetition, feedback, compressed history, outcomes and run statistics.

`log(session_id, seq, ts, action, result)` and `history(session_id, seq, line)` number a session's rows 0, 1, 2, ...;
`plans.scale.number_rows` gives such numbers to logs that lack them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import as_column
from webloom.functions.url import hostname, pathname, valid_url
from webloom.plans.scale import cut, number_rows, with_previous

# Fixed values.
MAX_REPEATED_ACTIONS = 3
MAX_HISTORY_ITEMS = 5
RECENT_ITEMS = 3
SIMILARITY_THRESHOLD = 0.7


def _same_action(past: Column, now: Column) -> Column:
    """Same type and same target; only four types can repeat."""
    target = (
        F.when(now["type"] == "click", past["element"].eqNullSafe(now["element"]))
        .when(
            now["type"] == "input",
            past["element"].eqNullSafe(now["element"]) & past["value"].eqNullSafe(now["value"]),
        )
        .when(now["type"] == "navigate", past["value"].eqNullSafe(now["value"]))
        .otherwise(now["type"] == "wait")
    )
    return F.coalesce((past["type"] == now["type"]) & target, F.lit(False))


def _with_recent(log: DataFrame, back: int) -> DataFrame:
    payload = F.struct("action.type", "action.element", "action.value")
    return with_previous(log, ["session_id"], "seq", payload, back, "_past")


def is_redundant(log: DataFrame) -> DataFrame:
    """Add `redundant`: at least two of the three actions before were the same."""
    recent = _with_recent(log, MAX_REPEATED_ACTIONS)
    same = F.size(F.filter("_past", lambda p: _same_action(p, F.col("action"))))
    return recent.withColumn("redundant", same >= MAX_REPEATED_ACTIONS - 1).drop("_past")


def action_feedback(log: DataFrame) -> DataFrame:
    """Add `feedback`: a notice when the action repeats one of the two before it, else ''.

    The action itself counts among the last three, so a single repeat is enough.
    """
    recent = _with_recent(log, MAX_REPEATED_ACTIONS - 1)
    repeats = F.exists("_past", lambda p: _same_action(p, F.col("action")))
    a = F.col("action")
    element, value = F.coalesce(a["element"], F.lit("undefined")), F.coalesce(a["value"], F.lit("undefined"))
    message = (
        F.when(
            a["type"] == "click",
            F.format_string(
                'NOTICE: You\'ve repeatedly tried to click "%s" without success. Try a different element or action type.',
                element,
            ),
        )
        .when(
            a["type"] == "input",
            F.format_string(
                'NOTICE: You\'ve repeatedly tried to input "%s" into "%s". Try a different field or value.', value, element
            ),
        )
        .when(
            a["type"] == "navigate",
            F.format_string(
                'NOTICE: You\'ve repeatedly tried to navigate to "%s". Try a different URL or action type.', value
            ),
        )
        .otherwise(F.lit("NOTICE: You've used multiple wait actions in succession. Try a more productive action now."))
    )
    return recent.withColumn("feedback", F.when(repeats, message).otherwise(F.lit(""))).drop("_past")


def _patterns(line: Column, mode: str) -> Column:
    """The patterns one history line shows. `reference` keeps the click pattern as written: its lazy group stops after
    one character."""
    end = "$" if mode == "intended" else ""
    click, entry, go = rf"Clicked (.+?)( successfully)?{end}", r"Input '(.+?)' to (.+)", r"Navigated to: (.+)"
    pattern = lambda key, success, place: F.struct(
        key.alias("pattern"), success.alias("success"), F.lit(place).alias("place")
    )
    return F.array_compact(
        F.array(
            F.when(
                line.rlike(click),
                pattern(
                    F.concat(F.lit("clicking "), F.regexp_extract(line, click, 1)),
                    F.regexp_extract(line, click, 2) != "",
                    0,
                ),
            ),
            F.when(
                line.rlike(entry),
                pattern(F.concat(F.lit("inputting text to "), F.regexp_extract(line, entry, 2)), F.lit(True), 1),
            ),
            F.when(line.rlike(go), pattern(F.lit("navigating"), F.lit(True), 2)),
        )
    )


def repeated_patterns(history: DataFrame, mode: str = "reference", more_than: int = 1) -> DataFrame:
    """session_id, pattern, count, success, first_seen for patterns a session shows more than once.

    In order: by count, then by first_seen.
    """
    seen = history.select("session_id", "seq", F.explode(_patterns(F.col("line"), mode)).alias("p"))
    return (
        seen.groupBy("session_id", F.col("p.pattern").alias("pattern"))
        .agg(
            F.count("*").alias("count"),
            F.max_by("p.success", "seq").alias("success"),
            F.min(F.col("seq") * 4 + F.col("p.place")).alias("first_seen"),
        )
        .where(F.col("count") > more_than)
    )


def ranked_patterns(patterns: DataFrame) -> DataFrame:
    """Add `rank` (from 1) within the session: by count, ties by first_seen.

    A session has few different counts, so ranking goes by (session, count) with the sizes of the larger counts added.
    """
    sizes = patterns.groupBy("session_id", "count").agg(F.count("*").alias("_size"))
    larger = Window.partitionBy("session_id").orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("session_id", "count", F.coalesce(F.sum("_size").over(larger), F.lit(0)).alias("_before"))
    numbered = number_rows(patterns, ["session_id", "count"], "first_seen", "_n")
    return (
        numbered.join(offsets, ["session_id", "count"])
        .withColumn("rank", F.col("_n") + F.col("_before") + 1)
        .drop("_n", "_before")
    )


def compress_history(history: DataFrame, max_items: int = MAX_HISTORY_ITEMS, mode: str = "reference") -> DataFrame:
    """session_id, item, line: short histories as they are; longer ones as first line, repeated patterns, last lines.

    Lines are fetched by (session, position), so a long session is not gathered anywhere.
    """
    # Needed three times below and small next to the history: written down once.
    patterns = cut(ranked_patterns(cut(repeated_patterns(history, mode, more_than=2))))
    notes = patterns.groupBy("session_id").agg(F.count("*").alias("notes"))
    sizes = history.groupBy("session_id").agg(F.count("*").alias("n")).join(notes, "session_id", "left")
    sizes = sizes.select("session_id", "n", F.coalesce("notes", F.lit(0)).alias("notes"))
    recent = F.greatest(F.least(F.lit(RECENT_ITEMS), F.lit(max_items - 1) - F.col("notes")), F.lit(0))
    long = F.col("n") > max_items
    places = F.when(
        long,
        F.concat(
            F.array(F.struct(F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("item"))),
            F.transform(
                F.filter(F.sequence(F.lit(1), F.lit(RECENT_ITEMS)), lambda i: i <= F.col("recent")),
                lambda i: F.struct(
                    (F.col("n") - F.col("recent") + i - 1).cast("bigint").alias("seq"),
                    (F.col("notes") + i).cast("bigint").alias("item"),
                ),
            ),
        ),
    ).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.least("n", F.lit(max_items)) - 1), lambda i: F.struct(i.alias("seq"), i.alias("item")))
    )
    wanted = (
        sizes.select("*", recent.alias("recent"))
        .select("session_id", F.explode(places).alias("p"))
        .select("session_id", "p.seq", "p.item")
    )
    lines = history.select("session_id", F.col("seq").cast("bigint").alias("seq"), "line")
    kept = wanted.join(lines, ["session_id", "seq"]).select("session_id", "item", "line")
    outcome = F.when(F.col("success"), F.lit("successfully")).otherwise(F.lit("without success"))
    told = (
        patterns.join(sizes.where(long).select("session_id"), "session_id", "left_semi")
        .select(
            "session_id",
            F.col("rank").cast("bigint").alias("item"),
            F.concat(F.lit("Tried "), "pattern", F.lit(" "), F.col("count").cast("string"), F.lit(" times "), outcome).alias("line"),
        )
    )
    return kept.unionByName(told)


def verify_navigate(current, target) -> Column:
    """Did navigation arrive? Same host and path, or the current URL contains the target."""
    current, target = as_column(current), F.coalesce(as_column(target), F.lit(""))
    holds = F.contains(current, target)
    same_place = (hostname(current) == hostname(target)) & ((pathname(current) == pathname(target)) | holds)
    return F.coalesce(valid_url(current) & F.when(valid_url(target), same_place).otherwise(holds), F.lit(False))


def verify_input(element, value, observed) -> Column:
    given = F.coalesce(as_column(element), F.lit("")) != ""
    return given & as_column(observed).isNotNull() & as_column(observed).eqNullSafe(as_column(value))


def verify_click(element) -> Column:
    """Counts as done whenever an element was given."""
    return F.coalesce(as_column(element), F.lit("")) != ""


def verify_actions(log: DataFrame, current_url: str = "current_url", observed: str = "observed_value") -> DataFrame:
    """Add `verified` and, for clicks, `url_changed`."""
    a = F.col("action")
    verdict = (
        F.when(a["type"] == "click", verify_click(a["element"]))
        .when(a["type"] == "input", verify_input(a["element"], a["value"], F.col(observed)))
        .when(a["type"] == "navigate", verify_navigate(F.col(current_url), a["value"]))
        .otherwise(F.coalesce(a["type"].isin("wait", "notes", "sendHumanMessage"), F.lit(False)))
    )
    changed = F.when(a["type"] == "click", ~F.col(current_url).eqNullSafe(a["previousUrl"]))
    return log.select("*", verdict.alias("verified"), changed.alias("url_changed"))


def run_stats(log: DataFrame) -> DataFrame:
    """Per session: total and successful actions, success rate, and duration in whole seconds."""
    total, good = F.count("*"), F.count(F.when(F.col("result") == "success", 1))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = F.max(at) - F.min(at)
    return log.groupBy("session_id").agg(
        total.alias("total_actions"),
        good.alias("successful_actions"),
        F.when(total > 0, F.format_string("%.1f%%", good / total * 100)).otherwise(F.lit("0%")).alias("success_rate"),
        F.concat(F.round(span / 1e6).cast("bigint").cast("string"), F.lit("s")).alias("duration"),
    )


def text_similarity(a, b) -> Column:
    """1 for equal texts, else 0."""
    return as_column(a).eqNullSafe(as_column(b)).cast("int")
