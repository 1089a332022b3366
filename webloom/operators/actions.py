"""Agent messages to actions: parsing, defaults and checks. All of it is column work on the message table."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.actions import (
    ACTION_TYPES,
    CHECKED_WAIT,
    DEFAULT_QUESTION,
    DIRECTIONS,
    FIELDS,
    HELP_PHRASES,
    HELP_WAIT,
    LOOSE_WORDS,
    OPERATIONS,
    PARSED_WAIT,
    SELECTOR_TYPES,
)
from webloom.functions.text import JS_SPACE_CLASS, let, non_empty, trim_js
from webloom.functions.url import escape_css

_S = JS_SPACE_CLASS


# While a message is parsed, an action is an array with its 11 fields as text: one small expression per way, where a
# struct would be taken apart and repeated field by field.


def _action(**fields: Column) -> Column:
    return F.array(*[fields.get(f, F.lit(None)).cast("string") for f in FIELDS])


def _wait(milliseconds: int) -> Column:
    return F.lit(str(float(milliseconds)))


def _normal(get, **changed: Column) -> Column:
    """The parsed object with its defaults; `get(name)` gives a field as text."""
    fields = {f: get(f) for f in FIELDS}
    fields["element"] = F.coalesce(non_empty(get("element")), get("selector"))
    fields["selectorType"] = F.coalesce(non_empty(get("selectorType")), F.lit("css"))
    fields["maxWait"] = F.coalesce(get("maxWait").try_cast("double").cast("string"), _wait(PARSED_WAIT))
    return _action(**{**fields, **changed})


def _untyped() -> Column:
    return _action(selectorType=F.lit("css"), maxWait=_wait(PARSED_WAIT))


def _variant_field(value: Column):
    return lambda name: F.try_variant_get(value, f"$.{name}", "string")


def _kind(value: Column, name: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(value, f"$.{name}", "variant")), F.lit("VOID"))


def _whole_json(text: Column) -> Column:
    """The message is JSON. Objects whose `type` is not text do not count, nor do clicks on nothing with an odd value;
    what is not an object gives an action with no type."""

    def parse(v: Column) -> Column:
        get = _variant_field(v)
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        bare_click = (F.lower(get("type")) == "click") & (F.coalesce(get("element"), F.lit("")) == "")
        odd_value = bare_click & ~_kind(v, "value").isin("STRING", "VOID") & ~get("value").isin("0", "false")
        bad = ~_kind(v, "type").isin("STRING", "VOID") | F.coalesce(odd_value, F.lit(False))
        href = escape_css(trim_js(F.substring(get("value"), F.lit(3), F.length(get("value")))))
        as_link = _normal(
            get,
            element=F.concat(F.lit('a[href="'), href, F.lit('"]')),
            description=get("value"),
            value=F.lit(None),
        )
        return (
            F.when(v.isNull() | F.is_variant_null(v), None)
            .when(~is_object, _untyped())
            .when(bad, None)
            .when(F.coalesce(bare_click & F.startswith(get("value"), F.lit("a.")), F.lit(False)), as_link)
            .otherwise(_normal(get))
        )

    return let(F.try_parse_json(text), parse)


def _embedded_json(text: Column) -> Column:
    """The first {...} in the message that is JSON by itself; braces do not nest."""
    candidates = F.regexp_extract_all(text, F.lit(r"\{[\s\S]*?\}"), F.lit(0))
    parsed = F.filter(F.transform(candidates, F.try_parse_json), lambda v: v.isNotNull())
    return let(F.get(parsed, F.lit(0)), lambda v: F.when(v.isNotNull(), _normal(_variant_field(v))))


_PAIR = rf"""(?<![A-Za-z0-9_])([A-Za-z0-9_]++){_S}*[:=]{_S}*(?:"([^"]+)"|'([^']+)'|([^,"}}{_S[1:-1]}]+))"""


def _key_values(text: Column) -> Column:
    """key: value pairs, latest first; of a repeated key the last one counts."""
    group = lambda i: F.regexp_extract_all(text, F.lit(_PAIR), F.lit(i))
    values = F.transform(F.arrays_zip(group(2).alias("a"), group(3).alias("b"), group(4).alias("c")),
                         lambda v: trim_js(F.concat(v["a"], v["b"], v["c"])))
    return F.struct(
        F.reverse(F.transform(group(1), F.lower)).alias("keys"), F.reverse(values).alias("values")
    )


def _from_pairs(text: Column) -> Column:
    """An action from pairs that name a type, or an action where no type is given. Keys are lower case here, so
    the camel-case fields are never found."""

    def action(pairs: Column) -> Column:
        def last(name: str) -> Column:
            return F.get(pairs["values"], F.nullif(F.array_position(pairs["keys"], name), F.lit(0)).cast("int") - 1)

        def get(name: str) -> Column:
            if name != name.lower():
                return F.lit(None).cast("string")
            return F.coalesce(last("type"), last("action")) if name == "type" else last(name)

        return F.when(F.arrays_overlap(pairs["keys"], F.array(F.lit("type"), F.lit("action"))), _normal(get))

    return let(_key_values(text), action)


def _loose(text: Column, mode: str) -> Column:
    """An action word somewhere in the text. The original builds its pattern from a string in which \\b is a backspace
    and \\s the letter s, so it hardly ever matches; `reference` keeps that, `intended` means what it says."""
    edge, space = (r"\b", _S[1:-1]) if mode == "intended" else (r"\x08", "s")
    word = None
    for w in LOOSE_WORDS:
        hit = text.rlike(rf"""(?i)(?:{edge}|action|type)[{space}:"']*{w}{edge}""")
        kind = "sendHumanMessage" if w in ("sendhumanmessage", "ask_human", "ask") else w
        word = F.when(hit, F.lit(kind)) if word is None else word.when(hit, F.lit(kind))
    lower = F.lower(text)

    def after(name: str) -> Column:
        pattern = rf"""(?i){name}[:{_S[1:-1]}]+["']?([^"'\n,}}]+)["']?"""
        return F.when(text.rlike(pattern), trim_js(F.regexp_extract(text, pattern, 1)))

    down = F.contains(lower, F.lit("scroll down")) | F.contains(lower, F.lit("direction down"))
    up = F.contains(lower, F.lit("scroll up")) | F.contains(lower, F.lit("direction up"))

    def action(kind: Column) -> Column:
        asks = kind == "sendHumanMessage"
        return _action(
            type=kind,
            element=non_empty(F.coalesce(after("element"), after("selector"))),
            value=F.when(asks, F.coalesce(after("question"), F.lit(DEFAULT_QUESTION))),
            direction=F.when(kind == "scroll", F.when(~down & up, F.lit("up")).otherwise(F.lit("down"))),
            selectorType=F.lit("css"),
            maxWait=_wait(PARSED_WAIT),
        )

    return let(word, lambda kind: F.when(kind.isNotNull(), action(kind)))


def _help(text: Column) -> Column:
    lower = F.lower(text)
    asks = reduce(or_, [F.contains(lower, F.lit(p)) for p in HELP_PHRASES])
    question = F.when(F.length(text) > 200, F.concat(F.left(text, F.lit(200)), F.lit("..."))).otherwise(text)
    return F.when(
        asks,
        _action(
            type=F.lit("sendHumanMessage"), question=question, selectorType=F.lit("css"), maxWait=_wait(HELP_WAIT)
        ),
    )


def parse_actions(messages: DataFrame, text: str = "text", mode: str = "reference") -> DataFrame:
    """Add `action` (struct, null if nothing was understood) and `method` (which of the five ways found it).

    Each way only looks at messages the ways before it left over; there is no shuffle. Of a key that a JSON object
    repeats the last value counts; that is a setting of the session, which is switched on here.
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if mode not in ("reference", "intended"):
        raise ValueError(f"unknown mode: {mode}")
    ways = [
        ("json", _whole_json),
        ("embedded_json", _embedded_json),
        ("key_value", _from_pairs),
        ("loose", lambda t: _loose(t, mode)),
        ("help", _help),
    ]

    def first_of(message: Column, rest) -> Column:
        (name, way), *others = rest
        nothing = F.lit(None) if not others else first_of(message, others)
        return let(
            way(message),
            lambda fields: F.when(
                fields.isNotNull(), F.struct(F.lit(name).alias("method"), fields.alias("fields"))
            ).otherwise(nothing),
        )

    parsed = let(F.col(text), lambda message: F.when(trim_js(message) != "", first_of(message, ways)))
    fields = [F.get("_parsed.fields", F.lit(i)).alias(f) for i, f in enumerate(FIELDS)]
    fields = [f.cast("double").alias("maxWait") if n == "maxWait" else f for f, n in zip(fields, FIELDS, strict=True)]
    return messages.select("*", parsed.alias("_parsed")).select(
        *messages.columns,
        F.when(F.col("_parsed").isNotNull(), F.struct(*fields)).alias("action"),
        F.col("_parsed.method").alias("method"),
    )


def unparsed(parsed: DataFrame) -> DataFrame:
    """Messages in which no action was found."""
    return parsed.where("action is null")


def parse_report(parsed: DataFrame) -> DataFrame:
    """Messages per session and method; unparsed ones count as `none`."""
    return parsed.groupBy("session_id", F.coalesce("method", F.lit("none")).alias("method")).agg(
        F.count("*").alias("messages")
    )


def check_action(rows: DataFrame, action: str = "action") -> DataFrame:
    """Add `valid` and `problems`, and fill selectorType and maxWait with the checker's own defaults."""
    a = F.col(action)
    enums = {"type": ACTION_TYPES, "selectorType": SELECTOR_TYPES, "operation": OPERATIONS, "direction": DIRECTIONS}
    problems = []
    for name, known in enums.items():
        wrong = ~a[name].isin(known)
        if name == "type":
            wrong = a[name].isNull() | wrong
        problems.append(F.when(wrong, F.concat(F.lit(f"{name}: "), F.coalesce(a[name], F.lit("missing")))))
    filled = a.withField("selectorType", F.coalesce(a["selectorType"], F.lit("css"))).withField(
        "maxWait", F.coalesce(a["maxWait"], F.lit(float(CHECKED_WAIT)))
    )
    checked = rows.withColumn("problems", F.array_compact(F.array(*problems)))
    return checked.withColumn(action, filled).withColumn("valid", F.size("problems") == 0)


def action_defaults(rows: DataFrame, action: str = "action", page_url: str = "page_url") -> DataFrame:
    """Fill maxWait (also 0), selectorType, a click's previousUrl from the page, and a message's question."""
    a = F.col(action)
    previous = F.coalesce(non_empty(a["previousUrl"]), non_empty(F.col(page_url)))
    filled = (
        a.withField("maxWait", F.coalesce(F.nullif(a["maxWait"], F.lit(0.0)), F.lit(float(PARSED_WAIT))))
        .withField("selectorType", F.coalesce(non_empty(a["selectorType"]), F.lit("css")))
        .withField("previousUrl", F.when(a["type"] == "click", previous).otherwise(a["previousUrl"]))
        .withField(
            "question",
            F.when(a["type"] == "sendHumanMessage", F.coalesce(non_empty(a["question"]), F.lit(DEFAULT_QUESTION))).otherwise(
                a["question"]
            ),
        )
    )
    return rows.withColumn(action, filled)


def verify_selector(selector: Column, interactive: Column) -> Column:
    """Is the selector listed, or part of a listed one? Empty selectors are not."""
    part = F.exists(interactive, lambda s: F.contains(s, selector))
    return F.coalesce((selector != "") & (F.array_contains(interactive, selector) | part), F.lit(False))


def missing_from_state(rows: DataFrame, action: str = "action", interactive: str = "interactive") -> DataFrame:
    """Add `missing_element`: a click or input whose element is not among the page's interactive elements."""
    a = F.col(action)
    asks = a["type"].isin("click", "input") & (F.coalesce(a["element"], F.lit("")) != "") & F.col(interactive).isNotNull()
    return rows.withColumn(
        "missing_element", F.coalesce(asks & ~F.array_contains(interactive, a["element"]), F.lit(False))
    )


def all_of(tests: list[Column]) -> Column:
    return reduce(and_, tests)
