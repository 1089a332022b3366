import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from webloom.functions.attrs import attr
from webloom.operators import actions, history, resolve
from webloom.plans.scale import number_rows, with_previous

MESSAGES = [
    ('"5"', "json", {}),
    ("[]", "json", {}),
    ("5", "json", {}),
    ("null", None, None),
    ("", None, None),
    ("   ", None, None),
    ('{"type":5}', "embedded_json", {"type": "5"}),
    ('{"type":"click","value":5}', "embedded_json", {"type": "click", "value": "5"}),
    ('{"type":"click","value":"a. http://x\'y","maxWait":0}', "json",
     {"type": "click", "element": "a[href=\"http://x\\'y\"]", "description": "a. http://x'y", "maxWait": 0.0}),
    ('{"type":"input","element":"","selector":"#s","value":"v","previousUrl":"u","selectorType":"text"}', "json",
     {"type": "input", "element": "#s", "value": "v", "previousUrl": "u", "selectorType": "text"}),
    ('{"type":"wait","type":"click","element":"#a","element":"#b"}', "json", {"type": "click", "element": "#b"}),
    ('go {"type":"wait","value":"a","value":"b"} now', "embedded_json", {"type": "wait", "value": "b"}),
    ('so {"type":"wait","maxWait":10} more {"type":"click"}', "embedded_json", {"type": "wait", "maxWait": 10.0}),
    ('x {"a":{"b":1}} y', None, None),
    ('{"a":', None, None),
    ('type: click, element="#a b" url=http://x.y/z', "key_value", {"type": "click", "element": "#a b"}),
    ("Action=go TYPE=input selector='q' type=\"wait\" maxWait=7", "key_value", {"type": "wait", "element": "q"}),
    ("action: click", "key_value", {"type": "click"}),
    ("I am Confused", "help", {"type": "sendHumanMessage", "question": "I am Confused", "maxWait": 1000.0}),
    ("not sure " + "x" * 200, "help", {"type": "sendHumanMessage", "question": "not sure " + "x" * 191 + "...", "maxWait": 1000.0}),
    ("please scroll up", None, None),
]


def test_parsing(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MESSAGES)], "id int, text string")
    for row in actions.parse_actions(df).orderBy("id").collect():
        text, method, fields = MESSAGES[row.id]
        assert row.method == method, text
        got = row.action and {k: v for k, v in row.action.asDict().items() if v is not None}
        want = fields if fields is None else {"selectorType": "css", "maxWait": 5000.0, **fields}
        assert got == want, text


def test_loose_patterns_as_intended(spark):
    texts = ["please scroll up", "Just CLICK element: #go, now", "ask: question: why me?", "clicking", "ask"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    rows = actions.parse_actions(df, mode="intended").orderBy("id").collect()
    got = [(r.method, r.action and (r.action.type, r.action.element, r.action.value, r.action.direction)) for r in rows]
    assert got == [
        ("loose", ("scroll", None, None, "up")),
        ("loose", ("click", "#go", None, None)),
        ("loose", ("sendHumanMessage", None, "why me?", None)),
        (None, None),
        ("loose", ("sendHumanMessage", None, "What should I do next?", None)),
    ]
    with pytest.raises(ValueError):
        actions.parse_actions(df, mode="other")


ACTION = "struct<type:string,element:string,value:string,description:string,question:string,previousUrl:string,selectorType:string,maxWait:double,operation:string,note:string,direction:string>"


def test_checks_and_defaults(spark):
    rows = [
        (1, ("click", "#a", None, None, None, None, None, None, None, None, None), "http://p/"),
        (2, ("jump", None, None, None, None, "http://o/", "magic", 0.0, "drop", None, "left"), "http://p/"),
        (3, ("sendHumanMessage", None, None, None, "", None, "xpath", 7.0, None, None, None), None),
    ]
    df = spark.createDataFrame(rows, f"id int, action {ACTION}, page_url string")
    checked = rows_of(actions.check_action(df).select("valid", "problems", "action.selectorType", "action.maxWait"), "id")
    assert checked == [
        (True, [], "css", 2000.0),
        (False, ["type: jump", "selectorType: magic", "operation: drop", "direction: left"], "magic", 0.0),
        (True, [], "xpath", 7.0),
    ]
    filled = rows_of(actions.action_defaults(df).select("action.maxWait", "action.selectorType", "action.previousUrl", "action.question"), "id")
    assert filled == [(5000.0, "css", "http://p/", None), (5000.0, "magic", "http://o/", None), (7.0, "xpath", None, "What should I do next?")]


def log_of(spark, *steps):
    rows = [(1, i, s, "success") for i, s in enumerate(steps)]
    schema = "session_id bigint, seq bigint, action struct<type:string,element:string,value:string>, result string"
    return spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds("seq"))


def test_redundancy_and_feedback(spark):
    click, wait, scroll, go = ("click", "a", None), ("wait", None, None), ("scroll", None, None), ("navigate", None, "u")
    log = log_of(spark, click, click, wait, click, wait, wait, scroll, scroll, scroll, go, go)
    assert [r.redundant for r in history.is_redundant(log).orderBy("seq").collect()] == [False] * 3 + [True, False, True] + [False] * 5
    told = [r.feedback[:40] for r in history.action_feedback(log).orderBy("seq").collect()]
    assert [bool(t) for t in told] == [False, True, False, True, True, True, False, False, False, False, True]
    assert history.action_feedback(log).where("seq = 10").first().feedback == (
        'NOTICE: You\'ve repeatedly tried to navigate to "u". Try a different URL or action type.'
    )


def test_a_session_cut_into_blocks_gives_the_same(spark):
    rows = spark.range(1000).select(F.lit(1).alias("session_id"), F.col("id").alias("seq"))
    got = with_previous(rows, ["session_id"], "seq", F.col("seq"), 3, block=7).orderBy("seq").collect()
    assert [r.previous for r in got] == [[p for p in (i - 1, i - 2, i - 3) if p >= 0] for i in range(1000)]


def test_numbering_splits_a_hot_key(spark):
    hot = spark.range(5000).select(F.lit("hot").alias("k"), (F.col("id") * 37 % 5003).alias("at"))
    cold = spark.range(3000).select((F.col("id") % 100).cast("string").alias("k"), (-F.col("id")).alias("at"))
    rows = hot.unionByName(cold)
    numbered = number_rows(rows, ["k"], "at", max_rows=200)
    from pyspark.sql import Window

    plain = rows.withColumn("seq", F.row_number().over(Window.partitionBy("k").orderBy("at")) - 1)
    assert sorted(rows_of(numbered.select("k", "at", "seq"))) == sorted(rows_of(plain.select("k", "at", "seq")))
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan


LINES = [
    "Navigated to: http://a", "Clicked #login successfully", "Clicked #login", "Clicked # successfully", "Input 'x' to q",
    "Input 'y' to q", "Clicked z", "Input 'y' to q", "Navigated to: b",
]


def test_history_patterns_and_compression(spark):
    rows = [(1, i, line) for i, line in enumerate(LINES)] + [(2, 0, "x"), (2, 1, "y")]
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, line string")
    ranked = history.ranked_patterns(history.repeated_patterns(df))
    assert rows_of(ranked.select("rank", "pattern", "count", "success"), "rank") == [
        (1, "clicking #", 3, True), (2, "inputting text to q", 3, True), (3, "navigating", 2, True),
    ]
    got = rows_of(history.compress_history(df).select("session_id", "item", "line"), "session_id", "item")
    assert got == [
        (1, 0, LINES[0]), (1, 1, "Tried clicking # 3 times successfully"), (1, 2, "Tried inputting text to q 3 times successfully"),
        (1, 3, LINES[7]), (1, 4, LINES[8]), (2, 0, "x"), (2, 1, "y"),
    ]
    intended = history.repeated_patterns(df, mode="intended")
    assert ("clicking #login", 2, False) in rows_of(intended.select("pattern", "count", "success"))
    assert [r[2] for r in rows_of(history.compress_history(df, max_items=1), "session_id", "item")][:3] == [
        LINES[0], "Tried clicking # 3 times successfully", "Tried inputting text to q 3 times successfully",
    ]


def test_outcomes(spark):
    pairs = [
        ("http://a.b/c?x", "http://a.b/c", True), ("http://a.b/c", "/c", True), ("http://a.b/c", "", True), ("http://a.b/c", None, True),
        ("bad", "bad", False), ("http://a.b/c", "http://a.b/d", False), ("http://a.b", "http://A.b/", True),
    ]
    df = spark.createDataFrame(pairs, "c string, t string, want boolean")
    assert all(r[0] == r[1] for r in df.select(history.verify_navigate("c", "t"), "want").collect())
    rows = [("click", "#a", None, None), ("click", None, None, None), ("input", "#a", "v", "v"), ("input", "#a", "v", None), ("notes", None, None, None), ("scroll", None, None, None)]
    df = spark.createDataFrame(
        [((t, e, v, "http://o/"), "http://n/", o) for t, e, v, o in rows],
        "action struct<type:string,element:string,value:string,previousUrl:string>, current_url string, observed_value string",
    )
    got = rows_of(history.verify_actions(df).select("verified", "url_changed"))
    assert got == [(True, True), (False, True), (True, None), (False, None), (True, None), (False, None)]
    stats = history.run_stats(log_of(spark, ("wait", None, None), ("wait", None, None))).first()
    assert (stats.total_actions, stats.success_rate, stats.duration) == (2, "100.0%", "1s")


SITE = """<body><nav><a href="/n?a=1&amp;b=2">Nav link</a></nav><form role=search><input id="search-input" name=q placeholder="Search me"></form>
<textarea id=t class="big box"></textarea><button class="x submit" id=go>Go now</button><button>Other</button>
<div role=button aria-label="Sign in">Sign In</div><a name=z>anchor</a></body>"""
TINY = '<a href="/only">Only one</a><input type=text id=i2><button>B</button>'


def test_resolution(spark, dom_of):
    cases = [
        (1, "click", "#go", None, "DirectSelector", "#go"),
        (1, "click", "button.x", None, "DirectSelector", "button.x"),
        (1, "click", "[class*=submit]", None, "DirectSelector", "[class*=submit]"),
        (1, "click", 'a[href="/n?a=1&b=2"]', None, "DirectSelector", 'a[href="/n?a=1&b=2"]'),
        (1, "input", "#my-input", None, "InputPattern", "textarea"),
        (1, "click", 'a[href="/nope"]', "nav LINK", "LinkStrategy", 'link[text="nav LINK"]'),
        (1, "click", 'a[href="(n?a=1)"]', None, "LinkStrategy", 'a[href*="(n?a=1)"]'),
        (2, "click", 'a[href="q"]', None, "LinkStrategy", "single-link-fallback"),
        (1, "click", "button.zz", "go", "RoleBased", 'role=button[name="go"]'),
        (1, "click", "button.zz", "o", None, None),
        (2, "input", "#zz", None, "SingleElement", "single-input-fallback"),
        (2, "click", "button#q", None, "SingleElement", "single-button-fallback"),
        (1, "notes", "#go", None, None, None),
        (1, "wait", None, None, None, None),
        (1, "click", "div:hover", None, None, None),
        (1, "click", "nav > a, form input", None, "DirectSelector", "nav > a, form input"),
    ]
    df = spark.createDataFrame(
        [(i, c[0], c[1:4]) for i, c in enumerate(cases)], "action_id int, page_id bigint, action struct<type:string,element:string,value:string>"
    )
    resolved = resolve.resolve_elements(df, dom_of(SITE, TINY)).orderBy("action_id").collect()
    assert [(r.strategy, r.selector) for r in resolved] == [c[4:] for c in cases]
    assert [r.action_id for r in resolved if r.unsupported_selector] == [14]
    assert [(t.strategy, t.hit) for t in resolved[4].trace] == [("DirectSelector", False), ("IdSelector", False), ("InputPattern", True)]


NAMES = """<body><div hidden><button>Send</button><textarea></textarea><a href="/h">Go</a></div><button id=b1>Send</button>
<p aria-hidden=true><a href="/h2">Go</a></p><a id=a1 href="/g">Go</a><span id=l1>Close</span><span id=l2> the window </span>
<button id=b2 aria-labelledby="l1 l2 none" aria-label="other">x</button><a id=a2 href="/c"><img alt="Shopping cart"> (2)</a>
<a id=a3 href="/d">before <img alt="the picture"> after</a><input type=image id=i1 alt="Find"><input name=q id=q1></body>"""
TWO = '<div style="display:none"><textarea></textarea></div><input name=q id=q2><input id=input-x hidden><button>A</button><button hidden>A</button>'


def test_names_and_visibility_in_the_cascade(spark, dom_of):
    cases = [
        (1, "click", "button.none", "send", "RoleBased", "b1"),
        (1, "click", 'a[href="/none"]', "go", "LinkStrategy", "a1"),
        (1, "click", "button.none", "close the WINDOW", "RoleBased", "b2"),
        (1, "click", "button.none", "other", None, None),
        (1, "click", 'a[href="/none"]', "shopping cart (2)", "LinkStrategy", "a2"),
        (1, "click", 'a[href="/none"]', "before the picture after", "LinkStrategy", "a3"),
        (1, "click", "button.none", "find", "RoleBased", "i1"),
        # The first text area is hidden, so the pattern is passed over for the next one.
        (1, "input", "input.none", None, "InputPattern", "q1"),
        (2, "input", "input.none", None, "InputPattern", "q2"),
        (2, "click", "button.none", "a", "RoleBased", None),
    ]
    dom = dom_of(NAMES, TWO)
    df = spark.createDataFrame([(i, c[0], c[1:4]) for i, c in enumerate(cases)], "action_id int, page_id bigint, action struct<type:string,element:string,value:string>")
    ids = dom.nodes.select("page_id", "pos", attr("id").alias("id"))
    found = resolve.resolve_elements(df, dom).join(ids, ["page_id", "pos"], "left").orderBy("action_id").collect()
    assert [(r.strategy, r.id) for r in found] == [c[4:] for c in cases]


def test_help_for_missing_elements(spark, dom_of):
    dom = dom_of(SITE, TINY)
    wanted = spark.createDataFrame([(1, "#go"), (1, "input.foo"), (1, "button.q"), (1, ".bi"), (2, "a")], "page_id bigint, selector string")
    assert sorted(rows_of(resolve.element_exists(wanted, dom)), key=str) == sorted([
        (1, "#go", True, 1, None), (1, "input.foo", False, 0, "Try instead: textarea, input[name=q]"),
        (1, "button.q", False, 0, "Try instead: [role=button]"), (1, ".bi", False, 0, None), (2, "a", True, 1, None),
    ], key=str)
    near = resolve.close_matches(wanted.where("selector in ('.bi', '#go')"), dom)
    assert sorted(rows_of(near.select("selector", "tag_name", "id"))) == [("#go", "BUTTON", "go"), (".bi", "TEXTAREA", "t")]
    references = spark.createDataFrame([(1, r) for r in ("#go", "input[type=text]", "search", "q", "other", "nothing here")], "page_id bigint, reference string")
    assert dict(rows_of(resolve.best_match(references, dom).select("reference", "match"))) == {
        "#go": "#go", "input[type=text]": "textarea", "search": "#search-input", "q": "#search-input", "other": "html", "nothing here": None,
    }
    texts = spark.createDataFrame([(1, "sign in"), (1, "other")], "page_id bigint, text string")
    tags = dom.nodes.select("page_id", "pos", "tag")
    said = lambda mode: dict(rows_of(resolve.find_by_text(texts, dom, mode).join(tags, ["page_id", "pos"]).select("text", "tag")))
    assert said("intended") == {"sign in": "div", "other": "button"}
    assert said("reference") == {"sign in": "a", "other": "a"}


def test_selectors_against_a_list(spark):
    df = spark.createDataFrame([("#a",), ("a",), ("#z",), ("",), (None,)], "s string")
    known = F.array(F.lit("#a"), F.lit("form b"))
    assert [r[0] for r in df.select(actions.verify_selector(F.col("s"), known)).collect()] == [True, True, False, False, False]
