"""Selectors in data against a plain evaluator that walks the tree."""

import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from webloom.catalog import resolution
from webloom.functions.attrs import attr_map
from webloom.operators import resolve
from webloom.operators.select import matches, select_nodes, supported_selector
from webloom.plans.nodes import with_family

PIECE = re.compile(r"""(\s*[>+~]\s*|\s+)|([a-zA-Z][\w-]*|\*)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([\^$*~|]?=)"([^"]*)"( i)?)?\]|:not\(([^()]*)\)|:has-text\("([^"]*)"\)""")


def compound_holds(node, parts):
    for _, tag, ident, cls, name, op, value, ci, inner, said in parts:
        attrs = node["attrs"]
        if tag and tag not in ("*", node["tag"]) or ident and attrs.get("id") != ident or cls and cls not in attrs.get("class", "").split():
            return False
        if name:
            have = attrs.get(name)
            if have is None:
                return False
            if ci:
                have, value = have.lower(), value.lower()
            fits = {"": True, "=": have == value, "^=": value and have.startswith(value), "$=": value and have.endswith(value), "*=": value and value in have, "~=": value in have.split(), "|=": have == value or have.startswith(value + "-")}[op]
            if not fits:
                return False
        if inner and any(compound_holds(node, PIECE.findall(alt.strip())) for alt in inner.split(",")):
            return False
        if said and said.lower() not in " ".join(node["text"].split()).lower():
            return False
    return True


def selected(nodes, selector):
    """Positions by trying every way up the tree."""
    hits = set()
    for alternative in re.split(r",(?![^()]*\))", selector):
        steps, links = [[]], [""]
        for piece in PIECE.findall(alternative.strip()):
            if piece[0]:
                steps.append([])
                links.append(piece[0].strip() or " ")
            else:
                steps[-1].append(piece)

        def holds(node, at):
            if not compound_holds(node, steps[at]):
                return False
            if at == 0:
                return True
            family = [n for n in nodes.values() if n["parent"] == node["parent"] and n["pos"] < node["pos"]]
            up = []
            while (node := nodes.get(node["parent"])) is not None:
                up.append(node)
            return any(holds(n, at - 1) for n in {" ": up, ">": up[:1], "~": family, "+": sorted(family, key=lambda n: n["pos"])[-1:]}[links[at]])

        hits |= {n["pos"] for n in nodes.values() if holds(n, len(steps) - 1)}
    return hits


def tree(rng, depth=0):
    html = ""
    for _ in range(rng.randint(2 if depth == 0 else 1, 4 if depth < 4 else 1)):
        tag = rng.choice(["div", "p", "span", "b", "input", "section"])
        attrs = ""
        if rng.random() < 0.5:
            attrs += f' class="{" ".join(rng.sample(["x", "y", "z-1"], rng.randint(1, 2)))}"'
        if rng.random() < 0.3:
            attrs += f' id="i{rng.randint(0, 5)}"'
        if rng.random() < 0.3:
            attrs += f' lang="{rng.choice(["en", "en-US", "de"])}"'
        inside = "" if tag == "input" else rng.choice(["One", " two  words ", ""]) + (tree(rng, depth + 1) if depth < 4 and tag != "p" and rng.random() < 0.7 else "")
        html += f"<{tag}{attrs}>" + ("" if tag == "input" else f"{inside}</{tag}>")
    return html


SELECTORS = [
    "div p", "div > p", "div>p", "section > div > span", "div div p", "p, span", "div + p", "span ~ b", "*", "div *", ".x.y", "div.x > .y", "#i1", "#i1 span", "p#i2, div > b.x",
    ":not(.x)", "div:not(.x):not(.y)", "span:not(.x, #i1)", 'div:has-text("two words")', 'section:has-text("TWO") > span', '[lang|="en"]', '[lang="EN" i]', '[class*="z"] > *', '[class^="x"] ~ [id]',
    "section div > span + b", "div > div > div > div", "input", "div input:not([class])", "b > *, span > input", "h1", "div  >  p , span",
]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_walking_the_tree(spark, dom_of, seed):
    rng = random.Random(seed)
    dom = dom_of(*[f"<body>{tree(rng)}</body>" for _ in range(6)], "", "<p>unclosed <b>bold<i>both</b></i><p>next")
    rows = with_family(dom.nodes).select("page_id", "pos", "end", "tag", "parent", attr_map().alias("attrs")).collect()
    texts = {r.page_id: r.texts for r in dom.docs.select("page_id", "texts").collect()}
    wanted = spark.createDataFrame([(p, s) for p in range(1, 9) for s in SELECTORS], "page_id bigint, selector string")
    found = {}
    for r in matches(wanted, dom).collect():
        found.setdefault((r.page_id, r.selector), set()).add(r.pos)
    total = 0
    for page in range(1, 9):
        nodes = {r.pos: {"pos": r.pos, "tag": r.tag, "attrs": dict(r.attrs), "parent": r.parent, "text": "".join(texts[page][r.pos : r.end])} for r in rows if r.page_id == page}
        for selector in SELECTORS:
            want = selected(nodes, selector)
            assert found.get((page, selector), set()) == want, (page, selector)
            total += len(want)
    assert total > 150


def test_parents_and_siblings(dom_of):
    dom = dom_of("<div><p>a<p>b</div><ul><li>x<li>y<b>z</b></ul>")
    rows = {(r.tag, r.pos): (r.parent, r.previous) for r in with_family(dom.nodes).collect()}
    places = {tag: [p for t, p in sorted(rows, key=lambda k: k[1]) if t == tag] for tag in ("div", "p", "ul", "li", "b")}
    div, ul, (p1, p2), (l1, l2), b = places["div"][0], places["ul"][0], places["p"], places["li"], places["b"][0]
    assert rows["p", p1] == (div, None) and rows["p", p2] == (div, p1)
    assert rows["ul", ul] == (None, div) and rows["li", l2] == (ul, l1) and rows["b", b] == (l2, None)


def test_what_is_supported(spark):
    fine = [*SELECTORS, r"#a\:b", ".é", "a[href='x,y > z']", ":has-text(plain)", "div:not( .a , [b] )"]
    not_fine = ["", " ", "div >", "> p", "a,,b", "a,", "p:hover", "text=Go", "div:not()", "a[", "#", "//div", ":not(a b)", "#1 a:nth-child(2)"]
    rows = spark.createDataFrame([(s,) for s in fine + not_fine], "s string").select("s", supported_selector("s").alias("ok")).collect()
    assert {r.s for r in rows if r.ok} == set(fine)


def test_escapes_quotes_and_odd_requests(spark, dom_of):
    dom = dom_of('<a id="a:b" href="x,y > z">One</a><input class="é" value=\'q"q\'>')
    asked = [r"#a\:b", "a[href='x,y > z']", ".é", 'input[value="q\\"q"]', ":has-text( one )", None, "", "p:hover", "#a:b"]
    wanted = spark.createDataFrame([(1, s) for s in asked] + [(9, "a"), (1, ".é")], "page_id bigint, selector string")
    found = {(r.page_id, r.selector): (r.match_count, r.supported) for r in select_nodes(wanted, dom).collect()}
    assert found == {
        (1, r"#a\:b"): (1, True), (1, "a[href='x,y > z']"): (1, True), (1, ".é"): (1, True), (1, 'input[value="q\\"q"]'): (1, True), (1, ":has-text( one )"): (1, True),
        (1, ""): (0, False), (1, "p:hover"): (0, False), (1, "#a:b"): (0, False), (9, "a"): (0, True),
    }
    assert select_nodes(wanted.limit(0), dom).count() == 0


def test_hot_page_gives_the_same(spark, dom_of):
    rng = random.Random(3)
    dom = dom_of(f"<body>{tree(rng)}</body>")
    wanted = spark.createDataFrame([(1, s) for s in SELECTORS], "page_id bigint, selector string")
    hot = spark.createDataFrame([(1, 3)], "page_id bigint, _parts int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(matches(wanted, dom, hot)) == rows(matches(wanted, dom))


FORM = '<form id=f><div><input name=q hidden><input name=q2></div><p>x <a class=go href="/g">Go on</a></p><button>Send</button></form><p><a href="/h">Home</a></p>'


def test_selectors_in_all_outputs(spark, dom_of):
    dom = dom_of(FORM)
    asked = ["form input", "div > p", "form > p", "a, button", 'a:has-text("go")', "input:not([hidden])", "form p + button"]
    wanted = spark.createDataFrame([(1, s) for s in asked], "page_id bigint, selector string")
    counts = {"form input": 2, "div > p": 0, "form > p": 1, "a, button": 3, 'a:has-text("go")': 1, "input:not([hidden])": 1, "form p + button": 1}
    info = {r.selector: (r.found, r["count"], r.tag_name) for r in resolve.element_info(wanted, dom).collect()}
    tags = {"form input": "INPUT", "form > p": "P", "a, button": "A", 'a:has-text("go")': "A", "input:not([hidden])": "INPUT", "form p + button": "BUTTON", "div > p": None}
    assert info == {s: (n > 0, n, tags[s]) for s, n in counts.items()}
    there = {r.selector: (r.exists, r["count"]) for r in resolve.element_exists(wanted, dom).collect()}
    assert there == {s: (n > 0, n) for s, n in counts.items()}
    best = {r.reference: r.match for r in resolve.best_match(wanted.withColumnRenamed("selector", "reference"), dom).collect()}
    assert best == {s: s if n else None for s, n in counts.items()}
    actions = wanted.select(F.monotonically_increasing_id().alias("action_id"), "page_id", F.struct(F.lit("wait").alias("type"), F.col("selector").alias("element"), F.lit(None).cast("string").alias("value")).alias("action"))
    found = {r.action.element: r for r in resolve.resolve_elements(actions, dom).collect()}
    assert {s: r.strategy for s, r in found.items()} == {s: "DirectSelector" if n else None for s, n in counts.items()}
    assert not any(r.unsupported_selector for r in found.values())


def test_page_rows_are_never_broadcast(spark):
    """Their size is guessed from the stored table, which is far too little; the driver cannot hold them."""
    found = resolution.structural_info(spark, DATA)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
