"""Pages, messages and logs rendered by Spark from the stored tables, so their results can be read off the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITE = "https://parts-register.example"
PER_PAGE = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _page(page_id: Column, url: Column, body: Column, head: str = "") -> list[Column]:
    html = F.concat(F.lit(f"<!DOCTYPE html><html><head>{head}</head><body>"), body, F.lit("</body></html>"))
    return [page_id.cast("bigint").alias("page_id"), url.alias("url"), html.alias("html")]


def _joined(part: Column, order: str) -> Column:
    """Aggregate: the fragments of a page in order. Pages hold a fixed number of source rows."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), part.alias("part"))))
    return F.array_join(F.transform(rows, lambda r: r["part"]), "")


def _s(column: str) -> Column:
    return F.col(column).cast("string")


def register_pages(spark, sf_dir) -> DataFrame:
    """A register of spare parts, 24 entries per page; every page but the last leads to the next, and every tenth entry
    to a page about its maker that is stored once per maker. Some entries lack a name or price, or hold odd values."""
    part = table(spark, sf_dir, "part")
    key, k = F.col("p_partkey"), _s("p_partkey")
    lit = F.lit
    name = F.when(key % 50 == 7, lit("")).otherwise(F.concat(lit("<h3 class='name wide'> "), "p_name", lit("</h3>")))
    price = F.when(key % 40 == 11, lit("on request")).otherwise(F.concat(lit("EUR "), F.format_number("p_retailprice", 2)))
    day = F.when(key % 30 == 4, lit("soon")).otherwise(F.concat(lit("20"), (key % 20 + 10).cast("string"), lit("-07-04")))
    size = F.when(key % 3 == 0, F.concat(lit("<span class=size>"), _s("p_size"), lit(" mm</span>"))).otherwise("")
    shelf = F.when(key % 2 == 0, lit("<em class=shelf>rack B &amp; C</em>")).otherwise("")
    boxed = F.when(key % 25 == 3, lit("perhaps")).when(key % 2 == 0, lit("true")).otherwise("false")
    maker = F.when(key % 10 == 0, F.concat(lit('<a class=maker href="/makers/'), F.substring("p_brand", 7, 2), lit('">'), "p_brand", lit("</a>"))).otherwise("")
    entry = F.concat(
        lit('<article class="entry" data-code="SP-'), k, lit('">'), name, lit('<p class="price">'), price, lit('</p><figure><img src="/drawings/'), k,
        lit('.svg"></figure><a class="sheet" href="/sheets/'), k, lit('">data sheet</a><time>'), day, lit("</time><b class=grade>"), "p_type",
        lit("</b><i class=boxed>"), boxed, lit("</i>"), size, shelf, maker, lit("</article>"),
    )
    pages = part.groupBy(F.floor(key / PER_PAGE).alias("n")).agg(_joined(entry, "p_partkey").alias("entries"))
    before = part.select((F.floor(key / PER_PAGE) - 1).alias("n")).distinct().withColumn("has_next", F.lit(True))
    following = F.when(
        F.col("has_next"), F.concat(lit('<a rel="next" href="/register?page='), (F.col("n") + 1).cast("string"), lit('">Next</a>'))
    ).otherwise("")
    url = F.concat(lit(f"{SITE}/register?page="), _s("n"))
    return pages.join(before, "n", "left").select(*_page(F.col("n"), url, F.concat(lit("<main>"), "entries", lit("</main><nav>"), following, lit("</nav>"))))


def maker_pages(spark, sf_dir) -> DataFrame:
    """One page per maker, with an entry of its own and a link to the maker with the next number."""
    part = table(spark, sf_dir, "part")
    number = F.substring("p_brand", 7, 2).cast("bigint")
    makers = part.groupBy(number.alias("m")).agg(F.first("p_brand").alias("brand"))
    m = F.col("m").cast("string")
    body = F.concat(
        F.lit('<article class="entry" data-code="M-'), m, F.lit('"><h3 class="name">'), "brand", F.lit('</h3><p class="price">0</p><a class="sheet" href="/makers/'), m,
        F.lit('/sheet">sheet</a></article><a class="maker" href="/makers/'), (F.col("m") + 1).cast("string"), F.lit('">next maker</a>'),
    )
    return makers.select(*_page(F.col("m") + 1_000_000_000, F.concat(F.lit(f"{SITE}/makers/"), m), body))


def order_pages(spark, sf_dir) -> DataFrame:
    """One table per order, ten to a page, without the end tags HTML lets one leave out."""
    line = table(spark, sf_dir, "lineitem")
    row = F.concat(F.lit("<tr><td>"), _s("l_linenumber"), F.lit("<td> part "), _s("l_partkey"), F.lit(" <td>"), "l_returnflag")
    tables = line.groupBy("l_orderkey").agg(_joined(row, "l_linenumber").alias("rows"))
    html = F.concat(
        F.lit("<table><caption>Order "), _s("l_orderkey"), F.lit("</caption><thead><tr><th>Line<th>Part<th>Flag<tbody>"),
        "rows", F.lit("</table>"),
    )
    pages = tables.groupBy(F.floor(F.col("l_orderkey") / 10).alias("n")).agg(_joined(html, "l_orderkey").alias("body"))
    return pages.select(*_page(F.col("n"), F.concat(F.lit(f"{SITE}/orders/"), _s("n")), F.col("body")))


def customer_lists(spark, sf_dir) -> DataFrame:
    """20 customers per page as a list; every fifth item holds a nested list. Lists in nav and of one item are not
    to be found."""
    customer = table(spark, sf_dir, "customer")
    nested = F.when(
        F.col("c_custkey") % 5 == 0,
        F.concat(F.lit("<ol><li>"), "c_mktsegment", F.lit("<li>nation "), _s("c_nationkey"), F.lit("</ol>")),
    ).otherwise("")
    item = F.concat(F.lit("<li>"), "c_name", nested)
    pages = customer.groupBy(F.floor(F.col("c_custkey") / 20).alias("n")).agg(_joined(item, "c_custkey").alias("items"))
    body = F.concat(F.lit("<nav><ul><li>a<li>b</ul></nav><ol><li>only</ol><ul>"), "items", F.lit("</ul>"))
    return pages.select(*_page(F.col("n"), F.concat(F.lit(f"{SITE}/customers/"), _s("n")), body))


def customer_forms(spark, sf_dir) -> DataFrame:
    """One form per customer: text field, select in a label, text area, hidden field, submit button."""
    customer = table(spark, sf_dir, "customer")
    key = _s("c_custkey")
    body = F.concat(
        F.lit('<form id="f'), key, F.lit('" action="/save/'), key, F.lit('" method="post"><label for="name'), key,
        F.lit('"> Name of '), key, F.lit(' </label><input id="name'), key, F.lit('" name="name" placeholder="Your name" value="'),
        "c_name", F.lit('" required><label>Segment <select name="segment"><option>NONE<option selected value="'),
        "c_mktsegment", F.lit('">'), "c_mktsegment",
        F.lit('</select></label><textarea name="note">nation '), _s("c_nationkey"),
        F.lit('</textarea><input type="hidden" name="key" value="'), key, F.lit('"><input type="submit" value="Save '), key,
        F.lit('"></form>'),
    )
    return customer.select(*_page(F.col("c_custkey"), F.concat(F.lit(f"{SITE}/customer/"), key), body))


def button_pages(spark, sf_dir) -> DataFrame:
    """One part per page with one of seven kinds of button, one without text and a hidden one."""
    part = table(spark, sf_dir, "part")
    key, name = _s("p_partkey"), F.col("p_name")
    kinds = [
        F.concat(F.lit('<button id="b'), key, F.lit('" type="button">Buy '), name, F.lit("</button>")),
        F.concat(F.lit('<div role="button" class="big buy">Buy '), name, F.lit("</div>")),
        F.concat(F.lit('<input type="button" name="buy" value="Buy '), name, F.lit('">')),
        F.concat(F.lit('<input type=submit value="Buy '), name, F.lit('">')),
        F.concat(F.lit('<a class="btn primary" href="/buy/'), key, F.lit('">Buy '), name, F.lit("</a>")),
        F.concat(F.lit('<a href="javascript:buy('), key, F.lit(')">Buy '), name, F.lit("</a>")),
        F.concat(F.lit('<span class="my-button" aria-label="Buy '), name, F.lit('"></span>')),
    ]
    kind = F.col("p_partkey") % 7
    body = F.coalesce(*[F.when(kind == i, k) for i, k in enumerate(kinds)])
    extra = '<button></button><div style="display: none"><button class="x">Hidden</button></div>'
    return part.select(
        *_page(F.col("p_partkey"), F.concat(F.lit(f"{SITE}/b/"), key), F.concat(body, F.lit(extra)))
    )


def media_pages(spark, sf_dir) -> DataFrame:
    """Images, some of them empty, without size or hidden, and frames."""
    part = table(spark, sf_dir, "part")
    key = _s("p_partkey")
    body = F.concat(
        F.lit('<img src="/i/'), key, F.lit('.png" alt="'), "p_name", F.lit('" width="'), _s("p_size"),
        F.lit('" height="20"><img src="" alt="none"><img src="/zero.png" width="0">'),
        F.lit('<p hidden><img src="/hidden.png"></p><span role="img" aria-label="icon '), key,
        F.lit('"></span><iframe src="/f/'), key, F.lit('" title="'), "p_brand", F.lit('" width="300"></iframe><iframe width=0></iframe>'),
    )
    return part.select(*_page(F.col("p_partkey"), F.concat(F.lit(f"{SITE}/m/"), key), body))


def score_pages(spark, sf_dir) -> DataFrame:
    """Per part: five links, each with one more reason to matter, in an order given by the part."""
    part = table(spark, sf_dir, "part")
    key = _s("p_partkey")
    body = F.concat(
        F.lit('<header><a href="/home">Home page of the store</a></header>'),
        F.lit('<a href="/plain/'), key, F.lit('">plain</a><a href="/long/'), key,
        F.lit('">a text of more than twenty characters</a><h2><a href="/head/'), key,
        F.lit('">head</a></h2><article><a class="btn" href="/call/'), key, F.lit('">call</a><a href="/image/'), key,
        F.lit('"><img src="x.png">image</a></article><a href="/x">x</a><a href="javascript:go()">go</a>'),
    )
    meta = '<meta name="description" content=" parts &amp; more ">'
    return part.select(*_page(F.col("p_partkey"), F.concat(F.lit(f"{SITE}/s/"), key), body, meta))


def graph_pages(spark, sf_dir) -> DataFrame:
    """Customer k links to customers 10k+1 .. 10k+10, its parent, and a page that is not stored."""
    customer = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    children = F.array_join(
        F.transform(
            F.sequence(k * 10 + 1, k * 10 + 10),
            lambda c: F.concat(F.lit('<li><a href="../c/'), c.cast("string"), F.lit('#top">child</a>')),
        ),
        "",
    )
    body = F.concat(
        F.lit("<ul>"), children, F.lit('</ul><a href="/c/'), F.floor((k - 1) / 10).cast("string"),
        F.lit('">parent</a><a href="https://elsewhere.example/c/1">out</a><a href="/cart/'), _s("c_custkey"), F.lit('">cart</a>'),
    )
    return customer.select(*_page(k, F.concat(F.lit(f"{SITE}/c/"), _s("c_custkey")), body))


# --- agent messages and logs from events ------------------------------------------------------------------------------


def event_values(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_type",
        F.get_json_object("props", "$.k").alias("k"),
        "value",
    )


def action_text(spark, sf_dir) -> DataFrame:
    """One message per event: plain JSON, JSON within prose, key-value pairs, a call for help, or none of these."""
    e = event_values(spark, sf_dir)
    kind = F.col("event_type")
    text = (
        F.when(
            F.col("seq") % 5 == 0,
            F.concat(F.lit('{"type": "click", "value": "a. https://x.example/'), "k", F.lit('", "maxWait": '), "k", F.lit("}")),
        )
        .when(
            F.col("seq") % 5 == 1,
            F.concat(F.lit('I will do {not json} {"type": "'), kind, F.lit('", "selector": "#e'), "k", F.lit('"} now')),
        )
        .when(
            F.col("seq") % 5 == 2,
            F.concat(F.lit("Action: "), kind, F.lit(', Element="#box '), "k", F.lit("\" value='v "), "k", F.lit("' maxWait=9")),
        )
        .when(F.col("seq") % 5 == 3, F.concat(F.lit("I am Not Sure what to do about "), kind, F.lit(" "), "k"))
        .otherwise(F.concat(F.lit("nothing to see in "), kind))
    )
    return e.select("session_id", "seq", "ts", text.alias("text"))


TYPES = {"click": "click", "view": "navigate", "signup": "input", "purchase": "wait", "error": "scroll"}


def unnumbered_log(spark, sf_dir) -> DataFrame:
    """Actions of each user in time order; `seq` is still the event's own number."""
    e = event_values(spark, sf_dir)
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in TYPES.items()])
    small = (F.col("k").cast("int") % 4).cast("string")
    action = F.struct(
        kind.alias("type"),
        F.when(kind.isin("click", "input"), F.concat(F.lit("#e"), small)).alias("element"),
        F.when(kind == "input", F.concat(F.lit("v"), small))
        .when(kind == "navigate", F.concat(F.lit("https://x.example/"), small))
        .alias("value"),
        F.lit("https://x.example/0").alias("previousUrl"),
    )
    result = F.when(F.col("event_type") == "error", "fail").when(F.col("value") > 20, "partial").otherwise("success")
    return e.select("session_id", "seq", "ts", action.alias("action"), result.alias("result"))


def history_lines(log: DataFrame) -> DataFrame:
    """The log's actions as history lines."""
    a = F.col("action")
    done = F.when(F.col("result") == "success", F.lit(" successfully")).otherwise("")
    line = (
        F.when(a["type"] == "click", F.concat(F.lit("Clicked "), a["element"], done))
        .when(a["type"] == "input", F.concat(F.lit("Input '"), a["value"], F.lit("' to "), a["element"]))
        .when(a["type"] == "navigate", F.concat(F.lit("Navigated to: "), a["value"]))
        .otherwise(F.concat(F.lit("Did "), a["type"]))
    )
    return log.select("session_id", "seq", line.alias("line"))
