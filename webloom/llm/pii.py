"""Personal data: labelers vote on candidate spans, and their agreement trains a span classifier.

Method (weak supervision). Fixed patterns find the base spans of each kind, which always stay. Looser patterns add
candidates (masked addresses, IPv6, national phone numbers, cards of other lengths or with one wrong digit). Labelers
vote yes, no or nothing on every candidate: the strict rule, a gazetteer (domain endings, address blocks, issuers,
dialling codes), the words before the span, and its form. Expectation-maximisation over the counts of vote patterns, at
most 81 per kind, estimates how reliable each labeler is, with the truth hidden. The probabilities that follow label the
candidates, and a classifier over the spans' features (votes and form) is trained on them: log-odds per feature value,
a table of bounded size. A loose candidate that it finds more likely than not, and that overlaps no base span, becomes
a span.

DataFrame functions only. Spans are found where a row is read and nothing but vote counts is shuffled.

Defined results: a null text counts as empty and has no spans. Positions are in code points, ends exclusive. Repeated
rows and equal or null ids are answered row by row; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.plans.scale import stored

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive, since no shorter match could help, and started only where a run of the class starts (or
#: the previous match ends), which finds the same spans in linear time.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,16}(?![0-9])",
    "phone": r"(?<![0-9+)])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: What every text with a match of the base and of the loose pattern contains: spares most texts the long patterns.
HINTS = {
    "email": (r"@", r"[\[(]at[\])]"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9]{4}"),
    "phone": (r"\+[0-9]", r"[0-9]{3}"),
}
#: Gazetteers: fixed public values.
GAZETTEER = {
    "email": r"(?i)[.\])\x20](?:com|org|net|edu|gov|io|info|biz|de|fr|es|it|nl|uk|eu|us|ca|ch|at|be|pl|se|no|dk|fi|pt|ie|br|mx|ar|in|jp|cn|ru|au|nz)$",
    "ip": r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.|^(?i:[23][0-9a-f]{3}|f[cd][0-9a-f]{2}|fe80):",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
}
CONTEXT = {
    "email": r"(?i)(?:mail|contact|write|reply|correo|courriel|kontakt)",
    "ip": r"(?i)(?:\bip\b|address|host|server|client|login|adresse)",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|whatsapp|telefon|móvil)",
}
AGAINST = r"(?i)(?:order|invoice|version|serial|isbn|part no|ticket|build|commit|bestell|pedido|facture)"
BEFORE = 24  # code points before a span that the context labeler reads
LABELERS = ("strict", "gazetteer", "context", "form")
ITERATIONS = 8


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(places, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """What a base match must fulfil besides its pattern."""
    count = F.length(_digits(value))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(count.between(16, 19), _luhn(value)).otherwise(False)
    return count.between(8, 15)


def _matches(text: Column, pattern: str, holds) -> Column:
    """Spans (start, end, value) of the leftmost non-overlapping matches that `holds` accepts.

    What lies between the matches gives their places.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap))
    both = F.zip_with(values, F.slice(gaps, 1, F.size(values)), lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        own = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(end.alias("at"), F.when(holds(x["value"]), F.concat(acc["found"], own)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(both, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])


def _guarded(text: Column, may: Column, spans: Column) -> Column:
    return F.when(may, spans).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0 for yes, no and no opinion."""
    return F.when(yes, 1).when(~yes if no is None else no, -1).otherwise(0)


def _described(kind: str, text: Column, span: Column, base: bool) -> Column:
    """A candidate with its labelers' votes."""
    value = span["value"]
    before = F.substring(text, F.greatest(span["start"] - BEFORE, F.lit(0)) + 1, F.least(span["start"], F.lit(BEFORE)))
    form = {
        "email": _vote(F.length(value) <= 64, F.length(value) > 128),
        "ip": _vote(~value.rlike(r"(?:^|\.)0[0-9]|^0")),
        "card": _vote(_luhn(value)),
        "phone": _vote(value.rlike(r"[\x20().-]"), F.length(_digits(value)) > 13),
    }[kind]
    votes = [F.lit(1 if base else -1), _vote(value.rlike(GAZETTEER[kind])), _vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)), form]
    named = [vote.cast("int").alias(name) for name, vote in zip(LABELERS, votes, strict=True)]
    shape = F.concat_ws("/", F.least(F.length(value), F.lit(40)).cast("string"), F.regexp_extract(before, r"([\x20\n:=]?)$", 1))
    return F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), span["start"].alias("start"), span["end"].alias("end"), *named, shape.alias("shape"))


def _describer(kind: str, text: Column, base: bool):
    return lambda span: _described(kind, text, span, base)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and its candidates, base ones first, each with votes and form; one row per document."""
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        base, loose = HINTS[kind]
        rows = rows.withColumn(f"base_{kind}", _guarded(text, text.rlike(base), _matches(text, BASE[kind], lambda v, k=kind: _holds(k, v))))
        rows = rows.withColumn(f"loose_{kind}", _guarded(text, text.rlike(loose), _matches(text, LOOSE[kind], lambda v: F.lit(True))))
    parts = []
    for kind in KINDS:
        base, loose = F.col(f"base_{kind}"), F.col(f"loose_{kind}")
        taken = F.concat(*[F.col(f"base_{k}") for k in KINDS])
        free = F.filter(loose, lambda s: ~F.exists(taken, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        parts += [F.transform(base, _describer(kind, text, True)), F.transform(free, _describer(kind, text, False))]
    return rows.select("doc_id", F.concat(*parts).alias("spans"))


def _log(x: float) -> float:
    return math.log(max(x, 1e-9))


def reliabilities(patterns: DataFrame) -> dict:
    """P(vote | kind, labeler, truth) and P(truth | kind), by expectation-maximisation over counted vote patterns.

    `patterns` has one row per kind and combination of votes; each iteration sums it once more. Starts from the
    majority of the votes.
    """
    total = reduce(Column.__add__, [F.col(name) for name in LABELERS])
    belief = F.when(total > 0, 0.9).when(total < 0, 0.1).otherwise(0.5)
    model = {}
    for _ in range(ITERATIONS):
        seen = patterns.withColumn("p", belief)
        votes = F.explode(F.array(*[F.struct(F.lit(name).alias("labeler"), F.col(name).alias("vote")) for name in LABELERS]))
        sums = seen.select("kind", "n", "p", votes.alias("v")).groupBy("kind", "v.labeler", "v.vote").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum(F.col("n") * (1 - F.col("p"))).alias("no"))
        model = {}
        for kind, labeler, vote, yes, no in sums.collect():  # at most 4 kinds x 4 labelers x 3 votes
            model[kind, labeler, vote] = (yes, no)
        odds = F.lit(0.0)
        for kind in KINDS:
            own = {k: v for k, v in model.items() if k[0] == kind}
            yes, no = (sum(v[i] for k, v in own.items() if k[1] == LABELERS[0]) for i in (0, 1))
            score = F.lit(_log(yes + 1) - _log(no + 1))
            for name in LABELERS:
                for vote in (-1, 0, 1):
                    a, b = own.get((kind, name, vote), (0.0, 0.0))
                    score = score + F.when(F.col(name) == vote, _log((a + 1) / (yes + 3)) - _log((b + 1) / (no + 3))).otherwise(0.0)
            odds = F.when(F.col("kind") == kind, score).otherwise(odds)
        belief = 1 / (1 + F.exp(-odds))
    return {"model": model, "belief": belief}


def _features(c) -> Column:
    """The classifier's features of a candidate as names: each vote, pairs with the form, and the form."""
    names = [F.concat_ws(":", c["kind"], F.lit(name), c[name].cast("string")) for name in LABELERS]
    return F.array(*names, F.concat_ws(":", c["kind"], F.lit("shape"), c["shape"]))


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, base and all: arrays of (kind, start, end), by kind and then start."""
    rows = stored(candidates(docs), "pii-candidates")
    each = rows.select(F.explode("spans").alias("c"))
    patterns = stored(each.groupBy("c.kind", *[f"c.{name}" for name in LABELERS]).agg(F.count("*").alias("n")), "votes")
    belief = reliabilities(patterns)["belief"]
    # The classifier's table: how often each feature goes with either truth. Features are few: 4 kinds, votes and forms.
    labelled = each.select("c.*", "c").withColumn("p", belief).select("kind", "p", F.explode(_features(F.col("c"))).alias("feature"))
    counts = labelled.groupBy("kind", "feature").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    weights, prior = {}, {}
    for kind in KINDS:
        own = [r for r in counts if r["kind"] == kind]
        yes, no = (sum(r[c] for r in own) / (len(LABELERS) + 1) for c in ("yes", "no"))
        prior[kind] = _log(yes + 1) - _log(no + 1)
        for r in own:
            weights[r["feature"]] = _log((r["yes"] + 0.5) / (yes + 1)) - _log((r["no"] + 0.5) / (no + 1))
    table = F.create_map(*[F.lit(x) for kv in (weights or {"": 0.0}).items() for x in kv])
    priors = F.create_map(*[F.lit(x) for kv in prior.items() for x in kv])

    def wanted(c):
        known = F.aggregate(_features(c), F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return c["base"] | (known + F.element_at(priors, c["kind"]) > 0)

    def plain(found):
        order = F.array_sort(F.transform(found, lambda c: F.struct(_place(c["kind"]).alias("k"), c["start"].alias("start"), c["end"].alias("end"))))
        return F.transform(order, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["k"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    found = F.filter("spans", wanted)
    return rows.select("doc_id", plain(F.filter("spans", lambda c: c["base"])).alias("base"), plain(found).alias("all"))


def _place(kind: Column) -> Column:
    return reduce(lambda rest, k: F.when(kind == k[1], k[0] + 1).otherwise(rest), enumerate(KINDS), F.lit(0))


def _joined(found: str) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark, sf_dir):
    rows = spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    numbers = [(F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("bigint").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *numbers, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all").alias("spans"))
