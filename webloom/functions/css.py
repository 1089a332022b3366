"""Constant CSS selectors as Column predicates over node rows (tag, raw).

Supported: type, #id, .class, [a], [a=v] with ^= $= *= ~= and the `i` flag, :not(simple), :scope, :has-text("..."),
descendants and comma lists. Anything else raises ValueError: a selector is never half understood.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.attrs import attr, has_attr, has_class
from webloom.functions.text import built_once, collapse_ws, contains_ci

_PIECE = re.compile(
    r"""(?P<comma>\s*,\s*)|(?P<space>\s+)|(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[\^$*~]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s"']+))\s*(?P<ci>[iI])?\s*)?\]
    |:not\((?P<neg>[^()]*)\)|:has-text\("(?P<text>[^"]*)"\)|(?P<scope>:scope)""",
    re.X,
)


@dataclass
class Compound:
    """One simple test of a single element."""

    tag: str | None = None
    ids: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)
    attrs: list[tuple[str, str | None, str, bool]] = field(default_factory=list)
    negated: list[Compound] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    scope: bool = False

    def test(self) -> Column:
        tests = []
        if self.tag and self.tag != "*":
            tests.append(F.col("tag") == self.tag.lower())
        needs_attrs = []
        needs_attrs += [attr("id") == value for value in self.ids]
        needs_attrs += [has_class(value) for value in self.classes]
        needs_attrs += [_attr_test(*a) for a in self.attrs]
        if needs_attrs:
            tests.append(F.when(F.length("raw") > F.length("tag") + 2, reduce(and_, needs_attrs)).otherwise(False))
        tests += [~F.coalesce(n.test(), F.lit(False)) for n in self.negated]
        tests += [contains_ci(collapse_ws("text"), F.lit(value)) for value in self.texts]
        return F.coalesce(reduce(and_, tests), F.lit(False)) if tests else F.lit(True)


def _attr_test(name: str, op: str | None, value: str, ignore_case: bool) -> Column:
    if op is None:
        return has_attr(name)
    here = F.lower(attr(name)) if ignore_case else attr(name)
    want = F.lit(value.lower() if ignore_case else value)
    if op == "=":
        return here == want
    if op == "~=":
        return F.array_contains(F.split(here, r"\s+"), want)
    if value == "":
        return F.lit(False)
    return {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](here, want)


def parse_selector(selector: str) -> list[list[Compound]]:
    """Alternatives of a selector list, each a chain of compounds from outermost to innermost."""
    groups, chain, now, used, at = [], [], Compound(), False, 0
    text = selector.strip()
    while at < len(text):
        m = _PIECE.match(text, at)
        if m is None or m.end() == at:
            raise ValueError(f"unsupported selector: {selector!r}")
        at = m.end()
        if m["comma"] or m["space"]:
            if not used:
                raise ValueError(f"unsupported selector: {selector!r}")
            chain.append(now)
            if m["comma"]:
                groups.append(chain)
                chain = []
            now, used = Compound(), False
            continue
        used = True
        if m["tag"]:
            now.tag = m["tag"]
        elif m["id"]:
            now.ids.append(m["id"])
        elif m["cls"]:
            now.classes.append(m["cls"])
        elif m["attr"]:
            value = next((m[k] for k in ("dq", "sq", "bare") if m[k] is not None), "")
            now.attrs.append((m["attr"], m["op"], value, bool(m["ci"])))
        elif m["neg"] is not None:
            inner = parse_selector(m["neg"])
            if len(inner) != 1 or len(inner[0]) != 1:
                raise ValueError(f"unsupported selector: {selector!r}")
            now.negated.append(inner[0][0])
        elif m["text"] is not None:
            now.texts.append(m["text"])
        else:
            now.scope = True
    if not used:
        raise ValueError(f"unsupported selector: {selector!r}")
    return [*groups, [*chain, now]]


@built_once
def simple(selector: str) -> Column:
    """Predicate of a selector list without descendant combinators."""
    groups = parse_selector(selector)
    if any(len(chain) > 1 for chain in groups):
        raise ValueError(f"needs its ancestors: {selector!r}")
    return reduce(or_, [chain[0].test() for chain in groups])


def match(nodes: DataFrame, selectors: dict[str, str]) -> DataFrame:
    """Add one boolean column per named selector. Descendant chains use running maxima, not joins."""
    parsed = {name: parse_selector(selector) for name, selector in selectors.items()}
    running = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    steps = max(len(chain) for groups in parsed.values() for chain in groups)
    out, kept = nodes, list(nodes.columns)
    # Step i adds, for every chain, whether the element matches its first i compounds.
    for step in range(1, steps + 1):
        flags = []
        for name, groups in parsed.items():
            for g, chain in enumerate(groups):
                if step > len(chain):
                    continue
                test = chain[step - 1].test()
                if step > 1:
                    reach = F.max(F.when(F.col(f"_{name}_{g}_{step - 1}"), F.col("end"))).over(running)
                    test = test & F.coalesce(reach > F.col("pos"), F.lit(False))
                flags.append(test.alias(f"_{name}_{g}_{step}"))
        out = out.select("*", *flags)
    final = [
        reduce(or_, [F.col(f"_{name}_{g}_{len(chain)}") for g, chain in enumerate(groups)]).alias(name)
        for name, groups in parsed.items()
    ]
    return out.select(*kept, *final)
