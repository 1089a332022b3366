"""Scrape specs: loading, both dialects, and checking."""

from __future__ import annotations

import json
from typing import Any

# The keys of a spec. The last group only matters to a live browser and is accepted, then ignored.
FIELD_TYPES = ["text", "number", "date", "url", "image", "html", "attribute"]
DATA_TYPES = ["string", "number", "date", "boolean"]
STRATEGIES = ["next-button", "url-pattern", "infinite-scroll", "load-more"]
NAVIGATION_TYPES = ["single", "multi", "flow"]
FORMATS = ["json", "jsonl", "csv"]
_KEYS = {
    "": {"name", "description", "target", "navigation", "selectors", "pagination", "output", "validation"},
    "target": {"baseUrl", "startPath", "maxPages", "maxItems"},
    "navigation": {"type", "followLinks", "maxDepth", "allowedDomains", "excludedPaths", "waitFor"},
    "selectors": {"container", "itemRoot", "fields", "links", "pagination"},
    "pagination": {"strategy", "waitForLoad", "scrollBehavior"},
    "output": {"directory", "filename", "format", "includeMetadata", "groupBy"},
    "validation": {"requiredFields", "dataTypes", "constraints"},
}
_FIELD_KEYS = {"selector", "type", "attribute", "transform", "required", "fallback"}
_PAGINATION_KEYS = {"nextButton", "pageIndicator", "maxPages"}
_LINK_KEYS = {"selector", "attribute", "filter", "follow"}
_CONSTRAINTS = {"min", "max", "pattern", "enum"}


class SpecError(ValueError):
    """The spec cannot be read or says something unknown."""


def load_spec(path: str) -> dict[str, Any]:
    """Read a spec from a .json, .yaml or .yml file."""
    try:
        suffix = path.rsplit(".", 1)[-1].lower()
        if suffix not in ("json", "yaml", "yml"):
            raise ValueError("Unsupported file format. Use .json or .yaml")
        with open(path, encoding="utf-8") as f:
            return parse_spec(f.read(), "json" if suffix == "json" else "yaml")
    except (OSError, ValueError) as e:
        raise SpecError(f"Failed to parse schema file: {e}") from e


def parse_spec(content: str, format: str = "json") -> dict[str, Any]:
    """Read a spec from a string."""
    try:
        if format == "json":
            raw = json.loads(content)
        elif format == "yaml":
            import yaml  # optional

            raw = yaml.safe_load(content)
        else:
            raise ValueError('Unsupported format. Use "json" or "yaml"')
    except (ValueError, ImportError) as e:
        raise SpecError(f"Failed to parse schema content: {e}") from e
    return normal_spec(raw)


def _check(where: str, given: dict, known: set[str]) -> None:
    unknown = sorted(set(given) - known)
    if unknown:
        raise SpecError(f"unknown key in {where or 'spec'}: {', '.join(unknown)}")


def normal_spec(raw: dict[str, Any]) -> dict[str, Any]:
    """The spec in its canonical form: `container` and a record of typed fields."""
    if not isinstance(raw, dict) or "selectors" not in raw:
        raise SpecError("a spec needs selectors")
    _check("", raw, _KEYS[""])
    for part, known in _KEYS.items():
        if part and isinstance(raw.get(part), dict):
            _check(part, raw[part], known)
    selectors = dict(raw["selectors"])
    container = selectors.pop("itemRoot", None) or selectors.get("container")
    if not container:
        raise SpecError("a spec needs a container")
    fields = selectors.get("fields") or {}
    if isinstance(fields, list):
        fields = {f["name"]: {k: v for k, v in f.items() if k != "name"} for f in fields}
    normal = {}
    for name, given in fields.items():
        field = dict(given)
        if "attr" in field:
            field["attribute"] = field.pop("attr")
        _check(f"field {name}", field, _FIELD_KEYS)
        field.setdefault("type", "attribute" if field.get("attribute") else "text")
        if field["type"] not in FIELD_TYPES:
            raise SpecError(f"unknown type of field {name}: {field['type']}")
        normal[name] = field
    links = selectors.get("links") or []
    for link in links:
        _check("link", link, _LINK_KEYS)
    _check("selectors.pagination", selectors.get("pagination") or {}, _PAGINATION_KEYS)
    validation = raw.get("validation") or {}
    for name, kind in (validation.get("dataTypes") or {}).items():
        if kind not in DATA_TYPES:
            raise SpecError(f"unknown data type of {name}: {kind}")
    for name, rules in (validation.get("constraints") or {}).items():
        _check(f"constraint on {name}", rules, _CONSTRAINTS)
    strategy = (raw.get("pagination") or {}).get("strategy")
    if strategy is not None and strategy not in STRATEGIES:
        raise SpecError(f"unknown pagination strategy: {strategy}")
    kind = (raw.get("navigation") or {}).get("type")
    if kind is not None and kind not in NAVIGATION_TYPES:
        raise SpecError(f"unknown navigation type: {kind}")
    return {**raw, "selectors": {**selectors, "container": container, "fields": normal, "links": links}}


def warnings(spec: dict[str, Any]) -> list[str]:
    """What the spec asks for that cannot be done, without failing."""
    notes = []
    group = (spec.get("output") or {}).get("groupBy")
    if group and group not in spec["selectors"]["fields"]:
        notes.append(f"output.groupBy names an undefined field: {group}")
    if (spec.get("navigation") or {}).get("type") == "flow":
        notes.append("navigation type flow needs a browser")
    buttons = (spec["selectors"].get("pagination") or {}).get("nextButton")
    if (spec.get("pagination") or {}).get("strategy") == "next-button" and not buttons:
        notes.append("pagination strategy next-button needs selectors.pagination.nextButton")
    if (spec.get("pagination") or {}).get("strategy") in ("infinite-scroll", "load-more"):
        notes.append(f"pagination strategy {spec['pagination']['strategy']} needs a browser")
    return notes
