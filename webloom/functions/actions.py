"""Fixed vocabulary of agent actions and the Spark type of an action."""

from __future__ import annotations

# Action types, and the words that mean "ask a human".
ACTION_TYPES = ["input", "navigate", "click", "wait", "sendHumanMessage", "notes", "scroll"]
SELECTOR_TYPES = ["css", "xpath", "text"]
OPERATIONS = ["add", "read"]
DIRECTIONS = ["up", "down"]
LOOSE_WORDS = [
    "click", "input", "navigate", "scroll", "extract", "wait", "sendHumanMessage", "sendhumanmessage", "ask_human", "ask",
    "notes",
]
HELP_PHRASES = [
    "need help", "ask human", "confused", "not sure", "unclear", "uncertain", "help required", "assistance needed",
]
DEFAULT_QUESTION = "What should I do next?"
# Three different defaults for maxWait: when parsing, when checking, and when a message asks for help.
PARSED_WAIT, CHECKED_WAIT, HELP_WAIT = 5000, 2000, 1000

FIELDS = [
    "type", "element", "value", "description", "question", "previousUrl", "selectorType", "maxWait", "operation", "note",
    "direction",
]
ACTION_SCHEMA = ", ".join(f"{f} {'double' if f == 'maxWait' else 'string'}" for f in FIELDS)
