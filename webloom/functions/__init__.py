"""Column helpers: text, URLs, attributes and selectors."""
