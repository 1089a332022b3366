"""Operators for preparing training text: every module holds one operator and its queries."""
