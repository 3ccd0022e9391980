"""Patterns of personal data in text, in the order in which they are tried, and names that never count."""

from __future__ import annotations

LITERALS: list[tuple[str, str]] = [
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("ip_address", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("credit_card", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b"),
    ("my_number", r"\b[0-9]{4}\s?[0-9]{4}\s?[0-9]{4}\b"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7}(?:[A-Z0-9]{0,18})\b"),
]

SAFE_NAMES = [
    "writeline", "readline", "deadline", "pipeline", "streamline", "guideline", "baseline", "timeline", "outline", "online", "offline", "hotline", "byline", "headline",
    "getline", "cmdline", "telephone", "controller", "selector", "delegate", "template", "throttle", "channel", "handler", "listener", "formatter", "dispatcher", "count",
    "counter", "total", "length", "size", "index", "offset",
]

TEST_CONTEXT = r"test|spec|fixture|mock|fake|stub"
