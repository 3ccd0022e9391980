"""What a parse warning advises, by what its line shows, in the order in which it is tried."""

from __future__ import annotations

ARROW = "Arrow function may be missing parentheses around parameters."
#: (opening, closing, advice where their numbers differ)
BRACKETS = [
    ("{", "}", "Mismatched braces `{}` detected on this line. Check for unclosed blocks."),
    ("(", ")", "Mismatched parentheses `()` detected. Check for unclosed function calls."),
    ("[", "]", "Mismatched brackets `[]` detected. Check for unclosed array literals."),
]
COMMA = "Trailing comma may not be allowed in this context."
OTHERWISE = "Check for typos, missing punctuation, or unsupported syntax in this area."
