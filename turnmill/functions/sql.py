"""Small helpers to compose SQL expression text.

Record conversion is written as SQL text: one parsed expression instead of
hundreds of single column calls.
"""

from __future__ import annotations

from turnmill.functions.text import PY_WS


def literal(text: str | None) -> str:
    """``text`` as a SQL string literal."""
    if text is None:
        return "CAST(NULL AS STRING)"
    plain = all(c.isprintable() and c not in "\\'" for c in text)
    body = text if plain else "".join(c if c.isalnum() and c.isascii() else _escape(c) for c in text)
    return f"'{body}'"


def _escape(c: str) -> str:
    return f"\\u{ord(c):04x}" if ord(c) < 0x10000 else f"\\U{ord(c):08x}"


def strip(text: str) -> str:
    """``text`` without the blanks around it, by Python's rules.

    Trimming a set of characters from the right end walks the whole string, so
    it is only done for a text that ends in one of them.
    """
    blanks = literal(PY_WS)
    ends_blank = " OR ".join(f"endswith(w, {literal(c)})" for c in PY_WS)
    stripped = f"CASE WHEN {ends_blank} THEN btrim(w, {blanks}) ELSE trim(LEADING {blanks} FROM w) END"
    return bind("w", text, stripped)


def strip_short(text: str) -> str:
    """The same for a text of a few characters."""
    return f"btrim({text}, {literal(PY_WS)})"


def bind(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once per row."""
    return f"transform(array({value}), {name} -> {body})[0]"
