"""SQL expressions over parsed JSON (``VARIANT``)."""

from __future__ import annotations

from turnmill.functions.sql import bind

# The binary form of a VARIANT is limited to 128 MiB; shorter texts always fit.
VARIANT_LIMIT_BYTES = 64 * 1024 * 1024


# What the parser takes: standard JSON with strings of any length, and NaN and Infinity
# as Python writes them.
_OPTIONS = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'true', 'maxStringLen', '2147483647')"


def _checksum(raw: str) -> str:
    return f"CAST(xxhash64({raw}) AS STRING)"


def parse_strict(raw: str) -> str:
    """One JSON value; null when the text holds anything before or after it.

    The parser stops at the end of the first value and ignores the rest, so the
    text is parsed as the first element of a two-element array whose second
    element is a checksum of the text. The checksum is only found in its place
    when the text was exactly one value.
    """
    pair = f"from_json(concat('[', {raw}, ',', {_checksum(raw)}, ']'), 'variant', {_OPTIONS})"
    whole = (
        f"try_variant_get(p, '$[1]', 'bigint') = xxhash64({raw})"
        " AND try_variant_get(p, '$[2]', 'variant') IS NULL"
    )
    return bind("p", pair, f"CASE WHEN {whole} THEN try_variant_get(p, '$[0]', 'variant') END")


def parse_strict_list(raw: str) -> str:
    """The elements of a JSON list, each a VARIANT of its own; null when malformed.

    The same check as in :func:`parse_strict`, with the checksum as one more
    element. Only a single element has to fit the VARIANT limit, not the list.
    """
    marked = f"concat(substr({raw}, 1, length({raw}) - 1), ',', {_checksum(raw)}, ']')"
    last = "try_variant_get(get(l, size(l) - 1), '$', 'bigint')"
    elements = bind(
        "l",
        f"from_json({marked}, 'array<variant>', {_OPTIONS})",
        f"CASE WHEN endswith({raw}, ']') AND {last} = xxhash64({raw}) THEN slice(l, 1, size(l) - 1) END",
    )
    return f"CASE WHEN {raw} RLIKE '^\\\\[\\\\s*\\\\]$' THEN CAST(array() AS ARRAY<VARIANT>) ELSE {elements} END"


def field(value: str, key: str) -> str:
    """The field as VARIANT: SQL null when absent, a VARIANT null for JSON null."""
    return f"try_variant_get({value}, '$.{key}', 'variant')"


def typed(value: str, key: str, sql_type: str) -> str:
    """The field cast to a SQL type; null when absent or not castable."""
    return f"try_variant_get({value}, '$.{key}', '{sql_type}')"


def is_list(value: str, key: str) -> str:
    return f"{typed(value, key, 'array<variant>')} IS NOT NULL"


def has(value: str, key: str) -> str:
    """The key is there, even when its value is null."""
    return f"{field(value, key)} IS NOT NULL"


def _as_string(value: str) -> str:
    return f"try_variant_get({value}, '$', 'string')"


def string_or_null(value: str) -> str:
    """The text of a JSON string; null for every other kind."""
    return bind("s", value, f"CASE WHEN schema_of_variant(s) = 'STRING' THEN {_as_string('s')} END")


def first_truthy(value: str, otherwise: str) -> str:
    """A string if ``value`` is a non-empty one; ``otherwise`` if it is empty.

    Empty means absent, null, ``""``, zero, false, ``[]`` or ``{}``. Any other
    value that is no string gives null.
    """
    empty = (
        "to_json(t) IN ('false', '[]', '{}') OR coalesce(try_variant_get(t, '$', 'double') = 0, false)"
    )
    return bind(
        "t",
        value,
        f"""CASE WHEN t IS NULL OR is_variant_null(t) THEN {otherwise}
             WHEN schema_of_variant(t) = 'STRING' THEN coalesce(nullif({_as_string('t')}, ''), {otherwise})
             WHEN {empty} THEN {otherwise} END""",
    )


def _printed(value: str) -> str:
    """A JSON value that is no string, as Python prints it where SQL differs."""
    return f"""CASE coalesce({_as_string(value)}, to_json({value}))
                    WHEN 'true' THEN 'True' WHEN 'false' THEN 'False' WHEN 'NaN' THEN 'nan'
                    WHEN 'Infinity' THEN 'inf' WHEN '-Infinity' THEN '-inf'
                    ELSE coalesce({_as_string(value)}, to_json({value})) END"""


def content_text(value: str) -> str:
    """Message content as one string.

    Strings stay as they are, absent and null become empty, a list of parts
    becomes its texts on separate lines, anything else is printed.
    """
    part_text = f"""CASE WHEN is_variant_null(x) THEN 'None'
                         WHEN schema_of_variant(x) = 'STRING' THEN {_as_string('x')} ELSE {_printed('x')} END"""
    part = f"""CASE WHEN schema_of_variant(p) = 'STRING' THEN {_as_string('p')}
                    WHEN startswith(schema_of_variant(p), 'OBJECT') AND {has('p', 'text')} THEN
                      {bind('x', field('p', 'text'), part_text)}
               END"""
    texts = f"filter(transform(try_variant_get(c, '$', 'array<variant>'), p -> {part}), p -> p IS NOT NULL)"
    return bind(
        "c",
        value,
        f"""CASE WHEN c IS NULL OR is_variant_null(c) THEN ''
             WHEN schema_of_variant(c) = 'STRING' THEN {_as_string('c')}
             WHEN startswith(schema_of_variant(c), 'ARRAY') THEN array_join({texts}, '\\n')
             ELSE {_printed('c')} END""",
    )
