"""Bring records of any known layout into one conversation schema.

A layout is a :class:`Format`: a test on the parsed record and a converter to
messages or to text. ``register_format`` adds one; it is tried after the
built-in chat layouts and before the ``text`` fallbacks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.functions import sql
from turnmill.functions.json import (
    content_text,
    field,
    first_truthy,
    has,
    is_list,
    string_or_null,
    typed,
)
from turnmill.functions.messages import MESSAGES_TYPE, canonical_role
from turnmill.functions.templates import TURN_OPEN
from turnmill.functions.text import is_blank
from turnmill.operators.staging import with_computed

# How a ChatML turn opens, with its role, and how it ends.
# U+001C-001F are blanks for Python but not for Java's \s.
CHATML_OPENING = r"(?U)<\|im_start\|>[\s\x1c-\x1f]*([a-zA-Z]+)[\s\x1c-\x1f]*\n"
CHATML_END = r"<\|im_end\|>"

# SQL text over the columns `v` (the parsed record) and `default_system`, or a
# function from the column `v`.
Expression = str | Callable[[Column], Column]


@dataclass(frozen=True)
class Format:
    """One record layout.

    ``matches`` tests a parsed record. Exactly one of ``messages`` (gives null
    when the record is malformed) and ``text`` converts it. ``complaint``
    describes a malformed record.
    """

    name: str
    matches: Expression
    messages: Expression | None = None
    text: Expression | None = None
    complaint: str = "malformed record"


def _column(expression: Expression) -> Column:
    return F.expr(expression) if isinstance(expression, str) else expression(F.col("v"))


def _message(role: str, content: str) -> str:
    return f"named_struct('role', {role}, 'content', {content})"


def _system_turn(text: str) -> str:
    """A one-turn array, or an empty one when there is nothing to say."""
    turn = f"array({_message(sql.literal('system'), 'y')})"
    empty = f"CAST(array() AS {MESSAGES_TYPE})"
    return sql.bind("y", sql.strip(text), f"CASE WHEN y <> '' THEN {turn} ELSE {empty} END")


# Content that, seen as a string, may have been something else than a string
# that prints differently: a list, a boolean, or a number without a value.
_AMBIGUOUS = "startswith(m.{0}, '[') OR m.{0} IN ('true', 'false', 'NaN', 'Infinity', '-Infinity')"


def _turns(key: str, role: str, content: str) -> str:
    """Convert every item of a list; null when the list is absent or an item is no object.

    One cast reads the whole list with its contents as strings, which is right
    for all but a few kinds of content. Lists that may hold one of those are
    read again, item by item.
    """

    def convert(items: str, text: str) -> str:
        turn = _message(canonical_role(f"m.`{role}`"), text)
        return f"transform({items}, m -> {turn})"

    def items(content_type: str) -> str:
        return typed("v", key, f"array<struct<`{role}` string, {content} {content_type}>>")

    return sql.bind(
        "l",
        items("string"),
        f"""CASE WHEN exists(l, m -> m IS NULL) THEN NULL
                 WHEN exists(l, m -> {_AMBIGUOUS.format(content)})
                 THEN {convert(items("variant"), content_text(f"m.{content}"))}
                 ELSE {convert("l", f"coalesce(m.{content}, '')")} END""",
    )


def _exchange(asked: str, answered: str, system: str) -> str:
    """One question and its answer; null when the question is empty."""
    user, assistant = _message("'user'", "q"), _message("'assistant'", answered)
    turns = f"concat({_system_turn(system)}, array({user}, {assistant}))"
    return sql.bind("q", asked, f"CASE WHEN q <> '' THEN {turns} END")


def _stripped(key: str) -> str:
    return sql.strip(content_text(field("v", key)))


_ALPACA_QUESTION = sql.bind(
    "e",
    f"named_struct('task', {_stripped('instruction')}, 'extra', {_stripped('input')})",
    "CASE WHEN e.task = '' OR e.extra = '' THEN e.task ELSE concat(e.task, '\\n\\n', e.extra) END",
)
_REPLY = (
    "coalesce("
    + sql.bind("f", field("v", "completion"), "CASE WHEN NOT is_variant_null(f) THEN f END")
    + f", {field('v', 'response')})"
)


def parse_chatml(text: str) -> str:
    """SQL for all complete turns of a ChatML text; null when there is none.

    The text is cut at its end markers, and each piece at its first opening.
    The piece after the last end marker is an unfinished turn.
    """
    opening = sql.literal(CHATML_OPENING)
    pieces = sql.bind("x", f"split({text}, {sql.literal(CHATML_END)})", "slice(x, 1, size(x) - 1)")
    opened = f"""filter(transform({pieces}, p ->
        named_struct('role', regexp_extract(p, {opening}, 1), 'cut', split(p, {opening}, 2))),
        p -> size(p.cut) = 2)"""
    turn = _message(canonical_role("p.role"), sql.strip("p.cut[1]"))
    return sql.bind("z", opened, f"CASE WHEN size(z) > 0 THEN transform(z, p -> {turn}) END")


CHAT_FORMATS = [
    Format(
        "openai",
        is_list("v", "messages"),
        messages=_turns("messages", "role", "content"),
        complaint="'messages' must be a list of objects",
    ),
    Format(
        "sharegpt",
        is_list("v", "conversations"),
        messages=f"""concat(
            {_system_turn(first_truthy(field('v', 'system'), string_or_null(field('v', 'system_prompt'))))},
            {_turns('conversations', 'from', 'value')})""",
        complaint="'conversations' must be a list of objects",
    ),
    Format(
        "alpaca",
        has("v", "instruction"),
        messages=_exchange(
            _ALPACA_QUESTION,
            _stripped("output"),
            first_truthy(field("v", "system"), "default_system"),
        ),
        complaint="'instruction' is empty",
    ),
    Format(
        "prompt",
        f"{has('v', 'prompt')} AND ({has('v', 'completion')} OR {has('v', 'response')})",
        messages=_exchange(
            _stripped("prompt"),
            sql.strip(content_text(_REPLY)),
            string_or_null(field("v", "system")),
        ),
        complaint="'prompt' is empty",
    ),
]
TEXT_FORMATS = [
    Format(
        "chatml",
        f"""schema_of_variant({field('v', 'text')}) = 'STRING'
            AND contains({typed('v', 'text', 'string')}, {sql.literal(TURN_OPEN)})""",
        messages=parse_chatml(content_text(field("v", "text"))),
        complaint="no complete ChatML turn in 'text'",
    ),
    Format(
        "text",
        f"schema_of_variant({field('v', 'text')}) = 'STRING'",
        text=content_text(field("v", "text")),
    ),
]
_added: list[Format] = []


def register_format(fmt: Format) -> None:
    """Make a further layout known to detection and dispatch."""
    if fmt.name in {f.name for f in known_formats()}:
        raise ValueError(f"format {fmt.name!r} exists already")
    if (fmt.messages is None) == (fmt.text is None):
        raise ValueError("give exactly one of messages= and text=")
    _added.append(fmt)


def known_formats() -> list[Format]:
    return [*CHAT_FORMATS, *_added, *TEXT_FORMATS]


def with_format(records: DataFrame) -> DataFrame:
    """Add ``format``: the first layout that fits ``v``, null when none does."""
    name = F.lit(None).cast("string")
    for fmt in reversed(known_formats()):
        name = F.when(_column(fmt.matches), fmt.name).otherwise(name)
    return with_computed(records, format=name)


def _by_format(values: dict[str, Column], sql_type: str) -> Column:
    """The value that belongs to the row's format."""
    chosen = F.lit(None).cast(sql_type)
    for name, value in values.items():
        chosen = F.when(F.col("format") == name, value).otherwise(chosen)
    return chosen


def normalize(
    records: DataFrame,
    fmt: str = "auto",
    *,
    default_system: str | None = None,
    on_error: str = "raise",
) -> DataFrame:
    """Add ``format``, ``messages``, ``text`` and ``error`` to parsed records.

    ``records`` needs a VARIANT column ``v`` holding one JSON object per row.
    Each result row has ``messages`` or ``text``, or an ``error``.

    ``fmt="auto"`` looks at every record; a format name is applied to all.
    ``on_error`` is ``"raise"`` (fail the job), ``"skip"`` (drop the record) or
    ``"quarantine"`` (keep it with its ``error``). ``default_system`` is for
    instruction records without a system prompt of their own.
    """
    formats = known_formats()
    if fmt == "auto":
        records = with_format(records)
    else:
        formats = [f for f in formats if f.name == fmt]
        if not formats:
            raise ValueError(f"unknown format {fmt!r}")
        records = records.withColumn("format", F.lit(fmt))

    out = with_computed(
        records.withColumn("default_system", F.lit(default_system).cast("string")),
        messages=_by_format({f.name: _column(f.messages) for f in formats if f.messages}, MESSAGES_TYPE),
        text=_by_format({f.name: _column(f.text) for f in formats if f.text}, "string"),
    )
    complaint = _by_format({f.name: F.lit(f.complaint) for f in formats}, "string")
    keys = "array_join(array_sort(json_object_keys(to_json(v))), ', ')"
    unknown = F.expr(f"concat('no known layout; keys: ', {keys})")
    error = F.when(F.col("format").isNull(), unknown).otherwise(complaint)
    converted = F.col("messages").isNotNull() | F.col("text").isNotNull()
    out = out.withColumn("error", F.when(~converted, error)).drop("v", "default_system")
    return apply_error_policy(out, on_error)


def apply_error_policy(normalized: DataFrame, on_error: str) -> DataFrame:
    ok = F.col("error").isNull()
    if on_error == "quarantine":
        return normalized
    if on_error == "skip":
        return normalized.filter(ok)
    if on_error == "raise":
        return normalized.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.col("error"))))
    raise ValueError("on_error must be 'raise', 'skip' or 'quarantine'")


def turns(normalized: DataFrame, *keys: str) -> DataFrame:
    """Long form: one row per message, numbered from 0."""
    return normalized.select(*keys, F.posexplode("messages").alias("turn", "m")).select(
        *keys, F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content"
    )


def status(normalized: DataFrame, usable: Column, blank: Column | None = None) -> Column:
    """Why a record was kept or dropped: ``ok``, ``unusable``, ``blank`` or ``malformed``."""
    blank = is_blank(F.col("text")) if blank is None else blank
    return (
        F.when(F.col("error").isNotNull(), "malformed")
        .when(F.col("messages").isNotNull() & ~usable, "unusable")
        .when(F.col("text").isNotNull() & blank, "blank")
        .otherwise("ok")
    )
