"""Columns over ``ARRAY<STRUCT<role, content>>`` conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnmill.functions import sql
from turnmill.functions.text import is_blank

MESSAGES_TYPE = "array<struct<role:string,content:string>>"

# The speaker names found in public chat dumps, by canonical role.
ROLE_ALIASES = {
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
    "bot": "assistant",
    "chatgpt": "assistant",
    "bard": "assistant",
    "bing": "assistant",
    "system": "system",
    "tool": "tool",
    "function": "tool",
    "observation": "tool",
}
FALLBACK_ROLE = "user"


def canonical_role(name: str) -> str:
    """SQL for the canonical role of any speaker name; unknown and null give ``user``."""
    targets = list(dict.fromkeys(ROLE_ALIASES.values()))
    branches = " ".join(
        f"WHEN r IN ({', '.join(repr(a) for a, role in ROLE_ALIASES.items() if role == target)}) THEN '{target}'"
        for target in targets
    )
    cleaned = f"lower({sql.strip_short(name)})"
    mapped = sql.bind("r", cleaned, f"CASE {branches} ELSE '{FALLBACK_ROLE}' END")
    # Names that are canonical already are the common case.
    return f"CASE WHEN {name} IN ({', '.join(map(repr, targets))}) THEN {name} ELSE {mapped} END"


def message(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def is_usable(messages: Column) -> Column:
    """At least one user turn and one assistant turn that says something."""
    asked = F.exists(messages, lambda m: m["role"] == "user")
    answered = F.exists(
        messages, lambda m: (m["role"] == "assistant") & ~is_blank(m["content"])
    )
    return asked & answered


def with_system(messages: Column, prompt: str | None) -> Column:
    """Put ``prompt`` in front unless the conversation opens with a system turn."""
    if not prompt:
        return messages
    opens_with_system = F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))
    opened = F.array_prepend(messages, message("system", F.lit(prompt)))
    return F.when(opens_with_system, messages).otherwise(opened)
