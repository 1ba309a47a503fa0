"""Chat templates as column builders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ChatML turn markers.
TURN_OPEN = "<|im_start|>"
TURN_CLOSE = "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """How a conversation becomes one string.

    ``render`` takes the messages column. ``reply_header`` opens the assistant
    turn the model is asked to complete.
    """

    name: str
    render: Callable[[Column], Column]
    reply_header: str


def _chatml(messages: Column) -> Column:
    def turn(m: Column) -> Column:
        return F.concat(
            F.lit(TURN_OPEN), m["role"], F.lit("\n"), m["content"], F.lit(TURN_CLOSE + "\n")
        )

    return F.array_join(F.transform(messages, turn), "")


def _role_prefix(messages: Column) -> Column:
    lines = F.transform(messages, lambda m: F.concat_ws(": ", m["role"], m["content"]))
    return F.array_join(lines, "\n")


CHATML = Template("chatml", _chatml, f"{TURN_OPEN}assistant\n")
ROLE_PREFIX = Template("role_prefix", _role_prefix, "\nassistant: ")
