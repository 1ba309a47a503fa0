"""Which records are usable, and how they become training or inference text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions.messages import is_usable, with_system
from turnmill.functions.templates import Template
from turnmill.functions.text import is_blank
from turnmill.operators.staging import with_computed


def collect_turns(turns: DataFrame, *keys: str) -> DataFrame:
    """Long form to one row per conversation, turns in order.

    The result row *is* the conversation, so its size is that of one record.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return turns.groupBy(*keys).agg(
        F.transform(
            ordered, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))
        ).alias("messages")
    )


def usable_conversations(turns: DataFrame, *keys: str) -> DataFrame:
    """The usability test on the long form, as two mergeable flags per conversation."""
    asked = F.bool_or(F.col("role") == "user")
    answered = F.bool_or((F.col("role") == "assistant") & ~is_blank(F.col("content")))
    return turns.groupBy(*keys).agg((asked & answered).alias("usable"))


def inject_system(turns: DataFrame, prompt: str, *keys: str) -> DataFrame:
    """Add a turn ``-1`` to every conversation that does not open with ``system``.

    The turns themselves are not shuffled; only one (turn, role) pair per
    conversation is.
    """
    opening = turns.groupBy(*keys).agg(F.min_by("role", "turn").alias("role"))
    added = opening.filter(~F.coalesce(F.col("role") == "system", F.lit(False))).select(
        *keys,
        F.lit(-1).cast("bigint").alias("turn"),
        F.lit("system").alias("role"),
        F.lit(prompt).alias("content"),
    )
    return turns.select(*keys, "turn", "role", "content").unionByName(added)


def with_rendered(normalized: DataFrame, template: Template | None) -> DataFrame:
    """Replace ``messages`` and ``error`` by the training text in ``text``: chat through
    ``template``, text verbatim, null for records that are not usable or blank.

    Without a template the job fails on the first usable conversation.
    """
    is_chat = F.col("messages").isNotNull()
    if template is None:
        missing = F.raise_error(F.lit("chat records need a template; none was given"))
        chat_text = missing.cast("string")
    else:
        chat_text = template.render(F.col("messages"))
    text = F.when(is_chat, F.when(is_usable(F.col("messages")), chat_text)).otherwise(F.col("text"))
    rendered = with_computed(normalized, text=text).drop("messages", "error")
    return rendered.withColumn("text", F.when(~is_blank(F.col("text")), F.col("text")))


def render(normalized: DataFrame, template: Template | None) -> DataFrame:
    """Usable records as training text; chat through ``template``, text verbatim.

    Without a template the job fails on the first usable conversation.
    """
    is_chat = F.col("messages").isNotNull()
    usable = normalized.filter(F.when(is_chat, is_usable(F.col("messages"))).otherwise(F.col("text").isNotNull()))
    return with_rendered(usable, template).filter(F.col("text").isNotNull())


def inference_prompts(
    conversations: DataFrame, template: Template, system_prompt: str | None = None
) -> DataFrame:
    """The text a model is asked to continue: system turn, history, reply header."""
    history = template.render(with_system(F.col("messages"), system_prompt))
    return conversations.withColumn(
        "prompt", F.concat(history, F.lit(template.reply_header))
    ).drop("messages")
