"""Turn the shared tables into the inputs the operators take.

Each adapter is a deterministic formula, repeated in the checking SQL. Whole
tables are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.functions.text import PY_WS
from turnmill.operators.conversations import collect_turns
from turnmill.session import configure
from turnmill.sources.records import parse_lines

LAYOUTS = ("openai", "sharegpt", "alpaca", "chatml", "prompt", "text")
SHAREGPT_NAMES = {"user": "human", "assistant": "gpt", "system": "system"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, turn, role, content``."""
    return table(spark, sf_dir, "conversations").withColumnRenamed("text", "content")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, messages``."""
    return collect_turns(turns(spark, sf_dir), "conv_id")


def _nth(role: str, n: int = 0) -> str:
    return f"get(filter(messages, m -> m.role = '{role}'), {n}).content"


def joined(role: str, first: int = 1) -> str:
    """The texts of a role's turns, from the ``first`` on; null if it has no turn."""
    own = f"filter(messages, m -> m.role = '{role}')"
    texts = f"transform(slice({own}, {first}, size({own})), m -> m.content)"
    return f"CASE WHEN size({own}) > 0 THEN array_join({texts}, '\\n') END"


# The JSON fields that hold a conversation in each layout, as SQL over `messages`.
_NAMED = " ".join(f"WHEN '{role}' THEN '{name}'" for role, name in SHAREGPT_NAMES.items())
LAYOUT_FIELDS = {
    "openai": {"messages": "messages"},
    "sharegpt": {
        "conversations": f"""transform(messages, m ->
            named_struct('from', CASE m.role {_NAMED} END, 'value', m.content))"""
    },
    "alpaca": {
        "instruction": _nth("user"),
        "input": f"coalesce({joined('user', 2)}, '')",
        "output": joined("assistant"),
        "system": joined("system"),
    },
    "chatml": {
        "text": """array_join(transform(messages, m ->
            concat('<|im_start|>', m.role, '\\n', m.content, '<|im_end|>\\n')), '')"""
    },
    "prompt": {
        "prompt": joined("user"),
        "completion": f"CASE WHEN conv_id % 12 <> 10 THEN {joined('assistant')} END",
        "response": f"CASE WHEN conv_id % 12 = 10 THEN {joined('assistant')} END",
        "system": joined("system"),
    },
    "text": {"text": "array_join(transform(messages, m -> m.content), '\\n')"},
}


def records_in(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """Every conversation as one JSON record of ``layout``: ``conv_id, raw``."""
    pairs = ", ".join(f"'{name}', {value}" for name, value in LAYOUT_FIELDS[layout].items())
    return conversations(spark, sf_dir).selectExpr("conv_id", f"to_json(named_struct({pairs})) AS raw")


def mixed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in the layout ``conv_id % 6`` names, one column per field.

    Every 25th record lacks the fields that identify its layout.
    """
    fields: dict[str, str] = {}
    for number, layout in enumerate(LAYOUTS):
        for name, value in LAYOUT_FIELDS[layout].items():
            branch = f"WHEN conv_id % 25 <> 7 AND conv_id % {len(LAYOUTS)} = {number} THEN {value}"
            fields[name] = f"{fields.get(name, '')} {branch}"
    kept = [f"CASE {branches} END AS {name}" for name, branches in fields.items()]
    return conversations(spark, sf_dir).selectExpr("conv_id", "'x' AS note", *kept)


def mixed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, raw`` over :func:`mixed_fields`."""
    fields = mixed_fields(spark, sf_dir)
    names = [c for c in fields.columns if c != "conv_id"]
    return fields.select("conv_id", F.to_json(F.struct(*names)).alias("raw"))


def parsed(records: DataFrame) -> DataFrame:
    return parse_lines(records).filter(F.col("problem").isNull()).drop("problem")


# SQL pieces -----------------------------------------------------------------

WS = "'" + PY_WS + "'"


def sql_strip(text: str) -> str:
    return f"trim({text}, {WS})"


# One row per conversation with the parts the layouts are made of.
SQL_CONV = f"""
conv AS (
  SELECT conv_id,
         list(text ORDER BY turn) FILTER (role = 'user') AS users,
         list(text ORDER BY turn) FILTER (role = 'assistant') AS replies,
         list(text ORDER BY turn) FILTER (role = 'system') AS systems,
         string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'user') AS asked,
         string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS told,
         string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS ruled,
         string_agg(text, chr(10) ORDER BY turn) AS plain,
         string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), ''
                    ORDER BY turn) AS chat,
         string_agg('<|im_start|>' || role || chr(10) || {sql_strip('text')} || '<|im_end|>' || chr(10), ''
                    ORDER BY turn) AS chat_stripped,
         bool_or(role = 'user')
           AND bool_or(role = 'assistant' AND {sql_strip('text')} <> '') AS usable
  FROM conversations GROUP BY conv_id)"""

SQL_LAYOUT = """CASE conv_id % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'sharegpt' WHEN 2 THEN 'alpaca'
  WHEN 3 THEN 'chatml' WHEN 4 THEN 'prompt' ELSE 'text' END"""

# The messages every layout is expected to give: conv_id, turn, role, content.
SQL_ALL_TURNS = """
all_turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, text AS content
  FROM conversations)"""

SQL_ALPACA = f"""
alpaca_parts AS (
  SELECT conv_id, {sql_strip("coalesce(users[1], '')")} AS task, {sql_strip("coalesce(array_to_string(users[2:], chr(10)), '')")} AS extra,
         {sql_strip("coalesce(told, '')")} AS reply, {sql_strip("coalesce(ruled, '')")} AS sys
  FROM conv WHERE {sql_strip("coalesce(users[1], '')")} <> ''),
alpaca_turns AS (
  SELECT conv_id, 0 AS turn, 'system' AS role, sys AS content FROM alpaca_parts WHERE sys <> ''
  UNION ALL
  SELECT conv_id, CASE WHEN sys <> '' THEN 1 ELSE 0 END, 'user',
         CASE WHEN extra = '' THEN task ELSE task || chr(10) || chr(10) || extra END FROM alpaca_parts
  UNION ALL
  SELECT conv_id, CASE WHEN sys <> '' THEN 2 ELSE 1 END, 'assistant', reply FROM alpaca_parts)"""

SQL_PROMPT = f"""
prompt_parts AS (
  SELECT conv_id, {sql_strip("coalesce(asked, '')")} AS task, {sql_strip("coalesce(told, '')")} AS reply,
         {sql_strip("coalesce(ruled, '')")} AS sys
  FROM conv WHERE {sql_strip("coalesce(asked, '')")} <> ''),
prompt_turns AS (
  SELECT conv_id, 0 AS turn, 'system' AS role, sys AS content FROM prompt_parts WHERE sys <> ''
  UNION ALL SELECT conv_id, CASE WHEN sys <> '' THEN 1 ELSE 0 END, 'user', task FROM prompt_parts
  UNION ALL SELECT conv_id, CASE WHEN sys <> '' THEN 2 ELSE 1 END, 'assistant', reply FROM prompt_parts)"""

# What auto detection says about each mixed record; NULL for malformed ones.
# Absent JSON fields decide: a conversation without a user has no 'instruction'.
SQL_DETECTED = f"""
detected AS (
  SELECT conv_id, usable,
    CASE WHEN conv_id % 25 = 7 THEN NULL
         WHEN conv_id % 6 = 2 AND users[1] IS NULL THEN NULL
         WHEN conv_id % 6 = 4 AND (users[1] IS NULL OR replies[1] IS NULL) THEN NULL
         ELSE {SQL_LAYOUT} END AS format
  FROM conv)"""

SQL_MIXED = f"""
WITH {SQL_CONV}, {SQL_ALL_TURNS}, {SQL_ALPACA}, {SQL_PROMPT}, {SQL_DETECTED},
mixed_turns AS (
  SELECT d.conv_id, d.format, t.turn, t.role,
         CASE WHEN d.format = 'chatml' THEN {sql_strip('t.content')} ELSE t.content END AS content
  FROM detected d JOIN all_turns t USING (conv_id) WHERE d.format IN ('openai', 'sharegpt', 'chatml')
  UNION ALL
  SELECT d.conv_id, d.format, t.turn, t.role, t.content
  FROM detected d JOIN alpaca_turns t USING (conv_id) WHERE d.format = 'alpaca'
  UNION ALL
  SELECT d.conv_id, d.format, t.turn, t.role, t.content
  FROM detected d JOIN prompt_turns t USING (conv_id) WHERE d.format = 'prompt'),
mixed_text AS (
  SELECT d.conv_id, d.format, c.plain AS text FROM detected d JOIN conv c USING (conv_id)
  WHERE d.format = 'text'),
mixed_status AS (
  SELECT conv_id, format,
    CASE WHEN bool_or(role = 'user') AND bool_or(role = 'assistant' AND {sql_strip('content')} <> '')
         THEN 'ok' ELSE 'unusable' END AS status
  FROM mixed_turns GROUP BY conv_id, format
  UNION ALL
  SELECT conv_id, format, CASE WHEN {sql_strip('text')} = '' THEN 'blank' ELSE 'ok' END FROM mixed_text
  UNION ALL
  SELECT d.conv_id, coalesce(d.format, 'unknown'), 'malformed' FROM detected d
  WHERE d.conv_id NOT IN (SELECT conv_id FROM mixed_turns UNION ALL SELECT conv_id FROM mixed_text)),
mixed_rendered AS (
  SELECT conv_id, format,
    string_agg('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
  FROM mixed_turns JOIN mixed_status s USING (conv_id, format) WHERE s.status = 'ok'
  GROUP BY conv_id, format
  UNION ALL
  SELECT conv_id, format, text FROM mixed_text WHERE {sql_strip('text')} <> '')
"""
