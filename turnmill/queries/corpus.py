"""Normalising, filtering and rendering conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.functions import sql
from turnmill.functions.json import content_text, field
from turnmill.functions.messages import canonical_role, is_usable
from turnmill.functions.templates import CHATML, ROLE_PREFIX
from turnmill.operators import conversations as ops
from turnmill.operators.formats import normalize, status, with_format
from turnmill.operators.formats import turns as long_turns
from turnmill.operators.split import seeded_split
from turnmill.plans.prepare import dataset_report, head_sample, prepare
from turnmill.queries import adapters as a
from turnmill.queries.adapters import sql_strip
from turnmill.sources.records import parse_lines

SYSTEM_PROMPT = "Answer in one paragraph."
# Fewer than the usable conversations of any table.
SAMPLE = 5


def _rendered(spark, sf_dir, template) -> DataFrame:
    unified = a.conversations(spark, sf_dir).withColumns(
        {"text": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}
    )
    return ops.render(unified, template).select("conv_id", "text")


def _inference_prompt(spark, sf_dir) -> DataFrame:
    return ops.inference_prompts(a.conversations(spark, sf_dir), CHATML, SYSTEM_PROMPT)


def _usable(spark, sf_dir) -> DataFrame:
    return ops.usable_conversations(a.turns(spark, sf_dir), "conv_id")


def _mixed(spark, sf_dir, on_error="skip") -> DataFrame:
    return normalize(a.parsed(a.mixed_records(spark, sf_dir)), on_error=on_error)


def _normalize_chat(layout):
    def query(spark, sf_dir) -> DataFrame:
        records = a.parsed(a.records_in(spark, sf_dir, layout))
        return long_turns(normalize(records, layout, on_error="skip"), "conv_id")

    return query


def _normalize_text(spark, sf_dir) -> DataFrame:
    records = a.parsed(a.records_in(spark, sf_dir, "text"))
    return normalize(records, "text", on_error="skip").select("conv_id", "text")


def _normalize_mixed(spark, sf_dir) -> DataFrame:
    unified = _mixed(spark, sf_dir)
    return unified.select(
        "conv_id", "format", "text", F.posexplode_outer("messages").alias("turn", "m")
    ).select("conv_id", "format", F.col("turn").cast("bigint"), "m.role", "m.content", "text")


def _detect_formats(spark, sf_dir) -> DataFrame:
    return with_format(a.parsed(a.mixed_records(spark, sf_dir))).select("conv_id", "format")


def _format_counts(spark, sf_dir) -> DataFrame:
    unified = _mixed(spark, sf_dir, "quarantine")
    fate = status(unified, is_usable(F.col("messages")))
    labelled = unified.select(
        F.coalesce("format", F.lit("unknown")).alias("format"), fate.alias("status")
    )
    return labelled.groupBy("format", "status").agg(F.count(F.lit(1)).alias("n"))


def _normalize_quarantine(spark, sf_dir) -> DataFrame:
    cut = F.col("conv_id") % 25 == 8
    short = F.expr("substring(raw, 1, length(raw) - 1)")
    raw = a.mixed_records(spark, sf_dir).withColumn("raw", F.when(cut, short).otherwise(F.col("raw")))
    unified = normalize(parse_lines(raw), on_error="quarantine")
    reason = F.coalesce("problem", "error")
    return unified.filter(reason.isNotNull()).select("conv_id", reason.alias("error"))


def _canonical_roles(spark, sf_dir) -> DataFrame:
    spelled = """CASE role
        WHEN 'user' THEN element_at(array(' Human\\t', 'USER', 'someone'), CAST(turn % 3 + 1 AS INT))
        WHEN 'assistant' THEN element_at(array('GPT', ' bot', ' Bard'), CAST(turn % 3 + 1 AS INT))
        ELSE upper(role) END"""
    return a.turns(spark, sf_dir).select(
        "conv_id", "turn", F.expr(canonical_role(spelled)).alias("role")
    )


def _stringify_content(spark, sf_dir) -> DataFrame:
    """Each conversation as one content list: objects, bare strings, and parts to ignore."""
    raw = """concat('{"content":[{"type":"image"},', array_join(transform(messages, (m, i) ->
        CASE WHEN i % 2 = 0 THEN to_json(named_struct('type', 'text', 'text', m.content))
             ELSE substr(to_json(array(m.content)), 2, length(to_json(array(m.content))) - 2) END), ','),
        ',5,null]}')"""
    records = a.conversations(spark, sf_dir).select("conv_id", F.expr(raw).alias("raw"))
    return a.parsed(records).select(
        "conv_id", F.expr(content_text(field("v", "content"))).alias("content")
    )


def _split_exact(spark, sf_dir) -> DataFrame:
    ids = _usable(spark, sf_dir).filter("usable").select("conv_id")
    return seeded_split(ids, "conv_id", ratio=0.05, seed=42)


def _prepared(spark, sf_dir) -> DataFrame:
    records = a.parsed(a.mixed_records(spark, sf_dir)).drop("raw")
    return prepare(records, "conv_id", on_error="skip").select("conv_id", "format", "text", "split")


def _head_sample(spark, sf_dir) -> DataFrame:
    # Ids are enough to find the sample; only its turns are collected.
    turns = a.turns(spark, sf_dir)
    usable = ops.usable_conversations(turns, "conv_id").filter("usable")
    chosen = head_sample(usable.select(F.lit("conversations").alias("file"), F.col("conv_id").alias("ordinal")), SAMPLE)
    chosen = chosen.select(F.col("ordinal").alias("conv_id"))
    sampled = ops.collect_turns(turns.join(chosen, "conv_id", "left_semi"), "conv_id")
    return sampled.select("conv_id", CHATML.render(F.col("messages")).alias("text"))


# A JSON string of a SQL text, and the question and answer the edge cases are made of.
_JSON = "substr(to_json(array({0})), 2, length(to_json(array({0}))) - 2)"
_ASKED, _TOLD = (f"coalesce({a.joined(r)}, 'none')" for r in ("user", "assistant"))
_EDGES = (
    '{"messages":[{"role":" Human","content":[{"type":"text","text":$u},"tail",{"type":"image"},7]},{"role":"GPT","content":$r}]}',
    '{"messages":[{"role":"user","content":null},{"role":"bot","content":12},{"role":"user","content":true},{"role":"user","content":[]}]}',
    '{"conversations":[{"from":"human","value":$u},{"from":"gpt","value":$r}],"system_prompt":" be brief "}',
    '{"conversations":[{"from":"human","value":$u},{"from":"gpt"}],"system":"","system_prompt":"short"}',
    '{"instruction":$u,"output":$r}',
    '{"instruction":$u,"input":"  ","output":7,"system":"own"}',
    '{"prompt":$u,"completion":null,"response":$r,"system":" sys "}',
    '{"prompt":$u,"completion":"","response":$r}',
    '{"text":"  ","other":$u}',
    '{"messages":"no list","x":$r}',
    '{"instruction":" ","output":$r}',
    '{"messages":[1],"text":$u}',
)


def _normalize_edges(spark, sf_dir) -> DataFrame:
    """Every conversation as one of a dozen awkward records."""
    texts = {"u": _JSON.format(_ASKED), "r": _JSON.format(_TOLD)}
    raw = "CASE "
    for number, edge in enumerate(_EDGES):
        parts = edge.replace("$u", "\0u\0").replace("$r", "\0r\0").split("\0")
        raw += f"WHEN conv_id % {len(_EDGES)} = {number} THEN concat({', '.join(texts.get(p) or sql.literal(p) for p in parts)}) "
    records = a.conversations(spark, sf_dir).selectExpr("conv_id", f"{raw} END AS raw")
    unified = normalize(a.parsed(records), default_system="be kind", on_error="quarantine")
    flat = unified.select("conv_id", "format", "text", "error", F.posexplode_outer("messages").alias("turn", "m"))
    return flat.select("conv_id", "format", F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content", "text", "error")


def _edges_sql() -> str:
    n = len(_EDGES)
    own = sql_strip
    chat = [
        (0, "openai", 0, "'user'", "u || chr(10) || 'tail'"), (0, "openai", 1, "'assistant'", "r"),
        (1, "openai", 0, "'user'", "''"), (1, "openai", 1, "'assistant'", "'12'"), (1, "openai", 2, "'user'", "'True'"), (1, "openai", 3, "'user'", "''"),
        (2, "sharegpt", 0, "'system'", "'be brief'"), (2, "sharegpt", 1, "'user'", "u"), (2, "sharegpt", 2, "'assistant'", "r"),
        (3, "sharegpt", 0, "'system'", "'short'"), (3, "sharegpt", 1, "'user'", "u"), (3, "sharegpt", 2, "'assistant'", "''"),
        (4, "alpaca", 0, "'system'", "'be kind'"), (4, "alpaca", 1, "'user'", own("u")), (4, "alpaca", 2, "'assistant'", own("r")),
        (5, "alpaca", 0, "'system'", "'own'"), (5, "alpaca", 1, "'user'", own("u")), (5, "alpaca", 2, "'assistant'", "'7'"),
        (6, "prompt", 0, "'system'", "'sys'"), (6, "prompt", 1, "'user'", own("u")), (6, "prompt", 2, "'assistant'", own("r")),
        (7, "prompt", 0, "'user'", own("u")), (7, "prompt", 1, "'assistant'", "''"),
    ]
    rows = [
        f"SELECT conv_id, '{f}' AS format, {t} AS turn, {role} AS role, {content} AS content, NULL AS text, NULL AS error FROM e WHERE k = {k}"
        for k, f, t, role, content in chat
    ]
    other = [
        (8, "'text'", "'  '", "NULL"), (9, "NULL", "NULL", "'no known layout; keys: messages, x'"),
        (10, "'alpaca'", "NULL", "chr(39) || 'instruction' || chr(39) || ' is empty'"),
        (11, "'openai'", "NULL", "chr(39) || 'messages' || chr(39) || ' must be a list of objects'"),
    ]
    rows += [f"SELECT conv_id, {f}, NULL, NULL, NULL, {text}, {error} FROM e WHERE k = {k}" for k, f, text, error in other]
    return f"""WITH {a.SQL_CONV},
        e AS (SELECT conv_id, conv_id % {n} AS k, coalesce(asked, 'none') AS u, coalesce(told, 'none') AS r FROM conv)
        SELECT conv_id, format, CAST(turn AS BIGINT) AS turn, role, content, text, error FROM ({' UNION ALL '.join(rows)})"""


QUERIES = {
    "normalize_edges": _normalize_edges,
    "render_chatml": lambda s, d: _rendered(s, d, CHATML),
    "render_role_prefix": lambda s, d: _rendered(s, d, ROLE_PREFIX),
    "inference_prompt": _inference_prompt,
    "inject_system": lambda s, d: ops.inject_system(a.turns(s, d), SYSTEM_PROMPT, "conv_id"),
    "usable_conversations": _usable,
    "detect_formats": _detect_formats,
    "format_counts": _format_counts,
    "normalize_openai": _normalize_chat("openai"),
    "normalize_sharegpt": _normalize_chat("sharegpt"),
    "normalize_alpaca": _normalize_chat("alpaca"),
    "normalize_chatml": _normalize_chat("chatml"),
    "normalize_prompt": _normalize_chat("prompt"),
    "normalize_text": _normalize_text,
    "normalize_mixed": _normalize_mixed,
    "normalize_quarantine": _normalize_quarantine,
    "canonical_roles": _canonical_roles,
    "stringify_content": _stringify_content,
    "dataset_report": lambda s, d: dataset_report(_mixed(s, d, "quarantine")),
    "split_exact": _split_exact,
    "prepared_dataset": _prepared,
    "head_sample": _head_sample,
}

_USABLE = f"bool_or(role = 'user') AND bool_or(role = 'assistant' AND {sql_strip('text')} <> '')"
_TURN_COLUMNS = "conv_id, CAST(turn AS BIGINT) AS turn, role, content"

ORACLES = {
    "normalize_edges": _edges_sql(),
    "render_chatml": f"WITH {a.SQL_CONV} SELECT conv_id, chat AS text FROM conv WHERE usable",
    "render_role_prefix": f"""
        SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text
        FROM conversations GROUP BY conv_id HAVING {_USABLE}""",
    "inference_prompt": f"""
        WITH {a.SQL_CONV},
        opening AS (SELECT conv_id, arg_min(role, turn) AS role FROM conversations GROUP BY conv_id)
        SELECT conv_id,
          CASE WHEN o.role = 'system' THEN '' ELSE
            '<|im_start|>system' || chr(10) || '{SYSTEM_PROMPT}<|im_end|>' || chr(10) END
          || chat || '<|im_start|>assistant' || chr(10) AS prompt
        FROM conv JOIN opening o USING (conv_id)""",
    "inject_system": f"""
        SELECT conv_id, turn, role, text AS content FROM conversations
        UNION ALL
        SELECT conv_id, CAST(-1 AS BIGINT), 'system', '{SYSTEM_PROMPT}'
        FROM conversations GROUP BY conv_id HAVING arg_min(role, turn) <> 'system'""",
    "usable_conversations": f"SELECT conv_id, {_USABLE} AS usable FROM conversations GROUP BY conv_id",
    "detect_formats": f"WITH {a.SQL_CONV}, {a.SQL_DETECTED} SELECT conv_id, format FROM detected",
    "format_counts": a.SQL_MIXED + """
        SELECT format, status, CAST(count(*) AS BIGINT) AS n FROM mixed_status GROUP BY format, status""",
    "normalize_openai": f"WITH {a.SQL_ALL_TURNS} SELECT {_TURN_COLUMNS} FROM all_turns",
    "normalize_sharegpt": f"WITH {a.SQL_ALL_TURNS} SELECT {_TURN_COLUMNS} FROM all_turns",
    "normalize_alpaca": f"WITH {a.SQL_CONV}, {a.SQL_ALPACA} SELECT {_TURN_COLUMNS} FROM alpaca_turns",
    "normalize_chatml": f"""
        WITH {a.SQL_ALL_TURNS}
        SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, {sql_strip('content')} AS content FROM all_turns""",
    "normalize_prompt": f"WITH {a.SQL_CONV}, {a.SQL_PROMPT} SELECT {_TURN_COLUMNS} FROM prompt_turns",
    "normalize_text": f"WITH {a.SQL_CONV} SELECT conv_id, plain AS text FROM conv",
    "normalize_mixed": a.SQL_MIXED + """
        SELECT conv_id, format, CAST(turn AS BIGINT) AS turn, role, content, CAST(NULL AS VARCHAR) AS text
        FROM mixed_turns
        UNION ALL SELECT conv_id, format, NULL, NULL, NULL, text FROM mixed_text""",
    "normalize_quarantine": f"""
        WITH {a.SQL_CONV}, {a.SQL_DETECTED}
        SELECT conv_id,
          CASE WHEN conv_id % 25 = 8 THEN 'invalid JSON'
               ELSE 'no known layout; keys: ' ||
                 CASE WHEN conv_id % 25 = 7 THEN 'note'
                      WHEN conv_id % 6 = 2 THEN concat_ws(', ', 'input', 'note',
                        CASE WHEN len(replies) > 0 THEN 'output' END, CASE WHEN len(systems) > 0 THEN 'system' END)
                      ELSE concat_ws(', ', CASE WHEN len(replies) > 0 AND conv_id % 12 <> 10 THEN 'completion' END,
                        'note', CASE WHEN len(users) > 0 THEN 'prompt' END,
                        CASE WHEN len(replies) > 0 AND conv_id % 12 = 10 THEN 'response' END,
                        CASE WHEN len(systems) > 0 THEN 'system' END) END
          END AS error
        FROM detected JOIN conv USING (conv_id)
        WHERE format IS NULL OR conv_id % 25 = 8""",
    "canonical_roles": """
        SELECT conv_id, turn, role FROM conversations""",
    "stringify_content": f"WITH {a.SQL_CONV} SELECT conv_id, plain AS content FROM conv",
    "dataset_report": a.SQL_MIXED + """
        SELECT format, status, CAST(count(*) AS BIGINT) AS n FROM mixed_status GROUP BY ROLLUP (format, status)""",
    "split_exact": f"""
        WITH {a.SQL_CONV}, u AS (SELECT conv_id FROM conv WHERE usable),
        ranked AS (
          SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS place,
                 count(*) OVER () AS n FROM u)
        SELECT conv_id, CASE WHEN n >= 10 AND place <= ceil(0.05::DOUBLE * n) THEN 'eval' ELSE 'train' END AS split
        FROM ranked""",
    "prepared_dataset": a.SQL_MIXED + """,
        ranked AS (
          SELECT conv_id, format, text, row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) AS place,
                 count(*) OVER () AS n FROM mixed_rendered)
        SELECT conv_id, format, text,
          CASE WHEN n >= 10 AND place <= ceil(0.05::DOUBLE * n) THEN 'eval' ELSE 'train' END AS split
        FROM ranked""",
    "head_sample": f"WITH {a.SQL_CONV} SELECT conv_id, chat AS text FROM conv WHERE usable ORDER BY conv_id LIMIT {SAMPLE}",
}
