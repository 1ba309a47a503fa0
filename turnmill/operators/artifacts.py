"""What a store of models holds and what is wrong with it.

Inputs are plain tables, normally made by ``sources.model_files``:
``files`` (model, rel_path, size), ``tensors`` (model, shard, tensor, dtype,
shape, issue), and ``configs``/``indexes`` (model, raw JSON text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.functions import sql
from turnmill.functions.json import parse_strict, string_or_null
from turnmill.functions.text import human_bytes
from turnmill.operators.staging import with_computed
from turnmill.sources.model_files import is_weights

# The files a usable model needs.
REQUIRED_FILES = ("config.json",)
TOKENIZER_FILES = ("tokenizer.json", "tokenizer_config.json", "tokenizer.model")
REPORTED_SUFFIXES = (".safetensors", ".json", ".txt", ".model")


def parameter_count(shape: Column) -> Column:
    """Product of the dimensions; a scalar or an absent shape counts as 1."""
    one = F.lit(1).cast("decimal(38,0)")
    product = F.aggregate(shape, one, lambda total, dim: (total * dim).cast("decimal(38,0)"))
    return F.coalesce(product, one)


def dtype_breakdown(tensors: DataFrame) -> DataFrame:
    """Parameters per model and dtype with their share of the model, in percent."""
    counted = tensors.filter(F.col("tensor").isNotNull()).groupBy("model", "dtype").agg(
        F.sum(parameter_count(F.col("shape"))).cast("decimal(38,0)").alias("parameters")
    )
    # One row per dtype is left by now, so a model's window is a handful of rows.
    total = F.sum("parameters").over(W.partitionBy("model"))
    share = F.col("parameters").cast("double") / F.greatest(total.cast("double"), F.lit(1.0)) * 100
    return counted.withColumn("share_pct", share)


def parameter_totals(tensors: DataFrame) -> DataFrame:
    return tensors.filter(F.col("tensor").isNotNull()).groupBy("model").agg(
        F.sum(parameter_count(F.col("shape"))).cast("decimal(38,0)").alias("parameters")
    )


def _is_reported() -> Column:
    return F.lower("rel_path").rlike(r"\.(%s)$" % "|".join(s[1:] for s in REPORTED_SUFFIXES))


def file_inventory(files: DataFrame) -> DataFrame:
    """Every reported file with its size, and a total row per model (null path)."""
    reported = files.filter(_is_reported()).select("model", "rel_path", "size")
    totals = reported.groupBy("model").agg(F.sum("size").alias("size")).select(
        "model", F.lit(None).cast("string").alias("rel_path"), "size"
    )
    return reported.unionByName(totals).withColumn("readable", human_bytes(F.col("size")))


def _parsed(documents: DataFrame) -> DataFrame:
    """``model, v``; ``v`` is null for text that is not one JSON object."""
    stripped = documents.withColumn("raw", F.expr(sql.strip("raw")))
    value = f"CASE WHEN startswith(raw, '{{') THEN {parse_strict('raw')} END"
    return with_computed(stripped, v=F.expr(value)).select("model", "v")


def indexed_shards(indexes: DataFrame) -> DataFrame:
    """Distinct shard names each model's index refers to."""
    weight_map = F.try_variant_get("v", "$.weight_map", "map<string,string>")
    return (
        _parsed(indexes)
        .select("model", F.explode(F.map_values(weight_map)).alias("shard"))
        .distinct()
    )


def missing_shards(indexes: DataFrame, files: DataFrame) -> DataFrame:
    """Shards named by an index that are not on disk."""
    present = files.select("model", F.col("rel_path").alias("shard"))
    return indexed_shards(indexes).join(present, ["model", "shard"], "left_anti")


def model_problems(models: DataFrame, files: DataFrame, indexes: DataFrame) -> DataFrame:
    """One row per model and problem; a healthy model has no row.

    The weights are complete when the index names at least one shard and all are
    there, or when there is no index and at least one weight file.
    """
    at_top = ~F.contains("rel_path", F.lit("/"))
    has = files.groupBy("model").agg(
        *(F.bool_or(F.col("rel_path") == name).alias(name.replace(".", "_")) for name in REQUIRED_FILES),
        F.bool_or(F.col("rel_path").isin(*TOKENIZER_FILES)).alias("tokenizer"),
        F.bool_or(at_top & is_weights(F.col("rel_path"))).alias("weights"),
    )
    indexed = indexes.select("model").distinct().withColumn("indexed", F.lit(True))
    named = indexed_shards(indexes).groupBy("model").agg(F.count(F.lit(1)).alias("named"))
    absent = missing_shards(indexes, files).groupBy("model").agg(F.count(F.lit(1)).alias("absent"))
    facts = models.select("model")
    for part in (has, indexed, named, absent):
        facts = facts.join(part, "model", "left")

    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    shards_ok = (F.coalesce("named", F.lit(0)) > 0) & (F.coalesce("absent", F.lit(0)) == 0)
    complete = F.when(flag("indexed"), shards_ok).otherwise(flag("weights"))
    found = F.array(
        *(
            F.when(~flag(name.replace(".", "_")), f"required file {name} is missing")
            for name in REQUIRED_FILES
        ),
        F.when(~flag("tokenizer"), "no tokenizer file"),
        F.when(~complete, "weight shards are missing or incomplete"),
    )
    return facts.select("model", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def _findings(models: DataFrame, files: DataFrame, tensors: DataFrame, indexes: DataFrame, config: DataFrame) -> DataFrame:
    """``model, disk_bytes, parameters, issues`` beside the columns of ``config``, among
    them ``config_ok``. Each table is aggregated once; ``issues`` is a sorted array."""
    at_top = ~F.contains("rel_path", F.lit("/"))
    held = files.groupBy("model").agg(
        F.bool_or(at_top & is_weights(F.col("rel_path"))).alias("weights"),
        F.sum(F.when(_is_reported(), F.col("size"))).alias("disk_bytes"),
    )
    found = F.when(F.col("tensor").isNotNull(), parameter_count(F.col("shape")))
    unreadable = F.when(F.col("issue").isNotNull(), F.concat_ws(": ", "shard", "issue"))
    read = tensors.groupBy("model").agg(
        F.sum(found).cast("decimal(38,0)").alias("parameters"), F.collect_list(unreadable).alias("unreadable")
    )
    absent = missing_shards(indexes, files).groupBy("model").agg(
        F.collect_list(F.concat(F.lit("missing shard "), "shard")).alias("absent")
    )
    facts = models.select("model")
    for part in (config, held, read, absent):
        facts = facts.join(part, "model", "left")
    none = F.array().cast("array<string>")
    issues = F.concat(
        F.when(F.coalesce("weights", F.lit(False)), none).otherwise(F.array(F.lit("no weight files"))),
        F.when(F.coalesce("config_ok", F.lit(False)), none).otherwise(
            F.array(F.lit("config.json is missing or invalid"))
        ),
        F.coalesce("unreadable", none),
        F.coalesce("absent", none),
    )
    return facts.select(
        "model",
        *[c for c in config.columns if c != "model"],
        F.coalesce("disk_bytes", F.lit(0)).alias("disk_bytes"),
        F.coalesce("parameters", F.lit(0).cast("decimal(38,0)")).alias("parameters"),
        F.array_sort(issues).alias("issues"),
    )


def _filled() -> Column:
    """Whether ``v`` is an object with any entry."""
    return F.col("v").isNotNull() & (F.to_json("v") != "{}")


def report_issues(
    models: DataFrame, files: DataFrame, tensors: DataFrame, configs: DataFrame, indexes: DataFrame
) -> DataFrame:
    """One row per finding of a report on the given models.

    Unlike :func:`model_problems` this tolerates an index that names no shard,
    names the missing shards, and covers unreadable headers and bad configs.
    """
    config = _parsed(configs).select("model", _filled().alias("config_ok"))
    findings = _findings(models, files, tensors, indexes, config)
    return findings.select("model", F.explode("issues").alias("issue"))


def model_report(
    models: DataFrame,
    files: DataFrame,
    tensors: DataFrame,
    configs: DataFrame,
    tokenizer_configs: DataFrame,
    generation_configs: DataFrame,
    indexes: DataFrame,
) -> DataFrame:
    """One row per model: architecture facts, bytes of the reported files, parameters,
    ``issues``, and ``integrity_ok`` where there are none."""
    facts = model_facts(models, configs, tokenizer_configs, generation_configs)
    findings = _findings(models, files, tensors, indexes, facts)
    return findings.withColumn("integrity_ok", F.size("issues") == 0)


def model_facts(
    models: DataFrame, configs: DataFrame, tokenizer_configs: DataFrame, generation_configs: DataFrame
) -> DataFrame:
    """Architecture facts per model; nulls where a file is missing or invalid."""
    v = F.col("v")
    filled = _filled()

    def text_of(key: str, path: str = "") -> Column:
        value = f"try_variant_get(v, '$.{key}{path}', 'variant')"
        return F.expr(string_or_null(value)).alias(key)

    config = _parsed(configs).select(
        "model",
        text_of("architectures", "[0]").alias("architecture"),
        text_of("model_type"),
        F.try_variant_get(v, "$.hidden_size", "bigint").alias("hidden_size"),
        F.try_variant_get(v, "$.num_hidden_layers", "bigint").alias("num_layers"),
        F.try_variant_get(v, "$.vocab_size", "bigint").alias("vocab_size"),
        filled.alias("config_ok"),
    )
    tokenizer = _parsed(tokenizer_configs).select("model", text_of("tokenizer_class"))
    generation = _parsed(generation_configs).select(
        "model", F.when(filled, F.to_json(v)).alias("generation_config")
    )
    facts = models.select("model")
    for part in (config, tokenizer, generation):
        facts = facts.join(part, "model", "left")
    return facts.withColumn("config_ok", F.coalesce("config_ok", F.lit(False)))
