"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnmill.llm import bpe, divergence, exact_dedup, filter_audit, jaccard, langid, line_dedup, mixing, secrets, sharding, url_filter, vector_file, warc
from turnmill.llm.common import table

QUERIES = {}
ORACLES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes, equal texts together."""
    placed = sharding.minimax_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_vector_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest inner products of every fiftieth vector with all others."""
    return vector_file.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op2_vector_file"] = """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


# The mixture's tree: domains are families of sources.
DOMAINS = {"web": ("src0",), "books": ("src1", "src2", "src3", "src4", "src5"), "news": ("src6", "src7", "src8", "src9")}
MIX_LEVELS = ("domain", "lang", "source")
MIX_WEIGHTS = {"domain": {"web": 3, "books": 3, "news": 2, "other": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}


def with_domain(docs: DataFrame) -> DataFrame:
    """``docs`` with the domain of each source; sources of no family are other."""
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(*sources), name).otherwise(domain)
    return docs.withColumn("domain", domain)


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a mixture of half of all words, over at most two epochs."""
    docs = with_domain(table(spark, sf_dir, "documents"))
    mixed = mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, budget=F.expr("total div 2"), max_epochs=2, seed=11)
    return mixed.withColumnRenamed("id", "doc_id").drop("text_key")


def _mix_sql() -> str:
    """The mixture in SQL: one level of the tree after the other."""
    case = lambda column, weights: f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END" if weights else "1"
    domain = "CASE " + " ".join(f"WHEN source IN ({', '.join(map(repr, x))}) THEN '{k}'" for k, x in DOMAINS.items()) + " ELSE 'other' END"
    parts = [
        rf"""d AS (SELECT doc_id, {domain} AS domain, lang, source, md5(coalesce(text, '')) AS text_key,
        CASE WHEN body = '' THEN 0 ELSE len(string_split_regex(body, '[\x20\x09-\x0D]+')) END AS tokens
        FROM (SELECT *, regexp_replace(coalesce(text, ''), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS body FROM documents))""",
        "leaves AS (SELECT domain, lang, source, sum(tokens)::HUGEINT AS tokens FROM d WHERE tokens > 0 GROUP BY ALL)",
        "p0 AS (SELECT 0 AS root, least(sum(tokens) // 2, sum(tokens) * 2)::HUGEINT AS budget FROM leaves)",
    ]
    above = ["root"]
    for depth, level in enumerate(MIX_LEVELS, 1):
        path = ", ".join(MIX_LEVELS[:depth])
        parent = ", ".join(above)
        full_first = f"PARTITION BY {parent} ORDER BY cap / weight, {level}"
        before = f"({full_first} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        upto = f"({full_first} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        group = f"(PARTITION BY {parent})"
        parts += [
            f"""c{depth} AS (SELECT * FROM (SELECT 0 AS root, {path}, sum(tokens)::HUGEINT * 2 AS cap,
            max({case(level, MIX_WEIGHTS.get(level, {}))})::HUGEINT AS weight FROM leaves GROUP BY ALL) JOIN p{depth - 1} USING ({parent}))""",
            f"""r{depth} AS (SELECT *, cap * (sum(weight) OVER {group} - coalesce(sum(weight) OVER {before}, 0))
            <= (budget - coalesce(sum(cap) OVER {before}, 0)) * weight AS fits FROM c{depth})""",
            f"f{depth} AS (SELECT *, bool_and(fits) OVER {upto} AS filled FROM r{depth})",
            f"""o{depth} AS (SELECT *, budget - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER {group} AS rest,
            sum(CASE WHEN filled THEN 0 ELSE weight END) OVER {group} AS open,
            sum(CASE WHEN filled THEN 0 ELSE weight END) OVER {upto} AS upto FROM f{depth})""",
            f"""p{depth} AS (SELECT root, {path}, CASE WHEN filled THEN cap
            ELSE (rest * upto)::HUGEINT // open::HUGEINT - (rest * (upto - weight))::HUGEINT // open::HUGEINT END AS budget FROM o{depth})""",
        ]
        above.append(level)
    leaf = ", ".join(MIX_LEVELS)
    parts += [
        f"t AS (SELECT {leaf}, budget // tokens AS epochs, budget % tokens AS over FROM leaves JOIN p{len(MIX_LEVELS)} USING ({leaf}))",
        f"placed AS (SELECT * FROM d JOIN t USING ({leaf}) WHERE tokens > 0)",
        f"""started AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {leaf}
        ORDER BY md5(concat_ws(':', '11', (epochs + 1)::VARCHAR, doc_id::VARCHAR, text_key)), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed WHERE over > 0)""",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT doc_id, {leaf}, tokens::BIGINT AS tokens, epoch::BIGINT AS epoch, tokens::BIGINT AS take_tokens"
        f" FROM (SELECT *, unnest(range(1, epochs::BIGINT + 1)) AS epoch FROM placed)"
        f" UNION ALL SELECT doc_id, {leaf}, tokens::BIGINT, (epochs + 1)::BIGINT, least(tokens, over - start)::BIGINT FROM started WHERE start < over"
    )


ORACLES["op3_mix_sources"] = _mix_sql()


@query
def op6_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that an earlier one has, in figures."""
    clean = line_dedup.remove_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"])))
    return clean.select(
        "doc_id", "n_lines", "removed_lines", spans.alias("removed_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op4_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text, and of the text they decode to."""
    encoded = bpe.encode_documents(
        table(spark, sf_dir, "documents"), vocabulary(), keep=["doc_id"], decoded=True
    )
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from the archives that it was written to."""
    index, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_records(index, folder, payload=False).drop("url")


ORACLES["op5_warc_archive"] = """
WITH p AS (
  SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM p)
SELECT page_id, n AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 5 * (i // 4)::INTEGER, 5) AS INTEGER) >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)
    for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM g
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out. A
    document without an id is not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    profiles = langid.learn_profiles(docs.filter(~held_out))
    found = langid.identify(docs, profiles, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op8_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal normalised texts and the document of each that stays."""
    found = exact_dedup.dedup_exact(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


ORACLES["op8_cuckoo_dedup"] = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


# Values that a provider's own prefix marks as a credential.
_ISSUED = (
    "^(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{20,}"
    "|sk-[A-Za-z0-9_-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeoprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
)
# A credential's name, = or :, and what may stand between it and the value.
_NAMED = (
    "(?i)(?:token|passw(?:or)?d|passwd|passphrase|pwd|secret|credentials?|authorization"
    "|(?:api|access|private|secret|auth|account|encryption|signing|ssh|master)[_.-]?key)(?:[_-]?(?:id|value|[0-9]+))?"
    "[\"']?\\s?(?::=|=>|[=:])\\s?[\"'`]?(?:(?:bearer|basic|token)\\s?)?$"
)
_UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_DATE = "^(?:19|20)[0-9]{2}([-/_]?)(?:0[1-9]|1[0-2])\\1(?:0[1-9]|[12][0-9]|3[01])(?:[T_-]?[0-2][0-9][-_]?[0-5][0-9](?:[-_]?[0-5][0-9])?)?Z?$"
_PATH = "^/?[a-z]+(?:[/_-][a-z]+)*[/_-]?[0-9]{1,4}$"


def _luhn(value: Column) -> Column:
    """Whether a value is a card number by length and check digit."""
    digits = F.transform(F.split(F.reverse(value), ""), lambda c: c.try_cast("int"))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return value.rlike("^[0-9]{13,19}$") & (F.aggregate(doubled, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0)


def reviewed() -> Column:
    """Labels for two thirds of the documents. The tables hold no reviewed findings, so
    formats decide: values with a provider's prefix, and those of twelve characters with
    a digit after a credential's name, are secrets; card numbers, UUIDs, dates and paths
    of dictionary words are not. What no rule knows, or rules of both kinds, has no label.
    """
    known = F.crc32(F.col("id").cast("string").cast("binary")) % 3 != 1
    value = F.col("value")
    words = value.rlike(_PATH) & (F.col("coverage") + F.col("digits") + F.col("marks") > 0.999)
    harmless = _luhn(value) | value.rlike(_UUID) | value.rlike(_DATE) | words
    named = F.concat_ws(" ", "before_2", "before", "prefix").rlike(_NAMED) & (F.length(value) >= 12) & value.rlike("[0-9]")
    secret = value.rlike(_ISSUED) | named
    return F.when(known & (secret != harmless), secret.cast("int"))


@query
def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate in every document, judged; values as digests."""
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"), reviewed())
    return found.select(
        F.col("id").alias("doc_id"), "word_at", "value_at", F.length("value").alias("length"),
        F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret",
    )


@query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document under 5-word shingles and similarity 0.75."""
    found = jaccard.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


ORACLES["op10_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if x <> ''] AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []
    WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)] END) AS shingle
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
reach AS (SELECT doc_id, doc_id AS other FROM w UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = other)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query
def op11_filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source under all 120 orders of four text filters and the duplicate filter."""
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_orders"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, t, len(w) AS n, len(list_distinct(w)) AS distinct_n
  FROM (SELECT doc_id, source, coalesce(text, '') AS t, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS w FROM documents)),
f AS (
  SELECT doc_id, part, CASE WHEN n < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * distinct_n < 65 * n THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY sha256(t)) THEN 16 ELSE 0 END AS mask
  FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS is_good, bool_or(toxic = 1) AS is_toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (is_good) AS good, count(*) FILTER (is_toxic) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(range(5)) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
steps AS (SELECT o, unnest(range(1, 6)) AS step FROM orders),
s AS (
  SELECT array_to_string([substr('ABCDE', x::INTEGER + 1, 1) for x in o], '') AS filter_order, step::INTEGER AS step, o[step] AS f, 1 << o[step]::INTEGER AS own,
    list_sum([1 << x::INTEGER for x in o[1:step]])::INTEGER - (1 << o[step]::INTEGER) AS before
  FROM steps),
r AS (
  SELECT part, filter_order, step, f,
    sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & own > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & own > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM m CROSS JOIN s GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of a language against every other one, and its most outstanding terms."""
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.lang_n
  FROM g JOIN k ON g.lang = k.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v) AS p,
    1 + 1000000000 * (lang_n + 5) // (lang_total + 5 * v) AS q
  FROM cells JOIN l USING (lang)),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, and by two Markov models where none fits."""
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.col("score").alias("score_milli"))


def _url_sql() -> str:
    """Rules, n-gram counts, smoothing by context, calibration and verdict in SQL."""
    fits = [
        f"WHEN (host = '{own}' OR ends_with(host, '.{own}')) AND starts_with(path, '/{below}') THEN '{rule}'"
        for rule in sorted((r for _, r in URL_RULES), key=lambda r: (-len(r), r))
        for own, _, below in [rule.partition("/")]
    ]
    told = " ".join(f"WHEN '{rule}' THEN '{kind}'" for kind, rule in URL_RULES)
    order, strength = url_filter.ORDER, f"{url_filter.STRENGTH}::DOUBLE"
    parts = [
        "u AS (SELECT row_number() OVER () AS r, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest"
        " FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))",
        "h AS (SELECT r, page_id, url, coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,"
        " coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)",
        f"f AS (SELECT *, CASE {' '.join(fits)} END AS rule FROM h)",
        f"t AS (SELECT *, CASE rule {told} END AS told, substr(md5(url), 1, 1) IN ('0', '1', '2') AS held FROM f)",
        f"x AS (SELECT r, told, told IS NULL OR held AS asked, repeat(chr(2), {order}) || url || chr(3) AS s FROM t)",
        f"g AS (SELECT r, told, asked, substr(s, unnest(range(1, length(s) - {order} + 1)), {order + 1}) AS gram FROM x)",
        f"l{order} AS (SELECT gram, count(*) FILTER (told = 'allow' AND NOT asked) AS a, count(*) FILTER (told = 'block' AND NOT asked) AS b FROM g GROUP BY gram)",
    ]
    parts += [f"l{k} AS (SELECT substr(gram, 2) AS gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM l{k + 1} GROUP BY ALL)" for k in reversed(range(order))]
    smooth = lambda c, below, context: f"({c}::DOUBLE + {strength} * {below}) / ({context}::DOUBLE + {strength}) AS {c}"
    parts.append("n AS (SELECT 1.0::DOUBLE / count(*) AS p, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM l0)")
    parts.append(f"p0 AS (SELECT gram, {smooth('l0.a', 'p', 'n.a').replace('AS l0.a', 'AS a')}, {smooth('l0.b', 'p', 'n.b').replace('AS l0.b', 'AS b')} FROM l0, n)")
    for k in range(1, order + 1):
        parts.append(f"c{k} AS (SELECT substr(gram, 1, {k}) AS gram, sum(a)::BIGINT AS a, sum(b)::BIGINT AS b FROM l{k} GROUP BY ALL)")
        one = [smooth(f"l.{c}", f"p.{c}", f"c.{c}").replace(f"AS l.{c}", f"AS {c}") for c in "ab"]
        parts.append(f"p{k} AS (SELECT l.gram, {', '.join(one)} FROM l{k} l JOIN p{k - 1} p ON substr(l.gram, 2) = p.gram JOIN c{k} c ON substr(l.gram, 1, {k}) = c.gram)")
    parts += [
        f"w AS (SELECT gram, round((ln(a) - ln(b)) * {url_filter._UNIT})::BIGINT AS weight FROM p{order})",
        f"s AS (SELECT r, sum(weight)::BIGINT AS s, {url_filter._BIN} * count(*) AS m FROM g JOIN w USING (gram) WHERE asked GROUP BY r)",
        "z AS (SELECT r, (s - ((s % m) + m) % m) // m AS score FROM s)",
        "k AS (SELECT score, told = 'allow' AS good FROM z JOIN t USING (r) WHERE told IS NOT NULL)",
        "e AS (SELECT DISTINCT score FROM (SELECT score FROM k UNION ALL SELECT max(score) + 1 FROM k UNION ALL SELECT 0 FROM k))",
        """cut AS (SELECT coalesce((SELECT score FROM (
          SELECT e.score, (count(*) FILTER (good AND k.score < e.score))::HUGEINT * count(*) FILTER (NOT good) + (count(*) FILTER (NOT good AND k.score >= e.score))::HUGEINT * count(*) FILTER (good) AS cost,
            count(*) FILTER (good) AS x, count(*) FILTER (NOT good) AS y FROM e, k GROUP BY e.score)
          WHERE x > 0 AND y > 0 ORDER BY cost, abs(score), score LIMIT 1), 0) AS cutoff)""",
        "trained AS (SELECT a > 0 AND b > 0 AS ok FROM n)",
    ]
    return (
        f"WITH {', '.join(parts)} SELECT page_id, host, path, rule, CASE WHEN told IS NOT NULL THEN told WHEN NOT ok OR score >= cutoff THEN 'allow' ELSE 'block' END AS verdict,"
        " CASE WHEN told IS NULL AND ok THEN score END::BIGINT AS score_milli FROM t LEFT JOIN z USING (r), cut, trained"
    )


ORACLES["op12_url_filter"] = _url_sql()
