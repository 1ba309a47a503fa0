import random
import re

import pytest
import xxhash
from llm_cases import ROWS, documents, with_clashes
from pyspark.sql import functions as F

from turnmill.llm import secrets

PATTERN = secrets.CANDIDATE


def _text(rng, i):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "window", "server"]) for _ in range(30)]
    kind = i % 4
    value = "".join(rng.choice("0123456789abcdef") for _ in range(40)) if kind < 2 else "".join(rng.choice("0123456789") for _ in range(16))
    if kind == 3:
        value = f"window-server-{rng.randint(10, 99)}-gamma"
    lead = {0: "token = ", 1: "password=", 2: "card ", 3: "host "}[kind]
    at = rng.randint(1, 28)
    return " ".join([*words[:at], lead + value, *words[at:]]), value, int(kind < 2)


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    made = [_text(rng, i) for i in range(240)]
    truth = {value: label for _, value, label in made}
    docs = documents(spark, [(i, text, "en", f"src/{'test' if i % 3 else 'main'}/f.py", None) for i, (text, _, _) in enumerate(made)])
    return docs, truth


def test_held_out_accuracy(spark, labelled):
    docs, truth = labelled
    secret = F.col("value").isin([v for v, t in truth.items() if t])
    label = F.when(F.col("id") % 3 != 1, secret.cast("int"))
    got = [r for r in secrets.scan_secrets(docs, label).collect() if r.id % 3 == 1]
    assert len(got) >= 75
    assert sum(r.secret == bool(truth[r.value]) for r in got) / len(got) > 0.95


def test_candidates_are_those_of_the_pattern(spark, labelled):
    docs, _ = labelled
    rows = docs.collect() + documents(spark).collect()
    got = secrets.candidates(docs.union(documents(spark))).collect()
    want = []
    for r in rows:
        for n, word in enumerate(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "").strip(" ").split(" ")):
            want += [(r.doc_id, n, k, m) for k, m in enumerate(re.findall(PATTERN, word))]
    assert sorted((r.id, r.word_at, r.value_at, r.value) for r in got) == sorted(want)


def test_neighbours(spark):
    rows = [(1, "my api_token = \"abc123def456ghi\" rest", None, None, None), (2, "abc123def456ghi", None, None, None)]
    got = {r.id: r for r in secrets.candidates(documents(spark, rows)).collect()}
    assert (got[1].before_2, got[1].before, got[1].prefix, got[1].after) == ("api_token", "=", '"', "rest")
    assert (got[2].before_2, got[2].before, got[2].prefix, got[2].after, got[2].path) == ("", "", "", "", "")


def test_dictionary_coverage(spark):
    words = spark.createDataFrame([("window",), ("server",)], "word string")
    found = secrets.candidates(documents(spark, [(1, "x window-server-42 y", None, None, None)]))
    row = secrets.features(found, words).collect()[0]
    assert row.coverage == pytest.approx(12 / 16) and row.length == 16 and row.digits == pytest.approx(2 / 16)


def test_reviewed_findings_as_a_table(spark, labelled):
    docs, truth = labelled
    rows = [(r.id, r.value, truth[r.value]) for r in secrets.candidates(docs).collect() if r.id % 3 != 1]
    # A finding that was reviewed twice, and findings that are in no document.
    table = spark.createDataFrame([*rows, (*rows[0][:2], 1 - rows[0][2]), (9999, "x", 1), (None, None, 0)], "id long, value string, label int")
    got = [r for r in secrets.scan_secrets(docs, table).collect() if r.id % 3 == 1]
    assert len(got) >= 75 and sum(r.secret == bool(truth[r.value]) for r in got) / len(got) > 0.95


def _bucket(text):
    return (xxhash.xxh64_intdigest(text.encode(), 42) ^ 1 << 63) % 8


def _features(row, words):
    """All features of a finding, from its definition."""
    v, n = row.value, len(row.value)
    share = lambda test: sum(map(test, v)) / n
    lower, upper, digit = str.islower, str.isupper, str.isdigit
    follows = lambda a, b: sum(a(x) and b(y) for x, y in zip(v, v[1:], strict=False)) / n
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "9" if c.isdigit() else None
    runs = sum(kind(c) is None or i == 0 or kind(v[i - 1]) != kind(c) for i, c in enumerate(v))
    parts = set(re.split("[^a-z]+", v.lower()))
    naming = re.compile("token|passw|secret|api|key|auth|cred|bearer", re.I)
    return {
        "length": n, "digits": share(digit), "uppers": share(upper), "lowers": share(lower), "marks": share(lambda c: not c.isalnum()), "distinct": len(set(v)),
        "runs": runs / n, "lower_digit": follows(lower, digit), "digit_lower": follows(digit, lower), "upper_digit": follows(upper, digit), "digit_upper": follows(digit, upper),
        "hexadecimal": bool(re.fullmatch("[0-9a-f]+", v)), "coverage": sum(len(w) for w in parts if w in words) / n, "path_depth": row.path.count("/"), "path_length": len(row.path),
        "path_practice": bool(re.search("test|example|sample|mock|fixture|demo|doc", row.path, re.I)), "path_bucket": _bucket(row.path),
        "named_before": bool(naming.search(row.before) or naming.search(row.before_2)), "named_prefix": bool(naming.search(row.prefix)),
        "assigned": bool(re.search("[=:]", row.prefix) or re.search("[=:]$", row.before)), "quoted": bool(re.search("[\"'`]$", row.prefix)),
        "before_bucket": _bucket(row.before.lower()), "before_length": len(row.before), "after_length": len(row.after),
    }


def _tree_share(node, x):
    """The share of secrets in the leaf that a finding falls into."""
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    stats = list(node.impurityStats().stats())
    return stats[1] / sum(stats)


def test_features_and_scores_by_definition(spark, labelled):
    docs, truth = labelled
    words = secrets.dictionary(docs)
    known = {r.word for r in words.collect()}
    rows = secrets.features(secrets.candidates(docs.limit(60)), words)
    label = F.col("value").isin([v for v, t in truth.items() if t]).cast("int")
    forest = secrets.train_forest(secrets.features(secrets.candidates(docs), words).withColumn("label", label), trees=7, depth=4)
    got = secrets.judge(rows, forest).collect()
    roots = [t._call_java("rootNode") for t in forest.trees]
    assert len(got) == 60 and {"window", "server"} <= known
    for r in got:
        want = _features(r, known)
        assert want.keys() == set(secrets.FEATURES) and {c: r[c] for c in want} == pytest.approx({c: float(x) for c, x in want.items()}), r.value
        x = [float(want[c]) for c in secrets.FEATURES]
        score = sum(_tree_share(root, x) for root in roots) / len(roots)
        assert r.score == pytest.approx(score) and r.secret == (r.score >= 0.5)


def test_odd_rows(spark):
    none = F.lit(None).cast("int")
    got = secrets.scan_secrets(documents(spark), none).collect()
    assert all(r.secret and r.score == 1.0 for r in got)
    assert len(secrets.scan_secrets(with_clashes(documents(spark)), none).collect()) == len(got)
    assert secrets.scan_secrets(documents(spark).limit(0), none).collect() == []
    one = [(1, "token = abc123def456ghi", None, None, None)] * 3 + ROWS
    assert len(secrets.scan_secrets(documents(spark, one), F.lit(1)).collect()) == len(got) + 3


def test_no_python_on_executors(spark, labelled):
    docs, truth = labelled
    plan = secrets.scan_secrets(docs, F.when(F.col("id") < 100, F.col("value").isin([v for v, t in truth.items() if t]).cast("int")))
    assert not re.search("Python|Pandas|Arrow", plan._jdf.queryExecution().executedPlan().toString())
