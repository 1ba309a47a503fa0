import hashlib
import re
from fractions import Fraction

import pytest
from llm_cases import ROWS, documents, plain, with_clashes
from pyspark.sql import functions as F

from turnmill.llm import mixing

LEVELS = ("lang", "source")


def _share(budget, children):
    """Water filling: children {name: (cap, weight)}."""
    order = sorted(children, key=lambda c: (children[c][0] / children[c][1], c is not None, c))
    own, left, weight = {}, budget, sum(w for _, w in children.values())
    for at, name in enumerate(order):
        cap, w = children[name]
        if Fraction(cap) * weight <= Fraction(left) * w:
            own[name], left, weight = cap, left - cap, weight - w
        else:
            done = 0
            for rest in order[at:]:
                upto = done + children[rest][1]
                own[rest] = left * upto // weight - left * done // weight
                done = upto
            break
    return own


def _targets(leaves, weights, budget, epochs):
    """Leaf targets for {(a, b): tokens}."""
    budget = min(budget, epochs * sum(leaves.values()))
    tops = {}
    for (a, _), n in leaves.items():
        tops[a] = tops.get(a, 0) + n * epochs
    upper = _share(budget, {a: (c, weights["lang"].get(a, 1)) for a, c in tops.items()})
    out = {}
    for a, own in upper.items():
        below = {b: (n * epochs, weights["source"].get(b, 1)) for (x, b), n in leaves.items() if x == a}
        out |= {(a, b): n for b, n in _share(own, below).items()}
    return out


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


@pytest.mark.parametrize("budget", [0, 1, 37, 150, 400, 10_000])
@pytest.mark.parametrize("epochs", [1, 3])
def test_budgets_and_prefixes(spark, budget, epochs):
    rows = [(i, " ".join(["w"] * (i % 9)), ["en", "de", "fr"][i % 3], f"s{i % 5}", None) for i in range(60)]
    weights = {"lang": {"en": 5, "de": 2}, "source": {"s1": 3, "s4": 7}}
    got = mixing.mix(documents(spark, rows), LEVELS, weights, budget=F.lit(budget), max_epochs=epochs, seed=3).collect()
    leaves = {}
    for r in rows:
        if _words(r[1]):
            leaves[r[2], r[3]] = leaves.get((r[2], r[3]), 0) + _words(r[1])
    targets = _targets(leaves, weights, budget, epochs)
    assert sum(targets.values()) == min(budget, epochs * sum(leaves.values()))
    taken = {}
    for r in got:
        taken[r.lang, r.source] = taken.get((r.lang, r.source), 0) + r.take_tokens
    assert taken == {k: n for k, n in targets.items() if n}
    want = []
    for (lang, source), target in targets.items():
        own = [r for r in rows if (r[2], r[3]) == (lang, source) and _words(r[1])]
        for epoch in range(1, epochs + 1):
            key = lambda r, e=epoch: hashlib.md5(f"3:{e}:{r[0]}:{hashlib.md5(r[1].encode()).hexdigest()}".encode()).hexdigest()
            for r in sorted(own, key=key):
                if target > 0:
                    want.append((r[0], epoch, min(_words(r[1]), target)))
                    target -= _words(r[1])
    # Whole epochs have no order of their own.
    assert sorted((r.id, r.epoch, r.take_tokens) for r in got) == sorted(want)


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10, 1, 1), ("a", "y", 1000, 1, 1), ("b", "z", 1000, 1, 1)], "lang string, source string, tokens long, lang_weight long, source_weight long")
    got = {(r.lang, r.source): r.target for r in mixing.leaf_budgets(leaves, LEVELS, F.lit(400), 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "z"): 200}
    got = {(r.lang, r.source): r.target for r in mixing.leaf_budgets(leaves.filter("source != 'y'"), LEVELS, F.lit(400), 1).collect()}
    assert got == {("a", "x"): 10, ("b", "z"): 390}


def test_odd_rows(spark):
    got = mixing.mix(documents(spark), LEVELS, {}, max_epochs=2).collect()
    total = sum(_words(r[1]) for r in ROWS)
    assert sum(r.take_tokens for r in got) == total and all(r.tokens > 0 for r in got)
    clash = mixing.mix(with_clashes(documents(spark)), LEVELS, {}, max_epochs=2).collect()
    assert plain(clash, "id", "epoch", "take_tokens") == plain(got, "id", "epoch", "take_tokens")
    assert mixing.mix(documents(spark).limit(0), LEVELS, {}).collect() == []


def test_no_python_on_executors(spark):
    plan = mixing.mix(documents(spark), LEVELS, {})._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)
