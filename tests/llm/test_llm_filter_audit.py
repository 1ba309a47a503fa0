import math
import random
from itertools import permutations

import pytest
from llm_cases import LONG, documents, plain, with_clashes

from turnmill.llm.filter_audit import MAX_FILTERS, TEXT_FILTERS, Diagram, audit_filters, audit_orders, audit_parts, exchanges

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def replay(masks, names):
    """Every order by going through the masks, filter after filter."""
    n, rows = len(names), []
    for order in permutations(range(n)):
        for step, f in enumerate(order, 1):
            before = sum(1 << i for i in order[: step - 1])
            failing = [(m, c) for m, c in masks.items() if m >> f & 1]
            removed = [c for m, c in failing if not m & before]
            kept = sum(c[0] for m, c in masks.items() if not m & (before | 1 << f))
            early = sum(c[0] for m, c in failing if m & before)
            alone = sum(c[0] for m, c in failing if m == 1 << f)
            rows.append([f, "".join(names[i] for i in order), step, kept, sum(c[0] for c in removed), early, alone, *(sum(c[i] for c in removed) for i in (1, 2))])
    shares = [sum(r[4] for r in rows if r[0] == f) for f in range(n)]
    return sorted((*r[1:], shares[r[0]]) for r in rows)


@pytest.mark.parametrize("n", range(1, 7))
def test_exchanges_reach_every_order_once(n):
    order = list(range(n))
    seen = {tuple(order)}
    for at in exchanges(n):
        order[at], order[at + 1] = order[at + 1], order[at]
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n) == len(exchanges(n)) + 1


@pytest.mark.parametrize("n", range(1, 6))
def test_orders_of_random_masks(n):
    rng = random.Random(n)
    for _ in range(8):
        chosen = rng.sample(range(1 << n), rng.randint(0, 1 << n))
        masks = {m: (c := rng.randint(1, 4), rng.randint(0, c), rng.randint(0, c)) for m in chosen}
        assert sorted(audit_orders(masks, "ABCDE"[:n])) == replay(masks, "ABCDE"[:n])


def test_equal_nodes_are_one_and_swaps_undo_each_other():
    diagram = Diagram({m: (1, 0, 0) for m in range(32)}, 5)
    assert [len(level) for level in diagram.levels] == [1] * 5
    diagram = Diagram({3: (2, 1, 0), 5: (1, 0, 1), 17: (4, 0, 0)}, 5)
    before = list(diagram.steps())
    sizes = [len(level) for level in diagram.levels]
    for at in (2, 0, 3, 3, 0, 2):
        diagram.swap(at)
    assert list(diagram.steps()) == before
    assert [len(level) for level in diagram.levels] == sizes


def test_text_filters():
    fails = lambda text: "".join(n for n, f in TEXT_FILTERS.items() if f(text.encode()))
    varied = " ".join(f"w{i}" for i in range(50))
    assert fails(varied) == ""
    assert fails(varied.rsplit(" ", 1)[0]) == "A"
    assert fails("") == "A"
    assert fails(" ".join([varied] * 2)) == "B"
    # 65 of 100 words are enough; words are told apart by case, and only ASCII space ends one.
    assert fails(" ".join([f"w{i}" for i in range(65)] + ["w0"] * 35)) == ""
    assert fails(" ".join([f"w{i}" for i in range(64)] + ["W0"] + ["w0"] * 35)) == ""
    assert fails(" ".join([varied] * 2).replace(" ", "\x0b")) == "B"
    assert fails(" ".join(["x"] * 200)) == "A"
    # 5 of 100 code points may be capitals.
    body = " ".join(f"é{i:03}" for i in range(60))
    capitals = len(body) * 5 // 100
    assert fails(body.replace("é", "É", 9)) == ""
    assert fails(body.replace("é", "Q", capitals)) == ""
    assert fails(body.replace("é", "Q", capitals + 1)) == "C"
    assert [fails(varied + c) for c in "#$%&*|"] == ["D"] * 6
    assert fails(varied + "!@^()") == ""


def expected(rows, labels):
    """All rows of the result from plain Python values."""
    flags = {}
    for i, quality, toxic in labels:
        if i is not None:
            good, bad = flags.get(i, (False, False))
            flags[i] = (good or quality == 1, bad or toxic == 1)
    parts: dict[str, dict[int, tuple]] = {}
    for i, text, _, source, _ in rows:
        body = (text or "").encode()
        mask = sum(f(body) << b for b, f in enumerate(TEXT_FILTERS.values()))
        earlier = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in rows)
        mask |= earlier << len(TEXT_FILTERS)
        good, bad = flags.get(i, (False, False))
        own = parts.setdefault(source or "", {})
        own[mask] = tuple(a + b for a, b in zip(own.get(mask, (0, 0, 0)), (1, good, bad), strict=True))
    return sorted((p, *r) for p, masks in parts.items() for r in replay(masks, "ABCDE"))


def cases():
    from llm_cases import ROWS

    return [*ROWS, (None, "", None, "src1", 0), (2, "", None, "src9", 0), (20, LONG, "en", "src0", 9), (4, "", "en", None, 0)]


def test_audit_against_brute_force(spark):
    labels = [(1, 1, 0), (1, 0, 1), (2, None, 1), (5, 1, 1), (None, 1, 1), (99, 1, 1), (4, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = documents(spark, cases())
    for given in (docs, with_clashes(docs).withColumnRenamed("lang", "part").withColumnRenamed("n_chars", "mask").repartition(7)):
        found = audit_filters(given, with_clashes(table))
        assert found.columns == COLUMNS
        assert plain(found.collect(), *COLUMNS) == expected(cases(), labels)


def test_hot_text_and_no_labels(spark):
    rows = [(i, "same text", "en", f"src{i % 3}", 9) for i in range(300)] + [(None, "same text", "en", "src0", 9)] * 5
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = audit_filters(documents(spark, rows), empty)
    assert plain(found.collect(), *COLUMNS) == expected(rows, [])


def test_empty_table_and_bad_names(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(documents(spark, []), empty).collect() == []
    for names in ("", "AA", "ABCDEFGHI"[: MAX_FILTERS + 1]):
        with pytest.raises(ValueError, match="filters"):
            audit_parts(spark.createDataFrame([], "part string, mask int, docs long, good long, toxic long"), names)
