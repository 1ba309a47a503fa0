import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import LONG, ROWS, documents, plain, with_clashes
from pyspark.sql import functions as F

from turnmill.llm import divergence
from turnmill.llm.divergence import PRIOR, SCALE, TOP_TERMS, count_long, count_short, find_terms, pack, radix_order, source_divergence

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_docs):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in counts}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        of_lang = {s: c for (g, s), c in counts.items() if g == lang}
        whole = sum(of_lang.values(), Counter())

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + SCALE * (c[t] + PRIOR) // (total + PRIOR * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in of_lang.items()}, shares(whole)
        for s, c in of_lang.items():
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in of_lang if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if c[t] > 0 and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, TOP_TERMS)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:top], 1)]
    return out


def same(found, rows, min_docs):
    assert found.columns == COLUMNS
    assert plain(found.collect(), *COLUMNS) == sorted(expected(rows, min_docs))


def made_rows(n, seed):
    """Texts over terms of 1 to 40 bytes, whose prefixes and paddings meet."""
    rng = random.Random(seed)
    words = ["a", "A", "ab", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghijklmno", "abcdefghijklmnop", "abcdefghijklmnopq", "É", "é", "漢字", "漢字漢字漢字", "\U0001f600" * 9, "x" * 40, "x" * 39 + "y"]
    words += ["".join(rng.choice("ab") for _ in range(rng.randint(1, 20))) for _ in range(40)]
    langs, sources = ["en", "de", None, ""], ["s0", "s0", "s0", "s1", "é", None]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", "1", "\0", "_", "`"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return [(i % 50, rng.choice([*[t] * 9, None, ""]), rng.choice(langs), rng.choice(sources), i) for i, t in enumerate(texts)]


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(1)
    for high in (3, 1 << 20, 1 << 63):
        words = [rng.integers(0, high, 2000, np.uint64), rng.integers(0, 3, 2000, np.uint64)]
        assert (radix_order(words) == np.lexsort((words[1], words[0]))).all()
    assert radix_order([np.zeros(0, np.uint64)]).tolist() == []


def test_packed_words_sort_as_terms():
    terms = [b"a", b"ab", b"abcdefgh", b"abcdefghi", b"b", "é".encode(), "漢字漢字".encode(), b"z" * 16]
    body = b" ".join(terms)
    starts, lengths = find_terms(body)
    assert [body[a : a + n] for a, n in zip(starts, lengths, strict=True)] == terms
    packed = list(zip(*(w.tolist() for w in pack(body, starts, lengths, 2)), strict=True))
    assert sorted(packed) == [w for _, w in sorted(zip(terms, packed, strict=True))]
    assert b"".join(x.to_bytes(8, "big") for x in packed[3]).rstrip(b"\0") == b"abcdefghi"


def test_runs_count_rows_and_documents():
    body = b"b a b a a b"
    starts, lengths = find_terms(body)
    groups, docs = np.array([0, 0, 0, 0, 1, 1]), np.array([0, 0, 0, 1, 2, 2])
    rows = list(zip(*(x.tolist() for x in count_short(body, starts, lengths, 1, groups, docs)), strict=True))
    a, b = (int.from_bytes(x.ljust(8, b"\0"), "big") for x in (b"a", b"b"))
    assert rows == [(a, 0, 0, 2, 2), (a, 0, 1, 1, 1), (b, 0, 0, 2, 1), (b, 0, 1, 1, 1)]
    assert count_long(body, starts, lengths, groups, docs) == [(b"a", 0, 2, 2), (b"a", 1, 1, 1), (b"b", 0, 2, 1), (b"b", 1, 1, 1)]


@pytest.mark.parametrize(("cells", "step"), [(1 << 20, 1 << 23), (8, 100)])
def test_against_brute_force(spark, monkeypatch, cells, step):
    monkeypatch.setattr(divergence, "_BLOCK_CELLS", cells)
    monkeypatch.setattr(divergence, "_BYTES_A_STEP", step)
    if step == 100:
        for name in ("_ROWS_HELD", "_LONG_HELD", "_ROWS_OUT"):
            monkeypatch.setattr(divergence, name, 9)
    rows = made_rows(400, cells)
    same(source_divergence(with_clashes(documents(spark, rows)).repartition(3), min_docs=5), rows, 5)


def test_counts_of_a_task_are_added_up(monkeypatch):
    rows = [(lang or "", source or "", (text or "").encode()) for _, text, lang, source, _ in made_rows(200, 5)]

    def counted(step, held):
        monkeypatch.setattr(divergence, "_ROWS_HELD", held)
        counts, out = divergence.TermCounts(), []
        for at in range(0, len(rows), step):
            counts.add(*map(list, zip(*rows[at : at + step], strict=True)))
            if counts.full:
                out += [r for b in counts.rows_out() for r in b.to_pylist()]
        out += [r for b in counts.rows_out() for r in b.to_pylist()]
        total = Counter()
        for r in out:
            term = r["long_term"] or b"".join((r[w] % (1 << 64)).to_bytes(8, "big") for w in ("w1", "w2")).rstrip(b"\0")
            for c in ("n", "docs"):
                total[r["lang"], r["source"], term.decode(), c] += r[c]
        return len(out), total

    few, whole = counted(len(rows), 1 << 20)
    assert all(counted(step, held) == (few, whole) for step, held in ((1, 1 << 20), (7, 1 << 20)))
    assert counted(7, 50)[1] == whole
    wanted = Counter()
    for lang, source, body in rows:
        terms = TERM.findall(body.decode().translate(LOWER))
        wanted.update((lang, source, t, "n") for t in terms)
        wanted.update((lang, source, t, "docs") for t in set(terms))
    assert whole == wanted and few == len({k[:3] for k in wanted})


def test_odd_rows(spark):
    rows = [*ROWS, *ROWS, (30, LONG, "en", "src4", 1), (31, "ÀÉ émigré", "", "src0", 1)]
    same(source_divergence(documents(spark, rows), min_docs=2), rows, 2)
    # No term is in so many documents: differences of nothing, and no terms.
    same(source_divergence(documents(spark, rows)), rows, 30)


def test_ties_go_by_the_bytes_of_the_item(spark):
    rows = [(i, text, "en", source, 0) for i, (text, source) in enumerate([("z é a", "z"), ("z é a", "é"), ("z é a q", "a"), ("q q q", "b")])]
    same(source_divergence(documents(spark, rows), min_docs=1), rows, 1)


def test_empty_table(spark):
    assert source_divergence(documents(spark, [])).collect() == []


def test_counts_beyond_64_bits(spark):
    big = 1 << 40
    got = spark.range(1).select(divergence.share(F.lit(big), F.lit(2 * big), F.lit(3)).alias("p")).first()["p"]
    assert got == 1 + SCALE * (big + PRIOR) // (2 * big + PRIOR * 3)
