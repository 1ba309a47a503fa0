import hashlib
import itertools
import random

import pytest
from llm_cases import ROWS, documents, with_clashes

from turnmill.llm import line_dedup as ld


def _words(line):
    parts = line.encode().split()
    return max(len(parts), sum(map(len, parts)) // 12)


def _brute(rows):
    """Every run of lines of every document in one dictionary, without chunks or windows."""
    key = lambda d: hashlib.md5(f"{'-' if d[0] is None else d[0]}:{d[1] or ''}".encode()).hexdigest()
    first, cut = {}, {}
    for d in sorted({(r[0], r[1]) for r in rows}, key=lambda d: (d[0] is not None, d[0] or 0, key(d))):
        lines = (d[1] or "").split("\n")
        sums = [0, *itertools.accumulate(map(_words, lines))]
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                if ld.is_passage(b - a, sums[b] - sums[a]):
                    at, begin = first.setdefault(tuple(lines[a:b]), (d, a))
                    if (at, begin) != (d, a):
                        cut.setdefault(d, set()).update(range(max(a, begin + b - a) if at == d else a, b))
    out = []
    for r in rows:
        gone = cut.get((r[0], r[1]), set()) if r[1] is not None else set()
        out.append((r[0], "\n".join(x for i, x in enumerate(r[1].split("\n")) if i not in gone) if gone else r[1], len(gone)))
    return sorted(out, key=str)


def _run(df):
    return sorted((tuple(r) for r in ld.remove_passages(df).select("doc_id", "text", "removed_lines").collect()), key=str)


def _line(rng, words):
    return " ".join(rng.choice("abcdefghijklmnop") + str(rng.randint(0, 999)) for _ in range(words))


def test_against_longest_runs(spark):
    rng = random.Random(21)
    shared = [[_line(rng, rng.choice([2, 9, 30])) for _ in range(n)] for n in (2, 2, 3, 3, 4, 5, 9)] + [["", "}"], ["x", "x"]]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += [_line(rng, rng.randint(0, 12)) for _ in range(rng.randint(0, 3))]
            passage = rng.choice(shared)
            a = rng.randint(0, 1)
            lines += passage[a:] if rng.random() < 0.5 else passage * rng.randint(0, 2)
        rows.append((i // 2 if i % 9 else None, "\n".join(lines), None, None, None))
    got = _run(documents(spark, rows + ROWS).repartition(5))
    assert got == _brute(rows + ROWS) and sum(n for _, _, n in got) > 200


@pytest.mark.parametrize("lines", [1, 2, 3, 5])
def test_passages_over_50_words_are_cut_whole(spark, lines):
    rng = random.Random(lines)
    rows, want = [], {}
    for i in range(20):
        passage = [_line(rng, 60 // lines + 1) for _ in range(lines)]
        for k in range(2):
            own = [_line(rng, 8), _line(rng, 5)]
            rows.append((2 * i + k, "\n".join([own[0], *passage, own[1]]), None, None, None))
            want[2 * i + k] = rows[-1][1] if k == 0 else "\n".join(own)
    got = {r.doc_id: r for r in ld.remove_passages(documents(spark, rows)).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all([tuple(s) for s in r.removed] == ([(1, 1 + lines)] if i % 2 else []) for i, r in got.items())


def test_odd_rows(spark, monkeypatch):
    assert _run(with_clashes(documents(spark))) == _brute(ROWS)
    assert ld.remove_passages(documents(spark).limit(0)).collect() == []
    monkeypatch.setattr(ld, "_BROADCAST_ROWS", -1)
    assert _run(documents(spark)) == _brute(ROWS)


def test_short_passages_stay(spark):
    rows = [(i, f"own {i}\n\n\n}}\n\nBy\nTo.\n{i} end\nfour words in it\nand five words in it", None, None, None) for i in range(3)]
    assert _run(documents(spark, rows)) == sorted(((r[0], r[1], 0) for r in rows), key=str)
    rows = [(i, f"own {i}\nfour words in it\n\nand six words are in it\n\n", None, None, None) for i in range(2)]
    assert _run(documents(spark, rows)) == [(0, rows[0][1], 0), (1, "own 1", 5)]


def _spans(lines, text):
    return [tuple(x) for x in lines(ld.Lines(*ld.line_profile(text)))]


def test_long_chunks_are_chunks_that_may_be_cut():
    rng = random.Random(8)
    for _ in range(50):
        text = "\n".join(_line(rng, rng.choice([0, 1, 4, 8, 60])) for _ in range(rng.randint(1, 60)))
        lines = text.split("\n")
        sums = [0, *itertools.accumulate(map(_words, lines))]
        found = _spans(ld.long_chunks, text)
        assert found == [(a, b) for a, b in ld.chunks(text) if ld.is_passage(b - a, sums[b] - sums[a])]
        # Equal lines have equal hashes wherever they are.
        profile = ld.Lines(*ld.line_profile(text))
        moved = ld.Lines(*ld.line_profile("x\ny\n" + text))
        assert all(profile.hash(a, b) == moved.hash(a + 2, b + 2) for a, b in found)


def test_short_chunks_cover_every_passage():
    rng = random.Random(9)
    for _ in range(40):
        text = "\n".join(_line(rng, rng.choice([0, 1, 4, 8, 60])) for _ in range(rng.randint(1, 25)))
        profile = ld.Lines(*ld.line_profile(text))
        n = len(profile.hashes)
        every = ld.short_chunks(profile, [])
        for a in range(n):
            for b in range(a + 1, n + 1):
                if profile.is_passage(a, b):
                    assert {i for x, y in every if a <= x and y <= b for i in range(x, y)} == set(range(a, b))
        known = [tuple(sorted(rng.sample(range(n + 1), 2))) for _ in range(3)] if n else []
        assert ld.short_chunks(profile, known) == [(a, b) for a, b in every if not any(x <= a and b <= y for x, y in known)]


def test_chunks_are_widened_to_both_sides():
    lines = [f"line {i}" for i in range(30)]
    own, first = ("\n".join(["a", *lines[5:25], "b"]), "\n".join(["c", "d", *lines[:20], "e"]))
    hashes = [ld.line_profile(t)[0] for t in (own, first)]
    # Lines 5 to 19 are from place 1 in one and from place 7 in the other.
    assert {ld.widened(*hashes, a, a + 2, a + 6) for a in range(1, 15)} == {(1, 16, 7)}
    whole = ld.line_profile("x\ny\nz")[0]
    assert ld.widened(whole, whole, 1, 2, 1) == (0, 3, 0)


def test_the_first_level_finds_most_repeats(spark):
    """Recall of the first level alone, and of both, in lines of passages that occur earlier."""
    rng = random.Random(12)
    shared = [[_line(rng, 12) for _ in range(n)] for n in (3, 5, 8, 12, 20, 30)]
    rows = []
    for i in range(120):
        own = [_line(rng, 9) for _ in range(rng.randint(2, 15))]
        at = rng.randint(0, len(own))
        rows.append((i, "\n".join(own[:at] + rng.choice(shared) + own[at:]), None, None, None))
    docs = documents(spark, rows)
    keyed = ld._keyed(docs, "doc_id", "text")
    profiles = ld.materialize(ld._profiles(keyed), "p")
    found = ld._widened(ld._segments(ld._repeats(ld.materialize(ld._chunk_rows(profiles), "c"))), profiles)
    first = sum(len({i for r in own for i in range(r[0], r[1])}) for own in found.rdd.map(lambda r: (r["key"], (r["start"], r["end"]))).groupByKey().map(lambda x: list(x[1])).collect())
    both = sum(n for _, _, n in _run(docs))
    assert both == sum(n for _, _, n in _brute(rows)) and 0.8 * both < first <= both
