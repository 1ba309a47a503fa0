import random

from llm_cases import ROWS, documents, plain, with_clashes
from pyspark.sql import functions as F

from turnmill.llm import line_dedup as ld


def _brute(rows):
    """All chunks of all documents in one dictionary of their bytes."""
    places = {}
    docs = {(r[0], r[1]) for r in rows}
    # The same order as the operator's: null ids first, then id, then key.
    import hashlib

    key = lambda d: hashlib.md5(f"{'-' if d[0] is None else d[0]}:{d[1] or ''}".encode()).hexdigest()
    for d in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, key(d))):
        lines = (d[1] or "").split("\n")
        for n, (a, b) in enumerate(ld.chunks(d[1] or "")):
            if b - a > 1:
                places.setdefault("\n".join(lines[a:b]), []).append((d, n))
    gone = {p for own in places.values() for p in own[1:]}
    out = []
    for r in rows:
        if r[1] is None:
            out.append((r[0], None, 0))
            continue
        lines = r[1].split("\n")
        dropped = {i for n, (a, b) in enumerate(ld.chunks(r[1])) if ((r[0], r[1]), n) in gone for i in range(a, b)}
        out.append((r[0], "\n".join(x for i, x in enumerate(lines) if i not in dropped) if dropped else r[1], len(dropped)))
    return sorted(out, key=str)


def _run(df):
    return sorted((tuple(r) for r in ld.remove_repeats(df).select("doc_id", "text", "removed_lines").collect()), key=str)


def test_chunks_cover_all_lines():
    rng = random.Random(2)
    for _ in range(200):
        text = "\n".join(rng.choice("abcde") for _ in range(rng.randint(1, 300)))
        found = ld.chunks(text)
        assert found[0][0] == 0 and found[-1][1] == text.count("\n") + 1
        assert all(a[1] == b[0] for a, b in zip(found, found[1:], strict=False)) and all(2 <= b - a <= 64 for a, b in found[:-1])


def test_boundaries_resist_shifts():
    rng = random.Random(4)
    lines = [f"line {rng.random()}" for _ in range(400)]
    whole = {"\n".join(lines[a:b]) for a, b in ld.chunks("\n".join(lines))}
    moved = ["new", *lines[:100], "another", *lines[100:]]
    shifted = {"\n".join(moved[a:b]) for a, b in ld.chunks("\n".join(moved))}
    assert len(whole & shifted) > 0.85 * len(whole)


def test_against_brute_force(spark):
    rng = random.Random(9)
    passage = [f"shared passage line {i} with several words" for i in range(12)]
    rows = []
    for i in range(80):
        own = [f"own {i} {j} {rng.random()}" for j in range(rng.randint(1, 20))]
        at = rng.randint(0, len(own))
        body = own[:at] + (passage if rng.random() < 0.4 else []) + own[at:]
        rows.append((i, "\n".join(body * (2 if rng.random() < 0.1 else 1)), "en", "s", None))
    rows += [(100 + i, rows[i % 4][1], "en", "s", None) for i in range(30)]
    got = _run(documents(spark, rows).repartition(5))
    assert got == _brute(rows) and sum(n for _, _, n in got) > 200


def test_spans_are_what_was_cut(spark):
    body = "\n".join(f"a line {i} of one text" for i in range(40))
    rows = [(1, body, None, None, None), (2, "first\n" + body, None, None, None)]
    got = {r.doc_id: r for r in ld.remove_repeats(documents(spark, rows)).collect()}
    assert got[1].removed == [] and got[1].text == body
    lines = rows[1][1].split("\n")
    dropped = {i for s in got[2].removed for i in range(s.start, s.end)}
    assert len(dropped) == got[2].removed_lines > 20
    assert got[2].text == "\n".join(x for i, x in enumerate(lines) if i not in dropped)


def test_odd_rows(spark):
    assert _run(documents(spark)) == _brute(ROWS)
    assert _run(with_clashes(documents(spark))) == _brute(ROWS)
    clash = ld.remove_repeats(with_clashes(documents(spark))).collect()
    assert len(clash) == len(ROWS) and {r.key for r in clash} == {"x"}
    assert ld.remove_repeats(documents(spark).limit(0)).collect() == []
    assert plain(ld.remove_repeats(documents(spark)).collect(), "doc_id", "n_chars") == plain(documents(spark).collect(), "doc_id", "n_chars")


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ld, "_BROADCAST_ROWS", -1)
    assert _run(documents(spark)) == _brute(ROWS)
    assert ld.remove_repeats(documents(spark).withColumn("doc_id", F.lit(None).cast("long"))).count() == len(ROWS)
