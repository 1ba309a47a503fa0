import hashlib
import random
import re

from llm_cases import ROWS, documents, plain, with_clashes

from turnmill.llm import exact_dedup as ed


def _digests(n, seed=0):
    return [hashlib.sha256(f"{seed}-{i}".encode()).hexdigest() for i in range(n)]


def test_filter_follows_a_set():
    rng, live, cuckoo = random.Random(3), set(), ed.CuckooFilter(2)
    names = _digests(3000)
    for _ in range(12_000):
        d = rng.choice(names)
        assert cuckoo.find(d) == (d in live)
        if d not in live:
            cuckoo.insert(d)
            live.add(d)
        elif rng.random() < 0.6:
            assert cuckoo.delete(d)
            live.discard(d)
    assert cuckoo.size == len(live) == sum(map(len, cuckoo.keys)) and cuckoo.buckets > 2
    assert len(cuckoo.table()) == cuckoo.buckets * 8


def test_false_positives_are_verified():
    a = "0" * 16 + "1" * 44 + "beef"
    b = "f" * 16 + "1" * 44 + "beef"
    cuckoo = ed.CuckooFilter(2)
    cuckoo.insert(a)
    assert not cuckoo.find(b) and cuckoo.verified == 1 and not cuckoo.delete(b)


def _expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep, stays = (known[0] if known else None), True
        for i in sorted(ids, key=lambda x: (x is None, x)):
            mine = stays and i == keep
            stays = stays and not mine
            out.append((i, hashlib.sha256(text.encode()).hexdigest(), keep, len(ids), mine))
    return out


def test_odd_rows(spark):
    columns = ["id", "digest", "keep_id", "group_size", "kept"]
    want = sorted(_expected(ROWS), key=str)
    assert sorted((tuple(r) for r in ed.dedup_exact(documents(spark)).select(columns).collect()), key=str) == want
    clash = ed.dedup_exact(with_clashes(documents(spark))).select(columns).collect()
    assert sorted(map(tuple, clash), key=str) == want
    assert ed.dedup_exact(documents(spark).limit(0)).collect() == []


def test_index_follows_arrivals_and_departures(spark):
    docs = [(i, f"text {i % 7}", None, None, None) for i in range(40)]
    keyed = lambda rows: ed.keyed_documents(documents(spark, rows))
    whole = ed.entries(ed.build_index(keyed(docs), 4)).collect()
    grown = ed.insert_digests(ed.build_index(keyed(docs[:15]), 4), keyed(docs[15:]), 4)
    assert plain(ed.entries(grown).collect(), "digest", "keep_id", "group_size") == plain(whole, "digest", "keep_id", "group_size")
    gone = [d for d in docs if d[0] % 7 in (0, 1)] + [(99, "never seen", None, None, None)]
    left = ed.entries(ed.delete_digests(grown, keyed(gone), 4)).collect()
    stay = [r for r in whole if r.keep_id not in (0, 1)]
    assert plain(left, "digest", "group_size") == plain(stay, "digest", "group_size")
