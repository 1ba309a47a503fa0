import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import ROWS, documents, with_clashes

from turnmill.llm import jaccard
from turnmill.llm.components import components


def _set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def _brute(rows, part=75, whole=100):
    sets = [_set(r[1]) for r in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and whole * common >= part * (len(sets[i]) + len(sets[j]) - common):
                label[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {}
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        least |= {i: min(known) if known else None for i in members}
    return sorted([(r[0], len(s), least[i]) for i, (r, s) in enumerate(zip(rows, sets, strict=True))], key=str)


def _run(df, **options):
    got = jaccard.jaccard_classes(df, **options).select("id", "n_shingles", "component_id")
    return sorted(map(tuple, got.collect()), key=str)


def _corpus(seed, n):
    """Families of edited copies at all similarities around the threshold, and a
    passage that most texts hold."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.random()}"
            if rng.random() < 0.3:
                words = words[: max(1, int(len(words) * rng.uniform(0.7, 1)))]
        else:
            words = [f"{i}w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 3, 6, 20, 60, 90]))]
            if rng.random() < 0.6:
                words += passage
        rows.append((i, " ".join(words), "en", "s", None))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = _corpus(seed, 260)
    want = _brute(rows)
    assert _run(documents(spark, rows).repartition(6)) == want
    assert len({c for _, _, c in want}) < 200


def test_far_links_are_found(spark, monkeypatch):
    """Without buckets of equal hashes, every link comes from opened groups."""
    monkeypatch.setattr(jaccard, "_clusters", lambda docs, profiles, words_each, at: (
        spark.createDataFrame([], "a long, b long"),
        spark.createDataFrame([], "node long, n int, cluster long, lo int, hi int, part int, loose boolean"),
    ))
    rows = _corpus(3, 160)
    assert _run(documents(spark, rows)) == _brute(rows)


def test_frequent_tokens_and_shuffled_ids(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_FREQUENT", 3)
    monkeypatch.setattr(jaccard, "_BROADCAST_ROWS", -1)
    monkeypatch.setattr(jaccard, "_GROUP_NODES", 2)
    monkeypatch.setattr(jaccard, "_PAIRS_A_STEP", 5)
    rows = _corpus(4, 160)
    assert _run(documents(spark, rows).repartition(4)) == _brute(rows)


def test_other_threshold(spark):
    rows = _corpus(5, 120)
    assert _run(documents(spark, rows), part=50) == _brute(rows, 50)


def test_odd_rows(spark):
    want = _brute(ROWS)
    assert _run(documents(spark)) == want
    assert _run(with_clashes(documents(spark)).drop("id", "key")) == want
    assert _run(with_clashes(documents(spark))) == want
    assert _run(documents(spark).limit(0)) == []
    assert _run(documents(spark, [r for r in ROWS if not r[1]])) == _brute([r for r in ROWS if not r[1]])


def test_few_documents_take_few_tasks(spark, monkeypatch):
    """With many shuffle partitions, each held to its number, the tables of few documents are in few
    files, but for the candidates, whose number is not known before."""
    from turnmill.llm import components as comp
    from turnmill.session import materialize

    files = {}

    def counted(df, name="stage"):
        made = materialize(df, name)
        files[name] = max(files.get(name, 0), len(made.inputFiles()))
        return made

    monkeypatch.setattr(jaccard, "materialize", counted)
    monkeypatch.setattr(comp, "materialize", counted)
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    rows = _corpus(9, 200)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = _run(documents(spark, rows))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == _brute(rows)
    many = {k: n for k, n in files.items() if n > 2 * spark.sparkContext.defaultParallelism}
    assert {"bucket-pairs", "clusters", "sets", "links", "least"} <= set(files) and set(many) <= {"candidates", "loose-links", "open-links"}


def test_first_of_classes(spark):
    got = jaccard.first_of_classes(with_clashes(documents(spark)))
    assert got.columns == with_clashes(documents(spark)).columns
    kept = sorted(str(r.doc_id) for r in got.collect() if r.text and r.text.strip())
    # 1 stands for both copies of 2 and for 11, 8 for 9.
    assert kept == sorted(map(str, [1, None, 7, 8, 10, 12]))
    assert got.count() == len(kept) + sum(1 for r in ROWS if not (r[1] or "").strip())


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(2000, 2100)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in links:
        if a != b:
            label[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {x: find(x) for x in label}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_many_nearly_similar_documents(spark):
    """Documents of one base that are mostly below the threshold of each other: loose groups
    stand for them among the candidates, and no link is lost."""
    rng = random.Random(31)
    base = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(160):
        own = list(base)
        for _ in range(rng.choice([5, 14, 18, 22])):
            own[rng.randrange(len(own))] = f"own{i}.{rng.random()}"
        rows.append((i, " ".join(own), None, None, None))
    from turnmill import session

    before = len(session._made)
    found = _run(documents(spark, rows))
    assert found == _brute(rows) and 1 < len({c for *_, c in found}) < 160
    (known,) = [p for p in session._made[before:] if "/cluster-pairs-" in p]
    assert spark.read.parquet(known).count() < 160 * 159 / 2 / 3


def test_links_that_connect_two_groups():
    import numpy as np

    at = jaccard.Threshold()
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 400, np.uint64)
    sets = [np.unique(np.concatenate((base[k : k + 300], rng.integers(0, 1 << 62, 5, np.uint64)))) for k in (0, 10, 20, 60, 95, 100)]
    nodes = [jaccard.node_of(s) for s in sets]
    group = lambda own: ([nodes[i] for i in own], [sets[i].tobytes() for i in own], [jaccard.sketch(sets[i]) for i in own])
    similar = {(i, j) for i in range(6) for j in range(6) if i != j and at.similar(sets[i], sets[j])}

    def parts(links):
        label = {n: n for n in nodes}
        for _ in nodes:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
        return [label[n] for n in nodes]

    for a, b in (([0, 1, 2], [3, 4, 5]), ([0, 3], [1, 2, 4, 5]), (range(6), range(6))):
        links = jaccard.connecting_links(group(a), group(b), jaccard.union_bitmap([sets[i] for i in b]), at, (True, True))
        among = {(i, j) for i, j in similar if i in a and j in b}
        assert all((nodes.index(x), nodes.index(y)) in among for x, y in links) and len(links) < 6
        assert parts(links) == parts([(nodes[i], nodes[j]) for i, j in among])
        assert len(jaccard.connecting_links(group(a), group(b), jaccard.union_bitmap([sets[i] for i in b]), at, (False, False))) <= 1


def test_repeated_tokens_are_counted_in_little_more_than_their_own_memory():
    rng = np.random.Generator(np.random.Philox(key=[3, 0]))
    sets = [np.unique(rng.integers(0, 1 << 20, 1000, dtype=np.uint64)) for _ in range(500)]
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    size = sum(s.nbytes for s in sets)
    tracemalloc.start()
    found, times = jaccard.repeated_tokens(list(sets))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tolist() == tokens[counts > 1].tolist() and times.tolist() == counts[counts > 1].tolist()
    assert peak < 2.5 * size
    assert all(len(x) == 0 for x in jaccard.repeated_tokens([np.zeros(0, np.uint64)]))


def test_words_of_many_texts_are_hashed_once(monkeypatch):
    """Each distinct word of a step is hashed once, and its sets are those of single texts."""
    texts = ["", None, " \n", "a", "a B c d", "A b C d e", " a\tb\x0bc\x0cd\re f ", "\u00c9\x1cx y z q w", "A a A a a a a a", "a b c d e f g" * 9]
    hashed, real = [], jaccard.xxhash.xxh3_64_intdigest
    monkeypatch.setattr(jaccard.xxhash, "xxh3_64_intdigest", lambda w: hashed.append(bytes(w)) or real(w))
    tokens, bounds = jaccard.shingle_sets(pa.array(texts, pa.string()))
    sets = [tokens[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert len(hashed) == len(set(hashed)) == len({w for t in texts for w in (t or "").encode().lower().split()})
    assert [len(s) for s in sets] == [len(_set(t)) for t in texts]
    assert all(s == sorted(s) for s in sets)
    for a, x in zip(texts, sets, strict=True):
        alone = jaccard.shingle_sets(pa.array([a], pa.string()))[0].tolist()
        assert alone == x
        assert all((x == y) == (_set(a) == _set(b)) for b, y in zip(texts, sets, strict=True))


def test_steps_hold_few_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(jaccard, "_ROWS_A_STEP", 3)
    monkeypatch.setattr(jaccard, "_BYTES_A_STEP", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(["a"] * 4 + [None, "b" * 30, "c" * 6, "d" * 6, ""])], ["id", "text"])
    assert [part.column(0).to_pylist() for part in jaccard._steps(batch)] == [[0, 1, 2], [3, 4], [5], [6], [7, 8]]
    assert list(jaccard._steps(batch.slice(0, 0))) == []


@pytest.mark.parametrize("at_once", [2, 64])
def test_pairs_of_runs(monkeypatch, at_once):
    """All pairs of different units of a token whose sizes fit, each once, smaller first."""
    monkeypatch.setattr(jaccard, "_UNITS_AT_ONCE", at_once)
    rng, at = np.random.default_rng(3), jaccard.Threshold()
    for n in (0, 1, 2, 300):
        token, unit = np.sort(rng.integers(-20, 20, n)), rng.integers(0, 60, n)
        lo = unit % 7 + 5
        hi = lo + unit % 3
        want = set()
        for v in set(token.tolist()):
            own = sorted({(int(a), int(b), int(c)) for a, b, c in zip(lo[token == v], unit[token == v], hi[token == v], strict=True)})
            want |= {(v, x[1], y[1]) for i, x in enumerate(own) for y in own[i + 1 :] if y[0] <= x[2] * at.whole // at.part}
        found = [x for p in jaccard.run_pairs([token, unit, lo.astype(np.int32), hi.astype(np.int32)], at) for x in zip(*[c.tolist() for c in p[:2]], strict=True)]
        assert sorted(found) == sorted(x[1:] for x in want)
