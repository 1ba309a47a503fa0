import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from conftest import plan_of
from llm_cases import plain, with_clashes

from turnmill.llm import url_filter
from turnmill.llm.queries import URL_RULES
from turnmill.llm.url_filter import ORDER, STRENGTH, calibrate, judge_urls

COLUMNS = ["id", "host", "path", "rule", "verdict", "score"]


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = lambda text, ends: text[: min([i for i, c in enumerate(text) if c in ends], default=len(text))]
    host = cut(rest, "/?#")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), cut(rest[len(host) :], "?#")


def rule_of(host, path, rules):
    fits = []
    for kind, rule in rules:
        own, slash, below = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith(slash + below):
            fits.append((-len(rule), rule, kind))
    return min(fits)[1:] if fits else (None, None)


def expected(rows, rules=URL_RULES):
    urls = [(i, u or "") for i, u in rows]
    parts = [(*split(u), *rule_of(*split(u), rules)) for _, u in urls]
    held = [hashlib.md5(u.encode()).hexdigest()[0] in "012" for _, u in urls]
    grams = lambda u: [("\2" * ORDER + u + "\3")[i : i + ORDER + 1] for i in range(len(u) + 1)]
    counts, symbols = {"allow": defaultdict(Counter), "block": defaultdict(Counter)}, set()
    for (_, u), (*_, told), h in zip(urls, parts, held, strict=True):
        symbols |= {g[-1] for g in grams(u)}
        if told and not h:
            for g in grams(u):
                for k in range(ORDER + 1):
                    counts[told][g[ORDER - k : ORDER]][g[-1]] += 1
    trained = all(c for c in counts.values())

    def weight(g):
        p = dict.fromkeys(counts, 1.0 / len(symbols))
        for k in range(ORDER + 1):
            for kind, seen in counts.items():
                after = seen[g[ORDER - k : ORDER]]
                p[kind] = (after[g[-1]] + STRENGTH * p[kind]) / (after.total() + STRENGTH)
        return math.floor((math.log(p["allow"]) - math.log(p["block"])) * 1_000_000 + 0.5)

    score = lambda u: sum(map(weight, grams(u))) // (1000 * (len(u) + 1))
    cutoff = 0
    if trained:
        known = [(score(u), told == "allow") for (_, u), (*_, told), h in zip(urls, parts, held, strict=True) if told and h]
        good = sum(g for _, g in known)
        if 0 < good < len(known):
            places = {0, max(known)[0] + 1, *(s for s, _ in known)}
            lost = lambda c: sum(g and s < c for s, g in known) * (len(known) - good) + sum(not g and s >= c for s, g in known) * good
            cutoff = min(places, key=lambda c: (lost(c), abs(c), c))
    out = []
    for (i, u), (host, path, rule, told) in zip(urls, parts, strict=True):
        own = score(u) if trained and not told else None
        out.append((i, host, path, rule, told or ("allow" if own is None or own >= cutoff else "block"), own))
    return sorted(out, key=lambda t: [(x is not None, str(type(x)), x) for x in t])


def made_rows(n, seed=1):
    rng = random.Random(seed)
    hosts = ["a.example.net", "EXAMPLE.com", "m.example.org", "example.net", "spam.example.io", "notexample.com", "x.org", "net", "example.net:80"]
    paths = ["/en/", "/de/", "/fr/", "/en", "/", "", "/EN/", "/de/é漢\U0001f600"]
    make = lambda i: f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#top', 'page'])}{rng.randint(0, 30)}"
    return [(i, make(i)) for i in range(n)]


ODD = [
    (1, None), (1, None), (2, ""), (3, "example.net/en/"), (4, "://"), (5, "a://b://c/d"), (6, "http://X.Net?x=://y/z"), (None, "http://x.net/"),
    (7, "http://a.org/fr/\n\x02\x03 '\"\\"), (8, "x" * 3000), (9, "https://" + "h" * 2000 + ".net/" + "p" * 3000), (10, "http://Ä.NET/é#?/"),
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string")


def test_against_brute_force(spark):
    rows = made_rows(250) + ODD
    found = judge_urls(pages(spark, rows), URL_RULES)
    assert found.columns == COLUMNS
    assert plain(found.collect(), *COLUMNS) == expected(rows)


def test_repeats_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "_FREQUENT", 20)
    rows = made_rows(60, 2) + [(5, "http://a.example.com/en/same")] * 40
    given = with_clashes(pages(spark, rows)).withColumnsRenamed({"row": "told"}).repartition(3)
    assert plain(judge_urls(given, URL_RULES).collect(), *COLUMNS) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "http://a.com/x")], [(i, f"http://b{i}.net/") for i in range(40)], [(1, None)]])
def test_nothing_to_learn_from(spark, rows):
    found = plain(judge_urls(pages(spark, rows), URL_RULES).collect(), *COLUMNS)
    assert found == expected(rows)
    assert all(r[4] == "allow" and r[5] is None for r in found if r[3] is None)


def test_longest_rule_wins(spark):
    rules = [("block", "b.com/"), ("allow", "a.b.com/"), ("block", "a.b.com/x"), ("allow", "b.com/yyyyyy")]
    rows = [(1, "http://b.com/"), (2, "http://a.b.com/"), (3, "http://z.a.b.com/xy"), (4, "http://a.b.com/yyyyyyy"), (5, "http://ab.com/"), (6, "http://b.com")]
    found = {r["id"]: r["rule"] for r in judge_urls(pages(spark, rows), rules).collect()}
    assert found == {1: "b.com/", 2: "a.b.com/", 3: "a.b.com/x", 4: "b.com/yyyyyy", 5: None, 6: None}


def test_models_tell_words_apart(spark):
    """URLs without a rule are judged as those with one that they are like."""
    rng = random.Random(3)
    good, bad = ["news", "library", "school", "garden"], ["casino", "pills", "jackpot", "xxxcam"]
    rows = []
    for i in range(600):
        kind, words = (("org/fr", good), ("net", bad))[i % 2]
        rows.append((i, f"http://{rng.choice(words)}.{kind}/{rng.choice(words)}-{rng.choice(words)}".replace("org/fr", "org/fr/", 1)))
    asked = [(1000 + i, f"http://site.com/{a}/{b}") for i, (a, b) in enumerate(zip(good * 5 + bad * 5, (good * 5)[1:] + good[:1] + (bad * 5)[1:] + bad[:1], strict=True))]
    found = {r["id"]: r["verdict"] for r in judge_urls(pages(spark, rows + asked), URL_RULES).collect()}
    wanted = {1000 + i: "allow" if i < 20 else "block" for i in range(40)}
    assert sum(found[i] == v for i, v in wanted.items()) >= 38


def test_calibration(spark):
    cut = lambda rows: calibrate(spark.createDataFrame(rows, "score long, accepted boolean"))
    assert cut([]) == 0
    assert cut([(5, True)]) == 0
    assert cut([(5, True), (4, False), (6, True), (-3, False)]) == 5
    assert cut([(5, False), (4, True)]) == 0
    assert cut([(-5, True), (-9, False)]) == -5
    # Kinds weigh the same, however many they are.
    assert cut([(1, True)] * 10 + [(3, True)] + [(2, False)]) == 3


def test_no_python_on_the_main_path(spark):
    plan = plan_of(judge_urls(pages(spark, made_rows(80)), URL_RULES))
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
