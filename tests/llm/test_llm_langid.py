import zlib

import numpy as np
from conftest import SF_DIR
from llm_cases import ROWS, documents, with_clashes
from pyspark.sql import functions as F

from turnmill.llm import langid
from turnmill.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf_dir = SF_DIR.replace("sf0.001", "sf0.01")
    got = QUERIES["op7_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert len(held) > 250 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97


def _vector(text, seed=7):
    """Letter by letter, as the definition says."""
    letters = [c if c.isalpha() else " " for c in text.lower()]
    codes = [ord(c) for c in " " + " ".join("".join(letters).split()) + " "]
    own = {c: langid._letter_vectors(np.array([c]), seed)[0].astype(int) for c in codes}
    return sum(np.roll(own[a], 2) * np.roll(own[b], 1) * own[c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))


def test_vectors_follow_the_definition():
    for text in ["Hello, world", "a", "Éaux-là 漢字", "x" * 50 + " y"]:
        assert np.array_equal(langid.text_vectors([langid.trigrams(text)], 7)[0], _vector(text))


def test_long_texts_are_whole(monkeypatch):
    text = "Some words, 12 of them; and others " * 50
    keys, counts = langid.trigrams(text)
    monkeypatch.setattr(langid, "_CHARS_A_STEP", 17)
    parts = langid.trigrams(text)
    assert np.array_equal(keys, parts[0]) and np.array_equal(counts, parts[1])


def test_profiles_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    a = langid.learn_profiles(docs).orderBy("lang").collect()
    b = langid.learn_profiles(docs.repartition(7)).orderBy("lang").collect()
    assert a == b and len(a) == 4


def test_odd_rows(spark):
    docs = documents(spark)
    profiles = langid.learn_profiles(docs)
    assert {r.lang for r in profiles.collect()} == {"en", "de", "fr"}
    got = langid.identify(docs, profiles, ["doc_id", "text"]).collect()
    assert len(got) == len(ROWS)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred != "und") == letters and (letters or r.score == 0)
    clash = langid.identify(with_clashes(docs), profiles, ["doc_id", "key"]).collect()
    assert sorted(x.lang_pred for x in clash) == sorted(x.lang_pred for x in got)
    assert langid.identify(docs.limit(0), profiles, ["doc_id"]).collect() == []
    nothing = langid.learn_profiles(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.learn_profiles(docs.withColumn("lang", F.lit(None).cast("string"))).collect() == []


def test_predictions_by_definition(spark):
    """Prototypes, cosines and the language of the largest, recomputed letter by letter."""
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text", "lang").collect() if len(r["text"] or "") < 400][:40]
    rows += [("Éaux", "fr"), ("éaux", "aa"), ("", "en"), (None, "en"), ("a text", None)]
    docs = documents(spark, [(i, text, lang, "s", None) for i, (text, lang) in enumerate(rows)])
    prototypes = {}
    for text, lang in rows:
        if lang and any(c.isalpha() for c in text or ""):
            keys, counts = langid.trigrams(text)
            weights = counts * langid._WEIGHT // counts.sum()
            own = {k: _gram(k) for k in keys.tolist()}
            prototypes[lang] = prototypes.get(lang, 0) + sum(own[k] * w for k, w in zip(keys.tolist(), weights.tolist(), strict=True))
    profiles = langid.learn_profiles(docs)
    assert {r.lang: r.profile for r in profiles.collect()} == {n: p.tolist() for n, p in prototypes.items()}
    for r in langid.identify(docs, profiles, ["doc_id"]).collect():
        text = rows[r.doc_id][0]
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.n_trigrams) == ("und", 0, 0)
            continue
        vector = _vector(text)
        cosines = {n: float(vector @ p / np.linalg.norm(vector) / np.linalg.norm(p)) for n, p in prototypes.items()}
        best = max(cosines.values())
        assert abs(r.score - max(best, 0)) < 1e-4 and cosines[r.lang_pred] > best - 1e-6
        assert r.n_trigrams == langid.trigrams(text)[1].sum()


def _gram(key):
    a, b, c = (key >> 2 * langid._CODE_BITS, key >> langid._CODE_BITS & (1 << langid._CODE_BITS) - 1, key & (1 << langid._CODE_BITS) - 1)
    own = [langid._letter_vectors(np.array([x]), 7)[0].astype(int) for x in (a, b, c)]
    return np.roll(own[0], 2) * np.roll(own[1], 1) * own[2]


def test_equal_cosines_go_to_the_first_language(spark):
    docs = documents(spark, [(1, "the same words", "nl", "s", None), (2, "the same words", "af", "s", None), (None, "the same words", None, "s", None)])
    got = langid.identify(docs, langid.learn_profiles(docs), ["doc_id"]).collect()
    assert {r.lang_pred for r in got} == {"af"} and len(got) == 3
