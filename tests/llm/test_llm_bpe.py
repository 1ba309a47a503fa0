import random
import subprocess
import sys
import weakref
from types import SimpleNamespace

import numpy as np
import pytest
from llm_cases import LONG, ROWS, documents, with_clashes
from tokenizers import Tokenizer

from turnmill.llm import bpe, common
from turnmill.llm.queries import vocabulary


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.compile_automaton(vocabulary()))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def _ids(encoder, text):
    return np.frombuffer(encoder.encode([text])[0], "<u4").tolist()


def _same(encoder, library, text):
    own = _ids(encoder, text)
    assert own == library.encode(text, add_special_tokens=False).ids, repr(text[:80])
    assert encoder.decode(encoder.encode([text])[0]) == text == library.decode(own, skip_special_tokens=False)


ALPHABETS = ["ab ", "aeiou  \n\tst'", "<|endoftext|> xyz", "éñßçøÅ ²½ŒœŠ 漢字かな", "0123 ,.!?'re've", " \r\n\t\v\f\x1c\x85\xa0 　a"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts(encoder, library, alphabet):
    rng = random.Random(1)
    for _ in range(1500):
        _same(encoder, library, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))))


@pytest.mark.parametrize("text", ["", "a" * 30_000, " " * 3000, "ab" * 5000, LONG, "x<|endoftext|>" * 50, "\U0001f600‍\U0001f9d1 ﻿\x00"])
def test_long_and_odd_texts(encoder, library, text):
    _same(encoder, library, text)


def test_all_latin_characters(encoder, library):
    for c in map(chr, range(0x250)):
        _same(encoder, library, f"a{c}b {c}{c} 1{c}")


def test_only_encodings_are_accepted(encoder, library):
    automaton = encoder.automaton
    for word in ["hello", "tokenization", "aaaaaaa", " unbelievable"]:
        assert automaton.accepts(library.encode(word, add_special_tokens=False).ids)
        letters = [automaton.labels.index(bytes([b])) for b in word.encode()]
        assert not automaton.accepts(letters)


def test_gadgets_on_a_small_vocabulary():
    """All sequences over a tiny vocabulary: exactly the outputs of merging are accepted."""
    import itertools

    labels = [b"a", b"b", b"ab", b"aa", b"aba"]
    merges = [(0, 1, 2), (0, 0, 3), (2, 0, 4)]
    automaton = bpe.Automaton(*bpe._apply_gadgets([0, 1], merges, 5), labels, {})

    def merged(word):
        ids = [labels.index(bytes([c])) for c in word]
        for u, v, w in merges:
            i, out = 0, []
            while i < len(ids):
                pair = ids[i : i + 2] == [u, v]
                out.append(w if pair else ids[i])
                i += 2 if pair else 1
            ids = out
        return ids

    for size in range(1, 6):
        for ids in itertools.product(range(5), repeat=size):
            word = b"".join(labels[i] for i in ids)
            assert automaton.accepts(list(ids)) == (merged(word) == list(ids)), (ids, word)


def test_bounded_cache(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED_WORDS", 3)
    _same(encoder, library, "one two three four five six seven one two " + "y" * 200)


def test_odd_rows(spark, library):
    got = bpe.encode_documents(with_clashes(documents(spark)), vocabulary(), decoded=True).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(r.text or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.decoded, r.score) == (len(r.ids) // 4, r.text or "", "x")
    assert bpe.encode_documents(documents(spark).limit(0), vocabulary()).collect() == []


MEASURE = """
import sys
from turnmill.llm import bpe
peak = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmHWM")).split()[1])
before = peak()
bpe.compile_automaton(sys.argv[1])
print((peak() - before) / 1024)
"""


def test_compiling_takes_little_more_than_the_table():
    """The table has 20 MB; the peak of the process rises by less than 60."""
    done = subprocess.run([sys.executable, "-c", MEASURE, vocabulary()], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path)})
    assert float(done.stdout) < 60


def test_a_worker_holds_no_encoder_for_other_operators(encoder):
    """The tables of one operator are not memory of the tasks that a worker runs for the next."""
    shared = SimpleNamespace(value=encoder.automaton)
    found = weakref.ref(bpe._encoder(shared))
    assert bpe._encoder(shared) is found()
    assert list(common.own_memory(lambda rows: (x + 1 for x in rows))([1, 2])) == [2, 3]
    assert found() is None and not common._HELD
