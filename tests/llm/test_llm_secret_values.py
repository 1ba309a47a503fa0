import pytest
from llm_cases import documents

from turnmill.llm import secrets

CASES = {
    "password = hunter2 rest": ["hunter2"], "password: correcthorsebattery": ["correcthorsebattery"], "db_password=P@ssw0rd!x7 rest": ["P@ssw0rd!x7"],
    "password = pass rest": ["pass"], "password=a": ["a"], "password =x.y rest": ["x.y"], "Password :abc$%. rest": ["abc$%."],
    'the "password": "P@ss", "user": "x"': ["P@ss"], '{"password":"P@ss","user":"x"}': ["P@ss"], "url?token=a.b&secret=c!d": ["a.b", "c!d"],
    "Authorization: Bearer ab.cd": ["ab.cd"], "apiKey='x!y';": ["x!y"], "clientSecret := ab%c": ["ab%c"], "token = abc123def456ghi": ["abc123def456ghi"],
    "password = abc123def456.ghi": ["abc123def456", "abc123def456.ghi"], "passwords are long": [], "password =": [], "a = b": [],
}


@pytest.fixture(scope="module")
def found(spark):
    return secrets.candidates(documents(spark, [(i, text, None, None, None) for i, text in enumerate(CASES)])).collect()


def test_named_values_are_candidates(found):
    got = {text: [r.value for r in sorted(found, key=lambda r: (r.word_at, r.value_at)) if r.id == i] for i, text in enumerate(CASES)}
    assert got == CASES


def test_prefix_ends_before_the_value(found):
    words = [text.split() for text in CASES]
    assert all(words[r.id][r.word_at].startswith(r.prefix + r.value) for r in found)
    assert [r.prefix for r in found if r.id == list(CASES).index("password=a")] == ["password="]


def test_long_keys_take_linear_time(spark):
    """Many names in one long word, and a value after it."""
    word = "token" * 100_000
    docs = documents(spark, [(1, word, None, None, None), (2, word + "=a!b", None, None, None), (3, "password=" + "x&" * 100_000, None, None, None)])
    found = {r.id: r.value for r in secrets.candidates(docs).collect()}
    assert found == {2: "a!b", 3: "x&" * 100_000}
