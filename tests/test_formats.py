"""Layout detection and conversion, record by record."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from turnmill.operators import formats
from turnmill.operators.formats import Format, normalize, register_format, with_format

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def run(parsed, record, fmt="auto", **options):
    row = normalize(parsed([record]), fmt, on_error="quarantine", **options).first()
    messages = None if row["messages"] is None else [(m["role"], m["content"]) for m in row["messages"]]
    return row["format"], messages, row["text"], row["error"]


@pytest.mark.parametrize(
    "record, expected",
    [
        ({"messages": []}, "openai"),
        ({"messages": [], "instruction": "x"}, "openai"),
        ({"conversations": [{"from": "human", "value": "x"}]}, "sharegpt"),
        ({"instruction": "x", "output": "y"}, "alpaca"),
        ({"instruction": None, "output": "y"}, "alpaca"),
        ({"prompt": "p", "completion": "c"}, "prompt"),
        ({"prompt": None, "response": None}, "prompt"),
        ({"text": f"{OPEN}user\nhi{CLOSE}"}, "chatml"),
        ({"text": "plain"}, "text"),
        ({"text": ""}, "text"),
        ({"messages": "x", "text": "t"}, "text"),
        ({"messages": None, "text": "t"}, "text"),
        ({"prompt": "p", "text": "t"}, "text"),
        ({"foo": "bar"}, None),
        ({"text": 5}, None),
        ({"prompt": "p"}, None),
        ({"conversations": {"a": 1}}, None),
    ],
)
def test_detection(parsed, record, expected):
    assert with_format(parsed([record])).first()["format"] == expected


def test_unknown_layout_names_its_keys(parsed):
    assert run(parsed, {"foo": 1, "bar": 2})[3] == "no known layout; keys: bar, foo"


def test_openai_roles_and_contents(parsed):
    record = {
        "messages": [
            {"role": " SYSTEM ", "content": " kept as is "},
            {"role": "developer", "content": None},
            {"role": "Assistant", "content": ["a", {"type": "text", "text": "b"}, {"x": 1}, 5, None, {"text": None}]},
            {"role": None, "content": True},
            {"content": 7},
            {"role": "observation"},
            {"role": ["user"], "content": {"a": 1}},
            {"role": "user", "content": float("nan")},
            {"role": "user", "content": [{"text": "true"}, {"text": True}, {"text": float("-inf")}, {"text": [1]}]},
        ]
    }
    assert run(parsed, record)[1] == [
        ("system", " kept as is "),
        ("user", ""),
        ("assistant", "a\nb\nNone"),
        ("user", "True"),
        ("user", "7"),
        ("tool", ""),
        ("user", '{"a":1}'),
        ("user", "nan"),
        ("user", "true\nTrue\n-inf\n[1]"),
    ]


@pytest.mark.parametrize("key", ["messages", "conversations"])
@pytest.mark.parametrize("bad", [1, "x", None, [1]])
def test_list_items_must_be_objects(parsed, key, bad):
    fmt, messages, _, error = run(parsed, {key: [{"role": "user", "from": "human"}, bad]})
    assert messages is None and error == f"'{key}' must be a list of objects"


@pytest.mark.parametrize(
    "alias, role",
    [
        ("human", "user"), (" GPT ", "assistant"), ("bot", "assistant"), ("ChatGPT", "assistant"),
        ("bard", "assistant"), ("bing", "assistant"), ("function", "tool"), ("observation", "tool"),
        (" system ", "system"), ("", "user"), ("narrator", "user"),
    ],
)
def test_sharegpt_speakers(parsed, alias, role):
    assert run(parsed, {"conversations": [{"from": alias, "value": " v "}]})[1] == [(role, " v ")]


@pytest.mark.parametrize(
    "extra, system",
    [
        ({}, None),
        ({"system": " S "}, "S"),
        ({"system_prompt": "P"}, "P"),
        ({"system": "", "system_prompt": "P"}, "P"),
        ({"system": "  ", "system_prompt": "P"}, None),
        ({"system": 0, "system_prompt": "P"}, "P"),
        ({"system": [], "system_prompt": "P"}, "P"),
        ({"system": {}, "system_prompt": "P"}, "P"),
        ({"system": False, "system_prompt": "P"}, "P"),
        ({"system": 3, "system_prompt": "P"}, None),
        ({"system": None, "system_prompt": 5}, None),
    ],
)
def test_sharegpt_system_prompt(parsed, extra, system):
    turns = run(parsed, {"conversations": [{"value": "hi"}], **extra})[1]
    assert turns == ([("system", system)] if system else []) + [("user", "hi")]


def test_alpaca_joins_instruction_and_input(parsed):
    record = {"instruction": "\tCount the vowels\n", "input": " in: banana ", "output": " three\t", "system": "Be exact."}
    assert run(parsed, record)[1] == [("system", "Be exact."), ("user", "Count the vowels\n\nin: banana"), ("assistant", "three")]


@pytest.mark.parametrize(
    "extra, system",
    [({}, "D"), ({"system": ""}, "D"), ({"system": None}, "D"), ({"system": "  "}, None), ({"system": 4}, None)],
)
def test_alpaca_default_system(parsed, extra, system):
    turns = run(parsed, {"instruction": "i", "output": "", **extra}, default_system=" D ")[1]
    assert turns == ([("system", system)] if system else []) + [("user", "i"), ("assistant", "")]


def test_default_system_reaches_no_other_layout(parsed):
    assert run(parsed, {"prompt": "p", "response": "r"}, default_system="D")[1] == [("user", "p"), ("assistant", "r")]


@pytest.mark.parametrize("value", [None, "", "   ", []])
def test_alpaca_needs_an_instruction(parsed, value):
    assert run(parsed, {"instruction": value, "output": "x"})[3] == "'instruction' is empty"


@pytest.mark.parametrize(
    "record, reply",
    [
        ({"completion": " c ", "response": "r"}, "c"),
        ({"completion": None, "response": "r"}, "r"),
        ({"response": "r"}, "r"),
        ({"completion": "", "response": "r"}, ""),
        ({"completion": None}, ""),
    ],
)
def test_prompt_reply(parsed, record, reply):
    assert run(parsed, {"prompt": " p ", **record})[1] == [("user", "p"), ("assistant", reply)]


def test_prompt_must_not_be_blank(parsed):
    assert run(parsed, {"prompt": " ", "completion": "c"})[3] == "'prompt' is empty"


def test_chatml_turns(parsed):
    text = (
        f"noise{OPEN}  System \n be\nbrief \n{CLOSE}{OPEN}\x1cgpt\x1f\nhi{CLOSE}"
        f"{OPEN}narrator\nx{CLOSE}{OPEN}bad1\ny{CLOSE}{OPEN}user\nopen end"
    )
    assert run(parsed, {"text": text})[1] == [("system", "be\nbrief"), ("assistant", "hi"), ("user", "x")]


def test_chatml_without_a_complete_turn(parsed):
    assert run(parsed, {"text": f"{OPEN}user"})[3] == "no complete ChatML turn in 'text'"


def test_text_is_verbatim(parsed):
    assert run(parsed, {"text": " a\tb "}) == ("text", None, " a\tb ", None)


@pytest.mark.parametrize(
    "fmt, record, error",
    [
        ("chatml", {"text": None}, "no complete ChatML turn in 'text'"),
        ("openai", {"text": "x"}, "'messages' must be a list of objects"),
        ("sharegpt", {"messages": []}, "'conversations' must be a list of objects"),
        ("alpaca", {"text": "x"}, "'instruction' is empty"),
    ],
)
def test_explicit_format_errors(parsed, fmt, record, error):
    assert run(parsed, record, fmt)[3] == error


def test_lists_of_strings_with_gaps(parsed):
    record = {"messages": [{"role": "GPT", "content": "a"}, {"role": None, "content": None}, {}, {"content": "b", "role": "x"}]}
    assert run(parsed, record)[1] == [("assistant", "a"), ("user", ""), ("user", ""), ("user", "b")]
    record["messages"].append(None)
    assert run(parsed, record)[3] == "'messages' must be a list of objects"


def test_explicit_text_format_coerces(parsed):
    assert run(parsed, {}, "text")[2] == ""
    assert run(parsed, {"text": ["a", "b"]}, "text")[2] == "a\nb"


def test_duplicate_keys_keep_the_last(parsed):
    assert run(parsed, '{"text":"a","text":"b"}')[2] == "b"


def test_error_policies(parsed):
    records = parsed([{"text": "a"}, {"foo": 1}, {"instruction": ""}])
    assert normalize(records, on_error="skip").count() == 1
    assert normalize(records, on_error="quarantine").filter("error IS NOT NULL").count() == 2
    with pytest.raises(PySparkException, match="no known layout|'instruction' is empty"):
        normalize(records).collect()
    with pytest.raises(ValueError):
        normalize(records, on_error="ignore")
    with pytest.raises(ValueError):
        normalize(records, "yaml")


def test_register_format(parsed, monkeypatch):
    monkeypatch.setattr(formats, "_added", [])
    register_format(
        Format(
            "qa",
            lambda v: F.try_variant_get(v, "$.q", "string").isNotNull(),
            messages="array(named_struct('role', 'user', 'content', try_variant_get(v, '$.q', 'string')))",
        )
    )
    assert run(parsed, {"q": "why", "text": "ignored"})[:2] == ("qa", [("user", "why")])
    assert run(parsed, {"instruction": "i", "q": "why"})[0] == "alpaca"
    with pytest.raises(ValueError):
        register_format(Format("qa", "true", text="''"))
    with pytest.raises(ValueError):
        register_format(Format("other", "true"))
