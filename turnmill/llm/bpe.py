"""BPE as a deterministic automaton over tokens.

The merges are compiled one by one. An automaton reads token sequences; its arcs
are labelled with tokens and it accepts exactly the sequences that BPE produces.
It begins as one state with a loop for each byte. The gadget of a merge (u, v)

* splits the state that arcs labelled u lead to, and takes the arc v out of the
  copy, so that u is never followed by v any more;
* adds an arc labelled uv wherever there is one labelled u, which leads where the
  arc v led.

All arcs of one label lead to the same state, so the automaton is a table: the
state of each label, and a bit for each (state, class of labels). Labels that are
allowed after the same states share a class until a gadget tells them apart.

A word has exactly one accepted path that spells it. It is found from left to
right: from each position, whose last label is already known, follow the trie of
labels along the bytes and take those that the table allows. Decoding emits the
labels of the arcs.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from turnmill.llm.common import hold, small_batches

# How byte-level vocabularies cut a text into words before merging,
# in full and for texts of Latin-1 characters.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LETTERS, _NUMBERS, _BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
_LATIN_WORDS = (
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)

_CACHED_WORDS = 200_000
_CACHED_LENGTH = 64
_ROWS_A_STEP = 512
_WORDS_A_STEP = 8192
_CELLS_A_STEP = 1 << 20


def _byte_symbols() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: Latin-1 characters that show
    stand for themselves, the other bytes for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Automaton:
    """``allowed`` packs, for each state, a bit for each class of labels.

    ``state[t]`` is where arcs labelled t lead, ``label_class[t]`` its class, both
    -1 for ids that no merge makes; ``labels[t]`` are its bytes; ``special`` maps the
    texts that are matched before anything else to their ids.
    """

    allowed: np.ndarray
    state: np.ndarray
    label_class: np.ndarray
    labels: list[bytes]
    special: dict[str, int]

    def follows(self, before: int, after: int) -> bool:
        c = int(self.label_class[after])
        return bool(self.allowed[self.state[before], c >> 3] >> (c & 7) & 1)

    def accepts(self, ids: list[int]) -> bool:
        """Whether a word's token sequence is one that BPE produces."""
        return all(self.state[t] >= 0 for t in ids) and all(map(self.follows, ids, ids[1:]))


def _gadgets(letters: list[int], merges: list[tuple[int, int, int]], size: int):
    """What the gadgets of all merges do: rows of (state to copy, its copy, class to copy,
    its copy, state, class of the arc taken out), -1 where nothing is copied; then the
    state and the class of each label, and how many there are of both. None of it
    depends on the table."""
    state, label_class = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    state[letters] = 0
    label_class[letters] = np.arange(len(letters))
    states, classes = 1, len(letters)
    in_state, in_class = {0: len(letters)}, dict.fromkeys(range(len(letters)), 1)
    steps = np.full((len(merges), 6), -1, np.int32)
    for step, (u, v, joined) in zip(steps, merges, strict=True):
        led_to = state[v]
        if in_state[int(state[u])] > 1 or u == v:
            step[:2] = state[u], states
            in_state[int(state[u])] -= 1
            state[u], in_state[states] = states, 1
            states += 1
        if in_class[int(label_class[v])] > 1:
            step[2:4] = label_class[v], classes
            in_class[int(label_class[v])] -= 1
            label_class[v], in_class[classes] = classes, 1
            classes += 1
        step[4:] = state[u], label_class[v]
        state[joined], label_class[joined] = led_to if u == v else state[v], label_class[u]
        in_state[int(state[joined])] += 1
        in_class[int(label_class[joined])] += 1
    return steps, state, label_class, states, classes


def _apply_gadgets(letters: list[int], merges: list[tuple[int, int, int]], size: int):
    """The table after all gadgets. It is packed from the start and allocated once, at
    its final size, since its rows and columns are known before its bits."""
    steps, state, label_class, states, classes = _gadgets(letters, merges, size)
    table = np.zeros((states, -(-classes // 8)), np.uint8)
    table[0] = np.packbits(np.arange(8 * table.shape[1]) < len(letters), bitorder="little")
    used = 1
    for own, copy, own_class, copy_class, without, label in map(np.ndarray.tolist, steps):
        if copy >= 0:
            table[copy] = table[own]
            used = copy + 1
        if copy_class >= 0:
            bits = table[:used, own_class >> 3] >> (own_class & 7) & 1
            table[:used, copy_class >> 3] |= bits << (copy_class & 7)
        table[without, label >> 3] &= 255 ^ 1 << (label & 7)
    return table, state, label_class


def compile_automaton(path: str) -> Automaton:
    """The automaton of a byte-level BPE file in the JSON form of public tokenizers.

    Runs once, on the driver; the table grows with the vocabulary alone (20 MB for
    50,000 merges). Normalisers, prefix spaces and other models are refused.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
        raise ValueError("only byte-level vocabularies without a normaliser are supported")
    if not before.get("use_regex", True) or model.get("ignore_merges") or model.get("dropout"):
        raise ValueError("unsupported options in the vocabulary file")
    symbols, vocab = _byte_symbols(), model["vocab"]
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", ())):
        raise ValueError("added tokens must match as they stand")
    size = max([*vocab.values(), *special.values()]) + 1
    labels = [b""] * size
    for token, number in vocab.items():
        labels[number] = bytes(symbols[c] for c in token)
    for token, number in special.items():
        labels[number] = token.encode()
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in pairs]
    letters = [vocab[s] for s in symbols if s in vocab]
    if len(letters) != 256:
        raise ValueError("the vocabulary lacks bytes")
    return Automaton(*_apply_gadgets(letters, merges, size), labels, special)


class Encoder:
    """Drives an automaton over texts. Holds a bounded cache of words."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.table = np.ascontiguousarray(automaton.allowed)
        self.state = automaton.state
        self.byte, self.bit = automaton.label_class >> 3, (automaton.label_class & 7).astype(np.uint8)
        self.length = np.array([len(x) for x in automaton.labels])
        self._build_trie()
        self.full, self.latin = regex.compile(_WORDS), re.compile(_LATIN_WORDS)
        special = sorted(automaton.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cache: dict[str, bytes] = {}

    def _build_trie(self) -> None:
        """``step[node, byte]`` is the next node, -1 if there is none; ``ends[node]``
        the label that ends there. Nodes without successors have the last numbers."""
        nodes, succ, ends = {b"": 0}, set(), {}
        for number, label in enumerate(self.automaton.labels):
            if self.state[number] < 0:
                continue
            for n in range(1, len(label) + 1):
                nodes.setdefault(label[:n], len(nodes))
                succ.add(label[: n - 1])
            ends[label] = number
        order = sorted(nodes, key=lambda x: (x not in succ, nodes[x]))
        place = {x: i for i, x in enumerate(order)}
        self.inner = len(succ)
        self.step = np.full((self.inner, 256), -1, np.int32)
        self.ends = np.full(len(order), -1, np.int32)
        for x, i in place.items():
            if x:
                self.step[place[x[:-1]], x[-1]] = i
            self.ends[i] = ends.get(x, -1)

    def paths(self, words: list[bytes]) -> list[bytes]:
        """For each word the ids of the one accepted path that spells it, packed.

        Goes through all words side by side, position by position. ``last[w, j]``
        is the last label of the path that spells the first j bytes.
        """
        if not words:
            return []
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        last = np.full((len(words), width + 1), -1, np.int32)
        for i in range(width):
            own = np.flatnonzero((sizes > i) & (last[:, i] >= 0) if i else sizes > 0)
            state = self.state[last[own, i]] if i else None
            node = np.zeros(len(own), np.int32)
            for j in range(i, width):
                node = self.step[node, letters[own, j]]
                going = (node >= 0) & (sizes[own] > j)
                own, node = own[going], node[going]
                state = state[going] if i else None
                if not len(own):
                    break
                label = self.ends[node]
                ending = np.flatnonzero(label >= 0)
                labels = label[ending]
                if i:
                    allowed = self.table[state[ending], self.byte[labels]] >> self.bit[labels] & 1
                    ending, labels = ending[allowed == 1], labels[allowed == 1]
                last[own[ending], j + 1] = labels
                further = node < self.inner
                own, node = own[further], node[further]
                state = state[further] if i else None
                if not len(own):
                    break
        # Follow all paths back from the ends of the words.
        out = np.zeros((len(words), width), "<u4")
        count, at = np.zeros(len(words), np.int64), sizes.copy()
        while (own := np.flatnonzero(at > 0)).size:
            label = last[own, at[own]]
            count[own] += 1
            out[own, width - count[own]] = label
            at[own] -= self.length[label]
        raw, row = out.tobytes(), 4 * width
        return [raw[(k + 1) * row - 4 * c : (k + 1) * row] for k, c in enumerate(count.tolist())]

    def split(self, text: str) -> list[str]:
        # The pattern for Latin-1 gives the same words faster.
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.full.findall(text)
        return self.latin.findall(text)

    def _learn(self, words: set[str]) -> Mapping[str, bytes]:
        """The ids of all ``words``; short ones stay in the cache."""
        new = sorted((w for w in words if w not in self.cache), key=len)
        if len(self.cache) + len(new) > _CACHED_WORDS:
            self.cache.clear()
            new = sorted(words, key=len)
        found: dict[str, bytes] = {}
        raw = [w.encode() for w in new]
        at = 0
        while at < len(new):
            # Words of similar length go side by side; the last of a step is the longest.
            step = max(1, min(_WORDS_A_STEP, _CELLS_A_STEP // (len(raw[min(at + _WORDS_A_STEP, len(new)) - 1]) + 1)))
            found.update(zip(new[at : at + step], self.paths(raw[at : at + step]), strict=True))
            at += step
        long = {w: x for w, x in found.items() if len(w) > _CACHED_LENGTH}
        self.cache.update((w, x) for w, x in found.items() if w not in long)
        return {**{w: self.cache[w] for w in words if w not in long}, **long} if long else self.cache

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        parts: list[list] = []
        for text in texts:
            if self.special is None or not self.special.search(text):
                parts.append([(self.split(text), b"")])
                continue
            own, at = [], 0
            for m in self.special.finditer(text):
                own.append((self.split(text[at : m.start()]), self.automaton.special[m[0]].to_bytes(4, "little")))
                at = m.end()
            parts.append([*own, (self.split(text[at:]), b"")])
        known = self._learn({w for own in parts for words, _ in own for w in words})
        return [b"".join(x for words, mark in own for x in (*map(known.__getitem__, words), mark)) for own in parts]

    def decode(self, packed: bytes) -> str:
        """Emit the labels of the ids. Bytes that are no UTF-8 become U+FFFD."""
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.automaton.labels.__getitem__, ids)).decode("utf-8", "replace")


def _encoder(shared: Broadcast) -> Encoder:
    """One encoder for a Python worker, kept between tasks until one of another operator comes."""
    return hold((__name__, getattr(shared, "_jid", None) or id(shared)), lambda: Encoder(shared.value))


def encode_documents(
    docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, *, decoded: bool = False
) -> DataFrame:
    """The ``keep`` columns (all by default) with ``ids`` and ``n_tokens``.

    ``ids`` is binary, little-endian unsigned 32-bit integers, of the whole text; a
    null text counts as empty. ``decoded`` adds the text that decoding those ids
    gives. Columns of these names in ``docs`` are replaced. A narrow map: rows are
    not shuffled, one text must fit a task.
    """
    made = ["ids", "n_tokens", *(["decoded"] if decoded else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(compile_automaton(path))
    source = small_batches(docs).select(*[docs[c] for c in kept], docs[text].alias("_encoded_text"))
    schema = T.StructType(source.schema.fields[:-1]).add("ids", T.BinaryType()).add("n_tokens", T.LongType())
    if decoded:
        schema = schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                part = batch.slice(at, _ROWS_A_STEP)
                ids = encoder.encode([t or "" for t in part.column(len(kept)).to_pylist()])
                columns = [*part.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array([encoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    return source.mapInArrow(run, schema)
