"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from a seed and its code
point. A letter trigram is bound by multiplying the vectors of its letters, the
first rotated twice, the second once. A text is the sum of its trigrams' vectors,
a language's prototype the sum of its texts', each text weighing the same; a text
gets the language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.common import own_memory, small_batches

UNKNOWN = "und"
_DIMENSIONS = 1024
_SPACE = 32
_CODE_BITS = 21
_DOCS_A_STEP = 128
_CHARS_A_STEP = 1 << 20
_TRIGRAMS_A_STEP = 8192
# Weight of one text in a prototype, dealt to its trigrams as whole numbers so
# that sums don't depend on their order.
_WEIGHT = 1 << 20

_LETTERS: dict[int, np.ndarray] = {}
_IS_LETTER: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point itself if it is a letter, else a space."""
    if not _IS_LETTER:
        codes = np.arange(0x110000, dtype=np.uint32)
        letters = np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        _IS_LETTER.append(np.where(letters, codes, _SPACE).astype(np.uint32))
    return _IS_LETTER[0]


def _letter_vectors(codes: np.ndarray, seed: int) -> np.ndarray:
    if len(_LETTERS) > 50_000:
        _LETTERS.clear()
    for c in codes.tolist():
        if c not in _LETTERS:
            bits = np.random.Generator(np.random.Philox(key=[seed, c])).integers(0, 2, _DIMENSIONS)
            _LETTERS[c] = (bits * 2 - 1).astype(np.int8)
    return np.stack([_LETTERS[c] for c in codes.tolist()])


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a whole text and their counts.

    Letters are lower-cased; each run of other characters counts as one space, as
    do the text's ends. Empty for a text without letters.
    """
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    tail = np.array([_SPACE], np.int64)
    for at in range(0, max(len(text), 1), _CHARS_A_STEP):
        piece = text[at : at + _CHARS_A_STEP].lower()
        codes = _letter_table()[np.frombuffer(piece.encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
        codes = np.concatenate((tail, codes, [_SPACE] if at + _CHARS_A_STEP >= len(text) else []))
        codes = codes.astype(np.int64)
        codes = codes[np.concatenate(([True], (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)))]
        tail = codes[-2:]
        if len(codes) > 2:
            found, n = np.unique(codes[:-2] << 2 * _CODE_BITS | codes[1:-1] << _CODE_BITS | codes[2:], return_counts=True)
            if not len(keys):
                keys, counts = found, n
            else:
                joined, where = np.unique(np.concatenate((keys, found)), return_inverse=True)
                counts = np.bincount(where, np.concatenate((counts, n)), len(joined)).astype(np.int64)
                keys = joined
    return keys, counts


def _trigram_vectors(keys: np.ndarray, seed: int) -> np.ndarray:
    mask = (1 << _CODE_BITS) - 1
    parts = [keys >> 2 * _CODE_BITS & mask, keys >> _CODE_BITS & mask, keys & mask]
    codes, where = np.unique(np.concatenate(parts), return_inverse=True)
    own = _letter_vectors(codes, seed)
    first, second, third = np.split(where, 3)
    return np.roll(own, 2, axis=1)[first] * np.roll(own, 1, axis=1)[second] * own[third]


def text_vectors(grams: list[tuple[np.ndarray, np.ndarray]], seed: int) -> np.ndarray:
    """The bundled vector of each text, from its trigrams."""
    all_keys, all_counts = np.concatenate([k for k, _ in grams]), np.concatenate([n for _, n in grams])
    keys, where = np.unique(all_keys, return_inverse=True)
    rows = np.repeat(np.arange(len(grams)), [len(k) for k, _ in grams])
    out = np.zeros((len(grams), _DIMENSIONS), np.float32)
    # So many trigrams at a time, however many the texts have.
    order = np.argsort(where, kind="stable")
    edges = np.searchsorted(where[order], np.arange(0, len(keys) + _TRIGRAMS_A_STEP, _TRIGRAMS_A_STEP))
    for step, at in enumerate(range(0, len(keys), _TRIGRAMS_A_STEP)):
        own = order[edges[step] : edges[step + 1]]
        vectors = _trigram_vectors(keys[at : at + _TRIGRAMS_A_STEP], seed).astype(np.float32)
        counts = np.zeros((len(grams), len(vectors)), np.float32)
        counts[rows[own], where[own] - at] = all_counts[own]
        out += counts @ vectors
    return out


def _merge(a: tuple[np.ndarray, np.ndarray] | None, grams: list[tuple[np.ndarray, np.ndarray]]):
    parts = grams if a is None else [a, *grams]
    keys, where = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    sums = np.zeros(len(keys), np.int64)
    np.add.at(sums, where, np.concatenate([n for _, n in parts]))
    return keys, sums


def learn_profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", seed: int = 7) -> DataFrame:
    """One row ``lang, profile`` (array of long) for each language with letters.

    Rows with a null text or language, or without letters, teach nothing. Each task
    adds up its rows; the sums of tasks are added per language and dimension, so
    no task sees more than partial sums. The result is one vector a language.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, len(batch), _DOCS_A_STEP):
                step: dict[str, list] = {}
                part = batch.iloc[at : at + _DOCS_A_STEP]
                for body, name in zip(part["text"], part["lang"], strict=True):
                    keys, counts = trigrams(body)
                    if len(keys):
                        step.setdefault(name, []).append((keys, counts * _WEIGHT // counts.sum()))
                for name, grams in step.items():
                    sums[name] = _merge(sums.get(name), grams)
        for name, (keys, weights) in sums.items():
            total = np.zeros(_DIMENSIONS, np.int64)
            for at in range(0, len(keys), 8192):
                total += weights[at : at + 8192] @ _trigram_vectors(keys[at : at + 8192], seed).astype(np.int64)
            yield pd.DataFrame({"lang": [name], "part": [total]})

    rows = small_batches(labelled).select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    parts = rows.mapInPandas(own_memory(partial), "lang string, part array<bigint>").select("lang", F.posexplode("part").alias("at", "x"))
    by_place = parts.groupBy("lang", "at").agg(F.sum("x").alias("x"))
    vector = F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"])
    return by_place.groupBy("lang").agg(vector.alias("profile"))


def identify(docs: DataFrame, profiles: DataFrame, id_columns: list[str], text: str = "text", seed: int = 7) -> DataFrame:
    """The ``id_columns`` of every row with ``lang_pred``, ``score`` and ``n_trigrams``.

    ``score`` is the cosine, 0 where it is negative; equal cosines go to the first
    language in order. A null text, one without letters, and any text when nothing
    was learned give ``und`` and 0. Whole texts are read; ``n_trigrams`` counts all of a
    text's. ``profiles``, one vector for each language, comes to the driver.
    """
    learned = sorted((r["lang"], r["profile"]) for r in profiles.collect())
    names = [name for name, _ in learned]
    matrix = np.array([p for _, p in learned], np.float64).reshape(len(names), _DIMENSIONS)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((matrix / np.where(norms == 0, 1, norms)).astype(np.float32))
    kept = [f"_kept_{i}" for i in range(len(id_columns))]
    source = small_batches(docs).select(*[docs[c].alias(k) for c, k in zip(id_columns, kept, strict=True)], docs[text].alias("_body"))
    schema = T.StructType(source.schema.fields[:-1]).add("lang_pred", T.StringType()).add("score", T.DoubleType()).add("n_trigrams", T.LongType())

    def predict(batches: Iterator) -> Iterator:
        import pyarrow as pa

        prototypes = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, _DOCS_A_STEP):
                part = batch.slice(at, _DOCS_A_STEP)
                grams = [trigrams(t or "") for t in part.column(len(kept)).to_pylist()]
                found, score = [UNKNOWN] * len(grams), np.zeros(len(grams))
                some = [i for i, (k, _) in enumerate(grams) if len(k)]
                if some and names:
                    vectors = text_vectors([grams[i] for i in some], seed)
                    length = np.linalg.norm(vectors, axis=1, keepdims=True)
                    cosine = vectors @ prototypes.T / np.where(length == 0, 1, length)
                    best = cosine.argmax(axis=1)
                    for i, b in zip(some, best.tolist(), strict=True):
                        found[i] = names[b]
                    score[some] = np.clip(cosine[np.arange(len(some)), best], 0, 1)
                size = pa.array([int(n.sum()) for _, n in grams], pa.int64())
                columns = [*part.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64()), size]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "n_trigrams"])

    found = source.mapInArrow(own_memory(predict), schema)
    return found.toDF(*id_columns, "lang_pred", "score", "n_trigrams")
