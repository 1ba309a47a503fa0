"""How far the sources of a language differ in the terms they use.

Terms are counted per source inside the tasks, in packed form. A term of at most eight
bytes is one uint64 word, one of at most sixteen is two; the words are padded with zero
bytes on the right, which no term holds, so that they sort as the terms do and none needs
its length. Short terms are ordered by a radix sort over 16-bit digits, and runs of equal
words are counted. Longer terms are put into buckets by length, which are sorted as bytes.
The words stay packed until a term is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.common import small_batches
from turnmill.session import materialize

# A term is kept for a language if so many of its documents hold it.
MIN_DOCS = 30
# Added to each count, and what shares are multiplied with.
PRIOR = 5
SCALE = 1_000_000_000
TOP_TERMS = 50

_WORD = 8
_BYTES_A_STEP = 1 << 21
# Counts that a task holds before it gives them on, and rows of a batch that it gives.
_ROWS_HELD = 1 << 20
_LONG_HELD = 1 << 17
_ROWS_OUT = 1 << 15
# A block of the source by term table has about as many cells as there are pairs of
# sources, between these bounds; a tile of pairs has at most so many pairs.
_LEAST_CELLS, _BLOCK_CELLS = 1 << 16, 1 << 20
# Term bytes are ASCII letters and all of a code point beyond ASCII; only A-Z change.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IN_TERM = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])
_PACKED = ["w1", "w2", "long_term"]
_PARTIAL = "lang string, source string, w1 long, w2 long, long_term binary, n long, docs long"


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """The stable order of rows of uint64 words, the first word being the highest.

    From the lowest 16-bit digit to the highest; digits that are alike in all rows are
    passed over.
    """
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 64, 16):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                # NumPy sorts 16-bit integers by radix.
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def find_terms(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of a lower-cased text begin, and their lengths in bytes."""
    inside = np.zeros(len(body) + 2, bool)
    inside[1:-1] = _IN_TERM[np.frombuffer(body, np.uint8)]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2] - edges[::2]


def pack(body: bytes, starts: np.ndarray, lengths: np.ndarray, words: int) -> list[np.ndarray]:
    """The terms, of at most ``8 * words`` bytes, as rows of that many uint64 words."""
    padded = body + bytes(_WORD * words)
    # The eight bytes from every place on, read where a term needs them.
    at_each = np.ndarray(len(padded) - _WORD + 1, ">u8", padded, strides=(1,))
    out = []
    for i in range(words):
        used = np.clip(lengths - _WORD * i, 0, _WORD)
        unused = ((_WORD - np.maximum(used, 1)) * 8).astype(np.uint64)
        word = at_each[starts + _WORD * i].astype(np.uint64)
        out.append(np.where(used > 0, word >> unused << unused, np.uint64(0)))
    return out


def _runs(changes: np.ndarray, groups: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ordered terms, ``changes`` true where a new one begins: the first row of each run
    of (term, group), its rows, and its documents. Rows of a term are in order of groups and
    documents."""
    new_run = changes.copy()
    new_run[1:] |= groups[1:] != groups[:-1]
    new_doc = new_run.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    first = np.flatnonzero(new_run)
    return first, np.diff(first, append=len(changes)), np.add.reduceat(new_doc.astype(np.int64), first)


def count_short(body: bytes, starts: np.ndarray, lengths: np.ndarray, words: int, groups: np.ndarray, docs: np.ndarray):
    """Arrays (w1, w2, group, n, documents) of terms of at most eight bytes a word."""
    packed = pack(body, starts, lengths, words)
    order = radix_order(packed)
    packed = [w[order] for w in packed]
    changes = np.zeros(len(order), bool)
    changes[0] = True
    for w in packed:
        changes[1:] |= w[1:] != w[:-1]
    first, n, of_docs = _runs(changes, groups[order], docs[order])
    w2 = packed[1][first] if words > 1 else np.zeros(len(first), np.uint64)
    return packed[0][first], w2, groups[order][first], n, of_docs


def count_long(body: bytes, starts: np.ndarray, lengths: np.ndarray, groups: np.ndarray, docs: np.ndarray):
    """Rows (term, group, n, documents) of longer terms, a bucket for each doubling of length."""
    out = []
    doubling = np.frexp(lengths.astype(np.float64) - 0.5)[1]
    for size in np.unique(doubling).tolist():
        own = np.flatnonzero(doubling == size)
        terms = np.array([body[a : a + k] for a, k in zip(starts[own].tolist(), lengths[own].tolist(), strict=True)])
        order = np.argsort(terms, kind="stable")
        terms, of_group, of_doc = terms[order], groups[own][order], docs[own][order]
        changes = np.ones(len(order), bool)
        changes[1:] = terms[1:] != terms[:-1]
        first, n, of_docs = _runs(changes, of_group, of_doc)
        out += zip(terms[first].tolist(), of_group[first].tolist(), n.tolist(), of_docs.tolist(), strict=True)
    return out


class TermCounts:
    """Counts of a task: packed terms of its (lang, source) groups, and longer terms."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.rows = 0
        self.long: dict[tuple[bytes, int], list[int]] = {}

    def add(self, langs: list[str], sources: list[str], bodies: list[bytes]) -> None:
        """Count the terms of some documents."""
        own = [self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources, strict=True)]
        order = sorted(range(len(bodies)), key=own.__getitem__)
        body = b"\0".join(bodies[i] for i in order).translate(_LOWER)
        starts, lengths = find_terms(body)
        docs = np.searchsorted(np.cumsum([len(bodies[i]) + 1 for i in order]), starts, "right")
        groups = np.array([own[i] for i in order])[docs]
        for words in (1, 2):
            at = np.flatnonzero((lengths > _WORD * (words - 1)) & (lengths <= _WORD * words))
            if len(at):
                self._keep(count_short(body, starts[at], lengths[at], words, groups[at], docs[at]))
        at = np.flatnonzero(lengths > 2 * _WORD)
        if len(at):
            for term, group, n, of_docs in count_long(body, starts[at], lengths[at], groups[at], docs[at]):
                counts = self.long.setdefault((term, group), [0, 0])
                counts[0] += n
                counts[1] += of_docs
        if self.rows >= _ROWS_HELD and len(self.parts) > 1:
            self._merge()

    def _keep(self, part: tuple[np.ndarray, ...]) -> None:
        self.parts.append(part)
        self.rows += len(part[0])

    def _merge(self) -> None:
        """One row for each packed term of a group."""
        w1, w2, group, n, docs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = radix_order([w1, w2, group.astype(np.uint64)])
        w1, w2, group = w1[order], w2[order], group[order]
        first = np.flatnonzero(np.concatenate(([True], (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (group[1:] != group[:-1]))))
        self.parts, self.rows = [], 0
        self._keep((w1[first], w2[first], group[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)))

    @property
    def full(self) -> bool:
        return self.rows >= _ROWS_HELD or len(self.long) >= _LONG_HELD

    def rows_out(self) -> Iterator[pa.RecordBatch]:
        """What was counted, in small batches; nothing is held any more."""
        names = [c.split(" ")[0] for c in _PARTIAL.split(", ")]
        known = [pa.array([x[k] for x in self.groups], pa.string()) for k in (0, 1)]
        if self.parts:
            self._merge()
            w1, w2, group, n, docs = self.parts[0]
            for at in range(0, len(w1), _ROWS_OUT):
                cut = slice(at, at + _ROWS_OUT)
                of_group = pa.array(group[cut].astype(np.int32))
                words = [pa.array(w[cut].view(np.int64)) for w in (w1, w2)]
                counts = [pa.array(c[cut].astype(np.int64)) for c in (n, docs)]
                yield pa.RecordBatch.from_arrays([*(k.take(of_group) for k in known), *words, pa.nulls(len(of_group), pa.binary()), *counts], names)
        long = list(self.long.items())
        for at in range(0, len(long), _ROWS_OUT):
            rows = long[at : at + _ROWS_OUT]
            of_group = pa.array([g for (_, g), _ in rows], pa.int32())
            none = pa.array(np.zeros(len(rows), np.int64))
            counts = [pa.array([c[k] for _, c in rows], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(k.take(of_group) for k in known), none, none, pa.array([t for (t, _), _ in rows], pa.binary()), *counts], names)
        self.parts, self.rows, self.long = [], 0, {}


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, w1, w2, long_term, n, docs`` for each term of each group of the
    documents ``lang, source, body``: how often it occurs, and in how many rows.

    Each task counts step by step, about two megabytes of text or one longer document at
    a time, and adds up what it counted until that is a million rows. Sums are added up
    before the one shuffle, keyed by group and term, so that a source with most of the
    rows is spread by its terms.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = TermCounts()
        for batch in batches:
            langs, sources, bodies = (c.to_pylist() for c in batch.columns)
            at, size = 0, 0
            for i, body in enumerate(bodies, 1):
                size += len(body)
                if size >= _BYTES_A_STEP or i == len(bodies):
                    counts.add(langs[at:i], sources[at:i], bodies[at:i])
                    at, size = i, 0
                    if counts.full:
                        yield from counts.rows_out()
        yield from counts.rows_out()

    counted = docs.select("lang", "source", "body").mapInArrow(run, _PARTIAL)
    return counted.groupBy("lang", "source", *_PACKED).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * kept)), exactly."""
    top = (n.cast("decimal(20,0)") + PRIOR) * SCALE
    return F.call_function("div", top, total.cast("decimal(20,0)") + PRIOR * kept) + 1


def spelled() -> Column:
    """The term that ``w1, w2, long_term`` stand for."""
    both = F.concat(*[F.lpad(F.hex(c), 2 * _WORD, "0") for c in ("w1", "w2")])
    return F.coalesce("long_term", F.unhex(F.regexp_replace(both, "(00)+$", ""))).cast("string")


def _block_sums(key: tuple, cells: pd.DataFrame, about: pd.DataFrame) -> pd.DataFrame:
    """Sums over the terms of one block of a language, for each source of a tile and each
    other source of the language."""
    kept, totals, tiles = (about[c].iloc[0] for c in ("kept", "totals", "tiles"))
    kept, totals = int(kept), np.asarray(totals, np.int64)
    ids, column = np.unique(cells["term_id"].to_numpy(np.int64), return_inverse=True)
    counts = np.zeros((len(totals), len(ids)), np.int64)
    counts[cells["number"].to_numpy(np.int64), column] = cells["n"].to_numpy(np.int64)
    # Python's integers where the product could pass 64 bits.
    exact = counts if not counts.size or counts.max() < (1 << 63) // SCALE - PRIOR else counts.astype(object)
    shares = (1 + (exact + PRIOR) * SCALE // (totals + PRIOR * kept)[:, None]).astype(np.int64) if kept else counts
    tile = range(int(key[2]), len(totals), int(tiles))
    values = np.array([np.abs(shares - shares[a]).sum(axis=1) for a in tile]).reshape(len(tile), len(totals))
    rows = pd.DataFrame({"a": np.repeat(np.array(tile), len(totals)), "b": np.tile(np.arange(len(totals)), len(tile)), "value": values.reshape(-1)})
    return rows[rows["a"] != rows["b"]].assign(lang=key[0])[["lang", "a", "b", "value"]]


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", *, min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: what sets each source of a language apart.

    Part ``pair`` has every other source of the language, with the difference of their
    term shares summed over all kept terms; part ``term`` the ``top`` terms whose share is
    above the language's. A language keeps the terms that ``min_docs`` of its rows hold.
    Null texts, languages and sources are empty ones; a source without terms has shares
    from the prior alone, a language without kept terms differences of 0. Repeated rows
    count each time. An empty table gives no rows. Equal values are ranked by item, in
    order of UTF-8. One text has to fit a task; results are exact.
    """
    empty = F.lit("")
    rows = small_batches(docs).select(
        F.coalesce(docs[lang].cast("string"), empty).alias("lang"),
        F.coalesce(docs[source].cast("string"), empty).alias("source"),
        F.coalesce(docs[text], empty).cast("binary").alias("body"),
    )
    groups = rows.select("lang", "source").distinct()
    counted = materialize(count_terms(rows), "terms")
    # The identity of a kept term: its place in a table that is written once.
    kept = counted.groupBy("lang", *_PACKED).agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = materialize(kept.select("lang", *_PACKED, "lang_n", F.monotonically_increasing_id().alias("term_id")), "kept-terms")
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"k.{c}")) if c == "long_term" else F.col(f"c.{c}") == F.col(f"k.{c}") for c in ("lang", *_PACKED)]
    packed = [F.col(f"k.{c}") for c in _PACKED]
    cells = counted.alias("c").join(kept.alias("k"), same).select("c.lang", "c.source", "k.term_id", *packed, "c.n", "k.lang_n")
    cells = materialize(cells, "kept-counts")
    # A row for each language, and one for each source of it.
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("number")
    none = F.lit(0).cast("long")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select(
        "lang", "source", number, F.coalesce("total", none).alias("total"), F.coalesce("kept", none).alias("kept"), F.coalesce("lang_total", none).alias("lang_total")
    )
    groups = materialize(groups, "sources")
    result = _pairs(cells, groups).unionByName(_terms(cells, groups, top))
    return result.select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", place)


def _pairs(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """Every pair of sources of a language. The sources by terms table of a language is cut
    by terms into blocks, which are added up pair by pair. A task has one block and a tile
    of at most about a million pairs; up to a thousand sources are one tile."""
    about = groups.groupBy("lang", "kept").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "total"))), lambda s: s["total"]).alias("totals"))
    size = F.size("totals").cast("long")
    pieces = lambda cells, each: F.greatest(F.ceil(cells / each), F.lit(1)).cast("int")
    most = F.lit(_BLOCK_CELLS).cast("long")
    block = F.least(F.greatest(F.lit(min(_LEAST_CELLS, _BLOCK_CELLS)).cast("long"), size * size), most)
    about = about.withColumns({"blocks": pieces(F.col("kept") * size, block), "tiles": F.least(pieces(size * size, most), size).cast("int")})
    about = materialize(about, "languages")
    number = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    named = groups.select("lang", "source", "number")
    blocked = cells.join(named, ["lang", "source"]).join(about.select("lang", "blocks", "tiles"), "lang")
    blocked = blocked.select("lang", F.pmod(F.xxhash64("term_id"), "blocks").cast("int").alias("block"), number("tiles").alias("tile"), "term_id", "number", "n")
    each = about.withColumn("block", number("blocks")).withColumn("tile", number("tiles"))
    keys = ["lang", "block", "tile"]
    sums = blocked.groupBy(*keys).cogroup(each.groupBy(*keys)).applyInPandas(_block_sums, "lang string, a int, b int, value long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    one = named.withColumnRenamed("number", "a")
    other = named.select("lang", F.col("source").alias("item"), F.col("number").alias("b"))
    return _ranked(sums.join(one, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value"))


def _terms(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """The terms that a source has more of than its language, the ``top`` of each."""
    placed = cells.join(groups, ["lang", "source"])
    own, whole = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    above = placed.select("lang", "source", *_PACKED, own.alias("p"), whole.alias("q")).filter("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), spelled().alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= top)
