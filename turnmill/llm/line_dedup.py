"""Removal of repeated passages, runs of lines that occur earlier in the table.

Content-defined line chunks are found on two levels:

1. A rolling hash over the hashes of neighbouring lines chooses boundaries, so they depend
   on the lines around them and not on where in a document they are. A chunk that occurs
   earlier is an anchor: it is joined to its first occurrence and widened line by line to
   both sides, as long as the lines of both documents are the same.
2. A passage may have no such chunk inside it, or lie across the edge of what was found.
   Therefore the shortest passages that begin, and those that end, at each line are chunks
   too, unless they are inside a widened one. What such a chunk holds depends on its own
   lines only, and the chunks inside a run of lines cover all of it.

Both levels together find every repeated passage. The bytes of both occurrences are
compared before anything is cut.

:func:`remove_repeats` cuts whole chunks of the first level only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnmill.llm.common import own_memory, small_batches, whole
from turnmill.session import materialize

_WINDOW = 2
# A boundary follows a line with probability 1 in this.
_DIVISOR = 3
_MIN_LINES = 2
_MAX_LINES = 64
_ROWS_A_STEP = 512
# Id tables of at most so many rows are broadcast; larger ones are joined by shuffle.
_BROADCAST_ROWS = 2_000_000
# A table of rows of any width is broadcast if its Parquet files have at most so many bytes.
_BROADCAST_BYTES = 32 << 20
# A passage of several lines has so many words, those of blank lines being none.
_MIN_WORDS = 10
# A line of so many words is a passage by itself.
_LINE_WORDS = 50
# Texts without spaces: so many bytes, white space apart, count as a word.
_WORD_BYTES = 12
_WINDOW_PRIME = (1 << 127) - 1
_WINDOW_WEIGHT = 0x5BD1E9955BD1E9959E3779B97F4A7C15
_WEIGHT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def chunk_lines(hashes: list[int]) -> list[tuple[int, int]]:
    """(first line, end line) of the chunks of lines with these hashes.

    A boundary follows line i if the rolling hash of the lines up to i says so and
    the chunk has two lines; a chunk ends at 64 lines in any case.
    """
    out, start, rolled = [], 0, 0
    oldest = pow(_WEIGHT, _WINDOW, _MASK + 1)
    for i, h in enumerate(hashes):
        rolled = (rolled * _WEIGHT + h) & _MASK
        if i >= _WINDOW:
            rolled = (rolled - hashes[i - _WINDOW] * oldest) & _MASK
        size = i + 1 - start
        if size >= _MIN_LINES and (size >= _MAX_LINES or (rolled >> 32) % _DIVISOR == 0):
            out.append((start, i + 1))
            start = i + 1
    if start < len(hashes):
        out.append((start, len(hashes)))
    return out


def chunks(text: str) -> list[tuple[int, int]]:
    """The chunks of a text's lines, which ``\\n`` ends."""
    return chunk_lines([xxhash.xxh3_128_intdigest(line) & _MASK for line in text.encode("utf-8", "surrogatepass").split(b"\n")])


def document_key(id_column: str = "doc_id", text: str = "text") -> Column:
    """128 bits that name a document by its id and text."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col(id_column).cast("string"), F.lit("-")), whole(F.col(text))))


def _small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if it has few enough rows."""
    df = materialize(df, "ids")
    return F.broadcast(df) if df.count() <= _BROADCAST_ROWS else df


def _light(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its files have few enough bytes."""
    df = materialize(df, "cuts")
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if size <= _BROADCAST_BYTES else df


def _keyed(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    return small_batches(docs).select(F.col(id_column).cast("long").alias("id"), document_key(id_column, text).alias("key"), whole(F.col(text)).alias("text"))


def _occurrences(keyed: DataFrame, *, with_text: bool) -> DataFrame:
    """One row for each chunk of several lines: id, key, its number, lines and hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "key", "chunk", "lines", "hash", *(["body"] if with_text else [])]
        types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                rows = []
                part = batch.slice(at, _ROWS_A_STEP)
                for own, key, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    lines = text.split("\n")
                    for number, (a, b) in enumerate(chunks(text)):
                        if b - a >= _MIN_LINES:
                            body = "\n".join(lines[a:b])
                            rows.append((own, key, number, b - a, xxhash.xxh3_128_hexdigest(body.encode("utf-8", "surrogatepass")), body)[: len(names)])
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    schema = "id long, key string, chunk int, lines int, hash string"
    return keyed.mapInArrow(own_memory(run), schema + (", body string" if with_text else ""))


def repeated_chunks(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``id, key, chunk, lines`` of the chunks to remove: all but the first
    occurrence of a repeated chunk, by id (null ids first), key and place."""
    keyed = _keyed(docs, id_column, text)
    found = materialize(_occurrences(keyed, with_text=False), "chunks")
    # Rows that are equal in id and text count as one document.
    found = found.groupBy("id", "key", "chunk", "lines", "hash").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    place = F.struct("id", "key", "chunk")
    many = found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    many = materialize(many.select("hash", F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key"), F.col("first.chunk").alias("first_chunk")), "repeated")
    involved = materialize(found.join(many, "hash"), "involved")
    ids = _small(involved.select("id").distinct())
    texts = keyed.join(ids, "id", "left_semi").union(keyed.filter("id is null"))
    # Both sides of the comparison come from the texts themselves.
    bodies = _occurrences(texts, with_text=True).join(_small(many.select("hash")), "hash", "left_semi")
    bodies = materialize(bodies.groupBy("id", "key", "chunk", "lines", "hash").agg(F.first("body").alias("body")), "bodies")
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")) & (F.col("chunk") == F.col("first_chunk"))
    placed = bodies.join(many, "hash")
    stays = placed.filter(is_first).select("hash", F.col("body").alias("kept"))
    rest = placed.filter(~is_first).select("id", "key", "chunk", "lines", "hash", "body")
    return rest.join(stays, "hash").filter(F.col("body") == F.col("kept")).select("id", "key", "chunk", "lines")


def _without(docs: DataFrame, cuts: DataFrame, spans_of: Callable[[str, list], list[tuple[int, int]]], id_column: str, text: str) -> DataFrame:
    """``docs`` without the lines that ``spans_of`` makes of the text and its ``cut``."""
    made = ["n_lines", "removed_lines", "removed"]
    kept = [c for c in docs.columns if c not in made]
    source = docs.select(*[docs[c].alias(f"_{i}") for i, c in enumerate(kept)], document_key(id_column, text).alias("key"))
    joined = source.join(_light(cuts.withColumnRenamed("key", "_key")), F.col("key") == F.col("_key"), "left")
    place = kept.index(text)
    rows = joined.select(*[f"_{i}" for i in range(len(kept))], "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                part = batch.slice(at, _ROWS_A_STEP)
                texts, counts, cut_lines, removed = [], [], [], []
                for body, cut in zip(part.column(place).to_pylist(), part.column(len(kept)).to_pylist(), strict=True):
                    lines = [] if body is None else body.split("\n")
                    gone = spans_of(body, cut) if cut else []
                    dropped = {i for a, b in gone for i in range(a, b)}
                    texts.append("\n".join(x for i, x in enumerate(lines) if i not in dropped) if dropped else body)
                    counts.append(len(lines))
                    cut_lines.append(len(dropped))
                    removed.append([{"start": a, "end": b} for a, b in gone])
                columns = list(part.columns[:-1])
                columns[place] = pa.array(texts, columns[place].type)
                columns += [pa.array(counts, pa.int32()), pa.array(cut_lines, pa.int32()), pa.array(removed, spans)]
                yield pa.RecordBatch.from_arrays(columns, [*(f"_{i}" for i in range(len(kept))), *made])

    spans_type = T.ArrayType(T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType()))
    schema = T.StructType(rows.schema.fields[:-1]).add("n_lines", T.IntegerType())
    schema = schema.add("removed_lines", T.IntegerType()).add("removed", spans_type)
    return rows.mapInArrow(own_memory(run), schema).toDF(*kept, *made)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of the text, and ``n_lines``,
    ``removed_lines`` and ``removed`` (array of the (start, end) line spans).

    Single lines are no chunks of several lines and stay. A null text stays null
    and has no lines. Rows that are equal in id and text count as one document and
    are cut alike. A document whose chunks all repeat ends up with an empty text.
    Columns of these three names are replaced, others pass through.
    """
    cuts = repeated_chunks(docs, id_column, text).groupBy("key").agg(F.sort_array(F.collect_set("chunk")).alias("cut"))
    return _without(docs, cuts, lambda body, cut: [span for n, span in enumerate(chunks(body)) if n in set(cut)], id_column, text)


def _words(line: bytes) -> int:
    parts = line.split()
    return max(len(parts), sum(map(len, parts)) // _WORD_BYTES)


def is_passage(lines: int, words: int) -> bool:
    """Whether a run of lines may be cut: two lines with 10 words in all, or one of 50."""
    return words >= (_MIN_WORDS if lines >= _MIN_LINES else _LINE_WORDS)


def line_profile(text: str) -> tuple[bytes, bytes]:
    """The hashes of a text's lines, 16 bytes each, and their words, four bytes each."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    hashes = b"".join(xxhash.xxh3_128_digest(line) for line in lines)
    return hashes, np.fromiter(map(_words, lines), "<u4", len(lines)).tobytes()


class Lines:
    """A profile, and the hash of any run of its lines."""

    def __init__(self, hashes: bytes, words: bytes):
        self.hashes = [int.from_bytes(hashes[at : at + 16], "big") for at in range(0, len(hashes), 16)]
        self.sums = [0, *np.cumsum(np.frombuffer(words, "<u4"), dtype=np.int64).tolist()]
        self.rolled, self.powers = [0], [1]
        for h in self.hashes:
            self.rolled.append((self.rolled[-1] * _WINDOW_WEIGHT + h) % _WINDOW_PRIME)
            self.powers.append(self.powers[-1] * _WINDOW_WEIGHT % _WINDOW_PRIME)

    def is_passage(self, a: int, b: int) -> bool:
        return is_passage(b - a, self.sums[b] - self.sums[a])

    def hash(self, a: int, b: int) -> bytes:
        return ((self.rolled[b] - self.rolled[a] * self.powers[b - a]) % _WINDOW_PRIME).to_bytes(16, "big")


def long_chunks(lines: Lines) -> list[tuple[int, int]]:
    """The chunks of the first level that are passages."""
    return [(a, b) for a, b in chunk_lines([h & _MASK for h in lines.hashes]) if lines.is_passage(a, b)]


def short_chunks(lines: Lines, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The shortest passages that begin or end at each line, without those inside one of
    the ``known`` spans."""
    size, spans, b = len(lines.hashes), set(), 0
    for a in range(size):
        while b < size and (b <= a or not lines.is_passage(a, b)):
            b += 1
        if b <= a or not lines.is_passage(a, b):
            break
        spans.add((a, b))
    a = 0
    for b in range(1, size + 1):
        while a + 1 < b and lines.is_passage(a + 1, b):
            a += 1
        if lines.is_passage(a, b):
            spans.add((a, b))
    # How far the known spans that begin at a line or before it reach.
    reach = [0] * (size + 1)
    for start, end in known:
        reach[start] = max(reach[start], end)
    for i in range(1, size + 1):
        reach[i] = max(reach[i], reach[i - 1])
    return sorted((a, b) for a, b in spans if b > reach[a])


def widened(own: bytes, first: bytes, start: int, end: int, first_start: int) -> tuple[int, int, int]:
    """(start, end, first_start) of a run of the same lines in two documents, as long as it
    can be. ``own`` and ``first`` are the documents' line hashes."""
    line = lambda hashes, i: hashes[16 * i : 16 * i + 16]
    while start and first_start and line(own, start - 1) == line(first, first_start - 1):
        start, first_start = start - 1, first_start - 1
    ahead = start - first_start
    while 16 * end < len(own) and 16 * (end - ahead) < len(first) and line(own, end) == line(first, end - ahead):
        end += 1
    return start, end, first_start


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The lines of ``spans`` as spans that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _profiles(keyed: DataFrame) -> DataFrame:
    """``id, key, hashes, words`` of every document's lines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                part = batch.slice(at, _ROWS_A_STEP)
                made = [line_profile(text) for text in part.column(2).to_pylist()]
                columns = [pa.array([x[k] for x in made], pa.binary()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "key", "hashes", "words"])

    return keyed.mapInArrow(own_memory(run), "id long, key string, hashes binary, words binary")


def _chunk_rows(profiles: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``id, key, start, end, hash`` of the chunks of the first level, or of the second where
    ``known`` (``_key, spans``) has what the first one found."""
    rows = profiles.select("id", "key", "hashes", "words")
    if known is not None:
        rows = profiles.join(known, F.col("key") == F.col("_key"), "left").select("id", "key", "hashes", "words", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["id", "key", "start", "end", "hash"], [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                rows = []
                for own, key, hashes, words, *spans in zip(*(c.to_pylist() for c in batch.slice(at, _ROWS_A_STEP).columns), strict=True):
                    lines = Lines(hashes, words)
                    found = short_chunks(lines, [(s["start"], s["end"]) for s in spans[0] or ()]) if spans else long_chunks(lines)
                    rows += [(own, key, a, b, lines.hash(a, b)) for a, b in found]
                columns = list(zip(*rows, strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(own_memory(run), "id long, key string, start int, end int, hash binary")


def _repeats(found: DataFrame) -> DataFrame:
    """``key, start, end, first_key, first_start`` of the chunks that occur earlier, by id
    (null ids first), key and place."""
    # Rows that are equal in id and text count as one document: their places are equal.
    place = F.struct("id", "key", "start")
    many = found.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(~F.col("first").eqNullSafe(F.col("last")))
    many = materialize(many.select("hash", F.col("first.key").alias("first_key"), F.col("first.start").alias("first_start")), "repeated")
    is_first = (F.col("key") == F.col("first_key")) & (F.col("start") == F.col("first_start"))
    return materialize(found.join(many, "hash").filter(~is_first).select("key", "start", "end", "first_key", "first_start"), "repeats")


def _widened(segments: DataFrame, profiles: DataFrame) -> DataFrame:
    """The segments as long as both documents have the same lines. Those within one document
    are left to the second level."""
    pairs = segments.filter("key != first_key").groupBy("key", "first_key").agg(F.collect_list(F.struct("start", "end", "first_start")).alias("spans"))
    pairs = materialize(pairs, "anchors")
    named = _small(pairs.select("key").union(pairs.select(F.col("first_key").alias("key"))).distinct())
    # Rows that are equal in id and text have one profile.
    lines = materialize(profiles.join(named, "key", "left_semi").groupBy("key").agg(F.first("hashes").alias("hashes")), "line-hashes")
    first = lines.select(F.col("key").alias("first_key"), F.col("hashes").alias("first_hashes"))
    rows = pairs.join(lines, "key").join(first, "first_key").select("key", "first_key", "spans", "hashes", "first_hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "start", "end", "first_key", "first_start"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                key, first_key, spans, own, first = (c[at].as_py() for c in batch.columns)
                longest = {widened(own, first, s["start"], s["end"], s["first_start"]) for s in spans}
                rows += [(key, a, b, first_key, c) for a, b, c in sorted(longest)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return materialize(rows.mapInArrow(own_memory(run), "key string, start int, end int, first_key string, first_start int"), "widened")


def _segments(repeats: DataFrame) -> DataFrame:
    """Windows with one document's place of first occurrence, joined: rows ``key, start,
    end, first_key, first_start``. A document's windows are one row of a group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "start", "end", "first_key", "first_start"], [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            for key, first_key, ahead, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(key, a, b, first_key, a - ahead) for a, b in joined_spans([(s["start"], s["end"]) for s in spans])]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    ahead = (F.col("start") - F.col("first_start")).alias("ahead")
    groups = repeats.groupBy("key", "first_key", ahead).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return groups.mapInArrow(own_memory(run), "key string, start int, end int, first_key string, first_start int")


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, start, end`` of the lines to remove: what repeats an earlier passage,
    by id (null ids first), key and place. A passage that overlaps its own first
    occurrence loses the lines after it."""
    keyed = _keyed(docs, id_column, text)
    profiles = materialize(_profiles(keyed), "line-profiles")
    anchors = _repeats(materialize(_chunk_rows(profiles), "chunks"))
    found = _widened(_segments(anchors), profiles)
    known = found.groupBy(F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rest = _segments(_repeats(materialize(_chunk_rows(profiles, _light(known)), "short-chunks")))
    parts = found.union(rest).withColumn("first_end", F.col("first_start") + F.col("end") - F.col("start"))
    parts = materialize(parts, "segments")
    own = parts.select("key", "start", "end")
    first = parts.select(F.col("first_key").alias("key"), F.col("first_start").alias("start"), F.col("first_end").alias("end"))
    spans = own.union(first).distinct().groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # Both sides of the comparison come from the texts themselves.
    spans = materialize(spans, "spans")
    texts = keyed.join(_small(spans.select("key")), "key", "left_semi").join(spans, "key")
    # Spans are cut out before a row is made of each, so that none carries the whole text.
    lines = texts.select("key", F.split("text", "\n", -1).alias("lines"), "spans")
    body = lambda s: F.array_join(F.slice(F.col("lines"), s["start"] + 1, s["end"] - s["start"]), "\n")
    cut = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), body(s).alias("body")))
    bodies = lines.select("key", cut.alias("cut")).select("key", F.inline("cut"))
    bodies = materialize(bodies.groupBy("key", "start", "end").agg(F.first("body").alias("body")), "bodies")
    kept = bodies.select(F.col("key").alias("first_key"), F.col("start").alias("first_start"), F.col("end").alias("first_end"), F.col("body").alias("kept"))
    same = parts.join(bodies, ["key", "start", "end"]).join(kept, ["first_key", "first_start", "first_end"]).filter(F.col("body") == F.col("kept"))
    begin = F.when(F.col("key") == F.col("first_key"), F.greatest("start", "first_end")).otherwise(F.col("start"))
    return same.select("key", begin.alias("start"), "end").filter("start < end")


def remove_passages(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every repeated passage cut out of the text, and ``n_lines``,
    ``removed_lines`` and ``removed`` (array of the (start, end) line spans).

    A passage is a run of lines that :func:`is_passage`; it is cut if an earlier place
    has the same lines in a row, before anything was cut there. So the lines of
    overlapping passages each stay once, but may stay in different documents. A null
    text stays null and has no lines. Rows that are equal in id and text count as one
    document and are cut alike. A document that repeats as a whole ends up with an
    empty text. Columns of these three names are replaced, others pass through.
    """
    cuts = repeated_passages(docs, id_column, text).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    return _without(docs, cuts, lambda body, cut: joined_spans([(s["start"], s["end"]) for s in cut]), id_column, text)
