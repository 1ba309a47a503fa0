"""How filters overlap, for every order they can be applied in.

Each document has a failure mask, a bit for each filter that it fails. The masks of
a part of the corpus are counted and make a decision diagram: a level for each filter,
two arcs for passing and failing, and at the end the number of documents with that
mask. Every node holds the sum of what is below it, and equal nodes of a level are one
node. The order of the filters is the order of the levels. Exchanging two neighbouring
levels rebuilds the nodes of those two levels only, and every order is reached from the
one before it by one such exchange. In a diagram the arc of failing, from the node that
is reached by passing all filters so far, leads to what the next filter removes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import small_batches
from turnmill.session import materialize

_ROWS_A_STEP = 512
_COUNTS = ("docs", "good", "toxic")
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_SIGNS = b"#$%&*|"
# Bytes of UTF-8 that don't begin a code point.
_CONTINUING = bytes(range(0x80, 0xC0))
MAX_FILTERS = 8


def _too_short(text: bytes) -> bool:
    return len(text.split()) < 50


def _repetitive(text: bytes) -> bool:
    words = text.split()
    return 100 * len(set(words)) < 65 * len(words)


def _shouting(text: bytes) -> bool:
    upper = len(text) - len(text.translate(None, _UPPER))
    return 100 * upper > 5 * len(text.translate(None, _CONTINUING))


def _has_signs(text: bytes) -> bool:
    return len(text.translate(None, _SIGNS)) < len(text)


# Whether a text, in UTF-8, fails. Words are what bytes.split() gives: runs without
# the six characters of ASCII white space.
TEXT_FILTERS: dict[str, Callable[[bytes], bool]] = {"A": _too_short, "B": _repetitive, "C": _shouting, "D": _has_signs}
DUPLICATE = "E"


def text_masks(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source", filters: Mapping[str, Callable[[bytes], bool]] = TEXT_FILTERS
) -> DataFrame:
    """``id, part, digest, mask`` of every row; bit i is set if filter i fails the whole
    text. A null text or part counts as empty. A narrow map."""
    tests = list(filters.values())
    names = ["id", "part", "digest", "mask"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_A_STEP):
                step = batch.slice(at, _ROWS_A_STEP)
                bodies = step.column(2).to_pylist()
                masks = [sum(fails(b) << i for i, fails in enumerate(tests)) for b in bodies]
                digests = pa.array([sha256(b).digest() for b in bodies], pa.binary())
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), digests, pa.array(masks, pa.int32())], names)

    empty = F.lit("")
    rows = small_batches(docs).select(
        docs[id_column].cast("long").alias("id"),
        F.coalesce(docs[part].cast("string"), empty).alias("part"),
        F.coalesce(docs[text], empty).cast("binary").alias("body"),
    )
    return rows.mapInArrow(run, "id long, part string, digest binary, mask int")


def mask_counts(masks: DataFrame, labels: DataFrame, duplicate_bit: int, id_column: str = "doc_id") -> DataFrame:
    """``part, mask, docs, good, toxic``: at most 2^filters rows for each part.

    ``masks`` comes from :func:`text_masks`. ``duplicate_bit`` is set where a smaller id
    has the same text anywhere in the table. A row without an id has no labels, is no
    duplicate and makes none; rows of equal id and text are no duplicates of each other.
    An id counts as good (toxic) if any row of ``labels`` says quality (toxic) 1.

    Copies of a text are added up in the tasks that read them, so a text that has a third
    of all rows is a few rows for each part when its smallest id is looked for.
    """
    flags = [F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(f"is_{name}") for c, name in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("label_id")).agg(*flags)
    # Written, so that its size decides and a frequent id can be split.
    known = materialize(known.filter("is_good or is_toxic"), "audit-labels")
    count = F.count(F.lit(1))
    named = masks.filter(F.col("id").isNotNull()).groupBy("id", "part", "digest", "mask").agg(count.alias("copies"))
    joined = named.join(known, F.col("id") == F.col("label_id"), "left")
    flagged = [F.coalesce(F.col(f"is_{name}"), F.lit(False)).alias(f"is_{name}") for name in ("good", "toxic")]
    keys = ["part", "mask", "is_good", "is_toxic"]
    texts = (
        joined.select("id", "part", "digest", "mask", "copies", *flagged)
        .groupBy("digest", *keys)
        .agg(F.sum("copies").alias("n"), F.min(F.struct("id", "copies")).alias("first"))
    )
    texts = materialize(texts, "audit-texts")
    # Of most texts there is one row; the others' smallest id is found and joined back.
    ahead = texts.groupBy("digest").agg(F.min("first.id").alias("least"), count.alias("rows")).filter("rows > 1")
    ahead = materialize(ahead.select(F.col("digest").alias("_digest"), "least"), "audit-first")
    placed = texts.join(ahead, F.col("digest") == F.col("_digest"), "left")
    own = F.when(F.coalesce("least", "first.id") == F.col("first.id"), F.col("first.copies")).otherwise(F.lit(0))
    failing = F.col("mask").bitwiseOR(F.lit(1 << duplicate_bit))
    split = F.explode(F.array(F.struct(F.col("mask"), own.alias("n")), F.struct(failing.alias("mask"), (F.col("n") - own).alias("n"))))
    with_id = placed.select("part", "is_good", "is_toxic", split.alias("s")).select("part", "s.mask", "s.n", "is_good", "is_toxic")
    no = F.lit(False)
    without = masks.filter(F.col("id").isNull()).groupBy("part", "mask").agg(count.alias("n"))
    rows = with_id.unionByName(without.withColumns({"is_good": no, "is_toxic": no}))
    sums = [F.sum("n"), F.sum(F.when(F.col("is_good"), F.col("n")).otherwise(0)), F.sum(F.when(F.col("is_toxic"), F.col("n")).otherwise(0))]
    return rows.filter("n > 0").groupBy("part", "mask").agg(*[s.alias(c) for s, c in zip(sums, _COUNTS, strict=True)])


Counts = tuple[int, ...]


class Node:
    """Where passing and failing a level's filter lead, and the sum of what is below."""

    __slots__ = ("passing", "failing", "total")

    def __init__(self, passing: Node | Counts, failing: Node | Counts):
        self.passing, self.failing = passing, failing
        self.total = tuple(a + b for a, b in zip(_total(passing), _total(failing), strict=True))


def _total(node: Node | Counts) -> Counts:
    return node.total if isinstance(node, Node) else node


class Diagram:
    """A diagram over the filters of ``order`` (numbers, first level first).

    The arcs of the last level lead to counts. The nodes of a level are looked up by
    their arcs, so equal ones are the same. No level is left out on any path.
    """

    def __init__(self, masks: Mapping[int, Counts], filters: int):
        self.order = list(range(filters))
        self.levels: list[dict[tuple, Node]] = [{} for _ in self.order]
        none = (0,) * len(_COUNTS)

        def below(level: int, mask: int) -> Node | Counts:
            if level == filters:
                return masks.get(mask, none)
            return self.node(level, below(level + 1, mask), below(level + 1, mask | 1 << level))

        self.root = below(0, 0)

    def node(self, level: int, passing: Node | Counts, failing: Node | Counts) -> Node:
        """The one node of a level with these arcs."""
        key = (id(passing), id(failing)) if isinstance(passing, Node) else (passing, failing)
        return self.levels[level].get(key) or self.levels[level].setdefault(key, Node(passing, failing))

    def swap(self, level: int) -> None:
        """Exchange ``level`` and the next one. Levels below stay as they are; those
        above only take up the rebuilt nodes."""
        old, done = self.root, {}
        self.levels[: level + 2] = [{} for _ in range(level + 2)]

        def rebuilt(node: Node, at: int) -> Node:
            if id(node) not in done:
                first, second = node.passing, node.failing
                if at < level:
                    arcs = rebuilt(first, at + 1), rebuilt(second, at + 1)
                else:
                    arcs = self.node(at + 1, first.passing, second.passing), self.node(at + 1, first.failing, second.failing)
                done[id(node)] = self.node(at, *arcs)
            return done[id(node)]

        self.root = rebuilt(old, 0)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Counts, Counts, Counts]]:
        """For each level: its filter, what is kept, what is removed, and what fails it
        alone. Follows the arcs of passing from the root."""
        node = self.root
        for number in self.order:
            alone = node.failing
            while isinstance(alone, Node):
                alone = alone.passing
            yield number, _total(node.passing), _total(node.failing), alone
            node = node.passing


def exchanges(n: int) -> list[int]:
    """The n! - 1 neighbours (left place) to exchange so that each order of n things comes
    up once: the last thing wanders through an order of the others, to and fro."""
    if n < 2:
        return []
    out, down = [], True
    for inner in [*exchanges(n - 1), None]:
        out += range(n - 2, -1, -1) if down else range(n - 1)
        if inner is not None:
            # The wandering thing is in front after going down, and behind after going up.
            out.append(inner + down)
        down = not down
    return out


def audit_orders(masks: Mapping[int, Counts], names: Sequence[str]) -> list[tuple]:
    """Rows (order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley) for every order of the filters. ``masks`` holds (docs, good, toxic)."""
    n = len(names)
    diagram = Diagram(masks, n)
    fails = [sum(c[0] for m, c in masks.items() if m >> i & 1) for i in range(n)]
    rows, shares = [], [0] * n
    for level in [None, *exchanges(n)]:
        if level is not None:
            diagram.swap(level)
        order = "".join(names[i] for i in diagram.order)
        for step, (i, kept, removed, alone) in enumerate(diagram.steps(), 1):
            shares[i] += removed[0]
            rows.append((i, order, step, kept[0], removed[0], fails[i] - removed[0], alone[0], removed[1], removed[2]))
    return [(*row[1:], shares[row[0]]) for row in rows]


_RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
_TYPES = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]


def audit_parts(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """The rows of every order for each part. ``counts`` is what :func:`mask_counts` gives:
    a part is one row of at most 2^filters masks here, whatever its share of the corpus."""
    if not 1 <= len(names) <= MAX_FILTERS or len({*names}) < len(names):
        raise ValueError(f"between 1 and {MAX_FILTERS} filters of different names")
    columns = [c.split(" ")[0] for c in _RESULT.split(", ")]
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("masks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, masks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = audit_orders({m["mask"]: tuple(m[c] for c in _COUNTS) for m in masks}, names)
                data = [[part] * len(rows), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(data, _TYPES, strict=True)], columns)

    return parts.mapInArrow(run, _RESULT)


def audit_filters(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Every order of the text filters and the duplicate filter, for each part of ``docs``.

    Columns: ``part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley``, in documents. Every row counts, repeated ones too.
    A null part is the empty one; an empty table has no parts and gives no rows. Columns
    other than those named are not looked at.
    """
    masks = materialize(text_masks(docs, id_column, text, part), "audit-masks")
    counts = mask_counts(masks, labels, len(TEXT_FILTERS), id_column)
    return audit_parts(counts, [*TEXT_FILTERS, DUPLICATE])
