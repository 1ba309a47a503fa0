"""Exact top-k inner products with a vector-approximation file.

Every vector is stored twice: as one byte a component, the number of its cell in a
uniform grid over the component's range, and exactly. A search first scans the cells
alone. They give an upper and a lower bound of each score; what lies below the k-th
largest lower bound is out. The exact vectors of the rest are then read in the order
of their upper bounds, until the k-th best exact score is at least as large as every
upper bound that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnmill.llm.warc import open_store
from turnmill.session import materialize, new_folder

_CELL_BITS = 6
# Queries of a block; each task holds one block at a time.
_QUERIES_A_BLOCK = 4096
_SCORES_A_STEP = 4_000_000
_SCALE = 256
_LARGEST = np.iinfo(np.int64).max


def scaled(vector: Column, scale: int = _SCALE) -> Column:
    """floor(scale * x) of each component as array of long; null for a vector that is
    null, empty, or holds null, NaN or infinite components."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(numbers, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(numbers, lambda x: F.floor(x * scale))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)), whole)


def _matrix(column, dims: int) -> np.ndarray:
    return np.stack(column).astype(np.int64).reshape(-1, dims)


def _ranges(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and largest value of each component, by number of components."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                own = _matrix(part["vector"], dims)
                low, high = found.get(dims, (own[0], own[0]))
                found[dims] = np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))
        for dims, (low, high) in found.items():
            yield pd.DataFrame({"dims": dims, "at": range(dims), "low": low, "high": high})

    rows = vectors.select("dims", "vector").mapInPandas(partial, "dims int, at int, low long, high long")
    out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    table = rows.groupBy("dims", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dims", "at").collect()
    for dims in {r["dims"] for r in table}:
        own = [r for r in table if r["dims"] == dims]
        out[dims] = np.array([r["low"] for r in own], np.int64), np.array([r["high"] for r in own], np.int64)
    return out


class Grid:
    """Cells of equal whole-number width for each component."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        # In floating point, for ranges beyond 64 bits; rounding widens a cell.
        span = high.astype(np.float64) - low.astype(np.float64) + 1
        self.low = low
        self.width = np.maximum(np.ceil(span / 2**bits), 1)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        offset = vectors.astype(np.float64) - self.low.astype(np.float64)
        return np.minimum(offset // self.width, 255).astype(np.uint8)

    def bounds(self, cells: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Upper bounds (query by vector), and by how much the lower bounds are less."""
        corner = self.low.astype(np.float64) + cells * self.width
        reach = self.width - 1
        upper = queries @ corner.T + (np.maximum(queries, 0) @ reach)[:, None]
        # Sums beyond 2**53 are rounded.
        slack = (np.abs(queries) @ (np.abs(self.low.astype(np.float64)) + 256 * self.width)) * 2.0**-50
        slack = np.where(slack < 1, 0, slack)
        return upper + slack[:, None], np.abs(queries) @ reach + 2 * slack, slack


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows; beyond 64 bits the nearest 64-bit number."""
    if not a.size or max(np.abs(a).max(), np.abs(b).max(), 0) < 2**26 and a.min() > -(2**26) and b.min() > -(2**26):
        return (a * b).sum(axis=1)
    sums = [sum(x * y for x, y in zip(p, q, strict=True)) for p, q in zip(a.tolist(), b.tolist(), strict=True)]
    return np.array([min(max(s, -_LARGEST - 1), _LARGEST) for s in sums], np.int64)


def build_file(embeddings: DataFrame, id_column: str, vector: str, bits: int = _CELL_BITS) -> tuple[DataFrame, dict[int, Grid]]:
    """The written table ``row, vec_id, dims, cells, vector`` and the grids.

    ``row`` numbers the rows, so that equal rows stay apart. Parquet keeps ``cells``
    and ``vector`` in columns of their own: a scan of the cells reads no vectors.
    """
    rows = embeddings.select(F.col(id_column).cast("long").alias("vec_id"), scaled(F.col(vector)).alias("vector"))
    rows = rows.filter("vector is not null and vec_id is not null").withColumn("dims", F.size("vector"))
    grids = {d: Grid(low, high, bits) for d, (low, high) in _ranges(rows).items()}

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [grids[d].cells(np.array(v, np.int64)[None])[0].tobytes() for v, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.binary())], ["vec_id", "vector", "dims", "cells"])

    made = rows.mapInArrow(approximate, "vec_id long, vector array<long>, dims int, cells binary")
    return materialize(made.withColumn("row", F.monotonically_increasing_id()), "vector-file"), grids


def _written_queries(queries: DataFrame) -> str:
    """The folder of the queries' rows, some thousands in each file."""
    folder = new_folder(queries.sparkSession, "queries")
    blocks = max(1, -(-queries.count() // _QUERIES_A_BLOCK))
    queries.select("row", "dims", "vector").repartition(blocks, F.xxhash64("row")).write.parquet(folder)
    return folder


def _blocks(folder: str) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries of each file: their rows and vectors, by number of components."""
    store, path = open_store(folder)
    names = sorted(x.path for x in store.get_file_info(fs.FileSelector(path)) if x.base_name.endswith(".parquet"))
    for name in names:
        with store.open_input_file(name) as file:
            table = pq.read_table(file)
        by_dims = {}
        for dims in np.unique(table["dims"].to_numpy()).tolist():
            own = table.filter(pc.equal(table["dims"], dims))
            vectors = own["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            by_dims[dims] = own["row"].to_numpy(), vectors.reshape(-1, dims).astype(np.float64)
        yield by_dims


def _scan(file: DataFrame, grids: dict[int, Grid], folder: str, k: int) -> DataFrame:
    """Rows ``query, row, upper, lower`` that may be among a query's k best.

    One pass over the cells: a task holds those of its part of the file, one byte a
    component, and goes through the blocks of queries, which it reads one after the other.
    """
    shared = file.sparkSession.sparkContext.broadcast(grids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                rows, cells = held.setdefault(dims, ([], []))
                rows.append(part["row"].to_numpy(np.int64))
                cells.append(np.frombuffer(b"".join(part["cells"]), np.uint8).reshape(-1, dims))
        file_part = {dims: (np.concatenate(rows), np.concatenate(cells)) for dims, (rows, cells) in held.items()}
        for block in _blocks(folder) if file_part else ():
            for dims, (names, matrix) in block.items():
                rows, cells = file_part.get(dims, (np.zeros(0, np.int64), None))
                # The k largest lower bounds that this task has seen, for each query.
                best = np.full((len(names), k), -np.inf)
                step = max(64, _SCORES_A_STEP // len(names))
                for at in range(0, len(rows), step):
                    own = rows[at : at + step]
                    upper, less, _ = shared.value[dims].bounds(cells[at : at + step], matrix)
                    upper[names[:, None] == own[None, :]] = -np.inf
                    lower = upper - less[:, None]
                    top = np.partition(lower, -k, axis=1)[:, -k:] if lower.shape[1] > k else lower
                    best = np.sort(np.concatenate((best, top), axis=1), axis=1)[:, -k:]
                    q, c = np.nonzero((upper >= best[:, :1]) & (upper > -np.inf))
                    yield pd.DataFrame({"query": names[q], "row": own[c], "upper": upper[q, c], "lower": lower[q, c]})

    return file.select("row", "dims", "cells").mapInPandas(run, "query long, row long, upper double, lower double")


def _scored(pairs: DataFrame, file: DataFrame) -> DataFrame:
    """Read the exact vectors of both sides; ``query, query_id, vec_id, score``."""
    own = file.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("vector").alias("q"))
    other = file.select("row", "vec_id", F.col("vector").alias("v"))
    rows = pairs.select("query", "row").join(other, "row").join(own, "query").select("query", "query_id", "row", "vec_id", "q", "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            score = np.zeros(len(batch), np.int64)
            for dims, place in batch.groupby(batch["q"].map(len)).indices.items():
                score[place] = exact_scores(_matrix(batch["q"].iloc[place], dims), _matrix(batch["v"].iloc[place], dims))
            yield batch.drop(columns=["q", "v"]).assign(score=score)

    return rows.mapInPandas(run, "query long, query_id long, row long, vec_id long, score long")


def _certain(candidates: DataFrame, file: DataFrame, k: int) -> DataFrame:
    """Exact k best: the vectors with the largest upper bounds are read first, then
    those that the k-th score so far does not rule out."""
    ordered = W.partitionBy("query").orderBy(F.desc("upper"), "row")
    ranked = materialize(candidates.withColumn("place", F.row_number().over(ordered)), "ordered")
    first = materialize(_scored(ranked.filter(F.col("place") <= 2 * k), file), "first")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    kth = first.withColumn("n", F.row_number().over(best)).filter(F.col("n") == k).select("query", F.col("score").alias("kth"))
    rest = ranked.filter(F.col("place") > 2 * k).join(kth, "query").filter(F.col("upper") >= F.col("kth"))
    both = first.union(_scored(rest, file))
    return both.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the k best others for each query row.

    ``is_query`` is a condition on ``vec_id``. Scores are inner products of the scaled
    whole-number vectors; ties go to the smaller vec_id. Only vectors of the same
    number of components are compared. Rows with a null id, or whose vector is null,
    empty or not finite, take no part. Repeated rows count each for itself; a row is
    never its own candidate. All queries are searched in one pass over the cells; tasks read
    the queries block by block, and hold one block.
    """
    file, grids = build_file(embeddings, id_column, vector)
    candidates = materialize(_scan(file, grids, _written_queries(file.filter(is_query)), k), "candidates")
    lower = W.partitionBy("query").orderBy(F.desc("lower"), "row")
    bound = candidates.withColumn("n", F.row_number().over(lower)).filter(F.col("n") == k).select("query", F.col("lower").alias("least"))
    left = candidates.join(bound, "query", "left").filter(F.col("least").isNull() | (F.col("upper") >= F.col("least")))
    found = _certain(left.select("query", "row", "upper"), file, k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
