"""Tensor headers of a model store as a data source of its own.

    register_tensor_headers(spark)
    spark.read.format("tensor_headers").load(store).filter("model = 'm1'")

Files are listed and the eight bytes before each header are read when the query is
planned; weight files are then dealt to partitions by the size of their headers. Filters
on ``model`` and ``shard`` decide which files are listed and opened at all.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith

from turnmill.session import ship_package
from turnmill.sources.model_files import _HEADER_SCHEMA, _PREFIX_BYTES, MAX_HEADER_BYTES, WEIGHTS_SUFFIX, file_system, header_rows

SOURCE = "tensor_headers"
# A partition reads about so many header bytes, and opening a file counts for so many.
PARTITION_BYTES = 16 << 20
OPEN_BYTES = 64 << 10
_OPENED_AT_ONCE = 32
_PUSHED = ("model", "shard")


@dataclass
class HeaderPartition(InputPartition):
    """Weight files (model, shard, path) that one task reads, and their header bytes."""

    files: tuple[tuple[str, str, str], ...]
    header_bytes: int


def _test(pushed: Filter) -> Callable[[str], bool] | None:
    """The filter on a name, if it is of a kind that files can be chosen by."""
    if isinstance(pushed, EqualTo | EqualNullSafe):
        return lambda name: name == pushed.value
    if isinstance(pushed, IsNull | IsNotNull):
        # A file always has both names.
        return lambda name: isinstance(pushed, IsNotNull)
    if isinstance(pushed, In):
        return lambda name: name in pushed.value
    if isinstance(pushed, StringStartsWith):
        return lambda name: name.startswith(pushed.value)
    if isinstance(pushed, StringEndsWith):
        return lambda name: name.endswith(pushed.value)
    if isinstance(pushed, StringContains):
        return lambda name: pushed.value in name
    return None


def dealt(sizes: list[int], most: int = PARTITION_BYTES) -> list[list[int]]:
    """Places of ``sizes`` in order, cut into runs of at most ``most``; larger ones alone."""
    runs: list[list[int]] = []
    filled = 0
    for place, size in enumerate(sizes):
        if not runs or filled + size > most:
            runs.append([])
            filled = 0
        runs[-1].append(place)
        filled += size
    return runs


class TensorHeaderReader(DataSourceReader):
    def __init__(self, root: str, most: int):
        self.root, self.most = root, most
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if getattr(one, "attribute", None) in {(c,) for c in _PUSHED} and _test(one) is not None:
                self.filters.append(one)
            else:
                yield one

    def _chosen(self, column: str, name: str) -> bool:
        return all(_test(f)(name) for f in self.filters if f.attribute == (column,))

    def files(self) -> list[tuple[str, str, str]]:
        """(model, shard, path) of the weight files at the top of the chosen models."""
        system, root = file_system(self.root)
        listed = lambda path: system.get_file_info(fs.FileSelector(path))
        models = [x for x in listed(root) if x.type == fs.FileType.Directory and self._chosen("model", x.base_name)]
        wanted = lambda x: x.type == fs.FileType.File and x.base_name.endswith(WEIGHTS_SUFFIX) and self._chosen("shard", x.base_name)
        scheme = match[0] if (match := re.match(r"[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", self.root)) else ""
        with ThreadPoolExecutor(_OPENED_AT_ONCE) as pool:
            shards = pool.map(lambda m: [(m.base_name, x.base_name, scheme + x.path) for x in listed(m.path) if wanted(x)], models)
            return sorted(s for own in shards for s in own)

    def partitions(self) -> list[HeaderPartition]:
        files = self.files()
        with ThreadPoolExecutor(_OPENED_AT_ONCE) as pool:
            sizes = list(pool.map(lambda f: _header_bytes(f[2]), files))
        runs = dealt([size + OPEN_BYTES for size in sizes], self.most)
        return [HeaderPartition(tuple(files[i] for i in run), sum(sizes[i] for i in run)) for run in runs]

    def read(self, partition: HeaderPartition) -> Iterator[pa.RecordBatch]:
        # Without files Spark asks for a partition of no kind.
        for model, shard, path in partition.files if isinstance(partition, HeaderPartition) else ():
            yield header_rows(model, shard, path)


def _header_bytes(path: str) -> int:
    """The size of a header by its prefix; 0 if there is none to be read."""
    system, inner = file_system(path)
    try:
        with system.open_input_file(inner) as handle:
            prefix = handle.read(_PREFIX_BYTES)
            size = struct.unpack("<Q", prefix)[0] if len(prefix) == _PREFIX_BYTES else 0
            return size if size <= min(MAX_HEADER_BYTES, handle.size()) else 0
    except OSError:
        return 0


class TensorHeaders(DataSource):
    """Options: the store as ``path``, ``partitionBytes``."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return _HEADER_SCHEMA

    def reader(self, schema) -> TensorHeaderReader:
        if "path" not in self.options:
            raise ValueError("tensor_headers needs the path of a store")
        return TensorHeaderReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)))


def register_tensor_headers(spark: SparkSession) -> None:
    """Make the source known to a session, and its filters reach it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TensorHeaders)
