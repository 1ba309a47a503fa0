"""Exact deduplication with a sharded cuckoo filter over the digests of live texts.

The index has one row per shard of the digest space: a cuckoo filter and the
stored keys of its buckets (full 256-bit digests with the id that stays and the
number of documents). A digest that hits the filter is verified against the keys
stored in its two buckets; a miss is certainly new. A full filter is rebuilt with
twice the buckets from the stored keys. Digests can be deleted, so the index
follows a live corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill.llm.common import SPACES, repeated, whole
from turnmill.session import materialize

_SLOTS = 4
_MAX_KICKS = 200
# Pre-aggregated rows that a digest may have when it reaches its shard.
_SALTS = 8
_DIGESTS_A_SHARD = 20_000
_MIN_SHARDS = 32

INDEX_SCHEMA = "shard int, buckets int, filter binary, digests array<string>, keep_ids array<long>, counts array<long>"


class CuckooFilter:
    """16-bit fingerprints in buckets of four, each with its key stored beside it.

    A fingerprint lives in one of two buckets; the second follows from the first
    and the fingerprint. ``find`` compares the full key only on a fingerprint hit.
    """

    def __init__(self, buckets: int = 1024):
        self.buckets = 1 << max(1, (buckets - 1).bit_length())
        self.cells: list[list[int]] = [[] for _ in range(self.buckets)]
        self.keys: list[list[str]] = [[] for _ in range(self.buckets)]
        self.size = 0
        self.verified = 0

    def _print(self, digest: str) -> int:
        return int(digest[-4:], 16) or 1

    def _pair(self, digest: str) -> tuple[int, int, int]:
        mark = self._print(digest)
        # Leading digits choose the shard, so the bucket comes from later ones.
        first = int(digest[16:32], 16) & (self.buckets - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995 >> 3) & (self.buckets - 1))

    def find(self, digest: str) -> bool:
        mark, *pair = self._pair(digest)
        for b in pair:
            if mark in self.cells[b]:
                self.verified += 1
                if digest in self.keys[b]:
                    return True
        return False

    def insert(self, digest: str) -> None:
        """Add a digest that is not there yet; resizes on overflow."""
        mark, first, second = self._pair(digest)
        for b in (first, second):
            if len(self.cells[b]) < _SLOTS:
                self._put(b, mark, digest)
                self.size += 1
                return
        at = first
        for kick in range(_MAX_KICKS):
            slot = kick % _SLOTS
            mark, self.cells[at][slot] = self.cells[at][slot], mark
            digest, self.keys[at][slot] = self.keys[at][slot], digest
            at = self._other(at, mark)
            if len(self.cells[at]) < _SLOTS:
                self._put(at, mark, digest)
                self.size += 1
                return
        self._resize(digest)

    def _put(self, bucket: int, mark: int, digest: str) -> None:
        self.cells[bucket].append(mark)
        self.keys[bucket].append(digest)

    def _resize(self, homeless: str) -> None:
        stored = [k for bucket in self.keys for k in bucket] + [homeless]
        self.__init__(self.buckets * 2)
        for key in stored:
            self.insert(key)

    def delete(self, digest: str) -> bool:
        mark, *pair = self._pair(digest)
        for b in pair:
            if digest in self.keys[b]:
                place = self.keys[b].index(digest)
                del self.cells[b][place], self.keys[b][place]
                self.size -= 1
                return True
        return False

    def table(self) -> bytes:
        return b"".join(
            (sum(m << 16 * i for i, m in enumerate(cell))).to_bytes(2 * _SLOTS, "little") for cell in self.cells
        )


def _restored(buckets: int, digests) -> CuckooFilter:
    out = CuckooFilter(buckets)
    for d in digests:
        out.insert(d)
    return out


def normalized(text: Column) -> Column:
    """Every run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(whole(text), SPACES, " ")


def text_digest(text: Column) -> Column:
    return F.sha2(normalized(text).cast("binary"), 256)


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"), F.lit(shards)).cast("int")


def _lower(a, b):
    if a is None or a != a:
        return b
    return a if b is None or b != b else min(a, b)


def _absorb(found: dict, cuckoo: CuckooFilter, rows: Iterator[tuple]) -> None:
    """Insert (digest, id, count) rows; a verified hit joins the stored entry."""
    for digest, own, count in rows:
        if cuckoo.find(digest):
            entry = found[digest]
            entry[0], entry[1] = _lower(entry[0], own), entry[1] + count
        else:
            cuckoo.insert(digest)
            found[digest] = [own, count]


def _entry(shard: int, cuckoo: CuckooFilter, found: dict) -> pd.DataFrame:
    live = sorted(found)
    ids = [None if (v := found[d][0]) is None or v != v else int(v) for d in live]
    counts = [int(found[d][1]) for d in live]
    return pd.DataFrame(
        {"shard": [shard], "buckets": [cuckoo.buckets], "filter": [cuckoo.table()], "digests": [live], "keep_ids": [ids], "counts": [counts]}
    )


def _stored(index: pd.DataFrame) -> tuple[CuckooFilter, dict]:
    if not len(index):
        return CuckooFilter(), {}
    row = index.iloc[0]
    found = {d: [i, c] for d, i, c in zip(row["digests"], row["keep_ids"], row["counts"], strict=True)}
    return _restored(int(row["buckets"]), found), found


def _rows(pdf: pd.DataFrame) -> Iterator[tuple]:
    return zip(pdf["digest"].tolist(), pdf["id"].astype(object).tolist(), pdf["n"].tolist(), strict=True)


def _arrivals(keyed: DataFrame, shards: int) -> DataFrame:
    """Pre-aggregated (shard, digest, id, n): at most ``_SALTS`` rows a digest."""
    salt = F.pmod(F.xxhash64("id"), F.lit(_SALTS))
    return (
        keyed.groupBy("digest", salt.alias("salt"))
        .agg(F.min("id").alias("id"), F.sum("copies").alias("n"))
        .select(_shard(F.col("digest"), shards).alias("shard"), "digest", "id", "n")
    )


def keyed_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (id, digest) with the number of equal rows as ``copies``."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), text_digest(F.col(text)).alias("digest"))
    return repeated(rows, "id", "digest")


def build_index(keyed: DataFrame, shards: int) -> DataFrame:
    """The index of ``keyed`` (see :func:`keyed_documents`), one row per shard in use."""

    def build(key, pdf):
        cuckoo, found = CuckooFilter(max(2, len(pdf) // 3)), {}
        _absorb(found, cuckoo, _rows(pdf))
        return _entry(int(key[0]), cuckoo, found)

    return _arrivals(keyed, shards).groupBy("shard").applyInPandas(build, INDEX_SCHEMA)


def insert_digests(index: DataFrame, keyed: DataFrame, shards: int) -> DataFrame:
    """The index after the arrival of further documents."""

    def merge(key, old, new):
        cuckoo, found = _stored(old)
        _absorb(found, cuckoo, _rows(new))
        return _entry(int(key[0]), cuckoo, found)

    arrivals = _arrivals(keyed, shards).groupBy("shard")
    return index.groupBy("shard").cogroup(arrivals).applyInPandas(merge, INDEX_SCHEMA)


def delete_digests(index: DataFrame, keyed: DataFrame, shards: int) -> DataFrame:
    """The index after documents left; a digest goes when its last document does.

    Digests that are not in the index are ignored. The id that stays is kept while
    any document of the text is live, so earlier decisions hold.
    """

    def drop(key, old, gone):
        cuckoo, found = _stored(old)
        for digest, _, count in _rows(gone):
            if cuckoo.find(digest):
                found[digest][1] -= count
                if found[digest][1] <= 0:
                    cuckoo.delete(digest)
                    del found[digest]
        return _entry(int(key[0]), cuckoo, found)

    leaving = _arrivals(keyed, shards).groupBy("shard")
    return index.groupBy("shard").cogroup(leaving).applyInPandas(drop, INDEX_SCHEMA)


def entries(index: DataFrame) -> DataFrame:
    """The stored keys as rows ``digest, keep_id, group_size``."""
    row = F.arrays_zip("digests", "keep_ids", "counts")
    return index.select(F.explode(row).alias("e")).select(
        F.col("e.digests").alias("digest"), F.col("e.keep_ids").alias("keep_id"), F.col("e.counts").alias("group_size")
    )


def _differing(docs: DataFrame, decided: DataFrame, id_column: str, text: str) -> DataFrame:
    """Dropped documents whose normalised bytes differ from those of the one that stays."""
    # One row for each id and digest, dealt by the digest alone, so that a hot one can be split.
    shared = decided.filter(F.col("group_size") > 1).select("id", "digest", "keep_id")
    texts = docs.select(
        F.col(id_column).cast("long").alias("id"), text_digest(F.col(text)).alias("digest"), normalized(F.col(text)).alias("body")
    )
    texts = materialize(texts.join(shared, ["id", "digest"]), "shared-texts")
    stays = texts.filter(F.col("id") == F.col("keep_id")).select("digest", F.col("body").alias("kept_body"))
    return texts.filter(F.col("id") != F.col("keep_id")).join(stays, "digest").filter(F.col("body") != F.col("kept_body"))


def dedup_exact(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, compare_bytes: bool = True
) -> DataFrame:
    """Rows ``id, digest, keep_id, group_size, kept``, one per row of ``docs``.

    Texts are equal when they are after replacing each run of ASCII white space by
    one space; a null text is empty. The row with the smallest id of a group stays;
    of rows that share that id too, one does; null ids stay only in groups without
    any other. ``compare_bytes`` also compares the dropped texts with the text that
    stays and fails the job should two texts ever share a SHA-256 digest. Other
    columns are not read. An empty table gives no rows.
    """
    keyed = materialize(keyed_documents(docs, id_column, text), "digests")
    shards = max(_MIN_SHARDS, -(-keyed.count() // _DIGESTS_A_SHARD))
    index = materialize(build_index(keyed, shards), "cuckoo")
    decided = keyed.join(entries(index), "digest")
    if compare_bytes and not _differing(docs, decided, id_column, text).isEmpty():
        raise RuntimeError("different texts share a SHA-256 digest")
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return decided.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        "id", "digest", "keep_id", "group_size", stays.alias("kept")
    )
