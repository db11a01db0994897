"""Operator 5: exact de-duplication with a cuckoo-filter index over live digests.

Documents are reduced to SHA-256 digests beside the scan. Digests are pre-aggregated per
(digest, salt), so a group of copies that holds a third of all rows arrives as a few rows.
Each reduce task streams its digests through a :class:`CuckooIndex`: the filter answers
most lookups, hits are verified against the records in the bucketed store, a row with a
larger id deletes the live entry and inserts its own, and an overflowing filter is rebuilt
twice as large from the stored keys. Decisions go back over the same (digest, salt) keys.

Defined cases: null text counts as empty; null ids rank below all others and share one
group like any text; rows equal in id and text are told apart by count, one of them stays;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholium.llm.shared import bounded_join, cut

SLOTS = 4
MAX_KICKS = 200


class CuckooIndex:
    """Cuckoo filter of 16-bit fingerprints plus the bucketed records that verify its hits."""

    def __init__(self, buckets: int = 1024):
        self.resizes = 0
        self._allocate(buckets)
        self.store: dict[int, list[list]] = {}
        self.size = 0

    def _allocate(self, buckets: int) -> None:
        self.mask = (1 << max(2, (buckets - 1).bit_length())) - 1
        self.table: list[list[int]] = [[] for _ in range(self.mask + 1)]

    @staticmethod
    def _print(key: bytes) -> int:
        return int.from_bytes(key[:2], "little") or 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[2:10], "little") & self.mask

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, key: bytes) -> bool:
        mark, home = self._print(key), self._home(key)
        return mark in self.table[home] or mark in self.table[self._other(home, mark)]

    def get(self, key: bytes) -> list | None:
        """The record of ``key``: filter first, then its bucket's content."""
        if not self.maybe(key):
            return None
        return next((r for r in self.store.get(int.from_bytes(key[2:6], "little"), ()) if r[0] == key), None)

    def _place(self, key: bytes) -> bool:
        mark, home = self._print(key), self._home(key)
        for bucket in (home, self._other(home, mark)):
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(mark)
                return True
        bucket = home
        for kick in range(MAX_KICKS):
            row = self.table[bucket]
            row[kick % SLOTS], mark = mark, row[kick % SLOTS]
            bucket = self._other(bucket, mark)
            if len(self.table[bucket]) < SLOTS:
                self.table[bucket].append(mark)
                return True
        return False

    def insert(self, key: bytes, *content) -> None:
        self.store.setdefault(int.from_bytes(key[2:6], "little"), []).append([key, *content])
        self.size += 1
        if not self._place(key):
            self._grow()

    def delete(self, key: bytes) -> list | None:
        record = self.get(key)
        if record is None:
            return None
        bucket = int.from_bytes(key[2:6], "little")
        self.store[bucket].remove(record)
        if not self.store[bucket]:
            del self.store[bucket]
        self.size -= 1
        mark, home = self._print(key), self._home(key)
        row = self.table[home] if mark in self.table[home] else self.table[self._other(home, mark)]
        row.remove(mark)
        return record

    def _grow(self) -> None:
        """Overflow: a table twice as large, filled again from the stored keys."""
        while True:
            self.resizes += 1
            self._allocate(2 * (self.mask + 1))
            if all(self._place(r[0]) for rows in self.store.values() for r in rows):
                return

    def records(self) -> Iterator[list]:
        for rows in self.store.values():
            yield from rows


def _index_groups(batches):
    import pandas as pd

    index = CuckooIndex()
    for batch in batches:
        for key, top, n in zip(batch["digest"], batch["top"], batch["n"], strict=True):
            key, top = bytes(key), None if pd.isna(top) else int(top)
            live = index.get(key)
            if live is None:
                index.insert(key, top, int(n))
            elif top is not None and (live[1] is None or top > live[1]):
                index.delete(key)
                index.insert(key, top, live[2] + int(n))
            else:
                live[2] += int(n)
    rows = [r for r in index.records() if r[2] > 1]
    for at in range(0, len(rows), 20_000):
        part = rows[at : at + 20_000]
        yield pd.DataFrame({"digest": [r[0] for r in part], "keep_id": pd.array([r[1] for r in part], dtype="Int64"), "group_size": [r[2] for r in part]})


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``; the largest id of equal texts stays."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    base = cut(spark, base.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")))
    partial = base.groupBy("digest", "salt").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("n"))
    partial = cut(spark, partial)
    # One task's index holds about a million digests, whatever the session's number of partitions.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-partial.count() // 1_000_000))
    groups = partial.repartition(tasks, F.col("digest")).select("digest", "top", "n").mapInPandas(_index_groups, "digest binary, keep_id long, group_size long")
    spread = partial.select("digest", "salt").join(groups, "digest")
    rows = base.repartition("digest", "salt").groupBy("digest", "salt", "doc_id").agg(F.count(F.lit(1)).alias("copies"))
    joined = rows.join(spread, ["digest", "salt"], "left")
    copy = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    joined = joined.select("doc_id", "digest", "keep_id", "group_size", copy)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that :func:`exact_dedup` keeps, with their columns."""
    gone = cut(spark, exact_dedup(spark, docs).filter("NOT kept").select("doc_id", F.col("text_sha256").alias("__sha256"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same")))
    marked = docs.withColumn("__sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = bounded_join(marked, gone.filter("NOT same").drop("same"), ["doc_id", "__sha256"], "left_anti", 200_000)
    if not gone.filter("same").isEmpty():  # rows equal in id and text: one of them stays
        held = held.dropDuplicates(["doc_id", "__sha256"])
    return held.drop("__sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
