"""Exact deduplication with a cuckoo index of live digests.

Every text is normalised (white space) and hashed in the JVM. The digests go to
cuckoo indexes twice: each map task folds its own rows, so that a group of copies
reaches the shuffle as one row per task, and each hash bucket then folds what the
tasks have sent. A filter hit is checked against the keys stored beside the filter's
slots, so false positives of the filter change nothing.

Defined cases: null text counts as empty; a null id is larger than any other id;
rows that share both id and text count one by one, and all carry the same keep_id;
``kept`` then holds for one of them; an empty table gives no rows; extra columns are
ignored by :func:`duplicates` and kept by :func:`dedup`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.common import SPACE, without
from panelcast.session import stage

#: Keys that a map task holds before it sends on what it has.
HELD = 200_000
#: Index ranges per shuffle partition: one index holds one of them at a time.
RANGES = 64
SLOTS = 4
KICKS = 200


class CuckooIndex:
    """Cuckoo filter of 16-bit tags whose slots point at stored keys.

    A key has two buckets; the second is the first xor a hash of the tag, so an
    entry moves without its key. Keys are digests: their bytes are the hash.
    ``insert`` returns the record of a key; ``delete`` frees it. When an entry
    finds no slot the index doubles and is filled again from the stored keys.
    """

    def __init__(self, buckets: int = 1024) -> None:
        self.keys: list[bytes | None] = []
        self.free: list[int] = []
        self._allocate(buckets)

    def __len__(self) -> int:
        return len(self.keys) - len(self.free)

    def _allocate(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [0] * (buckets * SLOTS)
        self.records = [-1] * (buckets * SLOTS)

    def _place(self, key: bytes) -> tuple[int, int, int]:
        tag = (key[0] << 8 | key[1]) or 1
        first = int.from_bytes(key[2:8], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, bucket: int, tag: int) -> int:
        return bucket ^ ((tag * 0x5BD1E995 >> 3) & self.mask)

    def _slot(self, key: bytes) -> int:
        tag, first, second = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[slot] == tag and self.keys[self.records[slot]] == key:
                    return slot
        return -1

    def find(self, key: bytes) -> int:
        """Record of a live key, or -1."""
        slot = self._slot(key)
        return self.records[slot] if slot >= 0 else -1

    def insert(self, key: bytes) -> tuple[int, bool]:
        """Record of the key, and whether it is new."""
        record = self.find(key)
        if record >= 0:
            return record, False
        if self.free:
            record = self.free.pop()
            self.keys[record] = key
        else:
            record = len(self.keys)
            self.keys.append(key)
        if not self._settle(key, record):
            self._grow()
        return record, True

    def delete(self, key: bytes) -> bool:
        """Forget a live key."""
        slot = self._slot(key)
        if slot < 0:
            return False
        record = self.records[slot]
        self.tags[slot], self.records[slot] = 0, -1
        self.keys[record] = None
        self.free.append(record)
        return True

    def _settle(self, key: bytes, record: int) -> bool:
        tag, first, second = self._place(key)
        for bucket in (first, second):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.records[slot] = tag, record
                    return True
        bucket = second
        for kick in range(KICKS):
            slot = bucket * SLOTS + kick % SLOTS
            tag, self.tags[slot] = self.tags[slot], tag
            record, self.records[slot] = self.records[slot], record
            bucket = self._other(bucket, tag)
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.tags[slot]:
                    self.tags[slot], self.records[slot] = tag, record
                    return True
        return False

    def _grow(self) -> None:
        live = [(k, r) for r, k in enumerate(self.keys) if k is not None]
        buckets = 2 * (self.mask + 1)
        while True:
            self._allocate(buckets)
            if all(self._settle(k, r) for k, r in live):
                return
            buckets *= 2


class _Groups:
    """Smallest id and number of rows per digest, in one cuckoo index."""

    def __init__(self) -> None:
        self.index, self.least, self.count = CuckooIndex(), [], []

    def add(self, digest: bytes, least, count: int) -> None:
        record, new = self.index.insert(digest)
        if new:
            self.least.append(least)
            self.count.append(count)
            return
        self.count[record] += count
        held = self.least[record]
        if held is None or (least is not None and least < held):
            self.least[record] = least

    def batch(self, ids: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(self.index.keys, pa.binary()), pa.array(self.least, ids), pa.array(self.count, pa.int64())],
            names=["digest", "keep_id", "group_size"],
        )


def _fold_task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, id) rows of one task to one row per digest."""
    groups, ids = _Groups(), pa.int64()
    for b in batches:
        ids = b.column(1).type
        for digest, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            groups.add(digest, i, 1)
        if len(groups.index) >= HELD:
            yield groups.batch(ids)
            groups = _Groups()
    if len(groups.index):
        yield groups.batch(ids)


def _fold_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(digest, least id, count, range) rows, range by range, to one row per digest."""
    groups, ids, at = _Groups(), pa.int64(), None
    for b in batches:
        ids = b.column(1).type
        for digest, least, count, part in zip(*(c.to_pylist() for c in b.columns)):
            if part != at:
                if at is not None:
                    yield groups.batch(ids)
                groups, at = _Groups(), part
            groups.add(digest, least, count)
    if at is not None:
        yield groups.batch(ids)


def text_digest(text: Column) -> Column:
    """SHA-256 of a text with every run of white space turned into one space."""
    return F.sha2(F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "), "UTF-8"), 256)


def groups_of(digests: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of (digest, doc_id), through cuckoo indexes."""
    kind = digests.schema["doc_id"].dataType.simpleString()
    schema = f"digest binary, keep_id {kind}, group_size long"
    partial = digests.select("digest", "doc_id").mapInArrow(_fold_task, schema)
    part = F.pmod(F.xxhash64("digest"), F.lit(RANGES)).cast("int").alias("part")
    spread = partial.select("*", part).repartition(F.col("digest")).sortWithinPartitions("part")
    return spread.mapInArrow(_fold_ranges, schema)


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: who stays for it, the size of its group, its digest."""
    digests = stage(docs.select(F.col(key).alias("doc_id"), F.unhex(text_digest(F.col(text))).alias("digest")), "digests")
    groups = groups_of(digests).withColumnRenamed("digest", "of")
    rows = digests.join(groups, F.col("digest") == F.col("of")).drop("of")
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select(
        "doc_id", "keep_id", "group_size", first.alias("first"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def keepers(rows: DataFrame) -> DataFrame:
    """``kept`` for one row of each group: the first, and of rows that share both
    id and text with it, one. Only those rows meet in a window."""
    one = F.row_number().over(Window.partitionBy("text_sha256").orderBy("doc_id")) == 1
    firsts = rows.where("first").withColumn("kept", one)
    return rows.where("NOT first").withColumn("kept", F.lit(False)).unionByName(firsts).drop("first")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    rows = stage(duplicates(docs, key, text), "duplicates")
    names = ["__d_id", "__d_sha"]
    keyed = docs.withColumns({names[0]: F.col(key), names[1]: text_digest(F.col(text))})
    gone = rows.where("NOT first").select(F.col("doc_id").alias(names[0]), F.col("text_sha256").alias(names[1])).distinct()
    left = without(keyed, stage(gone, "dropped"), names)
    again = stage(
        rows.where("first").groupBy(F.col("doc_id").alias(names[0]), F.col("text_sha256").alias(names[1]))
        .agg(F.count("*").alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    if again.isEmpty():
        return left.drop(*names)
    once = without(keyed, without(keyed.select(names), again, names).distinct(), names).dropDuplicates(names)
    return without(left, again, names).unionByName(once).drop(*names)


def apply_changes(changes: DataFrame) -> DataFrame:
    """Live digests after a log of (seq, digest, live) rows: true adds a digest,
    false deletes it, in the order of seq; adding twice or deleting a missing
    digest changes nothing. Returns (digest)."""
    part = F.pmod(F.xxhash64("digest"), F.lit(RANGES)).cast("int").alias("part")

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = CuckooIndex(), None
        done = lambda: pa.RecordBatch.from_pydict({"digest": pa.array([k for k in index.keys if k is not None], pa.binary())})
        for b in batches:
            for digest, live, where in zip(*(b.column(c).to_pylist() for c in ("digest", "live", "part"))):
                if where != at:
                    if at is not None:
                        yield done()
                    index, at = CuckooIndex(), where
                if live:
                    index.insert(digest)
                else:
                    index.delete(digest)
        if at is not None:
            yield done()

    log = changes.where("digest IS NOT NULL").select("seq", "digest", "live", part)
    return log.repartition(F.col("digest")).sortWithinPartitions("part", "seq").mapInArrow(replay, "digest binary")
