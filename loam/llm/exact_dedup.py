"""Exact deduplication over a cuckoo-filter index.

Texts are equal when they are after deleting white space; the digest is the SHA-256 of
what is left. Every map task sums up its digests first (rows, best row), so a group with
a third of all rows reaches the index as few entries a task. Entries are dealt to index
buckets by digest. Each bucket owns a cuckoo filter and the bucketed content behind it: a
miss is a new live digest, a hit is verified against the content that lies at the
digest's first place, and a false hit is stored as a digest of its own. When an insertion overflows,
the filter doubles and is filled again from the stored digests. Deletion takes the
fingerprint out of the filter and the digest out of the content.

Of equal texts, the row with the most code points stays, then the smallest doc_id.
Defined results: a null text is an empty one; null ids come last in ties; rows that repeat
a doc_id count in group_size, and exact_groups(), whose rows are told apart by doc_id and
text, calls all of them kept if one is (drop_copies() keeps one row); an empty table gives
no rows; other columns are passed by.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common

SLOTS = 4
KICKS = 200
DIGESTS_PER_BUCKET = 1024
HELD = 20_000
ENTRIES = "bucket int, digest binary, n long, points long, id long"
INDEX = "bucket int, width int, filter binary, digests array<binary>, n array<long>, points array<long>, id array<long>"


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four slots; a fingerprint has two buckets."""

    def __init__(self, width: int, slots: array | None = None):
        self.width = width
        self.slots = slots if slots is not None else array("H", bytes(2 * SLOTS * width))

    def places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "big") or 1
        first = int.from_bytes(digest[2:10], "big") & (self.width - 1)
        return mark, first, self.other(first, mark)

    def other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & (self.width - 1))

    def _bucket(self, place: int) -> array:
        return self.slots[SLOTS * place : SLOTS * (place + 1)]

    def __contains__(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        return mark in self._bucket(a) or mark in self._bucket(b)

    def _put(self, place: int, mark: int) -> bool:
        for k in range(SLOTS * place, SLOTS * (place + 1)):
            if not self.slots[k]:
                self.slots[k] = mark
                return True
        return False

    def insert(self, digest: bytes) -> bool:
        """False on overflow; the filter must then be built anew, as one mark is homeless."""
        mark, a, b = self.places(digest)
        if self._put(a, mark) or self._put(b, mark):
            return True
        place = a
        for kick in range(KICKS):
            k = SLOTS * place + kick % SLOTS
            mark, self.slots[k] = self.slots[k], mark
            place = self.other(place, mark)
            if self._put(place, mark):
                return True
        return False

    def delete(self, digest: bytes) -> bool:
        mark, a, b = self.places(digest)
        for place in (a, b):
            for k in range(SLOTS * place, SLOTS * (place + 1)):
                if self.slots[k] == mark:
                    self.slots[k] = 0
                    return True
        return False


class Bucket:
    """One index bucket: the filter, and the live digests with what is known of each."""

    def __init__(self, width: int = 16):
        self.filter = CuckooFilter(width)
        self.content: dict[int, list[list]] = {}

    @classmethod
    def load(cls, row) -> Bucket:
        self = cls(int(row.width))
        self.filter = CuckooFilter(int(row.width), array("H", row.filter))
        for digest, *known in zip(row.digests, row.n, row.points, row.id, strict=True):
            self._store([bytes(digest), *(None if x is None or x != x else int(x) for x in known)])
        return self

    def _store(self, entry: list) -> None:
        self.content.setdefault(self.filter.places(entry[0])[1], []).append(entry)

    def entries(self) -> Iterator[list]:
        for stored in self.content.values():
            yield from stored

    def find(self, digest: bytes) -> list | None:
        """A filter hit, verified against the content; None for a miss or a false hit. The
        mark may stand in either of its places, the content always lies at the first."""
        if digest not in self.filter:
            return None
        home = self.content.get(self.filter.places(digest)[1], ())
        return next((x for x in home if x[0] == digest), None)

    def insert(self, digest: bytes, n: int, points: int, doc_id: int | None) -> None:
        known = self.find(digest)
        if known is not None:
            known[1] += n
            if better(points, doc_id, known[2], known[3]):
                known[2:] = points, doc_id
            return
        placed = self.filter.insert(digest)
        self._store([digest, n, points, doc_id])
        while not placed:
            placed = self._resize()

    def _resize(self) -> bool:
        live = list(self.entries())
        self.filter, self.content = CuckooFilter(2 * self.filter.width), {}
        placed = True
        for entry in live:
            placed = self.filter.insert(entry[0]) and placed
            self._store(entry)
        return placed

    def delete(self, digest: bytes) -> None:
        if (known := self.find(digest)) is None:
            return
        self.filter.delete(digest)
        home = self.filter.places(digest)[1]
        self.content[home] = [x for x in self.content[home] if x is not known]

    def row(self, bucket: int) -> dict:
        entries = list(self.entries())
        columns = dict(zip(("digests", "n", "points", "id"), map(list, zip(*entries)), strict=True)) if entries else dict.fromkeys(("digests", "n", "points", "id"), [])
        return {"bucket": bucket, "width": self.filter.width, "filter": self.filter.slots.tobytes()} | columns


def better(points: int, doc_id: int | None, than_points: int, than_id: int | None) -> bool:
    if points != than_points:
        return points > than_points
    return doc_id is not None and (than_id is None or doc_id < than_id)


def digests(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, digest, n_points of every row, and its columns `more`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.unhex(F.sha2(F.translate(text, common.SPACES, ""), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("digest"), F.length(text).cast("long").alias("n_points"), *more)


def entries(hashed: DataFrame, buckets: int) -> DataFrame:
    """Digests summed up within each task, HELD distinct ones at a time, with the index
    bucket they belong to."""

    def packed(best: dict[bytes, list]) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "bucket": [int.from_bytes(d[-8:], "big") % buckets for d in best],
                "digest": list(best),
                "n": [x[0] for x in best.values()],
                "points": [x[1] for x in best.values()],
                "id": pd.array([x[2] for x in best.values()], dtype="Int64"),
            }
        )

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, list] = {}
        for frame in frames:
            for doc_id, digest, points in zip(frame["doc_id"].astype("Int64"), frame["digest"], frame["n_points"], strict=True):
                doc_id = None if doc_id is pd.NA else int(doc_id)
                known = best.get(digest)
                if known is None:
                    best[digest] = [1, points, doc_id]
                    continue
                known[0] += 1
                if better(points, doc_id, known[1], known[2]):
                    known[1:] = points, doc_id
            if len(best) >= HELD:
                yield packed(best)
                best = {}
        yield packed(best)

    return hashed.mapInPandas(summed, ENTRIES)


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def update(index: DataFrame, inserts: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The index after inserting entries and then deleting digests (bucket, digest).

    A bucket holds about DIGESTS_PER_BUCKET digests if entries() was given that many
    buckets, so what a task holds does not grow with the corpus.
    """
    changes = inserts.select("bucket", "digest", "n", "points", "id")
    if deletes is not None:
        gone = deletes.select("bucket", "digest", *(F.lit(None).cast("long").alias(c) for c in ("n", "points", "id")))
        changes = changes.unionByName(gone)

    def changed(key, state: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
        bucket = Bucket.load(next(state.itertuples())) if len(state) else Bucket()
        change = change.sort_values("n", na_position="last", kind="stable")
        for digest, n, points, doc_id in zip(change["digest"], change["n"], change["points"], change["id"], strict=True):
            if n is None or n != n:
                bucket.delete(bytes(digest))
            else:
                bucket.insert(bytes(digest), int(n), int(points), None if doc_id is None or doc_id != doc_id else int(doc_id))
        return pd.DataFrame([bucket.row(int(key[0]))])

    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(changed, INDEX)


def members(index: DataFrame) -> DataFrame:
    """digest, group_size and keep_id of every live digest."""
    return index.select(F.explode(F.arrays_zip("digests", "n", "id")).alias("e")).select(
        F.col("e.digests").alias("digest"), F.col("e.n").alias("group_size"), F.col("e.id").alias("keep_id")
    )


def live_digests(hashed: DataFrame, digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """members() of the index of a stored table of digests()."""
    buckets = common.partitions_for(hashed.count(), digests_per_bucket, least=64)
    summed = entries(hashed.select("doc_id", "digest", "n_points"), buckets)
    return common.stored(members(update(empty_index(hashed.sparkSession), summed)), "live-digests")


def exact_groups(docs: DataFrame, digests_per_bucket: int = DIGESTS_PER_BUCKET) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    hashed = common.stored(digests(docs), "digests")
    live = live_digests(hashed, digests_per_bucket)
    return hashed.join(live, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts. Of the rows that have the group's
    keep_id, the longest text stays, then the least row key; a row without an id stays only
    if its whole group has none."""
    rows = docs.select("doc_id", "text", common.row_key(docs).alias("row"))
    hashed = common.stored(digests(rows, "row"), "digests")
    named = hashed.join(live_digests(hashed), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    best = named.groupBy("digest").agg(F.min(F.struct((-F.col("n_points")).alias("shorter"), "row")).alias("best"))
    return common.one_row_each(docs, hashed, best.select("best.row"), "exact")
