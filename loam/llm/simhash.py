"""SimHash near-duplicates by pigeonring filtering.

The 64 bits stand in a ring of five segments. If two fingerprints differ in at most four
bits, then for some segment the chain that starts there keeps within its share at every
length: at most floor(4 l / 5) differences in its first l segments. So the first segment
agrees and the second differs in one bit at most: an equality of keys once one bit of the
second segment is blanked, for each bit in turn. Each fingerprint gives 64 such keys of 24
or 25 free bits. Rows of a key meet in one sorted run, where the longer chains (two differences
in three segments, three in four) prune pairs before the full Hamming check.

A run emits a spanning forest of its links, never its pairs: a breadth-first search in
which each fingerprint is held against those not reached yet. Equal fingerprints are one
from the start. Runs above RUN fingerprints are dealt out anew: of two that link there, one
of the ring's three other segments differs in one bit at most, so that segment, once more
with each bit blanked, is a second key. Runs that are still above RUN, of fingerprints that
crowd together, are held against each other as pairs of blocks. The forests are joined to components by alternating large and small stars.

Defined results: a null text is an empty one, and texts without words have fingerprint 0
and link with any other of four bits or fewer; null ids belong to groups but never name
them; repeated rows are copies; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common

SHINGLE = 4
DISTANCE = 4
SEED = 42
WIDTHS = (13, 13, 13, 13, 12)
STARTS = tuple(sum(WIDTHS[:k]) for k in range(len(WIDTHS)))
RUN = 1 << 15
CHUNK = 1 << 16


def _segment(k: int) -> np.uint64:
    k %= len(WIDTHS)
    return np.uint64(((1 << WIDTHS[k]) - 1) << STARTS[k])


#: For each start, (mask, most) of the chains of 3 segments and more.
CHAINS = [
    [
        (np.bitwise_or.reduce([_segment(k + x) for x in range(n)]), DISTANCE * n // len(WIDTHS))
        for n in range(3, len(WIDTHS) + 1)
    ]
    for k in range(len(WIDTHS))
]


def shingle_marks(text: bytes, shingle: int) -> np.ndarray:
    """The hashes of a text's shingles, in their order; a short text is one shingle."""
    import xxhash

    hashed = xxhash.xxh64_intdigest
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.array([hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], "<u8")


def folded(marks: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for k in range(0, len(marks), CHUNK):
        bits = np.unpackbits(marks[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(marks), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return folded(shingle_marks(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed number) of every row."""

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
            found = np.array([fingerprint(x.as_py(), shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(marked, "doc_id long, fp long")


def chain_keys(fps: np.ndarray) -> np.ndarray:
    """A row of keys for each fingerprint: start, blanked bit, first and second segment."""
    columns = []
    for k in range(len(WIDTHS)):
        after = (k + 1) % len(WIDTHS)
        first = (fps & _segment(k)) >> np.uint64(STARTS[k]) << np.uint64(24) | np.uint64(k)
        second = (fps & _segment(after)) >> np.uint64(STARTS[after])
        for bit in range(WIDTHS[after]):
            columns.append(first | (second & ~np.uint64(1 << bit)) << np.uint64(8) | np.uint64(bit << 3))
    return np.stack(columns, axis=1).view(np.int64)


def longer_keys(keys: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """A row of keys for each fingerprint of a run: the run's key with each of the other three
    segments, each bit of it blanked in turn; the start stays readable."""
    start, columns = keys.view(np.uint64) & np.uint64(7), []
    for k in range(2, len(WIDTHS)):
        for bit in range(max(WIDTHS)):
            mask = np.array([int(_segment(s + k)) & ~(1 << (STARTS[(s + k) % len(WIDTHS)] + bit)) for s in range(len(WIDTHS))], np.uint64)
            # Blanking a bit beyond a narrow segment's end blanks none, which is a key as well.
            x = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (fps & mask[start])) + np.uint64(k << 8 | bit)
            x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
            columns.append((x ^ x >> np.uint64(29)) & ~np.uint64(7) | start)
    return np.stack(columns, axis=1).view(np.int64)


def _near(fp: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which of the others pass every chain from start; the last chain is the whole ring."""
    differ = others ^ fp
    kept = np.bitwise_count(differ & CHAINS[start][0][0]) <= CHAINS[start][0][1]
    for mask, most in CHAINS[start][1:]:
        kept &= np.bitwise_count(differ & mask) <= most
    return kept


def forest(fps: np.ndarray, start: int) -> list[tuple[int, int]]:
    """Links that join what the links among fps join."""
    links, rest, queue = [], fps, []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
            continue
        fp = queue.pop()
        near = _near(fp, rest, start)
        if near.any():
            reached = rest[near]
            links += [(int(fp), int(x)) for x in reached]
            queue += list(reached)
            rest = rest[~near]
    return links


def run_links(batches: Iterator[pa.RecordBatch], most: int | None) -> Iterator[pa.RecordBatch]:
    """Links of each run of a key in sorted rows (key, fp); runs above most as they are, with
    their key."""
    names = ["key", "a", "b"]

    def emit(keys: list, left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(left.astype(np.uint64).view(np.int64)), pa.array(right.astype(np.uint64).view(np.int64))], names=names)

    def settle(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((at, [len(keys)])))
        twos = at[sizes == 2]
        if len(twos):
            a, b, start = fps[twos], fps[twos + 1], keys[twos] & 7
            kept = np.zeros(len(twos), bool)
            for k in range(len(WIDTHS)):
                mine = start == k
                kept[mine] = _near(a[mine], b[mine], k)
            if kept.any():
                yield emit([None] * int(kept.sum()), a[kept], b[kept])
        links = []
        for k, n in zip(at[sizes > 2], sizes[sizes > 2], strict=True):
            if most is not None and n > most:
                yield emit([int(keys[k])] * int(n), fps[k : k + n], fps[k : k + n])
            else:
                links += forest(fps[k : k + n], int(keys[k] & 7))
        if links:
            pairs = np.array(links, np.uint64)
            yield emit([None] * len(links), pairs[:, 0], pairs[:, 1])

    held_keys, held_fps, over = [], [], None
    for batch in batches:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        if not len(keys):
            continue
        if held_keys and held_keys[-1][-1] != keys[0] and over is None:
            yield from settle(np.concatenate(held_keys), np.concatenate(held_fps))
            held_keys, held_fps = [], []
        if over is not None:  # the middle of a run that is too long to hold
            n = int(np.searchsorted(keys, over, "right"))
            if n:
                yield emit([over] * n, fps[:n], fps[:n])
            keys, fps = keys[n:], fps[n:]
            if not len(keys):
                continue
            over = None
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        held_keys.append(keys)
        held_fps.append(fps)
        if cut:
            whole_keys, whole_fps = np.concatenate(held_keys), np.concatenate(held_fps)
            cut = int(np.searchsorted(whole_keys, keys[-1], "left"))
            if cut:
                yield from settle(whole_keys[:cut], whole_fps[:cut])
            held_keys, held_fps = [whole_keys[cut:]], [whole_fps[cut:]]
        n = sum(map(len, held_keys))
        if most is not None and n > most and held_keys[0][0] == held_keys[-1][-1]:
            over = int(held_keys[0][0])
            whole = np.concatenate(held_fps)
            yield emit([over] * n, whole, whole)
            held_keys, held_fps = [], []
    if held_keys:
        yield from settle(np.concatenate(held_keys), np.concatenate(held_fps))


def links(nodes: DataFrame, run: int = RUN) -> DataFrame:
    """Links (u > v) between distinct fingerprints, enough to join whatever is linked."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            keys = chain_keys(fps.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["key", "fp"])

    def dealt_anew(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                fps = part.column("fp").to_numpy(zero_copy_only=False)
                keys = longer_keys(part.column("key").to_numpy(zero_copy_only=False), fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["key", "fp"])

    def linked(rows: DataFrame, most: int | None) -> DataFrame:
        return (
            rows.repartition("key")
            .sortWithinPartitions("key")
            .mapInArrow(lambda batches: run_links(batches, most), "key long, a long, b long")
        )

    found = common.stored(linked(nodes.select("fp").mapInArrow(keyed, "key long, fp long"), run), "links")
    over = found.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if not over.isEmpty():
        again = common.stored(linked(over.mapInArrow(dealt_anew, "key long, fp long"), run), "longer-links")
        found = found.where("key IS NULL").unionByName(again)
        over = again.where("key IS NOT NULL").select("key", F.col("a").alias("fp"))
    if not over.isEmpty():
        counts = over.groupBy("key").agg(F.ceil(F.count("*") / (run // 2)).cast("int").alias("blocks"))
        mine = over.join(counts, "key").withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        dealt = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        pair = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))
        dealt = dealt.select((F.shiftleft(pair, 3) + F.col("key").bitwiseAND(7)).alias("key"), "fp")
        found = found.where("key IS NULL").unionByName(common.stored(linked(dealt, None), "block-links"))
    return found.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """u -> v, the smallest node of u's component, for every u that is not the smallest."""

    def signature(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    current = common.stored(edges, "edges")
    before = signature(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = common.stored(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        current = common.stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-stars")
        now = signature(current)
        if now == before:
            return current
        before = now


def near_groups(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    marked = common.stored(fingerprints(docs, shingle), "fingerprints")
    nodes = common.stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    joined = stars(links(nodes)).select(F.col("u").alias("fp"), "v")
    placed = common.stored(nodes.join(joined, "fp", "left").select("fp", F.coalesce("v", "fp").alias("root"), "least"), "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(names, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
