"""Near-duplicates by exact shingle similarity: rows of a Jaccard of MOST / PARTS or more.

A row's node is the hash of its set of hashed shingles. SimHash links of simhash.links()
and pairs of the prefix filter are candidates; a pair links if the sets' Jaccard is at
least 4/5. The prefix filter misses no such pair: if n shingles of a set stand in one order
for all sets, two sets of that similarity share one of their first n - ceil(4n/5) + 1. Any
order does; shingles that are frequent in a sample of the rows come last, so that common
lines seldom are candidates. Sizes and places bound what a pair can share.

Runs of a shingle first give pairs with their first and last node only. What these and the
SimHash links join needs no more pairs: the second round takes the pairs of a run that lie
in different components, all of them, and tries them where the run lies: nothing goes out of
a pair unless it may be similar. Before sets are fetched, the counts of a pair's shingles
by hash class bound what it shares, so that most pairs need no sets.

Defined results: a null text is an empty one, and texts without words are copies; null ids
come last; of a component one row stays, also of rows that repeat an id; rows of one id
with other texts have verdicts of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common, simhash

MOST, PARTS = 4, 5
SAMPLE, FREQUENT, ORDERED = 16, 4, 1 << 18
CHUNK = 1 << 18
#: Sketches count shingles by CLASSES hash classes up to 255; larger sets have none.
CLASSES, SKETCHED = 256, 20_000
ROWS = "doc_id long, row long, node long, fp long, n int, sketch binary, prefix array<long>"
ENTRIES = "key long, node long, n int, pos int"


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    return np.unique(simhash.shingle_marks(text, shingle))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return PARTS * shared >= MOST * (len(a) + len(b) - shared)


def prefix(marks: np.ndarray, frequent: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The first shingles of a set; those of the sorted `frequent` come last, by rank."""
    n = len(marks)
    first = n - -(-MOST * n // PARTS) + 1 if n else 0
    if not len(frequent):
        return marks[:first]
    at = np.searchsorted(frequent, marks)
    at[at == len(frequent)] = 0
    rank = np.where(frequent[at] == marks, ranks[at], 0)
    return marks[np.argsort(rank, kind="stable")[:first]]


def sketch(marks: np.ndarray) -> bytes | None:
    """Counts of a set by hash class; None if a count could exceed a byte."""
    counts = np.bincount((marks >> np.uint64(56)).astype(np.int64), minlength=CLASSES)
    return counts.astype(np.uint8).tobytes() if len(marks) <= SKETCHED and counts.max() < 256 else None


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.row_key(docs).alias("row"), F.col("text").cast("string").alias("text"))


def _texts(batch: pa.RecordBatch):
    return (x.as_py() for x in pc.fill_null(batch.column("text"), "").cast(pa.binary()))


def frequent_shingles(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that the sample holds often, sorted, and the rank of each."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                sets = [shingle_set(text, shingle) for text in _texts(batch.slice(k, 100))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["key"])

    sample = rows.where(F.pmod("row", F.lit(SAMPLE)) == 0).mapInArrow(listed, "key long")
    found = sample.groupBy("key").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "key").limit(ORDERED).toPandas()
    keys = found["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.log2(found["count"].to_numpy(np.float64)[order]).astype(np.int8) if len(keys) else np.zeros(0, np.int8)


def marked_rows(rows: DataFrame, shingle: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, shingle))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = [x.split()[0] for x in ROWS.split(", ")]
        for batch in batches:
            nodes, fps, sizes, sketches, firsts = [], [], [], [], []
            for text in _texts(batch):
                marks = simhash.shingle_marks(text, shingle)
                fps.append(simhash.folded(marks))
                marks = np.unique(marks)
                nodes.append(xxhash.xxh64_intdigest(marks.tobytes(), 7))
                sizes.append(len(marks))
                sketches.append(sketch(marks))
                firsts.append(prefix(marks, *sent.value).view(np.int64))
            long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            offsets = np.cumsum([0, *map(len, firsts)])
            flat = np.concatenate(firsts) if firsts else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), long(nodes), long(fps), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), lists], names=names)

    return rows.mapInArrow(marked, ROWS)


def whole_runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut between runs of the first column."""
    held: list = []
    join = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        keys = columns[0]
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if not cut and held and held[-1][0][-1] != keys[0]:
            yield join(held)
            held = []
        if cut:
            yield join([*held, [x[:cut] for x in columns]])
            held = []
        held.append([x[cut:] for x in columns])
    if held:
        yield join(held)


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return at, np.diff(np.concatenate((at, [len(keys)])))


def _sorted_runs(entries: DataFrame) -> DataFrame:
    return entries.repartition("key").sortWithinPartitions("key", "node")


def shared_entries(marked: DataFrame) -> DataFrame:
    """Entries of prefix shingles that two nodes or more have in their prefixes."""
    names = [x.split()[0] for x in ENTRIES.split(", ")]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, n, pos in whole_runs(batches, names):
            fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])))
            keys, nodes, n, pos = keys[fresh], nodes[fresh], n[fresh], pos[fresh]
            _, sizes = _starts(keys)
            shared = np.repeat(sizes > 1, sizes)
            for k in range(0, len(keys), CHUNK):
                part = shared[k : k + CHUNK]
                yield pa.RecordBatch.from_arrays([pa.array(x[k : k + CHUNK][part]) for x in (keys, nodes, n, pos)], names=names)

    entries = marked.select(F.posexplode("prefix").alias("pos", "key"), "node", "n").select("key", "node", "n", "pos")
    return _sorted_runs(entries).mapInArrow(kept, ENTRIES)


def _may(n: np.ndarray, pos: np.ndarray, m, at) -> np.ndarray:
    """Whether sets of n and m shingles that share those at pos and at can be similar."""
    most = np.minimum(pos, at) + 1 + np.minimum(n - pos, m - at) - 1
    return (PARTS + MOST) * np.minimum(most, np.minimum(n, m)).astype(np.int64) >= MOST * (n.astype(np.int64) + m)


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


def leader_pairs(shared: DataFrame) -> DataFrame:
    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, n, pos in whole_runs(batches, ["key", "node", "n", "pos"]):
            at, sizes = _starts(keys)
            for leader in (at, at + sizes - 1):
                first = np.repeat(leader, sizes)
                fit = np.flatnonzero((nodes != nodes[first]) & _may(n, pos, n[first], pos[first]))
                yield _pairs(nodes[fit], nodes[first[fit]])

    return _sorted_runs(shared).mapInArrow(led, "u long, v long").distinct()


def parted_runs(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries, with their root, of the runs that lie in several components; of runs with the
    same nodes one is enough, as any shared shingle makes a pair a candidate."""
    placed = shared.join(roots, "node", "left").select("key", "node", "n", "pos", F.coalesce("root", "node").alias("root"))
    placed = common.stored(placed, "placed-shingles")
    members = F.sum(F.shiftright(F.xxhash64("node"), 20))  # cannot overflow
    runs = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), members.alias("members"), F.bit_xor("node").alias("mixed"))
    kept = runs.where("low <> high").groupBy("size", "members", "mixed").agg(F.min("key").alias("key")).select("key")
    return placed.join(kept, "key", "left_semi")


def cross_pairs(parted: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs of a run that lie in different components and may be similar, by their sizes and
    places and by their sketches. A run's pairs are tried where its entries lie, a node
    against those behind it at a time; only what may be similar goes out."""
    names = ["key", "node", "n", "pos", "root", "sketch"]

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, n, pos, root, sketch_ in whole_runs(batches, names):
            has = np.array([x is not None for x in sketch_])
            counts = np.frombuffer(b"".join(x if x is not None else bytes(CLASSES) for x in sketch_), np.uint8).reshape(-1, CLASSES)
            left, right, held = [], [], 0
            for at, size in zip(*_starts(keys), strict=True):
                end = at + size
                for k in range(at, end - 1):
                    fit = k + 1 + np.flatnonzero((root[k + 1 : end] != root[k]) & _may(n[k + 1 : end], pos[k + 1 : end], n[k], pos[k]))
                    for j in range(0, len(fit), CHUNK // CLASSES):  # bounded memory
                        some = fit[j : j + CHUNK // CLASSES]
                        most = np.minimum(counts[some], counts[k]).sum(axis=1, dtype=np.int64)
                        good = ((PARTS + MOST) * most >= MOST * (n[some].astype(np.int64) + n[k])) | ~has[some] | ~has[k]
                        some = some[good]
                        left.append(np.full(len(some), nodes[k]))
                        right.append(nodes[some])
                        held += len(some)
                    if held >= CHUNK:
                        yield _pairs(np.concatenate(left), np.concatenate(right))
                        left, right, held = [], [], 0
            if held:
                yield _pairs(np.concatenate(left), np.concatenate(right))

    described = parted.join(sketches.select("node", "sketch"), "node").select(*names)
    return _sorted_runs(described).mapInArrow(crossed, "u long, v long").distinct()


def shingle_sets(rows: DataFrame, marked: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """node and its shingles of the wanted nodes, from one row of each."""
    one = common.stored(marked.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("row").alias("row")), "set-rows")

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle).tobytes() for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "marks"])

    return rows.select("row", "text").join(one, "row").select("node", "text").mapInArrow(taken, "node long, marks binary")


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, v) that can be similar by their sketches (node, n, sketch)."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.and_(pc.is_valid(batch.column("a")), pc.is_valid(batch.column("b")))
            some = batch.filter(held)
            counts = [np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint8).reshape(-1, CLASSES) for c in "ab"]
            most = np.minimum(*counts).sum(axis=1, dtype=np.int64)
            sizes = some.column("n").to_numpy(zero_copy_only=False).astype(np.int64) + some.column("m").to_numpy(zero_copy_only=False)
            good = (PARTS + MOST) * most >= MOST * sizes
            yield some.select(["u", "v"]).filter(pa.array(good, pa.bool_()))
            yield batch.filter(pc.invert(held)).select(["u", "v"])

    end = lambda x, n, y: sketches.select(F.col("node").alias(x), F.col("n").alias(n), F.col("sketch").alias(y))
    both = pairs.join(end("u", "n", "a"), "u").join(end("v", "m", "b"), "v")
    return both.select("u", "v", "n", "m", "a", "b").mapInArrow(tested, "u long, v long")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(a, b, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("marks").alias("a")), "u").join(
        sets.select(F.col("node").alias("v"), F.col("marks").alias("b")), "v"
    )
    return both.select("u", "v", "a", "b").mapInArrow(tested, "u long, v long").distinct()


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """Pairs of nodes that SimHash proposes: the least nodes of linked fingerprints, and all
    nodes of a fingerprint with its least."""
    nodes = common.stored(marked.groupBy("fp").agg(F.min("node").alias("least")), "near-fingerprints")
    links = simhash.links(nodes)
    end = lambda x, name: nodes.select(F.col("fp").alias(x), F.col("least").alias(name))
    linked = links.join(end("u", "a"), "u").join(end("v", "b"), "v").select("a", "b")
    equal = marked.select("fp", F.col("node").alias("a")).join(nodes, "fp").select("a", F.col("least").alias("b"))
    return linked.unionByName(equal).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def near_roots(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row and root (the component's least node) of every row."""
    rows = _rows(docs)
    spark = docs.sparkSession
    marked = common.stored(marked_rows(rows, shingle), "near-rows")
    shared = common.stored(shared_entries(marked), "shared-shingles")
    common.release_shuffles(spark)
    sketches = common.stored(marked.groupBy("node").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")

    def linked(close: DataFrame) -> DataFrame:
        close = common.stored(close, "near-candidates")
        common.release_shuffles(spark)
        wanted = close.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        sets = common.stored(shingle_sets(rows, marked, wanted, shingle), "shingle-sets")
        common.release_shuffles(spark)
        links = common.stored(verified(close, sets), "near-links")
        common.discard(sets)
        common.release_shuffles(spark)
        return links

    to_root = lambda links: simhash.stars(links).select(F.col("u").alias("node"), F.col("v").alias("root"))
    links = linked(bounded(leader_pairs(shared).unionByName(simhash_pairs(marked)).distinct(), sketches))
    links = links.unionByName(linked(cross_pairs(parted_runs(shared, to_root(links)), sketches)))
    roots = to_root(links)
    return marked.join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, shingle: int) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id."""
    placed = common.stored(near_roots(docs, shingle), "near-placed")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")).alias("best"))
    return common.one_row_each(docs, placed, best.select("best.row"), "near")
