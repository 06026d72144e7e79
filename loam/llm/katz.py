"""Katz back-off language model over n-grams of words, up to an order.

Counts are discounted by Good-Turing up to K occurrences; the mass left by a history's
grams goes to the other words by a back-off weight
    alpha(h) = (1 - sum of P(w|h) over kept grams) / (1 - sum of P(w|h') over their words),
h' being the history without its first word, so that every history's probabilities sum to
one over the vocabulary and one class of unknown words, which gets what the discounted
words leave. Grams of two words and more seen fewer than MIN_COUNT times count towards the
counts of counts but are not kept (their discount is total).
Where a count of counts is too thin for Good-Turing to give a ratio between 0 and 1,
(r - 0.5) / r stands in; where a history's discounts leave nothing, one unseen occurrence
is added to its count.

Each token is scored by the recursion P(w|h) = P*(w|h) if the gram is kept, else
alpha(h) P(w|h'). In logarithms the recursion telescopes: with a gram all its endings are
kept, so a text's score is the sum over the kept grams that its tokens end of
    log P*(w|h) - log alpha(h) - log P*(w|h')  +  log alpha(the gram as a history),
the first three terms being log P(w) for a word. So each gram has one value, and scoring is
one join of occurrences with the table of values.

Grams of the top order, by far the most, have no table of values. P*(w|h) being the
discounted count c by the history's total, theirs is
    log c  +  (- log total(h) - log alpha(h))  +  (- log P*(w|h')),
of which the middle belongs to the history and the last to the ending, both a word shorter
and in the table of values. A bucket that gets all occurrences of a gram counts those of
training texts itself, which gives log c. Where all grams are kept, those of a training
text are, so the other terms are summed up with its shorter grams; for other texts the
bucket asks for them once it has found the gram.

All shuffles of texts move occurrences as packed arrays: a map task turns blocks of
texts into hashed grams, deals them to buckets by key, and ships one row for a block and
bucket (where there are more of these than grams, one row for a gram at most). Counting
sums equal keys within a block first. In scoring, keys with at least 1 / HEAVY of all
training tokens - at most HEAVY grams of each order, whatever the corpus - are known to
every task and never shipped, which also takes the hot keys out.

Words are 64-bit XXH64 keys, longer grams 64-bit mixes of the keys of their history and of
their ending. Defined results: a null text is an empty one (one
end token); a null doc_id is in the training fold; without training rows every score is 0;
repeated rows count and are scored each; an empty table gives no rows; other columns are
passed by.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common

K = 5
ORDER = 2
MIN_COUNT = 1
HEAVY = 1 << 21
FOLDS, HELD_OUT = 7, 2
BLOCK_TOKENS = 1_500_000
BLOCK_DOCS = 60_000
BUCKET_BYTES = 16 << 20
START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
WORDS_KEPT = 300_000

PACKED = "bucket int, kind int, block long, keys binary, more binary, counts binary"
COUNTED = "level int, key long, prev long, cur long, c long"
DOC = np.dtype([("doc_id", "<i8"), ("null", "?"), ("held", "?"), ("n", "<i8"), ("known", "<i8"), ("base", "<f8"), ("score", "<f8")])
PART = np.dtype([("doc", "<u2"), ("known", "<i4"), ("base", "<f8"), ("score", "<f8")])
SHORT = np.dtype([("doc", "<u2"), ("score", "<f8")])
#: Kinds of packed rows: the order of a model's grams, LOOKUP more for occurrences; of those
#: a word below the top order also ALL (value, history's and ending's term), HISTORY and
#: ENDING (one of these terms).
LOOKUP, ALL, HISTORY, ENDING = 100, 150, 160, 161
#: Occurrences of the top order: in training texts that keep all, in others, in held-out ones.
DOCS, TOP, TOP_UNSURE, TOP_HELD = 200, 300, 301, 302
#: Kinds of results: sums by document with word counts, without.
WIDE_PART, SHORT_PART = 400, 401
#: Rows of a table that a task works on at a time.
GATHERED = 1 << 19


class Hasher(dict):
    """Keys of words; forgets when it holds WORDS_KEPT."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        key = self[word] = xxhash.xxh64_intdigest(word, 1)
        return key


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def pair_keys(prev: np.ndarray, cur: np.ndarray) -> np.ndarray:
    mixed = prev * np.uint64(0x9E3779B97F4A7C15) + cur
    mixed = (mixed ^ mixed >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(32)


@dataclass
class Block:
    """Texts as hashed words, each text ended by END."""

    doc_ids: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    words: array = field(default_factory=lambda: array("Q"))

    def add(self, doc_id: int | None, text: bytes, hasher: Hasher) -> None:
        before = len(self.words)
        self.words.extend(map(hasher.__getitem__, text.lower().split()))
        self.words.append(int(END))
        self.doc_ids.append(doc_id)
        self.sizes.append(len(self.words) - before)

    @property
    def full(self) -> bool:
        return len(self.words) >= BLOCK_TOKENS or len(self.sizes) >= BLOCK_DOCS

    def grams(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each order: it, and the keys, histories, endings and texts of all its grams.
        Pairs begin with START at a text's begin, longer grams behind it."""
        low, sizes = np.frombuffer(self.words, np.uint64), np.array(self.sizes, np.int64)
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
        yield 1, low, low, low, doc
        history = np.empty_like(low)
        history[1:] = low[:-1]
        history[np.cumsum(sizes) - sizes] = START
        for n in range(2, order + 1):
            keys = pair_keys(history, low)
            yield n, keys, history, low, doc
            # Of the next order: each gram but the first of its text, with the one before it.
            inner = np.flatnonzero(doc[1:] == doc[:-1]) + 1
            history, low, doc = keys[inner - 1], keys[inner], doc[inner]


def blocks(batches: Iterator[pa.RecordBatch], wanted) -> Iterator[Block]:
    hasher, block = Hasher(), Block()
    for batch in batches:
        texts = pc.fill_null(batch.column("text"), "").cast(pa.binary())
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
            if wanted(doc_id):
                block.add(doc_id, text.as_py(), hasher)
                if block.full:
                    yield block
                    block = Block()
    if block.sizes:
        yield block


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return keys.view(np.int64) % buckets


def dealt(keys: np.ndarray, buckets: int, *others: np.ndarray) -> Iterator[tuple]:
    """(bucket, keys, others...) of each bucket that has keys, in their order."""
    if not len(keys):
        return
    where = bucket_of(keys, buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(where, kind="stable")
    where, columns = where[order], [x[order] for x in (keys, *others)]
    cuts = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True):
        yield int(where[a]), *(x[a:b] for x in columns)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PACKED.split(", ")])


def count_blocks(batches: Iterator[pa.RecordBatch], buckets: int, order: int) -> Iterator[pa.RecordBatch]:
    """Grams of training texts, summed up by block, packed by bucket."""
    for block in blocks(batches, lambda x: not held_out(x)):
        rows = []
        for n, keys, history, low, _ in block.grams(order):
            if n == 1:
                keys, c = np.unique(keys, return_counts=True)
                rows += [(b, 1, 0, k.tobytes(), None, c.tobytes()) for b, k, c in dealt(keys, buckets, c.astype("<u4"))]
                continue
            keys, at, c = np.unique(keys, return_index=True, return_counts=True)
            sort = np.argsort(history[at], kind="stable")  # equal histories side by side pack well
            for b, _, p, w, c in dealt(keys[sort], buckets, history[at][sort], low[at][sort], c[sort].astype("<u4")):
                rows.append((b, n, 0, p.tobytes(), w.tobytes(), c.tobytes()))
        yield _packed(rows)


def runs(batches: Iterator[pa.RecordBatch], by) -> Iterator[list[dict]]:
    """Rows of sorted input, gathered while by(row) stays the same."""
    held, last = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = by(row)
            if key != last and held:
                yield held
                held = []
            last = key
            held.append(row)
    if held:
        yield held


def _joined(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def sum_counts(batches: Iterator[pa.RecordBatch], min_count: int, order: int) -> Iterator[pa.RecordBatch]:
    """Counts by key; level 1 words, 2 and more kept grams, below 0 counts of counts (by key)."""
    names = [x.split()[0] for x in COUNTED.split(", ")]
    for rows in runs(batches, lambda r: (r["bucket"], r["kind"])):
        level = rows[0]["kind"]
        prev, c = _joined(rows, "keys", "<u8"), _joined(rows, "counts", "<u4").astype(np.int64)
        cur = prev if level == 1 else _joined(rows, "more", "<u8")
        keys = prev if level == 1 else pair_keys(prev, cur)
        sort = np.argsort(keys)
        keys, prev, cur, c = keys[sort], prev[sort], cur[sort], c[sort]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        c = np.add.reduceat(c, first)
        of_counts = np.bincount(np.minimum(c, K + 2))[1 : K + 2]
        known = np.flatnonzero(of_counts)
        kept = c >= (1 if level == 1 else min_count)
        first, c = first[kept], c[kept]
        top = level == order > 1
        if top:  # equal histories side by side pack well; keys follow from the other columns
            sort = np.argsort(prev[first], kind="stable")
            first, c = first[sort], c[sort]
        columns = [np.full(len(first), level, np.int32), keys[first].view(np.int64), prev[first].view(np.int64), cur[first].view(np.int64), c]
        extra = [np.full(len(known), -level, np.int32), known + 1, known * 0, known * 0, of_counts[known]]
        columns = [np.concatenate((x, y.astype(x.dtype))) for x, y in zip(columns, extra, strict=True)]
        no_key = (columns[0] == level) & top
        yield pa.RecordBatch.from_arrays([pa.array(x, mask=no_key if name == "key" else None) for name, x in zip(names, columns, strict=True)], names=names)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def n_buckets(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(common.shuffle_width(docs.sparkSession), -(-size // BUCKET_BYTES))


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """A partition for each bucket, models before the occurrences that look them up."""
    return rows.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "kind")


def counts(docs: DataFrame, buckets: int, min_count: int = MIN_COUNT, order: int = ORDER) -> DataFrame:
    """The partitioned table of counts: level, key, prev (the history's key), cur (the
    ending's), c. Grams of the top order leave key null."""
    packed = _texts(docs).mapInArrow(lambda x: count_blocks(x, buckets, order), PACKED)
    summed = by_bucket(packed, buckets).mapInArrow(lambda x: sum_counts(x, min_count, order), COUNTED)
    spark = docs.sparkSession
    path = common.new_path(spark, "ngram-counts")
    summed.write.partitionBy("level").option("compression", "zstd").parquet(path)
    return spark.read.schema(summed.schema).parquet(path)


def discounts(of_counts: dict[int, int], k: int = K) -> list[float]:
    """Good-Turing ratios d_1 .. d_k."""
    n = [of_counts.get(r, 0) for r in range(k + 2)]
    common_part = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    found = []
    for r in range(1, k + 1):
        d = -1.0
        if common_part < 1 and n[r]:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common_part) / (1 - common_part)
        found.append(d if 0 < d < 1 else (r - 0.5) / r)
    return found


def _discounted(c: Column, ratios: list[float]) -> Column:
    out = c.cast("double")
    for r, d in enumerate(ratios, 1):
        out = F.when(c == r, F.lit(r * d)).otherwise(out)
    return out


@dataclass
class Terms:
    """Sorted keys, and of each the value, the logarithm of its count for the base, and what it
    adds as a history and as an ending of a gram of the top order."""

    keys: np.ndarray
    value: np.ndarray
    base: np.ndarray
    history: np.ndarray
    ending: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, value, base, history, ending) -> Terms:
        order = np.argsort(keys)
        return cls(keys[order], *(x[order] for x in (value, base, history, ending)))


NO_TERMS = Terms(np.empty(0, np.uint64), *(np.empty(0) for _ in range(4)))


@dataclass
class Model:
    """The table of values (level, key, value, c, history, ending) of grams below the top order
    (of words, if that is 1), heavy grams by order, and the numbers that go with them. Heavy
    ones of the top order have their logarithm of the discounted count as value and the whole
    value as base."""

    values: DataFrame
    heavy: list[Terms]
    ratios: list[float]
    order: int
    min_count: int
    tokens: int
    types: int
    log_unknown: float
    start_value: float
    least: float


def gathered(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[np.ndarray]]:
    """The named columns of GATHERED rows or some more at a time."""
    held, rows = [], 0
    for batch in batches:
        held.append([batch.column(x).to_numpy(zero_copy_only=False) for x in names])
        rows += batch.num_rows
        if rows >= GATHERED:
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
            held, rows = [], 0
    if rows:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def discounted_counts(c: np.ndarray, ratios: list[float]) -> np.ndarray:
    return np.where(c <= len(ratios), c * np.array([0.0, *ratios])[np.minimum(c, len(ratios))], c)


def history_sums(batches: Iterator[pa.RecordBatch], ratios: list[float], keys: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """prev, dc, p: the discounted counts of grams and the chances of those endings that are
    among keys, summed up by history as far as rows are at hand together."""
    for prev, cur, c in gathered(batches, "prev", "cur", "c"):
        order = np.argsort(prev, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(prev[order]) != 0)))
        hit, at = found_in(cur.view(np.uint64), keys)
        mine = np.zeros(len(cur))
        mine[hit] = p[at[hit]]
        sums = [np.add.reduceat(x[order], first) for x in (discounted_counts(c, ratios), mine)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (prev[order][first], *sums)], names=["prev", "dc", "p"])


def light_endings(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """prev and cur of the grams whose ending is not among keys."""
    for prev, cur in gathered(batches, "prev", "cur"):
        light = ~found_in(cur.view(np.uint64), keys)[0]
        yield pa.RecordBatch.from_arrays([pa.array(prev[light]), pa.array(cur[light])], names=["prev", "cur"])


def _unsigned(frame: pd.DataFrame, name: str) -> np.ndarray:
    return frame[name].to_numpy(np.int64).view(np.uint64)


def fit(counted: DataFrame, order: int = ORDER, min_count: int = MIN_COUNT, heavy_share: int = HEAVY) -> Model:
    """Values of all grams below the top order, and the heavy ones of it, from the table of counts."""
    spark = counted.sparkSession
    of_counts: dict[int, dict[int, int]] = {n: {} for n in range(1, order + 1)}
    for row in counted.where("level < 0").groupBy("level", "key").agg(F.sum("c").alias("c")).collect():  # order * (K + 1) rows at most
        of_counts[-row["level"]][row["key"]] = row["c"]
    ratios = {n: discounts(of_counts[n]) for n in of_counts}
    discounted = lambda n: _discounted(F.col("c"), ratios[n])
    words = counted.where("level = 1").select("key", "c", discounted(1).alias("dc"))
    n, types, kept, texts = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum("dc"), F.lit(0.0)), F.max(F.when(F.col("key") == int(END), F.col("c")))
    ).first()
    over = n if n - kept > 1e-6 else n + 1
    least = n / heavy_share
    begin = spark.range(1).select(F.lit(int(START)).alias("prev"), F.lit(texts or 0).cast("long").alias("n"))
    below = words.select("key", "c", (F.col("dc") / over).alias("p"), F.log10(F.col("dc") / over).alias("value"))
    none, values, start = F.lit(0.0), None, None
    for level in range(2, order + 1):
        top = level == order
        grams = counted.where(F.col("level") == level)
        seen = below.select(F.col("key").alias("prev"), F.col("c").alias("n"))
        seen = seen.unionByName(begin) if level == 2 else seen
        if top:
            known = below.where(F.col("c") >= least).select("key", "p").toPandas().sort_values("key", key=lambda x: x.to_numpy(np.int64).view(np.uint64))  # heavy_share rows at most
            sent = spark.sparkContext.broadcast((_unsigned(known, "key"), known["p"].to_numpy(np.float64)))
            parts = grams.select("prev", "cur", "c").mapInArrow(lambda x: history_sums(x, ratios[order], *sent.value), "prev long, dc double, p double")
            light = grams.select("prev", "cur").mapInArrow(lambda x: light_endings(x, sent.value[0]), "prev long, cur long")
            light = light.join(below.where(F.col("c") < least).select(F.col("key").alias("cur"), "p"), "cur").select("prev", none.alias("dc"), "p")
            parts = parts.unionByName(light)
        else:
            grams = grams.select("key", "prev", "cur", "c").join(below.select(F.col("key").alias("cur"), "p"), "cur").drop("cur")
            grams = common.stored(grams, "grams")
            common.release_shuffles(spark)
            parts = grams.select("prev", discounted(level).alias("dc"), "p")
        histories = parts.groupBy("prev").agg(F.sum("dc").alias("dc"), F.sum("p").alias("p")).join(seen, "prev")
        total = F.when(F.col("n") - F.col("dc") > 1e-6, F.col("n")).otherwise(F.col("n") + 1).cast("double")
        histories = common.stored(
            histories.select("prev", total.alias("total"), F.log10((1 - F.col("dc") / total) / (1 - F.col("p"))).alias("alpha")), "histories"
        )
        common.release_shuffles(spark)
        if level == 2:
            start = histories.where(F.col("prev") == int(START)).select("alpha", "total").first()
        done = below.join(histories.select(F.col("prev").alias("key"), "alpha", "total"), "key", "left")
        terms = (F.coalesce(-F.log10("total") - F.col("alpha"), none), -F.log10("p")) if top else (none, none)
        done = done.select(F.lit(level - 1).alias("level"), "key", (F.col("value") + F.coalesce("alpha", none)).alias("value"), "c", terms[0].alias("history"), terms[1].alias("ending"))
        values = done if values is None else values.unionByName(done)
        if not top:
            chance = discounted(level) / F.col("total")
            below = grams.join(histories, "prev").select("key", "c", chance.alias("p"), (F.log10(chance) - F.col("alpha") - F.log10("p")).alias("value"))
            below = common.stored(below, "chances")
            common.release_shuffles(spark)
    if values is None:
        values = below.select(F.lit(1).alias("level"), "key", "value", "c", none.alias("history"), none.alias("ending"))
    values = common.stored(values, "ngram-values")
    common.release_shuffles(spark)
    heavy = _heavy(values, counted, order, ratios[order], least, start)
    unknown = 1 - kept / over if over else 1.0
    return Model(values, heavy, ratios[order], order, min_count, n, types, math.log10(unknown), start[0] if start else 0.0, least)


def _heavy(values: DataFrame, counted: DataFrame, order: int, ratios: list[float], least: float, start) -> list[Terms]:
    """The grams with `least` occurrences by order, not more than heavy_share of each. START has
    its term as a history among the words."""
    rows = values.where(F.col("c") >= least).toPandas()
    found = []
    for level in range(1, max(order, 2)):
        mine = rows[rows["level"] == level]
        columns = [mine["value"].to_numpy(np.float64), np.log10(mine["c"].to_numpy(np.float64) + 1), *(mine[x].to_numpy(np.float64) for x in ("history", "ending"))]
        keys = _unsigned(mine, "key")
        if level == 1 and order == 2 and start:
            keys = np.append(keys, START)
            columns = [np.append(x, y) for x, y in zip(columns, (0.0, 0.0, -math.log10(start[1]) - start[0], 0.0), strict=True)]
        found.append(Terms.of(keys, *columns))
    if order > 1:
        # A heavy gram's history and ending are at least as frequent, so they are heavy too.
        grams = counted.where((F.col("level") == order) & (F.col("c") >= least)).select("prev", "cur", "c").toPandas()
        below, prev, cur = found[-1], _unsigned(grams, "prev"), _unsigned(grams, "cur")
        own = np.log10(discounted_counts(grams["c"].to_numpy(np.int64), ratios))
        whole = own + below.history[found_in(prev, below.keys)[1]] + below.ending[found_in(cur, below.keys)[1]] if len(own) else own
        found.append(Terms.of(pair_keys(prev, cur), own, whole, own, own))
    return found


def pack_values(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    for level, key, value, c, history, ending in gathered(batches, "level", "key", "value", "c", "history", "ending"):
        rows = []
        for n in np.unique(level).tolist():
            mine = level == n
            columns = (x[mine] for x in (key.view(np.uint64), value, history, ending, c))
            for b, k, v, h, e, times in dealt(next(columns), buckets, *columns):
                rows.append((b, n, 0, k.tobytes(), np.column_stack((v, h, e)).tobytes(), times.tobytes() if n == 1 else None))
        yield _packed(rows)


def found_in(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys the sorted table holds, and where."""
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return (table[at] == keys if len(table) else np.zeros(len(keys), bool)), at


def lookup_blocks(batches: Iterator[pa.RecordBatch], buckets: int, order: int, min_count: int, heavy: list[Terms]) -> Iterator[pa.RecordBatch]:
    """Each block's documents with what the heavy keys give them, and the other keys packed."""
    task = TaskContext.get().partitionId() if TaskContext.get() else 0
    for number, block in enumerate(blocks(batches, lambda _: True)):
        about = np.zeros(len(block.sizes), DOC)
        about["doc_id"] = [x or 0 for x in block.doc_ids]
        about["null"] = [x is None for x in block.doc_ids]
        about["held"] = [held_out(x) for x in block.doc_ids]
        about["n"] = block.sizes
        sure = ~about["held"] & (min_count == 1)
        rows, name = [], task << 24 | number
        sums = lambda docs, x: np.bincount(docs, x, len(about))

        def ship(kind, keys, doc):
            rows.extend((b, kind, name, k.tobytes(), d.tobytes(), None) for b, k, d in dealt(keys, buckets, doc))  # noqa: B023

        for n, keys, history, low, doc in block.grams(order):
            known = heavy[n - 1]
            hit, at = found_in(keys, known.keys)
            light = ~hit
            if n == order > 1:
                about["score"] += sums(doc[hit], np.where(sure[doc[hit]], known.value[at[hit]], known.base[at[hit]]))
                certain = sure[doc]
                ship(TOP, keys[light & certain], doc[light & certain])
                for kind, which in ((TOP_UNSURE, ~about["held"]), (TOP_HELD, about["held"])):
                    mine = light & ~certain & which[doc]
                    for b, k, d, h, w in dealt(keys[mine], buckets, doc[mine], history[mine], low[mine]):
                        rows.append((b, kind, name, k.tobytes(), d.tobytes(), h.tobytes() + w.tobytes()))
                continue
            about["score"] += sums(doc[hit], known.value[at[hit]])
            if n == 1:
                about["known"] = np.bincount(doc[hit], minlength=len(about))
                about["base"] = sums(doc[hit], known.base[at[hit]])
            if n < order - 1 or order == 1:
                ship(LOOKUP + n, keys[light], doc[light])
                continue
            # A sure text keeps all its grams of the top order: these end at each of its grams
            # but the first (at all its words, of pairs), and go on from each but the last.
            inner = doc[1:] == doc[:-1]
            begins, ends = sure[doc] & np.append(inner, False), sure[doc] & (np.insert(inner, 0, False) | (n == 1))
            for flag, term in ((begins, known.history), (ends, known.ending)):
                mine = hit & flag
                about["score"] += sums(doc[mine], term[at[mine]])
            both = light & begins & ends
            parts = ((ALL, both), (LOOKUP + n, light & ~both), (HISTORY, light & begins & ~both), (ENDING, light & ends & ~both))
            for kind, mine in parts:
                ship(kind, keys[mine], doc[mine])
            if n == 1:
                at_start, at = found_in(np.array([START]), known.keys)
                about["score"] += sure * (known.history[at[0]] if at_start[0] else 0.0)
        rows.append((name % buckets, DOCS, name, about.tobytes(), None, None))
        yield _packed(rows)


def part_rows(kind: int, block: np.ndarray, doc: np.ndarray, **sums: np.ndarray) -> Iterator[tuple]:
    """Packed rows of what documents get, summed up while neighbours are of one document."""
    if not len(doc):
        return
    first = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (block[1:] != block[:-1]))))
    part = np.zeros(len(first), PART if kind == WIDE_PART else SHORT)
    part["doc"] = doc[first]
    for name, x in sums.items():
        part[name] = np.add.reduceat(x, first)
    block = block[first]
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(block)], strict=True):
        yield 0, kind, int(block[a]), part[a:b].tobytes(), None, None


def count_top(rows: list[dict], model: Model, below: Terms, buckets: int) -> Iterator[tuple]:
    """Of all occurrences of a bucket's grams of the top order: what they add by their count,
    and, where the text need not keep them, the terms of heavy histories and endings and
    requests for those of the others."""
    keys, doc = _joined(rows, "keys", "<u8"), _joined(rows, "more", "<u2")
    sizes = [len(r["keys"]) // 8 for r in rows]
    per_row = lambda x, kind: np.repeat(np.array(x, kind), sizes)
    block, train = per_row([r["block"] for r in rows], np.int64), per_row([r["kind"] != TOP_HELD for r in rows], bool)
    order = np.argsort(keys)
    new = np.concatenate(([True], np.diff(keys[order]) != 0))
    c = np.empty(len(keys), np.int64)
    c[order] = np.bincount(np.cumsum(new) - 1, train[order]).astype(np.int64)[np.cumsum(new) - 1]
    found = c >= model.min_count
    value = np.zeros(len(keys))
    value[found] = np.log10(discounted_counts(c[found], model.ratios))
    unsure = np.flatnonzero(found & per_row([r["kind"] != TOP for r in rows], bool))
    if len(unsure):
        place = np.cumsum(per_row([r["kind"] != TOP for r in rows], bool))[unsure] - 1
        halves = [(np.frombuffer(r["counts"], "<u8"), n) for r, n in zip(rows, sizes, strict=True) if r["kind"] != TOP]
        for kind, terms, asked in (
            (HISTORY, below.history, np.concatenate([x[:n] for x, n in halves])[place]),
            (ENDING, below.ending, np.concatenate([x[n:] for x, n in halves])[place]),
        ):
            hit, at = found_in(asked, below.keys)
            value[unsure[hit]] += terms[at[hit]]
            light = unsure[~hit]
            for b, k, d, origin in dealt(asked[~hit], buckets, doc[light], block[light]):
                yield b, kind, 0, k.tobytes(), d.tobytes(), origin.tobytes()
    yield from part_rows(SHORT_PART, block[found], doc[found], score=value[found])


def look_up(batches: Iterator[pa.RecordBatch], model: Model, heavy: list[Terms], buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed keys against the bucket's values: sums by document, packed by block."""
    table, bucket = {}, None
    for rows in runs(batches, lambda r: (r["bucket"], min(r["kind"], TOP))):
        kind = rows[0]["kind"]
        if rows[0]["bucket"] != bucket:
            table, bucket = {}, rows[0]["bucket"]
        if kind < LOOKUP:
            keys, terms = _joined(rows, "keys", "<u8"), _joined(rows, "more", "<f8").reshape(-1, 3)
            base = np.log10(_joined(rows, "counts", "<i8") + 1.0) if kind == 1 else np.zeros(len(keys))
            table[kind] = Terms.of(keys, terms[:, 0], base, terms[:, 1], terms[:, 2])
            continue
        if kind == DOCS:
            out = [(0, DOCS, r["block"], r["keys"], None, None) for r in rows]
        elif kind >= TOP:
            out = list(count_top(rows, model, heavy[model.order - 2], buckets))
        else:
            level = model.order - 1 if kind >= ALL else kind - LOOKUP
            terms = table.get(level, NO_TERMS)
            value = {ALL: terms.value + terms.history + terms.ending, HISTORY: terms.history, ENDING: terms.ending}.get(kind, terms.value)
            keys, doc = _joined(rows, "keys", "<u8"), _joined(rows, "more", "<u2")
            block = np.concatenate([np.frombuffer(r["counts"], "<i8") if r["counts"] else np.full(len(r["keys"]) // 8, r["block"], np.int64) for r in rows])
            hit, at = found_in(keys, terms.keys)
            at = at[hit]
            wide = {"known": np.ones(len(at), np.int64), "base": terms.base[at]} if level == 1 and kind < HISTORY else {}
            out = list(part_rows(WIDE_PART if wide else SHORT_PART, block[hit], doc[hit], score=value[at], **wide))
        if out:
            yield _packed(out)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, buckets: int) -> DataFrame:
    """Every row's doc_id, fold, token counts, base score and score."""
    spark = docs.sparkSession
    light = model.values.where(F.col("c") < model.least).mapInArrow(lambda x: pack_values(x, buckets), PACKED)
    order, min_count = model.order, model.min_count
    sent = spark.sparkContext.broadcast(model.heavy)
    # Tasks get the numbers only; the heavy keys go by the broadcast.
    plain = replace(model, values=None, heavy=None)
    shipped = _texts(docs).mapInArrow(lambda x: lookup_blocks(x, buckets, order, min_count, sent.value), PACKED)
    looked_up = lambda rows: by_bucket(rows.unionByName(light), buckets).mapInArrow(lambda x: look_up(x, plain, sent.value, buckets), PACKED)
    parts = looked_up(shipped)
    if order > 1:
        first = common.stored(parts, "ngram-parts")
        common.release_shuffles(spark)
        asked = first.where(F.col("kind").isin(HISTORY, ENDING))
        parts = first.where(F.col("kind") >= DOCS).unionByName(looked_up(asked))
    parts = parts.select("block", "kind", F.col("keys").alias("data"))
    tokens, over = model.tokens, math.log10(model.tokens + model.types + 1)
    log_unknown, start_value = model.log_unknown, model.start_value

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        whole = frame["kind"] == DOCS
        about = np.frombuffer(frame["data"][whole].iloc[0], DOC).copy()
        # In a fixed order, so that reruns add up the same numbers the same way.
        for kind, data in sorted(zip(frame["kind"][~whole], frame["data"][~whole], strict=True)):
            part = np.frombuffer(data, PART if kind == WIDE_PART else SHORT)
            for name in part.dtype.names[1:]:
                np.add.at(about[name], part["doc"], part[name])
        unknown = about["n"] - about["known"]
        ids = pd.Series(about["doc_id"], dtype="Int64").mask(about["null"])
        return pd.DataFrame(
            {
                "doc_id": ids,
                "held_out": about["held"],
                "n_tokens": about["n"],
                "n_known": about["known"],
                "train_tokens": tokens,
                "base_score": about["base"] - about["n"] * over,
                "score": about["score"] + start_value + unknown * log_unknown,
            }
        )

    return parts.groupBy("block").applyInPandas(summed, SCORED)


def score_documents(docs: DataFrame, min_count: int = MIN_COUNT, order: int = ORDER, heavy_share: int = HEAVY) -> DataFrame:
    """Scores of all rows by a model of the training fold."""
    buckets = n_buckets(docs)
    counted = counts(docs, buckets, min_count, order)
    common.release_shuffles(docs.sparkSession)
    model = fit(counted, order, min_count, heavy_share)
    common.discard(counted)
    common.release_shuffles(docs.sparkSession)
    return score(docs, model, buckets)
