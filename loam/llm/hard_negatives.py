"""Hard-negative mining by threshold joins over an inverted index with omitted dimensions.

Rows of one label and one vector are one unit, which holds the smallest of their ids; anchors
of one label and vector are one query. Units are dealt to blocks, queries to deals, and each
block meets each deal: a stated query set against all rows. A block's index leaves out, for
every unit, the leading dimensions whose norm alone cannot reach the threshold; they are kept
as a tail for verification. A query goes through the posting lists from the last dimensions
to the first: units enter while what remains of the query may still reach the threshold,
partial scores add up, and units go whose score and remaining norms fall below it. What is
left is verified with its exact score.

Thresholds start high. A query whose windows (the positives; the negatives between two shares
of each positive's score) are not full of rows above its threshold comes back with a lower
one, until they are or nothing is below. So a window's rows are exact at every size.

Dimensions stand in order of their mean square, small ones first; a posting list covers STEP
of them. While few units go, a batch of queries adds a list up as a product of matrices; then
each query's remaining units are followed alone.

Defined results: rows with a null label, vector or vec_id, or a null or non-finite component,
take no part; shorter vectors are as if zeros followed; ties go by the smaller vec_id, and
repeated rows are rows of their own; scores are exact while they and all partial sums stay
below 2**53; an empty table gives no rows; other columns are passed by.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import common

SCALE = 256
ANCHOR_EVERY, SHIFT_EVERY, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's.
LEAST, MOST = 50, 95
#: Units of a block, queries of a deal, dimensions of a posting list, queries of a batch, and
#: the numbers that a block may hold.
BLOCK, DEAL, STEP, BATCH, NUMBERS = 4096, 4096, 8, 128, 1 << 22
#: Thresholds of positives in shares of the largest norm times the query's; then none.
POSITIVE_LEVELS = (0.35, 0.15)
#: Thresholds of negatives, in shares of the way from a window's least score to its most.
NEGATIVE_LEVELS = (0.8, 0.0)
#: Share of pairs left at which they are followed alone; relative error allowed for in bounds.
SPARSE, SLACK = 0.25, 1e-9
#: Parts in which an anchor vector's answers meet the anchors that have it.
PARTS = 16

FOUND = "q long, window int, score long, ids array<long>, own boolean"


def rows_of(embeddings: DataFrame, shift_every: int = SHIFT_EVERY, labels: int = LABELS) -> DataFrame:
    """vec_id, label, vector (whole numbers as doubles) of the rows that take part."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), vector.alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL").where(F.coalesce(finite, F.lit(False)))
    label = F.when(F.col("vec_id") % shift_every == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label"))
    return rows.select("vec_id", label.alias("label"), F.transform("vector", lambda x: F.floor(x * SCALE).cast("double")).alias("vector"))


def _key() -> Column:
    return F.md5(F.concat_ws(":", "label", F.array_join("vector", ",")))


def units_of(rows: DataFrame, positives: int, negatives: int) -> DataFrame:
    """unit, label, vector, ids (the smallest, as many as any window can take), size."""
    most = max(positives + 1, negatives)
    rows = rows.withColumn("key", _key())
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"))
    # A limit by group comes before the shuffle, so a vector of many copies is a few rows a task.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    first = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    units = first.groupBy("key").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    return units.join(sizes, "key").withColumn("unit", F.monotonically_increasing_id())


class Index:
    """The posting lists of a block: of each unit, the dimensions from the first list on whose
    inclusion brings its norm to `least`, which is in units of a query's norm."""

    def __init__(self, vectors: np.ndarray, least: float):
        d = vectors.shape[1]
        self.cuts = [(c, min(c + STEP, d)) for c in range(0, d, STEP)]
        # before[u, k]: the norm of the dimensions before list k; the last column is the whole.
        squares = np.cumsum(vectors**2, axis=1)
        before = np.stack([np.zeros(len(vectors)), *(np.sqrt(squares[:, hi - 1]) for _, hi in self.cuts)], axis=1)
        first = (before[:, 1:] < least * (1 - SLACK)).sum(axis=1)
        self.order = np.argsort(first, kind="stable")
        self.first, self.vectors, self.before = first[self.order], vectors[self.order], before[self.order]
        # List k holds the units [0, held[k]): a unit's lists are its first and all behind.
        self.held = np.searchsorted(self.first, np.arange(len(self.cuts)), "right")

    def rest(self, k: int, units: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """What the dimensions of units that no list down to k has added up may still give.
        norms: for each list, the query's norm (of each unit's query) before it."""
        since = np.maximum(self.first[units], k)
        return self.before[units, since] * (norms[since] if norms.ndim == 1 else norms[np.arange(len(units)), since])

    def ask(self, queries: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, unit, score) of all pairs with a score of the query's `least` or more."""
        if (least <= 0).any():  # met by units that share nothing with the query as well
            scores = queries @ self.vectors.T
            q, u = np.nonzero(scores >= least[:, None])
            return q, self.order[u], scores[q, u]
        norms = np.sqrt(np.concatenate([np.zeros((len(queries), 1)), np.cumsum(queries**2, axis=1)[:, [hi - 1 for _, hi in self.cuts]]], axis=1))
        floor, every = least - SLACK * least - SLACK, np.arange(self.held[-1])
        sums = np.zeros((len(queries), len(every)))
        q = u = None
        for k in range(len(self.cuts) - 1, -1, -1):
            lo, hi = self.cuts[k]
            if q is None:
                sums[:, : self.held[k]] += queries[:, lo:hi] @ self.vectors[: self.held[k], lo:hi].T
                since = np.maximum(self.first[every], k)
                # A look at the middle unit says whether there is something to prune.
                middle = len(every) // 2
                if len(every) and (self.before[middle, since[middle]] * norms[:, since[middle]] < floor).any():
                    kept = sums + self.before[every, since] * norms[:, since] >= floor[:, None]
                    if kept.mean() <= SPARSE or k == 0:
                        q, u = np.nonzero(kept)
                        sums = sums[q, u]
            else:
                mine = np.flatnonzero(u < self.held[k])
                sums[mine] += np.einsum("ij,ij->i", queries[q[mine], lo:hi], self.vectors[u[mine], lo:hi])
                kept = sums + self.rest(k, u, norms[q]) >= floor[q]
                q, u, sums = q[kept], u[kept], sums[kept]
        if q is None:
            q, u = np.nonzero(sums + self.before[every, self.first[every]] * norms[:, self.first[every]] >= floor[:, None])
        scores = np.einsum("ij,ij->i", queries[q], self.vectors[u])
        kept = scores >= least[q]
        return q[kept], self.order[u[kept]], scores[kept]


def _matrix(column: pa.ChunkedArray, width: int, order: np.ndarray) -> np.ndarray:
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out[:, order]


def _firsts(groups: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of each group's `most` best: higher scores, then smaller ids."""
    order = np.lexsort((ids, -scores, groups))
    run = groups[order]
    begins = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))) if len(run) else np.zeros(0, int)
    place = np.arange(len(run)) - np.repeat(begins, np.diff(np.concatenate((begins, [len(run)]))))
    return order[place < most]


def searched(units: DataFrame, queries: DataFrame, width: int, order: list[int], most: int) -> DataFrame:
    """The `most` best units of each block for every window of every query (q, window,
    score, ids, own).

    queries: q, label, vector, least, same, windows (lo, hi). A unit counts for a window if
    its score is least or more and between lo and hi, and its label is the query's (same)
    or another.
    """
    permuted, dims = np.array(order, int), max(1, width)
    block = max(1, min(BLOCK, NUMBERS // dims))
    blocks, deals = (max(1, -(-table.count() // n)) for table, n in ((units, block), (queries, DEAL)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = queries.withColumn("deal", dealt("q", deals)).withColumn("block", each(blocks))
    right = units.select("unit", "label", "vector", "ids", dealt("unit", blocks).alias("block")).withColumn("deal", each(deals))

    def met(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if asked.num_rows and held.num_rows:
            vectors, points = _matrix(held["vector"], dims, permuted), _matrix(asked["vector"], dims, permuted)
            norms = np.sqrt((points**2).sum(axis=1))
            least = asked["least"].to_numpy()
            index = Index(vectors, float(np.min(np.divide(least, norms, out=np.zeros_like(least), where=norms > 0), initial=np.inf)))
            labels, units_, ids = held["label"].to_numpy(), held["unit"].to_numpy(), held["ids"].combine_chunks()
            smallest = ids.flatten().to_numpy(zero_copy_only=False)[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            names, own_labels, same = asked["q"].to_numpy(), asked["label"].to_numpy(), asked["same"].to_numpy(zero_copy_only=False)
            windows = asked["windows"].combine_chunks()
            lows, highs = (windows.flatten().field(n).to_numpy(zero_copy_only=False) for n in ("lo", "hi"))
            sizes, starts = windows.value_lengths().to_numpy(zero_copy_only=False), windows.offsets.to_numpy()[:-1] - windows.offsets[0].as_py()
            for begin in range(0, len(points), BATCH):
                q, u, scores = index.ask(points[begin : begin + BATCH], least[begin : begin + BATCH])
                q = q + begin
                fit = (labels[u] == own_labels[q]) == same[q]
                q, u, scores = q[fit], u[fit], scores[fit]
                for w in range(int(sizes[begin : begin + BATCH].max(initial=0))):
                    has = np.flatnonzero(sizes[q] > w)
                    inside = (scores[has] >= lows[starts[q[has]] + w]) & (scores[has] <= highs[starts[q[has]] + w])
                    mine = has[inside]
                    best = mine[_firsts(q[mine], scores[mine], smallest[u[mine]], most)]
                    for column, values in zip(out, (names[q[best]], np.full(len(best), w, np.int32), scores[best].astype(np.int64), u[best], names[q[best]] == units_[u[best]]), strict=True):
                        column.append(values)
            taken = np.concatenate(out[3]) if out[3] else np.zeros(0, np.int64)
            lists = ids.take(pa.array(taken))
        else:
            lists = pa.array([], pa.list_(pa.int64()))
        joined = lambda k, kind: np.concatenate(out[k]).astype(kind) if out[k] else np.zeros(0, kind)
        return pa.table({"q": joined(0, np.int64), "window": joined(1, np.int32), "score": joined(2, np.int64), "ids": lists, "own": joined(4, bool)})

    keys = ["block", "deal"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(met, FOUND)


def best_rows(found: DataFrame, most: int) -> DataFrame:
    """q, window and its `most` best rows (score, id, own) of all blocks, in order."""
    rows = found.select("q", "window", "score", F.explode("ids").alias("id"), "own")
    place = F.row_number().over(Window.partitionBy("q", "window").orderBy(F.desc("score"), "id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= most)
    held = F.array_sort(F.collect_list(F.struct("place", "score", "id", "own")))
    return kept.groupBy("q", "window").agg(F.transform(held, lambda x: x.dropFields("place")).alias("rows"))


def positives_of(units: DataFrame, queries: DataFrame, width: int, order: list[int], norm: float, most: int, levels=POSITIVE_LEVELS) -> DataFrame:
    """q and its `most` best rows of the same label."""
    counts = units.groupBy("label").agg(F.sum("size").alias("rows_"))
    everything = F.array(F.struct(F.lit(-float("inf")).alias("lo"), F.lit(float("inf")).alias("hi")))
    rest = queries.join(counts, "label").withColumn("need", F.least(F.lit(most), F.col("rows_"))).drop("rows_")
    rest = rest.withColumns({"same": F.lit(True), "windows": everything})
    done = None
    for level in (*levels, None):
        least = F.lit(-float("inf")) if level is None else F.lit(level * norm) * F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
        asked = rest.withColumn("least", least)
        found = common.stored(best_rows(searched(units, asked.drop("need"), width, order, most), most), "positives")
        full = rest.select("q", "need").join(found, "q").where(F.lit(level is None) | (F.size("rows") >= F.col("need"))).select("q", "rows")
        done = full if done is None else done.unionByName(full)
        rest = common.stored(rest.join(full, "q", "left_anti"), "unfilled")
        if rest.isEmpty():
            break
    return done


def negatives_of(units: DataFrame, windows: DataFrame, width: int, order: list[int], most: int, levels=NEGATIVE_LEVELS) -> DataFrame:
    """q, positive_score and the `most` best rows of other labels in its window.

    windows: q, label, vector, positive_score, lo, hi (whole numbers as doubles).
    """
    done, rest = None, windows
    for level in levels:
        asked = rest.groupBy("q").agg(F.any_value("label").alias("label"), F.any_value("vector").alias("vector"), F.min(F.col("lo") + level * (F.col("hi") - F.col("lo"))).alias("least"), F.array_sort(F.collect_list(F.struct("lo", "hi", "positive_score"))).alias("windows"))
        asked = common.stored(asked.withColumn("same", F.lit(False)), "asked")
        found = best_rows(searched(units, asked, width, order, most), most)
        scores = asked.select("q", F.posexplode("windows").alias("window", "w")).select("q", F.col("window").cast("int"), "w.positive_score")
        found = common.stored(found.join(scores, ["q", "window"]).select("q", "positive_score", "rows"), "negatives")
        full = found if level <= 0 else found.where(F.size("rows") >= most)
        done = full if done is None else done.unionByName(full)
        rest = common.stored(rest.join(full, ["q", "positive_score"], "left_anti"), "open")
        if level <= 0 or rest.isEmpty():
            break
    return done


def mine(embeddings: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    common.small_batches(embeddings.sparkSession)
    rows = common.stored(rows_of(embeddings), "vectors")
    units = common.stored(units_of(rows, positives, negatives), "units")
    # One row for each dimension comes to the driver.
    squares = units.select(F.posexplode("vector").alias("k", "x")).groupBy("k").agg(F.avg(F.col("x") * F.col("x")).alias("s")).collect()
    order, width = [r["k"] for r in sorted(squares, key=lambda r: (r["s"], r["k"]))], len(squares)
    order = order or [0]
    norm = units.agg(F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), _key().alias("key"))
    queries = common.stored(anchors.select("key").distinct().join(units, "key").select(F.col("unit").alias("q"), "label", "vector", "size"), "queries")
    near = positives_of(units, queries.drop("size"), width, order, norm, positives + 1)
    near = common.stored(near.join(queries, "q"), "near")
    # The query's own row is a positive of no one, unless other rows are like it.
    scores = F.array_distinct(F.transform(F.filter("rows", lambda x: ~x["own"] | (F.col("size") > 1)), lambda x: x["score"]))
    windows = near.select("q", "label", "vector", F.explode(scores).alias("positive_score"))
    lo, hi = F.ceil(F.col("positive_score") * least / 100).cast("double"), F.floor(F.col("positive_score") * most / 100).cast("double")
    windows = windows.withColumns({"lo": lo, "hi": hi}).where("lo <= hi")
    hard = negatives_of(units, common.stored(windows, "windows"), width, order, negatives)
    hard = hard.groupBy("q").agg(F.collect_list(F.struct("positive_score", "rows")).alias("hard"))
    answers = near.select("q", "rows").join(hard, "q").join(units.select(F.col("unit").alias("q"), "key"), "q")
    # Anchors that share a vector meet its answers in parts, by their ids.
    parts = F.pmod(F.xxhash64("anchor_id"), F.lit(PARTS)).cast("int")
    met = anchors.withColumn("part", parts).join(answers.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["key", "part"])
    met = met.withColumn("self", F.get(F.filter(F.transform("rows", lambda x, k: F.when(x["own"] & (x["id"] == F.col("anchor_id")), k)), lambda k: k.isNotNull()), F.lit(0)))
    others = F.slice(F.filter("rows", lambda x, k: ~k.eqNullSafe(F.col("self"))), 1, positives)
    pairs = met.select("anchor_id", "hard", F.explode(others).alias("p"))
    taken = F.get(F.filter("hard", lambda h: h["positive_score"] == F.col("p.score")), F.lit(0))["rows"]
    return pairs.select("anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.posexplode(taken).alias("k", "n")).select(
        "anchor_id", "positive_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score")
    )
