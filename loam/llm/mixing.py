"""Mixing sources to target weights.

Sizes are summed by source. The weights share the total; a target stops at MOST times its
source's size, and the excess goes to the other sources by weight until no target is above
its bound. In order of bound over weight, the sources that reach their bound come first,
so running sums find the one level (words per unit of weight) at which the targets meet
the total. A source's rate is its target over its size; each document is emitted
floor(rate) times, and once more if its keyed hash is under the fraction.

The sources' table has one row a source; documents meet it in a join that Spark may
broadcast or split, whichever its size and the skew call for.

Defined results: a null text has size 0; null is a source, and the last; a source without
words has target 0 and its documents are not emitted; rows that repeat a doc_id, or have none,
draw apart by their text, and those alike in both by their number; an empty table gives no
rows; other columns are kept by mix().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import common
from loam.operators.ordinals import numbered, placed

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def chance(doc_id: Column, text_md5: Column, number: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the seed, the id, the text and the row's number among those
    that are alike in both."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_md5, number.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def text_md5(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")))


def told_apart(rows: DataFrame, like: list[Column], number: str) -> DataFrame:
    """rows with their number among the rows that `like` does not tell apart, 0 for most.

    Only rows that are not alone are numbered, in ranges, so that many of them share no task.
    """
    key, tie, at = common.unused(rows, "__like", "__tie", "__at")
    keyed = rows.withColumn(key, F.xxhash64(*like))
    again = common.stored(keyed.groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").select(key), "alike")
    if again.isEmpty():
        return rows.withColumn(number, F.lit(0))
    alone = keyed.join(again, key, "left_anti").withColumn(number, F.lit(0))
    more = placed(keyed.join(again, key, "left_semi").withColumn(tie, F.monotonically_increasing_id()), [key, tie], at)
    more = numbered(more, [key], at, number).withColumn(number, F.col(number).cast("int"))
    return alone.select(*rows.columns, number).unionByName(more.select(*rows.columns, number))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, size -> source, source_size, target. Windows here run over one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*map(F.lit, weights))
    sources = sources.withColumn("weight", F.get(cycle, place % len(weights)).cast("long")).withColumn(
        "bound", F.lit(most) * F.col("source_size")
    )
    order = Window.orderBy((F.col("bound") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    sources = sources.withColumn("level", level).withColumn("ratio", F.col("bound") / F.col("weight"))
    sources = sources.withColumn(
        "level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("ratio"))).over(everything)
    )
    return sources.select(
        "source", "source_size", F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight")).alias("target")
    )


def plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies."""
    facts = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), text_md5(F.col("text")).alias("md5"))
    sizes = told_apart(common.stored(facts, "mix-sizes"), [F.col("doc_id").isNull(), F.col("doc_id"), F.col("md5")], "number")
    goal = targets(sizes).withColumnRenamed("source", "of_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    drawn = chance(F.col("doc_id"), F.col("md5"), F.col("number"), seed)
    copies = F.floor("rate") + F.when(drawn < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (
        sizes.join(goal, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("rate", rate)
        .select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))
    )


def mix(docs: DataFrame, seed: str = SEED, copy: str | None = None) -> DataFrame:
    """The rows of docs, each as often as the plan says; numbered from 0 in a column `copy`,
    if that is named.

    Rates by source are joined to the texts, not rates by document: that table is small.
    """
    source, rate, number, one, alike = common.unused(docs, "__source", "__rate", "__number", "__one", "__alike")
    sizes = common.stored(docs.select("source", n_words(F.col("text")).alias("size")), "mix-sizes")
    goal = common.stored(
        targets(sizes).select(
            F.col("source").alias(source),
            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias(rate),
        ),
        "mix-rates",
    )
    md5 = text_md5(F.col("text"))
    rows = told_apart(docs, [F.col("doc_id").isNull(), F.col("doc_id"), md5], alike)
    extra = F.when(chance(F.col("doc_id"), md5, F.col(alike), seed) < F.col(rate) - F.floor(rate), 1).otherwise(0)
    times = (F.floor(rate) + extra).cast("int")
    kept = [c for c in docs.columns if c != copy]
    return (
        rows.join(goal, F.col("source").eqNullSafe(F.col(source)))
        .select("*", F.posexplode(F.array_repeat(F.lit(1), times)).alias(number, one))
        .select(*kept, *([F.col(number).alias(copy)] if copy else []))
    )
