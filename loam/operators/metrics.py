"""Confusion counts, precision, recall, F1, MCC, focal loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IGNORED = -100


def confusion(rows: DataFrame, label: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """tp, fp, fn, tn of 0/1 columns; rows with a negative label are left out, other values
    count nowhere."""
    y, p = F.col(label), F.col(predicted)
    pick = lambda a, b: F.count_if((y == a) & (p == b))
    return rows.where(y >= 0).groupBy(*by).agg(pick(1, 1).alias("tp"), pick(0, 1).alias("fp"), pick(1, 0).alias("fn"), pick(0, 0).alias("tn"))


def confusion_of_tags(rows: DataFrame, label: str, predicted: str, tag: str = "B-API", outside: str = "0") -> DataFrame:
    """Counts of string tags: a miss is a tag other than `outside` that isn't predicted."""
    hit, is_tag = F.col(predicted) == tag, F.col(label) == tag
    return rows.agg(
        F.count_if(hit & is_tag).alias("tp"),
        F.count_if(hit & ~is_tag).alias("fp"),
        F.count_if(~hit & (F.col(label) != outside)).alias("fn"),
        F.count_if(~hit & (F.col(label) == outside)).alias("tn"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1 and mcc. Nothing to find and nothing found is 1;
    nothing right otherwise is 0; an undefined MCC is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def edge(value: Column) -> Column:
        return F.when((tp == 0) & (fp == 0) & (fn == 0), 1.0).when(tp == 0, 0.0).otherwise(value)

    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return (
        counts.withColumn("precision", edge(F.try_divide(tp, tp + fp)))
        .withColumn("recall", edge(F.try_divide(tp, tp + fn)))
        .withColumn("f1", edge(F.try_divide(2 * tp, 2 * tp + fp + fn)))
        .withColumn("mcc", F.when(spread == 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(F.when(spread == 0, 1.0).otherwise(spread))))
    )


def best_epoch(runs: DataFrame) -> DataFrame:
    """The row with the highest f1, the latest of equals."""
    return runs.agg(F.max_by("epoch", F.struct("f1", "epoch")).alias("epoch"), F.max("f1").alias("f1"))


def focal_loss(chance: Column, gamma: float = 2.0, weight: Column | float = 1.0) -> Column:
    """-(1 - p)^gamma log p of the true class's probability."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return -F.pow(1 - chance, F.lit(gamma)) * F.log(chance) * w
