"""Running numbers and sums within a key that may hold any share of the rows.

No task gets a whole key: rows are put into slabs, each a stretch of the order; what a row
needs of its own slab comes from a window or from its place, what it needs of the slabs
before comes from their totals.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.sources.tables import stored

#: Places of a slab where the order is a number.
SLAB = 256
#: monotonically_increasing_id() has the partition above these bits, the row's place below.
PLACE_BITS = 33


def placed(rows: DataFrame, order: list[str], at: str = "at") -> DataFrame:
    """rows as a stored table in ranges of `order`, with a number `at` that grows with it.

    The range partitions are split by all of `order`, so only rows that are alike in it
    have to share a task. Numbers are distinct and have gaps between partitions.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(ranged.withColumn(at, F.monotonically_increasing_id()), "placed")


def numbered(rows: DataFrame, keys: list[str], at: str = "at", name: str = "ordinal") -> DataFrame:
    """Rows of placed() with their number, from 0, within keys (no nulls there).

    A key's rows of one partition stand in one stretch, so the number is the distance to the
    stretch's first row and the length of the key's stretches before. Without keys the
    stretches are the partitions.
    """
    slab = F.shiftright(at, PLACE_BITS).alias("slab_")
    stretches = rows.groupBy(*keys, slab).agg(F.min(at).alias("first_"), F.count("*").alias("rows_"))
    before = Window.partitionBy(*keys).orderBy("slab_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.withColumn("before_", F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("first_")).drop("first_", "rows_")
    met = rows.withColumn("slab_", F.shiftright(at, PLACE_BITS)).join(offsets, [*keys, "slab_"])
    return met.withColumn(name, F.col(at) + F.col("before_")).drop("slab_", "before_")


def starts(rows: DataFrame, keys: list[str], at: str, sums: Mapping[str, Column], slab: int = SLAB) -> DataFrame | None:
    """keys, slab_ and, for each name in sums, what its column adds up to before the slab (n) and
    with it (n_end), of keys with rows at `slab` or beyond; None if there are none.

    at: a whole number from 0 that orders a key's rows; a slab holds `slab` of its values.
    """
    # Few keys are long, mostly none: the sums of all rows are only needed if there are some.
    long = stored(rows.where(F.col(at) >= slab).select(*keys).distinct(), "long")
    if long.isEmpty():
        return None
    stretch = F.floor(F.col(at) / slab).alias("slab_")
    totals = rows.join(long, keys, "left_semi").groupBy(*keys, stretch).agg(*(F.sum(c).alias(f"{n}_end") for n, c in sums.items()))
    so_far = Window.partitionBy(*keys).orderBy("slab_")
    totals = totals.withColumns({f"{n}_end": F.sum(f"{n}_end").over(so_far) for n in sums})
    before = {n: F.coalesce(F.lag(f"{n}_end").over(so_far), F.lit(0)) for n in sums}
    return stored(totals.withColumns(before), "starts")


def running(rows: DataFrame, keys: list[str], at: str, sums: Mapping[str, Column], before: DataFrame | None, slab: int = SLAB) -> DataFrame:
    """rows with slab_ and, for each name in sums, the sum of its column over the key's rows
    before. before: what starts() gives. Rows are shuffled once, by key and slab; rows of
    equal numbers count in any order."""
    own = Window.partitionBy(*keys, "slab_").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.withColumn("slab_", F.floor(F.col(at) / slab))
    met = met.withColumns({n: F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()})
    if before is None:
        return met
    offsets = before.select(*keys, "slab_", *(F.col(n).alias(f"{n}_") for n in sums))
    met = met.join(offsets, [*keys, "slab_"], "left")
    return met.withColumns({n: F.col(n) + F.coalesce(f"{n}_", F.lit(0)) for n in sums}).drop(*(f"{n}_" for n in sums))


def slab_of(rows: DataFrame, keys: list[str], ordinal: str, name: str, before: DataFrame | None, slab: int = SLAB) -> DataFrame:
    """rows with slab_: the slab in which the running sum `name` reaches their ordinal. Slabs
    and rows meet by the stretches of `slab` ordinals that they are in."""
    if before is None:
        return rows.withColumn("slab_", F.lit(0).cast("long"))
    near = lambda c: F.floor(c / slab)
    held = before.where(F.col(f"{name}_end") > F.col(name)).select(*keys, "slab_", F.col(name).alias("low_"), F.col(f"{name}_end").alias("high_"))
    held = held.withColumn("near_", F.explode(F.sequence(near(F.col("low_")), near(F.col("high_") - 1))))
    met = rows.withColumn("near_", near(F.col(ordinal))).alias("r").join(held.alias("h"), [F.col(f"r.{k}") == F.col(f"h.{k}") for k in [*keys, "near_"]] + [F.col(ordinal) >= F.col("low_"), F.col(ordinal) < F.col("high_")], "left")
    return met.select(*(F.col(f"r.{c}") for c in rows.columns), F.coalesce("slab_", F.lit(0)).cast("long").alias("slab_"))
