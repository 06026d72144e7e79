"""Sharding by extendible hashing, with DataFrame operations only.

A row's 60-bit code holds 30 bits of its key's hash, then 30 bits of the hash of key and
salt. A bucket is a prefix of the code; a bucket over the byte limit is split on the next
bit until it fits or holds one row. Rows of one key part on the salt's bits, so a key with
a third of all rows is split like any other bucket.

Buckets are settled BITS levels at a time: rows are summed by a prefix of BITS more bits
(at most 2**BITS sums a bucket that is still open), the totals of the levels between
follow from those sums, and only the rows of buckets that are open on the last level go to
the next round. No level reads the texts again.

Defined results: null sizes count as 0, null keys and salts hash as empty strings; rows
that agree in key and salt have one code, and where they alone exceed the limit their
bucket ends at the full code and is reported with fits = false, as is a single row
larger than the limit. An empty table gives no rows. Other columns are passed by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common

CODE_BITS = 60
BITS = 12
LIMIT_BYTES = 1 << 20


def code(key: Column, salt: Column) -> Column:
    """The 60-bit code of a row."""

    def top30(text: Column) -> Column:
        return F.shiftright(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), 2)

    key = F.coalesce(key.cast("string"), F.lit(""))
    salted = F.concat_ws(":", key, F.coalesce(salt.cast("string"), F.lit("")))
    return F.shiftleft(top30(key), 30) + top30(salted)


def _prefix(h: Column, depth: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, (F.lit(CODE_BITS) - depth).cast("int"))


def assign(rows: DataFrame, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """rows (row_id, h, bytes) -> row_id, bytes, shard, depth, shard_bytes, shard_rows, fits.

    shard is the bucket's prefix as a string of bits, empty if everything fits one bucket.
    """
    spark = rows.sparkSession
    active = common.stored(rows.select("row_id", "h", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes")), "shard-codes")
    settled = []
    for base in range(0, CODE_BITS, BITS):
        fine = base + BITS
        coded = active.withColumn("cell", _prefix(F.col("h"), F.lit(fine)))
        cells = coded.groupBy("cell").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
        levels = cells.select(
            "cell", "b", "n", F.explode(F.sequence(F.lit(base), F.lit(fine))).alias("depth")
        ).withColumn("prefix", F.call_function("shiftrightunsigned", F.col("cell"), (F.lit(fine) - F.col("depth")).cast("int")))
        totals = levels.groupBy("depth", "prefix").agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")
        )
        fits = (F.col("shard_bytes") <= limit_bytes) | (F.col("shard_rows") <= 1)
        last = fits | (F.col("depth") == CODE_BITS)
        leaves = (
            levels.join(totals.where(last), ["depth", "prefix"])
            .groupBy("cell")
            .agg(F.min_by(F.struct("depth", "prefix", "shard_bytes", "shard_rows"), "depth").alias("leaf"))
        )
        placed = common.stored(coded.join(leaves, "cell", "left"), "shard-round")
        settled.append(placed.where("leaf IS NOT NULL"))
        active = placed.where("leaf IS NULL").select("row_id", "h", "bytes")
        if active.isEmpty():
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    depth = F.col("leaf.depth")
    return out.select(
        "row_id",
        "bytes",
        F.when(depth == 0, "").otherwise(F.lpad(F.bin("leaf.prefix"), depth, F.lit("0"))).alias("shard"),
        depth.alias("depth"),
        F.col("leaf.shard_bytes").alias("shard_bytes"),
        F.col("leaf.shard_rows").alias("shard_rows"),
        (F.col("leaf.shard_bytes") <= limit_bytes).alias("fits"),
    )


def shard(df: DataFrame, key: str, text: str, limit_bytes: int = LIMIT_BYTES) -> DataFrame:
    """A shard for each row of df, by its key and the bytes of its text."""
    return assign(
        df.select(
            F.col(key).alias("row_id"),
            code(F.col(key), F.col(text)).alias("h"),
            F.octet_length(text).alias("bytes"),
        ),
        limit_bytes,
    )


def directory(assigned: DataFrame) -> DataFrame:
    """The directory in ranges: each bucket's first slot and number of slots.

    A flat directory has 2**global_depth slots, which one deep bucket makes huge; a range
    of slots per bucket says the same in one row.
    """
    buckets = assigned.groupBy("shard", "depth").agg(F.first("shard_bytes").alias("shard_bytes"))
    top = buckets.agg(F.max("depth").alias("global_depth"))
    prefix = F.coalesce(F.conv(F.when(F.col("shard") != "", F.col("shard")), 2, 10).cast("long"), F.lit(0))
    spread = (F.col("global_depth") - F.col("depth")).cast("int")
    return buckets.join(F.broadcast(top)).select(
        "shard", "depth", "global_depth", "shard_bytes",
        F.call_function("shiftleft", prefix, spread).alias("first_slot"),
        F.call_function("shiftleft", F.lit(1).cast("long"), spread).alias("slots"),
    )


def placed(df: DataFrame, assigned: DataFrame, key: str, text: str = "text") -> DataFrame:
    """df with the shard of each row. Every code is a leaf's prefix and more bits, so rows
    find their leaf by code, whatever their key; texts are joined to distinct codes."""
    rows = df.withColumn("__h", code(F.col(key), F.col(text)))
    depths = assigned.agg(F.array_sort(F.collect_set("depth")).alias("depths"))  # 61 at most
    leaves = assigned.select(F.col("shard").alias("__shard"), F.col("depth").alias("__depth")).distinct()
    codes = rows.select("__h").distinct().join(F.broadcast(depths)).select("__h", F.explode("depths").alias("__depth"))
    bits = F.lpad(F.bin("__h"), CODE_BITS, F.lit("0"))
    found = codes.withColumn("__shard", F.substring(bits, F.lit(1), F.col("__depth"))).join(leaves, ["__depth", "__shard"])
    return rows.join(found.select("__h", F.col("__shard").alias("shard")), "__h").select(*df.columns, "shard")


def write(df: DataFrame, assigned: DataFrame, key: str, path: str, text: str = "text") -> None:
    """df written in folders by shard; a shard's rows go to one task, which its limit bounds."""
    placed(df, assigned, key, text).repartition("shard").write.partitionBy("shard").parquet(path)
