"""Helpers that the corpus operators share: inputs, shared tables, word definitions."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.sources.tables import new_path

# The white space that separates words, and what lower-casing touches.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: For str.translate(): ASCII letters to lower case, every separator to a blank.
TO_WORDS = str.maketrans(UPPER + SPACES, LOWER + " " * len(SPACES))


#: Rows of texts that a task hands to Python at a time. Spark's own 10,000 are made for short
#: rows: of texts, JVM and Python would each hold tens of megabytes a task, several times.
ARROW_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session to ARROW_ROWS rows a batch at most."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str | None) -> list[str]:
    """The words of a text, A-Z in lower case."""
    return [w for w in (text or "").translate(TO_WORDS).split(" ") if w]


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """df written as a table in the shared folder and read again.

    This cuts the lineage: a lost executor costs a reread of the table, not the work
    before it.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of finished steps.

    The cleaner follows the driver's garbage collection, which a long job with a large
    heap seldom starts by itself; the disks would hold every earlier shuffle meanwhile.
    This matters where disks are small against the corpus, and is there for that.
    """
    for _ in range(2):  # what the first round frees holds what the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def discard(table: DataFrame) -> None:
    """Deletes a table of stored() that nothing will read again."""
    jvm = table.sparkSession.sparkContext._jvm
    conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/part-", 1)[0].split("/level=", 1)[0] for f in table.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def partitions_for(rows: int, each: int, least: int = 1) -> int:
    return max(least, -(-rows // each))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as no column of docs has."""
    taken, found = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def row_key(docs: DataFrame) -> Column:
    """A 64-bit hash of all of a row, nulls and maps included: rows that are alike in every
    column share it. Other rows that share it by chance would count as one row in
    one_row_each(); among 10**9 rows that happens to a pair with a chance of 3 in 100.
    """
    columns = sorted(docs.columns)
    # Hashes pass nulls by and refuse maps, so the former are told and the latter written out.
    nulls = F.array(*(F.col(f"`{c}`").isNull() for c in columns))
    plain = (F.to_json(F.struct(f"`{c}`")) if any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant")) else F.col(f"`{c}`") for c in columns)
    return F.xxhash64(nulls, *plain)


def one_row_each(docs: DataFrame, keyed: DataFrame, kept: DataFrame, name: str) -> DataFrame:
    """The rows of docs whose row_key() is in kept, one of each key. keyed has the keys (row)
    of all rows; only rows of a kept key that occurs again are grouped, and summed up before
    the shuffle."""
    (key,) = unused(docs, "__row")
    times = keyed.groupBy("row").agg(F.count("*").alias("times")).join(kept.select("row", F.lit(True).alias("kept")), "row", "left")
    out = stored(times.where("kept IS NULL OR times > 1").select(F.col("row").alias(key), F.col("kept").isNotNull().alias("again")), f"{name}-copies")
    rows = docs.withColumn(key, row_key(docs))
    once = rows.join(out.select(key), key, "left_anti").select(*docs.columns)
    again = out.where("again").select(key)
    if again.isEmpty():
        return once
    return once.unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]).select(*docs.columns))
