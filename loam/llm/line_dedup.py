"""Line deduplication across documents, by built-in functions only.

Documents are exploded to their normalised lines, once a document each; these are hashed and
summed up by hash: how many documents hold it, and the largest doc_id of them. Lines over the
threshold are met with the documents that hold them, and each such document drops its own,
unless it is the largest holder, and is put together again in the order of its lines.

Only hashes and ids are shuffled to be counted; counting sums up in each task first, so a line
that a third of the documents hold is one row a task. The join of frequent lines with their
holders lets Spark split hot hashes. Texts meet the hashes that they drop, by document.

Defined results: a null or empty text is one empty line; rows of one doc_id count as
documents of their own, and all those of the largest doc_id keep their lines; rows
without a doc_id count too and drop what any row with one holds; an empty table gives no rows;
other columns are passed by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common

LEAST_POINTS = 40
LEAST_DOCUMENTS = 5


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hash(line: Column, least_points: int) -> Column:
    """A 128-bit hash of a line's key; null for a key that is too short."""
    key = common.lower_ascii(F.btrim(line, F.lit(common.SPACES)))
    return F.when(F.length(key) >= least_points, F.unhex(F.md5(key)))


def holders(docs: DataFrame, least_points: int = LEAST_POINTS) -> DataFrame:
    """place, doc_id, hash: the distinct long lines of each document. place: where the
    document's texts are met again, its doc_id or, without one, a hash of the text."""
    hashes = F.array_distinct(F.array_compact(F.transform("lines", lambda x: line_hash(x, least_points))))
    rows = docs.select("doc_id", place().alias("place"), lines(F.col("text")).alias("lines"))
    return rows.select("place", "doc_id", F.explode(hashes).alias("hash"))


def place() -> Column:
    """A struct, so that no hash of a text meets a doc_id."""
    id_ = F.col("doc_id").cast("long")
    return F.struct(id_.isNull().alias("none"), F.coalesce(id_, F.xxhash64("text")).alias("at"))


def frequent(held: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """hash, documents and keeper of the lines that enough documents hold."""
    counts = held.groupBy("hash").agg(F.count("*").alias("documents"), F.max("doc_id").alias("keeper"))
    return counts.where(F.col("documents") >= least_documents)


def deduplicated(docs: DataFrame, least_points: int = LEAST_POINTS, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_text of every row."""
    held = common.stored(holders(docs, least_points), "lines")
    drops = held.join(frequent(held, least_documents), "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy("place").agg(F.collect_set("hash").alias("drops"))
    rows = docs.select("doc_id", place().alias("place"), F.col("text").cast("string").alias("text")).join(drops, "place", "left")
    stays = lambda x: ~F.coalesce(F.array_contains("drops", line_hash(x, least_points)), F.lit(False))
    own = lines(F.col("text"))
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.size(own).alias("n"), F.when(F.col("drops").isNotNull(), F.filter(own, stays)).alias("kept"))
    return rows.select(
        "doc_id",
        F.col("n").cast("long").alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.col("n") - F.size("kept")).cast("long").alias("n_dropped"),
        F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"),
    )
