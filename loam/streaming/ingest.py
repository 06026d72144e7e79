"""Extension: posts as a stream, cut into segments as they come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loam.operators.segments import segments


def posts(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def segment_stream(stream: DataFrame, out: str, checkpoint: str, key: str = "page_id", html: str = "html") -> StreamingQuery:
    """Segments of all posts that are there, appended once each."""
    rows = segments(stream, key, html)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
