"""Results of Python functions in pieces."""

import pyarrow as pa

from loam.functions import rows, tokenizer


def test_results_come_in_pieces_of_bounded_size():
    found = list(rows.pieces((["x"] * 50 if k % 3 else None for k in range(1000)), pa.list_(pa.string()), piece=500))
    assert sum(map(len, found)) == 1000 and len(found) > 50
    assert max(sum(1 + len(x or ()) for x in part.to_pylist()) for part in found) <= 500 + 50
    assert list(rows.pieces(iter(()), pa.string())) == []


def test_a_batch_of_many_tokens_is_more_than_one_piece(spark):
    """10,000 rows are one batch of Spark's; its tokens are handed on 20,000 at a time."""
    texts = spark.range(0, 9000, numPartitions=1).selectExpr("id", "IF(id % 100 = 0, NULL, concat('a b c d e f() g ', id)) AS text")
    found = texts.select("id", tokenizer.tokenized("text").alias("t")).collect()
    assert len(found) == 9000
    assert all([x["token"] for x in r["t"]] == ([] if r["id"] % 100 == 0 else ["a", "b", "c", "d", "e", "f()", "g", str(r["id"])]) for r in found)
