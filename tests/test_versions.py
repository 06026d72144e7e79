"""Tables that are replaced as a whole."""

import pytest
from pyspark.sql import functions as F

from loam.sources import tables


def test_readers_see_the_old_rows_or_the_new(spark, tmp_path):
    table = tables.Versions(spark, f"{tmp_path}/t")
    assert table.current() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.write(spark.range(5))
    reader = table.read()  # planned before the table is replaced, read after
    table.write(table.read().select((F.col("id") + 10).alias("id")))  # of its own rows
    assert sorted(r.id for r in reader.collect()) == [0, 1, 2, 3, 4]
    assert sorted(r.id for r in table.read().collect()) == [10, 11, 12, 13, 14]
    assert sorted(r.id for r in tables.Versions(spark, f"{tmp_path}/t").read().collect()) == [10, 11, 12, 13, 14]


def test_a_write_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    table = tables.Versions(spark, f"{tmp_path}/t")
    table.write(spark.range(3))
    fails = spark.range(9).select(F.raise_error("down").cast("long").alias("id"))
    with pytest.raises(Exception, match="down"):
        table.write(fails)
    assert table.read().count() == 3

    def dies(name):
        raise KeyboardInterrupt

    monkeypatch.setattr(table, "_point_to", dies)  # between the rows and the pointer
    with pytest.raises(KeyboardInterrupt):
        table.write(spark.range(7))
    monkeypatch.undo()
    assert table.read().count() == 3
    assert len(table.vacuum()) == 2 and table.vacuum() == [] and table.read().count() == 3


def test_upserts_replace_rows_by_key(spark, tmp_path):
    table = tables.Versions(spark, f"{tmp_path}/t")
    table.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k")
    table.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k")
    assert sorted(map(tuple, table.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    table.write(spark.createDataFrame([], "k int, v string"))
    assert table.read().count() == 0
