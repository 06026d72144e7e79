"""Maps, repeated and missing ids in the corpus operators."""

import pytest
from pyspark.sql import functions as F

from loam.llm import common, exact_dedup, mixing, near


@pytest.fixture(scope="module")
def mapped(spark):
    schema = "doc_id long, text string, source string, m map<string,int>, nested array<struct<k:map<string,int>>>"
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, "a b", "s", {"x": 1}, [({"y": 2},)]), (2, "ab", "s", None, None), (3, long, "t", {}, []), (4, long + " tail", "t", {"x": 1}, None), (5, "else", "t", None, [(None,)]), (5, "else", "t", None, [(None,)])]
    return spark.createDataFrame(rows, schema).repartition(2)


def test_maps_go_through_the_stages(mapped):
    exact = exact_dedup.drop_copies(mapped)
    assert sorted(r.doc_id for r in exact.collect()) == [1, 3, 4, 5]
    kept = near.drop_near_copies(mapped, 5)
    assert kept.columns == mapped.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5]
    assert mixing.mix(mapped).columns == mapped.columns


def test_row_keys_tell_nulls_maps_and_values_apart(spark):
    rows = [(None, "a", None), ("a", None, None), ("a", None, {}), ("a", None, {"k": 1}), ("a", None, {"k": None}), (None, None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, m map<string,int>")
    assert frame.select(common.row_key(frame).alias("k")).distinct().count() == len(rows)
    assert frame.unionByName(frame).select(common.row_key(frame).alias("k")).distinct().count() == len(rows)


@pytest.mark.parametrize("text", [lambda k: "w " * 21, lambda k: "w " * 20 + str(k)])
@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_without_an_id_of_their_own_draw_apart(spark, text, doc_id):
    rows = [(doc_id, text(k), "a") for k in range(400)] + [(k, "x y", "b") for k in range(1000, 1800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.plan(docs).groupBy("target", "source_size").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    for r in got:
        assert abs(r.taken - r.target) < 0.12 * r.target
    again = mixing.plan(docs.repartition(2))
    both = [sorted(map(tuple, x.collect()), key=str) for x in (mixing.plan(docs), again)]
    assert both[0] == both[1]
    mixed = mixing.mix(docs)
    assert mixed.count() == sum(r[-1] for r in both[0]) and mixed.columns == docs.columns


def test_the_language_model_of_the_query_keeps_every_pair(spark):
    from loam.llm import katz

    ids = [k for k in range(200) if not katz.held_out(k)][:20]
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in ids], "doc_id long, text string")
    kept = katz.counts(docs, 4).where("level = 2")
    assert kept.where("c = 1").count() == 2 * 20


def test_pairs_of_the_language_model_have_no_table_of_values(spark):
    """Pairs are counted where they are scored; what is stored of each is two words and a count."""
    from loam.llm import katz

    ids = [k for k in range(200) if not katz.held_out(k)][:20]
    docs = spark.createDataFrame([(k, f"a b c d{k}") for k in ids], "doc_id long, text string")
    counted = katz.counts(docs, 4)
    assert counted.where("level = 2 AND key IS NULL").count() == 2 * 20 + 3
    assert {r.level for r in katz.fit(counted).values.select("level").distinct().collect()} == {1}
