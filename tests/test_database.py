"""Posts from a database to threads and blocks; the database is an embedded one."""

import contextlib
import io
import uuid

import pytest

from loam.operators import segments
from loam.sources import tables

DRIVER = "org.apache.derby.iapi.jdbc.AutoloadedDriver"


@pytest.fixture(scope="module")
def database(spark):
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(DRIVER)
    except Exception:  # noqa: BLE001
        pytest.skip("no embedded database on the class path")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    rows = [(k, None if k % 4 == 0 else k - k % 4, 1 if k % 4 == 0 else 2, f"title {k}" if k % 4 == 0 else None, f"text {k}<pre><code>x = {k}</code></pre>", "t") for k in range(40)]
    rows.append((99, 98, 2, None, "an answer without a question", None))
    posts = spark.createDataFrame(rows, "ID long, PARENT_ID long, KIND int, TITLE string, BODY string, TAGS string")
    posts.write.format("jdbc").options(url=url, dbtable="POSTS", driver=DRIVER).save()
    return url


def test_threads_from_a_database(spark, database):
    posts = tables.jdbc(spark, database, "POSTS", ids=("ID", 5), driver=DRIVER)
    assert posts.rdd.getNumPartitions() == 5 and posts.count() == 41
    rows = tables.threads(posts.toDF("id", "parent_id", "kind", "title", "body", "tags"))
    got = {r.post_id: r for r in segments.thread_blocks(rows, "post_id", "html", "title").collect()}
    assert set(got) == set(range(40))
    for k, r in got.items():
        assert r.code_blocks == [f"x = {k}"] and [x.strip() for x in r.text_blocks] == [f"title {k - k % 4}", f"text {k}"]


def test_filters_and_columns_go_to_the_database(spark, database):
    posts = tables.jdbc(spark, database, "POSTS", ids=("ID", 3), driver=DRIVER).where("KIND = 1 AND ID > 8").select("ID")
    with contextlib.redirect_stdout(shown := io.StringIO()):
        posts.explain("formatted")
    assert "EqualTo(KIND,1)" in shown.getvalue() and "GreaterThan(ID,8)" in shown.getvalue() and "BODY" not in shown.getvalue()
    assert sorted(r.ID for r in posts.collect()) == list(range(12, 40, 4))


def test_an_empty_table_is_read(spark, database):
    spark.createDataFrame([], "ID long, BODY string").write.format("jdbc").options(url=database, dbtable="EMPTY_POSTS", driver=DRIVER).save()
    assert tables.jdbc(spark, database, "EMPTY_POSTS", ids=("ID", 4), driver=DRIVER).count() == 0
    assert tables.jdbc(spark, database, "POSTS", driver=DRIVER).count() == 41
