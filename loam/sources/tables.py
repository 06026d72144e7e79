"""Sources and sinks: JSON lines, dictionaries, posts by id, parquet results, JDBC."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T

ANNOTATED = "text string, label array<array<string>>"
SAMPLES = "tokens array<string>, ner_tags array<int>, full_names array<string>, mention_morphological array<string>, mention_common array<string>, api_common array<string>"


_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where that is
    unset, a temporary folder of the session's own, on one machine only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN_FOLDERS:
            _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="loam-")
        folder = _OWN_FOLDERS[application]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: what follows rereads it, and neither
    several uses nor a lost executor do the work, or the calls, before it once more."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by their keys to as many tasks as a shuffle has, however few files they come
    from: for work that takes long beside reading them. Later grouping by the keys stays
    where they are."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_map(spark: SparkSession, path: str, kind: str = "map<string,string>") -> DataFrame:
    """One JSON object in a file as rows (key, value)."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", kind)).alias("key", "value"))


def returns(spark: SparkSession, path: str) -> DataFrame:
    """func, types, multi from an object whose values are a string or a list of strings."""
    rows = json_map(spark, path)
    multi = F.startswith("value", F.lit("["))
    types = F.when(multi, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return rows.select(F.col("key").alias("func"), types.alias("types"), multi.alias("multi"))


def alias_rows(spark: SparkSession, path: str) -> DataFrame:
    """alias, fqn, freq, ord from {alias: {fqn: freq}}, the inner order kept."""
    rows = json_map(spark, path, "map<string,map<string,int>>")
    return rows.select(F.col("key").alias("alias"), F.posexplode(F.map_entries("value")).alias("ord", "e")).select("alias", "e.key", "e.value", "ord").toDF("alias", "fqn", "freq", "ord")


def annotated_posts(rows: DataFrame) -> DataFrame:
    """id, post, api, label, raw_post of rows (text, label).

    The id stands between "ID:" and "Post:"; the post begins behind the first "Post:" and
    ends before the first "API:". Labels move with it, those of the id go, and the labelled
    API texts are taken from the raw text.
    """
    label = F.transform("label", lambda x: F.struct(F.get(x, F.lit(0)).cast("int").alias("start"), F.get(x, F.lit(1)).cast("int").alias("end"), F.get(x, F.lit(2)).alias("type")))
    begin = F.instr("text", "Post:") + F.lit(4)
    rest = F.substring(F.col("text"), begin + 1, F.length("text"))
    body = F.when(F.instr(rest, "API:") > 0, F.substring(rest, F.lit(1), F.instr(rest, "API:") - 1)).otherwise(rest)
    rows = rows.withColumn("spans", label).withColumn("begin", begin).withColumn("post", body)
    kept = F.filter("spans", lambda x: x["type"] != "post_id")
    moved = F.transform(kept, lambda x: F.struct((x["start"] - F.col("begin")).alias("start"), (x["end"] - F.col("begin")).alias("end"), x["type"].alias("type")))
    api = F.transform(F.filter(kept, lambda x: x["type"] == "API"), lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"]))
    return rows.select(T.between(F.col("text"), "ID:", "Post:").alias("id"), "post", api.alias("api"), moved.alias("label"), F.col("text").alias("raw_post"))


def questions_of(answers: DataFrame, posts: DataFrame) -> DataFrame:
    """Answers (id) with their question's id, title, body and tags."""
    a = answers.join(posts.select("id", "parent_id"), "id")
    q = posts.select(F.col("id").alias("parent_id"), "title", "body", "tags")
    return a.join(q, "parent_id")


def jdbc(spark: SparkSession, url: str, table: str, ids: tuple[str, int] | None = None, **options: str) -> DataFrame:
    """A table of a database; credentials come in as options and are stored nowhere.

    ids: a whole-number column and a number of tasks: each reads a range of it, between the
    least and greatest that the database has. Filters and columns go to the database.
    """
    source = lambda name, **more: spark.read.format("jdbc").options(url=url, dbtable=name, **options, **more).load()
    if ids is None:
        return source(table)
    column, tasks = ids
    # An alias with any letters in it would be folded as the database likes.
    low, high = source(f"(SELECT min({column}) AS LOW_, max({column}) AS HIGH_ FROM {table}) b").first()
    if low is None:
        return source(table)
    return source(table, partitionColumn=column, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(tasks))


def threads(posts: DataFrame, id_: str = "id", parent: str = "parent_id", kinds: tuple[str, int, int] = ("kind", 1, 2)) -> DataFrame:
    """Questions with their answers from one table of posts (id, parent_id, kind, title, body,
    tags): thread, post_id, title, tags and html, a row for each post of a thread, the
    question first by its null parent. Answers whose question is missing are left out.
    kinds: the column that tells questions from answers, and its values."""
    column, question, answer = kinds
    asked = posts.where(F.col(column) == question).select(F.col(id_).alias("thread"), "title", "tags", F.col("body").alias("html"))
    given = posts.where(F.col(column) == answer).select(F.col(parent).alias("thread"), F.col(id_).alias("post_id"), F.col("body").alias("html"))
    answers = given.join(asked.select("thread", "title", "tags"), "thread").select("thread", "post_id", "title", "tags", "html")
    return asked.select("thread", F.col("thread").alias("post_id"), "title", "tags", "html").unionByName(answers)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def replace_results(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class Versions:
    """A table whose contents are replaced as a whole: each version is a folder of its own, and
    a pointer file names the one that counts.

    A version is written in full first; then the pointer is written aside and renamed over the
    old one, which file systems do at once. So readers see the old rows or the new, a write
    that dies leaves the old version, and rows may be made from the table that they replace. Of
    writers at the same time the last to rename wins. Older versions stay until vacuum().
    On object stores without a rename this holds as far as their Hadoop client's rename does.
    """

    POINTER = "_current"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._root = self._path(self.path)
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._root.getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._root.toUri(), conf)
        self._overwrite = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE

    def current(self) -> str | None:
        """The name of the version that counts; None before the first."""
        pointer = self._path(f"{self.path}/{self.POINTER}")
        if not self._files.exists(pointer):
            return None
        stream = self._files.open(pointer)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        if (name := self.current()) is None:
            raise FileNotFoundError(f"no version of {self.path} has been written yet")
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, rows: DataFrame) -> str:
        """Puts rows in place of the table's; the name of their version."""
        name = f"version-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        self._point_to(name)
        return name

    def _point_to(self, name: str) -> None:
        aside = self._path(f"{self.path}/{self.POINTER}-{uuid.uuid4().hex}")
        stream = self._files.create(aside, False)
        try:
            stream.write(bytearray(name.encode()))
        finally:
            stream.close()
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._overwrite
        self._context.rename(aside, self._path(f"{self.path}/{self.POINTER}"), options)

    def upsert(self, new: DataFrame, key: str) -> str:
        """new in place of the table's rows of the same keys."""
        return self.write(new if self.current() is None else upserted(self.read(), new, key))

    def vacuum(self) -> list[str]:
        """Deletes all versions but the current one; readers of older ones have to be done."""
        kept, gone = self.current(), []
        for status in self._files.listStatus(self._root):
            name = status.getPath().getName()
            if name.startswith("version-") and name != kept:
                self._files.delete(status.getPath(), True)
                gone.append(name)
        return gone
