"""What the queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.sources import tables


def dealt_parts(spark, folder: str) -> DataFrame:
    """The parts dealt to all cores by their key. A million of them fit one file of a few MB,
    which a single task would read; here Python works on each row for far longer than that."""
    return tables.dealt(tables.read_table(spark, folder, "part"), "p_partkey")


def named_parts(spark, folder: str) -> DataFrame:
    """Parts with a qualified name: type, then the words of the name."""
    name = F.concat(F.lower("p_type"), F.lit("."), F.translate("p_name", " ", "."))
    return tables.read_table(spark, folder, "part").withColumn("fqn", name)


def part_code(spark, folder: str) -> DataFrame:
    """A code block for each part: two imports, two assignments, a function."""
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    key = F.col("p_partkey").cast("string")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("import "), F.lower("p_type"), F.lit(".core as m"), key),
        F.concat(F.lit("from "), F.lower("p_type"), F.lit("."), first, F.lit(" import "), second),
        F.concat(F.lit("x = m"), key, F.lit(".load('f')")),
        F.concat(F.lit("y, z = "), second, F.lit("("), F.col("p_size").cast("string"), F.lit(")")),
        F.lit("def f(a, b=1):\n    return a"),
    )
    return dealt_parts(spark, folder).select("p_partkey", F.array(lines).alias("code_blocks"))


def broken_code(spark, folder: str) -> DataFrame:
    """A code block for each part that does not parse, broken in one of four ways and more."""
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    key = F.col("p_partkey").cast("string")
    broken = F.get(F.array(F.concat(F.lit("print "), first), F.lit("Traceback (most recent call last):"), F.lit("..."), F.lit("x = foo(1, [2")), (F.col("p_partkey") % 4).cast("int"))
    lines = F.concat_ws(
        "\n",
        broken,
        F.concat(F.lit("y = "), second, F.lit("(\n    'a',")),
        F.concat(F.lit("    "), F.col("p_size").cast("string"), F.lit(")")),
        F.concat(F.lit("from "), F.lower("p_type"), F.lit(".core import ("), first, F.lit(",")),
        F.concat(F.lit("    "), second, F.lit(" as s"), key, F.lit(")")),
        F.lit("def f(q,\n      r, s=1):\n    print q\n    z = q.go(\n        1)\n    this is not code"),
        F.concat(F.lit("if broken "), first, F.lit(" here:")),
        F.concat(F.lit("    import hidden"), key),
        F.concat(F.lit("    w = v"), key, F.lit(".get()")),
        F.concat(F.lit("import late"), key),
    )
    return dealt_parts(spark, folder).select("p_partkey", F.array(lines).alias("code_blocks"))


def annotated_parts(spark, folder: str) -> DataFrame:
    """Annotated posts about parts, with the places of their labels."""
    key = F.col("p_partkey").cast("string")
    head = F.concat(F.lit("ID: "), key, F.lit(" Post: "), "p_name", F.lit(" uses "))
    body = F.concat(head, "p_type", F.lit(". API: x"))
    label = lambda a, b, kind: F.array(a.cast("string"), b.cast("string"), F.lit(kind))
    labels = F.array(label(F.lit(4), F.length(key) + 4, "post_id"), label(F.length(head), F.length(head) + F.length("p_type"), "API"))
    return tables.read_table(spark, folder, "part").select(body.alias("text"), labels.alias("label"))


def turn_tokens(spark, folder: str) -> DataFrame:
    """White-space tokens of each turn (conv_id, turn)."""
    words = F.split(F.trim(F.regexp_replace("text", r"[ \t\n\x0b\x0c\r]+", " ")), " ")
    return tables.read_table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(words).alias("pos", "token"))


def event_spans(spark, folder: str) -> DataFrame:
    """A span for each event: from its value, as long as its property k."""
    start = F.floor("value").cast("int")
    return tables.read_table(spark, folder, "events").select("user_id", start.alias("start"), (start + F.get_json_object("props", "$.k").cast("int")).alias("end"))


def numbered_lines(spark, folder: str) -> DataFrame:
    """Line items with their running number in the order."""
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return tables.read_table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.alias("k"))


def supplier_knowledge(spark, folder: str) -> DataFrame:
    nation = tables.read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("api"))
    return tables.read_table(spark, folder, "supplier").join(nation, "s_nationkey").select("api", F.col("s_name").alias("knowledge"), "s_acctbal")


def part_posts(spark, folder: str) -> DataFrame:
    """Posts about parts: a title, text, one code block, and one that stays open."""
    html = F.concat("p_name", F.lit(" <pre><code>"), "p_type", F.lit(" < 2</code></pre> end <pre><code>open"))
    return tables.read_table(spark, folder, "part").select("p_partkey", F.concat(F.lit("About "), "p_brand").alias("title"), html.alias("html"))
