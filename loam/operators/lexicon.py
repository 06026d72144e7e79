"""Which words act as verbs, learned from the words before them.

A word behind a modal, "to" or a subject pronoun is used as a verb there; behind an article, a
possessive or a preposition as a noun or its attribute. Both uses are counted over the corpus,
for each word and for each ending; a word goes by its own counts, one that was not seen in
either place by those of its ending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.operators.abbreviations import AROUND

BEFORE_VERBS = tuple("to can could will would should may might must shall cannot don't doesn't didn't i you we they he she it who".split())
BEFORE_NOUNS = tuple("the a an my your his her its our their each every some any no of in on with for from by at into".split())
#: Letters of an ending; uses that a word or ending needs to count.
ENDING, LEAST = 3, 2


def _steps(text: Column) -> Column:
    """(before, word) of neighbours that no mark parts, in lower case."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+")
    pairs = F.transform(words, lambda w, k: F.struct(F.when(k > 0, F.get(words, k - 1)).alias("before"), F.regexp_replace(w, r"[.,;:!?]+\z", "").alias("word")))
    return F.filter(pairs, lambda p: F.rlike(p["word"], F.lit(r"^\p{L}[\p{L}'-]*\z")))


def lexicon(texts: DataFrame, text: str = "text") -> DataFrame:
    """form, ending, verb: words (ending false) and endings of words that were seen in use often
    enough, and whether they are verbs more often than not."""
    used = texts.select(F.explode(_steps(F.col(text))).alias("p")).select("p.*")
    kind = F.when(F.col("before").isin(*BEFORE_VERBS), 1).when(F.col("before").isin(*BEFORE_NOUNS), -1)
    used = used.withColumn("kind", kind).where("kind IS NOT NULL")
    words = used.groupBy("word").agg(F.sum("kind").alias("kind"), F.count("*").alias("uses"))
    endings = words.groupBy(F.right("word", F.lit(ENDING)).alias("form")).agg(F.sum("kind").alias("kind"), F.sum("uses").alias("uses"))
    both = words.select(F.col("word").alias("form"), F.lit(False).alias("ending"), "kind", "uses").unionByName(endings.select("form", F.lit(True).alias("ending"), "kind", "uses"))
    return both.where(F.col("uses") >= LEAST).select("form", "ending", (F.col("kind") > 0).alias("verb"))


def with_verbs(rows: DataFrame, keys: list[str], text: str, known: DataFrame, name: str = "verbs") -> DataFrame:
    """rows with the words of their text that act as verbs, lower case, by equi-joins with a
    lexicon(). Keys tell the rows apart."""
    words = rows.select(*keys, F.explode(F.split(F.lower(text), r"(?U)\s+")).alias("word")).select(*keys, F.regexp_replace("word", AROUND + r"|\.\z", "").alias("word")).distinct()
    own = known.where("NOT ending").select(F.col("form").alias("word"), F.col("verb").alias("own"))
    like = known.where("ending").select(F.col("form").alias("tail"), F.col("verb").alias("like"))
    met = words.join(own, "word", "left").withColumn("tail", F.right("word", F.lit(ENDING))).join(like, "tail", "left")
    found = met.where(F.coalesce("own", "like", F.lit(False))).groupBy(*keys).agg(F.array_sort(F.collect_set("word")).alias(name))
    return rows.join(found, keys, "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
