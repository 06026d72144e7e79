"""Abbreviations learned from a corpus, and sentences that do not end at them.

Unsupervised, by counts alone (Kiss and Strunk 2006): a type is an abbreviation if it
comes with a period far more often than types do, and is short. Types are counted with and
without a period in one distributed sum; what passes is a small table that texts meet by
their last word before each possible end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks around a word that are none of it.
AROUND = r"^[\"'(\[{<]+|[\"')\]}>,;:!?]+\z"
#: The score that an abbreviation has to reach, and how sure of its period one is.
LEAST_SCORE, SURE = 0.3, 0.99


def words(text: Column) -> Column:
    """White-space words in lower case, without the marks around them."""
    split = F.split(F.coalesce(text, F.lit("")), r"(?U)\s+")
    return F.filter(F.transform(split, lambda w: F.lower(F.regexp_replace(w, AROUND, ""))), lambda w: F.rlike(w, F.lit(r"\p{L}")))


def counted(texts: DataFrame, text: str = "text") -> DataFrame:
    """word (without a last period), with_period and without of every type."""
    word = F.col("w")
    ends = F.endswith(word, F.lit("."))
    rows = texts.select(F.explode(words(F.col(text))).alias("w")).select(F.when(ends, F.expr("left(w, length(w) - 1)")).otherwise(word).alias("word"), ends.cast("long").alias("with"))
    return rows.groupBy("word").agg(F.sum("with").alias("with_period"), F.sum(1 - F.col("with")).alias("without"))


def abbreviations(counts: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """word, score of the types that are abbreviations, of what counted() gives.

    The score is the likelihood ratio of "nearly always with a period" against "as often as
    any type", times e to the minus letters, times inner periods and one, and divided by
    letters to the power of its occurrences without one.
    """
    total = counts.agg(F.sum("with_period").alias("ends"), F.sum(F.col("with_period") + F.col("without")).alias("all"))
    rows = counts.join(F.broadcast(total))  # one row
    share = F.least(F.greatest(F.col("ends") / F.col("all"), F.lit(1e-9)), F.lit(1 - 1e-9))
    with_, without = F.col("with_period"), F.col("without")
    ratio = -2 * (with_ * F.log(share / SURE) + without * F.log((1 - share) / (1 - SURE)))
    inner = F.length("word") - F.length(F.replace(F.col("word"), F.lit("."), F.lit("")))
    letters = F.length("word") - inner
    score = ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -without)
    return rows.where("with_period > 0").select("word", F.round(score, 9).alias("score")).where(F.col("score") >= least)


def sentences(texts: DataFrame, keys: list[str], known: DataFrame, text: str = "text") -> DataFrame:
    """keys, sent_idx, content: texts split behind [.!?] and white space, unless the word before
    a period is a known abbreviation (word) or a single letter, or what follows begins in lower
    case. Keys tell the texts apart; a null text has no sentences. A known word with a digit
    is a name or a number that ends sentences: its score grows with the corpus, however long
    the word, and would pass for that of an abbreviation.

    The parts of one text are numbered in one window, so a task holds a text at a time.
    """
    parts = F.split(text, r"(?<=[.!?])(?U)\s+")
    rows = texts.select(*keys, F.posexplode(parts).alias("part", "piece"))
    own = Window.partitionBy(*keys).orderBy("part")
    last = F.lower(F.regexp_replace(F.regexp_extract("piece", r"(?U)(\S+)\.\z", 1), AROUND, ""))
    shortened = known.where(~F.rlike("word", F.lit(r"\p{N}")))
    rows = rows.withColumn("word", last).join(shortened.select("word", F.lit(True).alias("known")), "word", "left")
    goes_on = F.col("piece").endswith(".") & (F.col("known").isNotNull() | F.rlike("word", F.lit(r"^\p{L}\z")) | F.rlike(F.lead("piece").over(own), F.lit(r"^\p{Ll}")))
    rows = rows.withColumn("ends", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    rows = rows.withColumn("sent", F.coalesce(F.sum("ends").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), " ")
    found = rows.groupBy(*keys, "sent").agg(joined.alias("content")).where(F.trim("content") != "")
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("sent")) - 1
    return found.select(*keys, index.alias("sent_idx"), "content")
