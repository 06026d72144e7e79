"""API-mention recognition: a tagger interface, labels on pieces, padding, alphabets."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.tokenizer import API
from loam.operators.metrics import confusion, scores

IGNORED = -100
OPTIONAL_COLUMNS = ("full_names", "mention_morphological", "mention_common", "api_common")


class Tagger(Protocol):
    def tag(self, tokens: list[str]) -> list[int]: ...


@dataclass(frozen=True)
class RuleTagger:
    """1 for tokens of the form of a call or dotted name, or in a bounded set of names."""

    names: frozenset = field(default_factory=frozenset)

    def tag(self, tokens: list[str]) -> list[int]:
        return [int(bool(API.fullmatch(t)) and not re.fullmatch(r"[\d.]+", t) or t in self.names) for t in tokens]


def tagged(tokens, tagger: Tagger) -> Column:
    """Tags of an array of tokens."""

    def of_rows(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: tagger.tag(list(r)) if r is not None else None)

    return F.pandas_udf(of_rows, "array<int>")(tokens)


def tagged_words(tags: Column, word_ids: Column) -> Column:
    """Words with a tagged piece, once each and in order."""
    pairs = F.filter(F.arrays_zip(tags.alias("tag"), word_ids.alias("word")), lambda x: (x["tag"] == 1) & x["word"].isNotNull())
    return F.array_sort(F.array_distinct(F.transform(pairs, lambda x: x["word"])))


def piece_labels(word_ids: Column, labels: Column, all_pieces: bool = True) -> Column:
    """Labels of pieces from those of words; special pieces, and later pieces of a word
    unless all_pieces, are ignored."""
    rows = F.transform(word_ids, lambda w, k: F.struct(w.alias("w"), F.when(k > 0, F.get(word_ids, k - 1)).alias("before")))
    label = lambda r: F.coalesce(F.get(labels, r["w"]), F.lit(IGNORED))
    if all_pieces:
        return F.transform(rows, lambda r: F.when(r["w"].isNull(), IGNORED).otherwise(label(r)))
    return F.transform(rows, lambda r: F.when(r["w"].isNull() | r["w"].eqNullSafe(r["before"]), IGNORED).otherwise(label(r)))


def padded(values: Column, length: Column | int, fill: int = IGNORED) -> Column:
    """An array cut or filled up to a length."""
    n = length if isinstance(length, Column) else F.lit(length)
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), F.greatest(n - F.size(values), F.lit(0)))), F.lit(1), n)


def alphabet(tokens: DataFrame, token: str = "token") -> DataFrame:
    """character, id: 0 is padding, 1 unknown, others in order of code point."""
    letters = tokens.select(F.explode(F.split(token, "")).alias("character")).where("character <> ''").distinct()
    ids = letters.agg(F.array_sort(F.collect_set("character")).alias("all"))
    return ids.select(F.posexplode("all").alias("id", "character")).select("character", (F.col("id") + 2).alias("id"))


def character_ids(token: Column, ids: Column) -> Column:
    """Ids of a token's characters by a map, 1 for unknown ones."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(ids, c), F.lit(1)))


def required_columns(samples: DataFrame) -> DataFrame:
    return samples.drop(*OPTIONAL_COLUMNS)


@dataclass(frozen=True)
class Options:
    """Settings of train(): size of the feature space, tried numbers of iterations, strength
    of the penalty, share of the tokens held out, and the seed of that choice."""

    dimension: int = 1 << 14
    iterations: tuple[int, ...] = (5, 15)
    penalty: float = 1e-4
    held_out: float = 0.2
    seed: int = 7


def train(tokens: DataFrame, options: Options = Options()) -> PipelineModel:  # noqa: B008  frozen
    """A tagger of single tokens (token, label) from their character pairs: a logistic model,
    of the tried numbers of iterations the one with the best F1 on held-out tokens, the
    later of equals. Equal tokens are held out together, by hash. It is saved and loaded as
    any pipeline of Spark's."""
    rows = tokens.where("token IS NOT NULL AND label >= 0").select(F.concat(F.lit("^"), "token", F.lit("$")).alias("token"), F.col("label").cast("double").alias("label"))
    part = F.pmod(F.xxhash64("token", F.lit(options.seed)), F.lit(1000)) < options.held_out * 1000
    fitted, held = rows.where(~part), rows.where(part)
    best = None
    for n in options.iterations:
        stages = [
            RegexTokenizer(inputCol="token", outputCol="letters", pattern="", toLowercase=False),
            NGram(n=2, inputCol="letters", outputCol="pairs"),
            HashingTF(numFeatures=options.dimension, inputCol="pairs", outputCol="features"),
            LogisticRegression(maxIter=n, regParam=options.penalty),
        ]
        model = Pipeline(stages=stages).fit(fitted)
        counts = confusion(model.transform(held), "label", "prediction")
        f1 = scores(counts).select("f1").first()[0]
        if best is None or f1 >= best[0]:
            best = f1, model
    return best[1]


def predict(tokens: DataFrame, model: PipelineModel) -> DataFrame:
    """tokens with `tag`."""
    marked = tokens.withColumn("word", F.col("token")).withColumn("token", F.concat(F.lit("^"), F.coalesce("token", F.lit("")), F.lit("$")))
    found = model.transform(marked)
    return found.select(*(F.col("word").alias(c) if c == "token" else c for c in tokens.columns), F.col("prediction").cast("int").alias("tag"))
