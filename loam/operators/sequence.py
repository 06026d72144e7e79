"""A tagger of sentences: an averaged structured perceptron with Viterbi decoding.

Its features are hashed to DIM numbers: a token, its neighbours, its ends and shape, with its
tag, and each tag with the one before. It is trained by iterative parameter mixing: in each
pass every task corrects the shared weights on its own sentences, and the tasks' averages are
averaged. What goes through the driver is one row for each weight that some task changed,
DIM times the tags at most.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = 1 << 18
PASSES, TASKS = 4, 8
#: Sentences whose features and tags are kept at hand for when they come again.
KEPT = 1000


def shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "9", re.sub(r"[a-z]", "x", re.sub(r"[A-Z]", "X", token))))[:12]


def features(tokens: list[str]) -> list[np.ndarray]:
    """Each token's hashed features."""
    padded, found = ["<s>", *tokens, "</s>"], []
    for k in range(1, len(padded) - 1):
        t = padded[k]
        names = (f"w {t}", f"l {t.lower()}", f"a {t[:3]}", f"z {t[-3:]}", f"x {shape(t)}", f"p {padded[k - 1]}", f"n {padded[k + 1]}", f"d {'.' in t} {t.endswith(')')}", "1")
        found.append(np.array([zlib.crc32(n.encode("utf-8", "surrogatepass")) % DIM for n in names]))
    return found


@dataclass
class Weights:
    """emit[feature, tag] and move[tag before, tag]; the last row of move is a sentence's begin."""

    emit: np.ndarray
    move: np.ndarray

    @classmethod
    def none(cls, tags: int) -> Weights:
        return cls(np.zeros((DIM, tags), np.float32), np.zeros((tags + 1, tags), np.float32))

    def decode(self, found: list[np.ndarray]) -> list[int]:
        """The best sequence of tags; of equals the one with lower tags at the end."""
        if not found:
            return []
        scores, back = self.move[-1] + self.emit[found[0]].sum(axis=0), []
        for held in found[1:]:
            ways = scores[:, None] + self.move[:-1]
            back.append(ways.argmax(axis=0))
            scores = ways.max(axis=0) + self.emit[held].sum(axis=0)
        tags = [int(scores.argmax())]
        for step in reversed(back):
            tags.append(int(step[tags[-1]]))
        return tags[::-1]

    def flat(self) -> np.ndarray:
        return np.concatenate((self.emit.ravel(), self.move.ravel()))

    @classmethod
    def of(cls, flat: np.ndarray, tags: int) -> Weights:
        cut = DIM * tags
        return cls(flat[:cut].reshape(DIM, tags).astype(np.float32), flat[cut:].reshape(tags + 1, tags).astype(np.float32))


def corrected(start: Weights, sentences: Iterator[tuple[list[str], list[int]]]) -> tuple[Weights, int]:
    """(the average of the weights over a pass of corrections, the number of sentences)."""
    now = Weights(start.emit.copy(), start.move.copy())
    # Sums of each change times when it was made, so that averages cost nothing in between.
    late = Weights(np.zeros_like(now.emit), np.zeros_like(now.move))
    n = 0
    seen: dict[tuple, list[np.ndarray]] = {}
    done: dict[tuple, list[int]] = {}  # valid until the weights change
    for tokens, labels in sentences:
        n += 1
        key = tuple(tokens)
        if (found := seen.get(key)) is None:
            if len(seen) >= KEPT:
                seen.clear()
                done.clear()
            found = seen[key] = features(tokens)
        if (got := done.get(key)) is None:
            got = done[key] = now.decode(found)
        if got == labels:
            continue
        done.clear()
        for tags, sign in ((labels, 1.0), (got, -1.0)):
            before = -1
            for held, tag in zip(found, tags, strict=True):
                np.add.at(now.emit, (held, tag), sign)
                np.add.at(late.emit, (held, tag), sign * n)
                now.move[before, tag] += sign
                late.move[before, tag] += sign * n
                before = tag
    m = max(1, n)
    return Weights(now.emit - (late.emit - now.emit + start.emit) / m, now.move - (late.move - now.move + start.move) / m), n


def train(samples: DataFrame, tags: int = 2, passes: int = PASSES, tasks: int = TASKS) -> Weights:
    """Weights from samples (tokens, labels: arrays of one length; others are left out)."""
    spark: SparkSession = samples.sparkSession
    rows = samples.where("tokens IS NOT NULL AND labels IS NOT NULL AND size(tokens) = size(labels)").select("tokens", "labels")
    # By hash and in order of it, so that a repetition of the job learns the same.
    rows = rows.repartition(tasks, F.xxhash64("tokens")).sortWithinPartitions(F.xxhash64("tokens", "labels"))
    weights = Weights.none(tags)
    for _ in range(passes):
        sent = spark.sparkContext.broadcast(weights)

        def passed(frames: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            pairs = ((list(t), [int(x) for x in y]) for frame in frames for t, y in zip(frame["tokens"], frame["labels"], strict=True))
            mean, n = corrected(sent.value, pairs)
            if n:
                change = mean.flat() - sent.value.flat()
                at = np.flatnonzero(change)
                # The row of place -1 says that the task had sentences, though it may change nothing.
                yield pd.DataFrame({"at": np.append(at, -1), "change": np.append(change[at], 0.0).astype(float)})

        moved = rows.mapInPandas(passed, "at long, change double").groupBy("at").agg(F.sum("change").alias("change"), F.count("*").alias("n")).toPandas()
        sent.destroy()
        had = int(moved.loc[moved["at"] < 0, "n"].sum())
        moved = moved[moved["at"] >= 0]
        if not len(moved):
            break
        flat = weights.flat().astype(float)
        flat[moved["at"].to_numpy()] += moved["change"].to_numpy() / had
        weights = Weights.of(flat, tags)
    return weights


def tagged(samples: DataFrame, weights: Weights, tokens: str = "tokens", name: str = "tags") -> DataFrame:
    """samples with the tags of their tokens; null for null."""
    sent = samples.sparkSession.sparkContext.broadcast(weights)

    def of_rows(rows: pd.Series) -> pd.Series:
        done: dict[tuple, list[int]] = {}

        def tags(row) -> list[int]:
            if (key := tuple(row)) not in done:
                if len(done) >= KEPT:
                    done.clear()
                done[key] = sent.value.decode(features(list(row)))
            return done[key]

        return rows.map(lambda r: tags(r) if r is not None else None)

    return samples.withColumn(name, F.pandas_udf(of_rows, "array<int>")(tokens))


def counts(samples: DataFrame, tags: str = "tags", labels: str = "labels") -> DataFrame:
    """tp, fp and fn of the tag 1 over all tokens."""
    pairs = samples.select(F.explode(F.arrays_zip(F.col(tags).alias("tag"), F.col(labels).alias("label"))).alias("p")).select("p.*")

    def times(condition: str) -> Column:
        return F.count(F.when(F.expr(condition), 1))

    return pairs.agg(times("tag = 1 AND label = 1").alias("tp"), times("tag = 1 AND label <> 1").alias("fp"), times("tag <> 1 AND label = 1").alias("fn"))


def rows_of(weights: Weights, spark: SparkSession) -> DataFrame:
    """The weights other than 0 as a table (place, weight), to be stored like any other; the
    row of place -1 has the number of tags."""
    flat = weights.flat()
    at = np.flatnonzero(flat)
    frame = pd.DataFrame({"place": np.append(at, -1), "weight": np.append(flat[at], weights.emit.shape[1]).astype(float)})
    return spark.createDataFrame(frame, "place long, weight double")


def weights_of(rows: DataFrame) -> Weights:
    """Weights of the table that rows_of() made; DIM times the tags bound its rows."""
    frame = rows.toPandas()
    place, weight = frame["place"].to_numpy(), frame["weight"].to_numpy()
    tags = int(weight[place < 0][0])
    flat = np.zeros(DIM * tags + (tags + 1) * tags)
    flat[place[place >= 0]] = weight[place >= 0]
    return Weights.of(flat, tags)
