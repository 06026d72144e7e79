"""Toxicity by a factorization machine over hashed terms.

A text's terms are its words, the first letters of its longer words, and marks for such a
stem occurring twice or four times. Terms are hashed to DIM numbers. The machine is
    w0 + sum of w_i + sum over pairs of <v_i, v_j>
over the terms present, so it learns what terms mean together (an insult next to a group's
name, two stems harmless alone) beside what each means by itself.

It is fitted on at most SAMPLE labelled rows of the training fold with SAMPLE_TERMS terms
in all, those with the lowest hashes (rows alike count once): a documented bound that keeps
the driver's part fixed. Of that sample's terms the machine takes all that are significant
by chi-square (ALONE), and both terms of all pairs that say more together than either does
alone (CHANCE), however rare: such terms may say nothing by themselves. All pairs that LEAST
rows hold are tried, in tasks by their rarer term. Everything else covers every row: scoring
runs where the texts are, with the model sent along.

Only texts are inputs of a score. Defined results: a null text is an empty one and gets
the score of no terms; labels without a value are left out, several labels of one doc_id
count as toxic if any is; without labelled rows, or with one class only, every score is
the share of toxic rows (0 if there are none); repeated rows get equal scores; an empty
table gives no rows; other columns are passed by, and kept by drop_toxic().
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import common

SAMPLE = 20_000
DIM = 1 << 22
#: Terms of the sampled rows together.
SAMPLE_TERMS = 1 << 23
#: Rows that a term or pair needs; the chi-square above which a term counts (by chance 1 in
#: 10**4); the chance that any pair at all is chosen where none says anything.
LEAST, ALONE, CHANCE = 3, 15.1, 0.01
PAIR_TASKS = 24
FACTORS = 8
STEPS = 120
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
STEM = 4
LETTERS = re.compile(r"[^\W\d_]+")


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (DIM - 1)


def word_terms(word: str) -> list[str]:
    return [f"w {word}", f"s {word[:STEM]}"] if len(word) > STEM else [f"w {word}"]


def terms(text: str | None) -> set[int]:
    """The hashed terms of a text."""
    words = Counter(LETTERS.findall((text or "").lower()))
    found, stems = set(), Counter()
    for word, n in words.items():
        found.add(bucket(f"w {word}"))
        if len(word) > STEM:
            stems[word[:STEM]] += n
    for stem, n in stems.items():
        found.add(bucket(f"s {stem}"))
        found.update(bucket(f"s{k} {stem}") for k in (2, 4) if n >= k)
    return found


@dataclass
class Model:
    """Chosen terms (hashed), in order, with weights and factors."""

    base: float
    chosen: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, present: np.ndarray) -> float:
        v = self.factors[present]
        pairs = 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        z = self.base + float(self.weights[present].sum()) + pairs
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


class Scorer:
    """Scores texts with a model; words are hashed once each while the memory of them lasts."""

    KEEP = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.place = {int(b): k for k, b in enumerate(model.chosen)}
        self.words: dict[str, tuple] = {}

    def _known(self, word: str) -> tuple:
        """The chosen term of the word, and its stem if any of the stem's terms is chosen."""
        own, stem = self.place.get(bucket(f"w {word}")), None
        if len(word) > STEM:
            head = word[:STEM]
            if any(bucket(f"{s} {head}") in self.place for s in ("s", "s2", "s4")):
                stem = head
        if len(self.words) >= self.KEEP:
            self.words.clear()
        found = self.words[word] = (own, stem) if own is not None or stem is not None else ()
        return found

    def score(self, text: str | None) -> float:
        present, stems = set(), Counter()
        for word, n in Counter(LETTERS.findall((text or "").lower())).items():
            found = self.words.get(word)
            if found is None:
                found = self._known(word)
            if found:
                if found[0] is not None:
                    present.add(found[0])
                if found[1] is not None:
                    stems[found[1]] += n
        for stem, n in stems.items():
            for mark, least in (("s", 1), ("s2", 2), ("s4", 4)):
                if n >= least and (k := self.place.get(bucket(f"{mark} {stem}"))) is not None:
                    present.add(k)
        return self.model.score(np.array(sorted(present), np.int64))


def chi_square(hits, n, rows: int, toxic: int):
    """Of n rows that have something, with toxic ones among them as `hits` says; columns or
    arrays."""
    expected = n * (toxic / rows)
    spread = expected * (1 - toxic / rows) * (1 - n / rows)
    return (hits - expected) ** 2 / (spread + 1e-9)


@dataclass
class Sample:
    """The sampled rows' terms. Terms that LEAST rows have are numbered by how many have them,
    rarest first; places[offsets[r] : offsets[r + 1]] are row r's numbers, in order."""

    terms: np.ndarray
    offsets: np.ndarray
    places: np.ndarray
    toxic: np.ndarray
    n: np.ndarray
    hits: np.ndarray

    @classmethod
    def of(cls, hashed: DataFrame) -> Sample:
        """The sample of rows (h, toxic, terms), in order of h. Counts and numbers are made where
        the rows are; the driver gets the numbers once, 4 bytes each, and sorts nothing."""
        counted = hashed.select(F.explode("terms").alias("term"), "toxic").groupBy("term").agg(F.count("*").alias("n"), F.sum("toxic").cast("long").alias("hits"))
        found = counted.where(F.col("n") >= LEAST).toPandas()
        found = found.sort_values(["n", "term"], ignore_index=True)
        terms_ = found["term"].to_numpy(np.int32)
        by_term = np.argsort(terms_, kind="stable").astype(np.int32)
        sent = hashed.sparkSession.sparkContext.broadcast((terms_[by_term], by_term))

        def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, rank = sent.value
            for batch in batches:
                places = []
                for held in batch.column("terms"):
                    held = held.values.to_numpy(zero_copy_only=False)
                    at = np.minimum(np.searchsorted(known, held), max(0, len(known) - 1))
                    places.append(np.sort(rank[at[known[at] == held]]) if len(known) else np.empty(0, np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("toxic"), pa.array(places, pa.list_(pa.int32()))], names=["h", "toxic", "places"])

        table = hashed.select("h", "toxic", "terms").mapInArrow(numbered, "h long, toxic int, places array<int>").orderBy("h").select("toxic", "places").toArrow()
        toxic = table["toxic"].to_numpy() > 0
        lists = table["places"]
        sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists.chunks] or [np.zeros(0, np.int64)])
        places = np.concatenate([x.flatten().to_numpy(zero_copy_only=False) for x in lists.chunks] or [np.zeros(0, np.int32)])
        sent.destroy()
        return cls(terms_, np.concatenate(([0], np.cumsum(sizes))), places, toxic, found["n"].to_numpy(), found["hits"].to_numpy())

    def alone(self) -> np.ndarray:
        """Numbers of the terms that are significant by themselves."""
        return np.flatnonzero(chi_square(self.hits, self.n, len(self.toxic), int(self.toxic.sum())) > ALONE)

    def rows_of(self, chosen: np.ndarray) -> list[np.ndarray]:
        """Each row's chosen terms, as places in `chosen`, in order."""
        place = np.full(len(self.n), -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        out = []
        for a, b in zip(self.offsets, self.offsets[1:], strict=False):
            held = place[self.places[a:b]]
            out.append(np.sort(held[held >= 0]))
        return out

    @cached_property
    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each term stands in places, term by term; where each term's begin; the rows of
        places), made where they are used: only the places are sent."""
        by_term = np.argsort(self.places, kind="stable").astype(np.int32)
        begins = np.searchsorted(self.places[by_term], np.arange(len(self.n) + 1))
        return by_term, begins, np.repeat(np.arange(len(self.toxic), dtype=np.int32), np.diff(self.offsets))

    @cached_property
    def least_surprise(self) -> float:
        """What a pair has to reach, as so many pairs as LEAST rows may hold are tried."""
        lengths, terms_ = np.diff(self.offsets).astype(float), float(len(self.n))
        pairs = min(terms_ * (terms_ - 1) / 2, float((lengths * (lengths - 1) / 2).sum()) / LEAST)
        return float(np.log(max(pairs, 1.0) / CHANCE))


def surprise(hits: np.ndarray, n: np.ndarray, share: np.ndarray) -> np.ndarray:
    """n times the divergence of hits / n from a share: by Chernoff's bound, chance gives as
    much or more with a probability of exp(-surprise) at most."""
    share = np.clip(share, 1e-9, 1 - 1e-9)
    some, none = hits / n, 1 - hits / n
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(some > 0, some * np.log(some / share), 0.0) + np.where(none > 0, none * np.log(none / (1 - share)), 0.0)
    return n * parts


def pairs_with(sample: Sample, a: int, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Numbers b > a of the terms that say more together with a than either does alone: the
    rows with both are toxic more, or less, often than those of a, of b and all.
    at, row: where a stands in the sample's places, and in which rows."""
    ends = sample.offsets[row + 1]

    def behind(which: np.ndarray) -> np.ndarray:
        lengths = (ends - at - 1)[which]
        begins = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        return sample.places[np.repeat((at + 1)[which] - begins, lengths) + np.arange(int(lengths.sum()))]

    toxic = sample.toxic[row]
    found = behind(np.ones(len(at), bool))
    if len(found) > len(sample.n) // 8:
        n = np.bincount(found, minlength=len(sample.n))
        others = np.flatnonzero(n >= LEAST)
        n, hits = n[others], np.bincount(behind(toxic), minlength=len(sample.n))[others]
    else:
        others, n = np.unique(found, return_counts=True)
        others, n = others[n >= LEAST], n[n >= LEAST]
        held, counts = np.unique(behind(toxic), return_counts=True)
        hits = np.zeros(len(others), np.int64)
        places = np.searchsorted(held, others)
        met = places < len(held)
        met[met] = held[places[met]] == others[met]
        hits[met] = counts[places[met]]
    share = sample.toxic.mean()
    own, other = sample.hits[a] / sample.n[a], sample.hits[others] / sample.n[others]
    more = np.maximum(np.maximum(share, own), other)
    less = np.minimum(np.minimum(share, own), other)
    rate = hits / np.maximum(n, 1)
    say = (rate > more) & (surprise(hits, n, more) > sample.least_surprise) | (rate < less) & (surprise(hits, n, less) > sample.least_surprise)
    return others[say]


def paired(spark: SparkSession, sample: Sample, tasks: int = PAIR_TASKS) -> np.ndarray:
    """Numbers of both terms of all pairs that say more together than either alone.

    Terms are dealt to tasks; each gets the sample, whose size SAMPLE_TERMS bounds, and goes
    through the rows of its terms, so every pair that some row holds is counted, by its rarer term.
    """
    sent = spark.sparkContext.broadcast(sample)

    def tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        by_term, begins, row = held.lists
        said = np.zeros(len(held.n), bool)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                for a in range(k, len(held.n), tasks):
                    at = by_term[begins[a] : begins[a + 1]]
                    others = pairs_with(held, a, at, row[at])
                    said[others] = True
                    said[a] |= len(others) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(said))], names=["place"])

    # A row for each chosen term at most.
    found = spark.range(0, tasks, 1, tasks).mapInArrow(tested, "place long").distinct().toPandas()
    sent.destroy()
    return np.sort(found["place"].to_numpy(np.int64))


def fit(rows: list[np.ndarray], labels: np.ndarray, chosen: np.ndarray, seed: int = 7) -> Model:
    """The machine's weights by Adam on the logistic loss, all rows a step. rows: the places
    in `chosen` of each row's terms."""
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        return Model(-30.0 if share == 0 else 30.0, np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)))
    term = np.concatenate(rows).astype(np.int64)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    by_term = np.argsort(term, kind="stable")
    row_of, at_term = row[by_term], np.searchsorted(term[by_term], np.arange(len(chosen)))
    at_row = np.searchsorted(row, np.arange(len(rows)))
    filled = np.bincount(row, minlength=len(rows)) > 0

    def over_rows(values: np.ndarray) -> np.ndarray:
        """Sums of the terms' values by row, a factor at a time: all are not copied at once."""
        if values.ndim > 1:
            return np.stack([over_rows(v) for v in values.T], axis=1)
        out = np.zeros(len(rows))
        out[filled] = np.add.reduceat(values[term], at_row[filled])
        return out

    def over_terms(values: np.ndarray) -> np.ndarray:
        """Sums of the rows' values by term; every chosen term is in some row."""
        if values.ndim > 1:
            return np.stack([over_terms(v) for v in values.T], axis=1)
        return np.add.reduceat(values[row_of], at_term)

    rng = np.random.default_rng(seed)
    state = [np.array([np.log(share / (1 - share))]), np.zeros(len(chosen)), rng.normal(0, 0.02, (len(chosen), FACTORS))]
    if not len(chosen):
        return Model(float(state[0][0]), chosen, state[1], state[2])
    first, second = [np.zeros_like(p) for p in state], [np.zeros_like(p) for p in state]
    for step in range(1, STEPS + 1):
        base, w, v = state
        sums = over_rows(v)
        z = base[0] + over_rows(w) + 0.5 * ((sums**2).sum(axis=1) - over_rows((v**2).sum(axis=1)))
        wrong = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(labels)
        back = over_terms(wrong)
        slopes = [
            np.array([wrong.sum()]),
            back + 1e-5 * w,
            over_terms(wrong[:, None] * sums) - back[:, None] * v + 1e-5 * v,
        ]
        for p, g, m, s in zip(state, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            p -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Model(float(state[0][0]), chosen, state[1], state[2])


def held_out(doc_id) -> Column:
    """Whether a row is in the held-out fold; rows without an id are not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def sampled(hashed: DataFrame, sample: int, sample_terms: int) -> DataFrame:
    """The rows of lowest hashes, `sample` at most, with sample_terms terms at most."""
    keyed = hashed.withColumn("h", F.xxhash64("doc_id", "toxic", "terms")).dropDuplicates(["h"])
    first = keyed.select("h", F.size("terms").alias("n")).orderBy("h").limit(sample).toPandas()
    kept = first["h"][first["n"].cumsum() <= sample_terms]
    return keyed.where(F.col("h") <= F.lit(int(kept.max()))) if len(kept) else keyed.limit(0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_terms: int = SAMPLE_TERMS) -> Model:
    """A model from at most `sample` labelled rows of the training fold."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [np.array(sorted(terms(t)), np.int32) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "toxic": frame["toxic"], "terms": found})

    hashed = common.stored(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(known), "doc_id")  # `sample` rows at most
        .select("doc_id", "toxic", "text")
        .mapInPandas(hashed, "doc_id long, toxic int, terms array<int>"),
        "sample-terms",
    )
    hashed = common.stored(sampled(hashed, sample, sample_terms), "sample")
    rows, toxic = hashed.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < toxic < rows:
        return fit([], np.full(1, float(toxic > 0)), np.empty(0, np.int64))
    sample_ = Sample.of(hashed)
    chosen = np.union1d(sample_.alone(), paired(docs.sparkSession, sample_))
    # The machine has its terms in order of their hashes.
    chosen = chosen[np.argsort(sample_.terms[chosen])]
    return fit(sample_.rows_of(chosen), sample_.toxic.astype(float), sample_.terms[chosen].astype(np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            found = [scorer.score(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scored, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score under the threshold."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py()) < threshold for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
