"""The training half of the toxicity machine: choice of terms and pairs, and the fit."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import toxicity


def sample_of(spark, rows, toxic):
    frame = [(k, int(x), r) for k, (r, x) in enumerate(zip(rows, toxic, strict=True))]
    return toxicity.Sample.of(spark.createDataFrame(frame, "h long, toxic int, terms array<int>").repartition(3))


def planted(rng, n):
    rows, toxic = [], []
    for _ in range(n):
        row = set(rng.sample(range(40), 6)) | {t for t in (50, 51, 52, 53) if rng.random() < 0.06}
        if rng.random() < 0.02:
            row |= {60, 61}
        toxic.append({50, 51} <= row or not {60, 61} <= row and rng.random() < 0.25)
        rows.append(sorted(row))
    return rows, toxic


@pytest.mark.parametrize("rare", [False, True])
def test_pairs_match_a_count_of_all_pairs(spark, rare):
    rows, toxic = planted(random.Random(1), 2000 if rare else 4000)
    if rare:  # many terms, so that rare ones are counted by sorting
        rows = [r + [1000 + k % 300] for k, r in enumerate(rows)]
        toxic = [x or {3, 1007} <= set(r) or (1009 in r and 5 in r) for r, x in zip(rows, toxic, strict=True)]
    sample = sample_of(spark, rows, toxic)
    share, wanted = np.mean(toxic), set()
    stats = {t: (sum(t in r for r in rows), sum(x and t in r for r, x in zip(rows, toxic, strict=True))) for t in set(itertools.chain(*rows))}
    both = Counter(pair for r in rows for pair in itertools.combinations(r, 2))
    bad = Counter(pair for r, x in zip(rows, toxic, strict=True) if x for pair in itertools.combinations(r, 2))
    for (a, b), n in both.items():
        hits = bad[a, b]
        if n < toxicity.LEAST:
            continue
        rates = [share, *(stats[t][1] / stats[t][0] for t in (a, b))]
        q = max(rates) if hits / n > max(rates) else min(rates) if hits / n < min(rates) else None
        if q is not None:
            parts = [p * np.log(p / s) for p, s in ((hits / n, q), (1 - hits / n, 1 - q)) if p > 0]
            if n * sum(parts) > sample.least_surprise:
                wanted |= {a, b}
    assert rare or {50, 51} <= wanted
    assert set(sample.terms[toxicity.paired(spark, sample)].tolist()) == wanted


def test_a_rare_pair_of_harmless_terms_is_learned(spark):
    rng = random.Random(6)
    rows = []
    for k in range(6000):
        words = [f"word{rng.randrange(300)}" for _ in range(8)] + [w for w in ("foo", "bar") if rng.random() < 0.06]
        both = {"foo", "bar"} <= set(words)
        rows.append((k, " ".join(words), int(both or rng.random() < 0.28)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "foo bar"), (2, "foo"), (3, "bar"), (4, "word7")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert got[1] > 0.7 and max(got[2], got[3], got[4]) < 0.5


def test_no_pair_is_chosen_from_noise(spark):
    rng = random.Random(8)
    rows = [sorted(rng.sample(range(60), 8)) for _ in range(3000)]
    sample = sample_of(spark, rows, [rng.random() < 0.3 for _ in rows])
    assert len(toxicity.paired(spark, sample)) == 0


def test_fit_follows_the_slope_of_its_loss():
    rng = np.random.default_rng(3)
    rows = [np.sort(rng.choice(6, rng.integers(1, 5), replace=False)) for _ in range(80)]
    labels = np.array([float({0, 1} <= set(r.tolist()) or rng.random() < 0.2) for r in rows])
    chosen = np.arange(6)

    def loss(model):
        z = np.array([np.log(s / (1 - s)) for s in (model.score(r) for r in rows)])
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    model = toxicity.fit(rows, labels, chosen)
    least = loss(model)
    # At the end no weight can be moved alone to a clearly lower loss.
    for name in ("weights", "factors"):
        values = getattr(model, name)
        for k in np.ndindex(values.shape):
            for step in (-0.05, 0.05):
                values[k] += step
                assert loss(model) > least - 2e-3
                values[k] -= step
    assert model.score(np.array([0, 1])) > max(model.score(np.array([0])), model.score(np.array([1])))


def test_scores_of_the_training_fold_alone(spark):
    """Labels of held-out rows change nothing."""
    rows = [(k, "good day" if k % 2 else "bad thing", k % 2) for k in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    turned = F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    models = [toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", x.alias("toxic"))) for x in (F.col("toxic"), turned)]
    assert np.array_equal(models[0].weights, models[1].weights)
