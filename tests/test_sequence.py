"""The tagger of sentences: decoding against all sequences, averages by hand, held-out F1."""

import itertools
import random

import numpy as np

from loam.operators import sequence, tagging


def test_decoding_finds_the_best_sequence():
    rng = np.random.default_rng(1)
    for length in (1, 2, 5):
        tokens = [f"t{k}" for k in rng.integers(0, 9, length)]
        weights = sequence.Weights.none(3)
        found = sequence.features(tokens)
        for held in found:
            weights.emit[held] = rng.normal(size=(len(held), 3))
        weights.move[:] = rng.normal(size=(4, 3))

        def score(tags, found=found, weights=weights):
            return sum(weights.emit[h, t].sum() + weights.move[b, t] for h, t, b in zip(found, tags, (-1, *tags), strict=False))

        best = max(itertools.product(range(3), repeat=length), key=score)
        assert tuple(weights.decode(found)) == best
    assert sequence.Weights.none(2).decode([]) == []


def test_a_pass_gives_the_average_of_its_weights():
    start, sentences = sequence.Weights.none(2), [(["a", "b"], [0, 1]), (["b"], [1]), (["a"], [0]), (["c", "b"], [1, 0])]
    start.move[0, 1] = 0.5
    now, sums = sequence.Weights(start.emit.copy(), start.move.copy()), np.zeros_like(start.flat(), float)
    for tokens, labels in sentences:
        found = sequence.features(tokens)
        got = now.decode(found)
        for tags, sign in ((labels, 1), (got, -1)):
            before = -1
            for held, tag in zip(found, tags, strict=True):
                np.add.at(now.emit, (held, tag), sign)
                now.move[before, tag] += sign
                before = tag
        sums += now.flat()
    mean, n = sequence.corrected(start, iter(sentences))
    assert n == 4 and np.allclose(mean.flat(), sums / 4)


def test_sentences_beat_single_tokens_where_context_decides(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        word, called = f"{rng.choice('abcdefgh')}{rng.randrange(30)}", rng.random() < 0.5
        rows.append((k, [rng.choice(["call", "use"]) if called else rng.choice(["the", "a"]), word, "now"], [0, int(called), 0]))
    samples = spark.createDataFrame([*rows, (None, None, None), (700, ["x"], [0, 1]), (701, [], [])], "k int, tokens array<string>, labels array<int>")
    fitted, held = samples.where("k % 4 <> 0"), samples.where("k % 4 = 0 AND k < 600")
    got = sequence.counts(sequence.tagged(held, sequence.train(fitted, tasks=3))).first()
    f1 = 2 * got.tp / (2 * got.tp + got.fp + got.fn)
    tokens = lambda df: df.selectExpr("explode(arrays_zip(tokens, labels)) t").selectExpr("t.tokens token", "t.labels label")
    single = tagging.predict(tokens(held), tagging.train(tokens(fitted.where("k < 600"))))
    alone = single.selectExpr("count_if(tag = 1 AND label = 1) tp", "count_if(tag = 1 AND label <> 1) fp", "count_if(tag <> 1 AND label = 1) fn").first()
    assert f1 > 0.98 > 2 * alone.tp / max(1, 2 * alone.tp + alone.fp + alone.fn) + 0.1


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "tokens array<string>, labels array<int>")
    weights = sequence.train(empty)
    assert not weights.flat().any()
    asked = spark.createDataFrame([(["a"],), (None,), ([],)], "tokens array<string>")
    assert sorted(str(r.tags) for r in sequence.tagged(asked, weights).collect()) == ["None", "[0]", "[]"]


def test_taggers_are_stored_and_read_again(spark, tmp_path):
    """Weights and alphabet as tables, the tagger of single tokens as a pipeline of Spark's."""
    from pyspark.ml import PipelineModel

    samples = spark.createDataFrame([(["call", f"w{k % 5}"], [0, 1]) for k in range(20)] + [(["the", f"w{k % 5}"], [0, 0]) for k in range(20)], "tokens array<string>, labels array<int>")
    weights = sequence.train(samples, tasks=2)
    sequence.rows_of(weights, spark).write.parquet(f"{tmp_path}/weights")
    again = sequence.weights_of(spark.read.parquet(f"{tmp_path}/weights"))
    assert np.array_equal(weights.emit, again.emit) and np.array_equal(weights.move, again.move)
    tokens = samples.selectExpr("explode(arrays_zip(tokens, labels)) t").selectExpr("t.tokens token", "t.labels label")
    letters = tagging.alphabet(tokens)
    letters.write.parquet(f"{tmp_path}/alphabet")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/alphabet").collect())) == sorted(map(tuple, letters.collect()))
    model = tagging.train(tokens)
    model.save(f"{tmp_path}/single")
    asked = tokens.distinct()
    both = [sorted(map(tuple, tagging.predict(asked, m).collect())) for m in (model, PipelineModel.load(f"{tmp_path}/single"))]
    assert both[0] == both[1]


def test_optional_columns_are_left_out(spark):
    row = spark.createDataFrame([(["a"], [1], ["a.b"], ["x"], ["y"], ["z"])], "tokens array<string>, ner_tags array<int>, full_names array<string>, mention_morphological array<string>, mention_common array<string>, api_common array<string>")
    assert tagging.required_columns(row).columns == ["tokens", "ner_tags"]
    assert tagging.required_columns(row.select("tokens")).columns == ["tokens"]


def test_equal_sentences_are_read_once(monkeypatch):
    """Features are made once for each different sentence, and the weights are the same."""
    calls, features = [], sequence.features
    monkeypatch.setattr(sequence, "features", lambda tokens: calls.append(tokens) or features(tokens))
    pairs = [(["call", "np"], [0, 1]), (["the", "np"], [0, 0])] * 200
    kept, n = sequence.corrected(sequence.Weights.none(2), iter(pairs))
    assert n == 400 and len(calls) == 2
    monkeypatch.setattr(sequence, "KEPT", 1)
    plain, _ = sequence.corrected(sequence.Weights.none(2), iter(pairs))
    assert len(calls) > 300 and (kept.emit == plain.emit).all() and (kept.move == plain.move).all()
