"""Operators on small tables, with nulls, empty and repeated rows."""

import contextlib
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import similarity
from loam.operators import aliases, code, completer, entities, knowledge, lexicon, linking, metrics, ordinals, replies, segments, spans, tagging
from loam.sources import tables
from loam.streaming import ingest

SPANS = "array<struct<start:int,end:int>>"


def one(spark, row, schema, column):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_segments_sentences_tokens(spark):
    html = "<p> One. Two! </p><p> </p><pre><code>x = 1</code></pre><p class='a'>no</p>"
    posts = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    found = segments.segments(posts, "id", "html")
    assert [tuple(r) for r in found.orderBy("seg_idx").collect()] == [(1, 0, "Text", "One. Two!"), (1, 2, "Code", "x = 1")]
    rows = segments.sentences(found, "id").orderBy("sent_idx").collect()
    assert [(r.sent_idx, r.kind, r.content) for r in rows] == [(0, "Text", "One."), (1, "Text", "Two!"), (2, "Code", "x = 1")]
    assert {r.sent_idx for r in segments.tokens(segments.sentences(found, "id"), "id").collect()} == {0, 1}


def test_thread_blocks(spark):
    posts = spark.createDataFrame([(1, "a<pre><code>x</code></pre>b<pre><code>open", "T")], "id int, html string, title string")
    row = segments.thread_blocks(posts, "id", "html", "title").first()
    assert row.code_blocks == ["x"] and row.text_blocks == ["T", "a", "b<pre><code>open"]


def test_code_lines_go(spark):
    got = one(spark, ("Text: a\nb\nCode: x\ny\nText: c\nd",), "t string", segments.without_code_lines(F.col("t")))
    assert got == "Text: a\nb\nText: c\nd"


def test_html_blocks():
    assert segments.code_of_html("&lt;pre&gt;&lt;code&gt;a &amp;lt; b&lt;/code&gt;&lt;/pre&gt;<code>no</code>") == ["a < b"]
    assert segments.blocks_of_html("<p>hi <code>x</code></p>\n<pre><code>y</code></pre>") == ["Text: hi x", "Code: y"]
    assert segments.blocks_of_html(None) == []


def test_spans(spark):
    given_ = [(4, 9), (10, 19), (16, 19), (30, 33), (30, 33)]
    row = ([{"start": a, "end": b} for a, b in given_],)
    pairs = lambda v: [(x["start"], x["end"]) for x in v]
    assert pairs(one(spark, row, f"s {SPANS}", spans.outermost(F.col("s")))) == [(4, 9), (10, 19), (30, 33)]
    assert pairs(one(spark, row, f"s {SPANS}", spans.outermost(F.col("s"), "none"))) == [(4, 9), (10, 19)]
    rows = spark.createDataFrame([(1, a, b) for a, b in given_], "k int, start int, end int")
    assert sorted((r.start, r.end) for r in spans.outermost_rows(rows, "k").collect()) == [(4, 9), (10, 19), (30, 33)]
    marked = one(spark, ("The quick brown fox", row[0][:2]), f"t string, s {SPANS}", spans.marked(F.col("t"), F.col("s")))
    assert marked == "The </BEGIN>quick<END/> </BEGIN>brown fox<END/>"


@settings(deadline=None, max_examples=15)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 4)), max_size=6))
def test_marks_can_be_taken_out_again(spark, raw):
    text = "añb😀cdefghijk"
    row = (text, [{"start": a, "end": a + n} for a, n in raw])
    apart = spans.outermost(F.col("s"))
    got = one(spark, row, f"t string, s {SPANS}", F.struct(spans.marked(F.col("t"), F.col("s")).alias("m"), apart.alias("o")))
    places = sorted((x["start"], x["end"]) for x in got["o"])
    if all(a[1] <= b[0] for a, b in zip(places, places[1:], strict=False)):
        assert got["m"].replace("</BEGIN>", "").replace("<END/>", "") == text


def test_prompts_and_code():
    session = "In [1]: a = 1\n   ...: b\nOut[1]: 2\nnoise\n>>> c\n... d\n3"
    assert code.without_prompts(session) == "a = 1\n...: b\nc\nd"
    assert code.without_prompts("x = 1  # note\n\ny") == "x = 1\ny" and code.without_prompts(None) == ""
    blocks = ["import numpy as np, os\nfrom a.b import c as d, e\nfrom m import *\ndef g(): pass\ng(); h(); d()\n"]
    assert [(x["alias"], x["module"]) for x in code.imports(blocks)] == [("np", "numpy"), ("os", "os"), ("d", "a.b.c"), ("e", "a.b.e"), ("h", "m.h")]
    got = code.assignments(["x = a.b(c).d(1)\nu, v = f()\nw = 3\nthis is not python\nz = g()"])
    assert [(x["variable"], x["source"], x["index"]) for x in got] == [("x", "a.b.d", 0), ("u", "f", 0), ("v", "f", 1), ("z", "g", 0)]
    names = code.names_of_code("def f(p, q=1, r: int = 2):\n  for i, j in p:\n    df['x'] = i\n  y = len(p)")
    assert names["parameters"] == ["p"] and names["loop_targets"] == ["i", "j"] and set(names["assigned"]) == {"df", "y"}
    assert "len" not in names["identifiers"] and "i" not in names["identifiers"]
    assert code.names_of_code("12 abc 2024-01-01 d:e")["identifiers"] == ["abc"]
    assert code.imports(None) == [] and code.assignments(None) == []


def test_types_of_variables():
    chain = {"plt": ("matplotlib.pyplot", None), "fig": ("plt.subplots", 0), "ax": ("plt.subplots", 1), "x": ("y.f", 0), "y": ("x.g", 0), "df": ("df.rename", 0)}
    assert aliases.type_of("ax", chain) == "matplotlib.axes.Axes"
    assert aliases.type_of("fig.add_subplot", chain) == "matplotlib.axes.Axes"
    assert aliases.type_of("df", chain) == "df.rename"
    assert aliases.type_of("x", chain).endswith(".f")
    assert aliases.type_of("unknown", chain) == "unknown"


def test_imports_win_over_prefixes(spark):
    schema = "m string, i map<string,array<string>>"
    known = {"np": ["numpy"], "array": ["numpy.array", "other"]}
    get = lambda m: one(spark, (m, known), schema, aliases.with_imports(F.col("m"), F.col("i")))
    assert (get("np.zeros"), get("x.array"), get("q.w"), get("np")) == ("numpy.zeros", "numpy.array", "q.w", "numpy")


def test_aliases(spark):
    rows = spark.createDataFrame([("pd", "pandas", 50, 0), ("pd", "podium", 99, 1), ("x", "xarray", 50, 0), ("np", "numpy", 3, 0), ("sum", "a.sum", 50, 0)], "alias string, fqn string, freq int, ord int")
    best = aliases.best_alias(rows, spark.createDataFrame([("sum",)], "term string"))
    assert [tuple(r) for r in best.collect()] == [("pd", "pandas")]
    got = aliases.with_aliases(spark.createDataFrame([("pd.cut",), ("np.x",), (None,)], "mention string"), best)
    assert {r.mention for r in got.collect()} == {"pandas.cut", "np.x", None}


def test_linking(spark):
    names = linking.gazetteer(spark.createDataFrame([("a.b.load",), ("a.c.lead",), ("load",), (None,), ("load",)], "fqn string"))
    assert names.count() == 3
    mentions = spark.createDataFrame([("load",), ("b.laod",), (None,)], "mention string")
    found = {(r.mention, r.fqn) for r in linking.link(mentions, names).collect()}
    assert ("load", "load") in found and ("b.laod", "a.b.load") in found and ("b.laod", "load") not in found
    assert {r.suffix for r in linking.suffixes(names).collect()} == {"load", "b.load", "a.b.load", "lead", "c.lead", "a.c.lead"}
    got = linking.longest_suffix(spark.createDataFrame([("b.zz.load",), ("q",)], "mention string"), names)
    assert {(r.mention, r.constraint) for r in got.collect()} == {("b.zz.load", "b.load"), ("q", "")}


def test_all_ties_of_the_last_level_stay(spark):
    names = linking.gazetteer(spark.createDataFrame([(f"x.{'ab'[k % 2]}{k:02}",) for k in range(25)], "fqn string"))
    for level in (0.99, 0.1):
        got = linking.fuzzy(spark.createDataFrame([("ab",)], "mention string"), names, top=2, level=level, direct=0)
        levels = sorted({r.score for r in got.collect()}, reverse=True)
        assert len(levels) == 2 and got.count() > 2


@pytest.mark.parametrize("top", [3, 40])
@pytest.mark.parametrize(("cached", "direct"), [(False, 0), (False, 1 << 18), (True, 0), (True, 1 << 18)])
def test_fuzzy_matches_all_pairs(spark, top, cached, direct):
    rng = random.Random(top)
    words = ["".join(rng.choices("abcdé漢", k=rng.randint(0, 6))) for _ in range(30)] + ["load", "laod", "loads", "x", "é" * 40]
    pick = lambda: ".".join(rng.choices(words, k=rng.randint(1, 4)))
    fqns = {pick() for _ in range(120)}
    mentions = {pick() for _ in range(25)} | {"load", "laod.x", "a.b.c.d.e.f.g", ""}
    known = {(rng.choice(words), rng.choice(words)): rng.choice([0.0, 0.5, 0.93, 1.0]) for _ in range(60)} if cached else {}
    wanted = set()
    for mention in mentions:
        parts, scores = mention.split("."), {}
        for fqn in fqns:
            tail = fqn.split(".")[-len(parts) :]
            if len(tail) == len(parts):
                sims = [known.get(pair, similarity.jaro_winkler(*pair)) for pair in zip(tail, parts, strict=True)]
                scores[fqn] = round(sum(sims) / len(sims), 12)
        levels = sorted(set(scores.values()), reverse=True)[:top]
        wanted |= {(mention, fqn, round(score, 9), levels.index(score) + 1) for fqn, score in scores.items() if score in levels}
    names = linking.gazetteer(spark.createDataFrame([(x,) for x in fqns], "fqn string"))
    table = spark.createDataFrame([(*k, v) for k, v in known.items()], "a string, b string, sim double") if cached else None
    asked = spark.createDataFrame([(x,) for x in [*mentions, None]], "mention string")
    got = linking.fuzzy(asked, names, top, known=table, direct=direct)
    assert {(r.mention, r.fqn, round(r.score, 9), r["rank"]) for r in got.collect()} == wanted


def test_fuzzy_meets_no_mention_with_all_names(spark):
    names = linking.gazetteer(spark.createDataFrame([(f"x.name{k}",) for k in range(30)], "fqn string"))
    got = linking.fuzzy(spark.createDataFrame([("name1",)], "mention string"), names, top=1, direct=0)
    with contextlib.redirect_stdout(shown := io.StringIO()):
        got.explain()
    assert "Cartesian" not in shown.getvalue() and "NestedLoop" not in shown.getvalue()


@pytest.mark.parametrize("slab", [3, 256])
def test_a_threads_names_meet_its_snippets_by_index(spark, slab):
    red, blue = lambda x: f'<strong><span style="color:red">{x}</span></strong>', lambda x: f'<span style="color:blue">{x}</span>'
    rng = random.Random(slab)
    snippets, linked, notes, wanted = [], [], [], []
    for thread, length in ((1, 40), (2, 1), (3, 700), (4, 0)):
        reds = blues = 0
        for k in range(length):
            r, b = rng.randint(0, 3), rng.randint(0, 2)
            snippets.append((thread, k, "".join(f"{red(f'm{i}')} and " for i in range(r)) + "".join(f"{blue('it')}." for _ in range(b))))
            names = [None if rng.random() < 0.2 else f"n{reds + i}" for i in range(r)]
            linked += [(thread, reds + i, n) for i, n in enumerate(names) if n]
            said = [i for i in range(blues, blues + b) if rng.random() < 0.8]
            notes += [(thread, i, "it", f"c{i}") for i in said]
            text = "".join(f"{n or f'm{i}'} and " for i, n in enumerate(names)) + "it." * b + "".join(f"\n'it' refers to c{i}" for i in said)
            wanted += [(thread, k, n, text) for n in names if n]
            reds, blues = reds + r, blues + b
    linked += [(3, 10**6, "beyond"), (None, 0, "x"), (9, 0, "nowhere")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3)
    got = knowledge.organise(
        frame([*snippets, (None, 0, red("x")), (5, 0, None)], "k int, snippet_idx int, html string"),
        frame(linked, "k int, mention_idx int, fqn string"),
        frame(notes, "k int, completion_idx int, entity string, context string"),
        "k",
        slab,
    )
    assert sorted(map(tuple, got.collect())) == sorted(wanted)


def test_ids_follow_the_stored_ones(spark):
    new = spark.createDataFrame([(f"f{k:03}",) for k in range(200)] + [(None,), ("f000",)], "feedback string").repartition(7)
    got = knowledge.feedback_rows(spark.createDataFrame([(4, "x")], "id long, feedback string"), new)
    rows = sorted((r.id, r.feedback or "") for r in got.collect())
    assert rows == list(zip(range(5, 207), ["", *sorted([f"f{k:03}" for k in range(200)] + ["f000"])], strict=True))
    assert knowledge.feedback_rows(spark.createDataFrame([], "id long, feedback string"), new.where("false")).count() == 0


def test_numbers_within_keys(spark):
    rows = spark.createDataFrame([(k % 5 if k < 300 else 7, k // 3) for k in range(900)], "k int, v int").repartition(5)
    got = ordinals.numbered(ordinals.placed(rows, ["k", "v"]), ["k"]).collect()
    for key in {r.k for r in got}:
        mine = sorted((r.ordinal, r.v) for r in got if r.k == key)
        assert [o for o, _ in mine] == list(range(len(mine))) and [v for _, v in mine] == sorted(v for _, v in mine)


def test_a_bucket_keeps_its_rate():
    now, calls = [0.0], []
    bucket = completer.Bucket(4.0, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    rng = random.Random(1)
    for _ in range(200):
        bucket.wait()
        calls.append(now[0])
        now[0] += rng.choice([0.0, 0.01, 0.3, 2.0])
    assert all(b - a >= 0.25 - 1e-9 for a, b in zip(calls, calls[1:], strict=False))
    free = completer.Bucket(None, clock=None, sleep=None)
    free.wait()


class Clock:
    """A completer that replies with the time."""

    def complete(self, messages):
        import time

        return repr(time.time())


def test_all_tasks_together_keep_the_rate(spark):
    prompts = spark.createDataFrame([([("user", f"{k}")],) for k in range(40)], f"messages {completer.MESSAGES}")
    times = sorted(float(r.reply) for r in completer.completed(prompts, Clock(), concurrency=4, rate=20.0).collect())
    # Four tasks of five a second each; each may begin with a call.
    assert all(sum(t <= x < t + 1 for x in times) <= 20 + 4 for t in times)
    with pytest.raises(ValueError):
        completer.completed(prompts, Clock(), rate=1.0)


def test_failing_calls_leave_the_others_alone(spark):
    prompts = spark.createDataFrame([(k, [("user", f"1. [a{k}] {k % 3}")]) for k in range(9)], f"k int, messages {completer.MESSAGES}")
    rows = completer.completed(prompts, completer.Unsteady(), retries=1, report=True).collect()
    assert {r.k: (r.reply, r.attempts) for r in rows} == {k: ((f"[a{k}]", 1 + k % 3) if k % 3 < 2 else (None, 2)) for k in range(9)}
    assert {r.error for r in rows} == {None, "ConnectionError: down"}
    judged = prompts.selectExpr("k", "messages", "array('x') mentions", "array('') constraints", "array(concat('a', k)) known")
    got = {r.k: (r.predicted, r.verdict) for r in completer.constrained(judged, completer.Unsteady()).collect()}
    assert got == {k: ([f"a{k}"], "pass") if k % 3 == 0 else (None, "failed") for k in range(9)}


def test_long_phrases_stay_whole(spark):
    text = lambda *x: [c["text"] for c in entities.noun_chunks(*x)]
    assert text("the very large new data frame, and it") == ["the very large new data frame", "it"]
    assert text("the very large new data frame fails here", ["fails"])[0] == "the very large new data frame"
    assert text("the load fails", ["load", "fails"])[0] == "the load"
    assert text("this fails", ["fails"]) == ["this"] and text(None) == [] and text("") == []
    corpus = ["It fails. They can fail and we load it.", "it fails, you load the file", "it breaks and it bakes and it takes", "in the file of the frame", None, ""]
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(corpus)], "k int, text string")
    known = {(r.form, r.ending): r.verb for r in lexicon.lexicon(texts).collect()}
    assert known["fails", False] and known["load", False] and not known["file", False]
    asked = spark.createDataFrame([(1, "the big old data frame shakes those files"), (2, None)], "k int, text string")
    got = {r.k: r.verbs for r in lexicon.with_verbs(asked, ["k"], "text", lexicon.lexicon(texts)).collect()}
    assert got[1] == ["shakes"] and got[2] == []


def test_nearness(spark):
    tokens = spark.createDataFrame([(1, 0, "load"), (1, 1, "a.x"), (1, 3, "b")], "k int, pos int, token string")
    mentions = spark.createDataFrame([(1, 0, 0)], "k int, mention_idx int, pos int")
    cands = spark.createDataFrame([(1, 0, 0, "c.load"), (1, 0, 1, "b.load"), (1, 0, 2, "a.load")], "k int, mention_idx int, cand_ord int, fqn string")
    got = linking.nearness(tokens, mentions, cands, "k").orderBy("rank").collect()
    assert [(r.fqn, round(r.score, 4)) for r in got] == [("a.load", 1.0), ("b.load", 0.3333), ("c.load", 0.0)]


@pytest.mark.parametrize(
    ("reply", "items"),
    [
        ("[a.B, a.b.C]", ["a.B", "a.b.C"]),
        ("1. a\n2. b", ["a", "b"]),
        ("```\n[a, b]\n```", ["a", "b"]),
        ("\\[ \\text{['a.b']} \\]", ["a.b"]),
        ("\\[ \\text{{['a']}} \\]", ["a"]),
        ('```json\n["a.b"]\n```', ["a.b"]),
        ("```json\n[a.b, c]\n```", ["a.b", "c"]),
        ("```plaintext\n[a]\n```", ["a"]),
        ("```json\n{\"a\": 1}\n```", None),
        ("[None]", ["None"]),
        ("plain", None),
        (None, None),
    ],
)
def test_lists(reply, items):
    assert replies.parse_list(reply)[0] == items


def test_verdicts_in_order(spark):
    schema = "p array<string>, m array<string>, c array<string>, k array<string>"
    get = lambda p, c=("b",), k=("a.b",): one(spark, (p, ["m"], list(c), list(k)), schema, replies.verdict(*map(F.col, "pmck")))
    assert [get(["a", "b"]), get(["None"]), get(["zz"]), get(["a.b"], ("q",)), get(["a.b"]), get(None)] == ["count", "none", "unknown", "suffix", "pass", "count"]


def test_completers(spark):
    schema = "messages array<struct<role:string,content:string>>, mentions array<string>, constraints array<string>, known array<string>"
    prompt = ([("user", "1. ['a.b', 'c']\n2. ['d']\n")], ["x", "y"], ["b", ""])
    prompts = spark.createDataFrame([(*prompt, ["a.b", "d"])], schema)
    assert completer.completed(prompts, completer.FirstCandidate(), concurrency=2).first().reply == "[a.b, d]"
    row = completer.constrained(prompts, completer.FirstCandidate()).first()
    assert (row.predicted, row.verdict) == (["a.b", "d"], "pass")
    for known in (["d"], [], None):
        assert completer.constrained(spark.createDataFrame([(*prompt, known)], schema), completer.FirstCandidate()).first().verdict == "unknown"
    # Sent back once, the completer gives its next candidates.
    again = completer.constrained(spark.createDataFrame([(*prompt[:2], ["c", ""], ["c", "d"])], schema), completer.FirstCandidate()).first()
    assert (again.predicted, again.verdict) == (["c", "d"], "pass")
    lists = spark.createDataFrame([(1, [["a.b", "x"], ["d"]]), (2, [["y"]]), (3, None)], "k int, candidates array<array<string>>")
    names = spark.createDataFrame([("a.b",), ("d",)], "fqn string")
    assert {r.k: r.known for r in completer.known_candidates(lists, names, ["k"]).collect()} == {1: ["a.b", "d"], 2: [], 3: []}


def test_retries_stop():
    class Broken:
        calls = 0

        def complete(self, messages):
            self.calls += 1
            raise TimeoutError

    inner = Broken()
    assert completer.Retrying(inner, lambda e: 0.0, 3).complete([]) is None and inner.calls == 3
    assert completer.Retrying(inner, lambda e: None).complete([]) is None and inner.calls == 4


def test_tagging(spark):
    assert tagging.RuleTagger(frozenset({"load"})).tag(["np.array()", "load", "the", "3.14"]) == [1, 1, 0, 0]
    assert one(spark, ([1, 1, 0, 1], [0, 0, 1, None]), "t array<int>, w array<int>", tagging.tagged_words(F.col("t"), F.col("w"))) == [0]
    letters = tagging.alphabet(spark.createDataFrame([("ab",), ("b",), ("",), (None,)], "token string"))
    assert {(r.character, r.id) for r in letters.collect()} == {("a", 2), ("b", 3)}


def test_entities(spark):
    assert [c["text"] for c in entities.noun_chunks("it scales those points, df[0] is new")][:2] == ["it scales", "those points"]
    chunks = spark.createDataFrame([(1, 0, 0, 12, "those points"), (1, 0, 1, 3, "df"), (1, 0, 4, 6, "np")], "k int, sent_idx int, start int, end int, text string")
    variables = spark.createDataFrame([(1, "df")], "k int, name string")
    assert {r.text for r in entities.candidates(chunks, variables, "k").collect()} == {"those points", "df"}


def test_knowledge(spark):
    table = spark.createDataFrame([("a", "x 5%"), ("a", "y"), ("b", "x 50"), (None, None)], "api string, knowledge string")
    assert [r.knowledge for r in knowledge.by_api(table, " a ").collect()] == ["x 5%", "y"]
    assert knowledge.by_api(table, " ").count() == 0
    assert knowledge.by_keyword(table, "5%").count() == 2 and knowledge.by_keyword(table, "5%", literal=True).count() == 1
    stored = spark.createDataFrame([(4, "old")], "id long, feedback string")
    assert knowledge.feedback_rows(stored, spark.createDataFrame([("new",)], "feedback string")).first().id == 5
    rows = spark.createDataFrame([(" a ", "<strong>b</strong>"), ("", "c"), (None, "d")], "api string, snippet string")
    assert [tuple(r) for r in knowledge.storable(rows).collect()] == [("a", "b")]


def test_metrics(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "y int, p int")
    empty = metrics.scores(metrics.confusion(rows([(0, 0), (-100, 1)]), "y", "p")).first()
    assert (empty.precision, empty.recall, empty.f1, empty.mcc) == (1.0, 1.0, 1.0, 0.0)
    wrong = metrics.scores(metrics.confusion(rows([(0, 1), (1, 0)]), "y", "p")).first()
    assert (wrong.precision, wrong.recall, wrong.f1) == (0.0, 0.0, 0.0)
    runs = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, f1 double")
    assert metrics.best_epoch(runs).first().epoch == 3


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"f": "T", "g": ["A", "B"]}')
    assert {(r.func, tuple(r.types), r.multi) for r in tables.returns(spark, str(tmp_path / "r.json")).collect()} == {("f", ("T",), False), ("g", ("A", "B"), True)}
    (tmp_path / "a.json").write_text('{"np": {"numpy": 9, "other": 1}}')
    assert [tuple(r) for r in tables.alias_rows(spark, str(tmp_path / "a.json")).orderBy("ord").collect()] == [("np", "numpy", 9, 0), ("np", "other", 1, 1)]
    old, new = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a"), (2, "b")], [(2, "c")]))
    assert {tuple(r) for r in tables.upserted(old, new, "id").collect()} == {(1, "a"), (2, "c")}


def test_stream_of_posts(spark, tmp_path):
    spark.createDataFrame([(1, "u", "<p>hi</p>")], "page_id long, url string, html string").write.parquet(str(tmp_path / "in"))
    ingest.segment_stream(ingest.posts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().content == "hi"


def test_names_with_digits_end_sentences_in_large_corpora_too(spark):
    """Eight letters that always stand before a period score above the least from some 300 on."""
    from loam.operators import abbreviations

    texts = spark.range(2000).selectExpr("id", "'It is in Fig. 2 by J. Brand#12. STANDARD ends it' AS text")
    counts = abbreviations.counted(texts)
    known = abbreviations.abbreviations(counts)
    assert "brand#12" in {r["word"] for r in known.collect()}
    found = abbreviations.sentences(texts.where("id = 7"), ["id"], known)
    assert [r["content"] for r in found.orderBy("sent_idx").collect()] == ["It is in Fig. 2 by J. Brand#12.", "STANDARD ends it"]


def test_other_columns_pass_by_python_as_they_came(spark):
    from loam.operators import completer

    rows = spark.range(600, numPartitions=1).selectExpr("id", "array(id, null) AS ids", "map('k', id) AS m", "array(named_struct('role', 'user', 'content', concat('Quotes:\nq', id, '\nPhrases: p'))) AS messages")
    done = completer.completed(rows, completer.FirstQuote(), report=True)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    found = {r["id"]: r for r in done.collect()}
    assert len(found) == 600 and all(r["ids"] == [k, None] and r["m"] == {"k": k} and r["attempts"] == 1 and r["error"] is None and f"q{k}" in r["reply"] for k, r in found.items())


def test_sums_are_not_worked_out_where_no_key_is_long(spark, monkeypatch):
    """Only the list of long keys is stored, which is empty."""
    names, stored = [], ordinals.stored
    monkeypatch.setattr(ordinals, "stored", lambda df, name: names.append(name) or stored(df, name))
    rows = spark.range(50).select((F.col("id") % 5).alias("k"), F.floor(F.col("id") / 5).alias("at"))
    assert ordinals.starts(rows, ["k"], "at", {"n": F.col("at")}, 16) is None
    assert names == ["long"]
