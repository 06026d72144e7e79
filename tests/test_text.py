"""Expressions, similarity and tokens against values worked out by hand."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loam.functions import similarity, text, tokenizer


def value(spark, column, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given_", "wanted"), [("a(b(c)d)e(f", "ade"), ("", ""), (None, None), ("x)y", "xy"), ("f()\n(g", "f\n"), ("émoji 😀(x)", "émoji 😀")]
)
def test_parentheses(spark, given_, wanted):
    assert value(spark, text.without_parentheses(F.col("t")), t=given_) == wanted


@pytest.mark.parametrize(
    ("given_", "wanted"), [("df['a'].sum(axis=1)", "df['a'].sum"), (".ix[0]", ".ix"), ("np.array", "np.array"), ("f(a.b)[0]", "f"), ("", ""), (None, None)]
)
def test_mentions(spark, given_, wanted):
    assert value(spark, text.normalised_mention(F.col("t")), t=given_) == wanted


def test_between_tells_empty_from_missing(spark):
    assert value(spark, text.between(F.col("t"), "ID:", "Post:"), t="ID: 7 Post: x Post:") == "7"
    assert value(spark, text.between(F.col("t"), "ID:", "Post:"), t="ID:Post:") == ""
    assert value(spark, text.between(F.col("t"), "ID:", "Post:"), t="no marks") is None


def test_red_mentions_are_replaced_in_order(spark):
    html = 'a <span style="color:red">x</span> b <span style="color:red">y</span>'
    got = value(spark, text.replace_red(F.col("t"), F.array(F.lit("new"))), t=html)
    assert got == html.replace(">x<", ">new<")
    red = lambda *x: " and ".join(f"{text.RED_OPEN}{y}</span>" for y in x)
    for old, names, new in [(["a"], ["$1\\"], ["$1\\"]), (["a"], [None], ["a"]), (["a"], [], ["a"]), (["a", "b", "c"], [None, "$0"], ["a", "$0", "c"]), (["a"], ["x", "y"], ["x"])]:
        given = F.array(*map(F.lit, names)).cast("array<string>")
        assert value(spark, text.replace_red(F.col("t"), given), t=red(*old)) == red(*new)
    assert value(spark, text.replace_red(F.col("t"), F.array(F.lit("new"))), t="plain") == "plain"


def test_snippet_terms_and_names(spark):
    assert value(spark, text.snippet_terms(F.col("t")), t="a 1 2.5 2024-01-02 b a") == ["a", "b"]
    assert value(spark, text.plain_names(F.split("t", " ")), t="a_1 12 x-y Z") == ["a_1", "Z"]


def test_code_words(spark):
    assert value(spark, text.looks_like_code(F.col("t")), t="return x") is True
    assert value(spark, text.looks_like_code(F.col("t")), t="a = b") is False
    assert value(spark, text.looks_like_code(F.col("t")), t="a=b") is True


@pytest.mark.parametrize(("a", "b", "wanted"), [("a", "a", 0.0), ("xarray", "yarray", 14 / 15), ("abcd", "axyz", 0.55), ("", "", 0.0), ("é", "éa", None), (None, "a", None)])
def test_jaro_winkler(a, b, wanted):
    got = similarity.jaro_winkler(a, b)
    assert got == pytest.approx(wanted) if wanted is not None else got is None or 0 <= got <= 1


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_stays_in_range(a, b):
    assert 0 <= similarity.jaro_winkler(a, b) <= 1 + 1e-9


def test_similarities_of_empty_strings(spark):
    assert value(spark, similarity.levenshtein_similarity(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert value(spark, similarity.character_jaccard(F.col("a"), F.col("b")), a="", b="") == 1.0
    assert value(spark, similarity.character_jaccard(F.col("a"), F.col("b")), a="ab", b="bc") == pytest.approx(1 / 3)
    assert value(spark, similarity.character_jaccard(F.col("a"), F.col("b")), a=None, b="bc") is None


def words(t):
    return [x["token"] for x in tokenizer.tokens(t)]


def test_tokens_keep_calls_urls_and_faces():
    assert words("Use np.array() and df.sum, please :)") == ["Use", "np.array()", "and", "df.sum", ",", "please", ":)"]
    assert "http://a.com/x" in words("see http://a.com/x now")
    assert words("a &lt;= b") == ["a", "<=", "b"]
    assert words("(hello)") == ["(", "hello", ")"]
    assert tokenizer.tokens(None) == [] and tokenizer.tokens("  ") == []


@given(st.text(alphabet="ab.()'\" :/<>&;,-1é😀\n", max_size=40))
def test_tokens_lie_in_the_cleaned_text(t):
    cleaned = tokenizer.clean(t)
    for token in tokenizer.tokens(t):
        assert 0 <= token["start"] <= token["end"]
        assert token["token"] in cleaned or not token["token"].strip()


def test_sentences_do_not_end_at_learned_abbreviations(spark):
    from loam.operators import abbreviations

    corpus = ["Use e.g. this one. Then go.", "It is v. 2 now. Go on.", "See Fig. 3 here. It works.", "A thing (Fig. 4) fits. Now stop."] * 12 + ["We go and they go on and it is this that they see here and now when it fits or works as one thing and so they stop it. "] * 40
    texts = spark.createDataFrame([(k, t) for k, t in enumerate([*corpus, None, "", "..."])], "k int, text string")
    known = abbreviations.abbreviations(abbreviations.counted(texts))
    words = {r.word for r in known.collect()}
    assert {"e.g", "v", "fig"} <= words and not words & {"go", "this", "now", "it"}
    rows = [(1, "Use e.g. this. See Fig. 3 of v. 2. J. Doe wrote it! Why? then so. it goes on."), (2, None), (3, ""), (4, "One"), (5, "  A bee.  \n Cee dee. "), (6, "x. " * 2000)]
    asked = spark.createDataFrame(rows, "k int, text string")
    got = {}
    for r in abbreviations.sentences(asked, ["k"], known).orderBy("k", "sent_idx").collect():
        got.setdefault(r.k, []).append(r.content.strip())
    assert got[1] == ["Use e.g. this.", "See Fig. 3 of v. 2.", "J. Doe wrote it!", "Why?", "then so. it goes on."]
    assert got[4] == ["One"] and got[5] == ["A bee.", "Cee dee."] and 2 not in got and 3 not in got
    assert len(got[6]) == 1
    assert abbreviations.abbreviations(abbreviations.counted(texts.limit(0))).count() == 0
