"""A post through all steps."""

from loam.operators import completer, knowledge, linking
from loam.plans.extraction import extract


def test_post_to_knowledge(spark):
    html = (
        "<p>Call df.groupby() on the DataFrame. Nothing here.</p><pre><code>import pandas as pd\ndf = pd.read_csv('x')</code></pre>"
        "<p>In plt plt.plto() draws a line.</p><p>Use pandas.DataFrame.sum() too.</p>"
    )
    posts = spark.createDataFrame([(1, html), (2, "<p>no mention</p>"), (3, None)], "post_id long, html string")
    names = linking.gazetteer(spark.createDataFrame([("pandas.DataFrame.groupby",), ("pandas.DataFrame.sum",), ("matplotlib.plt.plot",), ("os.path",)], "fqn string"))
    rows = extract(posts, names).orderBy("snippet_idx", "api").collect()
    assert [(r.post_id, r.snippet_idx, r.api) for r in rows] == [
        (1, 0, "pandas.DataFrame.groupby"),
        (1, 3, "matplotlib.plt.plot"),
        (1, 4, "pandas.DataFrame.sum"),
    ]
    assert rows[0].snippet == "Call pandas.DataFrame.groupby on the DataFrame."
    stored = knowledge.storable(extract(posts, names))
    assert knowledge.by_api(stored, "matplotlib.plt.plot").first().knowledge.startswith("In plt matplotlib.plt.plot draws")


def test_switches_aliases_and_completers(spark):
    html = "<p>Call it.load() on those frames. Use fs.lod() too.</p><pre><code>it = make()</code></pre>"
    posts = spark.createDataFrame([(1, html)], "post_id long, html string")
    names = linking.gazetteer(spark.createDataFrame([("files.store.load",), ("files.store.loud",), ("make.load",)], "fqn string"))
    best = spark.createDataFrame([("fs", "files.store")], "alias string, fqn string")
    api = lambda **switches: [r.api for r in extract(posts, names, best=best, **switches).orderBy("snippet_idx").collect()]
    assert api(typo=False) == ["make.load", "files.store.lod"]
    assert api(alias=False, typo=False) == ["it.load", "fs.lod"]
    close = spark.createDataFrame([("loud", "lod", 1.0), ("load", "lod", 0.0)], "a string, b string, sim double")
    assert api(rank=False, similarities=close) == ["make.load", "files.store.loud"]
    rows = extract(posts, names, best=best, linker=completer.FirstCandidate(), explainer=completer.FirstQuote()).orderBy("snippet_idx").collect()
    assert rows[0].snippet.startswith("Call make.load on those frames.\n'those frames' refers to Call it.load() on those frames.")
