"""Registered queries over the given tables, and their SQL.

Names and code that the tables lack are derived from their rows by Spark: qualified names
from parts, code and replies from part names, spans from events, snippets from line items.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import similarity, text, tokenizer
from loam.operators import abbreviations, aliases, code, completer, entities, knowledge, lexicon, linking, metrics, replies, segments, sequence, spans, tagging
from loam.plans import extraction, views
from loam.sources import tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

NAME_SQL = "lower(p_type) || '.' || replace(p_name, ' ', '.')"
WORD_SQL = "regexp_split_to_array(trim(regexp_replace(text, '[ \\t\\n\\x0b\\x0c\\r]+', ' ', 'g')), ' ')"


def query(sql: str | None = None):
    """Registers a function of (spark, folder) under its name, with SQL if there is any."""

    def add(function: Callable) -> Callable:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def read(spark, folder: str, table: str) -> DataFrame:
    return tables.read_table(spark, folder, table)


# Segments and text


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)(<p>.*?</p>|<pre><code>.*?</code></pre>)', 1) AS b FROM pages),
u AS (SELECT page_id, unnest(b) AS block, (generate_subscripts(b, 1) - 1)::INT AS seg_idx FROM p)
SELECT page_id, seg_idx, 'Text' AS kind, regexp_replace(regexp_extract(block, '(?s)^<p>(.*)</p>$', 1), '^\s+|\s+$', '', 'g') AS content
FROM u WHERE regexp_replace(regexp_extract(block, '(?s)^<p>(.*)</p>$', 1), '^\s+|\s+$', '', 'g') <> ''""")
def t1_paragraphs(spark, folder):
    return segments.segments(read(spark, folder, "pages"), "page_id", "html")


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)(<p>.*?</p>|<pre><code>.*?</code></pre>)', 1) AS b FROM pages),
u AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) AS seg FROM p),
c AS (SELECT page_id, seg, regexp_replace(regexp_extract(block, '(?s)^<p>(.*)</p>$', 1), '^\s+|\s+$', '', 'g') AS content FROM u),
s AS (SELECT page_id, seg, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS parts FROM c WHERE content <> ''),
e AS (SELECT page_id, seg, unnest(parts) AS content, generate_subscripts(parts, 1) AS part FROM s)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY seg, part) - 1)::INT AS sent_idx, 'Text' AS kind, content
FROM e WHERE trim(content) <> ''""")
def t3_sentences(spark, folder):
    found = segments.segments(read(spark, folder, "pages"), "page_id", "html")
    return segments.sentences(found, "page_id")


_NOTES = "'See e.g. ' || p_name || ' in Fig. ' || p_size || ' of it. It is v. ' || p_size || ' by J. ' || p_brand || '. ' || p_type || ' ends here. the rest!'"
_TYPES = r"""
n AS (SELECT p_partkey AS k, {notes} AS text FROM part),
w AS (SELECT lower(regexp_replace(unnest(regexp_split_to_array(text, '\s+')), '^[\"''(\[{{<]+|[\"'')\]}}>,;:!?]+$', '', 'g')) AS w FROM (SELECT text FROM n UNION ALL SELECT text FROM benchmark)),
c AS (SELECT CASE WHEN suffix(w, '.') THEN left(w, length(w) - 1) ELSE w END AS word, count(*) FILTER (suffix(w, '.')) AS a, count(*) FILTER (NOT suffix(w, '.')) AS b
      FROM w WHERE regexp_matches(w, '\p{{L}}') GROUP BY 1),
p AS (SELECT sum(a)::DOUBLE / sum(a + b) AS p FROM c),
s AS (SELECT word, a AS with_period, b AS without, length(word) - length(replace(word, '.', '')) AS inner_, length(replace(word, '.', '')) AS letters,
             -2 * (a * ln(p / 0.99) + b * ln((1 - p) / 0.01)) AS ratio FROM c, p WHERE a > 0),
k AS (SELECT word, with_period, without, round(ratio * exp(-letters) * (inner_ + 1) * pow(letters::DOUBLE, -without), 9) AS score FROM s
      WHERE round(ratio * exp(-letters) * (inner_ + 1) * pow(letters::DOUBLE, -without), 9) >= 0.3)"""


def _notes(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    """(notes about parts, counts of the words of these and of the benchmark's texts)."""
    size = F.col("p_size").cast("string")
    text_ = F.concat(
        F.lit("See e.g. "), "p_name", F.lit(" in Fig. "), size, F.lit(" of it. It is v. "), size, F.lit(" by J. "), "p_brand", F.lit(". "), "p_type", F.lit(" ends here. the rest!")
    )
    notes = read(spark, folder, "part").select("p_partkey", text_.alias("text"))
    return notes, abbreviations.counted(notes.select("text").unionByName(read(spark, folder, "benchmark").select("text")))


@query("WITH " + _TYPES.format(notes=_NOTES) + " SELECT word, with_period, without, round(score, 6) AS score FROM k")
def t2_abbreviations(spark, folder):
    """Words that the texts show to be abbreviations, with their counts."""
    _, counts = _notes(spark, folder)
    return abbreviations.abbreviations(counts).join(counts, "word").select("word", "with_period", "without", F.round("score", 6).alias("score"))


@query("""
SELECT p_partkey, unnest([0, 1, 2]) AS sent_idx, unnest(['See e.g. ' || p_name || ' in Fig. ' || p_size || ' of it.', 'It is v. ' || p_size || ' by J. ' || p_brand || '.', p_type || ' ends here. the rest!']) AS content FROM part""")
def t2_sentence_ends(spark, folder):
    """Sentences that do not end at learned abbreviations, initials, or before lower case."""
    notes, counts = _notes(spark, folder)
    return abbreviations.sentences(notes, ["p_partkey"], abbreviations.abbreviations(counts))


@query()
def t11_tokens(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", F.explode(tokenizer.tokenized("text")).alias("t"))
    return turns.select("conv_id", "turn", "t.*")


@query("""
SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), ',', 'np.' || lower(split_part(p_type, ' ', 1)) || '()', '<=', p_size || '.5', 'and', '(', 'more', ')', ':)', 'http://x.com/' || p_partkey, '!'] AS tokens
FROM part""")
def t11_part_tokens(spark, folder):
    """Tokens of a text about each part: words, a call, an entity, a number, edges, a face, a URL."""
    text_ = F.concat(
        F.col("p_name"), F.lit(", np."), F.lower(F.substring_index("p_type", " ", 1)), F.lit("() &lt;= "), F.col("p_size").cast("string"), F.lit(".5  and (more) :) http://x.com/"), F.col("p_partkey").cast("string"), F.lit(" !"),
    )
    return views.dealt_parts(spark, folder).select("p_partkey", F.transform(tokenizer.tokenized(text_), lambda t: t["token"]).alias("tokens"))


@query("""
WITH t AS (SELECT p_partkey, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2), ',', 'é漢', 'np.' || lower(p_type) || '()', '<', p_size::VARCHAR, '.'] AS tokens, [0, 1, 0, 1, 1, 1, 1, 1] AS gaps FROM part),
u AS (SELECT p_partkey, unnest(tokens) AS token, unnest(gaps) AS gap, generate_subscripts(tokens, 1) - 1 AS pos FROM t),
e AS (SELECT *, sum(gap + length(token)) OVER (PARTITION BY p_partkey ORDER BY pos) AS "end" FROM u)
SELECT p_partkey, pos::INT AS pos, token, ("end" - length(token))::INT AS start, "end"::INT AS "end" FROM e""")
def t12_places(spark, folder):
    """Places of tokens in the cleaned text: white space and entities shrink, letters beyond ASCII count once."""
    text_ = F.concat("p_name", F.lit(",  é漢\n np."), F.lower("p_type"), F.lit("() &lt; "), F.col("p_size").cast("string"), F.lit(" ."))
    return views.dealt_parts(spark, folder).select("p_partkey", F.explode(tokenizer.tokenized(text_)).alias("t")).select("p_partkey", "t.*")


@query(r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed FROM documents""")
def t13_squeeze(spark, folder):
    return read(spark, folder, "documents").select("doc_id", F.md5(text.squeeze(F.col("text"))).alias("squeezed"))


@query(r"""
SELECT doc_id, md5(replace(regexp_replace(replace(replace(text, '. ', '('), ', ', ')'), '\([^)]*(\)|\z)', '', 'g'), ')', '')) AS outside
FROM documents""")
def t10_parentheses(spark, folder):
    marked = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit("(")), F.lit(", "), F.lit(")"))
    return read(spark, folder, "documents").select("doc_id", F.md5(text.without_parentheses(marked)).alias("outside"))


@query(r"""
SELECT conv_id, turn, list_aggregate(list_filter(string_split(replace('Text: ' || text, '. ', chr(10) || 'Code: '), chr(10)),
       lambda line: NOT starts_with(line, 'Code:')), 'string_agg', chr(10)) AS kept
FROM (SELECT conv_id, turn, replace(text, chr(10), ' ') AS text FROM conversations)""")
def t8_code_lines(spark, folder):
    line = F.replace(F.concat(F.lit("Text: "), F.replace(F.col("text"), F.lit("\n"), F.lit(" "))), F.lit(". "), F.lit("\nCode: "))
    return read(spark, folder, "conversations").select("conv_id", "turn", segments.without_code_lines(line).alias("kept"))


@query("""
SELECT p_partkey, p_name AS prose, '<pre><code>' || chr(10) || p_type || '(' || p_size || ')' || chr(10) || '</code></pre>' AS code
FROM part""")
def t7_code_tags(spark, folder):
    post = F.concat(F.lit("Text: "), "p_name", F.lit(" Code: "), "p_type", F.lit("("), F.col("p_size").cast("string"), F.lit(")"))
    lines = F.split(segments.with_code_tags(post), "\n", 2)
    return read(spark, folder, "part").select("p_partkey", lines[0].alias("prose"), lines[1].alias("code"))


@query("""
SELECT p_partkey, p_name || ' of ' || p_brand AS plain, p_name AS first_red, [p_name] AS red, [p_brand] AS blue,
       '<strong><span style="color:red">' || p_type || '</span></strong> of <strong><span style="color:blue">' || p_brand || '</span></strong>' AS replaced
FROM part""")
def t17_highlights(spark, folder):
    coloured = lambda c, opening: F.concat(F.lit("<strong>" + opening), c, F.lit("</span></strong>"))
    parts = read(spark, folder, "part").withColumn("html", F.concat(coloured("p_name", text.RED_OPEN), F.lit(" of "), coloured("p_brand", text.BLUE_OPEN)))
    html = F.col("html")
    return parts.select(
        "p_partkey",
        text.without_highlights(html).alias("plain"),
        text.first_red(html).alias("first_red"),
        text.red_mentions(html).alias("red"),
        text.blue_mentions(html).alias("blue"),
        text.replace_red(html, F.array("p_type")).alias("replaced"),
    )


@query(r"""
SELECT conv_id, turn, CASE WHEN h AND s THEN 'BOTH_HS' WHEN h THEN 'HAPPY' WHEN s THEN 'SAD' ELSE 'NA' END AS mood
FROM (SELECT conv_id, turn, regexp_matches(t, '\^_\^|[:=8](o|O|-)?[D)\]]') AS h, regexp_matches(t, '[:=8](o|O|-)?[(\[]') AS s
      FROM (SELECT conv_id, turn, replace(replace(text, '. ', ':) '), ', ', ' :-( ') AS t FROM conversations))""")
def t16_emoticons(spark, folder):
    faces = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(":) ")), F.lit(", "), F.lit(" :-( "))
    return read(spark, folder, "conversations").select("conv_id", "turn", text.emoticon_class(faces).alias("mood"))


@query(r"""
SELECT doc_id, regexp_matches(text, '\b(def|class|for|while|if|elif|else|try|except|finally|with|as|import|from|return|yield|lambda|and|or|not|is|in|pass|break|continue|global|nonlocal|assert|raise|del|print|input)\b') AS code_like
FROM (SELECT doc_id, regexp_replace(text, '[^a-zA-Z ]', ' ', 'g') AS text FROM documents)""")
def c10_code_words(spark, folder):
    plain = F.regexp_replace("text", "[^a-zA-Z ]", " ")
    return read(spark, folder, "documents").select("doc_id", text.looks_like_code(plain).alias("code_like"))


@query(r"""
SELECT event_id, list_sort(list_filter(list_distinct(string_split(event_type || ' ' || value::VARCHAR || ' 2024-01-02 ' || event_type || ' ' || event_id::VARCHAR || ' ' || props, ' ')),
       lambda t: NOT regexp_full_match(t, '\d+(\.\d+)?|\d{4}-\d{2}-\d{2}'))) AS terms,
       list_filter([event_type, event_id::VARCHAR, props], lambda n: regexp_full_match(n, '[a-zA-Z0-9_]+') AND NOT regexp_full_match(n, '\d+')) AS names
FROM events""")
def c11_snippet_terms(spark, folder):
    snippet = F.concat_ws(" ", "event_type", F.col("value").cast("string"), F.lit("2024-01-02"), "event_type", F.col("event_id").cast("string"), "props")
    return read(spark, folder, "events").select(
        "event_id",
        F.array_sort(text.snippet_terms(snippet)).alias("terms"),
        text.plain_names(F.array("event_type", F.col("event_id").cast("string"), "props")).alias("names"),
    )


@query(r"""
SELECT conv_id, turn, list_has_any(string_split(lower(text), ' '), ['he','she','it','they','him','her','them','this','that','these','those','my','your','his','its','our','their','mine','yours','what','such','above','below']) AS depends
FROM conversations""")
def e1_demonstrative(spark, folder):
    return read(spark, folder, "conversations").select("conv_id", "turn", text.has_demonstrative(F.split("text", " ")).alias("depends"))


# Similarity


@query("""
SELECT p_partkey, round(1 - levenshtein(p_name, lower(p_type) || ' ' || p_brand)::DOUBLE / greatest(length(p_name), length(lower(p_type) || ' ' || p_brand)), 9) AS levenshtein,
       round(jaccard(p_name, lower(p_type) || ' ' || p_brand), 9) AS jaccard
FROM part""")
def m2_m3_similarity(spark, folder):
    other = F.concat_ws(" ", F.lower("p_type"), "p_brand")
    return read(spark, folder, "part").select(
        "p_partkey",
        F.round(similarity.levenshtein_similarity(F.col("p_name"), other), 9).alias("levenshtein"),
        F.round(similarity.character_jaccard(F.col("p_name"), other), 9).alias("jaccard"),
    )


@query("""
WITH d AS (SELECT DISTINCT p_name AS a, lower(p_type) || ' ' || p_brand AS b FROM part),
m AS (SELECT a, b, jaro_similarity(a, b) AS j,
             len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1))) AS same FROM d)
SELECT a, b, round(j + CASE WHEN j > 0 THEN 0.1 * least(4, same) * (1 - j) ELSE 0 END, 9) AS similarity FROM m""")
def m1_jaro_winkler(spark, folder):
    pairs = read(spark, folder, "part").select(F.col("p_name").alias("a"), F.concat_ws(" ", F.lower("p_type"), "p_brand").alias("b")).distinct()
    return pairs.select("a", "b", F.round(similarity.jaro_winkler_similarity("a", "b"), 9).alias("similarity"))


# Linking


@query(f"""
WITH g AS (SELECT DISTINCT {NAME_SQL} AS fqn FROM part WHERE p_size <= 25)
SELECT p_partkey, {NAME_SQL} AS mention, ({NAME_SQL}) IN (SELECT fqn FROM g) AS exact FROM part""")
def j1_exact_link(spark, folder):
    parts = views.named_parts(spark, folder)
    names = linking.gazetteer(parts.where("p_size <= 25"))
    hit, missed = linking.exact(parts.select("p_partkey", F.col("fqn").alias("mention")), names)
    return hit.withColumn("exact", F.lit(True)).unionByName(missed.withColumn("exact", F.lit(False)))


_SAME = "len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)))"
_JW = "(jaro_similarity({a}, {b}) + CASE WHEN jaro_similarity({a}, {b}) > 0 THEN 0.1 * least(4, " + _SAME + ") * (1 - jaro_similarity({a}, {b})) ELSE 0 END)"


_TOPK_SQL = f"""
WITH g AS (SELECT DISTINCT {NAME_SQL} AS fqn FROM part),
m AS (SELECT DISTINCT replace(replace(p_name, 'i', 'e'), ' ', '.') AS mention FROM part),
p AS (SELECT mention, fqn, split_part(mention, '.', 1) AS a1, split_part(mention, '.', 2) AS a2, split_part(fqn, '.', 2) AS b1, split_part(fqn, '.', 3) AS b2 FROM m, g),
s AS (SELECT mention, fqn, round(({_JW.format(a="a1", b="b1")} + {_JW.format(a="a2", b="b2")}) / 2, 12) AS score FROM p),
r AS (SELECT mention, fqn, round(score, 9) AS score, dense_rank() OVER (PARTITION BY mention ORDER BY score DESC) AS rank FROM s)
SELECT mention, fqn, score, rank::INT AS rank FROM r WHERE rank <= 20"""


@query(_TOPK_SQL)
def j2_topk_distinct(spark, folder):
    parts = views.named_parts(spark, folder)
    mentions = parts.select(F.translate(F.replace(F.col("p_name"), F.lit("i"), F.lit("e")), " ", ".").alias("mention"))
    return linking.fuzzy(mentions, linking.gazetteer(parts)).withColumn("score", F.round("score", 9))


@query(_TOPK_SQL)
def j2_by_posting_lists(spark, folder):
    """The same by posting lists, as large tables take it."""
    parts = views.named_parts(spark, folder)
    mentions = parts.select(F.translate(F.replace(F.col("p_name"), F.lit("i"), F.lit("e")), " ", ".").alias("mention"))
    return linking.fuzzy(mentions, linking.gazetteer(parts), direct=0).withColumn("score", F.round("score", 9))


@query(f"""
WITH g AS (SELECT DISTINCT {NAME_SQL} AS fqn FROM part), m AS (SELECT DISTINCT 'x.' || split_part(p_name, ' ', 2) AS mention FROM part)
SELECT mention, fqn FROM m, g WHERE lower(substr(split_part(mention, '.', 2), 1, 2)) = lower(substr(split_part(fqn, '.', 3), 1, 2))""")
def j4_same_block(spark, folder):
    parts = views.named_parts(spark, folder)
    mentions = parts.select(F.concat(F.lit("x."), F.substring_index("p_name", " ", -1)).alias("mention")).distinct()
    return linking.same_block(mentions, linking.gazetteer(parts))


@query(f"SELECT DISTINCT unnest(string_split({NAME_SQL}, '.')) AS term FROM part")
def j5_terms(spark, folder):
    return linking.terms(linking.gazetteer(views.named_parts(spark, folder)))


@query(f"""
WITH w AS (SELECT conv_id, turn, {WORD_SQL} AS w FROM conversations),
t AS (SELECT conv_id, turn, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM w),
p AS (SELECT a.conv_id, a.turn, replace(a.token, '.', '') || '.' || replace(b.token, '.', '') AS fqn, min(a.pos)::INT AS cand_ord,
             list_distinct(string_split(replace(a.token, '.', '') || '.' || replace(b.token, '.', ''), '.')) AS parts
      FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = b.turn AND b.pos = a.pos + 1 GROUP BY ALL),
e AS (SELECT conv_id, turn, pos, unnest(string_split(token, '.')) AS entry FROM t),
s AS (SELECT c.conv_id, c.turn, c.cand_ord, sum(1.0 / e.pos) AS score
      FROM (SELECT conv_id, turn, cand_ord, unnest(parts) AS entry FROM p) c JOIN e ON c.conv_id = e.conv_id AND c.turn = e.turn AND c.entry = e.entry
      WHERE e.pos <> 0 GROUP BY ALL)
SELECT p.conv_id, p.turn, p.cand_ord, p.fqn, round(coalesce(s.score, 0), 6) AS score
FROM p LEFT JOIN s ON p.conv_id = s.conv_id AND p.turn = s.turn AND p.cand_ord = s.cand_ord""")
def r1_proximity(spark, folder):
    """A turn's first token against all pairs of neighbouring tokens as candidates."""
    turn = ["conv_id", "turn"]
    tokens = views.turn_tokens(spark, folder)
    plain = F.translate("token", ".", "")
    after = F.lead(plain).over(Window.partitionBy(*turn).orderBy("pos"))
    pairs = tokens.select(*turn, "pos", F.concat(plain, F.lit("."), after).alias("fqn")).where("fqn IS NOT NULL")
    cands = pairs.groupBy(*turn, "fqn").agg(F.min("pos").alias("cand_ord")).withColumn("mention_idx", F.lit(0))
    mentions = tokens.where("pos = 0").select(*turn, F.lit(0).alias("mention_idx"), "pos")
    ranked = linking.nearness(tokens, mentions, cands, turn)
    return ranked.select(*turn, "cand_ord", "fqn", F.round("score", 6).alias("score"))


@query(f"""
WITH x AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS c3, split_part(p_name, ' ', 1) AS c2, lower(p_type) AS c1 FROM part),
q AS (SELECT DISTINCT c2 || '.zz.' || c3 AS mention, c2, c3 FROM x)
SELECT mention, c2 || '.' || c3 AS constraint FROM q""")
def r2_suffix(spark, folder):
    parts = views.named_parts(spark, folder)
    mention = F.replace(F.col("p_name"), F.lit(" "), F.lit(".zz."))
    return linking.longest_suffix(parts.select(mention.alias("mention")), linking.gazetteer(parts))


# Aliases and code


@query("""
SELECT p_partkey, replace(p_name, ' ', '.') || '.sum' AS called, replace(p_name, ' ', '.') AS subscript FROM part""")
def a1_mentions(spark, folder):
    dotted = F.translate("p_name", " ", ".")
    called = F.concat(dotted, F.lit(".sum(axis="), F.col("p_size").cast("string"), F.lit(").x"))
    subscript = F.concat(dotted, F.lit("['"), "p_type", F.lit("']"))
    return read(spark, folder, "part").select("p_partkey", text.normalised_mention(called).alias("called"), text.normalised_mention(subscript).alias("subscript"))


@query("""
SELECT p_partkey, 'm' || p_partkey AS alias, lower(p_type) || '.core' AS module, 0 AS ord FROM part
UNION ALL
SELECT p_partkey, split_part(p_name, ' ', 2), lower(p_type) || '.' || split_part(p_name, ' ', 1) || '.' || split_part(p_name, ' ', 2), 1 FROM part""")
def c1_imports(spark, folder):
    return code.import_rows(views.part_code(spark, folder), "p_partkey")


@query("""
SELECT p_partkey, 'x' AS variable, 'm' || p_partkey || '.load' AS source, 0 AS index, 0 AS ord FROM part
UNION ALL SELECT p_partkey, 'y', split_part(p_name, ' ', 2), 0, 1 FROM part
UNION ALL SELECT p_partkey, 'z', split_part(p_name, ' ', 2), 1, 2 FROM part""")
def c4_assignments(spark, folder):
    return code.assign_rows(views.part_code(spark, folder), "p_partkey")


@query("""
WITH w AS (SELECT p_partkey, p_partkey::VARCHAR AS k, lower(p_type) || '.core' AS m, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)
SELECT p_partkey, unnest(['import', 'import', 'import', 'assign', 'assign', 'assign', 'parameter', 'parameter']) AS kind,
       unnest([a, 's' || k, 'late' || k, 'y', 'z', 'w', 'q', 'r']) AS name,
       unnest([m || '.' || a, m || '.' || b, 'late' || k, b, 'q.go', 'v' || k || '.get', '', '']) AS source FROM w""")
def c1_c4_c6_broken_code(spark, folder):
    """Imports, assignments and parameters of code that does not parse: one of four kinds of
    broken line, a call, an import and a definition over several lines, older syntax, prose,
    and a block whose header is lost."""
    found = code.read(views.broken_code(spark, folder), "p_partkey", names=True)
    row = lambda kind, name, source: F.struct(F.lit(kind).alias("kind"), name.alias("name"), source.alias("source"))
    rows = F.concat(
        F.transform("code.imports", lambda x: row("import", x["alias"], x["module"])),
        F.transform("code.assigns", lambda x: row("assign", x["variable"], x["source"])),
        F.transform(F.get("code.names", F.lit(0))["parameters"], lambda x: row("parameter", x, F.lit(""))),
    )
    return found.select("p_partkey", F.explode(rows).alias("r")).select("p_partkey", "r.*")


@query("""
WITH w AS (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, 'v' || p_partkey AS v FROM part)
SELECT p_partkey, list_sort(list_distinct([v, a || '_t', 'helper', 'q', 'items', 'total', b])) AS identifiers, list_sort([v, a || '_t', 'total']) AS assigned,
       ['q'] AS parameters, [v || 'i', v || 'j'] AS loop_targets FROM w""")
def c13_names(spark, folder):
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    own = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    block = F.concat(
        own, F.lit(" = len("), second, F.lit(")\n"), first, F.lit("_t['x'] = "), own, F.lit("\ndef helper(q, r=1):\n  for "), own, F.lit("i, "), own, F.lit("j in items:\n    total = "), own, F.lit("i\n"),
    )
    posts = views.dealt_parts(spark, folder).select("p_partkey", code.names(block).alias("n"))
    sorted_ = lambda c: F.array_sort(F.array_distinct(f"n.{c}")).alias(c)
    return posts.select("p_partkey", sorted_("identifiers"), sorted_("assigned"), F.col("n.parameters").alias("parameters"), F.col("n.loop_targets").alias("loop_targets"))


@query("""
SELECT p_partkey, lower(p_type) || '.core.load.head' AS x, lower(p_type) || '.' || replace(p_name, ' ', '.') || '.tail' AS y, 'm' || p_partkey AS name,
       lower(p_type) || '.core' AS source FROM part""")
def a4_variables(spark, folder):
    chain = aliases.source_chain_of(code.read(views.part_code(spark, folder), "p_partkey"), "p_partkey")
    maps = chain.groupBy("p_partkey").agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("source", "index")))).alias("chain"))
    name = F.concat(F.lit("m"), F.col("p_partkey").cast("string"))
    return maps.select(
        "p_partkey",
        aliases.resolved(F.lit("x.head"), F.col("chain")).alias("x"),
        aliases.resolved(F.lit("y.tail"), F.col("chain")).alias("y"),
        name.alias("name"),
        F.try_element_at("chain", name)["source"].alias("source"),
    )


@query(f"""
WITH c AS (SELECT p_brand AS alias, {NAME_SQL} AS fqn, count(*) AS freq FROM part GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY freq DESC, fqn) AS k FROM c),
b AS (SELECT alias, fqn FROM o WHERE k = 1 AND freq >= 10)
SELECT p_partkey, coalesce(b.fqn, p_brand) || '.' || p_size AS mention FROM part LEFT JOIN b ON p_brand = b.alias""")
def a5_aliases(spark, folder):
    parts = views.named_parts(spark, folder)
    counted = parts.groupBy(F.col("p_brand").alias("alias"), "fqn").agg(F.count("*").alias("freq"))
    ordered = counted.withColumn("ord", F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("freq"), "fqn")))
    best = aliases.best_alias(ordered, linking.terms(linking.gazetteer(parts)))
    mentions = parts.select("p_partkey", F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("mention"))
    return aliases.with_aliases(mentions, best)


# Spans


@query("""
WITH s AS (SELECT DISTINCT user_id, floor(value)::INT AS a, floor(value)::INT + json_extract(props, '$.k')::INT AS b FROM events)
SELECT user_id, a AS start, b AS "end" FROM s x
WHERE NOT EXISTS (SELECT 1 FROM s y WHERE y.user_id = x.user_id AND y.a <= x.a AND x.b <= y.b AND (y.a <> x.a OR y.b <> x.b))""")
def p1_outermost(spark, folder):
    return spans.outermost_rows(views.event_spans(spark, folder), "user_id")


@query("""
WITH d AS (SELECT doc_id, text, (doc_id % 50)::INT AS k FROM documents)
SELECT doc_id, md5(substr(text, 1, k) || '</BEGIN>' || substr(text, k + 1, 5) || '<END/>' || substr(text, k + 6)) AS marked,
       md5(substr(text, 1, k) || '<strong><span style="color:red">' || substr(text, k + 1, 2) || '</span></strong>' || substr(text, k + 3, 3) || '<strong><span style="color:blue">'
           || substr(text, k + 6, 2) || '</span></strong>' || substr(text, k + 8)) AS coloured
FROM d""")
def p2_marked(spark, folder):
    docs = read(spark, folder, "documents").withColumn("k", (F.col("doc_id") % 50).cast("int"))
    span = lambda a, b, kind: F.struct((F.col("k") + a).alias("start"), (F.col("k") + b).alias("end"), F.lit(kind).alias("type"))
    return docs.select(
        "doc_id",
        F.md5(spans.marked(F.col("text"), F.array(span(1, 3, "x"), span(0, 5, "x"), span(0, 5, "x")))).alias("marked"),
        F.md5(spans.coloured(F.col("text"), F.array(span(5, 7, "CTX"), span(0, 2, "API")))).alias("coloured"),
    )


@query(f"""
WITH w AS (SELECT conv_id, turn, {WORD_SQL} AS w FROM conversations),
t AS (SELECT conv_id, turn, unnest(w) AS token, (generate_subscripts(w, 1) - 1)::INT AS pos FROM w),
o AS (SELECT *, (sum(length(token) + 1) OVER (PARTITION BY conv_id, turn ORDER BY pos) - 1)::INT AS e FROM t)
SELECT conv_id, turn, pos, token, e - length(token)::INT AS start, e AS "end" FROM o""")
def p6_offsets(spark, folder):
    return spans.token_places(views.turn_tokens(spark, folder), ["conv_id", "turn"])


# Replies


@query("""
SELECT p_partkey, CASE p_size % 5 WHEN 4 THEN NULL ELSE [p_type, p_name] END AS items FROM part""")
def l9_lists(spark, folder):
    pair = F.concat_ws(", ", "p_type", "p_name")
    form = F.col("p_size") % 5
    reply = (
        F.when(form == 0, F.concat(F.lit("```json\n[\""), "p_type", F.lit("\", \""), "p_name", F.lit("\"]\n```")))
        .when(form == 1, F.concat(F.lit("["), pair, F.lit("]")))
        .when(form == 2, F.concat(F.lit("1. "), "p_type", F.lit("\n2. "), "p_name"))
        .when(form == 3, F.concat(F.lit("\\[ \\text{['"), "p_type", F.lit("', '"), "p_name", F.lit("']} \\]")))
        .otherwise(F.col("p_type"))
    )
    return read(spark, folder, "part").select("p_partkey", replies.listed(reply)["items"].alias("items"))


@query("""SELECT p_partkey, p_name AS np, p_type AS value, [p_name, p_brand] AS chain FROM part""")
def l11_completions(spark, folder):
    parts = read(spark, folder, "part")
    pairs = F.concat(F.lit('Here: [{"NP": "'), "p_name", F.lit('", "Value": "'), "p_type", F.lit('"}] done'))
    chains = F.concat(F.lit('```json\n{"c1": ["'), "p_name", F.lit('", "'), "p_brand", F.lit('"]}\n```'))
    rows = parts.select("p_partkey", replies.completions(pairs).alias("c"), replies.chains(chains).alias("m"))
    return rows.select("p_partkey", F.col("c")[0]["NP"].alias("np"), F.col("c")[0]["Value"].alias("value"), F.col("m")["c1"].alias("chain"))


@query(f"""
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'count' WHEN 1 THEN 'none' WHEN 2 THEN 'unknown' WHEN 3 THEN 'suffix' ELSE 'pass' END AS verdict FROM part""")
def l12_verdicts(spark, folder):
    parts = views.named_parts(spark, folder)
    form, name = F.col("p_size") % 5, F.col("fqn")
    predicted = F.when(form == 0, F.array(name, name)).when(form == 1, F.array(F.lit("None"))).when(form == 2, F.array(F.lit("no.such.name"))).otherwise(F.array(name))
    constraint = F.when(form == 3, F.lit("elsewhere")).otherwise(F.substring_index(name, ".", -1))
    known = F.array(name)
    return parts.select("p_partkey", replies.verdict(predicted, F.array("p_name"), F.array(constraint), known).alias("verdict"))


@query(r"""
WITH g AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
o AS (SELECT conv_id, t, list_filter(range(3, len(t) + 1), lambda i: i % 2 = 1) AS others, list_filter(range(3, len(t) + 1), lambda i: i % 2 = 0) AS comments FROM g)
SELECT conv_id, md5('Question:' || chr(10) || t[1] || chr(10) || chr(10) || 'Answer:' || chr(10) || coalesce(t[2], '') || chr(10) || chr(10) || 'Other Answers:' || chr(10)
       || coalesce(list_aggregate(list_transform(others, lambda i: ((i - 1) // 2)::VARCHAR || '. ' || t[i]), 'string_agg', chr(10)), '') || chr(10) || chr(10) || 'Comments:' || chr(10)
       || coalesce(list_aggregate(list_transform(comments, lambda i: ((i - 2) // 2)::VARCHAR || '. ' || t[i]), 'string_agg', chr(10)), '')) AS context FROM o""")
def l7_context(spark, folder):
    """A conversation's first turns as question and answer, the others as answers and comments in turn."""
    turns = read(spark, folder, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    t = F.col("t")
    rest = F.slice(t, F.lit(3), F.greatest(F.size(t) - 2, F.lit(0)))
    others, comments = F.filter(rest, lambda x, k: k % 2 == 0), F.filter(rest, lambda x, k: k % 2 == 1)
    return turns.select("conv_id", F.md5(replies.context(F.get(t, F.lit(0)), F.get(t, F.lit(1)), others, comments)).alias("context"))


@query("""
WITH w AS (SELECT p_partkey, string_split(p_name || ' ' || p_type, ' ') AS w FROM part),
l AS (SELECT p_partkey, w, list_transform(w, lambda x: CASE WHEN length(x) % 2 = 0 THEN 1 ELSE 0 END) AS l FROM w)
SELECT p_partkey, [-100] || flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, 1 + length(w[i]) // 4), lambda k: l[i]))) || [-100] AS labels,
       [-100] || flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, 1 + length(w[i]) // 4), lambda k: CASE WHEN k = 0 THEN l[i] ELSE -100 END))) || [-100] AS first_labels,
       list_resize([-100] || flatten(list_transform(range(1, len(w) + 1), lambda i: list_transform(range(0, 1 + length(w[i]) // 4), lambda k: l[i]))) || [-100], 8, -100) AS padded
FROM l""")
def n1_piece_labels(spark, folder):
    """Words in pieces of four letters, with a special piece at each end."""
    parts = read(spark, folder, "part").withColumn("w", F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    pieces = F.flatten(F.transform("w", lambda x, k: F.array_repeat(k, F.floor(F.length(x) / 4).cast("int") + 1)))
    ends = F.array(F.lit(None).cast("int"))
    ids = F.concat(ends, pieces, ends)
    labels = F.transform("w", lambda x: F.when(F.length(x) % 2 == 0, 1).otherwise(0))
    of_all = tagging.piece_labels(ids, labels)
    return parts.select("p_partkey", of_all.alias("labels"), tagging.piece_labels(ids, labels, False).alias("first_labels"), tagging.padded(of_all, 8).alias("padded"))


# Sources and knowledge


@query(f"""
SELECT p_partkey::VARCHAR AS id, ' ' || p_name || ' uses ' || p_type || '. ' AS post, [p_type] AS api FROM part""")
def s2_annotated(spark, folder):
    rows = views.annotated_parts(spark, folder)
    return tables.annotated_posts(rows).select("id", "post", "api")


@query("""
SELECT a.conv_id, a.turn, q.text AS question FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND q.turn = 0 WHERE a.turn > 0""")
def s9_questions(spark, folder):
    turns = read(spark, folder, "conversations")
    place = F.struct("conv_id", "turn")
    posts = turns.select(
        place.alias("id"), F.struct("conv_id", F.lit(0).cast("long").alias("turn")).alias("parent_id"), F.col("role").alias("title"), F.col("text").alias("body"), F.lit("").alias("tags")
    )
    found = tables.questions_of(turns.where("turn > 0").select(place.alias("id")), posts)
    return found.select("id.conv_id", "id.turn", F.col("body").alias("question"))


@query("""
WITH q AS (SELECT conv_id, role, text FROM conversations WHERE turn = 0)
SELECT c.conv_id, c.turn, [coalesce(q.role, ''), 'p ' || c.turn || ' ' || length(c.text)] AS text_blocks, ['x = ' || c.turn] AS code_blocks
FROM conversations c JOIN q ON c.conv_id = q.conv_id""")
def s10_s11_threads(spark, folder):
    """Questions and answers from one table of posts, joined to threads and taken apart to
    blocks of text, of which the thread's title is the first, and code."""
    turns = read(spark, folder, "conversations")
    number = F.col("turn").cast("string")
    html = F.concat(F.lit("p "), number, F.lit(" "), F.length("text").cast("string"), F.lit("<pre><code>x = "), number, F.lit("</code></pre>"))
    place = lambda turn: F.struct(F.col("conv_id"), turn.cast("long").alias("turn"))
    first = F.col("turn") == 0
    posts = turns.select(place(F.col("turn")).alias("id"), F.when(~first, place(F.lit(0))).alias("parent_id"), F.when(first, 1).otherwise(2).alias("kind"), F.col("role").alias("title"), html.alias("body"), F.lit("t").alias("tags"))
    blocks = segments.thread_blocks(tables.threads(posts), "post_id", "html", "title")
    return blocks.select("post_id.conv_id", "post_id.turn", F.transform("text_blocks", lambda x: F.trim(x)).alias("text_blocks"), "code_blocks")


@query("""
SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1)::INT AS snippet_idx, 'part.' || l_partkey AS api,
       'Line part.' || l_partkey || ' of it' || chr(10) || '''it'' refers to order ' || l_orderkey AS snippet
FROM lineitem""")
def k2_organise(spark, folder):
    lines = views.numbered_lines(spark, folder)
    html = F.concat(F.lit("Line <strong>" + text.RED_OPEN), F.col("l_suppkey").cast("string"), F.lit("</span></strong> of <strong>" + text.BLUE_OPEN + "it</span></strong>"))
    snippets = lines.select("l_orderkey", F.col("k").alias("snippet_idx"), html.alias("html"))
    linked = lines.select("l_orderkey", F.col("k").alias("mention_idx"), F.concat(F.lit("part."), F.col("l_partkey").cast("string")).alias("fqn"))
    done = lines.select("l_orderkey", F.col("k").alias("completion_idx"), F.lit("it").alias("entity"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("context"))
    return knowledge.organise(snippets, linked, done, "l_orderkey")


@query("""
SELECT n_name AS api, s_name AS knowledge FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' ORDER BY 1, 2 LIMIT 5""")
def k3_by_api(spark, folder):
    return knowledge.by_api(views.supplier_knowledge(spark, folder).select("api", "knowledge"), " NATION_3 ")


@query("""
SELECT source AS api, text AS knowledge FROM documents WHERE text LIKE '%License%' ORDER BY 1 NULLS FIRST, 2 LIMIT 5""")
def k4_by_keyword(spark, folder):
    return knowledge.by_keyword(read(spark, folder, "documents").select(F.col("source").alias("api"), F.col("text").alias("knowledge")), "License")


@query("""
SELECT n_name AS api, s_name || ' in stock' AS knowledge FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 0""")
def s12_storable(spark, folder):
    rows = views.supplier_knowledge(spark, folder)
    snippet = F.when(F.col("s_acctbal") > 0, F.concat(F.lit(" <strong>"), "knowledge", F.lit("</strong> in stock "))).otherwise(" ")
    return knowledge.storable(rows.select("api", snippet.alias("snippet")))


@query(r"""
WITH w AS (SELECT conv_id, turn, string_split(lower(text), ' ') AS w FROM conversations)
SELECT conv_id, turn, len(list_filter(w, lambda x: x IN ('it', 'this'))) = 0 AS no_candidate,
       NOT list_contains(w, 'this') OR list_contains(w, 'it') AS kept FROM w""")
def e5_chain_filter(spark, folder):
    words = F.split(F.lower("text"), " ")
    rows = read(spark, folder, "conversations").select("conv_id", "turn", words.alias("w"))
    has = lambda x: F.array_contains("w", x)
    chain = F.create_map(F.lit("a"), F.when(has("this"), F.array(F.lit("this"), F.when(has("it"), "this").otherwise("that"))).otherwise(F.array(F.lit("x"))))
    return rows.select(
        "conv_id",
        "turn",
        (F.size(F.filter("w", lambda x: x.isin("it", "this"))) == 0).alias("no_candidate"),
        entities.kept_by_chains(F.lit("this"), chain, F.array(F.lit("this"), F.lit("it"))).alias("kept"),
    )


@query("""
SELECT p_partkey, t.start, t."end", t.entity AS text FROM part,
  LATERAL (SELECT unnest([
    {start: 0, "end": length('those ' || split_part(p_name, ' ', 1)), entity: 'those ' || split_part(p_name, ' ', 1)},
    {start: length('those ' || split_part(p_name, ' ', 1) || ' were fine; '), "end": length('those ' || split_part(p_name, ' ', 1) || ' were fine; v' || p_partkey || '[0]'), entity: 'v' || p_partkey || '[0]'}]) AS t)""")
def e2_candidates(spark, folder):
    """Chunks of sentences about parts: one with a demonstrative, one that is the post's own
    variable, one that is no candidate."""
    parts = views.dealt_parts(spark, folder)
    own = F.concat(F.lit("v"), F.col("p_partkey").cast("string"))
    sentence = F.concat(F.lit("those "), F.substring_index("p_name", " ", 1), F.lit(" were fine; "), own, F.lit("[0] is new to "), F.substring_index("p_name", " ", -1), F.lit("."))
    chunks = parts.select("p_partkey", F.lit(0).alias("sent_idx"), F.explode(entities.chunked(sentence)).alias("c")).select("p_partkey", "sent_idx", "c.*")
    # Assigned in the post are its variable and the name of the part, which is an API element.
    assigned = parts.select("p_partkey", F.explode(F.array(own, F.substring_index("p_name", " ", -1))).alias("name"))
    elements = linking.terms(linking.gazetteer(views.named_parts(spark, folder))).select(F.col("term").alias("name"))
    found = entities.candidates(chunks, entities.own_variables(assigned, elements, "p_partkey"), "p_partkey")
    return found.select("p_partkey", "start", "end", "text")


_ACTS = "chr((97 + p_partkey % 7)::INT) || 'arks'"


@query(f"""
SELECT p_partkey, unnest(['the very large new ' || p_name, 'those old ' || lower(p_type) || ' items', 'p_' || p_partkey || '[0]']) AS text,
       unnest([0, length('the very large new ' || p_name || ' ' || {_ACTS} || ' '), length('the very large new ' || p_name || ' ' || {_ACTS} || ' those old ' || lower(p_type) || ' items, ')]) AS start FROM part""")
def e3_long_chunks(spark, folder):
    """Phrases of any length in sentences about parts, which end at words that the corpus shows
    to be verbs: three of them stand behind "it" or "can" somewhere, the others end like them."""
    parts = views.dealt_parts(spark, folder)
    acts = F.concat(F.chr(97 + F.col("p_partkey") % 7), F.lit("arks"))
    shown = F.when(F.col("p_partkey") % 7 < 3, F.concat(F.lit("It "), acts, F.lit(" now. They can "), acts, F.lit(" too.")))
    sentence = F.concat(
        F.lit("the very large new "), "p_name", F.lit(" "), acts, F.lit(" those old "), F.lower("p_type"), F.lit(" items, p_"), F.col("p_partkey").cast("string"), F.lit("[0].")
    )
    known = lexicon.lexicon(parts.select(F.explode(F.array(shown, sentence)).alias("text")))
    rows = lexicon.with_verbs(parts.select("p_partkey", sentence.alias("content")), ["p_partkey"], "content", known)
    return rows.select("p_partkey", F.explode(entities.chunked("content", "verbs")).alias("c")).select("p_partkey", "c.text", "c.start")


@query()
def e3_chunks(spark, folder):
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "text")
    known = lexicon.lexicon(turns)
    turns = lexicon.with_verbs(turns, ["conv_id", "turn"], "text", known).select("conv_id", "turn", F.explode(entities.chunked("text", "verbs")).alias("c"))
    return turns.select("conv_id", "turn", "c.*")


# Evaluation

_SCORES = """
SELECT {by} tp, fp, fn, tn,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fp), 9) END AS "precision",
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE round(tp::DOUBLE / (tp + fn), 9) END AS recall,
  CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE round(2.0 * tp / (2 * tp + fp + fn), 9) END AS f1,
  CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0.0
       ELSE round((tp * tn - fp * fn)::DOUBLE / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 9) END AS mcc
FROM (SELECT {by} count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 0 AND toxic = 1) AS fp,
             count(*) FILTER (quality = 1 AND toxic = 0) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM {rows} {group})"""


def _rounded(counts: DataFrame) -> DataFrame:
    found = metrics.scores(counts)
    for name in ("precision", "recall", "f1", "mcc"):
        found = found.withColumn(name, F.round(name, 9))
    return found


@query(_SCORES.format(by="", rows="labels", group=""))
def g_confusion_prf_mcc(spark, folder):
    return _rounded(metrics.confusion(read(spark, folder, "labels"), "quality", "toxic"))


@query(_SCORES.format(by="lang, ", rows="labels JOIN documents USING (doc_id)", group="GROUP BY lang"))
def g_scores_by_language(spark, folder):
    rows = read(spark, folder, "labels").join(read(spark, folder, "documents").select("doc_id", "lang"), "doc_id")
    return _rounded(metrics.confusion(rows, "quality", "toxic", ("lang",)))


# Posts about parts: blocks, sessions, stars, messages


@query("""
SELECT p_partkey, ['About ' || p_brand, p_name || ' ', ' end <pre><code>open'] AS text_blocks, [p_type || ' < 2'] AS code_blocks FROM part""")
def t4_thread_blocks(spark, folder):
    return segments.thread_blocks(views.part_posts(spark, folder), "p_partkey", "html", "title")


@query("""
SELECT p_partkey, [p_type || ' < 2'] AS codes, ['Text: ' || p_name || ' x', 'Code: ' || p_type || ' < 2'] AS blocks FROM part""")
def t5_t6_html_blocks(spark, folder):
    page = F.concat(F.lit("<p>"), "p_name", F.lit(" <code>x</code></p>\n<pre><code>"), "p_type", F.lit(" &lt; 2</code></pre>"))
    return views.dealt_parts(spark, folder).select("p_partkey", segments.codes(page).alias("codes"), segments.blocks(page).alias("blocks"))


@query("""
SELECT p_partkey, p_type || ' = ' || p_size || chr(10) || 'for x in y:' || chr(10) || 'print(x)' AS session, 'x = ' || p_size AS plain FROM part""")
def t9_prompts(spark, folder):
    size = F.col("p_size").cast("string")
    session = F.concat(F.lit("In [1]: "), "p_type", F.lit(" = "), size, F.lit("\nOut[1]: 5\nnoise\n>>> for x in y:\n...   print(x)\n\n1"))
    plain = F.concat(F.lit("x = "), size, F.lit("  # note\n\n"))
    return views.dealt_parts(spark, folder).select("p_partkey", code.cleaned(session).alias("session"), code.cleaned(plain).alias("plain"))


@query("""
SELECT p_partkey, split_part(p_name, ' ', 1) AS alias, lower(p_type) || '.all.' || split_part(p_name, ' ', 1) AS module FROM part
UNION ALL SELECT p_partkey, 'known', 'kept.known' FROM part""")
def c2_star_imports(spark, folder):
    first = F.substring_index("p_name", " ", 1)
    block = F.concat(F.lit("from kept import known\nfrom "), F.lower("p_type"), F.lit(".all import *\ndef own(): pass\n"), first, F.lit("(1)\nown()\nknown()\na.b()\n"))
    posts = views.dealt_parts(spark, folder).select("p_partkey", F.array(block).alias("code_blocks"))
    return code.alias_map(code.import_rows(posts, "p_partkey"), "p_partkey").select("p_partkey", "alias", F.element_at("modules", 1).alias("module"))


@query("""
SELECT p_partkey, lower(p_type) || '.core.head' AS prefix, lower(p_type) || '.core.tail' AS whole, p_name AS other FROM part""")
def a2_imported(spark, folder):
    module = F.concat(F.lower("p_type"), F.lit(".core"))
    known = F.create_map(F.lit("m"), F.array(module), F.lit("tail"), F.array(F.concat(module, F.lit(".tail"))))
    return read(spark, folder, "part").select(
        "p_partkey",
        aliases.with_imports(F.lit("m.head"), known).alias("prefix"),
        aliases.with_imports(F.lit("q.tail"), known).alias("whole"),
        aliases.with_imports(F.col("p_name"), known).alias("other"),
    )


@query("""
SELECT p_partkey, p_type AS surface, length('Use ' || p_name || ' with ')::INT AS start, (2 + len(string_split(p_name, ' ')))::INT AS pos FROM part""")
def p4_p5_mentions(spark, folder):
    head = F.concat(F.lit("Use "), "p_name", F.lit(" with "))
    posts = read(spark, folder, "part").select("p_partkey", F.concat(head, "p_type", F.lit(" now")).alias("post"), F.length(head).alias("start"), (F.length(head) + F.length("p_type")).alias("end"))
    label = F.array(F.struct("start", "end", F.lit("Mention").alias("type")), F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("API").alias("type")))
    mentions = posts.select("p_partkey", F.posexplode(spans.mentions(F.col("post"), label)).alias("mention_idx", "m")).select("p_partkey", "mention_idx", "m.*")
    tokens = spans.token_places(posts.select("p_partkey", F.posexplode(F.split("post", " ")).alias("pos", "token")), "p_partkey")
    return spans.mention_tokens(tokens, mentions, "p_partkey").join(mentions, ["p_partkey", "mention_idx"]).select("p_partkey", "surface", "start", "pos")


@query("""
SELECT c AS character, (row_number() OVER (ORDER BY c) + 1)::INT AS id
FROM (SELECT DISTINCT unnest(string_split(p_name, '')) AS c FROM part) WHERE c <> ''""")
def n3_alphabet(spark, folder):
    return tagging.alphabet(read(spark, folder, "part"), "p_name")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [0, 2] ELSE [2] END AS words, [0, 1, 1] AS tags FROM part""")
def n6_tagged_words(spark, folder):
    parts = read(spark, folder, "part")
    even = (F.col("p_size") % 2 == 0).cast("int")
    tokens = F.array(F.lit("the"), F.concat(F.substring_index("p_name", " ", 1), F.lit("()")), F.lit("np.load"))
    return parts.select(
        "p_partkey",
        tagging.tagged_words(F.array(F.lit(1), F.lit(1), even, F.lit(1)), F.array(F.lit(2), F.lit(2), F.lit(0), F.lit(None).cast("int"))).alias("words"),
        tagging.tagged(tokens, tagging.RuleTagger()).alias("tags"),
    )


@query(f"""
WITH g AS (SELECT DISTINCT {NAME_SQL} AS fqn FROM part WHERE p_size > 10),
c AS (SELECT p_partkey, {NAME_SQL} AS fqn, p_brand || '.' || split_part(p_name, ' ', 2) AS wrong FROM part)
SELECT p_partkey, '1. [' || chr(39) || wrong || chr(39) || ', ' || chr(39) || fqn || chr(39) || ']' || chr(10) AS candidates, [fqn] AS predicted,
       CASE WHEN fqn IN (SELECT fqn FROM g) THEN 'pass' ELSE 'unknown' END AS verdict FROM c""")
def l8_l13_linking_calls(spark, folder):
    """Prompts from candidate lists whose first name is not in the gazetteer: the completer
    is sent back until its name is one; of parts that the gazetteer lacks none passes."""
    parts = views.named_parts(spark, folder)
    names = linking.gazetteer(parts.where("p_size > 10"))
    last = F.substring_index("p_name", " ", -1)
    lists = parts.select("p_partkey", "p_name", last.alias("last"), F.array(F.array(F.concat("p_brand", F.lit("."), last), "fqn")).alias("lists"))
    known = completer.known_candidates(lists, names, ["p_partkey"], "lists")
    shown = text.numbered_lists(F.col("lists"))
    prompts = known.select(
        "p_partkey",
        "known",
        shown.alias("candidates"),
        completer.messages("link_candidates", post=F.col("p_name"), mentions=F.col("last"), candidates=shown).alias("messages"),
        F.array("last").alias("mentions"),
        F.array("last").alias("constraints"),
    )
    return completer.constrained(prompts, completer.FirstCandidate()).select("p_partkey", "candidates", "predicted", "verdict")


@query("""
SELECT p_partkey, round(-pow(1 - (p_size + 1) / 60.0, 2) * ln((p_size + 1) / 60.0), 9) AS loss FROM part""")
def m5_focal_loss(spark, folder):
    chance = (F.col("p_size") + 1) / F.lit(60.0)
    return read(spark, folder, "part").select("p_partkey", F.round(metrics.focal_loss(chance), 9).alias("loss"))


@query("""
SELECT count(*) FILTER (p_size % 3 = 0 AND p_size % 2 = 0) AS tp, count(*) FILTER (p_size % 3 = 0 AND p_size % 2 <> 0) AS fp,
       count(*) FILTER (p_size % 3 <> 0 AND p_size % 2 = 0) AS fn, count(*) FILTER (p_size % 3 <> 0 AND p_size % 2 = 1) AS tn FROM part""")
def g1_tag_counts(spark, folder):
    tag = lambda k: F.when(F.col("p_size") % k == 0, "B-API").otherwise("0")
    return metrics.confusion_of_tags(read(spark, folder, "part").select(tag(2).alias("label"), tag(3).alias("predicted")), "label", "predicted")


@query("""
WITH e AS (SELECT p_size AS epoch, count(*)::DOUBLE AS f1 FROM part GROUP BY p_size)
SELECT max_by(epoch, f1 * 1000 + epoch) AS epoch, max(f1) AS f1 FROM e""")
def g6_best_epoch(spark, folder):
    epochs = read(spark, folder, "part").groupBy(F.col("p_size").alias("epoch")).agg(F.count("*").cast("double").alias("f1"))
    return metrics.best_epoch(epochs)


@query("""
WITH t AS (SELECT conv_id, turn, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w IN (DEMONSTRATIVES))) AS phrases FROM conversations WHERE turn > 0)
SELECT t.conv_id, t.turn, p.np, md5(replace(q.text, chr(10), ' ')) AS value
FROM t JOIN conversations q ON t.conv_id = q.conv_id AND q.turn = 0, LATERAL (SELECT unnest(t.phrases) AS np) p""".replace("DEMONSTRATIVES", ", ".join(f"'{w}'" for w in text.DEMONSTRATIVES)))
def e6_completions(spark, folder):
    """The demonstratives of each turn, with the first turn as context, through both
    completion steps with the offline completer."""
    turns = read(spark, folder, "conversations")
    questions = turns.where("turn = 0").select("conv_id", F.translate("text", "\n", " ").alias("context"))
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w.isin(*text.DEMONSTRATIVES))
    rows = turns.where("turn > 0").join(questions, "conv_id").withColumn("phrases", F.array_join(F.array_distinct(words), ", ")).where("phrases <> ''")
    done = entities.complete(rows.select("conv_id", "turn", "context", F.col("text").alias("sentence"), "phrases"), completer.FirstQuote())
    pairs = done.select("conv_id", "turn", F.explode("completions").alias("c"))
    return pairs.select("conv_id", "turn", F.col("c.NP").alias("np"), F.md5("c.Value").alias("value"))


@query("""
WITH h AS (SELECT p_size % 2 = 0 AS called FROM part WHERE p_partkey % 5 = 0)
SELECT count(*) FILTER (called) AS tp, 0::BIGINT AS fp, 0::BIGINT AS fn FROM h""")
def n5_sentence_tagger(spark, folder):
    """Held-out counts of a tagger that reads sentences: a part's word is an API where "call" is
    before it, and the same word is none behind "the"."""
    called = F.col("p_size") % 2 == 0
    word = F.substring_index("p_name", " ", 1)
    tokens = F.array(F.when(called, "call").otherwise("the"), word, F.lower("p_type"), F.lit("now"))
    labels = F.array(F.lit(0), called.cast("int"), F.lit(0), F.lit(0))
    samples = views.dealt_parts(spark, folder).select("p_partkey", tokens.alias("tokens"), labels.alias("labels"))
    held = F.col("p_partkey") % 5 == 0
    return sequence.counts(sequence.tagged(samples.where(held), sequence.train(samples.where(~held))))


@query()
def n5_trained_tagger(spark, folder):
    """A tagger that learns which tokens are names, on tokens of parts and their types."""
    parts = read(spark, folder, "part")
    tokens = parts.select(F.explode(F.array(F.struct(F.col("p_brand").alias("token"), F.lit(1).alias("label")), F.struct(F.col("p_type").alias("token"), F.lit(0).alias("label")))).alias("t")).select("t.*")
    model = tagging.train(tokens)
    return _rounded(metrics.confusion(tagging.predict(tokens, model), "label", "tag"))


# Names in full, caches, switches, failing mentions, ignored labels


@query(f"""
WITH b AS (SELECT replace(p_brand, '#', '_') AS alias, {NAME_SQL} AS fqn, count(*) AS freq FROM part GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY freq DESC, fqn) AS k FROM b),
u AS (SELECT alias, fqn FROM o WHERE k = 1 AND freq >= 10)
SELECT p_partkey, coalesce(u.fqn, replace(p_brand, '#', '_')) || '.read.head' AS variable, coalesce(u.fqn, replace(p_brand, '#', '_')) || '.plot' AS direct
FROM part LEFT JOIN u ON replace(p_brand, '#', '_') = u.alias""")
def a6_in_full(spark, folder):
    """Mentions by variables whose source is a global alias, and by the alias itself."""
    parts = views.named_parts(spark, folder).withColumn("p_brand", F.translate("p_brand", "#", "_"))
    counted = parts.groupBy(F.col("p_brand").alias("alias"), "fqn").agg(F.count("*").alias("freq"))
    ordered = counted.withColumn("ord", F.row_number().over(Window.partitionBy("alias").orderBy(F.desc("freq"), "fqn")))
    best = aliases.best_alias(ordered, linking.terms(linking.gazetteer(parts)))
    block = F.concat(F.lit("x = "), "p_brand", F.lit(".read(1)"))
    assigned = code.assign_rows(tables.dealt(parts, "p_partkey").select("p_partkey", F.array(block).alias("code_blocks")), "p_partkey")
    chain = assigned.select("p_partkey", F.create_map("variable", F.struct("source", "index")).alias("chain"))
    rows = parts.select("p_partkey", "p_brand").join(chain, "p_partkey")
    names = F.array(F.struct(F.lit("variable").alias("form"), F.lit("x.head").alias("mention")), F.struct(F.lit("direct").alias("form"), F.concat("p_brand", F.lit(".plot")).alias("mention")))
    found = aliases.with_assigns(rows.select("p_partkey", "chain", F.explode(names).alias("n")).select("p_partkey", "chain", "n.*"), best, ["p_partkey", "form"])
    of = lambda form: F.max(F.when(F.col("form") == form, F.col("mention"))).alias(form)
    return found.groupBy("p_partkey").agg(of("variable"), of("direct"))


_CACHED = "CASE WHEN substr({a}, 1, 1) = substr({b}, 1, 1) THEN CASE WHEN {a} = {b} THEN 1.0 ELSE 0.25 END ELSE " + _JW + " END"


@query(f"""
WITH g AS (SELECT DISTINCT {NAME_SQL} AS fqn FROM part),
m AS (SELECT DISTINCT replace(p_name, ' ', '.') AS mention FROM part),
p AS (SELECT mention, fqn, split_part(fqn, '.', 2) AS a1, split_part(mention, '.', 1) AS b1, split_part(fqn, '.', 3) AS a2, split_part(mention, '.', 2) AS b2 FROM m, g),
s AS (SELECT mention, fqn, round(({_CACHED.format(a="a1", b="b1")} + {_CACHED.format(a="a2", b="b2")}) / 2, 12) AS score FROM p),
r AS (SELECT mention, fqn, round(score, 9) AS score, dense_rank() OVER (PARTITION BY mention ORDER BY score DESC) AS rank FROM s)
SELECT mention, fqn, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def j3_cached_similarity(spark, folder):
    """Fuzzy candidates whose components' similarities come from a table where they begin alike
    (there 1 if equal, else a quarter), and from the measure elsewhere."""
    parts = views.named_parts(spark, folder)
    names = linking.gazetteer(parts)
    mentions = parts.select(F.translate("p_name", " ", ".").alias("mention")).distinct()
    begin = lambda c: F.substring(c, 1, 1).alias("begin")
    terms = linking.terms(names).select(F.col("term").alias("a"), begin("term"))
    asked = mentions.select(F.explode(F.split("mention", r"\.")).alias("b")).distinct().select("b", begin("b"))
    known = terms.join(asked, "begin").select("a", "b", F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.25).alias("sim"))
    return linking.fuzzy(mentions, names, top=5, known=known).withColumn("score", F.round("score", 9))


@query(f"""
WITH g AS (SELECT DISTINCT {NAME_SQL} AS fqn FROM part WHERE p_size <= 25)
SELECT DISTINCT {NAME_SQL} AS mention, {NAME_SQL} AS fqn, 1.0::DOUBLE AS score, 1 AS cand_ord FROM part WHERE ({NAME_SQL}) IN (SELECT fqn FROM g)""")
def r3_exact_only(spark, folder):
    """Linking with the fuzzy candidates switched off."""
    parts = views.named_parts(spark, folder)
    found = linking.link(parts.select(F.col("fqn").alias("mention")), linking.gazetteer(parts.where("p_size <= 25")), typo=False)
    return found.select("mention", "fqn", "score", "cand_ord")


@query("""
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN [p_brand] ELSE [] END AS failing FROM part""")
def l12_failing_mentions(spark, folder):
    parts = views.named_parts(spark, folder)
    wrong = F.when(F.col("p_size") % 2 == 0, F.lit("elsewhere")).otherwise(F.substring_index("fqn", ".", -1))
    return parts.select("p_partkey", replies.failing_mentions(F.array("fqn", "fqn"), F.array("p_brand", "p_type"), F.array(wrong, F.lit(""))).alias("failing"))


@query("""
WITH l AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN -100 WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS tag FROM lineitem)
SELECT count(*) FILTER (label = 1 AND tag = 1) AS tp, count(*) FILTER (label = 0 AND tag = 1) AS fp,
       count(*) FILTER (label = 1 AND tag = 0) AS fn, count(*) FILTER (label = 0 AND tag = 0) AS tn FROM l""")
def g5_ignored_labels(spark, folder):
    lines = read(spark, folder, "lineitem")
    label = F.when(F.col("l_linenumber") % 3 == 0, metrics.IGNORED).otherwise((F.col("l_returnflag") == "R").cast("int"))
    return metrics.confusion(lines.select(label.alias("label"), (F.col("l_linestatus") == "O").cast("int").alias("tag")), "label", "tag")


# Files written and read again


@query("""SELECT o_orderkey::VARCHAR AS text, [['0', o_custkey::VARCHAR, o_orderstatus], ['1', '2', 'API']] AS label FROM orders""")
def s1_json_lines(spark, folder):
    """Annotated rows through JSON lines."""
    mark = F.array(F.array(F.lit("0"), F.col("o_custkey").cast("string"), "o_orderstatus"), F.array(F.lit("1"), F.lit("2"), F.lit("API")))
    path = tables.new_path(spark, "annotated")
    read(spark, folder, "orders").select(F.col("o_orderkey").cast("string").alias("text"), mark.alias("label")).write.json(path)
    return tables.json_lines(spark, path, tables.ANNOTATED)


@query("""
SELECT p_brand AS alias, p_type AS fqn, count(*)::INT AS freq, (row_number() OVER (PARTITION BY p_brand ORDER BY p_type) - 1)::INT AS ord FROM part GROUP BY p_brand, p_type""")
def s5_dictionary(spark, folder):
    """The alias dictionary of brands and types, written as one JSON object and read as rows."""
    counted = read(spark, folder, "part").groupBy("p_brand", "p_type").agg(F.count("*").cast("int").alias("n"))
    inner = counted.groupBy("p_brand").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("p_type", "n")))).alias("types"))
    whole = inner.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "types")))).alias("value"))
    path = tables.new_path(spark, "dictionary")
    whole.write.text(path)
    return tables.alias_rows(spark, path)


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'stored' WHEN o_orderstatus = 'O' THEN 'called' ELSE 'replaced' END AS result FROM orders""")
def s8_resumed(spark, folder):
    """Results that are stored already are not called for again, and new ones replace old ones of
    their key, in a table that readers see before or after but never between."""
    orders = read(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    results = tables.Versions(spark, tables.new_path(spark, "results"))
    results.write(orders.where("o_orderstatus <> 'O'").select("o_orderkey", F.lit("stored").alias("result")))
    called = completer.not_done(orders, results.read(), "o_orderkey").select("o_orderkey", F.lit("called").alias("result"))
    again = orders.where("o_orderstatus NOT IN ('F', 'O')").select("o_orderkey", F.lit("replaced").alias("result"))
    results.upsert(called.unionByName(again), "o_orderkey")
    return results.read()


@query("""
SELECT (SELECT max(s_suppkey) FROM supplier) + row_number() OVER (ORDER BY c_name) AS id, c_name AS feedback FROM customer""")
def s13_feedback(spark, folder):
    stored = read(spark, folder, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("feedback"))
    return knowledge.feedback_rows(stored, read(spark, folder, "customer").select(F.col("c_name").alias("feedback"))).select("id", "feedback")


def _filled(template: str) -> str:
    """A template's user message in SQL, each field filled with the part's name and its own."""
    quoted = completer.TEMPLATES[template][1].replace("'", "''")
    return "'" + re.sub(r"\{(\w+)\}", r"' || p_name || ' \1' || '", quoted).replace("\n", "' || chr(10) || '") + "'"


@query(" UNION ALL ".join(f"SELECT p_partkey, '{name}' AS template, md5({_filled(name)}) AS content FROM part" for name in completer.TEMPLATES))
def l5_prompts(spark, folder):
    """Every template, its fields filled from columns of the parts."""
    parts = read(spark, folder, "part")
    rows = []
    for name, (_, user) in completer.TEMPLATES.items():
        fields = {f: F.concat("p_name", F.lit(f" {f}")) for f in re.findall(r"\{(\w+)\}", user)}
        rows.append(F.struct(F.lit(name).alias("template"), F.md5(completer.messages(name, **fields)[1]["content"]).alias("content")))
    return parts.select("p_partkey", F.explode(F.array(*rows)).alias("r")).select("p_partkey", "r.*")


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN '[' || p_name || ']' END AS reply, CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS attempts,
       CASE WHEN p_size % 3 = 2 THEN 'ConnectionError: down' END AS error FROM part""")
def l2_l3_paced_calls(spark, folder):
    """Calls under a shared rate, some of which fail once and some always; each says how often
    it was made and what it failed of last."""
    parts = read(spark, folder, "part")
    prompts = parts.select("p_partkey", completer.messages("coreference", marked=F.concat(F.lit("1. ["), "p_name", F.lit("] "), (F.col("p_size") % 3).cast("string"))).alias("messages"))
    called = completer.completed(prompts, completer.Unsteady(), concurrency=4, rate=1e6, retries=2, report=True)
    return called.select("p_partkey", "reply", "attempts", "error")


@query("""
SELECT p_size AS epoch, round(avg(CASE WHEN p_retailprice > 1000 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS f1 FROM part GROUP BY p_size
UNION ALL SELECT -1, 0.5""")
def s14_appended(spark, folder):
    """Results appended to those of an earlier run."""
    path = tables.new_path(spark, "scores")
    parts = read(spark, folder, "part")
    tables.append(parts.select(F.lit(-1).alias("epoch"), F.lit(0.5).alias("f1")).distinct(), path)
    share = F.round(F.avg(F.when(F.col("p_retailprice") > 1000, 1.0).otherwise(0.0)), 9)
    tables.append(parts.groupBy(F.col("p_size").alias("epoch")).agg(share.alias("f1")), path)
    return spark.read.parquet(path)


# End to end


@query(f"""
WITH p AS (SELECT p_partkey, {NAME_SQL} AS fqn, 'Call tool' || p_partkey || '.' || split_part(p_name, ' ', 2) || '() on it. Nothing here. Then ' || {NAME_SQL} || '() again.' AS post FROM part)
SELECT p_partkey, 0 AS snippet_idx, fqn AS api, 'Call ' || fqn || ' on it.' || chr(10) || chr(39) || 'it' || chr(39) || ' refers to ' || post AS snippet FROM p
UNION ALL SELECT p_partkey, 3, fqn, 'Then ' || fqn || ' again.' FROM p""")
def s16_extracted(spark, folder):
    """Posts about parts to knowledge rows, with aliases, constraints, both offline completers
    and context entities."""
    parts = views.named_parts(spark, folder)
    tool = F.concat(F.lit("tool"), F.col("p_partkey").cast("string"))
    owner, last = F.substring_index("fqn", ".", 2), F.substring_index("fqn", ".", -1)
    html = F.concat(
        F.lit("<p>Call "), tool, F.lit("."), last, F.lit("() on it. Nothing here.</p><pre><code>import "), owner, F.lit(" as "), tool, F.lit("</code></pre><p>Then "), F.col("fqn"), F.lit("() again.</p>"),
    )
    counted = parts.groupBy(F.col("p_brand").alias("alias"), "fqn").agg(F.count("*").alias("freq")).withColumn("ord", F.lit(0))
    names = linking.gazetteer(parts)
    best = aliases.best_alias(counted, linking.terms(names))
    posts = tables.dealt(parts, "p_partkey").select("p_partkey", html.alias("html"))
    return extraction.extract(posts, names, "p_partkey", best=best, linker=completer.FirstCandidate(), explainer=completer.FirstQuote())


# Flagship


@query(r"""
WITH p AS (SELECT page_id, regexp_extract_all(html, '(?s)(<p>.*?</p>|<pre><code>.*?</code></pre>)', 1) AS b FROM pages),
u AS (SELECT page_id, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS seg FROM p),
c AS (SELECT page_id, seg, string_split(trim(regexp_replace(lower(regexp_extract(block, '(?s)^<p>(.*)</p>$', 1)), '[^\p{L}]+', ' ', 'g')), ' ') AS w FROM u),
t AS (SELECT page_id, seg, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM c),
n AS (SELECT DISTINCT regexp_extract(url, '://([^/?#]*)', 1) AS fqn FROM pages),
k AS (SELECT DISTINCT fqn, unnest(string_split(fqn, '.')) AS term FROM n),
h AS (SELECT *, count(*) OVER (PARTITION BY term) AS names FROM k),
x AS (SELECT fqn, term FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY names, term) AS place FROM h) WHERE place = 1),
m AS (SELECT page_id, seg, fqn, min(pos) AS pos FROM t JOIN x ON t.token = x.term GROUP BY ALL),
f AS (SELECT page_id, seg, min(pos) AS mpos FROM m GROUP BY page_id, seg),
s AS (SELECT m.page_id, m.seg, m.fqn, sum(1.0 / abs(t.pos - f.mpos)) AS score
      FROM m JOIN f USING (page_id, seg) JOIN k ON m.fqn = k.fqn JOIN t ON t.page_id = m.page_id AND t.seg = m.seg AND t.token = k.term WHERE t.pos <> f.mpos GROUP BY ALL),
r AS (SELECT m.page_id, m.seg, m.fqn, round(coalesce(s.score, 0), 6) AS score,
             row_number() OVER (PARTITION BY m.page_id, m.seg ORDER BY round(coalesce(s.score, 0), 6) DESC, m.fqn) AS rank
      FROM m LEFT JOIN s ON m.page_id = s.page_id AND m.seg = s.seg AND m.fqn = s.fqn)
SELECT page_id, seg::INT AS seg_idx, fqn, score, rank::INT AS rank FROM r WHERE rank <= 5""")
def flagship_link_pages(spark, folder):
    """Paragraphs' words against the gazetteer of hosts: candidates by their rarest component,
    ranked by nearness to the first word that hits, the five best of each paragraph."""
    paragraph = ["page_id", "seg_idx"]
    pages = read(spark, folder, "pages")
    words = F.split(F.trim(F.regexp_replace(F.lower("content"), r"[^\p{L}]+", " ")), " ")
    tokens = segments.segments(pages, "page_id", "html").select(*paragraph, F.posexplode(words).alias("pos", "token"))
    names = linking.gazetteer(pages.select(F.regexp_extract("url", r"://([^/?#]*)", 1).alias("fqn")))
    found = linking.by_rarest_part(tokens, names, paragraph)
    mentions = found.groupBy(*paragraph).agg(F.min("pos").alias("pos")).withColumn("mention_idx", F.lit(0))
    candidates = found.select(*paragraph, F.lit(0).alias("mention_idx"), F.col("fqn").alias("cand_ord"), "fqn")
    near = linking.nearness(tokens, mentions, candidates, paragraph).withColumn("score", F.round("score", 6))
    order = Window.partitionBy(*paragraph).orderBy(F.desc("score"), "fqn")
    return near.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select(*paragraph, "fqn", "score", "rank")
