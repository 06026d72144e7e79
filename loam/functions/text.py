"""Text expressions: Column -> Column, all of them built-in Spark functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark-up and word lists that results depend on.
RED_OPEN, BLUE_OPEN, SPAN_CLOSE = '<span style="color:red">', '<span style="color:blue">', "</span>"
DEMONSTRATIVES = (
    "he", "she", "it", "they", "him", "her", "them", "this", "that", "these", "those", "my", "your", "his", "its", "our",
    "their", "mine", "yours", "what", "such", "above", "below",
)
CODE_WORDS = (
    "def", "class", "for", "while", "if", "elif", "else", "try", "except", "finally", "with", "as", "import", "from", "return",
    "yield", "lambda", "and", "or", "not", "is", "in", "=", "==", "!=", "pass", "break", "continue", "global", "nonlocal",
    "assert", "raise", "del", "print", "input",
)
NOSE = r"(?:|o|O|-)"
HAPPY = rf"\^_\^|[:=8]{NOSE}[D\)\]]"
SAD = rf"[:=8]{NOSE}[\(\[]"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def without_parentheses(text: Column) -> Column:
    """Text outside parentheses; they don't nest, an open one runs to the end, stray ones go."""
    return F.translate(F.regexp_replace(text, r"\([^)]*(?:\)|\z)", ""), ")", "")


def between(text: Column, left: str, right: str) -> Column:
    """The first, shortest stretch between two marks, trimmed; null if there is none."""
    pattern = rf"(?s)\Q{left}\E\s*(.*?)\s*\Q{right}\E"
    return F.when(F.rlike(text, F.lit(pattern)), F.regexp_extract(text, pattern, 1))


def without_highlights(text: Column) -> Column:
    for pattern in (r"</?strong>", r'<span style="color:[^"]+">'):
        text = F.regexp_replace(text, pattern, "")
    return F.replace(text, F.lit("</span>"), F.lit(""))


def first_red(html: Column) -> Column:
    """The first red mention inside strong tags; null if there is none."""
    pattern = rf"(?d)<strong>\Q{RED_OPEN}\E(.*?)</span></strong>"
    return F.when(F.rlike(html, F.lit(pattern)), F.regexp_extract(html, pattern, 1))


def _mentions(html: Column, opening: str) -> Column:
    return F.regexp_extract_all(html, F.lit(rf"(?d)\Q{opening}\E(.*?)</span>"), F.lit(1))


def red_mentions(html: Column) -> Column:
    return _mentions(html, RED_OPEN)


def blue_mentions(html: Column) -> Column:
    return _mentions(html, BLUE_OPEN)


def replace_red(html: Column, names: Column) -> Column:
    """The k-th red mention replaced by names[k]; mentions without a name stay."""
    pattern = rf"(?d)\Q{RED_OPEN}\E.*?</span>"
    outside, inside = F.split(html, pattern, -1), red_mentions(html)

    def joined(text: Column) -> Column:
        name = lambda k: F.coalesce(F.get(text["names"], k), F.get(text["inside"], k))
        mention = lambda k: F.when(k < F.size(text["inside"]), F.concat(F.lit(RED_OPEN), name(k), F.lit(SPAN_CLOSE))).otherwise("")
        return F.array_join(F.transform(text["outside"], lambda x, k: F.concat(x, mention(k))), "")

    # as an array of one, so that both patterns are run once a text
    text = F.array(F.struct(outside.alias("outside"), inside.alias("inside"), names.alias("names")))
    several = F.get(F.transform(text, joined), F.lit(0))
    quoted = F.regexp_replace(F.get(names, F.lit(0)), r"[\\$]", r"\\$0")
    only = F.coalesce(F.regexp_replace(html, F.lit(pattern), F.concat(F.lit(RED_OPEN), quoted, F.lit(SPAN_CLOSE))), html)
    return F.when(F.size(inside) == 0, html).when(F.size(inside) == 1, only).otherwise(several)


def normalised_mention(mention: Column) -> Column:
    """A mention without call arguments and without a subscript on its last part."""
    cut = F.regexp_replace(mention, r"(?s)\(.*\z", "")
    return F.regexp_replace(cut, r"(?s)[\[('][^.]*\z", "")


def emoticon_class(text: Column) -> Column:
    happy, sad = F.rlike(text, F.lit(HAPPY)), F.rlike(text, F.lit(SAD))
    return F.when(happy & sad, "BOTH_HS").when(happy, "HAPPY").when(sad, "SAD").otherwise("NA")


def looks_like_code(text: Column) -> Column:
    words = "|".join(rf"\Q{w}\E" for w in CODE_WORDS)
    return F.rlike(text, F.lit(rf"(?U)\b(?:{words})\b"))


def snippet_terms(text: Column) -> Column:
    """Distinct white-space tokens that are neither numbers nor ISO dates."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    return F.array_distinct(F.filter(tokens, lambda t: ~F.rlike(t, F.lit(r"^(?:\d+(?:\.\d+)?|\d{4}-\d{2}-\d{2})\z"))))


def plain_names(names: Column) -> Column:
    """Those of letters, digits and underscores that aren't numbers."""
    return F.filter(names, lambda n: F.rlike(n, F.lit(r"^[a-zA-Z0-9_]+\z")) & ~F.rlike(n, F.lit(r"^\d+\z")))


def has_demonstrative(tokens: Column) -> Column:
    return F.arrays_overlap(F.transform(tokens, F.lower), F.array(*map(F.lit, DEMONSTRATIVES)))


def sentences(text: Column) -> Column:
    """Sentences by end marks and white space; an approximation of a trained splitter."""
    return F.filter(F.split(text, r"(?<=[.!?])(?U)\s+"), lambda s: F.trim(s) != "")


def numbered_lists(lists: Column) -> Column:
    """Lines "1. [...]" for an array of lists."""
    line = lambda x, k: F.concat((k + 1).cast("string"), F.lit(". ["), F.array_join(F.transform(x, lambda y: F.concat(F.lit("'"), y, F.lit("'"))), ", "), F.lit("]\n"))
    return F.array_join(F.transform(lists, line), "")
