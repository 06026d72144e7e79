"""Phrases whose meaning depends on context, and their completion."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions.rows import by_rows
from loam.functions.text import DEMONSTRATIVES
from loam.operators import replies
from loam.operators.completer import Completer, completed, messages

CHUNKS = "array<struct<start:int,end:int,text:string>>"
CHUNKS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
STOPS = frozenset("is are was were be been has have had do does did can could will would should may might must and or but if of to in on at by for with from as than then so not when while because which who whom whose that's it's".split())
ARTICLES = frozenset(("the", "a", "an"))
HEADS = frozenset(DEMONSTRATIVES) | ARTICLES


def noun_chunks(sentence: str | None, verbs: list[str] | None = None) -> list[dict]:
    """Phrases by a finite automaton over words: a demonstrative or article with all words behind
    it up to a stop word, another head, a word that acts as a verb (lexicon.with_verbs()), or
    a mark; other names with = or [ stand alone. Behind an article the first word is no verb.
    """
    acting = frozenset(verbs if verbs is not None else ())
    found: list[tuple[int, int]] = []
    begin = end = bare = None  # of the open phrase; whether an article is all of it
    for m in re.finditer(r"\S+", sentence or ""):
        word = m[0].strip(".,;:!?")
        low, at = word.lower(), m.start() + len(m[0].rstrip(".,;:!?"))
        verb = low in acting and not bare
        if begin is not None and (low in STOPS or low in HEADS or verb):
            found.append((begin, end))
            begin = None
        if begin is not None:
            end, bare = at, False
        elif low in HEADS:
            begin, end, bare = m.start(), at, low in ARTICLES
        elif low not in STOPS and not verb and re.fullmatch(r"[A-Za-z_]\w*(?:[=\[].*)?", word):
            found.append((m.start(), at))
        if begin is not None and at < m.end():
            found.append((begin, end))
            begin = None
    if begin is not None:
        found.append((begin, end))
    return [{"start": a, "end": b, "text": sentence[a:b]} for a, b in sorted(found)]


def chunked(sentence, verbs: Column | str | None = None) -> Column:
    return by_rows(noun_chunks, CHUNKS, CHUNKS_ARROW, sentence, F.array().cast("array<string>") if verbs is None else verbs)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def own_variables(assigned: DataFrame, api_elements: DataFrame, key: str | list[str]) -> DataFrame:
    """A thread's assigned variables that are no API elements."""
    return assigned.select(*_keys(key), "name").distinct().join(api_elements.select("name"), "name", "left_anti")


def candidates(chunks: DataFrame, variables: DataFrame, key: str | list[str]) -> DataFrame:
    """chunks (key, sent_idx, start, end, text) with a demonstrative, or whose last word, cut
    at = or [, is one of the thread's own variables; once each."""
    words = F.split(F.lower("text"), r"\s+")
    root = F.regexp_extract(F.element_at(F.split("text", r"\s+"), -1), r"^([^=\[]*)", 1)
    rows = chunks.withColumn("demonstrative", F.arrays_overlap(words, F.array(*map(F.lit, DEMONSTRATIVES)))).withColumn("name", root)
    marks = variables.select(*_keys(key), "name").distinct().withColumn("own", F.lit(True))
    return rows.join(marks, [*_keys(key), "name"], "left").where("demonstrative OR own").drop("name", "own", "demonstrative")


def kept_by_chains(entity: Column, chains: Column, entities: Column) -> Column:
    """Whether an entity stays: no chain has it, or the first that has it holds nothing but
    candidates."""
    first = F.get(F.filter(F.map_values(chains), lambda c: F.array_contains(c, entity)), F.lit(0))
    return F.coalesce(F.size(F.array_except(first, entities)) == 0, F.lit(True))


def complete(rows: DataFrame, completer: Completer, context: str = "context", sentence: str = "sentence", phrases: str = "phrases") -> DataFrame:
    """rows with `completions`: what explains the phrases is asked for first, then the pairs."""
    asked = rows.withColumn("messages", messages("context_find", context=F.col(context), sentence=F.col(sentence), phrases=F.col(phrases)))
    quoted = completed(asked, completer).withColumnRenamed("reply", "quotes")
    asked = quoted.withColumn("messages", messages("context_complete", quotes=F.col("quotes"), phrases=F.col(phrases)))
    return completed(asked, completer).withColumn("completions", replies.completions(F.col("reply"))).drop("messages", "reply", "quotes")
