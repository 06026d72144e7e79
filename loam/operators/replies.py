"""Replies of a language model: lists, objects, constraints."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LIST = "struct<items:array<string>,parse_status:string>"
ABSTAINS = "None"


def _bare(item: object) -> str:
    return str(item).strip().strip("'").strip('"')


def _bracketed(text: str) -> list[str] | None:
    if text.startswith("[") and text.endswith("]"):
        return [_bare(x) for x in text[1:-1].split(",")]
    return None


def parse_list(reply: str | None) -> tuple[list[str] | None, str]:
    """(items, how they were found): fenced JSON (repaired if its items lack quotes), another
    fence, LaTeX text, brackets, or lines without their numbers 1. to 9.; else (None, why)."""
    if reply is None:
        return None, "null"
    text = reply.strip()
    fence = re.fullmatch(r"```(json|plaintext|python|)(.*)```", text, re.S)
    kind = ""
    if fence:
        kind, text = fence[1], fence[2].strip()
    if kind == "json":
        for candidate in (text, re.sub(r"\[|\]|, ", lambda m: {"[": '["', "]": '"]'}.get(m[0], '", "'), text)):
            try:
                found = json.loads(candidate)
            except ValueError:
                continue
            return ([_bare(x) for x in found], "json") if isinstance(found, list) else (None, "not a list")
        return None, "bad json"
    if latex := re.fullmatch(r"\\\[(.*)\\\]", text, re.S):
        text = latex[1].strip()
        inner = re.fullmatch(r"\\text\{\{(.*)\}\}|\\text\{(.*)\}", text, re.S)
        text = (inner[1] if inner[1] is not None else inner[2]).strip() if inner else text
    if (found := _bracketed(text)) is not None:
        return found, kind or "brackets"
    if "\n" in text:
        return [re.sub(r"^[1-9]\.", "", line.strip()).strip() for line in text.split("\n")], "lines"
    return None, "no list"


def listed(reply) -> Column:
    """parse_list() of a column: struct<items, parse_status>."""

    def of_replies(replies: pd.Series) -> pd.DataFrame:
        found = [parse_list(x) for x in replies]
        return pd.DataFrame({"items": [f[0] for f in found], "parse_status": [f[1] for f in found]})

    return F.pandas_udf(of_replies, LIST)(reply)


def chains(reply: Column) -> Column:
    """A reply's coreference chains, map<string, array<string>>; null if there are none."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(reply, r"(?s)(\{.*\})", 1))
    return F.from_json(F.when(body != "", body), "map<string,array<string>>")


def completions(reply: Column) -> Column:
    """A reply's (NP, Value) pairs, from its first bracket to its last."""
    body = F.regexp_extract(reply, r"(?s)(\[.*\])", 1)
    return F.from_json(F.when(body != "", body), "array<struct<NP:string,Value:string>>")


def context(question: Column, answer: Column, others: Column, comments: Column) -> Column:
    """A thread's parts as one text; other answers and comments are numbered."""
    numbered = lambda parts: F.array_join(F.transform(parts, lambda x, k: F.concat((k + 1).cast("string"), F.lit(". "), x)), "\n")
    head = lambda title, body: F.concat(F.lit(f"{title}:\n"), F.coalesce(body, F.lit("")))
    return F.concat_ws("\n\n", head("Question", question), head("Answer", answer), head("Other Answers", numbered(others)), head("Comments", numbered(comments)))


def verdict(predicted: Column, mentions: Column, constraints: Column, known: Column) -> Column:
    """count, none, unknown, suffix or pass, the first that holds: as many names as mentions,
    no abstention, only names in `known` (the predicted names that exist), each with its
    constraint as suffix."""
    ends = F.zip_with(predicted, constraints, lambda p, c: (p == c) | F.endswith(p, F.concat(F.lit("."), c)) | (c == ""))
    return (
        F.when(predicted.isNull() | (F.size(predicted) != F.size(mentions)), "count")
        .when(F.array_contains(predicted, ABSTAINS), "none")
        .when(F.size(F.array_except(predicted, known)) > 0, "unknown")
        .when(F.exists(ends, lambda e: ~e), "suffix")
        .otherwise("pass")
    )


def failing_mentions(predicted: Column, mentions: Column, constraints: Column) -> Column:
    """The mentions whose name lacks their constraint."""
    rows = F.arrays_zip(predicted.alias("p"), mentions.alias("m"), constraints.alias("c"))
    bad = F.filter(rows, lambda r: ~((r["p"] == r["c"]) | F.endswith(r["p"], F.concat(F.lit("."), r["c"])) | (r["c"] == "")))
    return F.transform(bad, lambda r: r["m"])
