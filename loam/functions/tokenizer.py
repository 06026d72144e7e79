"""Tokens of software text, with their places.

Python's `re` is needed for look-around and Unicode classes; one Arrow UDF does all.
"""

from __future__ import annotations

import html
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loam.functions.rows import by_rows
from loam.functions.text import NOSE

# What is kept as one token, tried in this order.
EYES, SAD, HAPPY = r"[:=8;]", r"[(\[]", r"[D)\]]"
FACE = rf"{EYES}{NOSE}(?:[pPb]|[|doO/\\]|{SAD}+|{HAPPY}+)|(?:{SAD}+|{HAPPY}+){NOSE}{EYES}"
EMOTICON = rf"<+/?3+|{FACE}|<*[-=]*>+|<+[-=]*>*"
ENTITY = r"&(?:amp|lt|gt|quot);"
DOMAIN = r"(?:com|co\.uk|org|net|info|ca|edu|gov)"
URL = (
    rf"\b(?:https?://|www\.|[a-z0-9.-]+?\.{DOMAIN}(?=[/\W]))[^ \t\r\n<>]*?"
    rf"(?=(?:(?:['“\".?!,(/:;]|{ENTITY})+?)?(?:\.\.+|[<>]|\s|$))"
)
EMAIL = rf"(?:[a-zA-Z0-9_+-]+\.)*[a-zA-Z0-9_+-]+@(?:[a-zA-Z0-9]+\.)+{DOMAIN}"
ABBREVIATION_END = rf"(?=\s|[“\"?!,:;]|{ENTITY})"
KEPT = (
    EMOTICON,
    URL,
    EMAIL,
    ENTITY,
    r"#[a-zA-Z0-9_]+",
    r"@[a-zA-Z0-9_]+",
    r"\d+:\d+",
    r"\d+\.\d+",
    r"(?:\d+,)+?\d{3}(?=[^,]|$)",
    rf"(?:[A-Za-z]\.){{2,}}{ABBREVIATION_END}|(?:[A-Za-z]\.)+[A-Za-z]{ABBREVIATION_END}",
    r"--+|―",
    r"[♫]+",
    r"\S+'\w+",
    r"(?:\w+\.)+\w+\(\)|\w+\(\)|(?:\w+\.)+\w+",
    r"['`\"“”‘’)]+|[.?!,…]+|[:;/(]+",
    r"\w+\(s\)",
    r"==|!=|>=|<=|&&|\|\|",
)
EDGE = r"['\"“”‘’*«»{}()\[\]]"
PROTECTED = re.compile("|".join(f"(?:{p})" for p in KEPT))
LEFT_EDGE = re.compile(rf"(\s|^)({EDGE}+)([a-zA-Z0-9])")
RIGHT_EDGE = re.compile(rf"([a-zA-Z0-9](?:\(s?\))?)({EDGE}*)(\s|$)")
TOKENS = "array<struct<pos:int,token:string,start:int,end:int>>"
TOKENS_ARROW = pa.list_(pa.struct([("pos", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
API = re.compile(KEPT[13])


def clean(text: str) -> str:
    """Text as it is tokenised: dashes and trailing slashes blank, white space squeezed,
    the entities of <, > and & decoded."""
    text = re.sub(r"(?<=\w)/(?:\s|$)", " ", text.replace("—", " "))
    text = " ".join(text.split())
    for entity in ("&lt;", "&gt;", "&amp;"):
        text = text.replace(entity, html.unescape(entity))
    return text


def edges_apart(text: str) -> str:
    """Punctuation at the edges of words set apart; call and plural parentheses stay."""
    return RIGHT_EDGE.sub(r"\1 \2\3", LEFT_EDGE.sub(r"\1\2 \3", text))


def tokens(text: str | None) -> list[dict]:
    """Tokens in order with code-point places in clean(text)."""
    if not text:
        return []
    text = clean(text)
    spread = edges_apart(text)
    found: list[str] = []
    at = 0
    for kept in PROTECTED.finditer(spread):
        found += spread[at : kept.start()].split()
        if kept.group():
            found.append(kept.group())
        at = kept.end()
    found += spread[at:].split()
    out, at = [], 0
    for token in found:
        start = text.find(token, at)
        if start < 0:  # set apart by an added blank: placed where the token before it ends
            start = at
        at = start + len(token)
        out.append({"pos": len(out), "token": token, "start": start, "end": at})
    return out


def tokenized(text) -> Column:
    """tokens() of a column, as an array of structs."""
    return by_rows(tokens, TOKENS, TOKENS_ARROW, text)


def cleaned(text) -> Column:
    """clean() of a column."""

    def of_texts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clean(t))

    return F.pandas_udf(of_texts, "string")(text)
