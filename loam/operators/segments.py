"""Posts into segments, sentences and tokens."""

from __future__ import annotations

from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.functions import tokenizer

BLOCK = r"(?s)(<p>.*?</p>|<pre><code>.*?</code></pre>)"


def segments(posts: DataFrame, key: str, html: str) -> DataFrame:
    """key, seg_idx, kind ("Text" or "Code") and content of each block; empty text goes."""
    block = F.col("block")
    code = block.startswith("<pre>")
    inner = F.when(code, F.regexp_extract(block, r"(?s)^<pre><code>(.*)</code></pre>$", 1)).otherwise(F.regexp_extract(block, r"(?s)^<p>(.*)</p>$", 1))
    found = posts.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(BLOCK), F.lit(1))).alias("seg_idx", "block"))
    found = found.select(key, "seg_idx", F.when(code, "Code").otherwise("Text").alias("kind"), F.regexp_replace(inner, r"(?U)^\s+|\s+$", "").alias("content"))
    return found.where("kind = 'Code' OR content <> ''")


def sentences(segments_: DataFrame, key: str) -> DataFrame:
    """One row a sentence or code block, with a running index over the post."""
    parts = F.when(F.col("kind") == "Code", F.array("content")).otherwise(T.sentences(F.col("content")))
    rows = segments_.select(key, "seg_idx", "kind", F.posexplode(parts).alias("part", "content"))
    index = F.row_number().over(Window.partitionBy(key).orderBy("seg_idx", "part")) - 1
    return rows.select(key, index.alias("sent_idx"), "kind", "content")


def tokens(sentences_: DataFrame, key: str) -> DataFrame:
    """Tokens of the text sentences; code blocks have none."""
    rows = sentences_.where("kind = 'Text'").withColumn("t", F.explode(tokenizer.tokenized("content")))
    return rows.select(key, "sent_idx", "t.*")


def thread_blocks(posts: DataFrame, key: str, html: str, title: str | None = None) -> DataFrame:
    """key, title, text_blocks and code_blocks; text behind an unclosed block stays text."""
    block = r"(?s)<pre><code>(.*?)</code></pre>"
    texts = F.filter(F.split(F.col(html), block, -1), lambda x: F.trim(x) != "")
    if title is not None:
        texts = F.concat(F.array(F.coalesce(F.col(title), F.lit(""))), texts)
    return posts.select(key, texts.alias("text_blocks"), F.regexp_extract_all(F.col(html), F.lit(block), F.lit(1)).alias("code_blocks"))


def with_code_tags(text: Column) -> Column:
    """"Text: ... Code: ..." as text blocks and tagged code blocks, one below the other."""
    marks = r"\s*(?:Text:|Code:)"
    bodies = F.slice(F.split(text, marks, -1), F.lit(2), F.greatest(F.size(F.split(text, marks, -1)) - 1, F.lit(0)))
    kinds = F.regexp_extract_all(text, F.lit(r"\s*(Text:|Code:)"), F.lit(1))
    piece = lambda kind, body: F.when(kind == "Code:", F.concat(F.lit("<pre><code>\n"), F.trim(body), F.lit("\n</code></pre>"))).otherwise(F.trim(body))
    return F.array_join(F.zip_with(kinds, bodies, piece), "\n")


def without_code_lines(text: Column) -> Column:
    """Lines from one that starts with "Code:" up to the next that starts with "Text:" go."""
    stretches = F.split(text, r"\n(?=Text:|Code:)", -1)
    return F.array_join(F.filter(stretches, lambda x: ~x.startswith("Code:")), "\n")


class _Tree(HTMLParser):
    """The code inside <pre> tags, and the blocks at the top of the page."""

    VOID = ("br", "img", "hr", "input", "meta", "link", "wbr")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.path: list[str] = []
        self.codes: list[str] = []
        self.code: list[str] | None = None
        self.blocks: list[tuple[set, str]] = []
        self.tags: set[str] = set()
        self.data: list[str] = []

    def _close(self):
        self.blocks.append((self.tags, "".join(self.data)))
        self.tags, self.data = set(), []

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID or tag in ("html", "body"):
            return
        if not self.path:
            self._close()
        if tag == "code" and self.path[-1:] == ["pre"]:
            self.code = []
        self.path.append(tag)
        self.tags.add(tag)

    def handle_endtag(self, tag):
        if tag not in self.path:
            return
        while self.path.pop() != tag:
            pass
        if tag == "code" and self.code is not None:
            self.codes.append("".join(self.code))
            self.code = None
        if not self.path:
            self._close()

    def handle_data(self, data):
        self.data.append(data)
        if self.code is not None:
            self.code.append(data)

    @classmethod
    def read(cls, html: str) -> _Tree:
        self = cls()
        self.feed(html)
        self.close()
        self._close()
        return self


def code_of_html(html: str | None) -> list[str]:
    """Text of each <code> right inside a <pre>; entities are decoded first."""
    return _Tree.read(unescape(html or "")).codes


def blocks_of_html(html: str | None) -> list[str]:
    """Top blocks as "Code: ..." where nothing but code in a pre stands, else "Text: ..."."""
    kept = ((tags, data.strip()) for tags, data in _Tree.read(unescape(html or "")).blocks)
    return [("Code: " if tags == {"pre", "code"} else "Text: ") + data for tags, data in kept if data]


def _listed(function, column) -> Column:
    def of_texts(texts: pd.Series) -> pd.Series:
        return texts.map(function)

    return F.pandas_udf(of_texts, "array<string>")(column)


def codes(html) -> Column:
    return _listed(code_of_html, html)


def blocks(html) -> Column:
    return _listed(blocks_of_html, html)
