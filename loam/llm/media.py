"""Media columns: documents as interleaved sequences of text and media.

store() turns payloads into media (8-bit grey PNG, WIDTH samples a row) and writes them
with their digests. sequences() parses HTML into an ordered array of structs: text, or a
reference to media by digest with its caption. resolve() joins references to what is known
of each stored payload by digest, each item at its own position with its own caption;
assembled() puts the sequence together again.

Payloads never move: a media row is decoded where it is stored, and what the join carries
by digest is its description.

Defined results: a null text is an empty payload, padded to one row of blanks; null HTML
is an empty sequence; a reference without a stored payload keeps its place, with a null
description; equal payloads share one description; an empty table gives no rows; other
columns are passed by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common

WIDTH = 192
TAIL = 16
SCHEME = "sha256:"
PNG = b"\x89PNG\r\n\x1a\n"
STORED = "doc_id long, n_bytes long, digest string, media binary"
ITEMS = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"
ABOUT = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of fewer rows, as a task holds a batch in several forms at once."""
    for batch in batches:
        for k in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(k, rows)


def padded(payload: bytes) -> bytes:
    rows = max(1, -(-len(payload) // WIDTH))
    return payload.ljust(rows * WIDTH, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(payload: bytes) -> bytes:
    """A PNG whose samples are the payload's bytes."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> np.ndarray:
    """The samples of a PNG that encode() made; checks every chunk."""
    if not media.startswith(PNG):
        raise ValueError("not a PNG")
    at, shape, packed = len(PNG), None, []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8].ljust(8, b"\0"))
        if at + 12 + size > len(media):
            raise ValueError("cut short")
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Size, mean, spread, and shares of sixteen bands of the samples."""
    bands = np.bincount((samples >> 4).ravel(), minlength=16) / samples.size
    shares = ",".join(f"{x:.4f}" for x in bands)
    return f"grey8 {samples.shape[1]}x{samples.shape[0]} mean {samples.mean():.4f} std {samples.std():.4f} bands {shares}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest (of the padded payload) and media, written and read back."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [x.as_py() for x in pc.fill_null(batch.column("text"), "").cast(pa.binary())]
            payloads = list(map(padded, texts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(map(len, texts), pa.int64()),
                    pa.array([SCHEME + hashlib.sha256(p).hexdigest() for p in payloads]),
                    pa.array(map(encode, payloads), pa.binary()),
                ],
                names=["doc_id", "n_bytes", "digest", "media"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.stored(rows.mapInArrow(encoded, STORED), "media", compression="none")


class Interleaved(HTMLParser):
    """Text and media references of an HTML page in their order. A figure's caption goes to
    all media of the figure, whether it stands before or behind them."""

    HIDDEN = ("script", "style")
    BREAKS = ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "figure", "article", "section", "figcaption")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.text: list[str] = []
        self.hidden = 0
        self.caption: list[str] | None = None
        self.figures: list[tuple[list[dict], list[str]]] = []  # open ones: media and captions

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def _end_caption(self) -> None:
        if self.caption is None:
            return
        caption, self.caption = " ".join("".join(self.caption).split()), None
        if caption and self.figures:
            self.figures[-1][1].append(caption)
        elif caption:
            self.text.append(caption)

    def _end_figure(self) -> None:
        self._end_caption()
        self._flush()
        media, captions = self.figures.pop()
        caption = " ".join(captions)
        for item in media if caption else ():
            item["caption"] = caption
        if caption and not media:  # nothing to stand at
            self.text.append(caption)
            self._flush()

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self.hidden += 1
        if tag in self.BREAKS and self.caption is None:
            self._flush()
        if tag == "figure":
            self.figures.append(([], []))
        elif tag == "figcaption":
            self._end_caption()
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            known = dict(attrs)
            self._flush()
            item = {"kind": "media", "text": None, "digest": known.get("src"), "caption": known.get("alt")}
            self.items.append(item)
            if self.figures:
                self.figures[-1][0].append(item)

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption":
            self._end_caption()
        elif tag == "figure" and self.figures:
            self._end_figure()
        if tag in self.BREAKS and self.caption is None:
            self._flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)

    @classmethod
    def parse(cls, html: str | None) -> list[dict]:
        self = cls()
        self.feed(html or "")
        self.close()
        while self.figures:
            self._end_figure()
        self._end_caption()
        self._flush()
        return [{"pos": k} | item for k, item in enumerate(self.items)]


def sequences(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with `items`, the interleaved sequence, in place of the HTML."""

    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(Interleaved.parse)

    return pages.withColumn("items", F.pandas_udf(parsed, ITEMS)(html)).drop(html)


def descriptions(media: DataFrame) -> DataFrame:
    """What the stored bytes say, once for each digest."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, met = [], set()
            for digest, stored in zip(batch.column("digest"), batch.column("media"), strict=True):
                if digest in met:
                    continue
                met.add(digest)
                stored = stored.as_py()
                samples = decode(stored)
                payload = samples.tobytes()
                rows.append((digest.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(samples)))
            names = [x.split()[0] for x in ABOUT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=names) if rows else pa.RecordBatch.from_pylist([], schema=pa.schema([(n, pa.int64() if k == "long" else pa.string()) for n, k in (x.split() for x in ABOUT.split(", "))]))

    return media.select("digest", "media").mapInArrow(described, ABOUT).dropDuplicates(["digest"])


def resolve(sequences_: DataFrame, keys: str | list[str], about: DataFrame) -> DataFrame:
    """keys, pos, kind, text, caption and the description of each item's media: a row for
    each item, at its own position and with its own caption."""
    keys = [keys] if isinstance(keys, str) else keys
    items = sequences_.select(*keys, F.explode("items").alias("i")).select(*keys, "i.*")
    return items.join(about, "digest", "left")


def assembled(resolved: DataFrame, keys: str | list[str]) -> DataFrame:
    """keys and `items`, the sequence put together again from the rows of resolve(), in order
    of position; a page's items meet in one row, as they did in its HTML."""
    keys = [keys] if isinstance(keys, str) else keys
    item = F.struct("pos", *(c for c in resolved.columns if c not in (*keys, "pos")))
    return resolved.groupBy(*keys).agg(F.array_sort(F.collect_list(item), lambda a, b: a["pos"] - b["pos"]).alias("items"))


def documents_with_media(docs: DataFrame) -> DataFrame:
    """A document of one figure for each row, whose payload is a reference."""
    media = store(docs)
    html = F.concat(F.lit("<article><p>document</p><figure><img src='"), "digest", F.lit("'><figcaption>payload</figcaption></figure></article>"))
    pages = sequences(media.select("doc_id", "n_bytes", html.alias("html")))
    # Written out first: the join then meets two plain sides, whose hot digests Spark can split.
    about = common.stored(descriptions(media), "media-descriptions")
    return resolve(pages, ["doc_id", "n_bytes"], about).where("kind = 'media'")
