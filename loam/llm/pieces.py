"""SentencePiece encoding with seeded merge-dropout, and decoding.

The vocabulary is that of a public BPE model with byte fallback, read once on the driver
from a path that is a parameter, and sent along (its size is fixed). A text is written
with a mark for each blank and one in front, and is cut where no piece has the characters
before and behind next to each other: no merge crosses there. In each part an agenda holds
the candidate merges by score, then place. A candidate that comes up is skipped for good if
its keyed hash is under the dropout; the key is made of the seed and the document's variant
(a hash of its id and, where rows have one, of their copy number), and the hash takes in
the candidate's place in the text and its piece. So reruns agree, each occurrence of a word
and each copy of a text is cut anew, and decoding is lossless for each of them. Characters
that no piece holds, and blanks' marks that a text holds itself, go out as bytes.

Parts of a length are settled together: a column of numbers for each part, of which every
step takes the least entry (rank and place), and skips or merges it. Parts above LONGEST
characters have a heap each.

Defined results: a null text is an empty one and has no pieces; null ids have variant 0 if
they are no later copy; repeated rows without a copy number get equal pieces; an empty
table gives no rows; other columns are kept by encode(), whose new columns are `piece_ids`
and `variant` (columns of these names that come in are replaced).
"""

from __future__ import annotations

import functools
import hashlib
import heapq
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 13
#: Upper lengths of the parts that are settled together; longer ones have a heap each.
LENGTHS = (2, 3, 4, 5, 6, 8, 10, 12, 16, 63)
LONGEST = LENGTHS[-1]
#: Rows encoded at a time, and characters settled at a time.
SLICE, WINDOW = 1024, 1 << 20
ALL = (1 << 64) - 1
PLACE, PIECE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
MARK = "▁"
COPY = "copy_number"
#: An entry of the agenda is rank << 6 | place; this and above is no candidate.
NONE = 1 << 30


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id. symbols: the piece of each character (-1: none); letters and together:
    which characters stand next to each other in some piece; keys and merged: a hash table
    of the pairs of pieces that make a piece; ranks: the order of merges, by piece."""

    ids: dict
    byte_ids: np.ndarray
    raw: tuple
    symbols: np.ndarray
    letters: np.ndarray
    together: np.ndarray
    keys: np.ndarray
    merged: np.ndarray
    ranks: np.ndarray


def _slot(keys: np.ndarray, size: int) -> np.ndarray:
    return (keys * np.uint64(PLACE) >> np.uint64(40)).astype(np.int64) & (size - 1)


@functools.lru_cache(maxsize=4)
def load(path: str = MODEL) -> Vocabulary:
    """Pieces, scores and bytes of a model file, laid out for the encoder."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    ids, byte_ids, raw = {}, np.zeros(256, np.int32), []
    for k in range(n):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            raw.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k):
            raw.append(b"")
        else:
            ids[piece] = k
            raw.append(piece.replace(MARK, " ").encode())
    scores = {k: model.get_score(k) for k in ids.values()}
    order = {score: k for k, score in enumerate(sorted(set(scores.values()), reverse=True))}
    ranks = np.full(n + 1, NONE >> 6, np.int32)  # the last is that of no piece, -1
    for k, score in scores.items():
        ranks[k] = order[score]
    symbols, letters = np.full(0x110000, -1, np.int32), np.zeros(0x110000, np.uint16)
    for k, c in enumerate(sorted({c for piece in ids for c in piece}), 1):
        letters[ord(c)] = k
        symbols[ord(c)] = ids.get(c, -1)
    # A blank is written as the mark; a mark of the text's own is a character of no piece.
    letters[ord(" ")], symbols[ord(" ")] = letters[ord(MARK)], symbols[ord(MARK)]
    together = np.zeros((int(letters.max()) + 1,) * 2, bool)
    for piece in ids:
        places = [letters[ord(c)] for c in piece]
        together[places[:-1], places[1:]] = True
    letters[ord(MARK)], symbols[ord(MARK)] = 0, -1
    pairs = {ids[p[:k]] << 20 | ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
    size = 1 << max(4, (4 * len(pairs)).bit_length())
    keys, merged = np.full(size, ALL, np.uint64), np.full(size, -1, np.int32)
    for key, at in zip(pairs, _slot(np.fromiter(pairs, np.uint64, len(pairs)), size).tolist(), strict=True):
        while keys[at] != ALL:
            at = (at + 1) % size
        keys[at], merged[at] = key, pairs[key]
    return Vocabulary(ids, byte_ids, tuple(raw), symbols, letters, together, keys, merged, ranks)


def mixed(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & ALL
    x = (x ^ x >> 27) * 0x94D049BB133111EB & ALL
    return x ^ x >> 31


def mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Encoder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, vocabulary: Vocabulary, dropout: float = DROPOUT, seed: int = SEED, window: int = WINDOW):
        import xxhash

        self.v, self.seed, self.window = vocabulary, seed, window
        self.below = int(dropout * (1 << 32))
        self.hash64 = xxhash.xxh64_intdigest
        self.size = len(vocabulary.raw)

    def variant(self, doc_id: int | None, copy: int = 0) -> int:
        if doc_id is None and not copy:
            return 0
        return self.hash64(f"{doc_id}:{copy}" if copy else str(doc_id), self.seed) & 0x7FFFFFFF

    def key(self, variant: int, place: int = 0) -> int:
        """The key of a variant's candidates from that place in the text on."""
        return mixed(variant * PIECE + self.seed & ALL) + place * PLACE & ALL

    def skips(self, key: int, place: int, piece: int) -> bool:
        return mixed(key + place * PLACE + piece * PIECE & ALL) >> 32 < self.below

    def _merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The pieces of pairs of pieces, -1 where they make none."""
        v = self.v
        wanted = left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64)
        at = _slot(wanted, len(v.keys))
        held = v.keys[at]
        out = np.where(held == wanted, v.merged[at], np.int32(-1))
        more = np.flatnonzero((held != wanted) & (held != np.uint64(ALL)))
        while len(more):
            at[more] = (at[more] + 1) & (len(v.keys) - 1)
            held = v.keys[at[more]]
            hit = held == wanted[more]
            out[more[hit]] = v.merged[at[more[hit]]]
            more = more[~hit & (held != np.uint64(ALL))]
        return out

    def agenda(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Settles parts, a column each (filled up with the number of pieces): their pieces,
        each at the place where it begins, and -1 at the others."""
        length, n = symbols.shape
        symbols = np.concatenate((symbols.ravel(), np.full(n, self.size, np.int32)))  # the last row: beyond the ends
        after = np.repeat(np.arange(1, length + 2, dtype=np.int16), n)
        before = np.repeat(np.concatenate(([length], np.arange(length))).astype(np.int16), n)
        piece_at = np.concatenate((self._merge(symbols[: (length - 1) * n], symbols[n : length * n]), np.full(2 * n, -1, np.int32)))
        table = (self.v.ranks[piece_at] << 6).reshape(length + 1, n) + np.arange(length + 1, dtype=np.int32)[:, None]
        column = np.arange(n)
        while True:
            least = table[:length].min(axis=0)
            going = least < NONE
            if not going.all():
                table, column, least, keys = table[:, going], column[going], least[going], keys[going]
            if not len(column):
                return symbols[: length * n].reshape(length, n)
            place = (least & 63).astype(np.int64)
            at, row = place * n + column, np.arange(len(column))
            piece = piece_at[at]
            if self.below:
                hashed = mixed_all(keys + place.astype(np.uint64) * np.uint64(PLACE) + piece.astype(np.uint64) * np.uint64(PIECE))
                skipped = hashed >> np.uint64(32) < np.uint64(self.below)
                table[place[skipped], row[skipped]] = NONE
                row = row[~skipped]
                place, at, piece = place[row], at[row], piece[row]
            own = column[row]
            last = after[at].astype(np.int64)
            gone = last * n + own
            follows = after[gone].astype(np.int64)
            leads = before[at].astype(np.int64)
            next_, prior = follows * n + own, leads * n + own
            symbols[at], symbols[gone] = piece, -1
            after[at], before[next_] = follows, place
            made = self._merge(np.concatenate((piece, symbols[prior])), np.concatenate((symbols[next_], piece)))
            ranked = self.v.ranks[made] << 6
            behind, ahead = made[: len(row)], made[len(row) :]
            table[last, row] = NONE
            piece_at[at], table[place, row] = behind, ranked[: len(row)] + place
            piece_at[prior], table[leads, row] = ahead, ranked[len(row) :] + leads

    def long_agenda(self, symbols: list[int], key: int) -> list[int]:
        """agenda() of one part: a heap of rank and place, where an entry counts if the pair
        at its place still has its rank."""
        ranks, n = self.v.ranks, len(symbols)
        after, before = array("i", range(1, n + 1)), array("i", range(-1, n - 1))
        made = self._merge(np.array(symbols[:-1], np.int32), np.array(symbols[1:], np.int32))
        agenda = [int(ranks[p]) << 32 | k for k, p in enumerate(made.tolist()) if p >= 0]
        heapq.heapify(agenda)
        known: dict[int, int] = {}

        def pair(a: int, b: int) -> int:
            both = a << 20 | b
            if both not in known:
                known[both] = int(self._merge(np.array([a]), np.array([b]))[0])
            return known[both]

        while agenda:
            entry = heapq.heappop(agenda)
            a = entry & 0xFFFFFFFF
            if symbols[a] < 0 or (b := after[a]) == n:
                continue
            piece = pair(symbols[a], symbols[b])
            if piece < 0 or ranks[piece] != entry >> 32 or self.below and self.skips(key, a, piece):
                continue
            symbols[a], symbols[b] = piece, -1
            c = after[a] = after[b]
            if c < n:
                before[c] = a
                if (p := pair(piece, symbols[c])) >= 0:
                    heapq.heappush(agenda, int(ranks[p]) << 32 | a)
            if (z := before[a]) >= 0 and (p := pair(symbols[z], piece)) >= 0:
                heapq.heappush(agenda, int(ranks[p]) << 32 | z)
        return symbols

    def _windows(self, text: str) -> Iterator[np.ndarray]:
        """A text's characters, with a blank in front, in windows that end where no merge
        crosses."""
        at, size = 0, self.window
        while at <= len(text):
            part = text[at - 1 : at - 1 + size] if at else " " + text[: size - 1]
            chars = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
            if at + len(chars) <= len(text):  # more follows
                cuts = np.flatnonzero(self._cuts(chars)[1:])
                if not len(cuts):
                    size *= 2
                    continue
                chars = chars[: int(cuts[-1]) + 1]
            yield chars
            at, size = at + len(chars), self.window

    def _cuts(self, chars: np.ndarray) -> np.ndarray:
        """Whether no merge crosses the place before each character."""
        letters = self.v.letters[chars]
        return np.concatenate(([True], ~self.v.together[letters[:-1], letters[1:]]))

    def encode_all(self, texts: list[str | None], variants: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all texts, one after the other, and how many each text has."""
        sizes, found = np.zeros(len(texts), np.int64), []
        held, docs, keys, n = [], [], [], 0

        def settle() -> None:
            pieces, counts = self._encode(held, np.array(keys, np.uint64))
            found.append(pieces)
            np.add.at(sizes, docs, counts)
            for x in (held, docs, keys):
                x.clear()

        for d, text in enumerate(texts):
            at = 0
            for chars in self._windows(text) if text else ():
                held.append(chars)
                docs.append(d)
                keys.append(self.key(variants[d], at))
                at, n = at + len(chars), n + len(chars)
                if n >= self.window:
                    settle()
                    n = 0
        if held:
            settle()
        return np.concatenate(found) if found else np.zeros(0, np.int32), sizes

    def _encode(self, windows: list[np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of windows, one after the other, and how many each window has."""
        chars = np.concatenate(windows)
        ends = np.cumsum([len(x) for x in windows])
        begins = ends - [len(x) for x in windows]
        out = self.v.symbols[chars]
        cuts = self._cuts(chars)
        cuts[begins] = True
        starts = np.flatnonzero(cuts)
        lengths = np.diff(np.concatenate((starts, [len(chars)])))
        window = np.searchsorted(ends, starts, "right")
        keys = keys[window] + (starts - begins[window]).astype(np.uint64) * np.uint64(PLACE)
        least = 1
        for most in LENGTHS:
            mine = np.flatnonzero((lengths > least) & (lengths <= most))
            least = most
            if len(mine):
                places = starts[mine] + np.arange(most)[:, None]
                inside = np.arange(most)[:, None] < lengths[mine]
                symbols = np.where(inside, out[np.minimum(places, len(out) - 1)], np.int32(self.size))
                out[places[inside]] = self.agenda(symbols, keys[mine])[inside]
        for k in np.flatnonzero(lengths > LONGEST).tolist():
            a, b = starts[k], starts[k] + lengths[k]
            out[a:b] = self.long_agenda(out[a:b].tolist(), int(keys[k]))
        # Characters without a piece: as many pieces as they have bytes.
        sizes = (out >= 0).astype(np.int64)
        alone = np.flatnonzero(self.v.symbols[chars] < 0)
        unknown, which = np.unique(chars[alone], return_inverse=True)
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in unknown.tolist()]
        sizes[alone] = np.array([len(c) for c in coded], np.int64)[which] if len(alone) else 0
        counts = np.add.reduceat(sizes, begins)
        flat = np.repeat(out, sizes)
        if len(alone):
            first = (np.cumsum(sizes) - sizes)[alone]
            for k, code in enumerate(coded):
                for j, byte in enumerate(code):
                    flat[first[which == k] + j] = self.v.byte_ids[byte]
        return flat, counts

    def encode(self, text: str | None, variant: int = 0) -> np.ndarray:
        return self.encode_all([text], [variant])[0]

    def decode(self, ids) -> bytes:
        """The UTF-8 bytes of the text that the pieces came from."""
        return b"".join(map(self.v.raw.__getitem__, ids))[1:]


def encode(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """docs with `piece_ids` (array of int) and `variant` in place of the text; the copy
    number, if docs have a column COPY, is part of the key."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in docs.columns if c not in ("text", "piece_ids", "variant")]
    copied = COPY in kept
    schema = docs.select(*kept).schema.add("variant", T.IntegerType()).add("piece_ids", T.ArrayType(T.IntegerType()))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, dropout, seed)
        for batch in batches:
            for k in range(0, max(1, batch.num_rows), SLICE):
                part = batch.slice(k, SLICE)
                copies = part.column(COPY).to_pylist() if copied else [0] * part.num_rows
                variants = [encoder.variant(x.as_py(), n or 0) for x, n in zip(part.column("doc_id"), copies, strict=True)]
                ids, sizes = encoder.encode_all(part.column("text").to_pylist(), variants)
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                arrays = [*(part.column(c) for c in kept), pa.array(variants, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, "variant", "piece_ids"])

    return docs.mapInArrow(encoded, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """Rows of encode() with their text in place of the pieces."""
    sent = encoded.sparkSession.sparkContext.broadcast(load(path))
    kept = [c for c in encoded.columns if c not in ("text", "piece_ids")]
    schema = encoded.select(*kept).schema.add("text", T.StringType())

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value)
        for batch in batches:
            texts = pa.array([encoder.decode(x.as_py()) for x in batch.column("piece_ids")], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), texts], names=[*kept, "text"])

    return encoded.mapInArrow(decoded, schema)


def round_trips(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """doc_id, variant, n_bytes, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit
    numbers) and lossless (whether the pieces decode to the text) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, dropout, seed)
        for whole in batches:
            for k in range(0, max(1, whole.num_rows), SLICE):
                yield tried_rows(encoder, whole.slice(k, SLICE))

    def tried_rows(encoder: Encoder, batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids, texts = batch.column("doc_id").to_pylist(), pc.fill_null(batch.column("text"), "").to_pylist()
        variants = [encoder.variant(x) for x in doc_ids]
        ids, sizes = encoder.encode_all(texts, variants)
        ends, rows = np.cumsum(sizes), []
        for doc_id, text, variant, end, size in zip(doc_ids, texts, variants, ends.tolist(), sizes.tolist(), strict=True):
            own, raw = ids[end - size : end], text.encode()
            rows.append((doc_id, variant, len(raw), size, hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), encoder.decode(own.tolist()) == raw))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = ["doc_id", "variant", "n_bytes", "n_pieces", "pieces_sha256", "lossless"]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tried, "doc_id long, variant int, n_bytes long, n_pieces long, pieces_sha256 string, lossless boolean")
