"""Conversation structure repair by a square-root checkpointed dynamic programme.

A conversation is right if its roles' initials read `(s?(ua)+)?`: a system turn at most, then
user and assistant in turn. Keeping a turn costs nothing, giving it another role 3, deleting
it 4 (blank and repeated turns must go), inserting an empty turn 3, and a truncated turn that
stays 3 more. Of the cheapest edits the ASCII-least string of their initials D I K R is taken.

For n turns the backward costs (of ending well from each of the four states) are kept only at
checkpoints, every ceil(sqrt n) turns. Blocks between them are rows of their own, so no task
needs a whole conversation for them: each gives its min-plus transfer matrix; the matrices,
square root of n of them, are scanned backward into the checkpoints' vectors; each block then
recomputes its inner vectors from the checkpoint behind it and walks forward along tight edits
from each state it may be entered in; a scan of exits picks the walk that was really taken.
Only the turns themselves pass through a task in their order, as a stream, to be written anew.

Defined results: nulls read as one blank, in ids and turns as well; turns go by number, nulls
first, then by role and text; rows that are alike in all are repetitions; conversations without
rows have no edits; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm import common
from loam.operators.ordinals import numbered, placed

NULL = " "
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAULTS = 20

START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user or assistant turn leads, the only one of both that fits a state.
NEXT = (USER, USER, ASSISTANT, USER)
#: (state, initial) -> state of a turn that keeps its role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
#: A turn as a letter: its initial (o: any other), whether it is truncated, whether it must go.
WHOLE, CUT, GONE = "suao", "SUAO", "1234"
TURN = {c: (WHOLE[k], TRUNCATED if letters is CUT else 0, letters is not GONE) for letters in (WHOLE, CUT, GONE) for k, c in enumerate(letters)}
LEGAL = ("su", "ua", "au")


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, conv, turn, role, text of conversations with their planted faults."""
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat(conv, F.lit(":"), turn)) % FAULTS
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(NULL)) for c in ("role", "text"))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(role)
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = turns.where(fault != 0).select("conv_id", conv.alias("conv"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy_"))
    return rows.drop("copy_")


def _relaxed(v: list[int]) -> tuple[int, ...]:
    """Costs at a place, once turns may be inserted there."""
    user, assistant = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + user), min(v[SYSTEM], INSERT + user), user, assistant


END = _relaxed([0, NEVER, NEVER, 0])


def _before(letter: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a turn from those behind it."""
    initial, extra, stays = TURN[letter]
    costs = []
    for state in range(4):
        cost = DELETE + after[state]
        if stays:
            cost = min(cost, REROLE + extra + after[NEXT[state]])
            if (kept := KEPT.get((state, initial))) is not None:
                cost = min(cost, KEEP + extra + after[kept])
        costs.append(cost)
    return _relaxed(costs)


@lru_cache(1 << 14)
def transfer(block: str) -> tuple[int, ...]:
    """The block's min-plus matrix: row a, column b, at least what it costs from a to b."""
    columns = []
    for b in range(4):
        v = tuple(0 if a == b else NEVER for a in range(4))
        for letter in reversed(block):
            v = _before(letter, v)
        columns.append(v)
    return tuple(min(columns[b][a], NEVER) for a in range(4) for b in range(4))


@lru_cache(1 << 14)
def walk(block: str, after: tuple[int, ...]) -> tuple[list[str], list[int]]:
    """The edits of the block from each state, and the state they end in."""
    costs = [after]
    for letter in reversed(block):
        costs.append(_before(letter, costs[-1]))
    costs.reverse()
    pieces, exits = [], []
    for state in range(4):
        edits, k = [], 0
        while k < len(block):
            initial, extra, stays = TURN[block[k]]
            here, following = costs[k][state], costs[k + 1]
            kept = KEPT.get((state, initial))
            if here == DELETE + following[state]:
                edits.append("D")
                k += 1
            elif here == INSERT + costs[k][NEXT[state]]:
                edits.append("I")
                state = NEXT[state]
            elif stays and kept is not None and here == KEEP + extra + following[kept]:
                edits.append("K")
                state, k = kept, k + 1
            else:
                edits.append("R")
                state, k = NEXT[state], k + 1
        pieces.append("".join(edits))
        exits.append(state)
    return pieces, exits


def _illegal(block: str) -> int:
    initials = [TURN[c][0] for c in block]
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def marked(turns: DataFrame) -> DataFrame:
    """conv, at, turn and fault (blank, duplicate, truncated or none) of placed turns, and the
    turn as a letter. A text's first turn is found by groups of equal role and text, whose
    least place is summed up in each task."""
    blank = F.btrim("text", F.lit(common.SPACES)) == ""
    key = F.sha2(F.concat(F.sha2("role", 256), "text"), 256)
    rows = turns.select("conv", "at", "turn", "role", key.alias("key"), blank.alias("blank"), F.right(F.btrim("text", F.lit(common.SPACES)), F.lit(1)).isin(".", "!", "?").alias("ended"))
    firsts = rows.groupBy("conv", "key").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    rows = rows.join(firsts, "at", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    kind = F.instr(F.lit(WHOLE[:3]), F.substring("role", 1, 1))
    place = F.when((F.col("role") == "") | (kind == 0), 4).otherwise(kind)
    letters = F.when(fault.isin("blank", "duplicate"), GONE).when(fault == "truncated", CUT).otherwise(WHOLE)
    return rows.select("conv", "at", "turn", fault.alias("fault"), F.substring(letters, place, F.lit(1)).alias("letter"))


def _scanned(conv: DataFrame) -> DataFrame:
    """after: the costs at each block's end, of rows (conv, blocks in order)."""

    @F.pandas_udf("struct<cost:long,illegal:long,afters:array<array<long>>>")
    def scan(rows: pd.Series) -> pd.DataFrame:
        found = []
        for blocks in rows:
            v, afters, illegal, following = END, [], 0, None
            for b in reversed(blocks):
                afters.append(list(v))
                m = b["transfer"]
                v = tuple(min(int(m[4 * a + c]) + v[c] for c in range(4)) for a in range(4))
                illegal += int(b["illegal"]) + (following is not None and b["last"] + following not in LEGAL)
                following = b["first"]
            found.append((v[START], illegal, afters[::-1]))
        return pd.DataFrame(found, columns=["cost", "illegal", "afters"])

    return conv.select("conv", "blocks", scan("blocks").alias("scan"))


def edits(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, cost, illegal, audit of every conversation; conv, at, entry, piece of its blocks).

    turns: what marked() gives. A block's `at` is that of its first turn.
    """

    @F.pandas_udf("struct<transfer:array<long>,illegal:int,first:string,last:string>")
    def summed(blocks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(list(transfer(b)), _illegal(b), TURN[b[0]][0], TURN[b[-1]][0]) for b in blocks], columns=["transfer", "illegal", "first", "last"])

    @F.pandas_udf("struct<pieces:array<string>,exits:array<int>>")
    def walked(blocks: pd.Series, afters: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([walk(b, tuple(map(int, v))) for b, v in zip(blocks, afters, strict=True)], columns=["pieces", "exits"])

    @F.pandas_udf("array<struct<block:long,entry:int,piece:string>>")
    def taken(rows: pd.Series) -> pd.Series:
        found = []
        for blocks in rows:
            state, pieces = START, []
            for b in blocks:
                pieces.append({"block": b["block"], "entry": state, "piece": b["pieces"][state]})
                state = int(b["exits"][state])
            while state not in (START, ASSISTANT):
                pieces[-1]["piece"] += "I"
                state = NEXT[state]
            found.append(pieces)
        return pd.Series(found)

    sizes = turns.groupBy("conv").agg(F.ceil(F.sqrt(F.count("*"))).alias("length"))
    rows = numbered(turns.select("conv", "at", "letter"), ["conv"]).join(sizes, "conv")
    rows = rows.withColumn("block", F.floor(F.col("ordinal") / F.col("length")))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letter"))), lambda x: x["letter"]), "")
    blocks = common.stored(rows.groupBy("conv", "block").agg(F.min("at").alias("at"), letters.alias("letters")), "blocks")
    parts = blocks.select("conv", "block", summed("letters").alias("s")).select("conv", F.struct("block", "s.*").alias("b"))
    scans = common.stored(_scanned(parts.groupBy("conv").agg(F.array_sort(F.collect_list("b")).alias("blocks"))).select("conv", "scan.*"), "checkpoints")
    afters = scans.select("conv", F.posexplode("afters").alias("k", "after")).select("conv", F.col("k").cast("long").alias("block"), "after")
    met = blocks.join(afters, ["conv", "block"]).select("conv", "block", walked("letters", "after").alias("w")).select("conv", F.struct("block", "w.*").alias("b"))
    ways = common.stored(met.groupBy("conv").agg(taken(F.array_sort(F.collect_list("b"))).alias("ways")), "ways")
    audits = scans.select("conv", "cost", "illegal").join(ways.select("conv", F.array_join(F.transform("ways", lambda w: w["piece"]), "").alias("audit")), "conv")
    pieces = ways.select("conv", F.explode("ways").alias("w")).select("conv", "w.*").join(blocks.select("conv", "block", "at"), ["conv", "block"])
    return audits, pieces.drop("block")


REPAIRED = "conv string, edit string, role string, text string"


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns that stay or are inserted, of rows (conv, at, kind) in order: blocks' pieces of
    kind 0, each ahead of its turns of kind 1."""
    conv = piece = None
    at, state = 0, START
    out: list[tuple] = []

    def inserts() -> None:
        nonlocal at, state
        while piece is not None and at < len(piece) and piece[at] == "I":
            state = NEXT[state]
            out.append((conv, "I", ROLES[state], ""))
            at += 1

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["conv", "edit", "role", "text"])

    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("conv", "kind", "entry", "role", "text")]
        for name, kind, entry, role, text in zip(*columns, strict=True):
            if kind == 0:
                inserts()  # of the block before, whose conversation may have ended
                conv, piece, at, state = name, text, 0, entry
                continue
            inserts()
            edit, at = piece[at], at + 1
            if edit == "D":
                continue
            if edit == "K":
                state = KEPT[state, role[:1]]
            else:
                state = NEXT[state]
                role = ROLES[state]
            out.append((conv, edit, role, text))
        yield flushed()
    inserts()
    yield flushed()


def rewritten(turns: DataFrame, pieces: DataFrame) -> DataFrame:
    """conv, edit (I, K, R), role and text of the repaired turns: a conversation's stand
    together and in order within a partition. turns: placed, with conv, at, role, text."""
    heads = pieces.select("conv", "at", F.lit(0).alias("kind"), "entry", F.lit(None).cast("string").alias("role"), F.col("piece").alias("text"))
    rows = heads.unionByName(turns.select("conv", "at", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("entry"), "role", "text"))
    return rows.repartition("conv").sortWithinPartitions("conv", "at", "kind").mapInArrow(_rewritten, REPAIRED)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv = digest = None
    for batch in batches:
        found = []
        for name, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "role", "text")), strict=True):
            if name != conv or digest is None:
                if digest is not None:
                    found.append((conv, digest.hexdigest()))
                conv, digest = name, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("conv", "sha256"), x, strict=True)) for x in found], pa.schema([("conv", pa.string()), ("sha256", pa.string())]))
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], names=["conv", "sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """conv and the SHA-256 of its `role:text` lines, of what rewritten() gives: the stream
    is hashed as it comes, so no conversation is held as a whole."""
    return repaired.mapInArrow(_hashed, "conv string, sha256 string")


def faults(turns: DataFrame) -> DataFrame:
    """conv and its numbers of gaps, blank, duplicate and truncated turns, of marked() turns."""
    by_turn = turns.groupBy("conv", "turn").agg(*(F.sum(F.when(F.col("fault") == f, 1).otherwise(0)).alias(f) for f in ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
    return by_turn.groupBy("conv").agg(gaps.alias("gaps"), *(F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")))


def repair(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Every conv_id with its faults, the cost and initials of its edits, and the digest of
    the repaired turns. turns: conv, turn, role, text, as damaged() gives them."""
    rows = placed(turns.select("conv", "turn", "role", "text"), ["conv", "turn", "role", "text"])
    found = common.stored(marked(rows), "marked")
    audits, pieces = edits(found)
    done = faults(found).join(audits, "conv").join(digests(rewritten(rows, pieces)), "conv", "left")
    every = conversations.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(NULL)))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(done, "conv", "left").select(
        "conv_id",
        *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
