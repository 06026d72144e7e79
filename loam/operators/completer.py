"""Language-model calls behind an interface, with a deterministic default.

A completer is any picklable object with complete(messages) -> reply. Calls run in
partitions: their number is the concurrency.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.operators.replies import parse_list

RETRIES = 5
#: Calls whose replies a task hands on together.
CALLS = 256
MESSAGES = "array<struct<role:string,content:string>>"
TEMPLATES = {
    "link_candidates": ("You link API mentions to fully qualified names.", "Post:\n{post}\nMentions: {mentions}\nCandidates:\n{candidates}\nAnswer with one list, an entry for each mention, None where no name fits."),
    "link_open": ("You link API mentions to fully qualified names.", "Post:\n{post}\nMentions: {mentions}\nAnswer with one list of names."),
    "link_one_step": ("You find API mentions and name them in full.", "Post:\n{post}\nAnswer with one list of names."),
    "link_no_abstention": ("You link API mentions to fully qualified names and never abstain.", "Post:\n{post}\nMentions: {mentions}\nCandidates:\n{candidates}"),
    "link_retrieved": ("You link API mentions with the help of documentation.", "Documentation:\n{documents}\nPost:\n{post}\nMentions: {mentions}"),
    "link_text_and_code": ("You link API mentions in text and code.", "Text:\n{text}\nCode:\n{code}\nMentions: {mentions}"),
    "link_rules": ("You link API mentions by rules.", "Rules:\n{rules}\nPost:\n{post}\nMentions: {mentions}"),
    "coreference": ("You build coreference chains.", "Sentence with marked phrases:\n{marked}\nAnswer with a JSON object: chain name to phrases."),
    "context_find": ("You find what a phrase depends on.", "Context:\n{context}\nSentence:\n{sentence}\nPhrases: {phrases}\nQuote what explains each phrase."),
    "context_complete": ("You complete phrases from quotes.", "Quotes:\n{quotes}\nPhrases: {phrases}\nAnswer with a JSON list of objects with NP and Value."),
    "context_one_go": ("You find and complete phrases that depend on context.", "Context:\n{context}\nSentence:\n{sentence}\nAnswer with a JSON list of objects with NP and Value."),
}


class Completer(Protocol):
    def complete(self, messages: list[dict]) -> str: ...


@dataclass(frozen=True)
class FirstCandidate:
    """Offline: the first candidate of each numbered list in the user's first message, and
    the next one of each after every answer that was sent back."""

    def complete(self, messages: list[dict]) -> str:
        picked, again = [], sum(m["role"] == "assistant" for m in messages)
        for line in next(m["content"] for m in messages if m["role"] == "user").split("\n"):
            number, dot, rest = line.partition(". [")
            if dot and number.isdigit():
                found = parse_list("[" + rest)[0] or [""]
                picked.append(found[again % len(found)] or "None")
        return "[" + ", ".join(picked) + "]"


@dataclass(frozen=True)
class FirstQuote:
    """Offline: quotes the first line of a context, and completes every phrase with the
    quotes it is given."""

    def complete(self, messages: list[dict]) -> str:
        content = next(m["content"] for m in messages if m["role"] == "user")
        kind, _, rest = content.partition(":\n")
        first, _, rest = rest.partition("\n")
        if kind != "Quotes":
            return first
        phrases = rest.rpartition("Phrases: ")[2].split("\n")[0]
        return json.dumps([{"NP": p, "Value": first} for p in phrases.split(", ") if p])


@dataclass
class Unsteady:
    """Offline: what stands in brackets; fails once for messages that say "] 1", and always for
    those that say "] 2"."""

    failed: set = field(default_factory=set)

    def complete(self, messages: list[dict]) -> str:
        text = messages[-1]["content"]
        if "] 2" in text or "] 1" in text and text not in self.failed:
            self.failed.add(text)
            raise ConnectionError("down")
        self.failed.discard(text)
        return text[text.index("[") : text.index("]") + 1]


@dataclass(frozen=True)
class Retrying:
    """Calls again after an error that passes, waiting as long as `wait` says for it (None:
    don't call again); after `times` the reply is null."""

    inner: Completer
    wait: Callable[[Exception], float | None]
    times: int = RETRIES

    def complete(self, messages: list[dict]) -> str | None:
        for _ in range(self.times):
            try:
                return self.inner.complete(messages)
            except Exception as e:  # noqa: BLE001  the completer's errors are its own
                if (pause := self.wait(e)) is None:
                    return None
                time.sleep(pause)
        return None


def messages(template: str, **columns: Column) -> Column:
    """The messages of a template, its fields filled from columns."""
    system, user = TEMPLATES[template]
    pieces, rest = [], user
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        pieces += [F.lit(head), F.coalesce(columns[name].cast("string"), F.lit(""))]
    content = F.concat(*pieces, F.lit(rest))
    entry = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.array(entry("system", F.lit(system)), entry("user", content))


@dataclass
class Bucket:
    """Lets `rate` calls a second pass, one at a time: a call waits for its turn, and turns
    that nobody took are lost. None: no limit."""

    rate: float | None
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    turn: float = float("-inf")

    def wait(self) -> None:
        if self.rate is not None:
            now = self.clock()
            self.turn = max(now, self.turn + 1 / self.rate)
            if self.turn > now:
                self.sleep(self.turn - now)


def _talk(sent) -> list[dict]:
    return [dict(m.asDict() if hasattr(m, "asDict") else m) for m in sent]


def completed(
    prompts: DataFrame, completer: Completer, column: str = "messages", concurrency: int | None = None, rate: float | None = None, retries: int = 0, report: bool = False
) -> DataFrame:
    """prompts with `reply`; a failed call is null and the others go on.

    rate: calls a second of all tasks together, retries among them. It takes a concurrency: that
    many tasks share it evenly, so no more than it go out whatever number of them runs. retries:
    how often a failed call is made again. report: also `attempts` and `error`, the last one's.
    """
    if rate is not None and not concurrency:
        raise ValueError("a rate is shared by a number of tasks: give the concurrency too")
    rows = prompts.repartition(concurrency) if concurrency else prompts
    added = [T.StructField("reply", T.StringType())]
    if report:
        added += [T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]

    def called(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(rate / concurrency if rate is not None else None)
        # The rows' other columns, which may hold whole posts, are passed on as they came.
        for batch in (b.slice(at, CALLS) for b in batches for at in range(0, b.num_rows, CALLS)):
            found = []
            for sent in batch.column(column):
                reply = error = None
                for attempt in range(1, 2 + retries):
                    bucket.wait()
                    try:
                        reply, error = completer.complete(_talk(sent.as_py())), None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
                found.append((reply, attempt, error))
            columns = [pa.array([x[k] for x in found], pa.int32() if f.name == "attempts" else pa.string()) for k, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *(f.name for f in added)])

    return rows.mapInArrow(called, T.StructType([*rows.schema, *added]))


def constrained(prompts: DataFrame, completer: Completer, known: str = "known", retries: int = RETRIES) -> DataFrame:
    """prompts (messages, mentions, constraints, known) with predicted and verdict: a reply
    that breaks a constraint is called again, with the reason, up to `retries` times. known:
    a column with the names that a reply may hold, such as the prompt's candidates that are
    in the gazetteer (known_candidates()). A call that fails gives a null and the verdict
    "failed", and the others go on."""
    schema = T.StructType([*prompts.schema, T.StructField("predicted", T.ArrayType(T.StringType())), T.StructField("verdict", T.StringType())])

    def judge(found: list | None, mentions, constraints, names: set) -> str:
        if found is None or len(found) != len(mentions):
            return "count"
        if "None" in found:
            return "none"
        if any(f not in names for f in found):
            return "unknown"
        return "pass" if all(not c or f == c or f.endswith("." + c) for f, c in zip(found, constraints, strict=True)) else "suffix"

    def called(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for sent, mentions, constraints, names in zip(frame["messages"], frame["mentions"], frame["constraints"], frame[known], strict=True):
                names = set(names if names is not None else ())
                talk, found, why = _talk(sent), None, "failed"
                for _ in range(1 + retries):
                    try:
                        reply = completer.complete(talk)
                    except Exception:  # noqa: BLE001
                        found, why = None, "failed"
                        break
                    found = parse_list(reply)[0]
                    if (why := judge(found, mentions, constraints, names)) == "pass":
                        break
                    talk += [{"role": "assistant", "content": reply or ""}, {"role": "user", "content": f"That breaks a constraint ({why}). Answer again."}]
                out.append((found, why))
            yield frame.assign(predicted=[o[0] for o in out], verdict=[o[1] for o in out])

    return prompts.mapInPandas(called, schema)


def known_candidates(lists: DataFrame, names: DataFrame, keys: list[str], candidates: str = "candidates") -> DataFrame:
    """lists with `known`, the distinct candidates (array of arrays of names) that are in the
    gazetteer, met in a join; keys tell the rows apart."""
    held = lists.select(*keys, F.explode(F.array_distinct(F.flatten(candidates))).alias("fqn")).join(names.select("fqn"), "fqn", "left_semi")
    found = held.groupBy(*keys).agg(F.array_sort(F.collect_set("fqn")).alias("known"))
    return lists.join(found, keys, "left").withColumn("known", F.coalesce("known", F.array().cast("array<string>")))


def not_done(prompts: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """The prompts that have no result yet."""
    return prompts.join(results.select(key), key, "left_anti")
