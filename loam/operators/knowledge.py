"""The knowledge table: rows of (api, knowledge), how they are made, stored and found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import ordinals

FIRST = 5


def organise(snippets: DataFrame, linked: DataFrame, completions: DataFrame, key: str, slab: int = ordinals.SLAB) -> DataFrame:
    """key, snippet_idx, api, snippet: one row for each linked mention.

    snippets: key, snippet_idx (from 0), html with red and blue mentions. linked: key,
    mention_idx, fqn. completions: key, completion_idx, entity, context. A mention or
    completion belongs to the snippet in which the thread's running count of red or blue
    mentions reaches its index; mentions without a linked name stay as they are, and of
    several names of an index the least counts.

    A thread is cut into slabs of snippets, so it may be as long as it likes: names and notes
    are put to their slab by the slabs' totals, and meet its snippets by key and slab. Rows
    without a key have no thread and go.
    """
    count = lambda found: F.size(found).cast("long")
    sums = {"reds": F.col("red"), "blues": F.col("blue")}
    rows = snippets.where(F.col(key).isNotNull()).select(key, F.col("snippet_idx").cast("long").alias("at"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"red": count(T.red_mentions(F.col("html"))), "blue": count(T.blue_mentions(F.col("html")))})
    before = ordinals.starts(rows, [key], "at", sums, slab)

    def dealt(items: DataFrame, index: str, value: Column, name: str) -> DataFrame:
        items = items.where(F.col(key).isNotNull()).select(key, F.col(index).cast("long").alias("at"), value.alias("value"))
        held = F.sort_array(F.collect_set(F.struct("at", "value"))).alias(f"{name}_held")
        return ordinals.slab_of(items, [key], "at", name, before, slab).groupBy(key, "slab_").agg(held)

    note = F.concat(F.lit("\n'"), "entity", F.lit("' refers to "), "context")
    names, notes = dealt(linked, "mention_idx", F.col("fqn"), "reds"), dealt(completions, "completion_idx", note, "blues")
    met = ordinals.running(rows, [key], "at", sums, before, slab).join(names, [key, "slab_"], "left").join(notes, [key, "slab_"], "left")

    def own(held: str, first: str, n: str) -> Column:
        """The values of a snippet's indexes, null where there is none."""
        at = lambda i: F.get(F.filter(held, lambda x: x["at"] == F.col(first) + i), F.lit(0))["value"]
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col(n) - 1), at)).otherwise(F.array().cast("array<string>"))

    each = met.select(key, "at", "html", own("reds_held", "reds", "red").alias("names"), own("blues_held", "blues", "blue").alias("notes"))
    shown = T.without_highlights(T.replace_red(F.col("html"), F.col("names")))
    shown = F.concat(shown, F.array_join("notes", ""))
    index = F.col("at").cast(snippets.schema["snippet_idx"].dataType).alias("snippet_idx")
    each = each.select(key, index, F.array_compact("names").alias("names"), shown.alias("snippet"))
    return each.select(key, "snippet_idx", F.explode("names").alias("api"), "snippet")


def storable(rows: DataFrame) -> DataFrame:
    """(api, knowledge) of rows (api, snippet), trimmed, without highlights; empty ones go."""
    trimmed = rows.select(F.trim("api").alias("api"), F.trim("snippet").alias("snippet")).where("api <> '' AND snippet <> ''")
    return trimmed.select("api", T.without_highlights(F.col("snippet")).alias("knowledge"))


def by_api(knowledge: DataFrame, api: str, first: int = FIRST) -> DataFrame:
    """The first rows of an API, in order of their text; none for a blank name."""
    return knowledge.where(F.col("api") == api.strip()).where(F.lit(api.strip() != "")).orderBy("api", "knowledge").limit(first)


def by_keyword(knowledge: DataFrame, word: str, first: int = FIRST, literal: bool = False) -> DataFrame:
    """The first rows whose text has a word; % and _ are wildcards unless literal."""
    text = F.col("knowledge")
    found = F.contains(text, F.lit(word)) if literal else text.like(f"%{word}%")
    return knowledge.where(found).where(F.lit(word.strip() != "")).orderBy("api", "knowledge").limit(first)


def feedback_rows(stored: DataFrame, new: DataFrame) -> DataFrame:
    """new (feedback) with the ids that follow the stored ones, in the order of their text, and
    the time. Ids come from range partitions and their lengths, never from one task."""
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top"))
    rows = ordinals.numbered(ordinals.placed(new.select("feedback"), ["feedback"]), [])
    return rows.join(F.broadcast(top)).select((F.col("ordinal") + 1 + F.col("top")).alias("id"), F.current_timestamp().alias("ts"), "feedback")
