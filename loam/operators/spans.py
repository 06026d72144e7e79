"""Span algebra: arrays of struct<start,end[,type]>, half-open code-point spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import BLUE_OPEN, RED_OPEN, SPAN_CLOSE


def outermost(spans: Column, duplicates: str = "one") -> Column:
    """Spans that lie in no other span. Equal spans count once, or, with duplicates="none",
    delete each other."""

    def inside(x: Column, y: Column) -> Column:
        within = (y["start"] <= x["start"]) & (x["end"] <= y["end"])
        return within & ((y["start"] != x["start"]) | (y["end"] != x["end"]))

    kept = F.filter(spans, lambda x: ~F.exists(spans, lambda y: inside(x, y)))
    if duplicates == "none":
        same = lambda x: F.size(F.filter(spans, lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"])))
        return F.filter(kept, lambda x: same(x) == 1)
    return F.array_distinct(kept)


def outermost_rows(spans: DataFrame, key: str) -> DataFrame:
    """outermost() for spans in rows (key, start, end): in order of start, the longer first,
    a span lies in another if one before it ends no earlier."""
    before = Window.partitionBy(key).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(key, "start", "end").distinct()
    reached = F.max(F.when(F.col("start").isNotNull(), F.col("end"))).over(before)
    return spans.withColumn("reached", reached).where("coalesce(reached < end, true)").drop("reached")


def _spliced(text: Column, spans: Column, wrap) -> Column:
    """text with each span wrapped: in order of start, what lies before each span and the
    span. Where spans overlap without lying in each other, from the last to the first, so
    that marks go in at the places that the text then has."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s.alias("span"))))
    before = lambda k: F.coalesce(F.get(ordered, k - 1)["end"], F.lit(0))
    inner = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    pieces = F.transform(ordered, lambda s, k: F.concat(F.substring(text, before(k) + 1, s["start"] - before(k)), wrap(inner(s), s["span"])))
    rest = F.substring(text, before(F.size(ordered)) + 1, F.length(text))
    apart = F.concat(F.array_join(pieces, ""), rest)

    def step(done: Column, s: Column) -> Column:
        inside = F.substring(done, s["start"] + 1, s["end"] - s["start"])
        return F.concat(F.substring(done, F.lit(1), s["start"]), wrap(inside, s["span"]), F.substring(done, s["end"] + 1, F.length(done)))

    crossed = F.exists(F.transform(ordered, lambda s, k: s["start"] < before(k)), lambda x: x)
    return F.when(crossed, F.aggregate(F.reverse(ordered), text, step)).otherwise(apart)


def marked(text: Column, spans: Column, opening: str = "</BEGIN>", closing: str = "<END/>") -> Column:
    """text with the outermost spans between marks."""
    return _spliced(text, outermost(spans), lambda inner, _: F.concat(F.lit(opening), inner, F.lit(closing)))


def coloured(text: Column, spans: Column) -> Column:
    """text with outermost spans of type API in red, others in blue."""
    colour = lambda s: F.when(s["type"] == "API", RED_OPEN).otherwise(BLUE_OPEN)
    return _spliced(text, outermost(spans), lambda inner, s: F.concat(F.lit("<strong>"), colour(s), inner, F.lit(SPAN_CLOSE + "</strong>")))


def mentions(text: Column, labels: Column, kind: str = "Mention") -> Column:
    """The labelled stretches of one type, with their places."""
    wanted = F.filter(labels, lambda x: x["type"] == kind)
    return F.transform(
        wanted, lambda x: F.struct(F.substring(text, x["start"] + 1, x["end"] - x["start"]).alias("surface"), x["start"].alias("start"), x["end"].alias("end"))
    )


def token_places(tokens: DataFrame, key: str | list[str], order: str = "pos") -> DataFrame:
    """start and end of each token in the text that joins a key's tokens by one character."""
    running = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("token") + 1).over(running) - 1
    return tokens.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("token"))


def mention_tokens(tokens: DataFrame, mentions_: DataFrame, key: str) -> DataFrame:
    """The first token of each mention, by places: key, mention_idx, pos."""
    m, t = mentions_.alias("m"), tokens.alias("t")
    overlap = (F.col(f"m.{key}") == F.col(f"t.{key}")) & (F.col("t.start") < F.col("m.end")) & (F.col("m.start") < F.col("t.end"))
    return m.join(t, overlap).groupBy(F.col(f"m.{key}").alias(key), "m.mention_idx").agg(F.min("t.pos").alias("pos"))
