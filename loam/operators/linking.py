"""Candidates for mentions: exact, fuzzy, ranked by nearness, cut to known suffixes."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.similarity import PREFIX_MOST, PREFIX_WEIGHT, jaro_winkler, jaro_winkler_similarity
from loam.sources.tables import stored

TOP = 20
#: Places of a score; the similarity at which names are fetched first.
PLACES, LEVEL = 12, 0.8
#: Mentions times tails up to which finding the near ones costs more than scoring them all.
DIRECT = 1 << 18
#: Letters in order from rare to common; all others are rarer.
COMMON_LETTERS = "jqxzwvkfybhgmpudclotnraise"


def gazetteer(names: DataFrame, name: str = "fqn") -> DataFrame:
    """fqn, parts and depth of each distinct name."""
    parts = F.split("fqn", r"\.", -1)
    return names.select(F.col(name).alias("fqn")).where("fqn IS NOT NULL").distinct().select("fqn", parts.alias("parts"), F.size(parts).alias("depth"))


def terms(names: DataFrame) -> DataFrame:
    """Distinct dotted components."""
    return names.select(F.explode("parts").alias("term")).distinct()


def exact(mentions: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions that are names, the others)."""
    known = names.select(F.col("fqn").alias("mention"))
    return mentions.join(known, "mention", "left_semi"), mentions.join(known, "mention", "left_anti")


def same_block(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs whose last components begin with the same two characters, case aside."""

    def block(c: str) -> Column:
        return F.lower(F.substring(F.element_at(F.split(F.col(c), r"\.", -1), -1), 1, 2))

    return mentions.withColumn("block", block("mention")).join(names.select("fqn", block("fqn").alias("block")), "block").drop("block")


def similarities(asked: DataFrame, terms_: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """part, term, sim of the distinct pairs whose similarity reaches the part's floor (and 0 is
    reached by none). asked: part, floor. known (a, b, sim): what a term's similarity to a
    part is instead of the measure.

    A pair of similarity s has a Jaro value of (s - w) / (1 - w) or more, where w is the most
    that the prefix adds, and that takes a number of shared letters. So among so many of the
    part's rarest letters that fewer than this number are left, one is in the term: an equi-join
    on (letter, its how-manieth), and each pair is scored once.
    """
    w = PREFIX_WEIGHT * PREFIX_MOST

    def numbered(text: str) -> list[str]:
        seen: Counter[str] = Counter()
        out = []
        for c in text:
            out.append(f"{c}{seen[c]}")
            seen[c] += 1
        return sorted(out, key=lambda x: (COMMON_LETTERS.find(x[0]), x))

    @F.pandas_udf("array<string>")
    def every(texts: pd.Series) -> pd.Series:
        return texts.map(numbered)

    @F.pandas_udf("array<string>")
    def rarest(texts: pd.Series, floors: pd.Series) -> pd.Series:
        def of(text: str, floor: float) -> list[str]:
            jaro = (floor - w) / (1 - w) - 1e-9
            shortest = max(1, math.ceil((3 * jaro - 2) * len(text)))
            shared = max(1, math.ceil((3 * jaro - 1) * len(text) * shortest / max(1, len(text) + shortest) - 1e-9))
            return numbered(text)[: len(text) - shared + 1]

        return pd.Series([of(*x) for x in zip(texts, floors, strict=True)])

    left = asked.select("part", "floor", F.explode(rarest("part", "floor")).alias("letter"))
    right = terms_.select("term", F.explode(every("term")).alias("letter"))
    shorter, longer = F.least(F.length("part"), F.length("term")), F.greatest(F.length("part"), F.length("term"))
    near = left.join(right, "letter").where(shorter >= (3 * ((F.col("floor") - w) / (1 - w)) - 2) * longer - 1e-6)
    pairs = near.select("part", "floor", "term").distinct()
    if known is not None:
        pairs = pairs.join(known.select(F.col("a").alias("term"), F.col("b").alias("part")), ["term", "part"], "left_anti")
    pairs = pairs.select("part", "floor", "term", jaro_winkler_similarity("term", "part").alias("sim"))
    if known is not None:
        met = known.select(F.col("a").alias("term"), F.col("b").alias("part"), F.col("sim").cast("double").alias("sim"))
        pairs = pairs.unionByName(met.join(asked, "part").join(terms_, "term", "left_semi").select("part", "floor", "term", "sim"))
    return pairs.where("sim > 0 AND sim >= floor").select("part", "term", "sim")


def _tails(names: DataFrame, lengths: DataFrame) -> DataFrame:
    """fqn, k, tail: the last k components of every name, for each wanted k."""
    tails = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(k.alias("k"), F.slice(F.col("parts"), -k, k).alias("tail")))
    return names.select("fqn", F.explode(tails).alias("t")).select("fqn", "t.*").join(lengths, "k", "left_semi")


def _fetched(asked: DataFrame, tails: DataFrame, known: DataFrame | None) -> DataFrame:
    """mention, tail, score: the tails of which a component reaches the mention's floor
    (mention, k, parts, floor), by posting lists of components in their places."""
    places = asked.select("mention", "k", "parts", "floor", F.posexplode("parts").alias("place", "part"))
    wanted = places.groupBy("part").agg(F.min("floor").alias("floor"))
    lists = tails.select("k", "tail", F.posexplode("tail").alias("place", "term"))
    pairs = similarities(wanted, lists.select("term").distinct(), known)
    reached = places.join(pairs, "part").where(F.col("sim") >= F.col("floor"))
    met = reached.join(lists, ["k", "place", "term"]).select("mention", "parts", "tail").distinct()
    if known is None:
        return met.select("mention", "tail", _mean_similarity("tail", "parts").alias("score"))
    each = met.select("mention", "tail", F.explode(F.arrays_zip(F.col("tail").alias("a"), F.col("parts").alias("b"))).alias("p")).select("mention", "tail", "p.*")
    sims = each.select("a", "b").distinct().join(known.select("a", "b", F.col("sim").cast("double").alias("sim")), ["a", "b"], "left")
    sims = sims.select("a", "b", F.coalesce("sim", jaro_winkler_similarity("a", "b")).alias("sim"))
    return each.join(sims, ["a", "b"]).groupBy("mention", "tail").agg(F.round(F.avg("sim"), PLACES).alias("score"))


def _mean_similarity(tail: str, parts: str) -> Column:
    def means(tails: pd.Series, mentions: pd.Series) -> pd.Series:
        memory: dict[tuple[str, str], float] = {}

        def sim(pair: tuple[str, str]) -> float:
            if pair not in memory:
                memory[pair] = jaro_winkler(*pair)
            return memory[pair]

        return pd.Series([round(sum(map(sim, zip(a, b, strict=True))) / len(a), PLACES) for a, b in zip(tails, mentions, strict=True)], dtype="float64")

    return F.pandas_udf(means, "double")(tail, parts)


def fuzzy(mentions: DataFrame, names: DataFrame, top: int = TOP, known: DataFrame | None = None, level: float = LEVEL, direct: int = DIRECT) -> DataFrame:
    """mention, fqn, score, rank: the names whose score is among a mention's `top` highest
    distinct scores (to 12 places). The score of a name at least as deep as the mention is the
    mean similarity of its last components to the mention's. known (a, b, sim, from 0 to 1):
    similarities of a name's component to a mention's that come before the measure.

    A threshold algorithm over posting lists. A name none of whose components reaches x
    scores below x. So first the names with a component at `level` are fetched; the last of a
    mention's `top` scores among them, where it is below the level, is what one component of
    any better name has to reach, and the names that have one are fetched. Names that share
    their last components are one tail until the end. Only mentions that find fewer than
    `top` scores above 0 take all other names, whose score is 0. Both tables are counted
    first: of at most `direct` mentions times tails, all are scored at once.
    """
    asked = mentions.select("mention").where("mention IS NOT NULL").distinct().withColumn("parts", F.split("mention", r"\.", -1))
    asked = stored(asked.withColumn("k", F.size("parts")), "mentions")
    named = _tails(names, asked.select("k").distinct())
    tails = stored(named.select("k", "tail").distinct(), "tails")
    place = F.dense_rank().over(Window.partitionBy("mention").orderBy(F.desc("score")))
    best = lambda rows: rows.withColumn("rank", place).where(F.col("rank") <= top)
    first, rest = None, asked.withColumn("floor", F.lit(0.0))
    small = asked.count() * tails.count() <= direct
    if small and known is None:
        every = asked.join(tails, "k").select("mention", "tail", _mean_similarity("tail", "parts").alias("score"))
        return best(every).join(named.select("fqn", "tail"), "tail").select("mention", "fqn", "score", "rank")
    if not small:
        first = stored(best(_fetched(asked.withColumn("floor", F.lit(level)), tails, known)), "near")
        last = first.groupBy("mention").agg(F.max("rank").alias("levels"), F.min("score").alias("least"))
        floor = F.when(F.col("levels") >= top, F.col("least")).otherwise(0.0)
        rest = asked.join(last, "mention", "left").select("mention", "k", "parts", floor.alias("floor")).where(F.col("floor") < level)
        rest = stored(rest, "open")
    found = stored(best(_fetched(rest, tails, known)), "far")
    lacking = rest.where("floor = 0").join(found.groupBy("mention").agg(F.max("rank").alias("levels")), "mention", "left")
    lacking = lacking.withColumn("levels", F.coalesce("levels", F.lit(0))).where(F.col("levels") < top)
    none = lacking.select("mention", "k", (F.col("levels") + 1).alias("rank")).join(tails, "k").join(found, ["mention", "tail"], "left_anti")
    found = found.unionByName(none.select("mention", "tail", F.lit(0.0).alias("score"), "rank"))
    if first is not None:
        found = found.unionByName(first.join(rest, "mention", "left_anti"))
    return found.join(named.select("fqn", "tail"), "tail").select("mention", "fqn", "score", "rank")


def nearness(tokens: DataFrame, mentions: DataFrame, candidates: DataFrame, key: str | list[str]) -> DataFrame:
    """candidates (key, mention_idx, cand_ord, fqn) with score and rank: each other token's
    dotted entry that is a component of the candidate adds 1 / distance; ties keep their
    candidate order. tokens: key, pos, token (normalised). mentions: key, mention_idx, pos.
    key: the column, or columns, of the text."""
    keys = [key] if isinstance(key, str) else list(key)
    entries = tokens.select(*keys, F.col("pos").alias("at"), F.explode(F.split("token", r"\.")).alias("entry"))
    components = candidates.select(*keys, "mention_idx", "cand_ord", F.explode(F.array_distinct(F.split("fqn", r"\."))).alias("entry"))
    placed = components.join(mentions.select(*keys, "mention_idx", "pos"), [*keys, "mention_idx"])
    near = placed.join(entries, [*keys, "entry"]).where("at <> pos")
    sums = near.groupBy(*keys, "mention_idx", "cand_ord").agg(F.sum(1 / F.abs(F.col("at") - F.col("pos"))).alias("score"))
    scored = candidates.join(sums, [*keys, "mention_idx", "cand_ord"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    order = Window.partitionBy(*keys, "mention_idx").orderBy(F.desc("score"), "cand_ord")
    return scored.withColumn("rank", F.row_number().over(order))


def by_rarest_part(tokens: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fqn, pos: the names whose rarest component (that of the fewest names, then the
    least) is a token of the text, and where it first is. A component that many names share
    fetches none of them."""
    parts = names.select("fqn", F.explode(F.array_distinct("parts")).alias("term"))
    shared = parts.groupBy("term").agg(F.count("*").alias("names"))
    rarest = parts.join(shared, "term").groupBy("fqn").agg(F.min(F.struct("names", "term")).alias("least")).select("fqn", F.col("least.term").alias("token"))
    return tokens.join(rarest, "token").groupBy(*keys, "fqn").agg(F.min("pos").alias("pos"))


def suffixes(names: DataFrame) -> DataFrame:
    """Every dotted suffix of every name, once."""
    ends = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.array_join(F.slice(F.col("parts"), -k, k), "."))
    return names.select(F.explode(ends).alias("suffix")).distinct()


def longest_suffix(mentions: DataFrame, names: DataFrame) -> DataFrame:
    """mention and the suffix that its components reach from right to left: a component is
    taken if it and what is taken already end some name, else it is passed over.

    What can be taken at all begins and ends with components of the mention and holds no
    others: one equi-join fetches these suffixes for distinct mentions, and a fold over the
    components picks from them, to any depth.
    """
    parts, size = F.split("mention", r"\.", -1), F.size("parts")
    wanted = mentions.select("mention").distinct().withColumn("parts", parts)
    behind = lambda i: F.transform(F.sequence(i, size), lambda k: F.struct(F.get("parts", i - 1).alias("first"), F.get("parts", k - 1).alias("last")))
    ends = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), size), behind)))
    asked = wanted.where("mention IS NOT NULL").select("mention", "parts", F.explode(ends).alias("e")).select("mention", "parts", "e.*")
    known = suffixes(names).withColumn("own", F.split("suffix", r"\.", -1))
    known = known.select("suffix", "own", F.element_at("own", 1).alias("first"), F.element_at("own", -1).alias("last"))
    met = asked.join(known, ["first", "last"]).where(F.size(F.array_except("own", "parts")) == 0)
    held = met.groupBy("mention").agg(F.collect_set("suffix").alias("held"))

    def step(taken, part):
        tried = F.when(taken == "", part).otherwise(F.concat(part, F.lit("."), taken))
        return F.when(F.array_contains("held", tried), tried).otherwise(taken)

    reached = F.when(F.col("held").isNotNull(), F.aggregate(F.reverse("parts"), F.lit(""), step))
    return wanted.join(held, "mention", "left").select("mention", F.coalesce(reached, F.lit("")).alias("constraint"))


def link(mentions: DataFrame, names: DataFrame, typo: bool = True, top: int = TOP, known: DataFrame | None = None) -> DataFrame:
    """Candidates of distinct mentions: the name itself if there is one, else fuzzy ones
    (unless typo is off)."""
    hit, missed = exact(mentions.select("mention").distinct(), names)
    found = hit.select("mention", F.col("mention").alias("fqn"), F.lit(1.0).alias("score"))
    if typo:
        found = found.unionByName(fuzzy(missed, names, top, known=known).drop("rank"))
    order = Window.partitionBy("mention").orderBy(F.desc("score"), "fqn")
    return found.withColumn("cand_ord", F.row_number().over(order))
