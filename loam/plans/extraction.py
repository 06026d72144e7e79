"""Posts to knowledge rows, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text, tokenizer
from loam.operators import aliases, code, completer, entities, knowledge, lexicon, linking, replies, segments, spans, tagging
from loam.sources.tables import stored


def mentions_of(tokens: DataFrame, key: str, tagger: tagging.Tagger) -> DataFrame:
    """Tagged tokens: key, sent_idx, mention_idx (running over the post), at (the token's
    place in the post), start, end and mention, the token without arguments and subscripts."""
    held = tokens.groupBy(key, "sent_idx").agg(F.array_sort(F.collect_list(F.struct("at", "token", "start", "end"))).alias("t"))
    tags = tagging.tagged(F.transform("t", lambda x: x["token"]), tagger)
    rows = held.select(key, "sent_idx", F.explode(F.arrays_zip("t", tags.alias("tag"))).alias("x")).where("x.tag = 1").select(key, "sent_idx", "x.t.*")
    return rows.select(
        key,
        "sent_idx",
        (F.row_number().over(Window.partitionBy(key).orderBy("at")) - 1).alias("mention_idx"),
        "at",
        "start",
        "end",
        F.ltrim(text.normalised_mention(F.col("token")), F.lit(".")).alias("mention"),
    )


def source_maps(found: DataFrame, key: str) -> DataFrame:
    """key, chain (where each name of a post's code comes from) and modules (of each import), of
    what code.read() gives."""
    imports = found.select(key, F.explode("code.imports").alias("i")).select(key, "i.*")
    chain = aliases.source_chain_of(found, key)
    chains = chain.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("source", "index")))).alias("chain"))
    modules = code.alias_map(imports, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("alias", "modules"))).alias("modules"))
    return chains.join(modules, key, "left")


def in_full(mentions: DataFrame, found: DataFrame, key: str, best: DataFrame | None) -> DataFrame:
    """mentions by their post's imports, then by its assignments and the global aliases; found:
    what code.read() gives."""
    rows = mentions.join(source_maps(found, key), key, "left").withColumn("mention", aliases.with_imports(F.col("mention"), F.col("modules")))
    if best is None:
        rows = rows.withColumn("mention", aliases.resolved("mention", "chain"))
    else:
        rows = aliases.with_assigns(rows, best, [key, "mention_idx"])
    return rows.drop("chain", "modules")


def asked(sentences: DataFrame, mentions: DataFrame, ranked: DataFrame, names: DataFrame, key: str, linker: completer.Completer) -> DataFrame:
    """key, mention_idx, fqn as the linker says: one prompt a post, with the candidates of
    its mentions in their order and the suffixes they must have. Where the answer is no
    candidate the mention has no row."""
    lists = ranked.groupBy(key, "mention_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "fqn"))), lambda c: c["fqn"]).alias("fqns"))
    wanted = linking.longest_suffix(mentions.select("mention"), names)
    each = mentions.join(wanted, "mention").join(lists, [key, "mention_idx"], "left")
    each = each.select(key, F.struct("mention_idx", "mention", "constraint", F.coalesce("fqns", F.array().cast("array<string>")).alias("fqns")).alias("m"))
    posts = each.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))
    shown = sentences.where("kind = 'Text'").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "content"))), lambda s: s["content"]), " ").alias("post"))
    part = lambda name: F.transform("m", lambda x: x[name])
    prompts = posts.join(shown, key).select(
        key,
        completer.messages("link_candidates", post=F.col("post"), mentions=F.array_join(part("mention"), ", "), candidates=text.numbered_lists(part("fqns"))).alias("messages"),
        part("mention").alias("mentions"),
        part("constraint").alias("constraints"),
        F.array_distinct(F.flatten(part("fqns"))).alias("known"),  # candidates come from the gazetteer
    )
    answered = completer.constrained(prompts, linker).where("verdict NOT IN ('count', 'failed')")
    return answered.select(key, "known", F.posexplode("predicted").alias("mention_idx", "fqn")).where(F.array_contains("known", F.col("fqn"))).drop("known")


def context_marks(sentences: DataFrame, found: DataFrame, names: DataFrame, key: str, explainer: completer.Completer) -> DataFrame:
    """key, sent_idx, start, end, entity: phrases that depend on context, but for those that
    corefer to something else in their sentence."""
    shown = sentences.where("kind = 'Text'").withColumn("content", tokenizer.cleaned("content"))
    shown = lexicon.with_verbs(shown, [key, "sent_idx"], "content", stored(lexicon.lexicon(shown, "content"), "lexicon"))
    chunks = shown.select(key, "sent_idx", F.explode(entities.chunked("content", "verbs")).alias("c")).select(key, "sent_idx", "c.*")
    assigned = found.select(key, F.explode("code.assigns").alias("a")).select(key, F.col("a.variable").alias("name"))
    variables = entities.own_variables(assigned, linking.terms(names).select(F.col("term").alias("name")), key)
    found = entities.candidates(chunks, variables, key).groupBy(key, "sent_idx").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("found"))
    marked = found.join(shown.select(key, "sent_idx", "content"), [key, "sent_idx"])
    marked = marked.withColumn("messages", completer.messages("coreference", marked=spans.marked(F.col("content"), F.col("found"))))
    chained = completer.completed(marked, explainer).withColumn("chains", replies.chains(F.col("reply")))
    all_ = F.transform("found", lambda x: x["text"])
    kept = F.filter("found", lambda x: F.col("chains").isNull() | entities.kept_by_chains(x["text"], F.col("chains"), all_))
    return chained.select(key, "sent_idx", F.explode(kept).alias("e")).select(key, "sent_idx", "e.start", "e.end", F.col("e.text").alias("entity"))


def explained(marks: DataFrame, sentences: DataFrame, key: str, explainer: completer.Completer) -> DataFrame:
    """marks (key, completion_idx, sent_idx, entity) with their context: a call for each
    sentence, with the text of the whole post."""
    shown = sentences.where("kind = 'Text'")
    posts = shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", "content"))), lambda s: s["content"]), " ").alias("context"))
    phrases = marks.groupBy(key, "sent_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("completion_idx", "entity"))), lambda s: s["entity"]), ", ").alias("phrases"))
    rows = phrases.join(shown.select(key, "sent_idx", F.col("content").alias("sentence")), [key, "sent_idx"]).join(posts, key)
    done = entities.complete(rows, explainer).select(key, "sent_idx", F.explode("completions").alias("c"))
    values = done.groupBy(key, "sent_idx", F.col("c.NP").alias("entity")).agg(F.min("c.Value").alias("context"))
    return marks.join(values, [key, "sent_idx", "entity"], "left").select(key, "completion_idx", "entity", F.coalesce("context", F.lit("")).alias("context"))


def extract(
    posts: DataFrame,
    names: DataFrame,
    key: str = "post_id",
    html: str = "html",
    tagger: tagging.Tagger | None = None,
    best: DataFrame | None = None,
    similarities: DataFrame | None = None,
    linker: completer.Completer | None = None,
    explainer: completer.Completer | None = None,
    alias: bool = True,
    typo: bool = True,
    rank: bool = True,
) -> DataFrame:
    """key, snippet_idx, api, snippet: each mention's sentence with its names in full.

    names is a gazetteer. A mention is resolved by its post's code and the global aliases
    `best` (unless alias is off), and met with the gazetteer: itself if it is a name, else
    fuzzy candidates (unless typo is off; `similarities` go before the measure), in order of
    nearness over the whole post (unless rank is off). The linker picks from them under the
    suffix constraints, or the first is taken; without a candidate the mention stays. With
    an explainer, phrases that depend on context are marked and their context is added.
    """
    sentences = stored(segments.sentences(segments.segments(posts, key, html), key), "sentences")
    tokens = segments.tokens(sentences, key)
    tokens = stored(tokens.withColumn("at", F.row_number().over(Window.partitionBy(key).orderBy("sent_idx", "pos")) - 1), "tokens")
    read = stored(code.read(segments.thread_blocks(posts, key, html), key), "code")
    mentions = mentions_of(tokens, key, tagger or tagging.RuleTagger())
    if alias:
        mentions = in_full(mentions, read, key, best)
    mentions = stored(mentions, "mentions")

    found = mentions.select(key, "mention_idx", "mention", F.col("at").alias("pos")).join(linking.link(mentions, names, typo, known=similarities), "mention")
    candidates = found.select(key, "mention_idx", "cand_ord", "fqn")
    if rank:
        words = tokens.select(key, F.col("at").alias("pos"), text.normalised_mention(F.col("token")).alias("token"))
        ranked = linking.nearness(words, mentions.select(key, "mention_idx", F.col("at").alias("pos")), candidates, key)
    else:
        ranked = candidates.withColumn("rank", F.col("cand_ord"))
    ranked = stored(ranked.select(key, "mention_idx", "fqn", "rank"), "candidates")
    if linker is None:
        chosen = ranked.where("rank = 1").select(key, "mention_idx", "fqn")
    else:
        chosen = asked(sentences, mentions, ranked, names, key, linker)
    linked = stored(mentions.join(chosen, [key, "mention_idx"], "left").select(key, "mention_idx", F.coalesce("fqn", "mention").alias("fqn")), "linked")

    mark = lambda rows, kind, entity: rows.select(key, "sent_idx", F.struct("start", "end", F.lit(kind).alias("type"), entity.alias("entity")).alias("mark"))
    marks = mark(mentions, "API", F.lit(None).cast("string"))
    if explainer is not None:
        marks = marks.unionByName(mark(context_marks(sentences, read, names, key, explainer), "context", F.col("entity")))
    marks = stored(marks.groupBy(key, "sent_idx").agg(spans.outermost(F.array_sort(F.collect_list("mark"))).alias("marks")), "marks")
    shown = sentences.where("kind = 'Text'").withColumn("content", tokenizer.cleaned("content")).join(marks, [key, "sent_idx"])
    snippets = shown.select(key, F.col("sent_idx").alias("snippet_idx"), spans.coloured(F.col("content"), F.col("marks")).alias("html"))
    inside = marks.select(key, "sent_idx", F.explode("marks").alias("m")).where("m.type = 'context'").select(key, "sent_idx", "m.start", "m.entity")
    order = Window.partitionBy(key).orderBy("sent_idx", "start")
    inside = inside.select(key, "sent_idx", "entity", (F.row_number().over(order) - 1).alias("completion_idx"))
    if explainer is None:
        completions = inside.select(key, "completion_idx", "entity", F.lit("").alias("context"))
    else:
        completions = explained(inside, sentences, key, explainer)
    return knowledge.organise(snippets, linked, completions, key)
