"""Aliases and variables to qualified names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_FREQUENCY = 10
# What calls return; a list gives the types of a tuple.
RETURNS = {
    "matplotlib.pyplot.subplots": ["matplotlib.figure.Figure", "matplotlib.axes.Axes"],
    "matplotlib.pyplot.subplot": "matplotlib.axes.Axes",
    "matplotlib.pyplot.figure": "matplotlib.figure.Figure",
    "matplotlib.pyplot.gcf": "matplotlib.figure.Figure",
    "pandas.read_csv": "pandas.DataFrame",
    "pandas.read_excel": "pandas.DataFrame",
    "pandas.DataFrame": "pandas.DataFrame",
    "numpy.array": "numpy.ndarray",
    "numpy.loadtxt": "numpy.ndarray",
    "pylab.figure.add_subplot": "matplotlib.axes.Axes",
    "matplotlib.figure.Figure.add_subplot": "matplotlib.axes.Axes",
    "matplotlib.axes.Axes.twinx": "matplotlib.axes.Axes",
    "numpy.fromfile": "numpy.ndarray",
    "pandas.DataFrame.pivot": "pandas.DataFrame",
    "pandas.to_datetime": "datetime.datetime",
    "numpy.cov": "numpy.ndarray",
    "pandas.read_table": "pandas.DataFrame",
    "pandas.DataFrame.from_dict": "pandas.DataFrame",
    "scipy.stats.uniform": "scipy.stats._continuous_distns.uniform_gen",
    "scipy.stats.uniform.pdf": "numpy.float64",
    "pylab.figure": "matplotlib.figure.Figure",
}


def with_imports(mention: Column, modules: Column) -> Column:
    """A mention by the post's imports (map alias -> modules): a name that is imported is its
    first module; else its first component is replaced if that is an alias."""
    first = F.substring_index(mention, ".", 1)
    last = F.substring_index(mention, ".", -1)
    module = lambda alias: F.get(F.try_element_at(modules, alias), F.lit(0))
    swapped = F.concat(module(first), F.substring(mention, F.length(first) + 1, F.length(mention)))
    return F.coalesce(module(last), F.when(F.instr(mention, ".") > 0, swapped), mention)


def source_chain(imports: DataFrame, assigns: DataFrame, key: str) -> DataFrame:
    """key, name, source, index (null for imports): the last one wins, assignments over
    imports."""
    a = imports.select(key, F.col("alias").alias("name"), F.col("module").alias("source"), F.lit(None).cast("int").alias("index"), F.struct(F.lit(0), "ord").alias("at"))
    b = assigns.select(key, F.col("variable").alias("name"), "source", "index", F.struct(F.lit(1), "ord").alias("at"))
    return a.unionByName(b).groupBy(key, "name").agg(F.max_by(F.struct("source", "index"), "at").alias("s")).select(key, "name", "s.source", "s.index")


def source_chain_of(found: DataFrame, key: str) -> DataFrame:
    """source_chain() of what code.read() gives, so that the code is read once."""
    row = lambda name, source, index, kind, x: F.struct(name.alias("name"), source.alias("source"), index.alias("index"), F.struct(F.lit(kind).alias("kind"), x["ord"].alias("ord")).alias("at"))
    rows = F.concat(
        F.transform("code.imports", lambda x: row(x["alias"], x["module"], F.lit(None).cast("int"), 0, x)),
        F.transform("code.assigns", lambda x: row(x["variable"], x["source"], x["index"], 1, x)),
    )
    each = found.select(key, F.explode(rows).alias("r")).select(key, "r.*")
    return each.groupBy(key, "name").agg(F.max_by(F.struct("source", "index"), "at").alias("s")).select(key, "name", "s.source", "s.index")


def _at(kind: str | list, index: int) -> str:
    if isinstance(kind, str):
        return kind
    return kind[index] if 0 <= index < len(kind) else "Unknown"


def _kind(name: str, chain: dict, returns: dict, known: dict) -> str | list:
    """What a name stands for: followed to its source, then back through calls and methods."""
    seen: set[str] = set()
    steps: list[int | str] = []
    while name not in seen:
        seen.add(name)
        if name in chain:
            source, index = chain[name]
            if index is None:
                name = source
                break
            steps.append(index)
            name = source
        elif "." in name:
            name, _, method = name.rpartition(".")
            steps.append(method)
        else:
            name = known.get(name, name)
            break
    kind: str | list = name
    for step in reversed(steps):
        if isinstance(step, int):
            kind = _at(returns.get(kind, kind) if isinstance(kind, str) else kind, step)
        else:
            full = f"{_at(kind, 0)}.{step}"
            kind = returns.get(full, full)
    return kind


def type_of(name: str, chain: dict, returns: dict = RETURNS, known: dict | None = None) -> str:
    """A name by the post's chain {name: (source, index or None)}: an import is its module,
    a variable what its call returns at its index, a dotted name its owner's type with the
    method behind it, and any other name what `known` (global aliases) has for it. A name
    that leads back to itself stays as it is, however long the way; of a tuple without an
    index the first type counts."""
    return _at(_kind(name, chain, returns, known or {}), 0)


def resolved(mention, chain, returns: dict = RETURNS, known=None) -> Column:
    """type_of() the first component of a mention, with the others behind it; chain is a
    map<string, struct<source, index>>, known a map<string, string>."""

    def of_rows(mentions: pd.Series, chains: pd.Series, aliases: pd.Series) -> pd.Series:
        out = []
        for m, c, k in zip(mentions, chains, aliases, strict=True):
            if m is None:
                out.append(None)
                continue
            sources = {k: (v["source"], None if v["index"] is None or v["index"] != v["index"] else int(v["index"])) for k, v in dict(c if c is not None else {}).items()}
            first, dot, rest = m.partition(".")
            out.append(type_of(first, sources, returns, dict(k if k is not None else {})) + dot + rest)
        return pd.Series(out, dtype="object")

    known = F.lit(None).cast("map<string,string>") if known is None else known
    return F.pandas_udf(of_rows, "string")(mention, chain, known)


def with_assigns(mentions: DataFrame, best: DataFrame, keys: list[str], returns: dict = RETURNS) -> DataFrame:
    """mentions (keys, mention, chain) with each mention in full: its first component by the
    post's code, where a name that leads nowhere is a global alias's name if there is one,
    then the global alias of what comes of it. Names that may be asked for meet best
    (alias, fqn) in a join; keys tell the rows apart."""
    first = lambda c: F.substring_index(c, ".", 1)
    sources = F.transform(F.map_values("chain"), lambda v: first(v["source"]))
    names = F.concat(F.array(first(F.col("mention"))), F.coalesce(sources, F.array().cast("array<string>")))
    asked = mentions.select(*keys, F.explode(F.array_distinct(names)).alias("alias"))
    met = asked.join(best, "alias").groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("alias", "fqn"))).alias("known"))
    rows = mentions.join(met, keys, "left").withColumn("mention", resolved("mention", "chain", returns, "known")).drop("known")
    return with_aliases(rows, best)


def best_alias(aliases: DataFrame, terms: DataFrame) -> DataFrame:
    """alias -> fqn: the first entry of each alias if it is frequent enough, longer than one
    character and no API term."""
    first = aliases.groupBy("alias").agg(F.min_by(F.struct("fqn", "freq"), "ord").alias("e")).select("alias", "e.fqn", "e.freq")
    usable = first.where((F.col("freq") >= LEAST_FREQUENCY) & (F.length("alias") > 1))
    return usable.join(terms.select(F.col("term").alias("alias")), "alias", "left_anti").select("alias", "fqn")


def with_aliases(mentions: DataFrame, best: DataFrame, column: str = "mention") -> DataFrame:
    """The first component of `column` replaced by its alias's name."""
    rows = mentions.withColumn("alias", F.substring_index(column, ".", 1)).join(best, "alias", "left")
    rest = F.substring(F.col(column), F.length("alias") + 1, F.length(column))
    return rows.withColumn(column, F.coalesce(F.concat(F.col("fqn"), rest), F.col(column))).drop("alias", "fqn")
