"""Joins by id with the reference tables of a run, and matches of names in texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key
from .matching import term_hits
from .shared import if_small


def overriding(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join in which the right side's columns win where they aren't null."""
    common = [c for c in right.columns if c in left.columns and c != key]
    own = right.select(key, *(F.col(c).alias(f"_r_{c}" if c in common else c) for c in right.columns if c != key))
    joined = left.join(own, key, "left")
    return joined.select(key, *(F.coalesce(f"_r_{c}", c).alias(c) if c in common else F.col(c) for c in left.columns if c != key), *(c for c in right.columns if c != key and c not in common))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new in the place of old ones with the same key; rows whose key only one side has stay."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def flagged(df: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """Adds 1 where the key is among ids, else 0."""
    return df.join(ids.select(key).distinct().withColumn("_in", F.lit(1)), key, "left").withColumn(name, F.coalesce("_in", F.lit(0))).drop("_in")


def with_unscored(scored: DataFrame, every: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """The scored rows, and those without a score with default values."""
    rest = every.join(scored.select(key), key, "left_anti")
    for name, value in defaults.items():
        rest = rest.withColumn(name, value)
    return scored.unionByName(rest, allowMissingColumns=True)


def merged_modes(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Full outer merge of runs; each mode's columns bear its name."""
    out = None
    for mode, df in frames.items():
        own = df.select(*keys, *(F.col(c).alias(f"{c}_{mode}") for c in df.columns if c not in keys))
        out = own if out is None else out.join(own, keys, "full_outer")
    return out


#: Aliases up to which each text is searched for each of them by an expression; beyond, by an automaton.
IN_ROW = 64


def aliases_of(names: DataFrame) -> DataFrame:
    """(name, ord, alias) of names (name, alias, ord, and kind if some are counties). A county's alias that doesn't say
    so counts only before "county" or "georgia"."""
    own = names.select("name", "ord", match_key(F.col("alias")).alias("alias"), (F.col("kind") if "kind" in names.columns else F.lit("")).alias("kind")).where("alias <> ''")
    short = (F.col("kind") == "county") & ~F.contains(F.col("alias"), F.lit("county"))
    forms = F.when(short, F.array(F.concat("alias", F.lit(" county")), F.concat("alias", F.lit(" georgia")))).otherwise(F.array("alias"))
    return own.select("name", "ord", F.explode(forms).alias("alias")).distinct()


def name_matches(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, limit: int | None = None) -> DataFrame:
    """(id, name, ord): names whose alias stands in a text as whole words. names: of `aliases_of`.

    Few aliases are looked for in each text; more by an automaton that reads a text once. limit: names of a document
    at most, by ord (the operator's cap on what it reports).
    """
    own = aliases_of(names)
    few = own.limit(IN_ROW + 1).collect()
    if len(few) <= IN_ROW:
        if not few:
            return texts.select(F.col(id_col).alias("id"), F.lit("").alias("name"), F.lit(0).alias("ord")).where("false")
        table = F.array(*(F.struct(F.lit(r.name).alias("name"), F.lit(r.ord).alias("ord"), F.lit(f" {r.alias} ").alias("alias")) for r in few))
        padded = texts.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), match_key(F.col(text_col)), F.lit(" ")).alias("t"))
        found = padded.select("id", F.explode(F.filter(table, lambda a: F.contains(F.col("t"), a["alias"]))).alias("a"))
        hits = found.groupBy("id", "a.name").agg(F.min("a.ord").alias("ord"))
    else:
        padded = texts.select(F.col(id_col).alias("id"), F.concat(F.lit(" "), match_key(F.col(text_col)), F.lit(" ")).alias("text"))
        found = term_hits(padded, own.select(F.concat(F.lit(" "), "alias", F.lit(" ")).alias("term")))
        hits = found.select("id", F.trim("term").alias("alias")).join(if_small(own), "alias").groupBy("id", "name").agg(F.min("ord").alias("ord"))
    if limit is None:
        return hits
    best = hits.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("ord", "name"))), 1, limit).alias("h"))
    return best.select("id", F.explode("h").alias("h")).select("id", "h.name", "h.ord")
