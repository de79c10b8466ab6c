"""Group-by questions over a table of entities: counts, sums, medians, having, concentration, listings, mixes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def not_blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""


def group_counts(df: DataFrame, group: str, ascending: bool = False, only_one: bool = False, limit: int | None = None) -> DataFrame:
    """(group, count), blank groups left out; ties by name."""
    out = df.where(not_blank(group)).groupBy(group).agg(F.count("*").alias("count"))
    out = out.where("count = 1") if only_one else out
    out = out.orderBy(F.asc("count") if ascending else F.desc("count"), group)
    return out if limit is None else out.limit(limit)


def group_numbers(df: DataFrame, group: str, value: str, metric: str = "sum", limit: int | None = None) -> DataFrame:
    own = df.where(not_blank(group) & F.col(value).isNotNull()).groupBy(group).agg((F.sum(value) if metric == "sum" else F.avg(value)).alias(metric))
    out = own.orderBy(F.desc(metric), group)
    return out if limit is None else out.limit(limit)


def extremes(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: least and greatest value and who has them, ties to the first name."""
    own = df.where(F.col(value).isNotNull())
    return own.agg(F.min(value).alias("min_value"), F.min_by(name, F.struct(value, name)).alias("min_name"), F.max(value).alias("max_value"), F.min_by(name, F.struct(-F.col(value), F.col(name))).alias("max_name"))


def groups_having_all(df: DataFrame, group: str, value: str, wanted: list[str]) -> DataFrame:
    """Groups that have every wanted value."""
    own = df.where(not_blank(group) & F.col(value).isin(*wanted)).groupBy(group).agg(F.count_distinct(value).alias("n"))
    return own.where(F.col("n") == len(set(wanted))).select(group)


def multi_valued(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups with more than one distinct value, and the values."""
    return df.where(not_blank(value)).groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias("values"), F.count_distinct(value).alias("n")).where("n > 1")


def single_members(df: DataFrame, group: str, name: str) -> DataFrame:
    return df.where(not_blank(group)).groupBy(group).agg(F.count("*").alias("n"), F.min(name).alias("only")).where("n = 1").select(group, "only")


def concentration(df: DataFrame, group: str, within: str) -> DataFrame:
    """(group, n, distinct, top, share): a group's most frequent value of `within` and its share; ties to the first."""
    counts = df.where(not_blank(within)).groupBy(group, within).agg(F.count("*").alias("c"))
    out = counts.groupBy(group).agg(F.sum("c").alias("n"), F.count("*").alias("distinct"), F.min_by(within, F.struct(-F.col("c"), F.col(within))).alias("top"), F.max("c").alias("most"))
    return out.select(group, "n", "distinct", "top", (F.col("most") / F.col("n")).alias("share"))


def listing(df: DataFrame, group: str, name: str, preview: int | None = None) -> DataFrame:
    """(group, names, more): a group's distinct names in order, the first `preview` of them, and how many more."""
    own = df.where(not_blank(group)).groupBy(group).agg(F.array_sort(F.collect_set(name)).alias("_all"))
    cut = F.col("_all") if preview is None else F.slice("_all", 1, preview)
    return own.select(group, F.array_join(cut, "; ").alias("names"), (F.size("_all") - F.size(cut)).cast("long").alias("more"))


def mix(df: DataFrame, group: str, value: str, limit: int = 3) -> DataFrame:
    """(group, mix): a group's most frequent values with their counts; ties by name."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(group).orderBy(F.desc("c"), value)
    top = counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat(F.col(value), F.lit(": "), F.col("c"))))), lambda x: x["col2"]), "; ").alias("mix"))


def cluster_summary(df: DataFrame, group: str, value: str, flags: dict[str, Column], excluded: list[str] = (), limit: int | None = 15) -> DataFrame:
    """Counts, sums and flagged counts of groups; excluded ones left out."""
    own = df.where(not_blank(group) & ~F.col(group).isin(*excluded)) if excluded else df.where(not_blank(group))
    out = own.groupBy(group).agg(F.count("*").alias("n"), F.sum(value).alias("total"), *(F.count_if(c).alias(k) for k, c in flags.items()))
    out = out.orderBy(F.desc("n"), F.desc("total"), group)
    return out if limit is None else out.limit(limit)


def rule_matches(df: DataFrame, searchable: Column, rules: dict[str, list[str]], also: Column | None = None) -> DataFrame:
    """Rows of df once for each rule whose patterns a text has, with its name in `rule`. The rules are a literal."""
    table = F.array(*(F.struct(F.lit(k).alias("rule"), F.array(*map(F.lit, v)).alias("patterns")) for k, v in rules.items()))
    own = df.withColumn("_s", F.lower(searchable))
    hit = lambda r: F.exists(r["patterns"], lambda p: F.contains(F.col("_s"), p))
    matched = F.filter(table, lambda r: hit(r) | also if also is not None else hit(r))
    return own.withColumn("rule", F.explode(F.transform(matched, lambda r: r["rule"]))).drop("_s")


def samples(df: DataFrame, group: str, name: str, limit: int) -> DataFrame:
    """(group, samples): the first names of a group."""
    w = Window.partitionBy(group).orderBy(name)
    own = df.select(group, name).distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= limit)
    return own.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(name)), "; ").alias("samples"))


def weighted_counts(df: DataFrame, value: str, weight: Column, limit: int | None = None) -> DataFrame:
    out = df.where(not_blank(value)).groupBy(value).agg(F.sum(weight).alias("weight")).orderBy(F.desc("weight"), value)
    return out if limit is None else out.limit(limit)


def medians(df: DataFrame, value: str, *groups: str) -> DataFrame:
    """(groups, median): the exact median of a number, nulls aside; of the whole table without groups."""
    return df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.median(value).alias("median"))


def labelled_groups(df: DataFrame, groups: list[str], label: str, name: str, labels: list[str]) -> DataFrame:
    """(groups, label, n, names): rows of some labels by group, with their names in order, each once."""
    own = df.where(F.col(label).isin(*labels)).groupBy(*groups, label)
    return own.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(name)), "; ").alias("names"))


def counts_by_field(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(field, value, n): how often each value of several columns stands, blank ones aside; one pass over the rows."""
    cells = F.array(*(F.struct(F.lit(k).alias("field"), F.trim(F.col(c).cast("string")).alias("value")) for k, c in fields.items()))
    return df.select(F.explode(cells).alias("c")).where("c.value <> ''").groupBy("c.field", "c.value").agg(F.count("*").alias("n"))


def represented(df: DataFrame, column: str) -> DataFrame:
    """(value): a column's distinct values that aren't blank, in order."""
    return df.where(not_blank(column)).select(F.trim(F.col(column).cast("string")).alias("value")).distinct().orderBy("value")
