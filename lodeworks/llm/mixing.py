"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources, by code point with null last, bear weights; a mix of `share` times all words is shared among them by
weight, each target stopping at `repeat` times its source (the excess goes to the others by weight). A source's
documents, in the order of a hash of their ids and texts, form its line of words, cut into blocks of equal length. A
target is a number of block draws: whole passes over the line, then its beginning, the last draw cut to the word.
The tree deals the draws out among output shards: at each node, half of all draws go left, and how many of them are
of each source is a multivariate-hypergeometric draw (inverse distribution function, seeded by node and source).
A shard's draws of a source are a run of its permuted blocks, so shards are disjoint. A document goes whole to the
shard of the block in which it begins, so a shard's words of a source are its blocks' to a document's length.
Documents in a shard are ordered by another hash. Everything is DataFrame expressions and depends on ids, texts and
seeds alone, so reruns agree; of rows that repeat an id and a text it is not said which is drawn where.

What is held in one row or task: an array of one long a source (the tree's nodes), and the sources' targets, a row a
source. Shards are rows, met by ranges of draws in an equi-join, and may be millions.
"""

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, carried, let, words, written

#: Documents in a part of a source's line, roughly, and blocks of a source at most for each shard.
PART, BLOCKS = 256, 1024
#: Levels of the tree that one task splits before its nodes are dealt out.
LEVELS = 8
#: Sources up to which the plan, a row a source, is broadcast.
BROADCAST_SOURCES = 4096


def targets(sums: DataFrame, weights: tuple[int, ...], share: float, repeat: int) -> DataFrame:
    """sums: source, source_size. Adds place (from 0), weight and target (double)."""
    alone = Window.partitionBy(F.lit(0))  # a row a source
    order = F.row_number().over(alone.orderBy(F.col("source").asc_nulls_last())) - 1
    each = sums.withColumn("place", order).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    most = (repeat * F.col("source_size")).cast("double")
    level = each.select("*", most.alias("most"), (most / F.col("weight")).alias("full"), (share * F.sum("source_size").over(alone)).alias("budget"))
    above = alone.orderBy("full").rangeBetween(Window.currentRow, Window.unboundedFollowing)  # those that a level fills later, and this
    filled = level.withColumn("capped", F.sum("most").over(alone) - F.sum("most").over(above) + F.col("full") * F.sum("weight").over(above) <= F.col("budget"))
    over = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(alone)
    rest = F.try_divide(F.col("budget") - F.sum(F.when(F.col("capped"), F.col("most")).otherwise(0.0)).over(alone), over)
    target = F.when(F.col("capped"), F.col("most")).otherwise(F.least(F.col("most"), F.col("weight") * rest))
    return filled.select("source", "source_size", "place", "weight", target.alias("target"))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` draws of `total` without return are among the `marked`, at the probability u."""
    mean = drawn * marked / F.greatest(total, F.lit(1))
    sd = F.sqrt(F.greatest(mean * (1 - marked / F.greatest(total, F.lit(1))) * (total - drawn) / F.greatest(total - 1, F.lit(1)), F.lit(0.0)))
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - 9 * sd - 9)).cast("bigint")
    high = F.least(drawn, marked, F.ceil(mean + 9 * sd + 9)).cast("bigint")
    ratio = lambda k: (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (total - marked - drawn + k + 1))

    def draw(b: Column) -> Column:
        ks = F.when(b["high"] > b["low"], F.sequence(b["low"], b["high"] - 1)).otherwise(F.array().cast("array<bigint>"))
        begin = F.struct(F.lit(1.0).cast("double").alias("w"), F.lit(1.0).cast("double").alias("sum"))
        add = lambda acc, k: let(acc["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum")))
        mass = F.aggregate(ks, begin, add, lambda acc: acc["sum"])

        def seek(m: Column) -> Column:
            start = F.struct(F.lit(1.0).cast("double").alias("w"), F.lit(1.0).cast("double").alias("sum"), b["low"].alias("k"))
            go = lambda acc, k: let(acc["w"] * ratio(k), lambda w: F.struct(w.alias("w"), (acc["sum"] + w).alias("sum"), F.when(acc["sum"] < u * m, k + 1).otherwise(acc["k"]).alias("k")))
            return F.aggregate(ks, start, go, lambda acc: acc["k"])

        return let(mass, seek)

    return let(F.struct(low.alias("low"), high.alias("high")), draw)


def split_tree(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """quotas: one row with draws, an array by source. (shard, draws) for 2 ** levels shards; sums are kept."""
    node = F.col("node")

    def halves(level: int) -> Column:
        def deal(acc: Column, x: Column) -> Column:
            u = (F.xxhash64(F.lit(seed), F.lit(level), node, x["i"]).cast("double") + 9.223372036854775807e18) / 1.8446744073709551616e19
            return let(hypergeometric(acc["total"], x["q"], acc["left"], u), lambda k: F.struct((acc["left"] - k).alias("left"), (acc["total"] - x["q"]).alias("total"), F.concat(acc["out"], F.array(k)).alias("out")))

        total = F.aggregate("draws", F.lit(0).cast("bigint"), lambda s, q: s + q)
        begin = let(total, lambda t: F.struct(F.floor(t / 2).cast("bigint").alias("left"), t.alias("total"), F.array().cast("array<bigint>").alias("out")))
        left = F.aggregate(F.transform("draws", lambda q, i: F.struct(q.alias("q"), i.alias("i"))), begin, deal, lambda acc: acc["out"])
        return let(left, lambda own: F.array(F.struct((node * 2).alias("node"), own.alias("draws")), F.struct((node * 2 + 1).alias("node"), F.zip_with("draws", own, lambda q, k: q - k).alias("draws"))))

    nodes = quotas.select(F.lit(0).cast("bigint").alias("node"), "draws")
    for level in range(levels):
        if level and level % LEVELS == 0:
            nodes = nodes.repartition("node")
        nodes = nodes.select(F.explode(halves(level)).alias("h")).select("h.node", "h.draws")
    return nodes.withColumnRenamed("node", "shard")


def shard_runs(plan: DataFrame, levels: int, seed: int) -> DataFrame:
    """(place, bucket, shard, first, last): the draws from first to last of a source go to a shard. Buckets are equal
    ranges of draws, as many as shards, in which a run is looked up. plan: place, draws."""
    quotas = plan.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "draws"))), lambda x: x["draws"]).alias("draws"))
    dealt = split_tree(quotas, levels, seed).select("shard", F.posexplode("draws").alias("place", "k")).where("k > 0")
    # A shard's beginning is the sum of the shards before it: within groups of shards, and over the groups.
    group = F.floor(F.col("shard") / 2**LEVELS)
    grouped = written(dealt.withColumn("g", group), "mixing-shards")
    by_group = grouped.groupBy("place", "g").agg(F.sum("k").alias("n"))
    ahead = by_group.select("place", "g", (F.sum("n").over(Window.partitionBy("place").orderBy("g")) - F.col("n")).alias("ahead"))
    inside = F.sum("k").over(Window.partitionBy("place", "g").orderBy("shard")) - F.col("k")
    runs = grouped.withColumn("inside", inside).join(ahead, ["place", "g"]).select("place", "shard", (F.col("ahead") + F.col("inside")).alias("first"), "k")
    runs = runs.join(plan.select("place", "span"), "place").withColumn("last", F.col("first") + F.col("k") - 1)
    buckets = F.sequence(F.floor(F.col("first") / F.col("span")), F.floor(F.col("last") / F.col("span")))
    return written(runs.select("place", "shard", "first", "last", F.explode(buckets).alias("bucket")), "mixing-runs")


#: Parts of a source's line that are summed together.
GROUP = 8192


def lines(sized: DataFrame, parts: int) -> DataFrame:
    """(row, at): the words before a document on its source's line. sized: row, task, name, h, id, size.

    The line is ordered by h, id, size and task. Rows that agree in these are copies that one task read: they stand
    together, and are dealt their places within. So however many rows repeat an id, no task sees more of them than
    one task has read.
    """
    kinds = ["name", "h", "id", "size", "task"]
    part = F.floor((F.col("h").cast("double") + 9.223372036854775807e18) / 1.8446744073709551616e19 * parts).cast("int")
    classes = sized.groupBy(*kinds).agg(F.count("*").alias("copies")).withColumn("part", part).withColumn("words", F.col("copies") * F.col("size"))
    classes = written(classes, "mixing-classes")
    # Words before a part: in its group of parts, and in the groups before, so no task sees all parts of a source.
    sub = classes.groupBy("name", "part").agg(F.sum("words").alias("n")).withColumn("g", F.floor(F.col("part") / GROUP))
    groups = sub.groupBy("name", "g").agg(F.sum("n").alias("n"))
    before = groups.select("name", "g", (F.sum("n").over(Window.partitionBy("name").orderBy("g")) - F.col("n")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("name", "g").orderBy("part")) - F.col("n")
    ahead = sub.withColumn("within", within).join(before, ["name", "g"]).select("name", "part", (F.col("before") + F.col("within")).alias("ahead"))
    inside = F.sum("words").over(Window.partitionBy("name", "part").orderBy("h", "id", "size", "task")) - F.col("words")
    begins = classes.withColumn("inside", inside).join(ahead, ["name", "part"]).select(*kinds, (F.col("ahead") + F.col("inside")).alias("begin"))
    nth = F.row_number().over(Window.partitionBy(*kinds).orderBy("row")) - 1
    of = begins.select(*(F.col(k).alias(f"_{k}") for k in kinds), "begin")
    same = F.lit(True)
    for k in kinds:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return sized.withColumn("nth", nth).join(of, same).select("row", (F.col("begin") + F.col("nth") * F.col("size")).alias("at"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeat: int = 2, seed: int = 20, shard_words: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, size (words), source, source_size, target, taken, draws, and the columns in `carry`
    under names that begin with carried_.

    draws: array of (pass, shard, words, place); words is below size only where a source's target ends within the
    document, or where the document is drawn again. Documents of a source stand by a hash of id and text, then id and size,
    and those that agree in all are interchangeable; equal places in a shard stay in any order. A null text has no words; null ids and sources are kept; repeated
    rows are documents of their own; texts are counted whole; other columns are not read; an empty table gives an empty one.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE.replace("[", "[^"))).cast("long")
    named = F.concat(F.when(F.col(source_col).isNull(), "n").otherwise("s"), F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    own = docs.select(
        F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("task"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), named.alias("name"), size.alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), *carried(carry),
    )
    sized = written(own, "mixing-sizes")
    sums = written(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mixing-sources")
    all_docs, all_words, sources = sums.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("source_size"), F.lit(0)), F.count("*")).first()
    parts = 2 ** max(0, ceil(log2(max(1, all_docs / PART))))
    levels = max(2, ceil(log2(max(1, share * all_words / shard_words))))
    plan = targets(sums.select("source", "source_size"), weights, share, repeat)
    block = F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.lit(float(BLOCKS * 2**levels)))).cast("bigint")
    plan = plan.select("*", F.round("target").cast("bigint").alias("aim"), block.alias("block"))
    plan = plan.select("*", F.ceil(F.col("source_size") / F.col("block")).cast("bigint").alias("blocks"))
    draws = (F.floor(F.col("aim") / F.greatest("source_size", F.lit(1))) * F.col("blocks") + F.ceil(F.col("aim") % F.greatest("source_size", F.lit(1)) / F.col("block"))).cast("bigint")
    plan = plan.withColumn("draws", draws).withColumn("span", F.greatest(F.lit(1), F.ceil(F.col("draws") / 2**levels)).cast("bigint"))
    plan = written(plan.withColumnRenamed("source", "s"), "mixing-plan")
    runs = shard_runs(plan, levels, seed)

    slim = sized.select("row", "task", "name", "h", "id", "size", "source")
    side = plan.select("s", "source_size", "target", "place", "aim", "block", "blocks", "span")
    side = F.broadcast(side) if sources <= BROADCAST_SOURCES else side
    known = slim.join(lines(slim.drop("source"), parts), "row").join(side, F.col("source").eqNullSafe(F.col("s")))
    taken = lambda p: F.greatest(F.lit(0), F.least(F.col("size"), F.col("aim") - p * F.col("source_size") - F.col("at"))).cast("bigint")
    passes = F.array(*(F.struct(F.lit(p).alias("pass"), taken(p).alias("words"), (F.floor(F.col("at") / F.col("block")) + p * F.col("blocks")).alias("rank")) for p in range(repeat)))
    known = known.withColumn("passes", F.filter(passes, lambda d: d["words"] > 0))
    known = written(known.select("row", "id", "size", "source", "source_size", "target", F.col("place").alias("of"), "span", "passes"), "mixing-lines")
    asked = known.select("row", "id", "of", "span", F.explode("passes").alias("d")).withColumn("in", F.floor(F.col("d.rank") / F.col("span")))
    met = (F.col("of") == F.col("place")) & (F.col("in") == F.col("bucket")) & (F.col("d.rank") >= F.col("first")) & (F.col("d.rank") <= F.col("last"))
    placed = F.struct(F.col("d.pass").alias("pass"), "shard", F.col("d.words").alias("words"), F.xxhash64(F.lit(seed + 1), "d.pass", "id").alias("place"))
    drawn = asked.join(runs, met).select("row", placed.alias("draw")).groupBy("row").agg(F.array_sort(F.collect_list("draw")).alias("draws"))  # `repeat` at most
    none = F.array().cast(drawn.schema["draws"].dataType)
    out = known.join(drawn, "row", "left").withColumn("draws", F.coalesce("draws", none))
    if carry:
        out = out.join(sized.select("row", *(f"carried_{c}" for c in carry)), "row")
    total = F.aggregate("passes", F.lit(0).cast("bigint"), lambda s, d: s + d["words"])
    return out.select(F.col("id").alias(id_col), "size", F.col("source").alias(source_col), "source_size", "target", total.alias("taken"), "draws", *(f"carried_{c}" for c in carry))


def mixed_rows(mixed: DataFrame, columns: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """A row for each draw of `mix` with the columns that it carried, shard by shard in shuffled order. A document in
    which a source's target ends is cut to its first words."""
    rows = mixed.select("size", F.explode("draws").alias("d"), *(f"carried_{c}" for c in columns))
    text = F.col(f"carried_{text_col}")
    cut = F.when(F.col("d.words") < F.col("size"), F.array_join(F.slice(words(text), 1, F.col("d.words").cast("int")), " ")).otherwise(text)
    out = rows.select("d.shard", "d.place", *(cut.alias(c) if c == text_col else F.col(f"carried_{c}").alias(c) for c in columns))
    # A shard's rows lie in 16 slots; what is more than a partition should hold is split further as it comes.
    dealt = out.withColumn("slot", F.pmod("place", F.lit(16))).hint("rebalance", "shard", "slot")
    return dealt.sortWithinPartitions("shard", "place").select(*columns)
