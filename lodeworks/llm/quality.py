"""Quality rules whose cutoffs are chosen by the risk of rejecting good documents.

In each stratum (language) the rules are certified as one family. SEQUENCE tightens their cutoffs together, mildest
first: first each rule's mildest one, rule by rule, then each rule's second, and so on. A step is certified while the
exact binomial test on the labelled good documents of the stratum rejects that the rules, with the cutoffs so far,
reject a share of `risk` or more of them, at level `error / strata`; the first step that fails ends the sequence
(fixed-sequence testing, so neither the grid nor the number of rules needs a correction). With confidence 1 - error,
then, no stratum loses more than `risk` of its good documents. Where labels are too few, nothing is certified and
nothing is rejected: with no good document lost, log(error / strata) / log(1 - risk) of them are needed.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, let, words, written

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Rule -> its score (larger is worse) and its cutoffs, mildest first. A document with a score above is rejected.
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", (0.5, 0.3, 0.2, 0.1, 0.05)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.8, 0.6, 0.5, 0.4, 0.3)),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", (0.5, 0.45, 0.4, 0.35, 0.3)),
    "long_words": ("word_chars / greatest(n_words, 1)", (30.0, 20.0, 15.0, 12.0)),
    "short_words": ("-word_chars / greatest(n_words, 1)", (-1.5, -2.0, -2.5, -3.0)),
}


def repeated_words(w: Column) -> Column:
    """Words that lie in a window of three found twice or more in an array of words."""

    def covered(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        triples = let(order, lambda s: F.arrays_zip(F.slice(F.concat(F.array(F.lit(None).cast("struct<v:bigint,i:int>")), s), 1, F.size(s)).alias("a"), s.alias("b"), F.concat(F.slice(s, 2, F.size(s)), F.array(F.lit(None).cast("struct<v:bigint,i:int>"))).alias("c")))
        twice = F.filter(triples, lambda t: F.coalesce(t["b"]["v"] == t["a"]["v"], F.lit(False)) | F.coalesce(t["b"]["v"] == t["c"]["v"], F.lit(False)))
        starts = F.array_sort(F.transform(twice, lambda t: t["b"]["i"]))
        step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"))
        return F.aggregate(starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def counted(w: Column) -> Column:
        size = F.size(w) - 2
        hashes = F.transform(F.arrays_zip(F.slice(w, 1, size).alias("x"), F.slice(w, 2, size).alias("y"), F.slice(w, 3, size).alias("z")), lambda t: F.xxhash64(t["x"], t["y"], t["z"]))
        return F.when(F.size(w) < 4, 0).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h))))

    return let(w, counted)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, stratum and the counts that the rules use, over the whole text; a null text has no words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    counted = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    by_word = let(words(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    whole = docs.select(
        F.col(id_col).alias("id"), F.col(stratum_col).alias("stratum"), F.length(F.translate(text, WHITE, "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"), by_word.alias("w"), counted.alias("l"), *carried(carry),
    )
    return whole.select("id", "stratum", *(F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")), *(f"carried_{c}" for c in carry))


#: Coefficients of Stirling's series for ln n!, fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680)


def log_factorial(n: Column) -> Column:
    x = F.greatest(n, F.lit(1)).cast("double")
    series = sum((c / F.pow(x, F.lit(2.0 * i + 1)) for i, c in enumerate(STIRLING)), x * F.log(x) - x + F.log(2 * math.pi * x) / 2)
    return F.when(n <= 20, F.log(F.factorial(F.least(n, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_below(n: Column, k: Column, p: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, p): terms from k downwards by their ratios. Beyond 20 standard deviations from the
    mean they are nothing in double precision, so no more are summed than that, however many are lost."""
    mean, reach = n * p, 20 * F.sqrt(n * p * (1 - p)) + 60
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * math.log(p) + (n - k) * math.log(1 - p)
    count = F.least(k.cast("double"), 2 * reach, F.greatest(k - mean + reach, F.lit(60.0))).cast("long")
    steps = F.when(count >= 1, F.sequence(F.lit(0).cast("long"), count - 1)).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, i: Column) -> Column:
        ratio = (k - i) / (n - k + i + 1) * ((1 - p) / p)
        return let(acc["term"] * ratio, lambda t: F.struct(t.alias("term"), (acc["sum"] + t).alias("sum")))

    one = F.lit(1.0).cast("double")
    total = F.aggregate(steps, F.struct(one.alias("term"), one.alias("sum")), step, lambda acc: acc["sum"])
    return F.when(k >= n, 1.0).when(k > mean + reach, 1.0).otherwise(F.least(one, F.exp(first) * total))


def cutoffs(scored: DataFrame, good: DataFrame, risk: float, error: float) -> DataFrame:
    """(stratum, rule, cutoff) certified with each rule by itself: a share of `risk / rules` at level
    `error / (rules * strata)`. scored: id, stratum, scores (array in the order of RULES). good: id."""
    held = scored.join(good, "id").select("stratum", "scores")
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.array(*(F.lit(c) for c in cuts)).alias("cuts")) for r, (_, cuts) in enumerate(RULES.values())))
    tries = held.select("stratum", "scores", F.explode(rules).alias("r")).select("stratum", F.col("r.rule").alias("rule"), F.posexplode("r.cuts").alias("place", "cut"), "scores")
    counted = tries.groupBy("stratum", "rule", "place", "cut").agg(F.count("*").alias("n"), F.count_if(F.get("scores", F.col("rule")) > F.col("cut")).alias("lost"))
    strata = counted.agg(F.greatest(F.count_distinct(F.coalesce("stratum", F.lit(""))), F.lit(1))).scalar()
    fine = binomial_below(F.col("n"), F.col("lost"), risk / len(RULES)) <= error / len(RULES) / F.col("strata")
    tested = counted.withColumn("strata", strata).withColumn("fails", F.when(fine, 0).otherwise(1))
    row = Window.partitionBy("stratum", "rule").orderBy("place")
    certified = tested.withColumn("failed", F.sum("fails").over(row)).where("failed = 0")
    return certified.groupBy("stratum", "rule").agg(F.min("cut").alias("cutoff"))


#: Steps of the sequence, in order: (rule, place of its cutoff).
SEQUENCE = sorted(((r, k) for r, (_, cuts) in enumerate(RULES.values()) for k in range(len(cuts))), key=lambda x: (x[1], x[0]))


def joint_cutoffs(scored: DataFrame, good: DataFrame, risk: float, error: float) -> DataFrame:
    """(stratum, rule, cutoff) certified as one family; `cutoffs` bounds each rule by itself. Same arguments."""
    bounds = [cuts for _, cuts in RULES.values()]
    # The step from which on a document is lost: a step's cutoffs are at least as tight as those of the steps before.
    lost_at = F.least(*(F.when(F.get("scores", F.lit(r)) > bounds[r][k], step).otherwise(len(SEQUENCE)) for step, (r, k) in enumerate(SEQUENCE)))
    counted = scored.join(good, "id").groupBy("stratum", lost_at.alias("step")).count()
    sums = counted.groupBy("stratum").agg(F.sum("count").alias("n"), F.map_from_entries(F.collect_list(F.struct("step", "count"))).alias("lost"))
    strata = sums.agg(F.greatest(F.count("*"), F.lit(1))).scalar()
    steps = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(bounds[r][k]).alias("cut")) for r, k in SEQUENCE))
    tried = sums.withColumn("strata", strata).select("stratum", "n", "lost", "strata", F.posexplode(steps).alias("step", "s"))
    row = Window.partitionBy("stratum").orderBy("step")
    counts = tried.withColumn("lost", F.sum(F.coalesce(F.try_element_at("lost", F.col("step")), F.lit(0).cast("long"))).over(row))
    fine = binomial_below(F.col("n"), F.col("lost"), risk) <= error / F.col("strata")
    certified = counts.withColumn("failed", F.sum(F.when(fine, 0).otherwise(1)).over(row)).where("failed = 0")
    return certified.groupBy("stratum", F.col("s.rule").alias("rule")).agg(F.min("s.cut").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.01, error: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, the counts of `features`, base_failed, rejected_by (rules, an array), kept; the columns
    in `carry` under names that begin with carried_.

    labels: id_col and quality; a document whose rows all have quality 1 is good. A null stratum is one of its own.
    Null and empty texts have no words and fail; texts are read whole; repeated rows count each; rows without an id
    are judged but hold no label; scores equal to a cutoff pass; without documents there are no rows, without labels
    no rule is certified. Other columns are not read.
    """
    scores = F.array(*(F.expr(s).cast("double") for s, _ in RULES.values()))
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    scored = written(features(docs, id_col, text_col, stratum_col, carry).withColumns({"scores": scores, "base_failed": base}), "quality")
    good = labels.groupBy(F.col(id_col).alias("id")).agg(F.min("quality").alias("q")).where("q = 1").select("id")
    chosen = joint_cutoffs(scored.where("not base_failed").select("id", "stratum", "scores"), good, risk, error)
    # A certified row takes hundreds of labelled documents, so there are few; the null stratum is spelled apart.
    key = lambda c: F.concat(F.when(c.isNull(), "n").otherwise("s"), F.coalesce(c, F.lit("")))
    limits = chosen.agg(F.map_from_entries(F.collect_list(F.struct(F.concat(key(F.col("stratum")), F.lit("/"), F.col("rule")), "cutoff")))).scalar()
    rejected = F.array_compact(F.array(*(F.when(F.get("scores", F.lit(r)) > F.try_element_at(F.col("limits"), F.concat(key(F.col("stratum")), F.lit(f"/{r}"))), name) for r, name in enumerate(RULES))))
    out = scored.withColumn("limits", limits).withColumn("rejected_by", rejected)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "rejected_by", (~F.col("base_failed") & (F.size("rejected_by") == 0)).alias("kept"), *(f"carried_{c}" for c in carry))
