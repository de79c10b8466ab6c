"""Evaluation of answers: citations, support by evidence, agreement with gold answers, runs against each other."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import vocab
from ..functions.text import NUMBER, answer_parts, citations, let, list_items, match_key, numbers, semantic_text, text, without_citations


def similarity_tokens(c: Column) -> Column:
    return F.filter(F.split(match_key(c), " "), lambda t: (t != "") & ~t.isin(*vocab.STOPWORDS))


def support(bullet: Column, evidence: Column) -> Column:
    """supported, partial, unsupported or nonfactual, by shared words and numbers."""
    clean = without_citations(bullet)

    def judge(t: Column) -> Column:
        ratio = F.size(F.filter(t["own"], lambda w: F.array_contains(t["given"], w))) / F.greatest(F.size(t["own"]), F.lit(1))
        lost = F.exists(t["numbers"], lambda n: ~F.contains(text(evidence), n))
        return F.when(F.size(t["own"]) == 0, "nonfactual").when(lost, "unsupported").when(ratio >= 0.55, "supported").when(ratio >= 0.30, "partial").otherwise("unsupported")

    return let(F.struct(similarity_tokens(clean).alias("own"), F.array_distinct(similarity_tokens(evidence)).alias("given"), F.regexp_extract_all(clean, F.lit(NUMBER), F.lit(0)).alias("numbers")), judge)


def bullets(answers: DataFrame) -> DataFrame:
    """(id, ord, bullet, cited) of answers (id, text)."""
    own = answers.select("id", F.posexplode(answer_parts(F.col("text"))["bullets"]).alias("ord", "bullet"))
    return own.withColumn("cited", citations(F.col("bullet")))


def validated(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row a bullet: id, ord, missing, invalid, label, failed. answers: id, text; evidence: id, token, text,
    or token, text where all answers were given the same.

    A bullet without citation is missing one; one that cites what wasn't given is invalid; others are judged on the
    texts that they cite.
    """
    own = bullets(answers)
    cites = own.select("id", "ord", F.posexplode("cited").alias("k", "token"))
    key = [c for c in ("id", "token") if c in evidence.columns]
    found = cites.join(evidence.select(*key, F.col("text").alias("given")), key, "left")
    by = found.groupBy("id", "ord").agg(F.count_if(F.col("given").isNull()).alias("unknown"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "given"))), lambda x: x["given"]), " ").alias("given"))
    joined = own.join(by, ["id", "ord"], "left")
    missing, invalid = F.size("cited") == 0, F.coalesce(F.col("unknown"), F.lit(0)) > 0
    label = F.when(missing | invalid, "unsupported").otherwise(support(F.col("bullet"), F.col("given")))
    return joined.select("id", "ord", missing.alias("missing"), (~missing & invalid).alias("invalid"), label.alias("label"), (label != "supported").alias("failed"))


def answer_metrics(checked: DataFrame) -> DataFrame:
    """Per answer: bullets, coverage, validity, support rate, unsupported rate; null where nothing counts."""
    n, cited = F.count("*"), F.count_if(~F.col("missing"))
    share = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    return checked.groupBy("id").agg(
        n.alias("bullets"), share(cited, n).alias("coverage"), share(F.count_if(~F.col("missing") & ~F.col("invalid")), cited).alias("validity"),
        share(F.count_if(F.col("label") == "supported"), n).alias("support_rate"), share(F.count_if("failed"), n).alias("unsupported_rate"),
    )


def tolerance(answer_format: Column) -> Column:
    """The numeric tolerance that a format states; values above 1 are percentages; 0.05 without one."""
    v = F.coalesce(F.nullif(F.regexp_extract(F.lower(text(answer_format)), r"tolerance\s*=\s*([0-9.]+)%?", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(text(answer_format)), r"tol\s*=\s*([0-9.]+)%?", 1), F.lit(""))).try_cast("double")
    return F.when(v.isNull(), 0.05).when(v > 1, v / 100).otherwise(v)


def gold_metrics(answer: Column, gold: Column, answer_format: Column) -> Column:
    """Struct of exact, precision, recall, f1, numeric_exact, numeric_close; null where a measure doesn't apply."""
    kind = F.lower(text(answer_format))
    has = lambda *ws: F.exists(F.array(*map(F.lit, ws)), lambda w: F.contains(kind, w))

    def lists(x: Column) -> Column:
        both = F.size(F.array_intersect(x["a"], x["g"]))
        p, r = F.coalesce(both / F.nullif(F.size(x["a"]), F.lit(0)), F.lit(0.0)), F.coalesce(both / F.nullif(F.size(x["g"]), F.lit(0)), F.lit(0.0))
        f1 = F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))
        return F.when(has("list", "set", "items", "companies") & ((F.size(x["a"]) > 0) | (F.size(x["g"]) > 0)), F.struct(F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1")))

    def exact(x: Column) -> Column:
        one = (F.size(x["a"]) == 1) & (F.size(x["g"]) == 1)
        a, g = F.get(x["a"], F.lit(0)), F.get(x["g"], F.lit(0))
        near = F.abs(a - g) <= F.greatest(tolerance(answer_format) * F.greatest(F.lit(1.0), F.abs(g)), F.lit(1e-9))
        asked = has("number", "numeric", "count", "percent")
        value = F.when(one, F.struct((a == g).cast("double").alias("exact"), near.cast("double").alias("close"))).otherwise(F.struct(F.lit(0.0).alias("exact"), F.lit(0.0).alias("close")))
        return F.when(asked | one, value)

    items = let(F.struct(list_items(answer).alias("a"), list_items(gold).alias("g")), lists)
    numeric = let(F.struct(numbers(answer).alias("a"), numbers(gold).alias("g")), exact)
    same = (match_key(semantic_text(answer)) == match_key(gold)).cast("double")
    return F.struct(same.alias("exact"), items["precision"].alias("precision"), items["recall"].alias("recall"), items["f1"].alias("f1"), numeric["exact"].alias("numeric_exact"), numeric["close"].alias("numeric_close"))


@F.pandas_udf(DoubleType())
def similarity_ratio(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts; has no counterpart among the built-in functions."""
    from difflib import SequenceMatcher

    for a, b in pairs:
        yield pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def matched_gold(answers: DataFrame, gold: DataFrame, by_question: bool = True) -> DataFrame:
    """answers (id, question) with gold (id, question, answer): by id, else by the question's words; match says how."""
    by_id = gold.select(F.col("id"), F.col("question").alias("gold_question"), F.col("answer").alias("gold_answer"))
    keyed = gold.groupBy(match_key(F.col("question")).alias("key")).agg(F.min(F.struct("id", "answer"))["answer"].alias("by_text"))
    both = answers.join(by_id, "id", "left").withColumn("key", match_key(F.col("question"))).join(keyed, "key", "left").drop("key")
    fallback = F.col("by_text") if by_question else F.lit(None).cast("string")
    how = F.when(F.col("gold_answer").isNotNull(), "q_id").when(fallback.isNotNull(), "question").otherwise("missing")
    differs = F.coalesce(match_key(F.col("gold_question")) != match_key(F.col("question")), F.lit(False))
    return both.select(*answers.columns, F.coalesce("gold_answer", fallback).alias("gold"), how.alias("match"), differs.alias("mismatch"))


def mode_summary(runs: DataFrame, mode: str, flags: list[str], numbers_: list[str]) -> DataFrame:
    """Per mode: rows, percentages of flags and means of numbers."""
    return runs.groupBy(mode).agg(F.count("*").alias("rows"), *(F.round(F.avg(F.coalesce(F.col(f).cast("double"), F.lit(0.0))) * 100, 2).alias(f"{f}_pct") for f in flags), *(F.round(F.avg(n), 4).alias(f"avg_{n}") for n in numbers_))


def low_scores(hits: DataFrame, group: str, score: str, share: float = 0.10) -> DataFrame:
    """(group, top, low): each group's best score, and whether it is within the lowest share of all groups'."""
    top = hits.where(F.col(score).isNotNull()).groupBy(group).agg(F.max(score).alias("top"))
    limit = top.agg(F.percentile("top", F.lit(share))).scalar()
    return top.select(group, "top").withColumn("low", F.col("top") <= limit)


def deltas(a: DataFrame, b: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """Full outer pairing of two runs; b less a, null where one lacks a value."""
    x = a.select(key, *(F.col(m).alias(f"a_{m}") for m in metrics))
    y = b.select(key, *(F.col(m).alias(f"b_{m}") for m in metrics))
    return x.join(y, key, "full_outer").select(key, *(F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 6).alias(f"{m}_delta") for m in metrics))


def value_signal(web_cited: Column, changed: Column, a_abstained: Column, b_abstained: Column, *gains: Column) -> Column:
    better = F.lit(False)
    for g in gains:
        better = better | F.coalesce(g > 0, F.lit(False))
    return F.coalesce(web_cited, F.lit(False)) & (F.coalesce(changed, F.lit(False)) | F.coalesce(a_abstained & ~b_abstained, F.lit(False)) | better)


def problem_scores(flags: dict[str, tuple[DataFrame, int]], key: str) -> DataFrame:
    """(key, score): points of each flag's ids, summed. flags: name -> (ids, points)."""
    out = None
    for ids, points in flags.values():
        own = ids.select(key).withColumn("points", F.lit(points))
        out = own if out is None else out.unionByName(own)
    return out.groupBy(key).agg(F.sum("points").alias("score")).orderBy(F.desc("score"), key)


def match_ratio(cited: Column, retrieved: Column) -> Column:
    """Share of distinct cited ids that were retrieved; null if none is cited."""
    own = F.array_distinct(cited)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, retrieved)) / F.size(own))


def provenance(mode: Column, answer: Column, failed: Column) -> Column:
    """Struct of an answer's text by where it comes from: retrieved knowledge or the model alone."""
    none = F.lit("")
    knows = (mode != "no_rag") & ~failed
    blank = (mode != "no_rag") & (F.trim(text(answer)) == vocab.ABSTENTION)
    return F.struct(F.when(blank, none).when(knows, answer).otherwise(none).alias("knowledge"), F.when(blank | knows, none).otherwise(answer).alias("pretrained"))


def scored_by(df: DataFrame, scorer: Callable[[list[str]], list[float]], text_col: str, out: str) -> DataFrame:
    """Adds a score from any callable over batches of texts: a model client, an encoder, a judge. It runs in Arrow
    batches inside the tasks, and is built once a batch stream, not once a row."""

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(scorer(batch.fillna("").tolist()))

    return df.withColumn(out, run(F.col(text_col)))
