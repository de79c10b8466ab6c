"""Curation of candidate documents: the stages from raw rows to keep, review or discard, as one chain of frames."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..functions import vocab
from ..operators import dedup, ranking


def generated_queries(topics: DataFrame, templates: list[str], expected: int | None = None) -> DataFrame:
    """(query, ord): every topic in every template, in order, distinct but for case. topics: topic, t (its place)."""
    p = F.explode(F.transform(F.array(*map(F.lit, templates)), lambda x, i: F.struct(x.alias("template"), i.alias("p"))))
    every = topics.select("topic", "t", p.alias("p")).select("topic", "t", "p.template", F.col("p.p").alias("p"))
    made = every.select(T.squeeze(F.replace("template", F.lit("{topic}"), F.col("topic"))).alias("query"), (F.col("t") * len(templates) + F.col("p")).cast("long").alias("ord"))
    out = dedup.best_by_key(made.withColumn("_k", F.lower("query")), ["_k"], [F.asc("ord")]).drop("_k")
    if expected is not None and out.count() != expected:
        raise ValueError(f"expected {expected} distinct queries")
    return out


def scored_candidates(candidates: DataFrame, lexical: DataFrame | None = None, v=vocab) -> DataFrame:
    """Stage 1. candidates: id, title, content, description, query, url, engine (score from 0 to 1). lexical: id,
    lexical (similarity to the goal text, 0 to 100)."""
    own = candidates if lexical is None else candidates.join(lexical, "id", "left")
    whole = T.squeeze(F.concat_ws(" ", *(T.text(F.col(c)) for c in ("title", "content", "description", "query", "url"))))
    near = F.lit(0.0) if lexical is None else F.coalesce("lexical", F.lit(0.0))
    scored = own.withColumn("m", R.metadata_score(whole, T.domain(F.col("url")), F.col("engine"), near, v))
    return scored.select(*own.columns, T.canonical_url(F.col("url")).alias("canonical"), F.col("m.score").alias("metadata"), F.col("m.two_signal").alias("two_signal"), F.col("m.question_specifics").alias("question_specifics"), F.col("m.penalty").alias("penalty"))


def deduplicated(scored: DataFrame) -> DataFrame:
    """Stage 1b: the best row of each url, else file, else title; ties to the smaller id."""
    file = F.col("filename") if "filename" in scored.columns else F.lit("")
    own = scored.withColumn("_key", dedup.candidate_key(F.col("canonical"), file, F.col("title"), F.col("id")))
    return dedup.best_by_key(own, ["_key"], [F.desc("metadata"), F.asc("id")]).drop("_key")


def gated(df: DataFrame, threshold: float = 25.0, document: Column | None = None, gate: bool = True) -> DataFrame:
    """Stage 2: adds metadata_pass, rule_pass, document and selected."""
    doc = F.lit(True) if document is None else document
    rule = (F.col("two_signal") == 1) | (F.col("question_specifics") == 1)
    out = df.withColumns({"metadata_pass": F.col("metadata") >= threshold, "rule_pass": rule, "document": doc})
    return out.withColumn("selected", F.col("metadata_pass") & F.col("document") & (F.col("rule_pass") if gate else F.lit(True)))


def decided(cards: DataFrame, judge: bool, share: float = 0.5) -> DataFrame:
    """Last stages: decision and rule, then the cap on one topic's share, in the final order."""
    names = ("file", "blocked", "low_trust", "shortlisted", "passed", "adjacent", "direct", "hybrid", "heuristic", "credibility", "news", "marketing", "rerank", "exact", "near")
    made = cards.withColumn("_d", R.final_decision({n: F.col(n) for n in names}, judge)).select(*cards.columns, F.col("_d.decision").alias("decision"), F.col("_d.rule").alias("rule"))
    capped = ranking.diversified(made, "topic", "decision", [F.desc("final_rank"), F.asc("id")], share)
    return capped.orderBy(*ranking.final_order("decision", "final_rank", "hybrid", "credibility"))


def report(stages: dict[str, DataFrame], flags: dict[str, dict[str, Column]] = {}) -> DataFrame:  # noqa: B006
    """(stage, rows, and a column for each flag): one row for each stage of a run, with how many of its rows have its
    flags; null where a stage has no such flag."""
    names = list(dict.fromkeys(k for own in flags.values() for k in own))
    out = None
    for name, df in stages.items():
        own = flags.get(name, {})
        counted = [F.count_if(own[k]).alias(k) if k in own else F.lit(None).cast("long").alias(k) for k in names]
        row = df.agg(F.count("*").alias("rows"), *counted).select(F.lit(name).alias("stage"), "rows", *names)
        out = row if out is None else out.unionByName(row)
    return out
