"""Reports over the runs of a study: what answers cite, what they were given, and one mode against another."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import logged_list, match_key, semantic_text, squeeze, text, word_count

#: The forms in which answers cite, and what reads as an abstention.
CITED = {kind: (rf"(?i)\[\s*{kind}\s*:\s*([^\]\n]+?)\s*\]", rf"(?i)\(\s*{kind}\s*:\s*([^)]+?)\s*\)", rf"(?i)\b{kind}\s*:\s*([A-Za-z0-9:_./-]+)") for kind in ("doc", "web")}
LINK, SOURCE = r"(?i)https?://[^\s)\]]+", r"(?i)\[\s*source\s+([0-9]+)\s*\]"
ABSTAINS = r"(?i)\b(i don['’]t know|not found|cannot find|can['’]t find|insufficient information|not enough information|unable to find)\b"


def _clean(token: Column) -> Column:
    """A citation without brackets, then without signs, at its ends."""
    return F.regexp_replace(F.regexp_replace(F.trim(token), r"^[\[\](){}]+|[\[\](){}]+$", ""), r"^[ ,.;:]+|[ ,.;:]+$", "")


def cited(answer: Column, kind: str) -> Column:
    """What an answer cites of a kind (doc or web), form by form, each once; links and sources count as web."""
    found = [F.regexp_extract_all(text(answer), F.lit(p), F.lit(1)) for p in CITED[kind]]
    if kind == "web":
        sources = F.transform(F.regexp_extract_all(text(answer), F.lit(SOURCE), F.lit(1)), lambda n: F.concat(F.lit("source_"), n))
        found += [F.regexp_extract_all(text(answer), F.lit(LINK), F.lit(0)), sources]
    return F.array_distinct(F.filter(F.transform(F.flatten(F.array(*found)), _clean), lambda x: x != ""))


def ordered_lists(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, ids): a key's values that aren't blank, each once, where it first stands. A key's values are what one
    question was given."""
    first = df.select(key, F.trim(F.col(value).cast("string")).alias("v"), order).where("v <> ''").groupBy(key, "v").agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]).alias("ids"))


def score_lists(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """(key, scores): a key's scores that are numbers, in order."""
    own = df.select(key, F.col(score).cast("string").try_cast("double").alias("s"), order).where("s is not null")
    return own.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "s"))), lambda x: x["s"]).alias("scores"))


def derived_columns(responses: DataFrame, local: DataFrame, web: DataFrame, mode: str) -> DataFrame:
    """responses with what their answers and retrieval say. responses: q_id, answer, doc_citations, web_citations,
    local_ids, web_ids (logged lists); local, web: q_id, chunk_id, ord."""
    given = lambda df, k: ordered_lists(df, "q_id", "chunk_id", "ord").withColumnRenamed("ids", k)
    own = responses.join(given(local, "_l"), "q_id", "left").join(given(web, "_w"), "q_id", "left")
    own = own.withColumns({
        "cited_docs": cited(F.col("answer"), "doc"), "cited_web": cited(F.col("answer"), "web"), "local_retrieved": F.coalesce("_l", logged_list(F.col("local_ids"))), "web_retrieved": F.coalesce("_w", logged_list(F.col("web_ids"))),
        "abstained": text(F.col("answer")).rlike(ABSTAINS), "words": word_count(F.col("answer")),
    }).drop("_l", "_w")
    count = F.size("cited_docs") + F.size("cited_web")
    unlogged = F.size(logged_list(F.col("doc_citations"))) + F.size(logged_list(F.col("web_citations"))) == 0
    every = F.array_distinct(F.concat("cited_docs", "cited_web"))
    matched = F.size(F.array_intersect(every, F.concat("local_retrieved", "web_retrieved")))
    answerable = ~F.col("abstained") if mode == "no_rag" else (F.size("local_retrieved") > 0) & ~F.col("abstained")
    return own.withColumns({"citations": count, "mismatch": (count > 0) & unlogged, "match_ratio": F.when(F.size(every) > 0, matched / F.size(every)), "answerable": answerable})


def mismatch_examples(derived: DataFrame, limit: int = 3, excerpt: int = 300) -> DataFrame:
    """The first answers by id whose citations were not logged, with an excerpt of one line."""
    own = derived.where("mismatch").orderBy("q_id").limit(limit)
    return own.select("q_id", "question", F.replace(F.left(F.col("answer"), F.lit(excerpt)), F.lit("\n"), F.lit(" ")).alias("excerpt"))


def review_template(merged: DataFrame, local: DataFrame, hybrid: DataFrame) -> DataFrame:
    """merged (q_id, ...) with the evidence of both modes and blank columns for a reviewer. local, hybrid: of
    `derived_columns`."""
    ids = lambda df, c, k: df.select("q_id", F.array_join(c, ", ").alias(k))
    out = merged.join(ids(local, "local_retrieved", "local_evidence_ids"), "q_id", "left").join(ids(hybrid, "web_retrieved", "web_evidence_ids"), "q_id", "left")
    return out.fillna("", ["local_evidence_ids", "web_evidence_ids"]).select("*", *(F.lit("").alias(c) for c in ("groundedness", "completeness", "usefulness", "comments")))


def latest_pairs(manifests: DataFrame, first: str = "local_rag", second: str = "hybrid_rag") -> DataFrame:
    """(model, first_run, second_run) of the models that have a run of both modes, the latest of each. manifests:
    model, mode, run_id, created."""
    newest = manifests.where(F.col("mode").isin(first, second)).groupBy("model", "mode").agg(F.max(F.struct("created", "run_id"))["run_id"].alias("run_id"))
    of = lambda mode, k: newest.where(F.col("mode") == mode).select("model", F.col("run_id").alias(k))
    return of(first, "first_run").join(of(second, "second_run"), "model")


#: Measures that are compared, and what their differences are called.
MEASURES = {"support_rate": "support_rate_delta", "citation_coverage": "citation_coverage_delta", "unsupported_rate": "unsupported_rate_delta", "exact": "exact_delta", "similarity": "similarity_delta"}


def paired(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """One row a model and question of both runs: answers, measures, differences, whether the second's web evidence
    was worth it. pairs: of `latest_pairs`; answers: run_id, q_id, question, answer, abstained, citations (array), and
    MEASURES. A question that one run lacks has nulls there."""
    def side(run: str, k: str) -> DataFrame:
        own = answers.join(pairs.select("model", F.col(run).alias("run_id")), "run_id")
        return own.select("model", "q_id", *(F.col(c).alias(f"{k}_{c}") for c in ("question", "answer", "abstained", "citations", *MEASURES)))

    both = side("first_run", "local").join(side("second_run", "hybrid"), ["model", "q_id"], "full_outer")
    plain = lambda k: match_key(semantic_text(squeeze_lines(F.col(f"{k}_answer"))))
    changed = ((plain("local") != "") | (plain("hybrid") != "")) & (plain("local") != plain("hybrid"))
    web = lambda k: F.size(F.filter(F.coalesce(f"{k}_citations", F.array().cast("array<string>")), lambda t: F.startswith(t, F.lit("WEB:"))))
    delta = lambda m: F.round(F.col(f"hybrid_{m}") - F.col(f"local_{m}"), 6)
    both = both.withColumns({name: delta(m) for m, name in MEASURES.items()} | {
        "question": F.coalesce(F.nullif(F.col("hybrid_question"), F.lit("")), F.col("local_question"), F.lit("")), "changed": changed, "local_web": web("local"), "hybrid_web": web("hybrid"),
        "abstention_delta": F.round(F.col("hybrid_abstained").cast("double") - F.col("local_abstained").cast("double"), 6),
    })
    better = F.lit(False)
    for name in ("support_rate_delta", "similarity_delta", "exact_delta"):
        better = better | F.coalesce(F.col(name) > 0, F.lit(False))
    answered = F.coalesce(F.col("local_abstained") & ~F.col("hybrid_abstained"), F.lit(False))
    return both.withColumn("value_signal", (F.col("hybrid_web") > 0) & (F.col("changed") | answered | better))


def squeeze_lines(c: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text(c), r"^\s+|\s+$", "")


def value_summary(pairs: DataFrame) -> DataFrame:
    """Per model: paired questions, changed answers, those with web citations and with a value signal, and means of
    measures and differences; null where no row has a number. pairs: of `paired`."""
    means = [F.round(F.avg(c), 6).alias(f"avg_{c}") for m, delta in MEASURES.items() for c in (f"local_{m}", f"hybrid_{m}", delta)]
    return pairs.groupBy("model").agg(
        F.count("*").alias("questions"), F.count_if("changed").alias("changed"), F.count_if(F.col("hybrid_web") > 0).alias("with_web"), F.count_if("value_signal").alias("with_signal"), *means, F.round(F.avg("abstention_delta"), 6).alias("avg_abstention_delta"),
    )


def with_metrics(responses: DataFrame, metrics: DataFrame) -> DataFrame:
    """responses with the metrics of the same question (but for case and spacing) and run. metrics: question, run_id
    and measures; of several rows of a question and run the first by its measures counts."""
    measures = [c for c in metrics.columns if c not in ("question", "run_id")]
    own = metrics.groupBy(F.lower(squeeze(F.col("question"))).alias("_q"), F.col("run_id").alias("_r")).agg(F.min(F.struct(*measures)).alias("_m"))
    joined = responses.join(own, (F.lower(squeeze(F.col("question"))) == F.col("_q")) & (F.col("run_id") == F.col("_r")), "left")
    return joined.select(*responses.columns, *(F.col(f"_m.{c}").alias(c) for c in measures))


def citation_kind(kind: Column, analysis: Column, sheet: Column, web: Column) -> Column:
    """The kind under which a result is cited."""
    low = lambda c: F.lower(squeeze(c))
    return F.when(web, "WEB").when((low(kind) == "derived_analytic_summary") | (low(analysis) != ""), "ANALYTIC").when(low(kind).isin("location_theme", "geo_reference") | F.contains(low(sheet), F.lit("geo")), "GEO").otherwise("DOC")


def evidence_registry(local: DataFrame, web: DataFrame) -> DataFrame:
    """(question, key, kind, id, text, web): what each question may cite, one row a key; web results override local
    ones. local, web: question, ord, id, text, chunk_kind, analysis, sheet."""
    both = local.withColumn("web", F.lit(False)).unionByName(web.withColumn("web", F.lit(True)))
    own = both.withColumn("kind", citation_kind(F.col("chunk_kind"), F.col("analysis"), F.col("sheet"), F.col("web")))
    own = own.withColumn("key", F.concat_ws(":", "kind", F.col("id").cast("string")))
    last = F.max(F.struct("web", "ord", "kind", "id", "text")).alias("x")
    return own.groupBy("question", "key").agg(last).select("question", "key", "x.kind", "x.id", "x.text", "x.web")


def result_block(kind: Column, ident: Column, place: Column, body: Column) -> Column:
    """An evidence block: its citation, where it is from, its text."""
    return F.concat(F.lit("["), kind, F.lit(":"), ident.cast("string"), F.lit("] "), text(place), F.lit("\n"), text(body))


def coverage(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, modes, common): the ids of all runs, how many runs have each, and whether all do."""
    out = None
    for df in frames.values():
        own = df.select(key).distinct()
        out = own if out is None else out.unionByName(own)
    return out.groupBy(key).agg(F.count("*").alias("modes")).withColumn("common", F.col("modes") == len(frames))


def split(df: DataFrame, decision: str) -> tuple[DataFrame, DataFrame]:
    """(kept or under review, the others); a null decision is among the others."""
    held = F.coalesce(F.col(decision).isin("keep", "review"), F.lit(False))
    return df.where(held), df.where(~held)


#: The priority of kinds of results in a compact context; others have 1.4.
COMPACT = {"structured_match_summary": 4.0, "structured_row_match": 3.2, "location_theme": 2.4, "identity_theme": 2.4, "supply_chain_theme": 2.4, "product_theme": 2.4, "company_profile": 2.0, "row_full": 1.0}


def compact(results: DataFrame, limit: int = 5) -> DataFrame:
    """The results that a compact context takes, with their place (rank). results: question, id, kind, company,
    row_key, final, definition, analytic (bool: what the question asks for), sufficient (bool: a summary that says all).

    By priority and score; a note only for definitions, and one; one result a row; whole rows and profiles only of
    companies that no result before speaks of. A summary that says all stands alone; with another summary, an
    analytic question takes three.
    """
    note = F.col("kind") == "note_reference"
    priority = F.when(note, F.when(F.col("definition"), 3.0).otherwise(-1.0))
    for name, value in COMPACT.items():
        priority = priority.when(F.col("kind") == name, value)
    own = results.withColumn("_p", priority.otherwise(1.4)).where(~note | F.col("definition"))
    by = lambda *more: Window.partitionBy("question", *more).orderBy(F.desc("_p"), F.desc("final"), "id")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = own.withColumn("_r", F.row_number().over(by("row_key"))).where((F.col("_r") == 1) | blank("row_key"))
    own = own.withColumn("_n", F.row_number().over(by("kind"))).where(~note | (F.col("_n") == 1))
    own = own.withColumn("_c", F.row_number().over(by("company"))).where(blank("company") | (F.col("_c") == 1) | ~F.col("kind").isin("row_full", "company_profile"))
    whole = Window.partitionBy("question")
    summary = F.col("kind") == "structured_match_summary"
    alone = F.max(summary & F.col("sufficient") & F.col("analytic")).over(whole)
    few = F.max(summary & F.col("analytic")).over(whole)
    most = F.when(alone, 1).when(few, min(limit, 3)).otherwise(limit)
    ranked = own.withColumns({"rank": F.row_number().over(by()), "_most": most})
    return ranked.where("rank <= _most").drop("_p", "_r", "_n", "_c", "_most")


def rendered(blocks: DataFrame, budget: int = 4200, least: int = 180) -> DataFrame:
    """(question, context, blocks): a question's blocks in order while `least` characters are left, the one that
    overflows cut; a text that says so without any. blocks: question, rank, company, kind, source, row, body."""
    header = F.concat(F.lit("[Evidence "), F.col("rank").cast("string"), F.lit("] type="), F.col("kind"), F.lit(" company="), F.coalesce(F.nullif(F.col("company"), F.lit("")), F.lit("n/a")), F.lit(" source="), F.col("source"), F.when(text(F.col("row")) != "", F.concat(F.lit(" row="), F.col("row"))).otherwise(""))
    own = blocks.withColumn("block", F.concat(header, F.lit("\n"), text(F.col("body"))))
    ahead = F.coalesce(F.sum(F.length("block")).over(Window.partitionBy("question").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - F.col("ahead")
    cut = F.when(F.length("block") > left, F.concat(F.rtrim(F.left(F.col("block"), F.greatest(F.lit(0), left - 3).cast("int"))), F.lit("..."))).otherwise(F.col("block"))
    fit = own.withColumn("ahead", ahead).where(F.lit(budget) - F.col("ahead") >= least).withColumn("block", cut)
    return fit.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("context"), F.count("*").alias("blocks"))
