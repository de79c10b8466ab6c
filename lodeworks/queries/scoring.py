"""Scores and decisions by the operators' expressions, over figures of real texts: how many parts of words, of lists
of their own, a document holds. `queries.cards` has the same scores over whole document cards."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import ranking as K
from . import query, table

#: Frequent parts of the invented prose's words.
PARTS = ("the", "and", "ing", "tion", "ent", "ere", "der", "die", "ung", "keit", "sch", "ein", "que", "los", "ment", "ado", "les", "pour", "con", "ver", "ation", "hat", "whe", "est", "ou")
#: Figure -> how many parts it counts; those of 8 and more are shares of a hundred.
COUNTS = {
    "companies": 4, "counties": 3, "oems": 3, "ports": 2, "facilities": 4, "capacities": 3, "dates": 6, "value_chain": 7, "relationship": 3, "logistics": 3, "policy": 3,
    "heuristic": 9, "hybrid": 10, "direct": 11, "adjacent": 12, "credibility": 9, "rerank": 13, "news": 8, "marketing": 8, "semantic": 10, "noise": 12,
}


def _figure(place: int, n: int) -> str:
    """Spark and SQL expression over text."""
    own = [PARTS[(place * 3 + 2 * i) % len(PARTS)] for i in range(n)]
    hits = " + ".join(f"(case when lower(coalesce(text, '')) like '%{w}%' then 1 else 0 end)" for w in own)
    return f"({hits})" if n < 8 else f"(100.0 * ({hits}) / {n})"


FIG = {k: _figure(i, n) for i, (k, n) in enumerate(COUNTS.items())}
_num = lambda k: f"({FIG[k]})::double"


def card(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang", "source", "text")
    return docs.select("doc_id", "n_chars", "lang", "source", *(F.expr(e).cast("double").alias(f"x_{k}") for k, e in FIG.items()))


X = lambda k: F.col(f"x_{k}")


@query("select doc_id, round(greatest(0.0, least(100.0, " + " + ".join(f"least({c}, {w} * {_num(k)})" for k, (w, c) in R.ENTITY_WEIGHTS.items()) + ")), 2) as score from documents")
def lexical_entity_score(spark, d):
    return card(spark, d).select("doc_id", R.capped_sum({k: X(k) for k in R.ENTITY_WEIGHTS}).alias("score"))


_C = "case when {c} >= 8 and {m} >= 8 and {q} >= 7 and {n} <= 3 then 'keep' when {c} >= 7 and {m} >= 6 and {q} >= 6 and {n} <= 5 then 'review' else 'discard' end".format(c=f"{_num('heuristic')} / 10", m=f"{_num('hybrid')} / 10", q=f"{_num('direct')} / 10", n=f"{_num('noise')} / 10")


@query(f"select doc_id, {_C} as decision from documents")
def judge_rule(spark, d):
    return card(spark, d).select("doc_id", R.judged(X("heuristic") / 10, X("hybrid") / 10, X("direct") / 10, X("noise") / 10).alias("decision"))


def _sql_strength(k):
    return {"grounded": "companies", "question": "value_chain", "chunk": "dates", "source": "credibility", "region": "counties", "recycling": "ports", "lexical": "facilities", "research": "oems", "relationship": "relationship", "logistics": "logistics", "policy": "policy"}.get(k, k)


_TOP = {k: 101.0 for k in FIG} | {"companies": 5.0, "counties": 4.0, "oems": 4.0, "ports": 3.0, "facilities": 5.0, "capacities": 4.0, "dates": 7.0, "value_chain": 8.0, "relationship": 4.0, "logistics": 4.0, "policy": 4.0}
STRENGTHS = sorted({n.removeprefix("not_") for w in [*R.RUBRIC_WEIGHTS.values(), *R.TOPIC_WEIGHTS.values()] for n in w})


def _sum(weights):
    term = lambda n: (f"(1.0 - {_num(_sql_strength(n[4:]))} / {_TOP[_sql_strength(n[4:])]})" if n.startswith("not_") else f"({_num(_sql_strength(n))} / {_TOP[_sql_strength(n)]})")
    return " + ".join(f"{w} * {term(n)}" for n, w in weights.items())


_CLASSES = ", ".join(f"round(greatest(0.0, least(1.0, {_sum(w)})), 4) as {k}" for k, w in R.RUBRIC_WEIGHTS.items())
_TOPICS = ", ".join(f"{{'v': round({_sum(w)}, 9), 'i': {-i}, 'k': '{k}'}}" for i, (k, w) in enumerate(R.TOPIC_WEIGHTS.items()))


@query(f"select doc_id, {_CLASSES}, list_max([{_TOPICS}]).k as topic from documents")
def rubric_classify(spark, d):
    out = card(spark, d).select("doc_id", R.rubric({n: X(_sql_strength(n)) / _TOP[_sql_strength(n)] for n in STRENGTHS}).alias("r"))
    return out.select("doc_id", "r.*")


@query(f"select doc_id, round(greatest(0.0, least(100.0, 0.18 * {_num('credibility')} + 0.28 * {_num('hybrid')} + 0.24 * {_num('rerank')} + 0.10 * (case when doc_id % 3 = 0 then 100.0 when doc_id % 3 = 1 then 60.0 else 25.0 end) + 0.08 * {_num('semantic')} + 0.12 * 50.0 - (least(60.0, 6.0 * {_num('oems')} + 8.0 * {_num('ports')} + 3.0 * ({_num('noise')} / 100)) + case when doc_id % 11 = 0 then 35.0 when doc_id % 7 = 0 then 18.0 else 0.0 end))), 2) as score from documents")
def credibility(spark, d):
    i = F.col("doc_id")
    p = {"source": X("credibility"), "evidence": X("hybrid"), "entity": X("rerank"), "type": X("semantic"), "dated": i % 3 == 0, "has_dates": i % 3 == 1, "llm": F.lit(50.0), "news": X("oems"), "marketing": X("ports"), "noise": X("noise") / 100, "blocked": i % 11 == 0, "low_trust": i % 7 == 0, "paged": i % 2 == 0}
    return card(spark, d).select("doc_id", R.credibility(p)["score"].alias("score"))


_P = {k: f"({_num(k)} / 100)" for k in ("adjacent", "direct", "news", "marketing")} | {k: _num(k) for k in ("hybrid", "heuristic", "credibility", "rerank")}
_DEC = """case when doc_id % 23 = 0 or doc_id % 29 = 0 then 'discard' when doc_id % 13 = 0 then 'discard' when doc_id % 11 = 0 then 'discard' when doc_id % 7 = 0 and ({news} >= 0.2 or {marketing} >= 0.2 or {credibility} < 75) then 'discard'
when doc_id % 2 = 0 and doc_id % 3 = 0 and {credibility} >= 60 then 'keep' when doc_id % 2 = 0 then 'review' when {credibility} >= 55 and {heuristic} >= 48 and {rerank} >= 58 and ({direct} >= 0.45 or {adjacent} >= 0.55) then 'review'
when {adjacent} >= 0.6 and {hybrid} >= 55 and {credibility} >= 50 and {news} <= 0.45 and {marketing} <= 0.45 then 'review' when {direct} >= 0.55 and {heuristic} >= 38 and {hybrid} >= 55 then 'review' else 'discard' end""".format(**_P)


def _decisions(spark, d):
    i = F.col("doc_id")
    p = {"file": i % 13 != 0, "blocked": i % 11 == 0, "low_trust": i % 7 == 0, "shortlisted": i % 2 == 0, "passed": i % 3 == 0, "exact": i % 23 == 0, "near": i % 29 == 0}
    p |= {k: X(k) / 100 for k in ("adjacent", "direct", "news", "marketing")} | {k: X(k) for k in ("hybrid", "heuristic", "credibility", "rerank")}
    return card(spark, d).withColumn("decision", R.final_decision(p, True)["decision"])


@query(f"select doc_id, {_DEC} as decision from documents")
def final_decision(spark, d):
    return _decisions(spark, d).select("doc_id", "decision")


@query(f"""with x as (select doc_id, source, {_num('rerank')} as s, {_DEC} as decision from documents), f as (select count(*) as n, count(distinct source) as t from x where decision = 'keep'),
r as (select *, row_number() over (partition by source, decision = 'keep' order by s desc, doc_id) as k from x)
select doc_id, case when decision = 'keep' and n >= 4 and t >= 2 and k > greatest(1, ceil(n * 0.2)) then 'review' else decision end as decision from r, f""")
def quota_per_group(spark, d):
    return K.diversified(_decisions(spark, d), "source", "decision", [F.desc("x_rerank"), F.asc("doc_id")], 0.2).select("doc_id", "decision")


@query("""with a as (select doc_id, source, lang, row_number() over (partition by lang, n_chars order by doc_id) as k from documents), c as (select d.doc_id, d.source, d.lang, d.n_chars, row_number() over (partition by d.lang, d.source order by d.n_chars desc, d.doc_id) as g from documents d join a on a.doc_id = d.doc_id where k = 1),
r as (select *, row_number() over (partition by lang order by n_chars desc, doc_id) as rank from c where g <= 2 or source = '') select lang, doc_id, rank from r where rank <= 10""")
def company_cap(spark, d):
    out = K.capped_by_group(table(spark, d, "documents"), ["lang"], "n_chars", "source", [F.desc("n_chars"), F.asc("doc_id")], 2, 10)
    return out.select("lang", "doc_id", F.col("rank").cast("long").alias("rank"))


@query("with t as (select lang, doc_id, greatest(1, n_chars // 4) as t from documents), u as (select *, sum(t) over (partition by lang order by doc_id) as upto from t) select lang, doc_id, upto::bigint as upto, (case when upto <= 1050 then t when upto - t < 1050 then 1050 - (upto - t) else 0 end)::bigint as given from u")
def budget_pack(spark, d):
    docs = table(spark, d, "documents").withColumn("t", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long"))
    return K.packed(docs, ["lang"], [F.asc("doc_id")], "t", 1050).select("lang", "doc_id", "upto", "given")


@query("select doc_id from documents order by n_chars desc, doc_id limit (select ceil(count(*) * 0.05) from documents)")
def ratio_cap(spark, d):
    return K.top_share(table(spark, d, "documents"), 0.05, [F.desc("n_chars"), F.asc("doc_id")]).select("doc_id")


@query(f"""with x as (select doc_id, {_num('rerank')} as s, {_DEC} as decision from documents), n as (select count(*) as c from x where decision in ('keep', 'review')), e as (select doc_id from x where decision = 'discard' and s >= 55 order by s desc, doc_id limit (select greatest(0, 600 - c) from n))
select x.doc_id, case when e.doc_id is not null then 'review' else decision end as decision from x left join e on e.doc_id = x.doc_id""")
def promotion_topn(spark, d):
    own = _decisions(spark, d).withColumn("id", F.col("doc_id"))
    out = K.promoted(own, (F.col("decision") == "discard") & (F.col("x_rerank") >= 55), "decision", [F.desc("x_rerank"), F.asc("id")], 600, 1000)
    return out.select("doc_id", "decision")


@query(f"select doc_id, round(round(0.28 * {_num('heuristic')} + 0.28 * {_num('hybrid')} + 0.16 * {_num('rerank')} + 0.06 * {_num('semantic')} + 20.0 * {_P['direct']} - 10.0 * {_P['news']} - 10.0 * {_P['marketing']}, 2), 1) as rerank, round(round(0.40 * {_num('rerank')} + 0.25 * {_num('hybrid')} + 0.25 * {_num('credibility')} + 5.0 * (doc_id % 2) + 0.5 * (doc_id % 10), 2), 1) as final_rank from documents")
def rank_scores(spark, d):
    i = F.col("doc_id")
    a = R.rerank_score(X("heuristic"), X("hybrid"), X("rerank"), X("semantic"), X("direct") / 100, X("news") / 100, X("marketing") / 100)
    b = R.final_rank(X("rerank"), X("hybrid"), X("credibility"), (i % 2).cast("double"), (i % 10).cast("double"))
    return card(spark, d).select("doc_id", F.round(a, 1).alias("rerank"), F.round(b, 1).alias("final_rank"))


@query()
def metadata_score(spark, d):
    """Stage 1 and 2 of the curation over the pages: scores, best of each url, gates."""
    from ..functions import html as H
    from ..plans.curation import deduplicated, gated, scored_candidates

    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), H.title(F.col("html")).alias("title"), H.main_text(F.col("html")).alias("content"), F.lit("").alias("description"), F.lit("battery supplier facility").alias("query"), "url", ((F.col("page_id") * 7 % 100) / 100.0).alias("engine"))
    return gated(deduplicated(scored_candidates(pages))).select("id", "canonical", "metadata", "two_signal", "rule_pass", "selected")
