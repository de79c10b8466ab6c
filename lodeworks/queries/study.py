"""Reports over runs. A conversation's answers are a local run; a hybrid run changes some and cites the web."""

from pyspark.sql import functions as F

from ..operators import study as S
from . import query, table

#: The answers of both runs, in SQL that Spark and DuckDB both read: q_id, local, hybrid (null where a run lacks it).
_BASE = "(select conv_id, turn, conv_id * 100 + turn as q_id, text from conversations where role = 'assistant')"
_LOCAL = "case when q_id % 11 = 0 then 'Sorry, not found anywhere.' when q_id % 7 = 0 then text || ' (doc: d' || (conv_id % 50) || ') and doc:d7.' when q_id % 5 = 0 then text else text || ' [DOC: d' || (conv_id % 50) || ']' end"
_HYBRID = "case when q_id % 13 = 0 then 'I cannot find it' when q_id % 4 = 0 then text || ' [web: w' || (conv_id % 30) || '] see https://x.example/' || (turn % 3) || ') [source 4]' when q_id % 3 = 0 then text else text || ' [DOC: d' || (conv_id % 50) || ']' end"
_RUNS = f"(select q_id, conv_id, turn, 'question ' || q_id as question, {_LOCAL} as local, {_HYBRID} as hybrid from {_BASE})"


def runs(spark, d):
    own = table(spark, d, "conversations").where("role = 'assistant'").selectExpr("conv_id", "turn", "conv_id * 100 + turn as q_id", "text")
    return own.selectExpr("q_id", "conv_id", "turn", "'question ' || q_id as question", f"{_LOCAL} as local", f"{_HYBRID} as hybrid")


def retrieved(spark, d):
    """(q_id, chunk_id, ord): three chunks of each local answer, one of them twice and one blank."""
    each = F.explode(F.sequence(F.lit(0), F.lit(4)))
    name = F.when(F.col("i") == 3, "  ").when(F.col("i") == 4, F.concat(F.lit(" d"), (F.col("conv_id") % 50).cast("string"))).otherwise(F.concat(F.lit("d"), ((F.col("conv_id") + F.col("i") * F.col("turn")) % 50).cast("string")))
    return runs(spark, d).where("q_id % 6 <> 0").select("q_id", "conv_id", "turn", each.alias("i")).select("q_id", name.alias("chunk_id"), F.col("i").alias("ord"))


_LISTS = f"(select q_id, list_distinct_in_order as ids from (select q_id, list_filter(['d' || (conv_id % 50), 'd' || ((conv_id + turn) % 50), 'd' || ((conv_id + 2 * turn) % 50)], lambda x, i: i = 1 or not list_contains(list_slice(['d' || (conv_id % 50), 'd' || ((conv_id + turn) % 50), 'd' || ((conv_id + 2 * turn) % 50)], 1, i - 1), x)) as list_distinct_in_order from {_RUNS} where q_id % 6 <> 0))"


@query(f"select q_id, array_to_string(ids, ',') as ids from {_LISTS}")
def retrieval_lookup(spark, d):
    return S.ordered_lists(retrieved(spark, d), "q_id", "chunk_id", "ord").select("q_id", F.array_join("ids", ",").alias("ids"))


@query(f"select q_id, array_to_string([round(q_id / 7.0, 3), round(q_id / 9.0, 3)], ',') as scores from {_RUNS}")
def score_lookup(spark, d):
    given = F.array(F.round(F.col("q_id") / 7.0, 3).cast("string"), F.lit("n/a"), F.round(F.col("q_id") / 9.0, 3).cast("string"), F.lit(None).cast("string"))
    rows = runs(spark, d).select("q_id", F.posexplode(given).alias("ord", "score"))
    return S.score_lists(rows, "q_id", "score", "ord").select("q_id", F.array_join(F.transform("scores", lambda s: s.cast("string")), ",").alias("scores"))


def derived(spark, d, mode):
    answer = "local" if mode == "local_rag" else "hybrid"
    own = runs(spark, d).select("q_id", "question", F.col(answer).alias("answer"), F.when(F.col("q_id") % 2 == 0, F.concat(F.lit("d"), (F.col("conv_id") % 50).cast("string"))).otherwise("").alias("doc_citations"), F.lit("").alias("web_citations"), F.lit("d1; d2,\nd1").alias("local_ids"), F.when(F.col("q_id") % 4 == 0, F.concat(F.lit("w"), (F.col("conv_id") % 30).cast("string"))).otherwise("").alias("web_ids"))
    return S.derived_columns(own, retrieved(spark, d), retrieved(spark, d).where("false"), mode)


_CLEAN = "regexp_replace(regexp_replace(trim({x}), '^[\\[\\](){{}}]+|[\\[\\](){{}}]+$', '', 'g'), '^[ ,.;:]+|[ ,.;:]+$', '', 'g')"
_HITS = lambda k: ", ".join(f"regexp_extract_all(answer, '{p}', 1)" for p in (rf"(?i)\[\s*{k}\s*:\s*([^\]\n]+?)\s*\]", rf"(?i)\(\s*{k}\s*:\s*([^)]+?)\s*\)", rf"(?i)\b{k}\s*:\s*([A-Za-z0-9:_./-]+)"))
_CITED = lambda more, k: f"list_filter(list_transform(flatten([{_HITS(k)}{more}]), lambda x: {_CLEAN.format(x='x')}), lambda x: x <> '')"
_WEB = r", regexp_extract_all(answer, '(?i)https?://[^\s)\]]+'), list_transform(regexp_extract_all(answer, '(?i)\[\s*source\s+([0-9]+)\s*\]', 1), lambda n: 'source_' || n)"
_DERIVED = f"""(select r.q_id, question, answer, len(list_distinct({_CITED('', 'doc')})) as docs, len(list_distinct({_CITED(_WEB, 'web')})) as web, list_distinct(list_concat({_CITED('', 'doc')}, {_CITED(_WEB, 'web')})) as every, regexp_matches(answer, '(?i)\\b(not found|cannot find)\\b') as abstained, len(regexp_extract_all(answer, '\\S+')) as words,
  coalesce(l.ids, ['d1', 'd2']) as local_ids, case when r.q_id % 4 = 0 then ['w' || (conv_id % 30)] else [] end as web_ids from (select *, {{answer}} as answer from {_RUNS}) r left join {_LISTS} l on l.q_id = r.q_id)"""


@query(f"select q_id, docs + web as citations, (docs + web > 0 and q_id % 2 <> 0) as mismatch, abstained, words, len(local_ids) as local_count, len(web_ids) as web_count, round(case when len(every) > 0 then len(list_filter(every, lambda x: list_contains(list_concat(local_ids, web_ids), x))) / len(every) end, 6) as match_ratio, (len(local_ids) > 0 and not abstained) as answerable from {_DERIVED.replace('{answer}', 'hybrid')}")
def derived_columns(spark, d):
    n = lambda c: F.col(c).cast("long")
    out = derived(spark, d, "hybrid_rag")
    return out.select("q_id", n("citations").alias("citations"), "mismatch", "abstained", n("words").alias("words"), F.size("local_retrieved").cast("long").alias("local_count"), F.size("web_retrieved").cast("long").alias("web_count"), F.round("match_ratio", 6).alias("match_ratio"), "answerable")


@query(f"select q_id, question, replace(left(answer, 300), chr(10), ' ') as excerpt from {_DERIVED.replace('{answer}', 'local')} where docs + web > 0 and q_id % 2 <> 0 order by q_id limit 3")
def mismatch_examples(spark, d):
    return S.mismatch_examples(derived(spark, d, "local_rag"))


@query(f"select r.q_id, question, array_to_string(coalesce(l.ids, ['d1', 'd2']), ', ') as local_evidence_ids, case when r.q_id % 4 = 0 then 'w' || (conv_id % 30) else '' end as web_evidence_ids, '' as groundedness, '' as completeness, '' as usefulness, '' as comments from {_RUNS} r left join {_LISTS} l on l.q_id = r.q_id")
def review_template(spark, d):
    return S.review_template(runs(spark, d).select("q_id", "question"), derived(spark, d, "local_rag"), derived(spark, d, "hybrid_rag"))


#: Three models; the second has two hybrid runs, the third no local one. A model's questions are those of its number.
_MANIFESTS = "(values ('m0', 'local_rag', 'a', 1), ('m0', 'hybrid_rag', 'b', 1), ('m1', 'local_rag', 'c', 1), ('m1', 'hybrid_rag', 'x', 1), ('m1', 'hybrid_rag', 'd', 2), ('m1', 'no_rag', 'y', 9), ('m2', 'hybrid_rag', 'z', 1)) m(model, mode, run_id, created)"
_SUPPORT = {"support_rate": "(q_id % 17) / 16.0", "citation_coverage": "(q_id % 9) / 8.0", "unsupported_rate": "(q_id % 5) / 4.0", "exact": "(q_id % 2) / 1.0", "similarity": "(q_id % 21) / 20.0"}


def manifests(spark):
    return spark.createDataFrame([("m0", "local_rag", "a", 1), ("m0", "hybrid_rag", "b", 1), ("m1", "local_rag", "c", 1), ("m1", "hybrid_rag", "x", 1), ("m1", "hybrid_rag", "d", 2), ("m1", "no_rag", "y", 9), ("m2", "hybrid_rag", "z", 1)], "model string, mode string, run_id string, created int")


def run_answers(spark, d):
    """Answers of the runs a to d: local ones lack questions whose id is divisible by 8, hybrid ones those by 10."""
    r = runs(spark, d)
    out = None
    for run, answer, lacks, shift in (("a", "local", 8, 0), ("b", "hybrid", 10, 3), ("c", "local", 8, 1), ("d", "hybrid", 10, 5), ("x", "hybrid", 10, 9)):
        measures = [F.expr(e.replace("q_id", f"(q_id + {shift})")).cast("double").alias(m) for m, e in _SUPPORT.items()]
        web = F.when((F.col("q_id") % 4 == 0) & F.lit(answer == "hybrid"), F.array(F.lit("WEB:w1"), F.lit("DOC:d1"))).otherwise(F.array(F.lit("DOC:d1")))
        own = r.where(F.col("q_id") % lacks != 0).select(F.lit(run).alias("run_id"), "q_id", "question", F.col(answer).alias("answer"), F.col(answer).rlike(S.ABSTAINS).alias("abstained"), web.alias("citations"), *measures)
        out = own if out is None else out.unionByName(own)
    return out


_SIDE = lambda answer, lacks, k, shifts: f"select model, q_id, question, {answer} as {k}_answer, regexp_matches({answer}, '(?i)\\b(not found|cannot find)\\b') as {k}_abstained, " + ", ".join(f"{e.replace('q_id', '(q_id + shift)')}::double as {k}_{m}" for m, e in _SUPPORT.items()) + f" from {_RUNS} r, (values ('m0', {shifts[0]}), ('m1', {shifts[1]})) t(model, shift) where q_id % {lacks} <> 0"
_SEMANTIC = lambda c: f"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '(?i)\\[(DOC|WEB|ANALYTIC|GEO):([^\\]]+)\\]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_PAIRED = f"""(select coalesce(l.model, h.model) as model, coalesce(l.q_id, h.q_id) as q_id, coalesce(h.question, l.question) as question, l.*exclude (model, q_id, question), h.*exclude (model, q_id, question),
  {_SEMANTIC('local_answer')} <> {_SEMANTIC('hybrid_answer')} as changed, case when h.q_id % 4 = 0 then 1 else 0 end as hybrid_web, {', '.join(f'round(hybrid_{m} - local_{m}, 6) as {n}' for m, n in S.MEASURES.items())}, round(hybrid_abstained::int - local_abstained::int, 6) as abstention_delta
  from ({_SIDE('local', 8, 'local', (0, 1))}) l full join ({_SIDE('hybrid', 10, 'hybrid', (3, 5))}) h on l.model = h.model and l.q_id = h.q_id)"""
_SIGNAL = "(hybrid_web > 0 and (changed or coalesce(local_abstained and not hybrid_abstained, false) or coalesce(support_rate_delta > 0, false) or coalesce(similarity_delta > 0, false) or coalesce(exact_delta > 0, false)))"


@query("""with m as (select o_custkey as model, o_orderkey as run_id, o_orderdate as created, case o_orderkey % 3 when 0 then 'local_rag' when 1 then 'hybrid_rag' else 'no_rag' end as mode from orders),
n as (select model, mode, arg_max(run_id, (created, run_id)) as run from m group by 1, 2) select a.model, a.run as first_run, b.run as second_run from n a join n b on a.model = b.model and a.mode = 'local_rag' and b.mode = 'hybrid_rag'""")
def paired_models(spark, d):
    """Customers stand for models, orders for runs."""
    mode = F.when(F.col("o_orderkey") % 3 == 0, "local_rag").when(F.col("o_orderkey") % 3 == 1, "hybrid_rag").otherwise("no_rag")
    return S.latest_pairs(table(spark, d, "orders").select(F.col("o_custkey").alias("model"), mode.alias("mode"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created")))


@query(f"select model, q_id, question, changed, hybrid_web::bigint as hybrid_web, {', '.join(S.MEASURES.values())}, abstention_delta::double as abstention_delta, {_SIGNAL} as value_signal from {_PAIRED}")
def hybrid_comparison(spark, d):
    out = S.paired(S.latest_pairs(manifests(spark)), run_answers(spark, d))
    return out.select("model", "q_id", "question", "changed", F.col("hybrid_web").cast("long").alias("hybrid_web"), *S.MEASURES.values(), "abstention_delta", "value_signal")


@query(f"select model, count(*) as questions, count(*) filter (changed) as changed, count(*) filter (hybrid_web > 0) as with_web, count(*) filter ({_SIGNAL}) as with_signal, {', '.join(f'round(avg({c}), 6) as avg_{c}' for m, n in S.MEASURES.items() for c in (f'local_{m}', f'hybrid_{m}', n))}, round(avg(abstention_delta), 6) as avg_abstention_delta from {_PAIRED} group by 1")
def hybrid_value(spark, d):
    return S.value_summary(S.paired(S.latest_pairs(manifests(spark)), run_answers(spark, d)))


@query(f"select q_id, run_id, case when q_id % 3 = 0 then 0.5 when q_id % 3 = 1 then 0.25 end as accuracy from {_RUNS}, (values ('a'), ('b')) v(run_id) where run_id = 'a' union all select q_id, 'b', null from {_RUNS}")
def metric_lookup(spark, d):
    r = runs(spark, d).select("q_id", "question").crossJoin(F.broadcast(spark.createDataFrame([("a",), ("b",)], "run_id string")))
    m = runs(spark, d).where("q_id % 3 <> 2").select(F.upper(F.concat(F.lit(" "), "question")).alias("question"), F.lit("a").alias("run_id"), F.when(F.col("q_id") % 3 == 0, 0.5).otherwise(0.25).alias("accuracy"))
    return S.with_metrics(r, m).select("q_id", "run_id", "accuracy")


_KIND = "case when {web} then 'WEB' when kind = 'derived_analytic_summary' or analysis <> '' then 'ANALYTIC' when kind in ('location_theme', 'geo_reference') or contains(sheet, 'geo') then 'GEO' else 'DOC' end"
_RESULTS = "(select doc_id % 40 as question, doc_id // 40 as ord, doc_id % 90 as id, left(text, 30) as text, case doc_id % 4 when 0 then 'row_full' when 1 then 'derived_analytic_summary' when 2 then 'location_theme' else 'note_reference' end as kind, case when doc_id % 12 = 3 then 'mix' else '' end as analysis, case when doc_id % 16 = 4 then 'geo sheet' else lang end as sheet from documents)"


def _results(spark, d):
    i = F.col("doc_id")
    kind = F.get(F.array(*map(F.lit, ("row_full", "derived_analytic_summary", "location_theme", "note_reference"))), (i % 4).cast("int"))
    return table(spark, d, "documents").select((i % 40).alias("question"), F.floor(i / 40).alias("ord"), (i % 90).alias("id"), F.left("text", F.lit(30)).alias("text"), kind.alias("chunk_kind"), F.when(i % 12 == 3, "mix").otherwise("").alias("analysis"), F.when(i % 16 == 4, "Geo Sheet").otherwise(F.col("lang")).alias("sheet"))


@query(f"""with b as (select *, {_KIND.format(web='false')} as k, false as web from {_RESULTS} where ord % 3 <> 1 union all select *, 'WEB' as k, true as web from {_RESULTS} where ord % 3 = 1)
select question, k || ':' || id as key, arg_max(text, (web::int, ord)) as text from b group by 1, 2""")
def evidence_registry(spark, d):
    r = _results(spark, d)
    return S.evidence_registry(r.where("ord % 3 <> 1"), r.where("ord % 3 = 1")).select("question", "key", "text")


@query(f"select question, ord, id, '[' || {_KIND.format(web='ord % 2 = 0')} || ':' || id || '] ' || sheet || chr(10) || text as block from {_RESULTS}")
def result_blocks(spark, d):
    r = _results(spark, d)
    kind = S.citation_kind(F.col("chunk_kind"), F.col("analysis"), F.col("sheet"), F.col("ord") % 2 == 0)
    return r.select("question", "ord", "id", S.result_block(kind, F.col("id"), F.lower("sheet"), F.col("text")).alias("block"))


@query("select doc_id, (1 + (doc_id % 3 <> 0)::int + (quality is not null)::int)::bigint as modes, (doc_id % 3 <> 0 and quality is not null) as common from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l using (doc_id)")
def id_coverage(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return S.coverage({"no_rag": docs, "local_rag": docs.where("doc_id % 3 <> 0"), "hybrid_rag": table(spark, d, "labels").join(docs, "doc_id", "left_semi").select("doc_id")}, "doc_id")


@query("select lang, count(*) filter (q = 1) as held, count(*) filter (q = 0 or q is null) as others from (select lang, l.quality as q from documents d left join (select doc_id, min(quality) as quality from labels group by 1) l using (doc_id)) group by 1")
def split_decisions(spark, d):
    good = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("q"))
    own = table(spark, d, "documents").join(good, "doc_id", "left").withColumn("decision", F.when(F.col("q") == 1, "keep").when(F.col("q") == 0, "discard"))
    held, others = S.split(own, "decision")
    return held.select("lang", F.lit(1).alias("h")).unionByName(others.select("lang", F.lit(0).alias("h"))).groupBy("lang").agg(F.count_if(F.col("h") == 1).alias("held"), F.count_if(F.col("h") == 0).alias("others"))


_COMPACT_KINDS = ("row_full", "company_profile", "location_theme", "note_reference", "structured_row_match", "structured_match_summary", "other")
_C = "(select doc_id % 60 as question, doc_id as id, case doc_id % 7 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_COMPACT_KINDS)) + " end as kind, case when doc_id % 5 = 0 then '' else source end as company, case when doc_id % 4 = 0 then '' else 'r' || (n_chars % 9) end as row_key, n_chars % 1000 / 1000.0 as final, (doc_id % 60) % 3 = 0 as definition, (doc_id % 60) % 2 = 0 as analytic, (doc_id % 60) % 8 = 0 as sufficient, left(text, 400) as body, lang from documents)"
_P = "case when kind = 'note_reference' then case when definition then 3.0 else -1.0 end when kind = 'structured_match_summary' then 4.0 when kind = 'structured_row_match' then 3.2 when kind = 'location_theme' then 2.4 when kind = 'company_profile' then 2.0 when kind = 'row_full' then 1.0 else 1.4 end"
_COMPACT = f"""(with p as (select *, {_P} as p from {_C} where kind <> 'note_reference' or definition), a as (select *, row_number() over (partition by question, row_key order by p desc, final desc, id) as x from p qualify x = 1 or row_key = ''),
b as (select *, row_number() over (partition by question, kind order by p desc, final desc, id) as y from a qualify kind <> 'note_reference' or y = 1), c as (select *, row_number() over (partition by question, company order by p desc, final desc, id) as z from b qualify company = '' or z = 1 or kind not in ('row_full', 'company_profile')),
e as (select *, row_number() over (partition by question order by p desc, final desc, id) as rank, bool_or(kind = 'structured_match_summary' and sufficient and analytic) over (partition by question) as alone, bool_or(kind = 'structured_match_summary' and analytic) over (partition by question) as few from c)
select * from e where rank <= case when alone then 1 when few then 3 else 5 end)"""


def _compact(spark, d):
    i = F.col("doc_id")
    q = i % 60
    kind = F.get(F.array(*map(F.lit, _COMPACT_KINDS)), (i % 7).cast("int"))
    own = table(spark, d, "documents").select(
        q.alias("question"), i.alias("id"), kind.alias("kind"), F.when(i % 5 == 0, "").otherwise(F.col("source")).alias("company"), F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("r"), (F.col("n_chars") % 9).cast("string"))).alias("row_key"), (F.col("n_chars") % 1000 / 1000.0).alias("final"),
        (q % 3 == 0).alias("definition"), (q % 2 == 0).alias("analytic"), (q % 8 == 0).alias("sufficient"), F.left("text", F.lit(400)).alias("body"), F.col("lang").alias("source"), F.lit("").alias("row"),
    )
    return S.compact(own)


@query(f"select question, id, rank from {_COMPACT}")
def compact_selection(spark, d):
    return _compact(spark, d).select("question", "id", F.col("rank").cast("long").alias("rank"))


_BLOCK = "'[Evidence ' || rank || '] type=' || kind || ' company=' || case when company = '' then 'n/a' else company end || ' source=' || lang || chr(10) || body"
_RENDER = f"""with b as (select question, rank, {_BLOCK} as block from {_COMPACT}), s as (select *, coalesce(sum(len(block)) over (partition by question order by rank rows between unbounded preceding and 1 preceding), 0) as ahead from b),
c as (select question, rank, case when len(block) > 1000 - ahead then rtrim(left(block, greatest(0, 1000 - ahead - 3)::int)) || '...' else block end as block from s where 1000 - ahead >= 180)
select question, string_agg(block, chr(10) || chr(10) order by rank) as context, count(*) as blocks from c group by 1"""


@query(_RENDER)
def context_render(spark, d):
    return S.rendered(_compact(spark, d), budget=1000)
