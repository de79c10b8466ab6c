"""Evaluation of answers. Turns stand for answers: lines become bullets that cite documents, some wrongly or not at all."""

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from ..operators import evaluation as E
from . import query, table

_LINE = "'- ' || x || case when (conv_id + i) % 3 = 0 then '' when (conv_id + i) % 5 = 0 then ' [DOC:none]' else ' [doc: d' || (conv_id % 50) || ']' end"
_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
ANSWERS = f"(select conv_id, turn, {_LINES} as ls from conversations where role = 'assistant')"


def answers(spark, d):
    own = table(spark, d, "conversations").where("role = 'assistant'")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cite = lambda i: F.when((F.col("conv_id") + i + 1) % 3 == 0, "").when((F.col("conv_id") + i + 1) % 5 == 0, " [DOC:none]").otherwise(F.concat(F.lit(" [doc: d"), (F.col("conv_id") % 50).cast("string"), F.lit("]")))
    body = F.transform(lines, lambda x, i: F.concat(F.lit("- "), x, cite(i)))
    return own.select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.array_join(body, "\n").alias("text"))


_B = f"(select conv_id || '/' || turn as id, conv_id, unnest(ls) as x, generate_subscripts(ls, 1) as i from {ANSWERS})"


@query(f"select id, string_agg(case when (conv_id + i) % 3 = 0 then null when (conv_id + i) % 5 = 0 then 'DOC:none' else 'DOC:d' || (conv_id % 50) end, ',' order by i) as tokens from {_B} group by 1")
def citation_parse(spark, d):
    return answers(spark, d).where("text <> ''").select("id", F.nullif(F.array_join(T.citations(F.col("text")), ","), F.lit("")).alias("tokens"))


@query(f"select id, count(*) as n, md5(string_agg(x || case when (conv_id + i) % 3 = 0 then '' when (conv_id + i) % 5 = 0 then ' [DOC:none]' else ' [doc: d' || (conv_id % 50) || ']' end, '|' order by i)) as digest from {_B} group by 1")
def bullet_parse(spark, d):
    own = E.bullets(answers(spark, d)).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "bullet"))), lambda x: x["bullet"]), "|").alias("t"))
    return own.select("id", "n", F.md5("t").alias("digest"))


@query("select conv_id, turn, (trim(t) = '' or regexp_matches(t, '(?i)not found in')) as abstained from (select conv_id, turn, case when turn % 4 = 1 then 'Not found in provided context.' when turn % 4 = 3 then 'x not found in y' else text end as t from conversations)")
def abstention(spark, d):
    t = F.when(F.col("turn") % 4 == 1, "Not found in provided context.").when(F.col("turn") % 4 == 3, "x not found in y").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.abstained(t).alias("abstained"))


_STOP = "('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'in', 'is', 'of', 'on', 'or', 'that', 'the', 'to', 'with')"
_NORM = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: t <> '' and t not in " + _STOP + ")"
_JUDGED = rf"""(select b.id, b.i, (b.conv_id + b.i) % 3 = 0 as missing, (b.conv_id + b.i) % 3 <> 0 and (b.conv_id + b.i) % 5 = 0 as invalid, {_NORM.format(c='b.x')} as own, {_NORM.format(c='e.text')} as given, regexp_extract_all(b.x, '-?\d[\d,]*(?:\.\d+)?%?') as nums, e.text as ev
from {_B} b left join documents e on e.doc_id = b.conv_id % 50)"""
_LABEL = "case when missing or invalid then 'unsupported' when len(own) = 0 then 'nonfactual' when len(list_filter(nums, lambda n: not contains(coalesce(ev, ''), n))) > 0 then 'unsupported' when len(list_filter(own, lambda w: list_contains(given, w))) / len(own) >= 0.55 then 'supported' when len(list_filter(own, lambda w: list_contains(given, w))) / len(own) >= 0.3 then 'partial' else 'unsupported' end"


def _evidence(spark, d):
    """Every document, under the token that cites it."""
    return table(spark, d, "documents").select(F.concat(F.lit("DOC:d"), F.col("doc_id").cast("string")).alias("token"), "text")


@query(f"select id, (i - 1)::bigint as ord, missing, invalid, {_LABEL} as label from {_JUDGED}")
def support_heuristic(spark, d):
    a = answers(spark, d)
    return E.validated(a, _evidence(spark, d)).select("id", F.col("ord").cast("long").alias("ord"), "missing", "invalid", "label")


@query(f"""select id, count(*) as bullets, round(count(*) filter (not missing) / count(*), 6) as coverage, round(count(*) filter (not missing and not invalid) / nullif(count(*) filter (not missing), 0), 6) as validity,
round(count(*) filter (label = 'supported') / count(*), 6) as support_rate, round(count(*) filter (label <> 'supported') / count(*), 6) as unsupported_rate from (select *, {_LABEL} as label from {_JUDGED}) group by 1""")
def rag_validation(spark, d):
    a = answers(spark, d)
    return E.answer_metrics(E.validated(a, _evidence(spark, d)))


_PAIR = "(select item_id, case item_id % 4 when 0 then 'Alpha, Beta, Gamma' when 1 then 'about 1,250 units' when 2 then 'it is 5%' else 'Same Answer' end as a, case item_id % 4 when 0 then 'beta, delta' when 1 then '1200' when 2 then '0.05' else 'same answer!' end as g, case item_id % 4 when 0 then 'list' when 1 then 'number tolerance=10%' when 2 then 'percent' else 'text' end as f from benchmark)"


@query(f"""select item_id, case item_id % 4 when 3 then 1.0 else 0.0 end::double as exact, case item_id % 4 when 0 then round(1 / 3, 6) end::double as "precision", case item_id % 4 when 0 then 0.5 end::double as recall, case item_id % 4 when 0 then 0.4 end::double as f1,
case item_id % 4 when 1 then 0.0 when 2 then 1.0 end::double as numeric_exact, case item_id % 4 when 1 then 1.0 when 2 then 1.0 end::double as numeric_close from {_PAIR}""")
def gold_metrics(spark, d):
    k = F.col("item_id") % 4
    pick = lambda *xs: F.when(k == 0, xs[0]).when(k == 1, xs[1]).when(k == 2, xs[2]).otherwise(xs[3])
    m = E.gold_metrics(pick("Alpha, Beta, Gamma", "about 1,250 units", "it is 5%", "Same Answer"), pick("beta, delta", "1200", "0.05", "same answer!"), pick("list", "number tolerance=10%", "percent", "text"))
    return table(spark, d, "benchmark").select("item_id", m.alias("m")).select("item_id", "m.*")


@query("select lang, count(*) as rows, round(avg(coalesce(quality, 0)) * 100, 2) as good_pct, round(avg(n_chars), 4) as avg_n_chars from documents d left join (select doc_id, max(quality)::double as quality from labels group by 1) l on l.doc_id = d.doc_id group by 1")
def run_summary(spark, d):
    labels = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("good"))
    return E.mode_summary(table(spark, d, "documents").join(labels, "doc_id", "left"), "lang", ["good"], ["n_chars"])


@query("with t as (select user_id, max(value) as top from events where value is not null group by 1) select user_id, round(top, 6) as top, top <= (select quantile_cont(top, 0.1) from t) as low from t")
def quantile_low(spark, d):
    return E.low_scores(table(spark, d, "events"), "user_id", "value").select("user_id", F.round("top", 6).alias("top"), "low")


@query("select source, round(b - a, 6) as n_delta from (select coalesce(x.source, y.source) as source, x.n as a, y.n as b from (select source, avg(n_chars) as n from documents where lang = 'en' group by 1) x full join (select source, avg(n_chars) as n from documents where lang = 'de' group by 1) y on x.source = y.source)")
def delta_report(spark, d):
    docs = table(spark, d, "documents")
    of = lambda lang: docs.where(F.col("lang") == lang).groupBy("source").agg(F.avg("n_chars").alias("n"))
    return E.deltas(of("en"), of("de"), "source", ["n"])


@query("select lang, round(avg(n_chars), 3) as mean, count(*) as n from documents group by 1 order by 2 desc nulls last, 1")
def leaderboard(spark, d):
    from ..operators.ranking import leaderboard as board

    return board(table(spark, d, "documents").groupBy("lang").agg(F.round(F.avg("n_chars"), 3).alias("mean"), F.count("*").alias("n")), ["mean"], "lang")


@query("select doc_id, len(v)::bigint as violations, array_to_string(v, ',') as what from (select doc_id, list_filter([case when m = 0 and l then 'unexpected_local' end, case when m <= 1 and w then 'unexpected_web' end, case when m = 0 and c then 'unexpected_context' end, case when m >= 1 and not l then 'missing_local' end, case when m = 2 and not w then 'missing_web' end], lambda x: x is not null) as v from (select doc_id, doc_id % 3 as m, doc_id % 2 = 0 as l, doc_id % 5 < 2 as w, doc_id % 7 = 0 as c from documents))")
def isolation_checks(spark, d):
    i = F.col("doc_id")
    mode = F.when(i % 3 == 0, "no_rag").when(i % 3 == 1, "local_rag").otherwise("hybrid_rag")
    v = R.isolation(mode, i % 2 == 0, i % 5 < 2, i % 7 == 0)
    return table(spark, d, "documents").select("doc_id", v.alias("v")).select("doc_id", F.size("v").cast("long").alias("violations"), F.array_join("v", ",").alias("what"))


@query("select doc_id, sum(p)::bigint as score from (select doc_id, 2 as p from documents where doc_id % 4 = 0 union all select doc_id, 1 from documents where n_chars > 2000 union all select doc_id, 1 from labels where quality = 0) group by 1")
def problem_scores(spark, d):
    docs = table(spark, d, "documents")
    return E.problem_scores({"a": (docs.where("doc_id % 4 = 0"), 2), "b": (docs.where("n_chars > 2000"), 1), "c": (table(spark, d, "labels").where("quality = 0"), 1)}, "doc_id")


@query("select a.conv_id, case when g.item_id is not null then 'q_id' when k.item_id is not null then 'question' else 'missing' end as match from (select distinct conv_id from conversations) a left join benchmark g on g.item_id = a.conv_id left join benchmark k on k.item_id = a.conv_id % 100")
def gold_lookup(spark, d):
    b = table(spark, d, "benchmark")
    gold = b.select(F.col("item_id").alias("id"), F.concat(F.lit("question "), F.col("item_id").cast("string")).alias("question"), F.col("text").alias("answer"))
    asked = table(spark, d, "conversations").select(F.col("conv_id").alias("id")).distinct().withColumn("question", F.concat(F.lit("Question "), (F.col("id") % 100).cast("string"), F.lit("?")))
    return E.matched_gold(asked, gold).select(F.col("id").alias("conv_id"), "match")


@query()
def sentence_units(spark, d):
    return table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.posexplode(T.sentence_units(F.col("text"))).alias("ord", "unit"))
