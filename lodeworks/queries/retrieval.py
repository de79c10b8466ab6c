"""Lexical, dense and fused retrieval: benchmark items ask, documents and embeddings answer."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import ranking as K
from ..operators import retrieval as V
from ..operators.shared import shared_path, shared_table
from ..plans import questions as PQ
from . import query, table
from . import questions as QQ

_TOK = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
IDF = f"(select token, count(*) as df, ln((1.0 + (select count(*) from documents)) / (1.0 + count(*))) + 1.0 as idf from (select doc_id, unnest({_TOK}) as token from documents) group by 1)"
_LEX = f"(select question, id, sum(idf) as score from (select item_id as question, unnest({_TOK}) as token from benchmark) q join {IDF} using (token) join (select doc_id as id, unnest({_TOK}) as token from documents) c using (token) group by 1, 2)"
LEXICAL = f"(select question, id, score, row_number() over (partition by question order by round(score, 6) desc, id) as rank from {_LEX} qualify rank <= 20)"


@query(f"select token, df, round(idf, 6) as idf from {IDF}")
def idf(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("doc_id", "id")
    return V.idf(docs, "text").select("token", "df", F.round("idf", 6).alias("idf"))


def _lexical(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), F.lit(0).alias("variant"), "text")
    return V.lexical_top(asked, docs, V.idf(docs, "text", asked), 20, 6)


@query(f"select question, id, round(score, 6) as score, rank from {LEXICAL}")
def lexical_rank(spark, d):
    return _lexical(spark, d).select("question", "id", "score", F.col("rank").cast("long").alias("rank"))


_PAIRS = "(select q.vec_id as question, e.vec_id as id, round(greatest(0.0, list_cosine_similarity(q.embedding::double[], e.embedding::double[])), 6) as score from embeddings q, embeddings e where q.vec_id % 20 = 0 {more})"
_DENSE = _PAIRS.format(more="")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _dense(spark, d, top):
    """Every vector whose id is divisible by 20 against all."""
    e = _vectors(spark, d)
    q = e.where("id % 20 = 0").select(F.col("id").alias("question"), F.lit(0).alias("variant"), "vector")
    return V.dense_top(q, e, top, digits=6)


@query(f"select question, id, score, rank from (select *, row_number() over (partition by question order by score desc, id) as rank from {_DENSE}) where rank <= 10")
def dense_rank(spark, d):
    return V.top_ranks(_dense(spark, d, 10), 10).select("question", "id", "score", F.col("rank").cast("long").alias("rank"))


#: Three variants of a question: its own vector, the next row's, and their sum.
_VARIANTS = """(select a.vec_id as question, v.variant, case v.variant when 0 then a.embedding::double[] when 1 then b.embedding::double[] else list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double + b.embedding[i]::double) end as vector
from embeddings a join embeddings b on b.vec_id = a.vec_id + 1, (values (0), (1), (2)) v(variant) where a.vec_id % 20 = 0)"""


def variant_vectors(spark, d):
    a = _vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("question"), F.col("vector").cast("array<double>").alias("x"))
    b = _vectors(spark, d).select((F.col("id") - 1).alias("question"), F.col("vector").cast("array<double>").alias("y"))
    both = a.join(b, "question").withColumn("z", F.zip_with("x", "y", lambda p, q: p + q))
    return both.select("question", F.posexplode(F.array("x", "y", "z")).alias("variant", "vector"))


_FUSED = f"""(select question, id, round(rrf, 8) as rrf, row_number() over (partition by question order by round(rrf, 8) desc, id) as rank from (select question, id, sum(1.0 / (60 + r)) as rrf
from (select *, row_number() over (partition by question, variant order by score desc, id) as r from (select q.question, q.variant, e.vec_id as id, round(greatest(0.0, list_cosine_similarity(q.vector, e.embedding::double[])), 6) as score from {_VARIANTS} q, embeddings e)) where r <= 40 group by 1, 2))"""


@query(f"select question, id, rrf, rank from {_FUSED} where rank <= 40")
def rank_fusion_variants(spark, d):
    hits = V.dense_top(variant_vectors(spark, d), _vectors(spark, d), 40, digits=6)
    return K.fused_ranks(hits, digits=8).select("question", "id", "rrf", F.col("rank").cast("long").alias("rank"))


@query(f"with lexical as (select question, id, rank from {LEXICAL}), dense as (select question, id, rank from (select *, row_number() over (partition by question order by score desc, id) as rank from {_DENSE}) where rank <= 20) select coalesce(a.question, b.question) as question, coalesce(a.id, b.id) as id, round(coalesce(0.55 / (60 + a.rank), 0.0) + coalesce(0.45 / (60 + b.rank), 0.0), 8) as fused from dense a full join lexical b on a.question = b.question and a.id = b.id")
def rrf_fusion(spark, d):
    out = K.fusion(V.top_ranks(_dense(spark, d, 20), 20), _lexical(spark, d))
    return out.select("question", "id", F.round("fused", 8).alias("fused"))


def _terms(t, k, i, expr):
    return f"(select {i} as {k}, term, count(*)::double as n from (select {i}, unnest({expr}) as term from {t}) group by 1, 2)"


_W8 = "regexp_extract_all(lower(text), '[a-z0-9][a-z0-9\\-\\+\\.]*')"
_COS = "select x.a, x.b, round(least(1.0, dot / (na * nb)), 6) as cosine from (select x.a, y.b, sum(x.n * y.n) as dot from {x} x join {y} y using (term) group by 1, 2) x join (select a, sqrt(sum(n * n)) as na from {x} group by 1) p on p.a = x.a join (select b, sqrt(sum(n * n)) as nb from {y} group by 1) q on q.b = x.b"


@query(_COS.format(x=_terms("documents", "a", "doc_id", _W8), y=_terms("benchmark", "b", "item_id", _W8)))
def bow_cosine(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return V.bag_cosines(a, b).select("a", "b", F.round("cosine", 6).alias("cosine"))


_HASH = f"list_transform(list_concat({_W8}, list_transform(range(1, len({_W8})), lambda i: ({_W8})[i] || '__' || ({_W8})[i + 1])), lambda g: ('0x' || substr(sha1(g), 1, 8))::bigint % 512)"
_HASH2 = "list_transform(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '__' || w[i + 1])), lambda g: ('0x' || substr(sha1(g), 1, 8))::bigint % 512)"


@query(_COS.format(x=_terms(f"(select doc_id, {_W8} as w from documents)", "a", "doc_id", _HASH2), y=_terms(f"(select item_id, {_W8} as w from benchmark)", "b", "item_id", _HASH2)))
def hashed_cosine(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return V.bag_cosines(a, b, 512).select("a", "b", F.round("cosine", 6).alias("cosine"))


# Retrieval end to end. Documents are chunks, benchmark items are questions; what a chunk's metadata says is made of its
# first words, and a document's or question's vector is the row of the embeddings with its number.
_WORD = "list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> '')[{i}]"
_KINDS = ("row_full", "location_theme", "derived_analytic_summary", "note_reference", "company_profile", "supply_chain_theme")
_KIND = "case doc_id % 6 " + " ".join(f"when {i} then '{k}'" for i, k in enumerate(_KINDS)) + " end"
_INTENT = "case item_id % 3 when 0 then 'aggregation' when 1 then 'definition' else 'fact' end"
_W = lambda i: "coalesce(" + _WORD.format(c="text", i=i) + ", '')"
_CHUNKS = f"(select doc_id as id, text, {_W(1)} as company, lang as sheet, {_W(2)} as category, {_W(3)} as role, {_W(4)} || ' ' || {_W(5)} as product, {_KIND} as kind, {_W(6)} || ' ' || {_W(7)} as title, {_W(8)} as analysis, 'r' || (doc_id // 2) as row_key from documents)"
_NORMAL = "trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_TOKENS_OF = "list_distinct(regexp_extract_all({c}, '[a-z0-9]+'))"
_OVER = lambda c: f"len(list_intersect({_TOKENS_OF.format(c='q')}, {_TOKENS_OF.format(c=_NORMAL.format(c=c))}))"
_HAS = lambda ws: "(" + " or ".join(f"contains(q, '{w}')" for w in ws) + ")"
ROLE_TERMS = ["the", "of", "der", "que"]
_ROLE = " or ".join(f"(contains(q, '{w}') and contains({_NORMAL.format(c='role')}, '{w}'))" for w in ROLE_TERMS)
_IN = lambda c: f"({_NORMAL.format(c=c)} <> '' and contains(q, {_NORMAL.format(c=c)}))"
_BOOST = f"""(case when {_IN('company')} then 0.04 else 0.0 end + case when {_IN('category')} then 0.04 else 0.0 end + case when {_ROLE} then 0.05 else 0.0 end + case when {_OVER('product')} >= 2 then 0.015 else 0.0 end
+ case when contains(q, 'employment') and kind = 'location_theme' then 0.01 else 0.0 end + case when {_HAS(V.BOOST_WORDS['oem'])} and kind = 'supply_chain_theme' then 0.015 else 0.0 end + case when {_HAS(V.BOOST_WORDS['note'])} and kind = 'note_reference' then 0.03 else 0.0 end
+ case when kind = 'derived_analytic_summary' then least(0.06, 0.012 * {_OVER('title')}) + least(0.04, 0.01 * {_OVER('analysis')}) + case when {_HAS(V.BOOST_WORDS['pattern'])} then 0.03 else 0.0 end else 0.0 end)"""
_PRIORITY = "case when kind = 'derived_analytic_summary' then case when intent in ('aggregation', 'comparison') then 2.7 else 1.7 end when intent = 'definition' and kind = 'note_reference' then 2.5 when kind in ('structured_row_match', 'company_profile', 'row_full') then 1.5 when kind = 'note_reference' then 1.0 else 0.0 end"
_RETRIEVE = f"""with chunks as {_CHUNKS}, q as (select item_id as question, text, {_INTENT} as intent, {_NORMAL.format(c='text')} as q from benchmark),
v as (select item_id as question, 0 as variant, text from benchmark union all select item_id, 1, {_W(1)} || ' ' || {_W(2)} || ' ' || {_W(3)} from benchmark),
vec as (select b.item_id as question, x.variant, e.embedding::double[] as vector from benchmark b, (values (0), (1)) x(variant) join embeddings e on e.vec_id = b.item_id + x.variant),
idf as {IDF}, ct as (select id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as token from chunks), vt as (select question, variant, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as token from v),
lex as (select vt.question, vt.variant, ct.id, sum(idf) as score from vt join idf using (token) join ct using (token) group by 1, 2, 3),
lexb as (select l.question, l.id, max(round(l.score + case when c.company <> '' and contains(lower(v.text), lower(c.company)) then 2.5 else 0.0 end + case when c.sheet <> '' and contains(lower(v.text), lower(c.sheet)) then 0.5 else 0.0 end, 6)) as score from lex l join v on v.question = l.question and v.variant = l.variant join chunks c on c.id = l.id group by 1, 2),
lr as (select *, row_number() over (partition by question order by score desc, id) as r from lexb where score > 0 qualify r <= 40),
ds as (select vec.question, vec.variant, e.vec_id as id, round(greatest(0.0, list_cosine_similarity(vec.vector, e.embedding::double[])), 6) as score from vec, embeddings e where e.vec_id in (select id from chunks)),
dt as (select *, row_number() over (partition by question, variant order by score desc, id) as r from ds qualify r <= 40), dq as (select question, id, round(sum(1.0 / (60 + r)), 6) as rrf, max(score) as dense from dt group by 1, 2),
dr as (select *, row_number() over (partition by question order by rrf desc, id) as r from dq), dk as (select * from dr where r <= 40),
f as (select coalesce(dk.question, lr.question) as question, coalesce(dk.id, lr.id) as id, dk.r as d, lr.r as l, lr.score as lexical from dk full join lr on dk.question = lr.question and dk.id = lr.id),
s as (select f.question, f.id, round(coalesce(0.55 / (60 + f.d), 0.0) + coalesce(0.45 / (60 + f.l), 0.0) + {_BOOST}, 5) as final, round(coalesce(dr.dense, 0.0), 5) as dense, round(coalesce(f.lexical, 0.0), 5) as lexical, c.kind, c.company, c.row_key, {_PRIORITY} as priority
  from f join chunks c on c.id = f.id join q on q.question = f.question left join dr on dr.question = f.question and dr.id = f.id),
s1 as (select *, row_number() over (partition by question, row_key order by priority desc, final desc, id) as k from s qualify k = 1), s2 as (select *, row_number() over (partition by question, company order by priority desc, final desc, id) as g from s1 qualify g <= 2 or company = ''),
s3 as (select *, row_number() over (partition by question order by priority desc, final desc, id) as rank from s2) select question, rank, id, final, dense, lexical, kind, company from s3 where rank <= 8"""


def chunks_of(spark, d):
    word = lambda n: T.nth_word(F.col("text"), n)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), "text", word(1).alias("company"), F.col("lang").alias("sheet"), word(2).alias("category"), word(3).alias("role"), F.concat_ws(" ", word(4), word(5)).alias("product"),
        F.get(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 6).cast("int")).alias("kind"), F.concat_ws(" ", word(6), word(7)).alias("title"), word(8).alias("analysis"), F.concat(F.lit("r"), F.floor(F.col("doc_id") / 2).cast("string")).alias("row_key"),
    )


def questions_of(spark, d):
    """Questions with an intent, and two variants of each with a vector."""
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("question"), "text")
    intent = F.get(F.array(F.lit("aggregation"), F.lit("definition"), F.lit("fact")), (F.col("question") % 3).cast("int"))
    word = lambda i: F.coalesce(F.get(F.filter(F.split(T.match_key(F.col("text")), " "), lambda w: w != ""), F.lit(i)), F.lit(""))
    v = b.select("question", F.posexplode(F.array(F.col("text"), F.concat_ws(" ", word(0), word(1), word(2)))).alias("variant", "text"))
    e = _vectors(spark, d).withColumnRenamed("id", "vec")
    return b.withColumn("intent", intent), v.join(e, F.col("vec") == F.col("question") + F.col("variant"), "left").drop("vec")


@query(_RETRIEVE)
def retrieve(spark, d):
    chunks = chunks_of(spark, d)
    asked, variants = questions_of(spark, d)
    return V.retrieve(asked, variants, chunks, V.idf(chunks, "text", variants), role_terms=ROLE_TERMS, digits=6, vectors=_vectors(spark, d))


# The same with questions about the entity table: what their filters find comes first, and what they name is searched, too.
_FOCUS = "array_to_string(list_filter(string_split(q, ' '), lambda w: w <> '' and not list_contains([" + ", ".join(f"'{w}'" for w in PQ.STOPWORDS) + "], w))[1:12], ' ')"
_ASKED = f"select question, text, intent, {_NORMAL.format(c='text')} as q from ({QQ._FORMS})"
_FILTERS = f"(select question, string_agg(value, ' | ' order by case field when 'company' then 0 when 'category' then 1 when 'location' then 2 when 'primary_oems' then 3 else 4 end, len(value) desc, value) as t from {QQ._NAMED} group by 1)"
# A question that names nothing takes all rows, however many there are.
_EVERY = lambda sql: sql.replace(QQ._ALL, "true")
_STRUCTURED = f"""sr as (select question, row_key, company, row_number() over (partition by question order by row_key) as o from {_EVERY(QQ._MATCHED)} where question in (select question from ({_EVERY(QQ._ANSWERS)})) qualify o <= 6),
st as (select distinct question, 0 as ord, 'structured-summary::' || question as id, 'structured_match_summary' as kind, '' as company, '' as row_key from sr union all select question, o, 'structured-row::' || row_key, 'structured_row_match', company, row_key::varchar from sr),
"""
_BOTH = (
    _RETRIEVE.replace("doc_id as id, text, ", "doc_id::varchar as id, text, ", 1).replace("e.vec_id as id", "e.vec_id::varchar as id").replace("e.vec_id in (select id", "e.vec_id::varchar in (select id")
    .replace("round(coalesce(f.lexical, 0.0), 5)", "round(coalesce(f.lexical, 0.0)::decimal(18, 6), 5)::double").replace("round(coalesce(dr.dense, 0.0), 5)", "round(coalesce(dr.dense, 0.0)::decimal(18, 6), 5)::double")
)
_A, _B, _C, _D = _BOTH.index("q as (select item_id"), _BOTH.index("vec as ("), _BOTH.index("idf as ("), _BOTH.index("s1 as (")
_BOTH = (
    _BOTH[:_A] + f"q as ({_ASKED}), v as (select question, 0 as variant, text from q union all select question, 1, {_FOCUS} from q union all select question, 2, t from {_FILTERS}),\n"
    + "vec as (select v.question, v.variant, e.embedding::double[] as vector from v join embeddings e on e.vec_id = v.question + v.variant),\n" + _BOTH[_C:_D] + _STRUCTURED
    + """u as (select question, id, final, dense, lexical, kind, company, row_key, priority, 1 as stage, 0 as ord from s union all select question, id, case ord when 0 then 1.0 else 0.99 end, case ord when 0 then 1.0 else 0.99 end, case ord when 0 then 1.0 else 0.99 end, kind, company, row_key, 9.0, 0, ord from st),
s1 as (select *, row_number() over (partition by question, coalesce(nullif(trim(row_key), ''), id) order by stage, ord, priority desc, final desc, id) as k from u qualify k = 1), s2 as (select *, row_number() over (partition by question, company order by stage, ord, priority desc, final desc, id) as g from s1 qualify g <= 2 or company = ''),
s3 as (select *, row_number() over (partition by question order by stage, ord, priority desc, final desc, id) as rank from s2) select question, rank, id, final, dense, lexical, kind, company from s3 where rank <= 8"""
)


@query(_BOTH)
def retrieve_structured(spark, d):
    """Questions about suppliers: their plan's variants are searched, and their structured results come first."""
    from ..plans.answers import answered, structured_results

    rows, asked = QQ.rows(spark, d), PQ.understood(QQ.asked(spark, d)).select("question", "text", "intent")
    names = PQ.named(asked, rows)
    hits = shared_table(PQ.matched(asked, names, rows, most=None), "hits")
    first = shared_table(structured_results(answered(hits), hits, rows), "structured")
    e = _vectors(spark, d).withColumnRenamed("id", "vec")
    v = shared_table(PQ.variants(asked, names).join(e, F.col("vec") == F.col("question") + F.col("variant"), "left").drop("vec"), "variants")
    chunks = chunks_of(spark, d).withColumn("id", F.col("id").cast("string"))
    vectors = _vectors(spark, d).withColumn("id", F.col("id").cast("string"))
    return V.retrieve(asked, v, chunks, V.idf(chunks, "text", v), first, role_terms=ROLE_TERMS, digits=6, vectors=vectors)


@query("select e.vec_id as id, r.vec_id as reference, round(100.0 * greatest(0.0, list_cosine_similarity(e.embedding::double[], r.embedding::double[])), 2) as score from embeddings e, embeddings r where r.vec_id % 50 = 0")
def reference_matrix(spark, d):
    e = _vectors(spark, d)
    return V.reference_matrix(e, e.where("id % 50 = 0").select(F.col("id").alias("reference"), "vector"))


@query(f"select question, '[' || string_agg('{{\"rank\":' || rank || ',\"id\":' || id || ',\"kind\":\"' || kind || '\"}}', ',' order by rank) || ']' as log from ({_RETRIEVE}) group by 1")
def retrieval_log(spark, d):
    return V.retrieval_log(retrieve(spark, d).select("question", "rank", "id", "kind"))


def _refreshed(spark, d):
    """An index of documents of which some are missing, others and some that are too many are there, then brought to the
    documents as they are."""
    from ..operators import index as X

    docs = shared_table(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text").join(_vectors(spark, d), "id", "left"), "chunks")
    k = F.col("id")
    older = docs.where(k % 97 != 3).withColumn("text", F.when(k % 89 == 5, F.concat("text", F.lit(" since changed"))).otherwise(F.col("text")))
    older = older.unionByName(docs.where(k % 101 == 7).withColumn("id", -k - 1))
    path = shared_path(spark, "index")
    X.refresh(spark, path, older)
    return path, X.refresh(spark, path, docs)


@query(f"select token, df, round(idf, 6) as idf from {IDF}")
def index_refresh(spark, d):
    from ..operators import index as X

    path, _ = _refreshed(spark, d)
    return X.frequencies(spark, path).select("token", "df", F.round("idf", 6).alias("idf"))


@query("select state, count(*) as chunks from (select case when doc_id % 97 = 3 then 'added' when doc_id % 89 = 5 then 'changed' else 'same' end as state from documents union all select 'gone' from documents where doc_id % 101 = 7) group by 1")
def index_changes(spark, d):
    return _refreshed(spark, d)[1]
