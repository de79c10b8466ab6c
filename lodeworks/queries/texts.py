"""Text functions over documents, pages and constructed answers. Spaces and word ends are ASCII where SQL's are."""

from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import html as H
from ..functions import rules as R
from ..functions import text as T
from . import query, table

#: Frequent parts of the invented words, which stand for a domain's keywords.
TERMS = ["the", "tion", "que", "der", "ing", "pre"]
GROUPS = {"english": ["the ", "ing", "of "], "german": ["der ", "ung", "keit"], "romance": ["que", "ción", "ment"]}
_lit = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
SQUEEZE = r"trim(regexp_replace(coalesce({c}, ''), '[\s\x{{00A0}}]+', ' ', 'g'))"
TOKENS = r"regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9][a-z0-9\-\+\.]*')"


@query(f"select doc_id, {SQUEEZE.format(c='text')} as squeezed, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) as key, md5(lower(text)) as lowered from documents")
def normalize_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.squeeze(t).alias("squeezed"), T.match_key(t).alias("key"), F.md5(F.lower(t)).alias("lowered"))


@query(rf"select doc_id, len({TOKENS.format(c='text')}) as tokens, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) as distinct_tokens, len(regexp_extract_all(text, '\S+')) as words, greatest(1, len(text) // 4) as estimate from documents")
def token_stats(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(t)).cast("long").alias("tokens"), F.size(T.token_set(t)).cast("long").alias("distinct_tokens"), T.word_count(t).cast("long").alias("words"), T.token_estimate(t).cast("long").alias("estimate"))


@query(rf"select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({TOKENS.format(c='text')}) as token from documents) group by 1")
def term_frequencies(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(T.term_counts(F.col("text"))).alias("token", "k"))
    return each.groupBy("token").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


@query(f"select doc_id, len(list_filter({_lit(TERMS)}, lambda k: contains(lower(text), k))) as hits from documents")
def keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", T.keyword_count(F.col("text"), TERMS).cast("long").alias("hits"))


_CATS = " + ".join(f"(len(list_filter({_lit(v)}, lambda k: contains(lower(text), k))) > 0)::bigint" for v in GROUPS.values())
_HITS = " + ".join(f"len(list_filter({_lit(v)}, lambda k: contains(lower(text), k)))" for v in GROUPS.values())
_NAMES = ", ".join(f"case when len(list_filter({_lit(v)}, lambda k: contains(lower(text), k))) > 0 then '{k}' end" for k, v in GROUPS.items())


@query(f"select doc_id, {_CATS} as n, {_HITS} as hits, concat_ws(', ', {_NAMES}) as names from documents")
def category_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", R.category_hits(F.col("text"), GROUPS).alias("c")).select("doc_id", F.col("c.n").cast("long").alias("n"), F.col("c.hits").cast("long").alias("hits"), "c.names")


@query(f"select doc_id, {_CATS} as covered from documents")
def question_coverage(spark, d):
    return table(spark, d, "documents").select("doc_id", R.question_coverage(F.col("text"), list(GROUPS.values())).cast("long").alias("covered"))


SPECIFICS = [r"[0-9]+(?:\.[0-9]+)?", r"20[0-9][0-9]", r"(the|der|que) [a-z]+ing"]


@query(f"select doc_id, {' + '.join(f'regexp_matches(lower(text), {chr(39)}{p}{chr(39)})::bigint' for p in SPECIFICS)} as specifics from documents")
def specificity(spark, d):
    return table(spark, d, "documents").select("doc_id", T.specificity(F.col("text"), SPECIFICS).cast("long").alias("specifics"))


_URL = r"""(select page_id, url, regexp_extract(url, '^([a-zA-Z]+)://', 1) as scheme, regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1) as host, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path, regexp_extract(url, '\?([^#]*)', 1) as q from pages)"""
_CANON = rf"""(select page_id, url, path, host, lower(scheme) || '://' || lower(host) || case when path in ('', '/') then '/' else regexp_replace(path, '/+$', '') end || case when kept = '' then '' else '?' || kept end as canonical from (select *, array_to_string(list_filter(string_split(q, '&'), lambda kv: contains(kv, '=') and not ends_with(kv, '=') and not starts_with(lower(kv), 'utm_') and lower(string_split(kv, '=')[1]) not in ('fbclid', 'gclid', 'mc_cid', 'mc_eid', 'mkt_tok', 'ref', 'spm', 'trk')), '&') as kept from {_URL}))"""


@query(f"select page_id, canonical from {_CANON}")
def url_canonical(spark, d):
    return table(spark, d, "pages").select("page_id", T.canonical_url(F.col("url")).alias("canonical"))


@query(f"select page_id, 'CAND_' || upper(left(sha1(canonical), 10)) as id from {_CANON}")
def stable_id(spark, d):
    return table(spark, d, "pages").select("page_id", T.stable_id(F.col("url")).alias("id"))


@query(f"select page_id, lower(host) as domain, case when ends_with(lower(host), '.gov') then 15.0 when ends_with(lower(host), '.edu') then 13.0 when ends_with(lower(host), '.org') then 10.0 else 6.0 end::double as credibility from {_URL}")
def domain_score(spark, d):
    u = T.domain(F.col("url"))
    return table(spark, d, "pages").select("page_id", u.alias("domain"), R.source_credibility(u).alias("credibility"))


@query(rf"select page_id, case when regexp_matches(lower(path), '\.pdf$') then 'PDF' when regexp_matches(lower(path), '\.html?$') then 'HTML' when regexp_matches(lower(path), '\.csv$') then 'CSV' when regexp_matches(lower(path), '\.txt$') then 'TXT' else 'HTML' end as kind, regexp_matches(lower(path), '\.(pdf|html|htm|txt|md)$') as document from {_URL}")
def file_type(spark, d):
    u, none = F.col("url"), F.lit("")
    return table(spark, d, "pages").select("page_id", T.url_file_type(u).alias("kind"), R.probable_document(u, none, none, none).alias("document"))


_UNESC = "replace(replace(replace(replace(replace(replace({c}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
_DOC = rf"array_to_string(list_filter(list_transform(string_split_regex({_UNESC}, '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '[\s\x{{{{00A0}}}}]+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


#: The pages have neither canonical links nor meta titles: every third gets both.
_LINKED = "case when page_id % 3 = 0 then replace(html, '<head>', '<head><meta content=\"Shared  title ' || page_id || '\" property=\"og:title\"><link rel=\"canonical\" href=\"' || url || '\">') else html end"


@query(f"select page_id, case when page_id % 3 = 0 then 'Shared title ' || page_id else {_DOC.format(c='''regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)''')} end as title, case when page_id % 3 = 0 then trim(url) else '' end as link from pages")
def html_title_url(spark, d):
    page = F.expr(_LINKED)
    return table(spark, d, "pages").select("page_id", H.title(page).alias("title"), H.canonical_link(page).alias("link"))


_BARE = "html"
for _tag in ("script", "style", "noscript", "nav", "footer", "header", "aside", "form"):
    _BARE = rf"regexp_replace({_BARE}, '(?is)<{_tag}\b.*?>.*?</{_tag}>', ' ', 'g')"
_PLAIN = rf"trim(regexp_replace({_DOC.format(c='''regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<[^>]+>', ' ', 'g')''')}, '[\s\x{{00A0}}]+', ' ', 'g'))"


#: Pages with what tells content from boilerplate: a block to leave out, and for every other page a block of content
#: with links beside the article.
_PAGE = "replace(html, '<article>', '<div id=\"top-menu\"><div>skip <p>this</p></div></div>' || case when page_id % 2 = 0 then '<div class=\"story\"><div>' || repeat('some <a href=\"x\">linked words</a> here. ', (page_id % 40)::int) || '</div></div>' else '' end || '<article>')"
_IN_PAGE = "<article>(.*?)</article>"
_N = lambda c, p: f"len(regexp_extract_all({c}, '{p}'))"
_SCORE = lambda c, t, more: f"(case when len({t}) = 0 then 0.0 else len({t}) + least(200, 4 * {_N(t, '[.!?:]')}) + 120 * {_N(c, '(?i)<p[ >]')} + 60 * {_N(c, '(?i)<h[1-3][ >]')} - 8 * {_N(c, '(?i)<li[ >]')} - 1500.0 * len({_PLAIN.replace('{c}', _LINKS.format(c=c))}) / greatest(1, len({t})) + {more} end)"
_LINKS = "array_to_string(regexp_extract_all({c}, '(?is)<a [^>]*>(.*?)</a>', 1), ' ')"
_MAIN = f"""with p as (select page_id, regexp_replace({_PAGE}, '(?is)<head>.*?</head>', ' ') as html from pages), b as (select page_id, regexp_replace({_BARE}, '(?is)<div id="top-menu"><div>.*?</div></div>', ' ') as b from p),
x as (select page_id, b, regexp_extract(b, '(?is){_IN_PAGE}', 1) as a, regexp_extract(b, '(?is)<div class="story"><div>(.*?)</div></div>', 1) as s from b),
t as (select *, {_PLAIN.replace('{c}', 'a')} as ta, {_PLAIN.replace('{c}', 's')} as ts, {_PLAIN.replace('{c}', 'b')} as tb from x),
y as (select page_id, ta, ts, tb, {_SCORE('a', 'ta', '400.0')} as sa, {_SCORE('s', 'ts', '250.0')} as ss, {_SCORE('b', 'tb', '250.0')} as sb from t),
l as (select page_id, tb, list_filter([{{'s': round(ss, 6), 'i': 3, 't': ts}}, {{'s': round(sa, 6), 'i': 2, 't': ta}}, {{'s': round(sb, 6), 'i': 1, 't': tb}}], lambda z: len(z.t) >= 250) as c from y)
select page_id, case when list_max(c).s > 0 then list_max(c).t else tb end as main from l"""


@query(_MAIN)
def html_text_fallback(spark, d):
    return table(spark, d, "pages").select("page_id", H.main_text(F.expr(_PAGE.replace("::int", ""))).alias("main"))


_DATED = "case page_id % 3 when 0 then '<meta name=\"date\" content=\"2031-0' || (page_id % 9 + 1) || '\">' || html when 1 then '<meta content=\" 2030 \" property=\"article:modified_time\"><meta name=\"date\" content=\"1999\">' || html else html end"


@query("select page_id, case page_id % 3 when 0 then '2031-0' || (page_id % 9 + 1) when 1 then '2030' else '' end as date from pages")
def html_date(spark, d):
    return table(spark, d, "pages").select("page_id", H.publication_date(F.expr(_DATED)).alias("date"))


_BARE3 = "html"
for _tag in ("script", "style", "noscript"):
    _BARE3 = rf"regexp_replace({_BARE3}, '(?is)<{_tag}\b.*?>.*?</{_tag}>', ' ', 'g')"


@query(f"select page_id, array_to_string(list_filter(list_transform(regexp_extract_all({_BARE3}, '(?is)<h[1-6][^>]*>(.*?)</h[1-6]>', 1), lambda x: {_PLAIN.replace('{c}', 'x')}), lambda x: x <> ''), ' | ') as headings from pages")
def html_headings(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(H.heading_texts(F.col("html")), " | ").alias("headings"))


_NUM = "text || ' 12 gwh plant 2031-04-05 and 7.5 tons in ' || (2000 + doc_id % 90)"


@query(rf"select doc_id, regexp_extract_all({_NUM}, '(?i)[0-9]+(?:\.[0-9]+)? (?:gwh|tons)')[-1] as last_capacity, len(regexp_extract_all({_NUM}, '20[0-9][0-9]-[0-9][0-9]-[0-9][0-9]')) as iso_dates from documents")
def extract_capacities(spark, d):
    t = F.concat(F.col("text"), F.lit(" 12 gwh plant 2031-04-05 and 7.5 tons in "), (2000 + F.col("doc_id") % 90).cast("string"))
    caps = F.filter(T.capacities(t), lambda x: x.rlike("(?i)(gwh|tons)$"))
    return table(spark, d, "documents").select("doc_id", F.element_at(caps, -1).alias("last_capacity"), F.size(F.filter(T.dates(t), lambda x: x.rlike("^20[0-9]{2}-"))).cast("long").alias("iso_dates"))


@query("select doc_id, case when doc_id % 3 = 0 then 'June 5, 2021' when doc_id % 3 = 1 then '2022-01-09' else '2023' end as published from documents")
def publication_date(spark, d):
    dated = F.when(F.col("doc_id") % 3 == 0, "2023 seen June 5, 2021 ").when(F.col("doc_id") % 3 == 1, "in 2020 or 2022-01-09 ").otherwise("of 2023 ")
    return table(spark, d, "documents").select("doc_id", T.publication_date(F.concat(dated, F.col("text"))).alias("published"))


_SENT = rf"string_split(regexp_replace({SQUEEZE.format(c='text')}, '([.!?]) ', '\1' || chr(1), 'g'), chr(1))"
_SCORE = rf"len(list_filter({_lit(TERMS)}, lambda k: contains(lower(s), k))) + 0.6 * len(regexp_extract_all(lower(s), '\b[0-9]+(?:\.[0-9]+)?\b'))"


@query(f"""with s as (select doc_id, {_SENT} as ss from documents), e as (select doc_id, unnest(ss) as s, generate_subscripts(ss, 1) as i, len(ss) as n from s),
r as (select *, row_number() over (partition by doc_id, i = 1 order by {_SCORE} desc, i) as k from e)
select doc_id, left(case when max(n) <= 4 then string_agg(s, ' ' order by i) else string_agg(s, ' ' order by i) filter (i = 1 or k <= 3) end, 750) as summary from r group by 1""")
def extractive_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", T.extractive_summary(F.col("text"), TERMS, ["georgia"], specifics=[]).alias("summary"))


@query(rf"""with w as (select doc_id, string_split({SQUEEZE.format(c='text')}, ' ') as w from documents where {SQUEEZE.format(c='text')} <> ''),
c as (select doc_id, w, least(60, case when len(w) <= 180 then 1 else ceil((len(w) - 180) / 135)::int + 1 end) as n from w), x as (select doc_id, w, unnest(range(n)) as i from c)
select doc_id, i::bigint as i, md5(array_to_string(list_slice(w, i * 135 + 1, i * 135 + 180), ' ')) as chunk from x""")
def word_windows(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.posexplode(C.word_windows(F.col("text"))).alias("i", "chunk"))
    return own.select("doc_id", F.col("i").cast("long").alias("i"), F.md5("chunk").alias("chunk"))


@query(r"""with t as (select doc_id, text, len(text) as n from documents), s as (select doc_id, text, unnest(range(0, case when n <= 1200 then 1 else (ceil((n - 1200) / 1050)::bigint * 1050) + 1 end, 1050)) as start from t)
select doc_id, start::bigint as start, sha1(doc_id || '::' || start) as id, md5(regexp_replace(substring(text, start + 1, 1200), '^\s+|\s+$', '', 'g')) as body from s where regexp_replace(substring(text, start + 1, 1200), '^\s+|\s+$', '', 'g') <> ''""")
def char_windows(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.explode(C.character_windows(F.col("text"))).alias("w"))
    return own.select("doc_id", F.col("w.start").cast("long").alias("start"), C.chunk_id(F.col("doc_id"), F.col("w.start")).alias("id"), F.md5("w.text").alias("body"))


@query(rf"""with s as (select doc_id, {SQUEEZE.format(c='text')} as t from documents), a as (select doc_id, t, unnest([{{'label': 'first', 's': 0}}, {{'label': 'middle', 's': greatest(0, len(t) // 2 - 1100)}}, {{'label': 'late', 's': greatest(0, len(t) - 2200)}}]) as x from s),
f as (select doc_id, t, x.label as label, x.s as s, row_number() over (partition by doc_id, x.s order by case x.label when 'first' then 0 when 'middle' then 1 else 2 end) as k from a)
select doc_id, label, s::bigint as start, md5(trim(substring(t, s::bigint + 1, 2200))) as body from f where k = 1 and t <> ''""")
def anchored_segments(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.explode(C.anchored_segments(F.col("text"))).alias("s"))
    return own.select("doc_id", "s.label", F.col("s.start").cast("long").alias("start"), F.md5("s.text").alias("body"))


@query("""select p_partkey, chunk_type, text from (select p_partkey, 'row_full' as chunk_type, 'Company: ' || p_name || ' | Category: ' || p_brand || ' | Location: ' || p_type as text from part
union all select p_partkey, 'company_profile', 'Company: ' || p_name || ' | Category: ' || p_brand from part union all select p_partkey, 'location_theme', 'Company: ' || p_name || ' | Location: ' || p_type from part)""")
def row_chunks(spark, d):
    cols = {"Company": F.col("p_name"), "Category": F.col("p_brand"), "Location": F.col("p_type")}
    made = C.row_chunks(cols, {"location_theme": ["Company", "Location"]}, ["Company", "Category"])
    return table(spark, d, "part").select("p_partkey", F.explode(made).alias("c")).select("p_partkey", "c.chunk_type", "c.text")


@query("""select conv_id, turn, regexp_replace(lower(regexp_replace(trim(text), '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') as raw_name from conversations""")
def snake_names(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.snake_case(F.col("text")).alias("raw_name"))


@query("select s_suppkey, 'DOC_' || lpad(s_suppkey::varchar, 3, '0') as doc, replace(s_name, '#', '_') || '_DOC_1.pdf' as name from supplier")
def file_names(spark, d):
    own = F.concat(F.replace("s_name", F.lit("#"), F.lit("_")), F.lit(".pdf"))
    return table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("DOC_"), F.lpad(F.col("s_suppkey").cast("string"), 3, "0")).alias("doc"), T.with_suffix(own, F.lit("DOC_1")).alias("name"))


TEMPLATES = ["{topic} supply chain", "who makes {topic}", "{Topic}   capacity 2030"]


@query("""with t as (select p_type as topic, row_number() over (order by p_type) - 1 as t from (select distinct p_type from part)), q as (select replace(tpl, '{topic}', topic) as query, t * 3 + p as ord from t, (values (0, '{topic} supply chain'), (1, 'who makes {topic}'), (2, '{Topic} capacity 2030')) p(p, tpl))
select query, ord::bigint as ord from q qualify row_number() over (partition by lower(query) order by ord) = 1""")
def query_generation(spark, d):
    """Every type of part is a topic; a template without its mark gives one query for all."""
    from pyspark.sql import Window

    from ..plans.curation import generated_queries

    types = table(spark, d, "part").select(F.col("p_type").alias("topic")).distinct()
    return generated_queries(types.withColumn("t", F.row_number().over(Window.orderBy("topic")) - 1), TEMPLATES)  # a row a type


_PLAIN = "trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))"
_HINTS = "supplier tier network facility capacity timeline Georgia Southeast risk resilience localization"
_PDF, _WEB = f"left({_PLAIN} || ' filetype:pdf {_HINTS}', 420)", f"left({_PLAIN} || ' {_HINTS}', 420)"


@query(f"select item_id, 'pdf_only' as label, {_PDF} as query from benchmark union all select item_id, 'web_only', {_WEB} from benchmark where lower({_WEB}) <> lower({_PDF})")
def query_variants(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.explode(T.query_variants(F.col("text"))).alias("v")).select("item_id", "v.label", "v.query")
