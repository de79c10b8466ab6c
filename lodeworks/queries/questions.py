"""Questions as a table. Suppliers are the entities; benchmark items' numbers make the questions."""

from pyspark.sql import functions as F

from ..functions import vocab
from ..operators import analytics as A
from ..plans import questions as Q
from ..sources.readers import table_rows
from . import query, table

_CELLS = {
    "row_key": "s_suppkey", "company": "'Acme ' || (s_suppkey % 68)", "category": "case s_suppkey % 4 when 0 then 'OEM' when 1 then 'Tier 1' when 2 then 'Tier 2/3' else 'Tier 1/2' end",
    "role": "case s_suppkey % 5 when 0 then 'battery cells' when 1 then 'Battery Pack and Charging Gear' when 2 then 'charging gear' when 3 then 'vehicle assembly' else 'wire goods' end", "product_service": "'makes harness ' || (s_suppkey % 9) || case when s_suppkey % 11 = 0 then ' of wire' else '' end",
    "location": "'City' || s_nationkey || case when s_nationkey % 2 = 1 then ', C' || (s_nationkey % 5) || ' County' else '' end", "primary_oems": "case s_suppkey % 6 when 0 then '' when 2 then 'Acme ' || (s_suppkey % 5) when 3 then 'Multiple OEMs' when 4 then 'Ford and GM Plants' else 'Kia Motors' end",
    "employment": "case when s_suppkey % 8 <> 0 then cast(floor(s_acctbal) as bigint) end", "industry_group": "case when s_suppkey % 7 = 0 then '' else 'Group ' || (s_suppkey % 3) end", "primary_facility_type": "case when s_suppkey % 3 = 0 then 'Engineering and Manufacturing' else 'Manufacturing' end",
    "ev_battery_relevant": "case s_suppkey % 9 when 0 then '' when 1 then 'No' when 2 then 'Indirect' else 'Yes' end", "classification_method": "case when s_suppkey % 10 = 1 then 'Public OEM footprint / supplier listing' else 'Survey' end", "supplier_or_affiliation_type": "case when s_suppkey % 12 = 0 then '' else 'Direct' end",
}
_ROWS = "(select " + ", ".join(f"{v} as {k}" for k, v in _CELLS.items()) + ", case when s_nationkey % 2 = 1 then 'C' || (s_nationkey % 5) || ' County' else '' end as county from supplier)"
_ALL = "(select count(*) <= 150 from supplier)"
_L = {"category": "Category", "role": "EV Supply Chain Role", "product_service": "Product / Service", "primary_oems": "Primary OEMs", "location": "Location", "primary_facility_type": "Primary Facility Type", "employment": "Employment", "ev_battery_relevant": "EV / Battery Relevant", "classification_method": "Classification Method"}


def _lines(heading, fields, where="true", order="row_key"):
    cells = "".join(f" || case when coalesce({f}::varchar, '') <> '' then ' | {_L[f]}: ' || {f} else '' end" for f in fields)
    return f"select question, '{heading}' || chr(10) || string_agg('- Company: ' || company{cells}, chr(10) order by {order}) as said from m where {where} group by 1"


def _groups(heading, field, line, order="v", where="true", having="true", tail=""):
    """One line a group: n, e (all employment), mean, firms and roles (arrays) are the group's."""
    return f"""select question, '{heading}' || chr(10) || string_agg({line}, chr(10) order by {order}){tail} as said from (select question, {field} as v, count(*) as n, sum(employment)::bigint as e, avg(employment) as mean, list_sort(list_distinct(list(company))) as firms, list_sort(list_distinct(list(role))) as roles
      from m where {field} <> '' and {where} group by 1, 2 having {having}) group by 1"""


_PLACES = f"'location in [''' || (select string_agg(v, ''', ''' order by len(v) desc, v) from (select distinct location as v from {_ROWS} where county = 'C' || (i % 5) || ' County')) || ''']'"
_CONCENTRATED = """select question, 'Most concentrated EV Supply Chain Role:' || chr(10) || '- Role: ' || role || chr(10) || '- County: ' || county || chr(10) || '- Share: ' || printf('%.2f', share) || chr(10) || '- Companies: ' || array_to_string(firms, ', ') as said
  from (select *, n / sum(n) over (partition by question, role) as share, row_number() over (partition by question, role order by n desc, county) as k from (select question, role, county, count(*) as n, list_sort(list_distinct(list(company))) as firms from m where county <> '' group by 1, 2, 3)) where k = 1 qualify row_number() over (partition by question order by share desc, role) = 1"""
_SUMS = {k: f"(select question, string_agg(v || ': ' || n, '; ' order by n desc, v) as {k} from (select question, {f} as v, count(*) as n from m where classification_method <> 'Survey' group by 1, 2) group by 1)" for k, f in (("c", "category"), ("e", "ev_battery_relevant"))}
_LISTED = f"""select question, 'Public OEM footprint / supplier listing [' || n || ' rows]:' || chr(10) || 'Category summary: ' || c || chr(10) || 'EV / Battery Relevant summary: ' || e || chr(10) || 'Companies: ' || f as said
  from (select question, count(*) as n, string_agg(company, '; ' order by row_key) as f from m where classification_method <> 'Survey' group by 1) join {_SUMS['c']} using (question) join {_SUMS['e']} using (question)"""
_RANGE = "select question, 'Employment range:' || chr(10) || '- Min: ' || min(employment) || ' | Company: ' || first(company order by employment, row_key) || chr(10) || '- Max: ' || max(employment) || ' | Company: ' || first(company order by employment desc, row_key) as said from m where employment is not null group by 1"
_FIRST = "row_key in (select row_key from m o where o.question = m.question and employment is not null order by employment desc, company, row_key limit 3)"
_IN_COUNTY = "county = 'C' || (i % 5) || ' County'"
#: Question, the rows that it chooses, the filters named, the template, and the answer: what the rules say of it. i is the
#: question's number; rows are r, chosen rows m.
_KINDS = [
    ("'Show all Tier 1 companies grouped by EV Supply Chain Role for charging gear.'", "category = 'Tier 1' and contains(lower(role), 'charging gear')", "'category in [''Tier 1''], role terms in [''charging gear'']'", "grouped_listing", _groups("Grouped by EV Supply Chain Role:", "role", "'- ' || v || ': ' || array_to_string(firms, '; ')")),
    ("'category is Tier 2/3 and count by industry group'", "category = 'Tier 2/3'", "'category in [''Tier 2/3'']'", "counts", _groups("Counts by Industry Group:", "industry_group", "'- ' || v || ': ' || n", "n desc, v")),
    ("'List Tier 1 suppliers excluding location = City' || (i % 25) || '.'", "category = 'Tier 1' and location <> 'City' || (i % 25)", "'category in [''Tier 1''], location not in [''City' || (i % 25) || ''']'", "details", _lines("Matching rows:", ["location"])),
    ("'Which suppliers are linked to Acme ' || (i % 5) || '?'", "primary_oems = 'Acme ' || (i % 5)", "'primary OEMs in [''Acme ' || (i % 5) || ''']'", "linked", _lines("Linked companies:", ["role", "location", "employment", "ev_battery_relevant"])),
    ("'Which suppliers of wire goods have OEM contracts?'", "role = 'wire goods'", "'role terms in [''wire goods'']'", "details", _lines("Matching rows:", [])),
    ("'How many companies are there by county?'", _ALL, "''", "counts", _groups("Counts by County:", "county", "'- ' || v || ': ' || n", "n desc, v")),
    ("'Compare total employment by EV Supply Chain Role, with the highest'", _ALL, "''", "totals", _groups("Total Employment by EV Supply Chain Role:", "role", "'- ' || v || ': ' || e", "e desc, v", "employment is not null", tail=" || chr(10) || 'Highest: ' || arg_max(v, e) || ' (' || max(e) || ')'")),
    ("'Average employment by category for Tier 1/2 rows'", "category in ('Tier 1', 'Tier 1/2')", "'category in [''Tier 1/2'', ''Tier 1'']'", "averages", _groups("Average Employment by Category:", "category", "'- ' || v || ': ' || printf('%.2f', mean)", "mean desc, v", "employment is not null")),
    ("'What is the median employment of Kia Motors suppliers?'", "primary_oems = 'Kia Motors'", "'primary OEMs in [''Kia Motors'']'", "median", "select question, 'Median Employment: ' || round_even(median(employment), 0)::bigint as said from m group by 1"),
    ("'Give the range of employment in C' || (i % 5) || ' County'", _IN_COUNTY, _PLACES, "range", _RANGE),
    ("'Top 3 companies with highest employment in Tier 2/3'", "category = 'Tier 2/3'", "'category in [''Tier 2/3'']'", "ranked", _lines("Employment-ranked companies:", ["employment"], _FIRST, "employment desc, company, row_key")),
    ("'Which companies appear multiple times with distinct EV Supply Chain Roles?'", _ALL, "''", "several_roles", _groups("Companies appearing multiple times with distinct EV Supply Chain Roles:", "company", "'- ' || v || ': ' || array_to_string(roles, ', ')", having="count(distinct role) > 1")),
    ("'Which EV Supply Chain Role is most concentrated in a single county?'", _ALL, "''", "concentrated", _CONCENTRATED),
    ("'Which industry groups are represented among OEM companies?'", "category = 'OEM'", "'category in [''OEM'']'", "groups_named", "select question, 'Industry Groups represented:' || chr(10) || '- ' || string_agg(v, '; ' order by v) as said from (select distinct question, industry_group as v from m where industry_group <> '') group by 1"),
    ("'List suppliers with missing Primary OEMs in Tier 2/3'", "category = 'Tier 2/3'", "'category in [''Tier 2/3'']'", "missing_oems", _lines("Entries with missing Primary OEMs:", ["role"], "primary_oems = ''")),
    ("'EV / Battery Relevant: yes versus indirect for charging gear'", "contains(lower(role), 'charging gear')", "'role terms in [''charging gear'']'", "relevance", _groups("EV / Battery Relevant groups:", "ev_battery_relevant", "'- ' || v || ': ' || n || chr(10) || '  Companies: ' || array_to_string(firms, ', ')")),
    ("'Which mentions \"harness ' || (i % 9) || '\" in Product / Service?'", _ALL, "''", "mentions", _lines("Matching Product / Service entries:", ["product_service"], "contains(product_service, 'harness ' || (question % 9)) or contains(product_service, 'wire')")),
    ("'What is the methodology of each classification method for Tier 1?'", _ALL, "''", "details", _lines("Matching rows:", ["classification_method"])),
    ("'Which rows have Employment >= ' || (i * 50) || ' of Tier 1?'", "category = 'Tier 1'", "'category in [''Tier 1'']'", "details", _lines("Matching rows:", ["employment"], "employment >= question * 50")),
    ("'Which suppliers supply to more than one OEM in C' || (i % 5) || ' County?'", _IN_COUNTY, _PLACES, "several_oems", _lines("Companies linked to more than one explicit OEM:", ["primary_oems"], "primary_oems = 'Ford and GM Plants'")),
    ("'Give the public OEM footprint / supplier listing of Tier 1'", "category in ('OEM', 'Tier 1')", "'category in [''Tier 1'', ''OEM'']'", "public_listing", _LISTED),
    ("'Which primary facility type containing both words has vehicle assembly?'", "role = 'vehicle assembly'", "'role terms in [''vehicle assembly'']'", "containing_both", _lines("Primary Facility Type matches:", ["primary_facility_type"], "primary_facility_type <> 'Manufacturing'")),
    ("'Count entries whose category starts with OEM by supplier or affiliation type'", _ALL, "''", "details", _lines("Matching rows:", ["category"], "category = 'OEM' and supplier_or_affiliation_type = ''")),
    ("'List all Tier 1 companies grouped by EV Supply Chain Role and count them'", "category = 'Tier 1'", "'category in [''Tier 1'']'", "grouped", _groups("Grouped by EV Supply Chain Role:", "role", "'- ' || v || ': ' || array_to_string(firms, '; ')")),
]
_TEXT = "case i % 24 " + " ".join(f"when {k} then {t}" for k, (t, *_) in enumerate(_KINDS)) + " end"
_MATCHED = "(" + " union all ".join(f"select i as question, r.* from (select item_id as i from benchmark where item_id % 24 = {k}) b, {_ROWS} r where {where}" for k, (_, where, *_) in enumerate(_KINDS)) + ")"
#: (question, template, filters, said) of every kind.
_SAID = " union all ".join(f"select question, '{t}' as template, {f.replace('i %', 'question %')} as filters, said from (with m as (select * from matched where question % 24 = {k}) {body})" for k, (_, _, f, t, body) in enumerate(_KINDS))
_ANSWERS = f"with matched as materialized {_MATCHED} select a.question, template, t.rows, 'Structured workbook matches from exact metadata filters:' || chr(10) || 'Applied filters: ' || filters || chr(10) || 'Matched rows: ' || t.rows || chr(10) || said as text from ({_SAID}) a join (select question, count(*) as rows from matched group by 1) t on t.question = a.question"
#: (question, field, value) that the kinds name.
_NAMES = {
    "category": "when i % 24 in (0, 2, 18, 23) then ['Tier 1'] when i % 24 in (1, 10, 14) then ['Tier 2/3'] when i % 24 = 7 then ['Tier 1', 'Tier 1/2'] when i % 24 = 13 then ['OEM'] when i % 24 = 20 then ['OEM', 'Tier 1']",
    "role": "when i % 24 in (0, 15) then ['charging gear'] when i % 24 = 4 then ['wire goods'] when i % 24 = 21 then ['vehicle assembly']",
    "primary_oems": "when i % 24 = 3 then ['Acme ' || (i % 5)] when i % 24 = 8 then ['Kia Motors']",
}
_NAMED = "(" + " union all ".join(f"select i as question, '{f}' as field, unnest(case {c} else [] end) as value from (select item_id as i from benchmark)" for f, c in _NAMES.items()) + f" union all select item_id, 'location', location from benchmark, (select distinct location, county from {_ROWS}) where item_id % 24 in (9, 19) and county = 'C' || (item_id % 5) || ' County')"


def rows(spark, d):
    return table(spark, d, "supplier").selectExpr(*(f"{v} as {k}" for k, v in _CELLS.items()))


def asked(spark, d):
    return table(spark, d, "benchmark").selectExpr("item_id as question", "item_id as i").selectExpr("question", f"{_TEXT} as text")


_GROUPED = {0: "role", 1: "industry_group", 2: "city", 5: "county", 6: "role", 7: "category", 9: "county", 11: "role", 12: "role", 13: "industry_group", 14: "primary_oems", 15: "ev_battery_relevant", 17: "classification_method", 19: "county", 21: "primary_facility_type", 22: "supplier_or_affiliation_type", 23: "role"}
_FORMS = f"""select i as question, {_TEXT} as text, case when i % 24 = 17 then 'definition' when i % 24 in (6, 15) then 'comparison' when i % 24 in (0, 1, 2, 5, 9, 12, 13, 14, 19, 20, 22, 23) then 'aggregation' else 'fact' end as intent,
case i % 24 {' '.join(f"when {k} then '{v}'" for k, v in _GROUPED.items())} end as group_field,
case i % 24 when 6 then 5 when 10 then 3 end as top, case when i % 24 = 18 then '>=' end as op, case when i % 24 = 18 then i * 50 end as value, case when i % 24 = 2 then 'City' || (i % 25) else '' end as excluded, case when i % 24 = 16 then 'harness ' || (i % 9) else '' end as quoted,
i % 24 not in (0, 2, 3, 4, 20) as analytic, i % 24 in (0, 23) as exhaustive from (select item_id as i from benchmark)"""


@query(_FORMS)
def question_forms(spark, d):
    out = Q.understood(asked(spark, d))
    return out.select("question", "text", "intent", F.col("group").alias("group_field"), F.col("limit").alias("top"), "threshold.op", "threshold.value", F.array_join("excluded", "|").alias("excluded"), F.array_join("quoted", "|").alias("quoted"), "analytic", "exhaustive")


@query(f"select question, field, value from {_NAMED}")
def question_names(spark, d):
    return Q.named(asked(spark, d), rows(spark, d)).select("question", "field", "value")


@query(f"select question, row_key from {_MATCHED}")
def structured_filter(spark, d):
    r, q = rows(spark, d), asked(spark, d)
    return Q.matched(q, Q.named(q, r), r)


@query(_ANSWERS)
def question_answers(spark, d):
    """Twenty-four kinds of questions, each with rows and an answer of its own."""
    from ..plans.answers import answers

    r, q = rows(spark, d), asked(spark, d)
    names = Q.named(q, r)
    return answers(q, Q.matched(q, names, r), r, names)


@query(f"""with m as (select question, row_key, company, category, employment from {_MATCHED}), c as (select question, string_agg(category || ': ' || n, '; ' order by n desc, category) as categories from (select question, category, count(*) as n from m group by 1, 2) group by 1),
f as (select question, string_agg(company, '; ' order by company) filter (k <= 5) as companies, greatest(0, count(*) - 5) as more from (select question, company, row_number() over (partition by question order by company) as k from (select distinct question, company from m)) group by 1), t as (select question, count(*) as rows, sum(employment)::bigint as employment from m group by 1)
select question, rows, employment, categories, companies, more, 'Matched rows: ' || rows || chr(10) || 'By category: ' || categories || chr(10) || 'Companies: ' || companies || case when more > 0 then ' (+' || more || ' more)' else '' end as summary from t join c using (question) join f using (question)""")
def structured_summary(spark, d):
    r, q = rows(spark, d), asked(spark, d)
    return Q.summaries(Q.matched(q, Q.named(q, r), r), r)


@query("select c_custkey, c_acctbal, case c_custkey % 3 when 0 then '>=' when 1 then '<' else '>=' end as op from customer where case c_custkey % 3 when 1 then floor(c_acctbal) < c_nationkey * 400 when 0 then floor(c_acctbal) >= c_nationkey * 400 else floor(c_acctbal) >= 5000 + c_nationkey end")
def numeric_threshold(spark, d):
    """Each row has a question of its own, from which its limit is read."""
    from ..functions.rules import employment_limit

    k, n = F.col("c_custkey") % 3, (F.col("c_nationkey") * 400).cast("string")
    asked = F.when(k == 0, F.concat(F.lit("Which have employment >= "), n, F.lit("?"))).when(k == 1, F.concat(F.lit("EMPLOYMENT<"), n)).otherwise(F.concat(F.lit("with employment at least 5,"), F.lpad(F.col("c_nationkey").cast("string"), 3, "0")))
    c = table(spark, d, "customer").withColumn("t", employment_limit(asked))
    e = F.floor("c_acctbal")
    return c.where(F.when(F.col("t.op") == ">=", e >= F.col("t.value")).otherwise(e < F.col("t.value"))).select("c_custkey", "c_acctbal", "t.op")


_CELL = "case when o_orderkey % 11 = 0 then null when o_orderkey % 7 = 0 then ' N/A ' when o_orderkey % 5 = 0 then '' else o_orderpriority end"


@query("select o_orderkey, o_orderkey % 11 = 0 or o_orderkey % 7 = 0 or o_orderkey % 5 = 0 as missing from orders")
def missing_value(spark, d):
    return table(spark, d, "orders").select("o_orderkey", Q.missing(F.expr(_CELL)).alias("missing"))


@query("select doc_id, contains(lower(text), 'the in') or contains(lower(text), 'der') as mentioned from documents")
def quoted_mention(spark, d):
    return table(spark, d, "documents").select("doc_id", Q.mentions_quoted(F.col("text"), F.lit("see \"The in\" or 'der  '")).alias("mentioned"))


@query("select doc_id, contains(lower(text), 'the') and contains(lower(text), 'ing') as every, contains(lower(text), 'tion of') or contains(lower(text), 'der ver') as mentioned from documents")
def contains_all_terms(spark, d):
    """Terms are what a question quotes."""
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", Q.contains_all(t, Q.quoted_terms(F.lit("both \"The\" and 'ing'"))).alias("every"), Q.mentions_quoted(t, F.lit('see "Tion of" or "der ver"')).alias("mentioned"))


_OEMS = "case p_partkey % 4 when 0 then p_brand when 1 then p_brand || ' / ' || p_type when 2 then p_brand || ' and ' || p_brand else p_brand || '; ' || p_name end"


@query("select p_partkey, p_partkey % 4 in (1, 3) and (p_partkey % 4 = 1 or p_brand <> p_name) as several from part")
def multi_value_pred(spark, d):
    return table(spark, d, "part").select("p_partkey", Q.several_values(F.expr(_OEMS)).alias("several"))


@query("select s_suppkey, 'Company: ' || s_name || ' | Area: ' || s_nationkey as line from supplier")
def detail_lines(spark, d):
    cells = {"Company": F.col("s_name"), "OEM": F.lit(" unknown "), "Area": F.col("s_nationkey").cast("string"), "Blank": F.lit(None).cast("string")}
    return table(spark, d, "supplier").select("s_suppkey", Q.labelled(cells).alias("line"))


@query(f"select row_key, company, 'County' || (s_nationkey % 5) || ' County' as county, 'City' || s_nationkey as city, case when s_suppkey % 8 <> 0 then (s_suppkey * 1250)::bigint end as employment, '' as nothing from (select *, s_suppkey as row_key, 'Acme ' || s_suppkey as company from supplier)")
def typed_rows(spark, d):
    """Rows of cells as a reader gives them: maps of what isn't blank."""
    s = table(spark, d, "supplier")
    k, n = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    cells = s.select(k.cast("string").alias("Key"), F.concat(F.lit(" Acme "), k.cast("string")).alias("Company"), F.concat(F.lit("City"), n, F.lit(", County"), (F.col("s_nationkey") % 5).cast("string"), F.lit(" County")).alias("Location"), F.when(k % 8 != 0, F.format_number(k * 1250, 0)).alias("Employment"))
    out = Q.typed(table_rows(cells), {"row_key": "Key", "company": "Company", "location": "Location", "employment": "Employment", "nothing": "Absent"})
    return out.select(F.col("row_key").cast("long").alias("row_key"), "company", F.concat(F.lit("County"), F.regexp_extract("location", r"County(\d)", 1), F.lit(" County")).alias("county"), "city", "employment", "nothing")


@query("select kind, names, aliases, examples from (select 'company' as kind, count(distinct s_name) as names, count(distinct s_name) * 2 as aliases, (select string_agg(n, '; ' order by n) from (select distinct s_name || ' Inc' as n from supplier order by 1 limit 5)) as examples from supplier union all select 'county', count(distinct n_name), count(distinct n_name) * 2, (select string_agg(n, '; ' order by n) from (select distinct n_name || ' Long County' as n from nation order by 1 limit 5)) from nation)")
def grounding_names(spark, d):
    s = table(spark, d, "supplier").select(F.concat("s_name", F.lit(" Inc")).alias("company"), F.lit(None).cast("string").alias("county"))
    n = table(spark, d, "nation").select(F.lit("").alias("company"), F.concat("n_name", F.lit(" Long County")).alias("county"))
    return Q.vocabulary_summary(Q.vocabulary(s.unionByName(n), {"company": "company", "county": "county"}))


@query("select distinct p_type as value, (-len(p_type))::int as ord from part where trim(p_type) <> ''")
def known_values(spark, d):
    return Q.known_values(table(spark, d, "part"), "p_type")


@query("select s_suppkey, s_name || ' x y' as term from supplier")
def seed_terms(spark, d):
    raw = F.concat(F.lit(" -*["), F.col("s_name"), F.lit("]*  x | y  z , more words that are not taken here,"))
    return table(spark, d, "supplier").select("s_suppkey", Q.seed_term(raw, words=4).alias("term"))


@query("select item_id, case when item_id % 5 in (0, 1) then '1=knowledge,2=pretrained' end as labels from benchmark")
def attribution_parse(spark, d):
    i = F.col("item_id") % 5
    good = '[{"unit": 1, "source": "Knowledge"}, {"unit": 2, "source": "pretrained"}]'
    raw = F.when(i == 0, good).when(i == 1, f"Sure:\n{good} done").when(i == 2, '[{"unit": 1, "source": "knowledge"}]').when(i == 3, '[{"unit": 1, "source": "guess"}, {"unit": 2, "source": "pretrained"}]').otherwise("no labels")
    made = Q.attribution_labels(raw, F.lit(2))
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.transform(made, lambda x: F.concat_ws("=", x["unit"].cast("string"), x["source"])), ",").alias("labels"))


@query("select item_id, case when item_id % 2 = 0 and item_id % 3 <> 0 then item_id / 10.0 end as accuracy, case when item_id % 2 = 0 and item_id % 5 <> 0 then item_id / 20.0 end as grounding from benchmark")
def response_metrics(spark, d):
    i = F.col("item_id")
    made = Q.response_metrics(i % 2 == 0, F.when(i % 3 != 0, "gold").otherwise(" "), F.when(i % 5 != 0, "context"), i / 10.0, i / 20.0)
    return table(spark, d, "benchmark").select("item_id", made.alias("m")).select("item_id", "m.accuracy", "m.grounding")




@query(f"select page_id as id, case when page_id % 3 = 0 then null else 'dir/' || page_id || '.html' end as path from pages")
def path_resolution(spark, d):
    """Files of two of three pages are there; a row knows its file by a path, a file name or its title."""
    k = F.col("page_id").cast("string")
    p = table(spark, d, "pages")
    files = p.where("page_id % 3 <> 0").select(F.concat(F.lit("dir/"), k, F.lit(".html")).alias("path"))
    by_path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("dir/"), k, F.lit(".html")))
    paths = Q.path_candidates(F.lit(""), by_path, F.lit("elsewhere/x.pdf"), F.lit("other/"), F.lit("y.txt"))
    names = Q.local_names(F.when(F.col("page_id") % 4 == 1, F.concat(k, F.lit(".HTML"))), F.lit("https://x.example/"), k)
    return Q.resolved_paths(p.select(F.col("page_id").alias("id"), paths.alias("paths"), names.alias("names")), files)


@query("with p as (select conv_id, turn, text from conversations where trim(text) <> ''), u as (select *, coalesce(sum(len(text)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding), 0) as used from p) select conv_id, turn, left(text, (600 - used)::bigint) as text from u where used < 600")
def page_budget(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("page"), "text")
    return Q.page_budget(pages, 600).select(F.col("id").alias("conv_id"), F.col("page").alias("turn"), "text")


@query("select s_nationkey % 4 as g, case when s_suppkey % 3 = 0 then 'Yes' else 'Indirect' end as label, count(*) as n, string_agg(s_name, '; ' order by s_name) as names from supplier where s_suppkey % 3 <> 2 group by 1, 2")
def relevance_groups(spark, d):
    """Companies by group and relevance (yes or indirect), listed."""
    k = F.col("s_suppkey") % 3
    s = table(spark, d, "supplier").withColumn("label", F.when(k == 0, "Yes").when(k == 1, "Indirect").otherwise("")).withColumn("g", F.col("s_nationkey") % 4)
    return A.labelled_groups(s, ["g"], "label", "s_name", ["Yes", "Indirect"])


@query("select 'segment' as field, c_mktsegment as value, count(*) as n from customer group by 2 union all select 'nation', n_name, count(*) from customer join nation on c_nationkey = n_nationkey group by 2")
def multi_key_summary(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return A.counts_by_field(c, {"segment": "c_mktsegment", "nation": "n_name"})


@query("select distinct p_type as value from part where trim(p_type) <> ''")
def distinct_values(spark, d):
    return A.represented(table(spark, d, "part"), "p_type")


@query("select c_mktsegment, round(median(c_acctbal), 6) as median from customer group by 1")
def median_value(spark, d):
    out = A.medians(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("c_mktsegment", F.round("median", 6).alias("median"))


@query("select 'orders' as stage, count(*) as rows, null::bigint as finished from orders union all select 'large', count(*), count(*) filter (o_orderstatus = 'F') from orders where o_totalprice > 200000")
def pipeline_counters(spark, d):
    from ..plans.curation import report

    o = table(spark, d, "orders")
    large = o.where("o_totalprice > 200000")
    return report({"orders": o, "large": large}, {"large": {"finished": F.col("o_orderstatus") == "F"}})


_LOW = "lower(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')))"
_SAYS = lambda ws: "(" + " or ".join(f"contains({_LOW}, '{w}')" for w in ws) + ")"
_ROUTED = "(select conv_id, turn, text || case conv_id % 5 when 0 then '  is DEMAND for  imports growing?' when 1 then ' x  vs  y' when 2 then ' and bottleneck' else '' end as text from conversations)"


@query(f"select conv_id, turn, case when {_SAYS(vocab.ROUTES['web_needed'])} then 'web_needed' when {_SAYS(vocab.ROUTES['analytic'])} then 'analytic' else 'lookup' end as route from {_ROUTED}")
def question_route(spark, d):
    """Whole turns, to some of which a question is added."""
    from ..functions.rules import route

    k = F.col("conv_id") % 5
    said = F.concat("text", F.when(k == 0, "  is DEMAND for  imports growing?").when(k == 1, " x  vs  y").when(k == 2, " and bottleneck").otherwise(""))
    return table(spark, d, "conversations").select("conv_id", "turn", route(said).alias("route"))
