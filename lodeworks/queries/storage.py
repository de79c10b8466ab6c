"""Sources, sinks and streams: tables written to the shared folder, read or streamed back, and compared."""

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.shared import shared_path
from ..sources import readers as S
from ..sources import sinks as K
from ..streaming import ingest as I
from . import query, table
from .texts import _CANON as CANONICAL


_folder = shared_path


@query("select doc_id, lang, source, n_chars, md5(coalesce(text, '')) as text from documents")
def json_lines(spark, d):
    """Documents as JSON lines and back; lines that are no JSON are dropped."""
    path = _folder(spark, "json")
    docs = table(spark, d, "documents").withColumn("_private", F.lit(1))
    K.write_json(docs, path)
    spark.createDataFrame([("{broken",), ('{"doc_id": 3, "lang": ',)], "value string").coalesce(1).write.mode("append").text(path)
    back = S.json_lines(spark, path, docs.drop("_private").schema).where("doc_id is not null")
    return back.select("doc_id", "lang", "source", "n_chars", F.md5(F.coalesce("text", F.lit(""))).alias("text"))


@query("select s_suppkey::varchar as s_suppkey, s_name, left(s_name || ' ab', 12) as cut, '[1,2]' as list from supplier")
def csv_cells(spark, d):
    """Rows as CSV and back: nested cells as JSON, no control characters, no private columns."""
    path = _folder(spark, "csv")
    own = table(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("S Name"), F.array(F.lit(1), F.lit(2)).alias("list"), F.concat(F.col("s_name"), F.lit(" a\x07b")).alias("cut"), F.lit("x").alias("_own"))
    K.write_csv(own, path)
    back = spark.read.option("header", True).csv(path)
    return back.select("s_suppkey", "s_name", F.left("cut", F.lit(12)).alias("cut"), "list")


@query("select s_suppkey, s_name, '' as extra, s_nationkey from supplier")
def column_contract(spark, d):
    return K.contract(K.public(table(spark, d, "supplier").select("s_nationkey", "s_name", "s_suppkey", F.lit(1).alias("_x"))), ["s_suppkey", "s_name", "extra"])


@query("select 'query ' || s_suppkey as query, row_number() over (order by s_suppkey) + 2 as ord from supplier where s_suppkey >= (select min(s_suppkey) + 3 from supplier) and s_suppkey < (select min(s_suppkey) + 13 from supplier)")
def query_list_scan(spark, d):
    """Lines of a text with blank ones between: ten queries from the fourth on."""
    path = _folder(spark, "queries")
    line = F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda k: F.concat(F.lit("  query   "), k.cast("string"), F.lit("\n \n"))), "")
    table(spark, d, "supplier").agg(line.alias("value")).write.text(path)
    return S.query_list(spark, path, offset=3, limit=10)


@query("select item_id::varchar as q_id, 'item ' || item_id as question, 'gold' as golden_answer from benchmark where item_id % 7 <> 0")
def gold_scan(spark, d):
    """Gold answers under other headers; rows with a blank are dropped."""
    b = table(spark, d, "benchmark")
    given = b.select(F.concat(F.col("item_id").cast("string"), F.lit(".0")).alias("Question_ID"), F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("question"), F.when(F.col("item_id") % 7 != 0, "gold").otherwise(" ").alias("Reference Answer"))
    return S.gold_answers(given, {"q_id": ["question id"], "golden_answer": ["reference answer"]}).select("q_id", "question", "golden_answer")


@query("select n_name || ' County' as county, r_name as region from nation join region on n_regionkey = r_regionkey")
def county_scan(spark, d):
    """A GeoJSON file of counties."""
    path = _folder(spark, "counties")
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    props = F.struct(F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(" County"))).alias("NAMELSAD10"), F.concat("n_name", F.lit(" County")).alias("NAME10"), F.col("r_name").alias("Reg_Comm")).alias("properties"))
    n.agg(F.to_json(F.struct(F.collect_list(props).alias("features"))).alias("value")).write.text(path)
    return S.counties(spark, path)


@query("select key, 'p/' || min(page_id) || '/file_' || (page_id % 10) || '_DOC_1.html' as path from (select page_id, unnest(list_distinct(['file_' || (page_id % 10) || '_doc_1.html', 'file ' || (page_id % 10)])) as key from pages) group by key, page_id % 10")
def file_index(spark, d):
    k = F.col("page_id")
    files = table(spark, d, "pages").select(F.concat(F.lit("p/"), F.lpad(k.cast("string"), 6, "0"), F.lit("/file_"), (k % 10).cast("string"), F.lit("_DOC_1.html")).alias("path"))
    return S.file_index(files).select("key", F.regexp_replace("path", "^p/0*(?=[0-9])", "p/").alias("path"))


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, sum(cast(round(value * 100) as bigint))::bigint as cents from events group by 1, 2")
def stream_window_counts(spark, d):
    """Events as a stream of files, counted by hour; what the stream says once all are in."""
    path = _folder(spark, "events")
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(path)
    name = f"counts_{uuid.uuid4().hex}"
    stream = I.windowed_counts(I.file_stream(spark, path, events.schema, files_per_trigger=1), "1 hour")
    stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "cents")


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def stream_dedup_key(spark, d):
    """Events as a stream of files: the first of each user and type, whichever file it comes in."""
    path, name = _folder(spark, "events"), f"firsts_{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", "event_type", "event_id")
    events.repartition(3).write.parquet(path)
    firsts = I.file_stream(spark, path, events.schema, files_per_trigger=1).groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    firsts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@query(f"select distinct canonical from {CANONICAL}")
def stream_new_urls(spark, d):
    """Pages as a stream, each twice: urls that were not seen before, by their canonical form."""
    path = _folder(spark, "pages")
    pages = table(spark, d, "pages").select("url", F.lit("2031-05-01 10:00:00").cast("timestamp").alias("ts"))
    pages.repartition(2).write.parquet(path)
    pages.coalesce(1).write.mode("append").parquet(path)
    out = _folder(spark, "urls")
    stream = I.new_urls(I.file_stream(spark, path, pages.schema, files_per_trigger=1), "url", "ts")
    stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", _folder(spark, "state")).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out).select("canonical")


@query("select doc_id, count(*) as n from documents group by 1")
def append_safe(spark, d):
    """Documents appended by two streams over the same rows: each stands once."""
    path, out = _folder(spark, "docs"), _folder(spark, "appended")
    docs = table(spark, d, "documents").select("doc_id", "lang")
    docs.repartition(3).write.parquet(path)
    for _ in range(2):
        stream = I.file_stream(spark, path, docs.schema, files_per_trigger=1)
        I.append_once(stream, out, _folder(spark, "state"), "doc_id").awaitTermination()
    return spark.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select c_custkey, o_orderkey from (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 1")
def latest_manifest(spark, d):
    out = S.last_wins(table(spark, d, "orders"), "o_custkey", F.desc(F.struct("o_orderdate", "o_orderkey")))
    return out.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")


@query('select l_returnflag, count(*) filter (l_linestatus = \'O\') as "O_n", count(*) filter (l_linestatus = \'F\') as "F_n" from lineitem group by 1')
def pivot_report(spark, d):
    from ..plans.cards import wide_report

    long = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("v")).withColumn("m", F.lit("n"))
    return wide_report(long, "l_returnflag", "l_linestatus", "m", "v", ["O", "F"], ["n"]).fillna(0)


@query("select o_orderkey::varchar || '_' || k as log_id, o_orderkey::varchar as id, k as stage_id, name as stage, status, '' as error from (unpivot (select o_orderkey, o_orderstatus as acquired, o_orderpriority as judged, case when o_orderkey % 2 = 0 then '' else 'x' end as decided from orders) on acquired, judged, decided into name stage value status) t join (values ('acquired', 'A', 'acquired'), ('judged', 'B', 'judged'), ('decided', 'C', 'decided')) s(n, k, name) on s.n = t.stage where status <> ''")
def unpivot_log(spark, d):
    from ..plans.cards import processing_log

    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("acquired"), F.col("o_orderpriority").alias("judged"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("x").alias("decided"))
    return processing_log(o, {"acquired": ("A", "acquired"), "judged": ("B", "judged"), "decided": ("C", "decided")})


_ID = "s_suppkey"


@query("""select s_suppkey, s_suppkey::varchar as whole, s_suppkey || '.5' as half, '' as none, lower(s_name) as category, case s_suppkey % 3 when 0 then 'Unknown' when 1 then 'Battery News' else 'Energy Ga' end as label, case s_suppkey % 3 when 0 then 'PDF' when 1 then 'HTML' else 'Image' end as kind,
case s_suppkey % 3 when 0 then 'a_b.pdf' when 1 then 'c d.txt' end as name, 'a|b|c|d' as parts, s_suppkey::bigint * 10 + 7 as digits, 'City' || s_suppkey as city, 'Long County' as county, case when s_suppkey % 2 = 0 then '{"k": ' || s_suppkey || '}' end as json, case when s_suppkey % 5 = 0 then null else (s_suppkey % 5) / 10.0 end as score,
'supplier_' || lpad(s_suppkey::varchar, 9, '0') as snake, 'x,y' as logged, case when s_suppkey % 2 = 0 then 1 else 0 end as truth, case when s_suppkey % 2 = 0 then s_suppkey::double else -1.0 end as number, s_suppkey::varchar as plain, 'report 7 of' || s_suppkey as filename, left('aa ' || repeat('b', 300), 237) || '...' as preview from supplier""")
def cell_functions(spark, d):
    """Functions over single cells, on values made of the row's number."""
    k = F.col("s_suppkey")
    s, pick = k.cast("string"), lambda *xs: F.when(k % 3 == 0, xs[0]).when(k % 3 == 1, xs[1]).otherwise(xs[2])
    location = F.concat(F.lit("City"), s, F.lit(", Long County"))
    return table(spark, d, "supplier").select(
        "s_suppkey", T.cell(k.cast("double")).alias("whole"), T.cell(k + 0.5).alias("half"), T.cell(F.lit(float("nan"))).alias("none"), T.category_key(F.concat(F.lit("  "), "s_name", F.lit("\t"))).alias("category"), T.source_label(pick("", "https://www.battery.news/x", "http://energy.ga.gov")).alias("label"),
        T.content_file_type(pick("application/pdf; x=1", "text/html", "image/png")).alias("kind"), T.disposition_name(pick("attachment; filename*=UTF-8''a%5Fb.pdf", 'inline; filename="c d.txt"', "none")).alias("n0"), F.when(k % 3 == 0, "a_b.pdf").when(k % 3 == 1, "c d.txt").alias("name"), F.array_join(T.split_values(F.lit("a; b/c and  d,")), "|").alias("parts"),
        T.digits(F.concat(s, F.lit(" and 7"))).alias("digits"), T.place(location)["city"].alias("city"), T.county(location).alias("county"), T.json_object(F.when(k % 2 == 0, F.concat(F.lit('Sure: {"k": '), s, F.lit("} done"))).otherwise("no {json")).alias("json"),
        T.judge_score(F.when(k % 5 != 0, F.concat(F.lit("score: 0."), (k % 5).cast("string"), F.lit(" of 1"))).otherwise("none")).alias("score"), T.snake_case(F.concat(F.lit(" "), "s_name", F.lit("!"))).alias("snake"), F.array_join(T.logged_list(F.lit("x; y,\nx,")), ",").alias("logged"), T.truthy(F.when(k % 2 == 0, "2").otherwise("no")).alias("truth"),
        T.safe_float(F.when(k % 2 == 0, s).otherwise("n/a"), -1.0).alias("number"), T.plain_id(F.concat(F.lit(" "), s, F.lit(".0"))).alias("plain"), T.filename_words(F.concat(F.lit("report_7-of"), s, F.lit("_DOC_12.pdf"))).alias("filename"), T.preview(F.concat(F.lit("aa  "), F.repeat(F.lit("b"), 300))).alias("preview"),
    ).drop("n0")


@query("select doc_id, sha256(trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g'))) as hash, '{\"a\":' || doc_id || ',\"b\":\"' || lang || '\"}' as json from documents where trim(text) <> ''")
def content_hashes(spark, d):
    """The hash of a text, and the fingerprint of columns, which is that of their JSON."""
    docs = table(spark, d, "documents").where("trim(text) <> ''")
    json = F.to_json(F.struct(F.col("doc_id").alias("a"), F.col("lang").alias("b")))
    same = T.json_fingerprint(F.col("doc_id").alias("a"), F.col("lang").alias("b")) == F.sha2(json, 256)
    return docs.where(same).select("doc_id", T.text_hash(F.col("text")).alias("hash"), json.alias("json"))


@query("select e.vec_id, q.vec_id as asked, round(greatest(0.0, list_cosine_similarity(e.embedding::double[], q.embedding::double[])), 6) as cosine from embeddings e join embeddings q on q.vec_id % 20 = 0")
def vector_cosine(spark, d):
    """The rows whose id is divisible by 20, a stated set, against all: all scores, a matrix product a pair of blocks."""
    from ..operators.retrieval import all_cosines

    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = all_cosines(e, e.where("id % 20 = 0").select(F.col("id").alias("reference"), "vector"), 6)
    return found.select(F.col("id").alias("vec_id"), F.col("reference").alias("asked"), F.col("score").alias("cosine"))


@query("select doc_id, lower(regexp_extract(text, '^\\s*(\\S+)', 1)) as first, case when doc_id % 3 = 0 then 'Heading ' || doc_id else 'A: b' end as headings from documents where trim(text) <> ''")
def heading_lines(spark, d):
    made = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Heading "), F.col("doc_id").cast("string"))).otherwise("A: b"), F.lit("\nthis line is no heading at all.\nno\n"))
    docs = table(spark, d, "documents").where("trim(text) <> ''")
    return docs.select("doc_id", F.lower(F.regexp_extract("text", r"^\s*(\S+)", 1)).alias("first"), F.array_join(T.headings(made), "|").alias("headings"))


@query("""select 'question' as kind, case when item_id % 4 = 0 then 'id' || item_id else null end as id, trim(regexp_replace(text, '[\\s\\x{00A0}]+', ' ', 'g')) as text, case when item_id % 3 = 0 then 'gold ' || item_id end as answer from benchmark where len(trim(text)) >= 5""")
def question_sheets(spark, d):
    """Question sheets whose header stands below two other rows; rows without an id get their number."""
    from ..sources import sheets

    path, k = _folder(spark, "sheets"), F.col("item_id")
    b = table(spark, d, "benchmark")
    plain = F.concat(F.lit('"'), F.replace(T.squeeze(F.col("text")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", F.when(k % 4 == 0, F.concat(F.lit("id"), k.cast("string"))).otherwise(""), plain, F.lit("x"), F.when(k % 3 == 0, F.concat(F.lit("gold "), k.cast("string"))).otherwise(""))
    head = spark.createDataFrame([(0, "Study,of,items"), (1, ",,,"), (2, "#,Sample  Query,,Reference Answer")], "nth long, value string")
    rows = head.unionByName(b.select((k + 10).alias("nth"), line.alias("value")))
    rows.repartitionByRange(4, "nth").sortWithinPartitions("nth").coalesce(1).select("value").write.text(path)
    own = sheets.questions(spark, path)
    return own.select(F.lit("question").alias("kind"), F.when(F.col("q_id").startswith("id"), F.col("q_id")).alias("id"), F.col("question").alias("text"), F.col("expected_answer").alias("answer"))


@query("""with s as (select s_suppkey, s_name, s_nationkey from supplier), t as (select s_nationkey % 3 as sheet, row_number() over (partition by s_nationkey % 3 order by s_suppkey) as nth, s_suppkey, s_name from s)
select 'row' as kind, sheet, nth, '{"Company":"' || s_name || case when s_suppkey % 2 = 0 then '","Number":"' || s_suppkey else '' end || '"}' as said from t where sheet <> 1
union all select 'note', 1, 0, string_agg(s_name, chr(10) order by nth) from t where sheet = 1""")
def sheet_rows(spark, d):
    """Sheets of suppliers: two are tables, the third has one named column, and so is a note."""
    from ..sources import sheets

    path = _folder(spark, "sheets")
    s = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("sheet"), F.col("s_suppkey").alias("nth"), F.concat_ws(",", "s_name", F.when((F.col("s_nationkey") % 3 != 1) & (F.col("s_suppkey") % 2 == 0), F.col("s_suppkey").cast("string")).otherwise("")).alias("value"))
    heads = spark.createDataFrame([(0, -1, "Company,Number"), (1, -1, "Definitions,"), (2, -1, "Company,Number"), (2, -2, ",,")], "sheet int, nth long, value string")
    rows = heads.unionByName(s).repartition(3, "sheet").sortWithinPartitions("sheet", "nth")
    rows.select("sheet", "value").write.partitionBy("sheet").text(path)
    tables, notes = sheets.rows_and_notes(spark, f"{path}/*")
    sheet = F.regexp_extract("file", r"sheet=(\d)", 1).cast("int").alias("sheet")
    own = tables.select(F.lit("row").alias("kind"), sheet, "nth", F.to_json("values").alias("said"))
    return own.unionByName(sheets.note_texts(notes).select(F.lit("note").alias("kind"), sheet, F.lit(0).cast("long").alias("nth"), F.col("text").alias("said")))
