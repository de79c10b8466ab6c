"""The registered queries of this subpackage: thin digests of what the operators return."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op9_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_tokens import prefix_table

    found = prefix_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), (1024,))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"), F.col("cuts")[0].alias("chars_in_limit"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets, spelled

    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(spelled(F.col("base")), 256).alias("base_sha256"),
        spelled(F.array_sort(F.concat("base", "extra"))).alias("spans"), F.size("extra").cast("long").alias("n_random"),
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    found = mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", F.transform("draws", lambda d: d["shard"]).alias("shards"))


#: Tools that op1 reads into chats without tool messages, one after the other.
TOOLS = ("search", "lookup", "summarise")
_ARGUMENTS = {"query": {"type": "string", "minLength": 1}, "words": {"type": "integer", "minimum": 1, "maximum": 60}}
SCHEMAS = {name: {"type": "object", "required": ["query", "words"], "properties": _ARGUMENTS, "additionalProperties": False} for name in TOOLS}


def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats hold no tool messages, so each user turn stands for a call, and the assistant's turn after it for its
    result; two calls of three need the user turn before."""
    from .common import words
    from .tool_calls import link

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    k = F.floor(F.col("turn") / 2) % 3
    name = lambda shift: F.concat(F.lit("call_"), (F.col("turn") - shift).cast("string"))
    arguments = F.to_json(F.struct(F.size(words(F.col("text"))).alias("words"), F.coalesce("text", F.lit("")).alias("query")))
    calls = turns.where("role = 'user'").select("conv_id", name(0).alias("call_id"), "turn", F.get(F.array(*map(F.lit, TOOLS)), k).alias("name"), arguments.alias("arguments"), F.when(k > 0, F.array(name(2))).alias("needs"))
    results = turns.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), "turn", F.coalesce("text", F.lit("")).alias("content"))
    found = link(calls, results, SCHEMAS)
    return found.select("conv_id", "call_id", "call_turn", "result_turn", F.col("level").cast("long").alias("level"), "status", F.array_join("errors", ";").alias("errors"), "message", "position")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' archive against a second one, in which some records have a byte too many, have lost their payload, are
    missing, stand twice, or are new between others. Ids are even, so that new ones find room."""
    from .fixity import audit, warc_record

    k = F.col("page_id")
    pages = table(spark, sf_dir, "pages").select((2 * k).alias("record_id"), "page_id", "url", "html")
    rotten = F.when(k % 997 == 11, "").when(k % 97 == 5, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    whole = pages.where("page_id % 89 <> 3").withColumn("html", rotten)
    twice = pages.where("page_id % 211 = 9 and page_id % 89 <> 3").withColumn("html", rotten)
    new = pages.where("page_id % 307 = 8").withColumn("record_id", F.col("record_id") + 1)
    found = audit(pages, whole.unionByName(twice).unionByName(new), "record_id", warc_record(F.col("url"), F.col("html")))
    # A digest of many records is no record's.
    one = lambda n, d: F.when(F.col(n) == 1, F.col(d))
    return found.select("record_id", "n", "n_bytes", "ordinal", "offset", one("n", "digest").alias("digest"), "copy_n", "copy_n_bytes", "copy_ordinal", "copy_offset", one("copy_n", "copy_digest").alias("copy_digest"), "status")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations

    found = collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with faults of each kind, one in five, by a checksum of their place."""
    spelled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spelled("conv_id"), spelled("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", spelled("role").alias("role"), spelled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("col")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import digests, repair

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = repair(damaged(turns))
    count = lambda kind: F.count_if(F.col("fault") == kind).alias(kind)
    counts = found.groupBy("conv").agg(count("blank"), count("duplicate"), count("truncated"), F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    span = found.select("conv", "turn").distinct().groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    out = turns.select(F.col("conv_id")).distinct()
    for own in (counts, span, digests(found)):
        out = out.join(own, out["conv_id"].eqNullSafe(own["conv"]), "left").drop("conv")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose id's CRC-32 leaves 2 modulo 4 are held out: their labels are not read."""
    from .common import short_batches
    from .quality_model import classify, fit

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents")
    with short_batches(spark):
        model = fit(docs, table(spark, sf_dir, "labels").where(~held))
    return classify(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {
    f.__name__: f
    for f in (op1_tool_calls, op2_secrets, op3_minhash, op4_licenses, op5_packing, op6_quality, op7_nearest, op8_mixing, op9_prefix_tokens, op10_fixity, op11_collocations, op12_repair, op13_quality_model)
}

ORACLES: dict[str, str] = {
    "op12_repair": r"""
with recursive tab as (select list(v order by i) as t from (select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from (select unnest(range(256)) as i))),
keyed as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) % 20 as kind from keyed, tab),
x as (select conv_id, turn, case when kind = 4 then 'user' else role end as role, case when kind = 1 then '' when kind = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when kind = 3 then 2 else 1 end)) as copy from d where kind <> 0),
o as (select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seen, row_number() over (partition by conv_id order by turn nulls first, role, md5(text)) as i from x),
f as materialized (select *, case when seen = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(seen, 1) not in ('.', '!', '?') then 'truncated' end as fault, left(role, 1) as r, lag(left(role, 1)) over (partition by conv_id order by i) as before from o),
way as (
  select conv_id, 0::bigint as i, 0 as q, 0::bigint as c, '' as a, []::varchar[] as lines from f where i = 1
  union all
  select conv_id, i, q, c, a, lines from (
    select *, row_number() over (partition by conv_id, q order by c, a) as best from (
      select s.conv_id, f.i, case e when 'D' then s.q when 'R' then case when s.q = 2 then 3 else 2 end else case f.r when 's' then 1 when 'u' then 2 else 3 end end as q,
        s.c + 3 * s.k + case e when 'D' then 4 when 'R' then 3 else 0 end + case when e <> 'D' and f.fault = 'truncated' then 3 else 0 end as c, s.a || repeat('I', s.k) || e as a,
        list_concat(s.lines, case e when 'D' then [] when 'R' then [case when s.q = 2 then 'assistant:' else 'user:' end || f.text] else [f.role || ':' || f.text] end) as lines
      from (select w.conv_id, w.i, w.c, w.a, k, case when k = 0 then w.q when k = 1 then case when w.q = 2 then 3 else 2 end else case when w.q = 2 then 2 else 3 end end as q,
          list_concat(w.lines, case when k = 0 then [] when w.q = 2 then ['assistant:', 'user:'][1:k] else ['user:', 'assistant:'][1:k] end) as lines from way w, (values (0), (1), (2)) inserts (k)) s
      join f on f.conv_id is not distinct from s.conv_id and f.i = s.i + 1, (values ('D'), ('R'), ('K')) edits (e)
      where e = 'D' or coalesce(f.fault, 'truncated') = 'truncated' and (e = 'R' or f.r = 's' and s.q = 0 or f.r = 'u' and s.q <> 2 or f.r = 'a' and s.q = 2))
  ) where best = 1),
n as (select conv_id, count(*) as n, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
  count(*) filter (where before is not null and before || r not in ('su', 'ua', 'au')) as illegal, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps from f group by 1),
e as (select w.conv_id, w.c + case q when 1 then 6 when 2 then 3 else 0 end as c, a || case q when 1 then 'II' when 2 then 'I' else '' end as a, list_concat(lines, case q when 1 then ['user:', 'assistant:'] when 2 then ['assistant:'] else [] end) as lines
  from way w join n on w.conv_id is not distinct from n.conv_id and w.i = n.n qualify row_number() over (partition by w.conv_id order by w.c + case q when 1 then 6 when 2 then 3 else 0 end, a || case q when 1 then 'II' when 2 then 'I' else '' end) = 1)
select c.conv_id, coalesce(n.gaps, 0)::bigint as gaps, coalesce(n.blank, 0)::bigint as blank, coalesce(n.duplicate, 0)::bigint as duplicate, coalesce(n.truncated, 0)::bigint as truncated, coalesce(n.illegal, 0)::bigint as illegal, coalesce(e.c, 0)::bigint as cost, coalesce(e.a, '') as audit,
  sha256(coalesce(array_to_string(e.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join n on n.conv_id is not distinct from c.conv_id left join e on e.conv_id is not distinct from c.conv_id""",
    "op11_collocations": r"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
grams as (select lang, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i])) as phrase, 1 as words from w
  union all select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), 2 from w
  union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])), 3 from w),
f as materialized (select lang, phrase, words, count(*) as f from grams group by all),
n as (select lang, sum(f)::bigint as n from f where words = 1 group by 1),
k as materialized (select lang, phrase, words, f from f where f >= 10),
c as materialized (select lang, phrase, words, f as a, string_split(phrase, ' ') as w from k where words > 1),
cuts as (select lang, phrase, a, 1 as cut, w[1] as x, array_to_string(w[2:], ' ') as y from c union all select lang, phrase, a, 2, w[1] || ' ' || w[2], w[3] from c where words = 3),
scored as (select c.lang, c.phrase, c.a, c.cut, l.f as l, r.f as r, (1000000::hugeint * c.a * c.a // (l.f::hugeint * r.f))::bigint as score from cuts c
  join k l on l.lang = c.lang and l.phrase = c.x join k r on r.lang = c.lang and r.phrase = c.y),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
longer as (select lang, phrase, max(a) as a from (select lang, w[1] || ' ' || w[2] as phrase, a from c where words = 3 union all select lang, w[2] || ' ' || w[3], a from c where words = 3) group by all)
select b.lang, row_number() over (partition by b.lang order by b.score desc, b.a desc, b.phrase) as rank, b.phrase, b.a, b.l, b.r, n.n, b.score
from best b join n on n.lang = b.lang left join longer x on x.lang = b.lang and x.phrase = b.phrase where x.a is null or 100 * x.a < 50 * b.a
qualify rank <= 2000""",
    "op1_tool_calls": """
with t as (select conv_id, turn, role, coalesce(text, '') as text from conversations),
c as (select conv_id, turn, text, (turn // 2) % 3 as k, len(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as n from t where role = 'user'),
r as (select conv_id, turn, text from t where role = 'assistant'),
l as (select c.*, case when c.k = 0 or p.turn is null then 0 when p.k = 0 or g.turn is null then 1 else 2 end as level
  from c left join c p on p.conv_id = c.conv_id and p.turn = c.turn - 2 left join c g on g.conv_id = c.conv_id and g.turn = c.turn - 4)
select coalesce(l.conv_id, r.conv_id) as conv_id, 'call_' || coalesce(l.turn, r.turn - 1) as call_id, l.turn as call_turn, r.turn as result_turn, l.level::bigint as level,
  case when l.turn is null then 'orphan' when l.text = '' or l.n not between 1 and 60 then 'invalid' when r.turn is null then 'pending' else 'ok' end as status,
  case when l.turn is null then '' else concat_ws(';', case when l.text = '' then '$.query: too short' end, case when l.n not between 1 and 60 then '$.words: out of range' end) end as errors,
  '{' || case when l.turn is null then '' else '"call":{"arguments":{"query":' || to_json(l.text)::varchar || ',"words":' || l.n || '},"name":"' || ['search', 'lookup', 'summarise'][l.k + 1] || '"},' end
  || '"id":"call_' || coalesce(l.turn, r.turn - 1) || '"' || case when r.turn is null then '' else ',"result":' || to_json(r.text)::varchar end || '}' as message,
  row_number() over (partition by coalesce(l.conv_id, r.conv_id) order by l.level nulls last, coalesce(l.turn, r.turn), 'call_' || coalesce(l.turn, r.turn - 1)) as position
from l full outer join r on r.conv_id = l.conv_id and r.turn = l.turn + 1""",
    "op10_fixity": """
with p as (select page_id * 2 as record_id, page_id, coalesce(url, '') as url, coalesce(html, '') as html,
  case when page_id % 997 = 11 then '' when page_id % 97 = 5 then coalesce(html || ' ', '') else coalesce(html, '') end as bad from pages),
x as (select 1 as side, record_id, url, html from p union all select 2, record_id, url, bad from p where page_id % 89 <> 3
  union all select 2, record_id, url, bad from p where page_id % 89 <> 3 and page_id % 211 = 9 union all select 2, record_id + 1, url, html from p where page_id % 307 = 8),
r as (select side, record_id, replace('WARC/1.0~WARC-Type: resource~WARC-Target-URI: ', '~', chr(13) || chr(10)) || url || replace('~Content-Type: text/html~Content-Length: ', '~', chr(13) || chr(10)) || strlen(html) || replace('~~', '~', chr(13) || chr(10)) || html || replace('~~', '~', chr(13) || chr(10)) as rec from x),
g as (select side, record_id, count(*) as n, sum(strlen(rec))::bigint as n_bytes, min(sha256(rec)) as d, min(sha256(rec)) = max(sha256(rec)) as alike from r group by 1, 2),
l as (select *, (sum(n) over o - n)::bigint as ordinal, (sum(n_bytes) over o - n_bytes)::bigint as "offset" from g window o as (partition by side order by record_id)),
a as (select * from l where side = 1), b as (select * from l where side = 2)
select coalesce(a.record_id, b.record_id) as record_id, a.n, a.n_bytes, a.ordinal, a."offset", case when a.n = 1 then a.d end as digest, b.n as copy_n, b.n_bytes as copy_n_bytes, b.ordinal as copy_ordinal, b."offset" as copy_offset, case when b.n = 1 then b.d end as copy_digest,
  case when b.n is null then 'missing' when a.n is null then 'added' when a.d <> b.d then 'changed' when a.n <> b.n then 'repeated' else 'intact' end as status
from a full join b on a.record_id = b.record_id""",
}
