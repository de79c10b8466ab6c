"""Joins by id, merges of runs and names in texts."""

from pyspark.sql import functions as F

from ..operators import joins as J
from . import query, table


@query("select o_orderkey, coalesce(case when c_custkey % 2 = 0 then c_name end, 'order ' || o_orderkey) as name, c_mktsegment from (select o_orderkey, o_custkey from orders) o left join customer c on c_custkey = o_custkey")
def acquisition_join(spark, d):
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"), "c_mktsegment")
    return J.overriding(left, right, "k").select("o_orderkey", "name", "c_mktsegment")


@query("select c_custkey, case when c_custkey % 3 = 0 then 'new' else c_name end as c_name from customer union all select -1, 'added'")
def upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name")
    new = old.where("c_custkey % 3 = 0").withColumn("c_name", F.lit("new")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("added").alias("c_name")))
    return J.upsert(old, new, "c_custkey")


@query("select c_custkey, case when exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000) then 1 else 0 end as large from customer")
def semi_flag(spark, d):
    ids = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.flagged(table(spark, d, "customer"), ids, "c_custkey", "large").select("c_custkey", "large")


@query("select d.doc_id, coalesce(l.quality, -1) as quality from documents d left join (select doc_id, max(quality) as quality from labels group by 1) l on l.doc_id = d.doc_id")
def anti_union(spark, d):
    scored = table(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id")
    return J.with_unscored(scored.join(docs, "doc_id", "left_semi"), docs, "doc_id", {"quality": F.lit(-1)})


@query("select coalesce(a.c_nationkey, b.s_nationkey) as nation, a.n as n_local, b.n as n_hybrid from (select c_nationkey, count(*) as n from customer where c_acctbal > 9000 group by 1) a full join (select s_nationkey, count(*) as n from supplier group by 1) b on a.c_nationkey = b.s_nationkey")
def mode_outer_merge(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    b = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return J.merged_modes({"local": a, "hybrid": b}, ["nation"])


@query("select d.doc_id, n.name from documents d join (select distinct trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) as name from (values ('the'), ('of the'), ('die der'), ('de la'), ('in the')) v(x)) n on contains(' ' || trim(regexp_replace(lower(d.text), '[^a-z0-9]+', ' ', 'g')) || ' ', ' ' || n.name || ' ')")
def alias_match(spark, d):
    names = spark.createDataFrame([(x, x, i) for i, x in enumerate(("the", "of the", "die der", "de la", "in the"))], "name string, alias string, ord int")
    return J.name_matches(table(spark, d, "documents"), names, "doc_id", "text").select(F.col("id").alias("doc_id"), "name")
