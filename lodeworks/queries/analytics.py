"""Group-by questions. Suppliers and nations stand for companies and counties, parts for products and roles."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics as A
from . import query, table

SUPPLIERS = "(select s.*, n.n_name, r.r_name from supplier s join nation n on s_nationkey = n_nationkey join region r on n_regionkey = r_regionkey)"


def suppliers(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))


@query(f"select n_name, count(*) as count from {SUPPLIERS} group by 1 order by 2 desc, 1 limit 5")
def group_count_topn(spark, d):
    return A.group_counts(suppliers(spark, d), "n_name", limit=5)


@query(f"select n_name, count(*) as count from {SUPPLIERS} group by 1 order by 2, 1 limit 5")
def group_count_bottom(spark, d):
    return A.group_counts(suppliers(spark, d), "n_name", ascending=True, limit=5)


@query("select c_acctbal_band, count(*) as count from (select cast(floor(c_acctbal / 25) as bigint) as c_acctbal_band from customer) group by 1 having count(*) = 1")
def group_count_only_one(spark, d):
    df = table(spark, d, "customer").select(F.floor(F.col("c_acctbal") / 25).cast("bigint").alias("c_acctbal_band"))
    return A.group_counts(df, "c_acctbal_band", only_one=True)


@query("select c_mktsegment, sum(cents)::bigint as sum, round(avg(cents), 4) as mean from (select c_mktsegment, cast(round(c_acctbal * 100) as bigint) as cents from customer) group by 1")
def group_sum_mean(spark, d):
    df = table(spark, d, "customer").withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("bigint"))
    total, mean = A.group_numbers(df, "c_mktsegment", "cents"), A.group_numbers(df, "c_mktsegment", "cents", "mean")
    return total.join(mean, "c_mktsegment").select("c_mktsegment", "sum", F.round("mean", 4).alias("mean"))


@query("select min(s_acctbal) as min_value, (select s_name from supplier order by s_acctbal, s_name limit 1) as min_name, max(s_acctbal) as max_value, (select s_name from supplier order by s_acctbal desc, s_name limit 1) as max_name from supplier")
def range_argminmax(spark, d):
    return A.extremes(table(spark, d, "supplier"), "s_acctbal", "s_name")


@query("select o_custkey from orders where o_orderpriority in ('1-URGENT', '5-LOW') group by 1 having count(distinct o_orderpriority) = 2")
def having_contains_all(spark, d):
    return A.groups_having_all(table(spark, d, "orders"), "o_custkey", "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("select o_custkey, string_agg(distinct o_orderstatus, ', ' order by o_orderstatus) as values, count(distinct o_orderstatus) as n from orders group by 1 having count(distinct o_orderstatus) > 1")
def multi_role_entities(spark, d):
    return A.multi_valued(table(spark, d, "orders"), "o_custkey", "o_orderstatus")


@query("select p_size_brand, min(p_name) as only from (select p_brand || '/' || p_size as p_size_brand, p_name from part) group by 1 having count(*) = 1")
def single_member_roles(spark, d):
    df = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_size").alias("p_size_brand"), "p_name")
    return A.single_members(df, "p_size_brand", "p_name")


CONC = """(select g, sum(c)::bigint as n, count(*) as "distinct", first(w order by c desc, w) as top, max(c) / sum(c) as share from (select {g} as g, {w} as w, count(*) as c from {t} group by 1, 2) group by 1)"""


@query(f"""select g as p_type, n, "distinct", top, round(share, 6) as share from {CONC.format(g="p_type", w="p_brand", t="part")} order by share desc, g limit 1""")
def concentration_argmax(spark, d):
    out = A.concentration(table(spark, d, "part"), "p_type", "p_brand").orderBy(F.desc("share"), "p_type").limit(1)
    return out.withColumn("share", F.round("share", 6))


@query(f"select n_name, array_to_string(list_slice(l, 1, 3), '; ') as names, greatest(len(l) - 3, 0)::bigint as more from (select n_name, list_sort(list(distinct s_name)) as l from {SUPPLIERS} group by 1)")
def grouped_listing(spark, d):
    return A.listing(suppliers(spark, d), "n_name", "s_name", 3)


@query(f"select n_name, count(*) as n, sum(cents)::bigint as total, count(*) filter (s_acctbal > 5000) as rich, count(*) filter (s_acctbal < 0) as poor from (select *, cast(round(s_acctbal * 100) as bigint) as cents from {SUPPLIERS}) where n_name not in ('NATION_0', 'NATION_1') group by 1 order by 2 desc, 3 desc, 1 limit 15")
def cluster_summary(spark, d):
    df = suppliers(spark, d).withColumn("cents", F.round(F.col("s_acctbal") * 100).cast("bigint"))
    return A.cluster_summary(df, "n_name", "cents", {"rich": F.col("s_acctbal") > 5000, "poor": F.col("s_acctbal") < 0}, ["NATION_0", "NATION_1"])


MIX = "(select g, string_agg(w || ': ' || c, '; ' order by c desc, w) as mix from (select *, row_number() over (partition by g order by c desc, w) as k from (select {g} as g, {w} as w, count(*) as c from {t} group by 1, 2)) where k <= 3 group by 1)"


@query(f"""select c.g as p_brand, n, "distinct", top, round(share, 6) as share, mix from {CONC.format(g="p_brand", w="p_type", t="part")} c join {MIX.format(g="p_brand", w="p_size::varchar", t="part")} m on c.g = m.g""")
def role_concentration(spark, d):
    part = table(spark, d, "part").withColumn("size", F.col("p_size").cast("string"))
    return A.concentration(part, "p_brand", "p_type").withColumn("share", F.round("share", 6)).join(A.mix(part, "p_brand", "size"), "p_brand")


RULES = {"one": ["1", "one"], "brand two": ["brand#2", "2"], "steel": ["steel", "7"]}
_RULE_SQL = "select p.*, r.rule from part p join (values ('one', ['1', 'one']), ('brand two', ['brand#2', '2']), ('steel', ['steel', '7'])) r(rule, patterns) on len(list_filter(r.patterns, lambda x: contains(lower(p_name || ' | ' || p_brand || ' | ' || p_type), x))) > 0"


@query(f"select m.rule, m.n, x.mix, s.samples from (select rule, count(*) as n from ({_RULE_SQL}) group by 1) m join {MIX.format(g='rule', w='p_brand', t=f'({_RULE_SQL})')} x on x.g = m.rule join (select rule, string_agg(p_name, '; ' order by p_name) as samples from (select *, row_number() over (partition by rule order by p_name) as k from (select distinct rule, p_name from ({_RULE_SQL}))) where k <= 4 group by 1) s on s.rule = m.rule")
def capability_index(spark, d):
    part = table(spark, d, "part")
    hits = A.rule_matches(part, F.concat_ws(" | ", "p_name", "p_brand", "p_type"), RULES)
    return hits.groupBy("rule").agg(F.count("*").alias("n")).join(A.mix(hits, "rule", "p_brand"), "rule").join(A.samples(hits, "rule", "p_name", 4), "rule")


LINK = "(select l_suppkey, p_brand, p_type, p_name from lineitem join part on l_partkey = p_partkey)"


@query(f"select b.g as p_brand, n, b.mix, t.mix as types, e.samples from (select g, mix from {MIX.format(g='p_brand', w='l_suppkey::varchar', t=LINK)}) b join (select g, mix from {MIX.format(g='p_brand', w='p_type', t=LINK)}) t on t.g = b.g join (select p_brand, count(*) as n from {LINK} group by 1) c on c.p_brand = b.g join (select p_brand, string_agg(p_name, '; ' order by p_name) as samples from (select *, row_number() over (partition by p_brand order by p_name) as k from (select distinct p_brand, p_name from {LINK})) where k <= 3 group by 1) e on e.p_brand = b.g")
def linkage_summary(spark, d):
    links = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).withColumn("supplier", F.col("l_suppkey").cast("string"))
    n = links.groupBy("p_brand").agg(F.count("*").alias("n"))
    return n.join(A.mix(links, "p_brand", "supplier"), "p_brand").join(A.mix(links, "p_brand", "p_type").withColumnRenamed("mix", "types"), "p_brand").join(A.samples(links, "p_brand", "p_name", 3), "p_brand")


@query("select r.rule, count(*) as n from part p join (values ('one', ['1', 'one']), ('brand two', ['brand#2', '2']), ('steel', ['steel', '7'])) r(rule, patterns) on p_size > 45 or len(list_filter(r.patterns, lambda x: contains(lower(p_name), x))) > 0 group by 1")
def ecosystem_themes(spark, d):
    return A.rule_matches(table(spark, d, "part"), F.col("p_name"), RULES, F.col("p_size") > 45).groupBy("rule").agg(F.count("*").alias("n"))


@query("select p_brand, sum(p_size * 2)::bigint as weight from part group by 1 order by 2 desc, 1 limit 10")
def weighted_counts(spark, d):
    return A.weighted_counts(table(spark, d, "part"), "p_brand", F.col("p_size") * 2, 10)
