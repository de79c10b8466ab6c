import pytest

from lodeworks.plans import questions as Q
from lodeworks.plans.answers import answered, answers, structured_results

SCHEMA = "row_key int, company string, category string, role string, product_service string, location string, primary_oems string, employment long, ev_battery_relevant string, industry_group string"
ROWS = [
    (1, "Acme", "Tier 1", "Battery Pack", "Pack", "Rome, Floyd County", "Kia Motors America", 100, "Yes", "Metals"),
    (2, "Bolt", "Tier 1", "Battery Pack", "Cells", "Macon, Bibb County", "", 900, "Indirect", "Metals"),
    (3, "Core", "Tier 2/3", "DC Fast Charging and Battery Cell", "wire harness", "Rome, Floyd County", "Kia", None, "Yes", "Plastics"),
    (4, "Acme", "OEM", "Vehicle Assembly", "cars", "Atlanta", "Acme", 5000, "No", ""),
    (5, "Dyno", "Tier 1/2", "Battery Pack", "packs", "Atlanta", "Acme", 50, "Yes", "Metals"),
]
#: Question -> what it names, the rows that it chooses, the template, the lines after "Matched rows".
CASES = {
    "Show all Tier 1 companies grouped by EV Supply Chain Role for battery pack.": ({("category", "tier 1"), ("role", "battery pack")}, {1, 2}, "grouped_listing", "Grouped by EV Supply Chain Role:\n- Battery Pack: Acme; Bolt"),
    "Which suppliers manufacture DC fast charging hardware and have existing OEM contracts?": ({("role", "dc fast charging")}, {3}, "details", "Matching rows:\n- Company: Core"),
    "Which suppliers are linked to Acme?": ({("primary_oems", "acme")}, {4, 5}, "linked", None),
    "Which suppliers are linked to Bolt?": ({("primary_oems", "bolt")}, set(), None, None),
    "List Tier 1 suppliers excluding location = Atlanta.": ({("category", "tier 1")}, {1, 2}, "details", None),
    "Which are in Floyd County?": ({("location", "rome floyd county")}, {1, 3}, "details", None),
    "category = OEM and employment > 10": ({("category", "oem")}, {4}, "details", "Matching rows:\n- Company: Acme | Category: OEM | Employment: 5000"),
    "What is classified as OEM footprint?": (set(), {1, 2, 3, 4, 5}, "details", None),
    "Show OEM rows": ({("category", "oem")}, {4}, "details", None),
    "Which are the primary OEM rows of Tier 1/2": ({("category", "tier 1"), ("category", "tier 1/2")}, {1, 2, 5}, "details", None),
    "Which suppliers mentions 'harness' in Product / Service?": (set(), {1, 2, 3, 4, 5}, "mentions", "Matching Product / Service entries:\n- Company: Core | Product / Service: wire harness"),
    "Top 2 companies with highest employment": (set(), {1, 2, 3, 4, 5}, "ranked", "Employment-ranked companies:\n- Company: Acme | Employment: 5000\n- Company: Bolt | Employment: 900"),
    "What is the median employment in Tier 1?": ({("category", "tier 1")}, {1, 2}, "median", "Median Employment: 500"),
    "How many Tier 1 rows have fewest companies by county?": ({("category", "tier 1")}, {1, 2}, "counts", "Counts by County:\n- Bibb County: 1\n- Floyd County: 1"),
    "Which companies appear multiple times in Tier 1?": ({("category", "tier 1")}, {1, 2}, "several_roles", "Companies appearing multiple times with distinct EV Supply Chain Roles: None"),
    "Who has employment > 9,000 in Tier 1?": ({("category", "tier 1")}, {1, 2}, "rows", None),
    "Define the value chain": (set(), set(), None, None),
}


@pytest.fixture(scope="module")
def told(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    asked = spark.createDataFrame(list(enumerate(CASES)), "question long, text string")
    names = Q.named(asked, rows)
    hits = Q.matched(asked, names, rows)
    return names.collect(), hits.collect(), {r.question: r for r in answers(asked, hits, rows, names).collect()}


@pytest.mark.parametrize("k", range(len(CASES)), ids=list(CASES))
def test_question(told, k):
    names, hits, said = told
    wanted, rows, template, lines = list(CASES.values())[k]
    assert {(r.field, r.key) for r in names if r.question == k} == wanted
    assert {r.row_key for r in hits if r.question == k} == rows
    assert (said[k].template if k in said else None) == template
    if lines:
        assert said[k].text.split("\n", 3)[3] == lines


def test_structured_results_need_no_texts(spark, told):
    """Who is answered is known without the answers, with rows that no template has lines for, too; so is all that retrieval takes."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    hits = spark.createDataFrame([(r.question, r.row_key) for r in told[1]], "question long, row_key int")
    said = spark.createDataFrame([(k, r.text) for k, r in told[2].items()], "question long, text string")
    assert sorted(r.question for r in answered(hits).collect()) == sorted(told[2]) and any(r.template == "rows" for r in told[2].values())
    full, bare = structured_results(said, hits, rows), structured_results(answered(hits), hits, rows)
    assert "text" in full.columns and "text" not in bare.columns
    assert sorted(map(tuple, bare.collect())) == sorted(map(tuple, full.drop("text").collect())) and bare.count() > len(told[2])


def test_many_rows_without_names(spark):
    rows = spark.createDataFrame([(i, f"C{i}", "Tier 1", "Lab" if i % 2 else "", "", "", "", i, "", "") for i in range(20)], SCHEMA)
    asked = spark.createDataFrame([(0, "How many by category?"), (1, "List all, and count by category"), (2, "Show all Tier 1 companies grouped by EV supply chain role")], "question long, text string")
    names = Q.named(asked, rows)
    hits = Q.matched(asked, names, rows, most=10)
    assert {r.question for r in hits.select("question").distinct().collect()} == {1, 2}
    said = {r.question: r.text for r in answers(asked, hits, rows, names, shown=2, most=10).collect()}
    assert said[1].endswith("Counts by Category:\n- Tier 1: 20")
    assert said[2].endswith("- Lab: C1, C11\n  + 8 more companies\n- Unspecified: C0, C10\n  + 8 more companies\nSummary truncated because matched rows (20) exceed structured_exhaustive_limit (10).")


def test_everything_asked_of_many_rows(spark):
    """Who asks for everything gets every company, however many rows were matched."""
    rows = spark.createDataFrame([(i, f"C{i:03}", "Tier 1", "Lab", "", "", "", i, "", "") for i in range(200)], SCHEMA)
    asked = spark.createDataFrame([(0, "Show all Tier 1 companies grouped by EV supply chain role"), (1, "List all Tier 1 companies grouped by EV Supply Chain Role and count them")], "question long, text string")
    names = Q.named(asked, rows)
    said = {r.question: r.text for r in answers(asked, Q.matched(asked, names, rows), rows, names).collect()}
    for k in (0, 1):
        assert said[k].endswith("Grouped by EV Supply Chain Role:\n- Lab: " + "; ".join(f"C{i:03}" for i in range(200)))


def test_nothing_asked(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    asked = spark.createDataFrame([], "question long, text string")
    names = Q.named(asked, rows)
    assert names.collect() == [] and answers(asked, Q.matched(asked, names, rows), rows, names).collect() == []
    one = spark.createDataFrame([(0, None), (1, "")], "question long, text string")
    names = Q.named(one, rows.limit(0))
    assert names.collect() == [] and Q.matched(one, names, rows.limit(0)).collect() == []


def test_structured_search_takes_all_rows(spark, tmp_path, monkeypatch):
    """Who names nothing gets structured results from a table of any size."""
    from lodeworks.queries import ORACLES, retrieval

    spark.range(200).selectExpr("cast(id as int) as s_suppkey", "concat('S', id) as s_name", "cast(id % 25 as int) as s_nationkey", "cast(id as double) as s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(48).selectExpr("cast(id as int) as item_id", "'text' as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.range(60).selectExpr("id as vec_id", "array(1.0f, 2.0f) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(40).selectExpr("id as doc_id", "concat('some words of text ', id, ' and more of them') as text", "'en' as lang", "'a' as source", "30L as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(retrieval.V, "retrieve", lambda asked, v, chunks, weights, first, **_: first)
    first = retrieval.retrieve_structured(spark, str(tmp_path)).collect()
    for k in (5, 6, 11, 12, 22):  # How many companies by county, totals by role, ...
        assert [r.row_key for r in sorted(first, key=lambda r: r.ord) if r.question == k] == ["", "0", "1", "2", "3", "4", "5"]
    assert "150" not in ORACLES["retrieve_structured"] and "<= 150" in ORACLES["structured_filter"]
