from pyspark.sql import functions as F

from lodeworks.functions import chunks, html, rules
from lodeworks.functions import text as T
from lodeworks.functions.vocab import ABSTENTION


def one(spark, value, use, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(use(F.col("x")).alias("y")).first().y


def test_text(spark):
    assert one(spark, None, T.squeeze) == ""
    assert one(spark, " a  b\n", T.squeeze) == "a b"
    assert one(spark, "Tier 1/2 & co", T.match_key) == "tier 1 2 co"
    assert one(spark, "1,200-1,500", T.digits) == 12001500
    assert one(spark, "", T.digits) is None
    assert one(spark, "HTTP://Ex.org/a/?utm_x=1&b=2&c=#f", T.canonical_url) == "http://ex.org/a?b=2"
    assert one(spark, "", T.stable_id) == "CAND_UNKNOWN"
    assert one(spark, "A; b / a, c and d", T.split_values) == ["A", "b", "a", "c", "d"]
    assert one(spark, "x y_DOC_12.pdf", T.filename_words) == "x y"
    assert one(spark, "say {\"a\": 1} so", T.json_object) == '{"a": 1}'
    assert one(spark, "no", T.json_object) is None
    assert one(spark, "Athens, Clarke County", T.county) == "Clarke County"
    assert one(spark, "-3 and 1,250.5 and 5%", T.numbers) == [-3.0, 1250.5, 0.05]
    assert one(spark, "SCORE=0.80 of 1", T.judge_score) == 0.8


def test_answers(spark):
    text = "- one [DOC:a]\n- two\nMissing info: three\n- four\nEvidence: a"
    parts = one(spark, text, T.answer_parts)
    assert (parts.bullets, parts.missing, parts.evidence) == (["one [DOC:a]", "two"], ["three", "four"], "Evidence: a")
    assert one(spark, ABSTENTION, T.answer_parts).abstained
    assert one(spark, "[doc:a] [WEB: b ] [x:c] [GEO:d][ANALYTIC:e]", T.citations) == ["DOC:a", "WEB:b", "GEO:d", "ANALYTIC:e"]
    assert one(spark, text, T.semantic_text) == "one\ntwo"
    assert one(spark, "a, b, a", T.list_items) == ["a", "b"]
    assert one(spark, "Made by Acme Inc. of Rome. It is new; really. ok", T.sentence_units) == ["Made by Acme Inc. of Rome.", "It is new; really. ok"]


def test_rules(spark):
    assert one(spark, "", rules.source_credibility) == 3.0
    assert one(spark, "a.benzinga.com", rules.source_credibility) == 1.5
    assert one(spark, "energy.gov", rules.source_credibility) == 15.0
    assert one(spark, "a supplier of cells with 5 gwh", rules.category_hits).n == 2
    assert one(spark, "Employment at least 1,000", rules.employment_limit).value == 1000
    assert one(spark, "compare demand", rules.route) == "web_needed"
    assert one(spark, "a b a", lambda c: F.round(rules.bag_cosine(c, F.lit("a b")), 6)) == 0.948683
    assert one(spark, "", lambda c: rules.bag_cosine(c, F.lit("a"))) == 0.0


def test_html_and_chunks(spark):
    page = "<title> A &amp; B</title><nav>x</nav><h2>H <b>i</b></h2><article>" + "word " * 60 + "</article>"
    assert one(spark, page, html.title) == "A & B"
    assert one(spark, page, html.main_text) == ("word " * 60).strip()
    assert one(spark, page, html.heading_texts) == ["H i"]
    assert [len(w.split()) for w in one(spark, "w " * 400, chunks.word_windows)] == [180, 180, 130]
    assert [(w.start, len(w.text)) for w in one(spark, "x" * 2500, chunks.character_windows)] == [(0, 1200), (1050, 1200), (2100, 400)]
    assert one(spark, "", chunks.word_windows) == []
