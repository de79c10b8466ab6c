"""Names in texts, vectors in blocks, tokens and copies against plain versions, on small inputs and both ways of joining."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import html, rules, vocab
from lodeworks.functions import text as T
from lodeworks.operators import dedup, evaluation, joins, retrieval, shared
from lodeworks.plans import curation
from lodeworks.plans import questions as Q

key = lambda s: re.sub("[^a-z0-9]+", " ", s.lower()).strip()


@pytest.mark.parametrize("in_row", [0, 200])
def test_aliases_of_any_length(spark, monkeypatch, in_row):
    """69 aliases of 1 to 69 words that all stand in the text, looked for in the row and by windows."""
    monkeypatch.setattr(joins, "IN_ROW", in_row)
    words = [f"w{i}" for i in range(80)]
    names = [(f"n{n}", " ".join(words[n : 2 * n]) if 2 * n <= 80 else " ".join(words[:n]), n, "company") for n in range(1, 70)]
    names += [("Bacon County", "Bacon", 99, "county"), ("Long Lake", "long lake county", 98, "county"), ("None", "not there", 97, "company"), ("Blank", " - ", 96, "company")]
    texts = [(0, " ".join(words)), (1, "eggs and bacon"), (2, "in Bacon, Georgia."), (3, "the BACON county; long  lake county"), (4, None), (5, "")]
    df = spark.createDataFrame(texts, "id long, text string")
    ns = spark.createDataFrame(names, "name string, alias string, ord int, kind string")
    got = {(r.id, r.name) for r in joins.name_matches(df, ns, "id", "text").collect()}
    assert got == {(0, f"n{n}") for n in range(1, 70)} | {(2, "Bacon County"), (3, "Bacon County"), (3, "Long Lake")}
    capped = joins.name_matches(df, ns, "id", "text", limit=3).where("id = 0").collect()
    assert sorted(r.ord for r in capped) == [1, 2, 3]
    assert joins.name_matches(df, ns.where("false"), "id", "text").count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_dense_top_against_numpy(spark, block):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6)).round(1)
    x[5], x[6] = x[4], x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [0.0] * 6), (102, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "id long, vector array<double>")
    asked = vectors.where("id % 20 = 0 or id in (4, 100, 101, 102)").select(F.col("id").alias("question"), F.lit(0).alias("variant"), "vector")
    got = {}
    for r in retrieval.dense_top(asked, vectors, 5, digits=9, block=block).collect():
        got.setdefault(r.question, []).append((-r.score, r.id))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40, 4):
        s = np.clip(u @ u[q], 0, 1).round(9)
        assert sorted(got[q]) == sorted((-s[i], i) for i in sorted(range(60), key=lambda i: (-s[i], i))[:5])
    assert sorted(got) == [0, 4, 20, 40, 102] and got[102] == [(-1.0, 102)]


@pytest.mark.parametrize("rows", [0, 200_000])
def test_lexical_scores_both_ways(spark, monkeypatch, rows):
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", rows)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(40)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(0, 0, "a b, a"), (0, 1, "C"), (1, 0, "zz"), (2, 0, "")], "question long, variant int, text string")
    weights = retrieval.idf(chunks, "text")
    idf = {r.token: r.idf for r in weights.collect()}
    got = {(r.question, r.variant, r.id): r.score for r in retrieval.lexical_scores(asked, chunks, weights).collect()}
    want = {(q, v, i): sum(idf[t] for t in set(w) & set(texts[i].split())) for q, v, w in ((0, 0, "ab"), (0, 1, "c")) for i in range(40) if set(w) & set(texts[i].split())}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    a, b = chunks, spark.createDataFrame([(0, "a a b"), (1, "q")], "id long, text string")
    cos = {(r.a, r.b): r.cosine for r in retrieval.bag_cosines(a, b).collect()}
    assert {k[1] for k in cos} == {0} and len(cos) == sum(bool(set(t.split()) & {"a", "b"}) for t in texts)


def test_metadata_boost_has_the_analysis_type(spark):
    own = spark.range(1).select(retrieval.metadata_boost(F.lit("county cluster density"), *(F.lit("") for _ in range(4)), F.lit("derived_analytic_summary"), F.lit("County cluster table"), [], F.lit("cluster density")).alias("b")).first()
    assert own.b == pytest.approx(0.012 * 2 + 0.01 * 2 + 0.03)


def test_hamming_matches_against_all_pairs(spark):
    rng = random.Random(7)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(7))) for b in base for _ in range(8)]
    signed = spark.createDataFrame([(i, v - (1 << 64) if v >= 1 << 63 else v) for i, v in enumerate(values)], "id long, signature long")
    got = sorted((r.a, r.b, r.distance) for r in dedup.hamming_matches(signed.where("id % 3 = 0"), signed).collect())
    assert got == sorted((a, b, (values[a] ^ values[b]).bit_count()) for a in range(0, 48, 3) for b in range(48) if a != b and (values[a] ^ values[b]).bit_count() <= 4)


def test_simhash_is_the_vote_of_grams(spark):
    import hashlib

    texts = ["", None, "one", "a b a b c", "Étude x-1 x-1 + .y", "w " * 9000]
    got = {r.id: r.signature for r in dedup.simhash_table(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[a-z0-9][a-z0-9\-+.]*", (t or "").lower())
        h = [int(hashlib.sha1(g.encode()).hexdigest()[:16], 16) for g in [*w, *map("__".join, zip(w, w[1:], strict=False))]]
        want = sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) >= len(h)) if h else 0
        assert got[i] & (1 << 64) - 1 == want, t


def test_exact_masters(spark):
    rows = [(1, "a", 5, 2), (2, "a", 9, 1), (3, "a", 9, 1), (4, None, 1, 1), (5, None, 1, 1), (6, "b", None, 3)] + [(100 + i, "hot", 1, i % 3) for i in range(60)]
    got = {r.id: (r.is_copy, r.is_master, r.master_id) for r in dedup.exact_masters(spark.createDataFrame(rows, "id long, key string, x int, y int"), "key", "id", ["x", "y"]).collect()}
    assert got[1] == (1, 0, 2) and got[2] == (1, 1, None) and got[3] == (1, 0, 2) and got[4] == got[5] == got[6] == (0, 1, None)
    assert got[102] == (1, 1, None) and sum(m for _, m, _ in got.values()) == 5


def test_near_pairs_leave_copies_out(spark):
    from lodeworks.queries.dedup import _near_input

    docs = [(i, " ".join(f"w{k}" for k in range(60)), 300) for i in range(30)] + [(50, " ".join(f"w{k}" for k in range(59)) + " other", 300)]
    import tempfile

    path = tempfile.mkdtemp()
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{path}/documents.parquet")
    assert [(r.a, r.b) for r in dedup.near_pairs(_near_input(spark, path)).collect()] == [(0, 50)]


def test_a_hub_s_component(spark):
    edges = [(0, i) for i in range(1, 300)] + [(300, 5), (301, 300), (400, 401), (402, 402)]
    got = {r.id: r.component for r in dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(302)} | {400: 400, 401: 400, 402: 402}


def test_blocks_of_a_page(spark):
    long = "Real words stand here. " * 20
    pages = {
        f"<body><div class='main-content'><div><p>{long}</p></div><div>{long} end</div></div><div id='side-menu'><div>{long * 9}</div></div></body>": f"{long}{long} end",
        f"<body><p>short</p><div class=\"story\">tiny</div></body>": "short tiny",  # noqa: F541
        f"<html><head><title>x</title></head><body><main>{long}</main><!-- {long} --><footer>{long * 5}</footer></body></html>": long,
        f"<div role='main'>{long}<ul class='share'><li>no</li></ul></div>": long,
        f"<article>{'<a href=x>link words here and there</a> ' * 40}</article><section class='post'><p>{long}</p>": long,
        "": "",
    }
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    got = [r.t for r in df.select("i", html.main_text(F.col("html")).alias("t")).orderBy("i").collect()]
    want = list(pages.values())
    for i in (0, 1, 2, 3, 5):
        assert got[i] == " ".join(want[i].split()), i
    assert got[4].endswith(" ".join(long.split()))


def test_sentence_units_against_plain_rules(spark):
    cases = {
        "One. Two! Three; Four": ["One.", "Two!", "Three;", "Four"], "Made by Acme Inc. In Georgia. Yes": ["Made by Acme Inc. In Georgia.", "Yes"], "- a\n- b\nc": ["- a", "- b", "c"], "line one\nline two": ["line one", "line two"],
        "": [], "Cost 3.5 units. Done": ["Cost 3.", "5 units.", "Done"], "5 plants\n" + "x" * 150 + "\n-y": ["5 plants", "x" * 150, "-y"], "He spoke; she left. no. Yes": ["He spoke; she left. no.", "Yes"], "First block.\n\nSecond one. Third.": ["First block.", "Second one.", "Third."],
    }
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.u for r in df.select("i", T.sentence_units(F.col("t")).alias("u")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_metadata_score_against_plain_formula(spark):
    texts = ["Supplier facility report 2031: 12 GWh plant in Georgia, port logistics and tax credit", "buy now coupon deal in the united states", "", "national global study of battery cell capacity, offtake agreement with Acme Corp; workforce"]
    rows = [(i, t, "", "", "", f"https://{d}/a", 0.1 * i) for i, (t, d) in enumerate(zip(texts, ("energy.gov", "ainvest.com", "x.org", "reuters.com"), strict=True))]
    df = spark.createDataFrame(rows, "id long, title string, content string, description string, query string, url string, engine double")
    got = {r.id: r for r in curation.scored_candidates(df).collect()}
    v, n = vocab, lambda low, ws: sum(w in low for w in ws)
    for i, t in enumerate(texts):
        low = " ".join(f"{t} {rows[i][5]}".split()).lower()
        cats, questions = sum(n(low, ws) > 0 for ws in v.SIGNALS.values()), sum(n(low, g) > 0 for g in v.QUESTIONS)
        specifics = sum(bool(re.search(p, low)) for p in v.SPECIFICS)
        penalty = min(24, 4 * n(low, v.NEGATIVE)) + (8 if n(low, v.NATIONAL) and not n(low, v.NODES) and not n(low, v.REGION) else 0)
        share = lambda x, m: min(100.0, x / m * 100)
        total = 0.12 * min(100, 10 * i) + 0.24 * share(cats, 6) + 0.12 * share(n(low, v.VALUE_CHAIN), 8) + (12 if n(low, v.REGION) else 0) + 0.08 * share(n(low, v.NODES), 6) + 0.08 * share(n(low, v.POLICY), 5) + 0.08 * share(questions, 7) + 0.06 * share(specifics, 5) + 0.06 * share(n(low, v.QUALITY), 6)
        total += (15.0, 0.5, 10.0, 8.0)[i] + (5 if cats >= 2 else 0) + (3 if questions and specifics else 0) - penalty
        assert got[i].metadata == pytest.approx(max(0, min(100, total)), abs=0.0101) and got[i].penalty == penalty
    gated = {r.id: r for r in curation.gated(curation.deduplicated(curation.scored_candidates(df))).collect()}
    assert gated[0].selected and not gated[2].selected


def test_vocabulary_and_marketing(spark):
    assert {"request a quote", "contact us", "learn more", "book a demo", "schedule a demo", "world-class"} <= set(vocab.MARKETING) and len(vocab.MARKETING) == 13
    got = spark.range(1).select(Q.company_aliases(F.lit("Acme Battery, Inc.")).alias("a"), Q.company_aliases(F.lit("Co Inc")).alias("b"), Q.county_aliases(F.lit("Chatham County")).alias("c"), Q.county_aliases(F.lit("Bibb County")).alias("d"), Q.county_aliases(F.lit("Chatham County"), ["chatham"]).alias("e")).first()
    assert got.a == ["acme battery inc", "acme battery"] and got.b == ["co inc"] and got.c == ["chatham county", "chatham"] and got.d == ["bibb county"] and got.e == ["chatham county"]


def test_rules_without_queries(spark):
    lit = F.lit
    one = spark.range(1).select(
        rules.probable_pdf(lit("http://x/a.PDF"), lit(""), lit(""), lit("")).alias("a"), rules.rule_gate(lit(1), lit(1), lit(0)).alias("b"), rules.rejection_reason(lit(True), lit(True), lit(False), lit(True)).alias("c"), rules.employment_limit(lit("employment at least 1,200")).alias("d"),
        rules.promotable({k: lit(True) for k in ("filtered", "file", "exact_master", "near_master")} | {"blocked": lit(False), "low_trust": lit(False), "decision": lit("discard")} | {k: lit(v) for k, v in {"credibility": 55.0, "heuristic": 41.0, "rerank": 56.0, "direct": 0.2, "adjacent": 0.61, "hybrid": 46.0, "rerank_embedding": 0.0}.items()}).alias("e"),
        evaluation.match_ratio(F.array(lit("a"), lit("a"), lit("b")), F.array(lit("b"))).alias("f"), evaluation.provenance(lit("local_rag"), lit("x"), lit(False))["knowledge"].alias("g"), evaluation.similarity_ratio(lit("abcd"), lit("bcde")).alias("h"),
        rules.first_page_score(lit("georgia supplier plant 12 gwh " * 20), lit("summary"), lit(50.0), lit(40.0), lit(60.0)).alias("i"),
    ).first()
    assert one.a and not one.b and one.c == "rule gate" and tuple(one.d) == (">=", 1200) and one.e and one.f == 0.5 and one.g == "x" and one.h == 0.75 and 0 < one.i <= 100
    scored = evaluation.scored_by(spark.createDataFrame([("a",), (None,)], "t string"), lambda xs: [float(len(x)) for x in xs], "t", "n").collect()
    assert [r.n for r in scored] == [1.0, 0.0]


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master, applicationId = "yarn", "app"
        getConf = lambda self: Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_structured_rows_come_before_ranked_chunks(spark):
    chunks = spark.createDataFrame(
        [(i, f"token{i % 3} common", [1.0, float(i)], "Acme" if i < 4 else "Rome" if i < 6 else "", "s", "", "", "", "row_full", "", "", f"r{i // 2}") for i in range(10)],
        "id long, text string, vector array<double>, company string, sheet string, category string, role string, product string, kind string, title string, analysis string, row_key string",
    )
    asked = spark.createDataFrame([(0, "token1 of acme", "fact"), (1, "token2", "fact")], "question long, text string, intent string")
    variants = asked.select("question", F.lit(0).alias("variant"), "text", F.array(F.lit(1.0), F.lit(0.5)).alias("vector"))
    structured = spark.createDataFrame([(0, 0, 900, "structured_match_summary", "", ""), (0, 1, 901, "structured_row_match", "Acme", "r0"), (0, 2, 902, "structured_row_match", "Acme", "r0"), (0, 3, 903, "structured_row_match", "Acme", "r9x")], "question long, ord int, id long, kind string, company string, row_key string")
    rows = retrieval.retrieve(asked, variants, chunks, retrieval.idf(chunks, "text"), structured, limit=5).orderBy("question", "rank").collect()
    own = [r for r in rows if r.question == 0]
    assert [r.id for r in own[:3]] == [900, 901, 903] and [r.final for r in own[:3]] == [1.0, 0.99, 0.99]  # one a row, two a company
    assert not [r for r in own[3:] if r.company == "Acme"] and len(own) == 5 and len({r.id for r in own}) == 5
    other = [r for r in rows if r.question == 1]
    assert len(other) == 5 and sum(r.company == "Acme" for r in other) <= 2 and [r["rank"] for r in other] == [1, 2, 3, 4, 5]


def test_answers_of_questions(spark):
    rows = spark.createDataFrame([("1", "Acme", "Tier 1", "Lab", "Rome, Floyd County", "Kia", 100), ("2", "Bolt", "Tier 1/2", "Lab", "Macon, Bibb County", "", 900), ("3", "Core", "Tier 2", "Fab", "Rome, Floyd County", "Kia", None)], "row_key string, company string, category string, role string, location string, primary_oems string, employment long")
    asked = spark.createDataFrame([(0, "Who is in Tier 1/2?"), (1, "List all of Kia in Floyd County"), (2, "employment >= 200"), (3, "what is this?"), (4, "Tier 2 or Tier 1 suppliers, excluding location = Rome.")], "question long, text string")
    names = Q.named(asked, rows)
    got = {}
    for r in Q.matched(asked, names, rows).collect():
        got.setdefault(r.question, set()).add(r.row_key)
    assert got == {0: {"1", "2"}, 1: {"1", "3"}, 2: {"1", "2", "3"}, 4: {"1", "3"}}
    forms = {r.question: r for r in Q.understood(asked).collect()}
    assert forms[1].exhaustive and forms[2].threshold.value == 200 and forms[4].excluded == ["Rome"] and forms[3].intent == "fact" and forms[1].intent == "aggregation"
    one = {r.question: r for r in Q.summaries(Q.matched(asked, names, rows), rows, preview=1).collect()}[1]
    assert one.summary == "Matched rows: 2\nBy category: Tier 1: 1; Tier 2: 1\nCompanies: Acme (+1 more)"


def test_all_cosines_of_odd_vectors(spark):
    """Every vector meets every reference; without a direction, or of another length, the score is 0."""
    from lodeworks.operators import retrieval as V

    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [-3.0, -4.0]), (6, [4.0, 3.0])], "id long, vector array<float>")
    r = spark.createDataFrame([(7, [3.0, 4.0]), (8, None), (9, [2.0])], "reference long, vector array<float>")
    wanted = {(i, k): 0.0 for i in range(1, 7) for k in (7, 8, 9)} | {(1, 7): 100.0, (4, 9): 100.0, (6, 7): 96.0}
    assert {(x.id, x.reference): x.score for x in V.reference_matrix(v, r).collect()} == wanted
    small = V.all_cosines(v, r, 2, 100.0, block=2)
    assert {(x.id, x.reference): x.score for x in small.collect()} == wanted
    assert V.reference_matrix(v, r.limit(0)).count() == 0


@pytest.mark.parametrize("hashed", [None, 512])
def test_bag_cosines_leave_texts_in_their_tasks(spark, hashed):
    """With few references nothing of the texts is shuffled, and the cosines are those of the shuffled way."""
    from lodeworks.operators import retrieval as V

    a = spark.createDataFrame([(i, t) for i, t in enumerate(["One two two three-4.", "", None, "zz", "two  ONE\none two", "caf\u00e9 one"])], "id long, text string")
    b = spark.createDataFrame([("x", "one two"), ("y", "three-4. zz q"), ("z", "")], "id string, text string")
    out = V.bag_cosines(a, b, hashed)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    own = {(r.a, r.b): r.cosine for r in out.collect()}
    most, V.BROADCAST_ROWS = V.BROADCAST_ROWS, 0
    try:
        other = {(r.a, r.b): r.cosine for r in V.bag_cosines(a, b, hashed).collect()}
    finally:
        V.BROADCAST_ROWS = most
    assert own == pytest.approx(other, abs=1e-12) and (0, "x") in own and (3, "y") in own
    assert V.bag_cosines(a, b.limit(0), hashed).count() == 0


def test_near_links_count_what_near_pairs_lists(spark, monkeypatch):
    # A family that shares its title, in blocks so small that it is dealt out among several, gives a row a document.
    rng = random.Random(11)
    words = [f"w{i}" for i in range(90)]
    base = [rng.choice(words) for _ in range(70)]
    texts = [" ".join(base[:8] + [rng.choice(words) if rng.random() < 0.04 else w for w in base[8:]]) for _ in range(40)] + [" ".join(rng.choice(words) for _ in range(70)) for _ in range(5)]
    df = spark.createDataFrame([(i, " ".join(t.split()[:8]), t) for i, t in enumerate(texts)], "id long, title string, body string")
    signed = df.join(dedup.simhash_table(df, "id", "body"), "id")
    pairs = {(r.a, r.b) for r in dedup.near_pairs(signed).collect()}
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 7)
    rows = dedup.near_links(signed).collect()
    assert {r.id: r.links for r in rows} == Counter(i for p in pairs for i in p) and len(pairs) > 100
    assert {(r.a, r.b) for r in dedup.near_pairs(signed).collect()} == pairs
    assert {r.component for r in rows} == {0} and len(rows) == 40


@pytest.mark.parametrize("rows", [0, 200_000])
def test_lexical_top_cuts_in_the_task(spark, monkeypatch, rows):
    # Ties by id, bonuses and the best of two variants, cut again and again while chunks are read; and by a shuffle.
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    chunks = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(4)), rng.choice(["", "W1", "w2 w3", None])) for i in range(200)], "id long, text string, name string").repartition(3)
    asked = spark.createDataFrame([(k, v, " ".join(rng.choice(words) for _ in range(3))) for k in range(4) for v in range(2)], "question long, variant int, text string")
    weights = retrieval.idf(chunks, "text")
    bonus = F.when((F.coalesce("name", F.lit("")) != "") & F.contains(F.lower("query_text"), F.lower("name")), 2.5).otherwise(0.0)
    scores = retrieval.lexical_scores(asked, chunks, weights, bonus).withColumn("score", F.round("score", 6))
    want = sorted(map(tuple, retrieval.top_ranks(scores, 7).collect()))
    monkeypatch.setattr(retrieval, "WAITING", 20)
    monkeypatch.setattr(retrieval, "SCORES", 100)
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", rows)
    top = retrieval.lexical_top(asked, chunks, weights, 7, 6, {"name": 2.5})
    assert sorted(map(tuple, top.collect())) == want and len(want) == 28


def test_only_tokens_asked_for_are_counted(spark, monkeypatch):
    # Others of the texts are never shuffled; with too many to ask for, all are.
    texts = ["the cat", "The CAT sat", None, "", "dog-the-dog", "\u212aat 42"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([("a cat, the",), ("kat",), (None,)], "text string")
    every = {r.token: (r.df, r.idf) for r in retrieval.idf(chunks, "text").collect()}
    few = {r.token: (r.df, r.idf) for r in retrieval.idf(chunks, "text", asked).collect()}
    assert few == {t: every[t] for t in ("cat", "the", "kat")} and few["the"][0] == 3
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 2)
    assert {r.token: (r.df, r.idf) for r in retrieval.idf(chunks, "text", asked).collect()} == every


def test_hits_of_many_queries_are_not_shuffled(spark, monkeypatch):
    # 400 chunks that all meet all 12 questions: with more tokens than are brought at once, too, a task gives each question's best 3.
    monkeypatch.setattr(retrieval, "BROADCAST_ROWS", 5)
    chunks = spark.range(400, numPartitions=2).select("id", F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    asked = spark.range(12).select(F.col("id").alias("question"), F.lit(0).alias("variant"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    seen, own = [], retrieval.top_ranks
    monkeypatch.setattr(retrieval, "top_ranks", lambda scores, top: seen.append(scores.count()) or own(scores, top))
    top = retrieval.lexical_top(asked, chunks, retrieval.idf(chunks, "text", asked), 3, 6)
    got = {(r.question, r["rank"]): r.id for r in top.collect()}
    assert seen == [2 * 12 * 3]
    assert got == {(q, k + 1): i for q in range(12) for k, i in enumerate([q, *(i for i in range(3) if i != q)][:3])}


def test_words_of_a_text(spark):
    texts = ["One, two  THREE", "-- a", "", None, "x" * 40_000, "\u0130stanbul \u212a 7", "a b c d e f g h i"]
    key = lambda t: [w for w in re.sub("[^a-z0-9]+", " ", (t or "").lower()).split(" ") if w]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", F.array(*(T.nth_word(F.col("t"), n) for n in range(1, 9))).alias("w")).collect()
    assert {r.i: r.w for r in got} == {i: [*key(t), *[""] * 8][:8] for i, t in enumerate(texts)}


def test_hamming_matches_are_dealt_out(spark):
    # One small file of signatures that all share a band: the work on it is no single task's.
    signed = spark.range(60).select("id", F.shiftleft("id", 60).alias("signature")).coalesce(1)
    found = dedup.hamming_matches(signed.where("id % 20 = 0"), signed)
    assert found.rdd.getNumPartitions() > 1
    rows = signed.collect()
    want = {(a.id, b.id) for a in rows for b in rows if a.id % 20 == 0 and a.id != b.id and ((a.signature ^ b.signature) & (2**64 - 1)).bit_count() <= 4}
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) == found.count()


def test_vectors_are_shuffled_in_their_own_precision(spark):
    from lodeworks.operators import retrieval as V

    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(6)], "id long, vector array<float>")
    out = V.all_cosines(v, v.where("id = 2").withColumnRenamed("id", "reference"), 6)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "array<double>" not in plan and {r.id: r.score for r in out.collect()} == {i: round((2 * i + 1) / ((i * i + 1) * 5) ** 0.5, 6) for i in range(6)}
