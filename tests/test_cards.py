"""Cards, their scores and the decision against a plain version of the formulas, on a small corpus."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodeworks.functions import rules as R
from lodeworks.plans import cards as C
from lodeworks.queries import cards as Q

V, G = Q.PROSE, Q.GROUNDING
WORDS = "the thing and of that with ation er en die der das nicht que de la para mit report port rail ist is 12 gwh 2031-01-05 Alpha plant keit heit on in by for buy ell".split()


@pytest.fixture(scope="module")
def rows(spark):
    rng, out = random.Random(31), []
    for i in range(14):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 5, 60, 400, 1500])))
        html = f"<html><head><title>t</title><meta name='date' content='2030'></head><body><nav>x</nav><article><h1>Big Head</h1><p>{text}</p></article></body></html>" if i % 4 == 0 and len(text) > 300 else None
        url = ["https://www.epa.gov/a.pdf", "http://ainvest.com/x", "https://fool.com/y.html", "https://x.org/z", "https://n.example/q"][i % 5]
        out.append((i, " ".join(text.split()[:5]), url, "" if i % 3 == 0 else "the thing that der", "", text[:50], float(i * 7), html, text or None, i % 6 != 5))
    return spark.createDataFrame(out, "id long, title string, url string, query string, description string, snippet string, metadata double, html string, text string, file boolean")


def counter(text):
    t = re.findall(r"[a-z0-9][a-z0-9\-+.]*", " ".join(text.split()).lower())
    return Counter(int(hashlib.sha1(g.encode()).hexdigest()[:8], 16) % 512 for g in [*t, *map("__".join, zip(t, t[1:], strict=False))])


def similar(a, b):
    x, y = counter(a), counter(b)
    if not x or not y:
        return 0.0
    return round(100 * sum(n * y[k] for k, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values())), 2)


def figures(text, query):
    whole = similar(text, G.whole)
    return whole, similar(text, query) if query.strip() else whole, [similar(text, f) for f in G.facets.values()]


def hits(text, words):
    return sum(w in text.lower() for w in words)


clamp = lambda x, lo=0.0, hi=100.0: max(lo, min(hi, x))
near = lambda x: pytest.approx(x, abs=0.0151)


@pytest.fixture(scope="module")
def carded(spark, rows):
    return C.cards(rows, Q.names(spark), G, v=V)


def test_chunks_are_the_best_windows(spark, rows, carded):
    profiled = {r.id: r for r in C.profiles(rows, v=V).collect()}
    cards = {r.id: r for r in carded.collect()}
    assert len(cards) == 14
    for i, p in profiled.items():
        windows = []
        for e in p.entries:
            w = e.text.split()
            windows += [(e.label, " ".join(w[at : at + 180])) for at in range(0, max(1, len(w) - 45), 135)][:3] if w else []
        scored = []
        for k, (label, text) in enumerate(windows):
            whole, asked, facets = figures(text, p["query"])
            scored.append((-round(0.30 * whole + 0.30 * max(facets) + 0.25 * asked + 0.15 * sum(sorted(facets)[-2:]) / 2, 2), k, label, text))
        best = [x[3] for x in sorted(scored)[:3]]
        got = cards[i].chunks
        assert len(got) == len(best)
        for c, x in zip(got, sorted(scored)[:3], strict=True):
            assert c.combined == near(-x[0])
        if len({round(x[0], 1) for x in scored}) == len(scored):  # no near ties
            assert [c.text for c in got] == best
        assert p.content_source == ("local_html" if p.html else "local_text" if p.full else "metadata")
        assert p.published == ("2030" if p.html else "2031-01-05" if "2031-01-05" in (p.full or "")[:2500] else p.published)


def test_scores_against_plain_formulas(spark, carded):
    own = C.credible(Q._judged_columns(C.classified(C.scored(carded, G, V), V)), V)
    for r in own.collect():
        text = r.card_text
        whole, asked, facets = figures(text, r["query"])
        top2, cover = sum(sorted(facets)[-2:]) / 2, 100 * sum(f >= 55 for f in facets) / 4
        semantic = round(0.30 * whole + 0.25 * top2 + 0.20 * cover + 0.25 * asked, 2)
        n = {k: len(r[k]) for k in ("companies", "counties", "oems", "ports", "facilities", "capacities", "dates", "value_chain")}
        lexical = sum(min(cap, w * (n[k] if k in n else hits(text, V.LEXICAL[k]))) for k, (w, cap) in R.ENTITY_WEIGHTS.items())
        assert r.lexical == near(clamp(lexical)) and r.semantic == near(semantic)
        hybrid = 0.55 * r.semantic + 0.45 * r.lexical
        grounded = min(100.0, 18 * n["companies"] + 12 * n["counties"] + 14 * n["oems"] + 10 * n["facilities"] + 18 * n["capacities"] + 5 * min(4, n["dates"]))
        mean = lambda k: sum(c[k] for c in r.chunks) / len(r.chunks) if r.chunks else 0.0  # noqa: E731, B023
        rerank_embedding = 0.45 * asked + 0.35 * r.semantic + 0.20 * mean("asked")
        assert (r.hybrid, r.grounded, r.chunk_mean, r.rerank_embedding) == (near(hybrid), near(grounded), near(mean("combined")), near(rerank_embedding))
        trust = {"www.epa.gov": 15.0, "ainvest.com": 0.5, "fool.com": 1.5, "x.org": 10.0, "n.example": 6.0}[r.domain]
        source = min(100, trust / 15 * 100)
        cats = sum(any(w in text.lower() for w in ws) for ws in V.SIGNALS.values())
        questions = sum(hits(text, g) > 0 for g in V.QUESTIONS)
        depth = (5 if r.metadata_summary else 0) + (18 if r.first_page_summary else 0) + (15 if r.two_page_summary else 0) + (15 if r.sampled_summary else 0) + (10 if r.headings_text else 0) + (20 if r.relevant_chunks else 0) + (10 if r.content_source != "metadata" else 0)
        region = 100 if hits(text, V.REGION) or n["counties"] else 0
        count = {k: hits(text, getattr(V, k)) for k in ("NEGATIVE", "MARKETING", "NEWS", "RESEARCH", "QUALITY")}
        penalty = min(45, 5 * count["NEGATIVE"] + 6 * count["MARKETING"] + 4 * count["NEWS"] + (6 if count["RESEARCH"] and grounded < 25 else 0))
        heuristic = clamp(0.20 * min(100, cats / 4 * 100) + 0.18 * min(100, questions / 5 * 100) + 0.22 * grounded + 0.14 * mean("combined") + 0.10 * region + 0.07 * source + 0.03 * min(100, depth + (5 if r.published else 0)) + 0.04 * r.metadata + 0.04 * min(100, count["QUALITY"] / 5 * 100) - penalty)
        assert r.heuristic == near(heuristic), r.id
        unit = lambda x: clamp(x, 0.0, 1.0)
        g, sem, rer, hyb, lex, q, reg, chunk = (unit(x) for x in (grounded / 100, r.semantic / 100, r.rerank_embedding / 100, r.hybrid / 100, r.lexical / 100, questions / 5, region / 100, mean("combined") / 100))
        pol, log, rel = (unit(hits(text, V.RUBRIC[k]) / 5) for k in ("policy", "logistics", "relationship"))
        rec, res, news, mark = unit(hits(text, V.RUBRIC["recycling"]) / 4), unit(count["RESEARCH"] / 4), unit(count["NEWS"] / 4), unit(count["MARKETING"] / 4)
        direct = unit(0.24 * g + 0.18 * hyb + 0.08 * sem + 0.08 * rer + 0.08 * lex + 0.15 * q + 0.10 * rel + 0.10 * log + 0.10 * pol + 0.10 * reg - 0.12 * news - 0.15 * mark - 0.08 * res)
        adjacent = unit(0.28 * pol + 0.24 * log + 0.14 * sem + 0.10 * hyb + 0.08 * rer + 0.12 * q + 0.08 * chunk + 0.06 * reg - 0.10 * mark)
        noise = unit(0.62 * mark + 0.20 * (1 - g) + 0.18 * (1 - unit(source / 100)))
        generic = unit(0.55 * news + 0.15 * (1 - g) + 0.15 * (1 - q) + 0.15 * (1 - chunk))
        fine = lambda x: pytest.approx(x, abs=3e-4)
        assert (r.direct, r.adjacent, r.marketing_noise, r.generic_news) == (fine(direct), fine(adjacent), fine(noise), fine(generic))
        rerank = 0.28 * r.heuristic + 0.28 * r.hybrid + 0.16 * r.rerank_embedding + 0.06 * r.semantic + 20 * direct - 10 * generic - 10 * noise
        assert r.rerank == near(rerank)
        topics = {"recycling_materials": rec + 0.2 * sem, "policy_localization": pol + 0.15 * reg + 0.1 * hyb, "logistics_risk": log + 0.2 * sem, "supplier_tiering": rel + 0.2 * g + 0.1 * hyb, "who_where_scale": 0.35 * g + 0.25 * lex + 0.2 * q + 0.2 * sem}
        assert topics[r.topic] >= max(topics.values()) - 1e-3
        blocked, low = r.domain == "ainvest.com", r.domain in ("ainvest.com", "fool.com")
        kind = "PDF" if r.url.endswith(".pdf") else "HTML"
        typed = min(100, 15 + 12 * hits(f"{r.title} {r.relevant_chunks[:400]} {kind}", V.QUALITY) + (8 if kind == "PDF" else 0))
        llm = 50.0 if r.information is None else clamp(8 * r.information + 12 * r.confidence - 4 * r.noise)
        cost = min(60, 6 * count["NEWS"] + 8 * count["MARKETING"] + 3 * noise) + (35 if blocked else 18 if low else 0)
        credibility = clamp(0.18 * source + 0.28 * min(100, depth) + 0.24 * clamp(1.2 * r.lexical + 0.3 * grounded) + 0.10 * (100 if r.published else 60 if n["dates"] else 25) + 0.08 * typed + 0.12 * llm - cost)
        assert r.credibility == near(credibility) and (r.blocked, r.low_trust) == (blocked, low)
        assert r.final_rank == near(0.40 * r.rerank + 0.25 * r.hybrid + 0.25 * r.credibility + 5.0 * bool(r.passed) + 0.5 * (r.information or 0))


def test_decisions_follow_the_rules_in_order(spark, carded):
    own = C.credible(Q._judged_columns(C.classified(C.scored(carded, G, V), V)), V).withColumn("exact", F.col("id") == 3)
    limits, bar = (40.0, 20.0, 0.30), 50.0
    got = {r.id: r for r in C.curated(own, judge=True, share=1.0, limits=limits, bar=bar).collect()}
    for r in got.values():
        short = r.heuristic >= limits[0] and r.hybrid >= limits[1] and r.direct >= limits[2]
        n, m = r.generic_news, r.marketing_noise
        steps = [
            (r.exact or not r.file or r.blocked, "discard"), (r.low_trust and (n >= 0.2 or m >= 0.2 or r.credibility < 75), "discard"), (short and r.passed and r.credibility >= bar, "keep"), (short, "review"),
            (r.credibility >= 55 and r.heuristic >= 48 and r.rerank >= 58 and (r.direct >= 0.45 or r.adjacent >= 0.55), "review"), (r.adjacent >= 0.6 and r.hybrid >= 55 and r.credibility >= 50 and n <= 0.45 and m <= 0.45, "review"), (r.direct >= 0.55 and r.heuristic >= 38 and r.hybrid >= 55, "review"),
        ]
        want = next((what for on, what in steps if on), "discard")
        assert r.decision == want or (want == "keep" and r.moved), r.id
    registry = C.document_registry(C.curated(own, judge=True, share=1.0, limits=limits, bar=bar)).collect()
    assert {r.id for r in registry} == {i for i, r in got.items() if r.decision != "discard"} and registry
    assert all(r.rationale.startswith(f"Final decision={got[r.id].decision}") and f"subtopic={got[r.id].topic}" in r.factors for r in registry)


def test_summaries_and_snippets(spark):
    one = spark.range(1)
    entries = F.array(F.struct(F.lit("first part").alias("label"), F.lit("The thing. Another one.").alias("text")), F.struct(F.lit("late").alias("label"), F.lit(" ").alias("text")))
    got = one.select(C.entry_summary(entries, ["the"], ["x"]).alias("a"), C.joined_snippets(entries).alias("b"), C.evidence_pages(F.array(F.lit("3"), F.lit(None), F.lit("x"), F.lit("1"), F.lit("3"))).alias("c"), C.metadata_summary(F.lit("T"), F.lit(None), F.lit("d.org"), F.lit(""), F.lit("s"), F.lit(7.5)).alias("d")).first()
    assert got.a == "First Part: The thing. Another one." and got.b == "[1 first part] The thing. Another one. || [2 late] "
    assert got.c == [3, 1] and got.d == "title: T query: domain: d.org description: content snippet: s metadata score: 7.5"


def test_curated_on_empty_tables(spark, rows):
    none = C.cards(rows.where("false"), Q.names(spark), G, v=V)
    assert C.curated(C.credible(C.classified(C.scored(none, G, V), V), V)).count() == 0


def test_no_terms_across_parts(spark):
    """A part that ends in a blank and the next one make no term: here the first segment ends in "ing ", the middle
    one begins with "of", and no part has "ing of"."""
    text = ("x" * 164 + " of" + "y" * 2200)[:2195] + "ying " + "z" * 330
    assert len(text) == 2530 and text[165:167] == "of" and text[:2200].endswith("ing ") and "ing of" not in text
    row = [(1, "t", "https://x.org/z", "", "", "", 1.0, None, text, True)]
    rows = spark.createDataFrame(row, "id long, title string, url string, query string, description string, snippet string, metadata double, html string, text string, file boolean")
    assert C.entities(C.profiles(rows, v=V), Q.names(spark), ["ing of", "ying"], V).first().value_chain == ["ying"]


def test_cards_leave_texts_with_the_profile(spark):
    row = spark.createDataFrame([(1, "T", "https://a.org/x", "the", "d", "s", 1.0, None, "the thing of that. " * 40, True)], "id long, title string, url string, query string, description string, snippet string, metadata double, html string, text string, file boolean")
    made = C.cards(row, Q.names(spark), Q.GROUNDING, v=Q.PROSE)
    assert not {"full", "first", "two", "sampled", "text", "html", "entries"} & set(made.columns) and made.first().first_page_summary.startswith("the thing")


def test_searched_text_is_squeezed_and_dates_are_looked_for(spark):
    # The first page ends in a blank, and a title has more than one: the whole still reads as if it had been squeezed.
    body = "ab " * 833 + "on 2031-01-05 and in March 3, 2029. " + "cd " * 900
    row = spark.createDataFrame([(1, " A  T ", "https://a.org/x", "the", "d", "s", 1.0, None, body, True)], "id long, title string, url string, query string, description string, snippet string, metadata double, html string, text string, file boolean")
    made = C.profiles(row, v=Q.PROSE).select(C.entity_text().alias("t"), "first").first()
    assert made.t == " ".join(made.t.split()) and made.t.startswith("A T title:") and made.t.endswith("cd cd")
    assert [list(r.d) for r in spark.createDataFrame([(made.t,), ("none in 1999",), (None,)], "t string").select(C.T.dates(F.col("t")).alias("d")).collect()] == [["March 3, 2029", "2031-01-05", "2031", "2029"], [], []]


def test_metadata_summary_of_blank_values(spark, tmp_path):
    # Blank and missing values, and white space that the SQL doesn't squeeze.
    import duckdb

    from lodeworks.queries import ORACLES, QUERIES

    rows = [(1, " " * 60 + "late", "en", "a", 64), (2, "", "de", "b", 0), (3, None, None, None, 0), (4, "a  \t b", "", "", 5), (5, " a\x0bb c　", "x  y", " s ", 7), (6, "no length", "en", "a", None), (7, "plain text " * 9, "en", "a", 99)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = sorted(con.execute(ORACLES["metadata_summary"]).fetchall())
    assert sorted(map(tuple, QUERIES["metadata_summary"](spark, str(tmp_path)).collect())) == want
    assert want[0][1] == "title: en query: domain: a description: d content snippet:  metadata score: 64"
