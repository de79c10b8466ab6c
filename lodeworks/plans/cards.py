"""Document cards: what a candidate's text says, what it names, its best passages, and the scores and the decision that
follow. Each stage is a table by id; texts are written once, with the profile, and read whole.

Rows: id, title, url, query, description, snippet, metadata (score), html, text (either may be null), file (bool).
Vocabularies, names and reference texts are parameters.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import html as H
from ..functions import rules as R
from ..functions import text as T
from ..functions import vocab
from ..operators.joins import name_matches
from ..operators.ranking import diversified, final_order
from ..operators.shared import shared_table

BUCKETS = 512


@dataclass(frozen=True)
class Grounding:
    """What cards are compared with: a text for all, one for each facet, and terms of the value chain."""

    whole: str
    facets: dict[str, str]
    value_chain: list[str] = field(default_factory=list)


# ---- similarity by hashed grams


#: Grams whose buckets a Python worker remembers.
KNOWN_GRAMS = 500_000
_TOKEN = re.compile(r"[a-z0-9][a-z0-9\-+.]*")
_known: dict[str, int] = {}


def buckets(text: str) -> list[int]:
    """The buckets of a text's tokens and bigrams."""
    tokens = _TOKEN.findall((text or "").lower())
    if len(_known) > KNOWN_GRAMS:
        _known.clear()
    out = []
    for g in (*tokens, *map("__".join, zip(tokens, tokens[1:], strict=False))):
        if g not in _known:
            _known[g] = int(hashlib.sha1(g.encode()).hexdigest()[:8], 16) % BUCKETS
        out.append(_known[g])
    return out


def counts(texts: list[str]) -> np.ndarray:
    """Counts by bucket, a row a text."""
    return np.stack([np.bincount(buckets(t), minlength=BUCKETS) for t in texts]).astype(np.float64) if texts else np.zeros((0, BUCKETS))


def _cosines(x: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Cosines of rows with references; 0 where one of them is empty."""
    norms = np.outer(np.sqrt((x * x).sum(1)), np.sqrt((refs * refs).sum(1)))
    return np.divide(x @ refs.T, norms, out=np.zeros(norms.shape), where=norms > 0)


def _compared(given: tuple[str, ...]):
    """Cosines of texts with fixed references and with their own queries: a matrix product a batch of texts."""
    refs = counts(list(given))

    @F.pandas_udf("struct<refs:array<double>,asked:double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, queries in batches:
            found, asked = np.zeros((len(texts), len(refs))), np.zeros(len(texts))
            own, of = np.unique(queries.fillna("").to_numpy(dtype=object), return_inverse=True)
            wanted = counts(list(own))
            for at in range(0, len(texts), 1024):
                x, q = counts(texts.iloc[at : at + 1024].tolist()), wanted[of[at : at + 1024]]
                found[at : at + 1024] = _cosines(x, refs)
                norms = np.sqrt((x * x).sum(1) * (q * q).sum(1))
                asked[at : at + 1024] = np.divide((x * q).sum(1), norms, out=np.zeros(len(x)), where=norms > 0)
            yield pd.DataFrame({"refs": list(found), "asked": asked})

    return run


def _percent(cosine: Column) -> Column:
    return F.round(100.0 * T.clamp(F.coalesce(cosine, F.lit(0.0)), 0.0, 1.0), 2)


def with_similarities(df: DataFrame, name: str, c: str, query: str, grounding: Grounding) -> DataFrame:
    """df with a struct of whole, query (whole without one) and facets (an array in the order of the grounding's), each 0
    to 100, of a text column and the query that goes with it."""
    compared = _compared((grounding.whole, *grounding.facets.values()))
    raw = df.withColumn("_raw", compared(T.text(F.col(c)), T.text(F.col(query))))
    whole = _percent(F.get("_raw.refs", F.lit(0)))
    asked = F.when(T.squeeze(F.col(query)) == "", whole).otherwise(_percent(F.col("_raw.asked")))
    facets = F.array(*(_percent(F.get("_raw.refs", F.lit(i + 1))) for i in range(len(grounding.facets)))).cast("array<double>")
    return raw.withColumn(name, F.struct(whole.alias("whole"), asked.alias("query"), facets.alias("facets"))).drop("_raw")


# ---- parts of a card


def metadata_summary(title: Column, query: Column, domain: Column, description: Column, snippet: Column, metadata: Column) -> Column:
    named = {"title": title, "query": query, "domain": domain, "description": description, "content snippet": snippet}
    parts = [F.concat(F.lit(f"{k}: "), T.text(c)) for k, c in named.items()]
    score = F.when(T.text(metadata) != "", F.concat(F.lit("metadata score: "), T.text(metadata)))
    return T.squeeze(F.concat_ws(" ", *parts, score))


def entry_summary(entries: Column, pool: list[str], regions: list[str], count: int = 4, limit: int = 1400, specifics: list[str] = vocab.SPECIFICS) -> Column:
    """The first entries (label, text), two sentences of each, labelled."""
    short = lambda e: T.extractive_summary(e["text"], pool, regions, 2, 240, specifics)
    made = F.transform(F.slice(entries, 1, count), lambda e: T.let(short(e), lambda s: F.when(s != "", F.concat(F.initcap(e["label"]), F.lit(": "), s))))
    return F.left(F.array_join(F.array_compact(made), " || "), F.lit(limit))


def joined_snippets(chunks: Column, limit: int = 500) -> Column:
    """Passages (text, label), numbered, with where they are from."""
    one = lambda c, i: F.concat(F.lit("["), (i + 1).cast("string"), F.when(T.text(c["label"]) != "", F.concat(F.lit(" "), c["label"])).otherwise(""), F.lit("] "), F.left(T.squeeze(c["text"]), F.lit(limit)))
    return F.array_join(F.transform(chunks, one), " || ")


def evidence_pages(pages: Column) -> Column:
    """The page numbers of passages, each once; those that are no numbers are left out."""
    return F.array_distinct(F.array_compact(F.transform(pages, lambda p: p.cast("string").try_cast("int"))))


def profiles(rows: DataFrame, enriched: bool = False, max_chars: int | None = None, v=vocab) -> DataFrame:
    """rows with domain, full (the text: of the page, else the plain one; up to max_chars), content_source, first and
    two (what stands for pages), headings, published, entries (sampled segments, sequential ones for enriched cards),
    and metadata_summary."""
    page = T.text(F.col("html")) != ""
    read = F.when(page, H.main_text(F.col("html"))).otherwise(T.squeeze(F.col("text")))
    own = rows.withColumn("full", read if max_chars is None else F.left(read, F.lit(max_chars)))
    own = own.withColumns({
        "domain": T.domain(F.col("url")), "content_source": F.when(F.col("full") == "", "metadata").when(page, "local_html").otherwise("local_text"), "first": F.left("full", F.lit(v.FIRST_PAGE)), "two": F.left("full", F.lit(v.TWO_PAGES)),
        "headings": F.when(page, T.distinct_texts(H.heading_texts(F.col("html")), 20)).otherwise(T.headings(F.left(T.text(F.col("text")), F.lit(v.TWO_PAGES)))), "sampled": C.anchored_segments(F.col("full")),
        "published": T.publication_date(F.col("full"), [H.publication_date(F.col("html"))]),
    })
    sequential = F.transform(C.sequential_segments(F.col("full")), lambda x, i: F.struct(F.concat(F.lit("segment "), (i + 1).cast("string")).alias("label"), x.alias("text")))
    short = F.transform("sampled", lambda e: F.struct(e["label"].alias("label"), e["text"].alias("text")))
    own = own.withColumn("entries", sequential if enriched else short).withColumn("sampled", short)
    return own.withColumn("metadata_summary", metadata_summary(*(F.col(c) for c in ("title", "query", "domain", "description", "snippet", "metadata"))))


def entity_text(cap: int | None = None) -> Column:
    """What of a profile is searched for names. All parts but the title are squeezed already, but for a blank at the end of a
    cut one: without these the whole need not be squeezed again."""
    full = F.col("full") if cap is None else F.left("full", F.lit(cap))
    parts = (T.squeeze(F.col("title")), F.col("metadata_summary"), F.col("first"), F.col("two"), F.array_join(F.transform("sampled", lambda e: e["text"]), " "), full)
    return F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in parts))


def term_text() -> Column:
    """What of a profile is searched for terms: the same parts with the blanks at their ends, so that one that ends in a
    blank and the next make no term of two words that no part has."""
    return F.concat_ws(" ", T.text(F.col("title")), "metadata_summary", "first", "two", F.array_join(C.anchored_pieces(F.col("full")), " "), "full")


KINDS = {"company": "companies", "county": "counties", "oem": "oems", "port": "ports"}


def entities(profiled: DataFrame, names: DataFrame, value_chain: list[str], v=vocab) -> DataFrame:
    """(id, companies, counties, oems, ports, facilities, capacities, dates, value_chain): arrays. names: kind, name,
    alias, ord. Names of a kind are capped in their order, as v.NAME_CAPS says."""
    texts = profiled.select("id", entity_text().alias("t"), F.lower(term_text()).alias("low"))
    coded = names.select("kind", F.concat_ws("\x1f", "kind", "name").alias("name"), "alias", "ord")
    hits = name_matches(texts, coded, "id", "t").select("id", F.split_part("name", F.lit("\x1f"), F.lit(1)).alias("kind"), F.split_part("name", F.lit("\x1f"), F.lit(2)).alias("name"), "ord")
    of = lambda kind, out: F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "name")))), lambda x: x["name"]), 1, v.NAME_CAPS[kind]).alias(out)
    found = hits.groupBy("id").agg(*(of(kind, out) for kind, out in KINDS.items()))  # no more than names
    terms = F.array(*map(F.lit, value_chain)).cast("array<string>")
    own = texts.select(
        "id", T.facilities(F.col("t")).alias("facilities"), T.capacities(F.col("t")).alias("capacities"), T.dates(F.col("t")).alias("dates"),
        T.distinct_texts(F.filter(terms, lambda w: (w != "") & F.contains(F.col("low"), F.lower(w))), v.VALUE_CHAIN_CAP).alias("value_chain"),
    )
    none = F.array().cast("array<string>")
    return own.join(found, "id", "left").select("id", *(F.coalesce(c, none).alias(c) for c in KINDS.values()), "facilities", "capacities", "dates", "value_chain")


def chunk_candidates(profiled: DataFrame, per_entry: int = 3) -> DataFrame:
    """(id, query, ord, label, index, text): windows of each entry, `per_entry` at most."""
    entry = profiled.select("id", "query", F.posexplode("entries").alias("e", "entry"))
    cut = entry.select("id", "query", "e", F.col("entry.label").alias("label"), F.posexplode(C.word_windows(F.col("entry.text"), limit=per_entry)).alias("w", "text"))
    return cut.select("id", "query", (F.col("e") * per_entry + F.col("w")).alias("ord"), "label", (F.col("w") + 1).alias("index"), "text")


def top_chunks(candidates: DataFrame, grounding: Grounding, top: int = 3) -> DataFrame:
    """The candidates of the best chunk score of each id, with whole, asked, facet and combined; ties to the first."""
    scored = with_similarities(candidates, "s", "text", "query", grounding)
    labels = F.array(*map(F.lit, grounding.facets))
    best = F.array_max(F.transform("s.facets", lambda f, i: F.struct(f.alias("v"), (-i).alias("i"))))
    facets = [F.get("s.facets", F.lit(i)) for i in range(len(grounding.facets))]
    own = scored.select(*candidates.columns, F.col("s.whole").alias("whole"), F.col("s.query").alias("asked"), F.get(labels, -best["i"]).alias("facet"), R.chunk_score(F.col("s.whole"), facets, F.col("s.query")).alias("combined"))
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("combined"), "ord"))).where(F.col("rank") <= top)


def cards(rows: DataFrame, names: DataFrame, grounding: Grounding, enriched: bool = False, v=vocab) -> DataFrame:
    """rows as cards: the profile without its texts, the entities' arrays, chunks (array of rank, text, label, facet, asked,
    combined, in order), summaries, headings_text, relevant_chunks, evidence, evidence_pages_text, and card_text."""
    profiled = shared_table(profiles(rows, enriched, v=v), "profiles")
    best = top_chunks(chunk_candidates(profiled, 6 if enriched else 3), grounding, 5 if enriched else 3)
    chunk = F.array_sort(F.collect_list(F.struct("rank", "text", "label", "facet", "asked", "combined"))).alias("chunks")
    grouped = best.groupBy("id").agg(chunk)  # five at most
    none = F.array().cast(grouped.schema["chunks"].dataType)
    own = profiled.join(entities(profiled, names, grounding.value_chain, v), "id").join(grouped, "id", "left").withColumn("chunks", F.coalesce("chunks", none))
    pool = [*v.VALUE_CHAIN, *v.REGION, *v.POLICY, *(w for ws in v.SIGNALS.values() for w in ws)]
    summary = lambda c, count, limit: T.extractive_summary(F.col(c), pool, v.REGION, count, limit, v.SPECIFICS)
    own = own.withColumns({
        "first_page_summary": summary("first", 4, 750), "two_page_summary": summary("two", 5, 950), "sampled_summary": entry_summary(F.col("sampled"), pool, v.REGION, 4, 1500, v.SPECIFICS), "headings_text": F.array_join(F.slice("headings", 1, 15), " | "),
        "relevant_chunks": joined_snippets(F.col("chunks")), "evidence_pages_text": F.lit(""),
    })
    said = [F.array_join(c, " ") for c in (*KINDS.values(), "facilities", "capacities", "dates", "value_chain")]
    snippets = F.array_join(F.transform("chunks", lambda c: F.left(T.squeeze(c["text"]), F.lit(500))), " ")
    body = F.concat_ws(" ", T.text(F.col("title")), "metadata_summary", "first_page_summary", "two_page_summary", "sampled_summary", F.array_join(F.slice("headings", 1, 12), " "), snippets, *said)
    # The texts stay with the profile: nothing that follows reads them, and they would be shuffled and written at each stage.
    return shared_table(own.withColumn("card_text", T.squeeze(body)).drop("entries", "html", "text", "full", "first", "two", "sampled"), "cards")


# ---- scores and decisions


def scored(carded: DataFrame, grounding: Grounding, v=vocab) -> DataFrame:
    """Cards with their scores: lexical, semantic, hybrid, rerank_embedding, heuristic and what these are made of."""
    c = F.col("card_text")
    n = lambda k: F.size(k).cast("double")
    mean = lambda k: F.when(F.size("chunks") > 0, F.aggregate("chunks", F.lit(0.0), lambda s, x: s + x[k]) / F.size("chunks")).otherwise(0.0)
    hits = lambda words: T.keyword_count(c, words)
    own = with_similarities(carded, "s", "card_text", "query", grounding).withColumns({"cat": R.category_hits(c, v.SIGNALS)} | {f"n_{k}": hits(getattr(v, k.upper())) for k in ("quality", "negative", "marketing", "news", "research", "region")})
    counts = {k: n(k) for k in (*KINDS.values(), "facilities", "capacities", "dates", "value_chain")} | {k: hits(words) for k, words in v.LEXICAL.items()}
    facets = [F.get("s.facets", F.lit(i)) for i in range(len(grounding.facets))]
    grounded = F.least(F.lit(100.0), sum((w * (F.least(F.lit(4.0), n(k)) if k == "dates" else n(k)) for k, w in v.GROUNDED.items()), F.lit(0.0)))
    own = own.withColumns({"lexical": R.capped_sum(counts), "semantic": R.semantic_score(F.col("s.whole"), facets, F.col("s.query")), "grounded": grounded, "chunk_mean": mean("combined"), "chunk_asked": mean("asked")})
    backed = F.when(F.col("content_source").isin("local_html", "local_text"), 10.0).otherwise(0.0)
    depth = sum((F.when(F.col(k) != "", p).otherwise(0.0) for k, p in v.EVIDENCE.items()), backed)
    source = F.least(F.lit(100.0), R.source_credibility(F.col("domain")) / 15.0 * 100.0)
    own = own.withColumns({
        "hybrid": R.hybrid_score(F.col("semantic"), F.col("lexical")), "rerank_embedding": R.rerank_embedding(F.col("s.query"), F.col("semantic"), F.col("chunk_asked")), "source": source, "depth": depth,
        "questions": R.question_coverage(c, v.QUESTIONS), "in_region": (F.col("n_region") > 0) | (F.size("counties") > 0),
    })
    dated = F.least(F.lit(100.0), F.col("depth") + F.when(F.col("published") != "", 5.0).otherwise(0.0))
    p = {"categories": F.col("cat.n"), "questions": F.col("questions"), "entities": F.col("grounded"), "chunk": F.col("chunk_mean"), "region": F.col("in_region"), "source": F.col("source"), "depth": dated, "late": F.lit(False), "metadata": T.safe_float(F.col("metadata"))}
    return own.withColumn("heuristic", R.heuristic_score(p | {k: F.col(f"n_{k}") for k in ("quality", "negative", "marketing", "news", "research")}))


def classified(scored_cards: DataFrame, v=vocab) -> DataFrame:
    """Scored cards with the rubric's class scores, topic and rerank."""
    c = F.col("card_text")
    share = lambda x, most: R.unit(x / most)
    hits = {k: T.keyword_count(c, words) for k, words in v.RUBRIC.items()}
    strengths = {
        "grounded": share(F.round("grounded", 2), 100.0), "semantic": share(F.col("semantic"), 100.0), "rerank": share(F.col("rerank_embedding"), 100.0), "hybrid": share(F.col("hybrid"), 100.0), "lexical": share(F.col("lexical"), 100.0), "question": share(F.col("questions"), 5.0),
        "region": F.col("in_region").cast("double"), "chunk": share(F.round("chunk_mean", 2), 100.0), "source": share(F.round("source", 2), 100.0), "policy": share(hits["policy"], 5.0), "logistics": share(hits["logistics"], 5.0), "relationship": share(hits["relationship"], 5.0),
        "recycling": share(hits["recycling"], 4.0), "research": share(F.col("n_research"), 4.0), "news": share(F.col("n_news"), 4.0), "marketing": share(F.col("n_marketing"), 4.0),
    }
    own = scored_cards.withColumns({f"x_{k}": s for k, s in strengths.items()})
    named = {k: F.col(f"x_{k}") for k in strengths}
    # The rerank takes the class scores before they are rounded.
    raw = {k: R.unit(R.weighted(named, R.RUBRIC_WEIGHTS[k])) for k in ("direct", "generic_news", "marketing_noise")}
    own = own.withColumn("rerank", R.rerank_score(F.col("heuristic"), F.col("hybrid"), F.col("rerank_embedding"), F.col("semantic"), raw["direct"], raw["generic_news"], raw["marketing_noise"]))
    return own.withColumn("r", R.rubric(named)).select(*scored_cards.columns, "rerank", "r.*")


def credible(cards_: DataFrame, v=vocab) -> DataFrame:
    """Classified cards with credibility, reason, blocked, low_trust and final_rank. Columns of a judge count if there
    are any: passed (bool), information, confidence, noise (numbers; null where not judged)."""
    has = lambda k, other: F.col(k) if k in cards_.columns else F.lit(other)
    judged = F.col("information").isNotNull() if "information" in cards_.columns else F.lit(False)
    llm = F.when(judged, T.clamp(8.0 * has("information", 0.0) + 12.0 * has("confidence", 0.0) - 4.0 * has("noise", 0.0))).otherwise(50.0)
    kind = T.keyword_count(F.concat_ws(" ", T.text(F.col("title")), F.left("relevant_chunks", F.lit(400)), T.url_file_type(F.col("url"))), v.QUALITY)
    typed = F.least(F.lit(100.0), 15.0 + 12.0 * kind + F.when(T.url_file_type(F.col("url")) == "PDF", 8.0).otherwise(0.0))
    flags = R.source_flags(F.col("domain"))
    own = cards_.withColumns({"blocked": flags["blocked"] == 1, "low_trust": flags["low_trust"] == 1})
    p = {
        "source": T.clamp(F.round("source", 2)), "evidence": F.least(F.lit(100.0), F.col("depth")), "entity": T.clamp(1.2 * F.col("lexical") + 0.3 * F.round("grounded", 2)), "type": typed, "dated": F.col("published") != "", "has_dates": F.size("dates") > 0, "llm": llm,
        "news": F.col("n_news"), "marketing": F.col("n_marketing"), "noise": F.col("marketing_noise"), "blocked": F.col("blocked"), "low_trust": F.col("low_trust"), "paged": F.col("evidence_pages_text") != "",
    }
    own = own.withColumn("c", R.credibility(p)).withColumns({"credibility": F.col("c.score"), "reason": F.col("c.reason")}).drop("c")
    passed = F.coalesce(has("passed", False), F.lit(False)).cast("double")
    return own.withColumn("final_rank", R.final_rank(F.col("rerank"), F.col("hybrid"), F.col("credibility"), passed, F.coalesce(has("information", 0.0), F.lit(0.0)).cast("double")))


def curated(cards_: DataFrame, judge: bool = False, hashing: bool = True, share: float = 0.5, limits: tuple[float, float, float] = (45.0, 60.0, 0.60), bar: float = 60.0) -> DataFrame:
    """limits: what heuristic, hybrid and direct scores a shortlist takes; bar: the credibility that a kept card has.

    Credible cards with shortlisted, decision, rule and moved (by the cap on one topic), in the final order. exact
    and near (bool: a copy of another) count if cards have them."""
    own = cards_.withColumn("shortlisted", R.shortlist(F.col("heuristic"), F.col("hybrid"), F.col("direct"), hashing, limits))
    for k in ("exact", "near", "passed"):
        own = own if k in own.columns else own.withColumn(k, F.lit(False))
    names = {k: F.col(k) for k in ("file", "blocked", "low_trust", "shortlisted", "passed", "adjacent", "direct", "hybrid", "heuristic", "credibility", "rerank", "exact", "near")}
    made = own.withColumn("_d", R.final_decision(names | {"news": F.col("generic_news"), "marketing": F.col("marketing_noise")}, judge, bar))
    made = shared_table(made.withColumns({"decision": F.col("_d.decision"), "rule": F.col("_d.rule")}).drop("_d"), "decided")
    return diversified(made, "topic", "decision", [F.desc("final_rank"), F.asc("id")], share).orderBy(*final_order("decision", "final_rank", "hybrid", "credibility"))


#: Topic -> category and sub-category of the registry.
CATEGORIES = {"who_where_scale": ("Supply Chain Evidence", "Facilities and Capacity"), "supplier_tiering": ("Supply Chain Evidence", "Supplier and Tiering"), "logistics_risk": ("Infrastructure and Risk", "Logistics and Risk"), "policy_localization": ("Policy and Localization", "Incentives and Localization"), "recycling_materials": ("Supply Chain Evidence", "Recycling and Materials")}
OTHER = ("Supply Chain Evidence", "General")


def category(topic: Column, place: int) -> Column:
    out = F.lit(OTHER[place])
    for k, v in CATEGORIES.items():
        out = F.when(topic == k, v[place]).otherwise(out)
    return out


def document_registry(decided: DataFrame) -> DataFrame:
    """One row a kept or reviewed card: id, name, type, category, sub_category, source, url, published, status, quality,
    factors, rationale."""
    shown = lambda name, c: F.when(c > 0, F.concat(F.lit(f"{name}="), F.round(c, 2).cast("string")))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}="), F.left(F.array_join(c, "; "), F.lit(120))))
    given = lambda name, c: F.when(T.text(c) != "", F.concat(F.lit(f"{name}="), c))
    factors = F.concat_ws("; ", given("source", F.col("domain")), given("subtopic", F.col("topic")), shown("hybrid", F.col("hybrid")), shown("credibility", F.col("credibility")), listed("companies", "companies"), listed("counties", "counties"), listed("oems", "oems"), listed("capacities", "capacities"))
    grades = lambda c, *steps: F.coalesce(*(F.when(c >= low, says) for low, says in steps))
    direct = F.round(100.0 * F.col("direct"), 1)
    rationale = F.concat_ws(
        ". ", F.concat(F.lit("Final decision="), F.col("decision")), grades(F.col("hybrid"), (65, "strong hybrid relevance"), (55, "moderate hybrid relevance")), grades(F.col("credibility"), (75, "high credibility"), (60, "acceptable credibility")),
        grades(direct, (70, "direct use-case fit"), (55, "borderline direct use-case fit")), F.when((F.size("companies") > 0) | (F.size("counties") > 0) | (F.size("oems") > 0), "grounded regional entities present"),
    )
    kept = decided.where(F.col("decision").isin("keep", "review"))
    return kept.select("id", T.safe_filename(F.col("title")).alias("name"), T.url_file_type(F.col("url")).alias("type"), category(F.col("topic"), 0).alias("category"), category(F.col("topic"), 1).alias("sub_category"), F.when(F.col("domain") == "", "Unknown").otherwise(F.col("domain")).alias("source"), "url", "published", F.concat(F.lit("Curated-"), F.initcap("decision")).alias("status"), F.round("final_rank", 2).alias("quality"), F.left(factors, F.lit(900)).alias("factors"), F.left(rationale, F.lit(700)).alias("rationale"))


def chunk_registry(decided: DataFrame) -> DataFrame:
    """One row a passage of each card: chunk_id, id, category, facet, label, chars, tokens, status, quality, text."""
    each = decided.select("id", "topic", "decision", F.explode("chunks").alias("c"))
    number = F.lpad(F.col("c.rank").cast("string"), 2, "0")
    return each.select(F.concat(F.col("id").cast("string"), F.lit("_CHUNK_"), number).alias("chunk_id"), "id", category(F.col("topic"), 0).alias("category"), F.coalesce(F.nullif(F.col("c.facet"), F.lit("")), F.col("topic")).alias("facet"), F.coalesce(F.nullif(F.col("c.label"), F.lit("")), F.lit("evidence")).alias("label"), F.length("c.text").cast("long").alias("chars"), F.greatest(F.lit(1), T.word_count(F.col("c.text"))).cast("long").alias("tokens"), F.initcap("decision").alias("status"), F.round("c.combined", 2).alias("quality"), F.col("c.text").alias("text"))


#: Stages of the processing log: column -> id and name.
STAGES = {"acquisition_status": ("STAGE2", "Acquisition"), "card_status": ("STAGE3", "Lightweight Card"), "enrichment_status": ("STAGE6", "Enrichment"), "judge_status": ("STAGE7", "LLM Judge"), "decision": ("FINAL", "Final Decision")}


def processing_log(rows: DataFrame, stages: dict[str, tuple[str, str]] = STAGES) -> DataFrame:
    """(log_id, id, stage_id, stage, status, error): one row for each status of a row that isn't blank."""
    long = rows.select(F.col("id").cast("string").alias("id"), *(T.text(F.col(c)).alias(c) for c in stages)).unpivot(["id"], list(stages), "field", "status").where("status <> ''")
    pick = lambda i: F.coalesce(*(F.when(F.col("field") == c, v[i]) for c, v in stages.items()))
    return long.select(F.concat_ws("_", "id", pick(0)).alias("log_id"), "id", pick(0).alias("stage_id"), pick(1).alias("stage"), "status", F.when(F.contains(F.lower("status"), F.lit("failed")), F.col("status")).otherwise("").alias("error"))


def wide_report(long: DataFrame, key: str, run: str, metric: str, value: str, runs: list[str], metrics: list[str]) -> DataFrame:
    """One row a key with a column for each run and metric, in the order given; of several values the least."""
    return long.groupBy(key).agg(*(F.min(F.when((F.col(run) == r) & (F.col(metric) == m), F.col(value))).alias(f"{r}_{m}") for r in runs for m in metrics))
