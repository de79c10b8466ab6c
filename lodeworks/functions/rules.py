"""Predicates, gates and linear scores as column expressions. Vocabularies and weights are parameters."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import clamp, domain, filename_words, keyword_count, let, specificity, squeeze, text, tokens


def category_hits(c: Column, categories: dict[str, list[str]] = vocab.SIGNALS) -> Column:
    """Struct of n (categories with a hit), hits (keywords found) and names (of those categories)."""

    def count(low: Column) -> Column:
        each = F.array(*(F.struct(F.lit(k).alias("name"), F.size(F.filter(F.array(*map(F.lit, v)), lambda w: F.contains(low, w))).alias("n")) for k, v in categories.items()))
        return let(each, lambda e: F.struct(F.size(F.filter(e, lambda x: x["n"] > 0)).alias("n"), F.aggregate(e, F.lit(0), lambda s, x: s + x["n"]).alias("hits"), F.array_join(F.transform(F.filter(e, lambda x: x["n"] > 0), lambda x: x["name"]), ", ").alias("names")))

    return let(F.lower(text(c)), count)


def question_coverage(c: Column, groups: list[list[str]] = vocab.QUESTIONS) -> Column:
    return sum(((keyword_count(c, g) > 0).cast("int") for g in groups), F.lit(0))


def _within(d: Column, domains: list[str]) -> Column:
    return d.isin(*domains) | F.exists(F.array(*(F.lit("." + x) for x in domains)), lambda x: F.endswith(d, x))


def source_credibility(d: Column) -> Column:
    """Credibility of a domain; rules in order."""
    low = F.lower(text(d))
    part = lambda *xs: keyword_count(low, list(xs)) > 0
    return (
        F.when(low == "", 3.0).when(_within(low, vocab.BLOCKED), 0.5).when(_within(low, vocab.LOW_TRUST), 1.5)
        .when(F.endswith(low, F.lit(".gov")), 15.0).when(F.endswith(low, F.lit(".edu")), 13.0).when(F.endswith(low, F.lit(".org")), 10.0)
        .when(part("sec.gov", "doe.gov", "energy.gov", "nist.gov", "epa.gov"), 15.0).when(part("reuters", "bloomberg", "wsj", "ft.com"), 8.0)
        .when(part("linkedin", "facebook", "instagram", "x.com", "twitter"), 2.0).otherwise(6.0)
    )


def source_flags(d: Column) -> Column:
    low = F.lower(text(d))
    return F.struct(_within(low, vocab.BLOCKED).cast("int").alias("blocked"), _within(low, vocab.LOW_TRUST).cast("int").alias("low_trust"))


def probable_pdf(url: Column, file_type: Column, extension: Column, filename: Column, *texts: Column) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(text(url), F.lit("PATH")), F.lit("")))
    named = F.endswith(path, F.lit(".pdf")) | (F.lower(text(file_type)) == "pdf") | (F.lower(text(extension)) == ".pdf") | F.endswith(F.lower(text(filename)), F.lit(".pdf"))
    return named | (keyword_count(F.concat_ws(" ", *map(text, texts), filename_words(filename)), vocab.PDF_HINTS) > 0)


def probable_document(url: Column, file_type: Column, extension: Column, filename: Column, *texts: Column) -> Column:
    ends = lambda c: F.exists(F.array(*map(F.lit, vocab.EXTENSIONS)), lambda e: F.endswith(c, e))
    path = F.lower(F.coalesce(F.try_parse_url(text(url), F.lit("PATH")), F.lit("")))
    named = F.lower(text(extension)).isin(*vocab.EXTENSIONS) | F.lower(text(file_type)).isin("pdf", "html", "htm", "txt") | ends(F.lower(text(filename))) | ends(path)
    return named | (keyword_count(F.concat_ws(" ", *map(text, texts), filename_words(filename)), vocab.DOCUMENT_HINTS) > 0)


def rule_gate(categories: Column, questions: Column, specifics: Column) -> Column:
    return (categories >= 2) | ((questions >= 1) & (specifics >= 1))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of two texts' token counts, within a row; 0 without tokens."""

    def cosine(t: Column) -> Column:
        count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x)).cast("double")
        norm = lambda xs: F.sqrt(F.aggregate(F.array_distinct(xs), F.lit(0.0), lambda s, x: s + count(xs, x) * count(xs, x)))
        dot = F.aggregate(F.array_intersect(t["a"], t["b"]), F.lit(0.0), lambda s, x: s + count(t["a"], x) * count(t["b"], x))
        return F.when((F.size(t["a"]) == 0) | (F.size(t["b"]) == 0), 0.0).otherwise(clamp(dot / (norm(t["a"]) * norm(t["b"])), 0.0, 1.0))

    return let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), cosine)


def _share(n: Column, most: float) -> Column:
    return F.least(F.lit(100.0), n / most * 100.0)


def metadata_score(whole: Column, url_domain: Column, engine: Column, lexical: Column, v=vocab) -> Column:
    """Struct of the metadata score and what it is made of. lexical: similarity to the goal text, 0 to 100."""
    cat, value, region, nodes = category_hits(whole, v.SIGNALS), keyword_count(whole, v.VALUE_CHAIN), keyword_count(whole, v.REGION), keyword_count(whole, v.NODES)
    policy, quality, negative, national = keyword_count(whole, v.POLICY), keyword_count(whole, v.QUALITY), keyword_count(whole, v.NEGATIVE), keyword_count(whole, v.NATIONAL)
    parts = F.struct(
        cat.alias("cat"), value.alias("value_chain"), region.alias("region"), nodes.alias("nodes"), policy.alias("policy"), quality.alias("quality"), negative.alias("negative"), national.alias("national"),
        question_coverage(whole, v.QUESTIONS).alias("questions"), specificity(whole, v.SPECIFICS).alias("specifics"), source_credibility(url_domain).alias("credibility"), lexical.alias("lexical"), clamp(F.coalesce(engine, F.lit(0.0)) * 100.0).alias("engine"),
    )

    def score(p: Column) -> Column:
        two, exact = p["cat"]["n"] >= 2, (p["questions"] >= 1) & (p["specifics"] >= 1)
        penalty = F.least(F.lit(24.0), p["negative"] * 4.0) + F.when((p["national"] > 0) & (p["nodes"] == 0) & (p["region"] == 0), 8.0).otherwise(0.0)
        total = (
            0.12 * p["engine"] + 0.24 * _share(p["cat"]["n"], 6.0) + 0.12 * _share(p["value_chain"], 8.0) + F.when(p["region"] > 0, 12.0).otherwise(0.0)
            + 0.08 * _share(p["nodes"], 6.0) + 0.08 * _share(p["policy"], 5.0) + 0.08 * _share(p["questions"], 7.0) + 0.06 * _share(p["specifics"], 5.0) + 0.06 * _share(p["quality"], 6.0)
            + 0.10 * p["lexical"] + p["credibility"] + F.when(two, 5.0).otherwise(0.0) + F.when(exact, 3.0).otherwise(0.0) - penalty
        )
        return F.struct(F.round(clamp(total), 2).alias("score"), p.alias("parts"), two.cast("int").alias("two_signal"), exact.cast("int").alias("question_specifics"), F.round(penalty, 2).alias("penalty"))

    return let(parts, score)


def first_page_score(page: Column, summary: Column, goal_full: Column, goal_summary: Column, metadata: Column, v=vocab) -> Column:
    """Score of a first page. goal_full, goal_summary: similarity of both texts together, and of the summary, to the
    goal text, 0 to 100."""
    both = squeeze(F.concat_ws(" ", text(summary), text(page)))
    entities = F.size(F.regexp_extract_all(F.lower(both), F.lit(r"\b\d+(?:\.\d+)?\s?(gwh|mwh|kwh|mtpa|tons|million|billion|%)?\b"), F.lit(0)))
    parts = F.struct(category_hits(both, v.SIGNALS)["n"].alias("cat"), question_coverage(both, v.QUESTIONS).alias("questions"), entities.alias("entities"), F.length(squeeze(page)).alias("size"))

    def score(p: Column) -> Column:
        length = F.when(p["size"] >= 350, 4.0).when(p["size"] >= 180, 1.0).when(p["size"] < 90, -6.0).otherwise(-2.0)
        total = (
            0.26 * (0.7 * goal_full + 0.3 * goal_summary) + 0.22 * _share(p["cat"], 6.0) + 0.12 * _share(keyword_count(both, v.VALUE_CHAIN), 8.0) + F.when(keyword_count(both, v.REGION) > 0, 8.0).otherwise(0.0)
            + 0.08 * _share(keyword_count(both, v.NODES), 6.0) + 0.08 * _share(keyword_count(both, v.POLICY), 5.0) + 0.08 * _share(p["questions"], 7.0) + 0.08 * _share(specificity(both, v.SPECIFICS), 5.0)
            + 0.06 * _share(keyword_count(both, v.QUALITY), 6.0) + 0.06 * F.least(F.lit(100.0), p["entities"] * 12.5) + 0.04 * metadata
            + F.when(p["cat"] >= 2, 5.0).otherwise(0.0) + F.when((p["questions"] >= 1) & (p["entities"] >= 1), 3.0).otherwise(0.0) + length - F.least(F.lit(12.0), keyword_count(both, v.NEGATIVE) * 4.0)
        )
        return F.round(clamp(total), 2)

    return let(parts, score)


#: Weight and cap of each count in the lexical-entity score.
ENTITY_WEIGHTS = {"companies": (6.0, 18.0), "counties": (6.0, 12.0), "oems": (5.0, 10.0), "ports": (4.0, 8.0), "facilities": (4.0, 12.0), "capacities": (8.0, 16.0), "dates": (2.0, 8.0), "value_chain": (2.0, 8.0), "relationship": (2.0, 4.0), "logistics": (2.0, 4.0), "policy": (2.0, 4.0)}


def capped_sum(counts: dict[str, Column], weights: dict[str, tuple[float, float]] = ENTITY_WEIGHTS) -> Column:
    """Sum of counts, each with its weight and cap, from 0 to 100."""
    return F.round(clamp(sum((F.least(F.lit(cap), w * counts[k]) for k, (w, cap) in weights.items() if k in counts), F.lit(0.0))), 2)


def semantic_score(overall: Column, facets: list[Column], query: Column) -> Column:
    best = F.slice(F.sort_array(F.array(*facets), False), 1, 2)
    top2 = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    coverage = 100.0 * sum(((f >= 55.0).cast("double") for f in facets), F.lit(0.0)) / max(1, len(facets))
    return F.round(0.30 * overall + 0.25 * top2 + 0.20 * coverage + 0.25 * query, 2)


def hybrid_score(semantic: Column, lexical: Column) -> Column:
    return F.round(0.55 * semantic + 0.45 * lexical, 2)


def rerank_embedding(query: Column, semantic: Column, chunk_query: Column) -> Column:
    return F.round(0.45 * query + 0.35 * semantic + 0.20 * chunk_query, 2)


def chunk_score(overall: Column, facets: list[Column], query: Column) -> Column:
    best = F.slice(F.sort_array(F.array(*facets), False), 1, 2)
    return F.round(0.30 * overall + 0.30 * F.greatest(*facets, F.lit(0.0)) + 0.25 * query + 0.15 * F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best), 2)


def heuristic_score(p: dict[str, Column]) -> Column:
    """p: categories, questions, entities (0-100), chunk, region (bool), source (0-100), depth, late (bool), metadata,
    quality, negative, marketing, news, research (counts)."""
    penalty = F.least(F.lit(45.0), p["negative"] * 5.0 + p["marketing"] * 6.0 + p["news"] * 4.0 + F.when((p["research"] > 0) & (p["entities"] < 25), 6.0).otherwise(0.0))
    flag = lambda c: F.when(c, 100.0).otherwise(0.0)
    total = (
        0.20 * _share(p["categories"], 4.0) + 0.18 * _share(p["questions"], 5.0) + 0.22 * p["entities"] + 0.14 * p["chunk"] + 0.10 * flag(p["region"]) + 0.07 * p["source"]
        + 0.03 * p["depth"] + 0.02 * flag(p["late"]) + 0.04 * p["metadata"] + 0.04 * _share(p["quality"], 5.0) - penalty
    )
    return F.round(clamp(total), 2)


def unit(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


#: Weights of the rubric's class scores over strengths from 0 to 1.
RUBRIC_WEIGHTS: dict[str, dict[str, float]] = {
    "direct": {"grounded": 0.24, "hybrid": 0.18, "semantic": 0.08, "rerank": 0.08, "lexical": 0.08, "question": 0.15, "relationship": 0.10, "logistics": 0.10, "policy": 0.10, "region": 0.10, "news": -0.12, "marketing": -0.15, "research": -0.08},
    "adjacent": {"policy": 0.28, "logistics": 0.24, "semantic": 0.14, "hybrid": 0.10, "rerank": 0.08, "question": 0.12, "chunk": 0.08, "region": 0.06, "marketing": -0.10},
    "research_only": {"research": 0.58, "not_grounded": 0.18, "not_relationship": 0.12, "not_region": 0.12},
    "generic_news": {"news": 0.55, "not_grounded": 0.15, "not_question": 0.15, "not_chunk": 0.15},
    "marketing_noise": {"marketing": 0.62, "not_grounded": 0.20, "not_source": 0.18},
}
#: Weights of the subtopics; the first of the best wins.
TOPIC_WEIGHTS: dict[str, dict[str, float]] = {
    "recycling_materials": {"recycling": 1.0, "semantic": 0.20},
    "policy_localization": {"policy": 1.0, "region": 0.15, "hybrid": 0.10},
    "logistics_risk": {"logistics": 1.0, "semantic": 0.20},
    "supplier_tiering": {"relationship": 1.0, "grounded": 0.20, "hybrid": 0.10},
    "who_where_scale": {"grounded": 0.35, "lexical": 0.25, "question": 0.20, "semantic": 0.20},
}


def weighted(strengths: dict[str, Column], weights: dict[str, float]) -> Column:
    """Weighted sum; a name that begins with not_ stands for one less the strength."""
    of = lambda k: 1.0 - strengths[k[4:]] if k.startswith("not_") else strengths[k]
    return sum((w * of(k) for k, w in weights.items()), F.lit(0.0))


def rubric(strengths: dict[str, Column]) -> Column:
    """Struct of the five class scores and the main subtopic."""
    classes = [F.round(unit(weighted(strengths, w)), 4).alias(k) for k, w in RUBRIC_WEIGHTS.items()]
    topics = F.array(*(F.struct(weighted(strengths, w).alias("v"), F.lit(-i).alias("i"), F.lit(k).alias("k")) for i, (k, w) in enumerate(TOPIC_WEIGHTS.items())))
    return F.struct(*classes, F.array_max(topics)["k"].alias("topic"))


def rerank_score(heuristic: Column, hybrid: Column, rerank: Column, semantic: Column, direct: Column, news: Column, marketing: Column) -> Column:
    return F.round(0.28 * heuristic + 0.28 * hybrid + 0.16 * rerank + 0.06 * semantic + 20.0 * direct - 10.0 * news - 10.0 * marketing, 2)


def credibility(p: dict[str, Column]) -> Column:
    """Struct of score and reason. p: source, evidence, entity, type (0-100), dated, has_dates (bool), llm (0-100),
    news, marketing (counts), noise (0-1), blocked, low_trust, paged (bool)."""
    penalty = F.least(F.lit(60.0), 6.0 * p["news"] + 8.0 * p["marketing"] + 3.0 * p["noise"]) + F.when(p["blocked"], 35.0).when(p["low_trust"], 18.0).otherwise(0.0)
    date = F.when(p["dated"], 100.0).when(p["has_dates"], 60.0).otherwise(25.0)
    score = F.round(clamp(0.18 * p["source"] + 0.28 * p["evidence"] + 0.24 * p["entity"] + 0.10 * date + 0.08 * p["type"] + 0.12 * p["llm"] - penalty), 2)
    reasons = F.concat_ws(
        "; ",
        F.when(p["source"] >= 80, "credible source domain").when(p["source"] <= 35, "low-authority source domain"),
        F.when(p["blocked"], "blocklisted finance/news aggregator domain").when(p["low_trust"], "low-trust finance/news aggregator domain"),
        F.when(p["evidence"] >= 70, "strong evidence depth").when(p["evidence"] <= 40, "thin evidence depth"),
        F.when(p["entity"] >= 65, "specific grounded entities"),
        F.when(p["paged"], "page-linked evidence"),
    )
    return F.struct(score.alias("score"), F.left(F.when(reasons == "", "mixed credibility signals").otherwise(reasons), F.lit(250)).alias("reason"))


def final_rank(rerank: Column, hybrid: Column, cred: Column, passed: Column, quality: Column) -> Column:
    return F.round(0.40 * rerank + 0.25 * hybrid + 0.25 * cred + 5.0 * passed + 0.5 * F.coalesce(quality, F.lit(0.0)), 2)


def judged(relevance: Column, match: Column, quality: Column, noise: Column) -> Column:
    """A judge's scores as keep, review or discard."""
    r, m, q, n = (clamp(c, 0.0, 10.0) for c in (relevance, match, quality, noise))
    return F.when((r >= 8) & (m >= 8) & (q >= 7) & (n <= 3), "keep").when((r >= 7) & (m >= 6) & (q >= 6) & (n <= 5), "review").otherwise("discard")


def shortlist(heuristic: Column, hybrid: Column, direct: Column, hashing: bool, limits=(45.0, 60.0, 0.60)) -> Column:
    """Preliminary shortlist; the hashing similarity relaxes the last two limits."""
    low, mid, high = limits[0], min(limits[1], 50.0) if hashing else limits[1], min(limits[2], 0.55) if hashing else limits[2]
    return (heuristic >= low) & (hybrid >= mid) & (direct >= high)


def final_decision(p: dict[str, Column], judge: bool, bar: float = 60.0) -> Column:
    """Struct of decision and rule (its number). p: file, blocked, low_trust, shortlisted, passed (bool), adjacent,
    direct, hybrid, heuristic, credibility, news, marketing, rerank, exact, near (duplicates of another: bool)."""
    short, cred = p["shortlisted"], p["credibility"]
    rules = [
        (p["exact"], "discard"), (p["near"], "discard"), (~p["file"], "discard"), (p["blocked"], "discard"),
        (p["low_trust"] & ((p["news"] >= 0.20) | (p["marketing"] >= 0.20) | (cred < 75)), "discard"),
        (short & F.lit(judge) & p["passed"] & (cred >= bar), "keep"), (short & F.lit(not judge) & (cred >= bar), "review"),
        (short & F.lit(judge) & p["passed"] & (cred < bar), "review"), (short & F.lit(judge) & ~p["passed"], "review"),
        ((cred >= 55) & (p["heuristic"] >= 48) & (p["rerank"] >= 58) & ((p["direct"] >= 0.45) | (p["adjacent"] >= 0.55)), "review"),
        ((p["adjacent"] >= 0.60) & (p["hybrid"] >= 55) & (cred >= 50) & (p["news"] <= 0.45) & (p["marketing"] <= 0.45), "review"),
        ((p["direct"] >= 0.55) & (p["heuristic"] >= 38) & (p["hybrid"] >= 55), "review"),
    ]
    out = F.struct(F.lit("discard").alias("decision"), F.lit(len(rules) + 1).alias("rule"))
    for i, (when, what) in reversed(list(enumerate(rules, 1))):
        out = F.when(when, F.struct(F.lit(what).alias("decision"), F.lit(i).alias("rule"))).otherwise(out)
    return out


def promotable(p: dict[str, Column], cred: float = 60.0, heuristic: float = 45.0, hybrid: float = 60.0, direct: float = 0.60) -> Column:
    """Whether a discarded document may be promoted to review."""
    gates = p["filtered"] & p["file"] & p["exact_master"] & p["near_master"] & ~p["blocked"] & ~(p["low_trust"] & (p["credibility"] < 75))
    floors = (p["credibility"] >= max(45.0, cred - 10)) & (p["heuristic"] >= max(40.0, heuristic - 5)) & (p["rerank"] >= 55)
    ways = (p["direct"] >= max(0.45, direct - 0.15)) | ((p["adjacent"] >= 0.60) & (p["hybrid"] >= max(45.0, hybrid - 15))) | ((p["hybrid"] >= max(50.0, hybrid - 15)) & (p["rerank_embedding"] >= 45))
    return (p["decision"] == "discard") & gates & floors & ways


def rejection_reason(document: Column, metadata: Column, rule: Column, file: Column) -> Column:
    return F.when(~document, "not a document").when(~metadata, "metadata score too low").when(~rule, "rule gate").when(~file, "no source file").otherwise("stage filter")


def route(question: Column) -> Column:
    q = F.lower(squeeze(question))
    return F.when(keyword_count(q, vocab.ROUTES["web_needed"]) > 0, "web_needed").when(keyword_count(q, vocab.ROUTES["analytic"]) > 0, "analytic").otherwise("lookup")


def intent(normal_question: Column) -> Column:
    out = F.lit("fact")
    for name, terms in reversed(vocab.INTENTS.items()):
        out = F.when(keyword_count(normal_question, terms) > 0, name).otherwise(out)
    return out


def employment_limit(question: Column) -> Column:
    """Struct of operator and value of a limit on employment; null without one."""
    q = text(question)
    op = F.nullif(F.regexp_extract(q, r"(?i)employment\s*(>=|<=|>|<)\s*([\d,]+)", 1), F.lit(""))
    value = F.regexp_extract(q, r"(?i)employment\s*(?:>=|<=|>|<|\s+at\s+least)\s*([\d,]+)", 1)
    least = F.regexp_extract(q, r"(?i)employment\s+at\s+least\s+([\d,]+)", 1)
    n = lambda c: F.regexp_replace(c, ",", "").try_cast("bigint")
    return F.when(op.isNotNull(), F.struct(op.alias("op"), n(value).alias("value"))).when(least != "", F.struct(F.lit(">=").alias("op"), n(least).alias("value")))


def isolation(mode: Column, has_local: Column, has_web: Column, has_context: Column) -> Column:
    """What a run's mode forbids and a row has, or demands and lacks."""
    none, local, hybrid = mode == "no_rag", mode == "local_rag", mode == "hybrid_rag"
    return F.array_compact(F.array(
        F.when(none & has_local, "unexpected_local"), F.when((none | local) & has_web, "unexpected_web"), F.when(none & has_context, "unexpected_context"),
        F.when((local | hybrid) & ~has_local, "missing_local"), F.when(hybrid & ~has_web, "missing_web"),
    ))
