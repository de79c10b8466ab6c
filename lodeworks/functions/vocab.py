"""Keyword vocabularies: fixed values that scores and gates depend on, in one place. All are parameters elsewhere."""

# Signal categories and their keywords (matched as substrings of lower-cased text).
SIGNALS: dict[str, list[str]] = {
    "network_structure": ["tier 1", "tier 2", "tiering", "supplier", "customer", "supply chain map", "ecosystem map", "value chain", "network", "oem"],
    "node_attributes": ["facility", "plant", "location", "capacity", "gwh", "mwh", "tons per year", "ownership", "commissioning", "timeline", "expansion", "site"],
    "edge_attributes": ["material flow", "logistics", "route", "lead time", "import", "export", "shipping", "freight", "port", "rail", "hazmat"],
    "risk_variables": ["risk", "bottleneck", "concentration", "single source", "trade exposure", "regulatory", "permitting", "disruption", "dependency", "shortage"],
    "optimization_levers": ["localization", "gap analysis", "incentive", "tax credit", "workforce", "site readiness", "site selection", "grant", "capex", "investment"],
    "scenario_modeling": ["scenario", "what-if", "stress test", "simulation", "resilience score", "digital twin", "control tower", "sensitivity analysis"],
}
# Keyword groups, each of which stands for one question that a document may answer.
QUESTIONS: list[list[str]] = [
    ["who", "supplier", "manufacturer", "company", "producer"],
    ["what", "product", "material", "cell", "module", "pack", "cam", "anode"],
    ["where", "georgia", "southeast", "plant", "facility", "location"],
    ["scale", "capacity", "gwh", "mwh", "tons", "mtpa"],
    ["relationship", "customer", "offtake", "agreement", "tier", "flow"],
    ["constraints", "risk", "permitting", "trade", "lead time", "bottleneck"],
    ["localization", "incentive", "workforce", "site readiness", "control tower"],
]
# Single lists.
VALUE_CHAIN = ["minerals", "mining", "refining", "cathode", "cam", "anode", "separator", "electrolyte", "cell", "module", "pack", "oem", "recycling", "black mass", "hydrometallurgy"]
REGION = ["georgia", "southeast", "battery belt", "atlanta", "savannah", "brunswick", "tennessee", "alabama", "south carolina", "north carolina", "kentucky", "mississippi"]
NODES = ["georgia", "southeast", "battery belt", "atlanta", "savannah", "brunswick", "chatham county", "bartow county", "coweta county", "jackson county", "west point", "commerce ga"]
POLICY = ["ira", "inflation reduction act", "doe", "state incentive", "tax credit", "permitting", "workforce", "savannah port", "brunswick port", "rail", "hazmat"]
NEGATIVE = ["buy now", "shop now", "affiliate", "sponsored", "press release wire", "click here", "lifestyle", "celebrity", "top 10", "best ev", "review", "coupon", "deal", "sponsored content", "native advertising", "news roundup", "price prediction", "crypto", "betting", "giveaway", "chemistry only"]
NATIONAL = ["united states", "u.s.", "us ", "north america", "global", "international", "worldwide"]
QUALITY = ["report", "white paper", "roadmap", "policy brief", "analysis", "study", "annual report", "investor presentation", "10-k", "8-k", "fact sheet", "directory", "dataset", "filing"]
PDF_HINTS = ["report", "white paper", "brief", "fact sheet", "study", "roadmap", "slides", "presentation", "publication", "year-end", "outlook"]
DOCUMENT_HINTS = [*QUALITY, "supplier", "tier", "facility", "plant", "county", "georgia", "capacity", "gwh", "tons", "offtake", "localization", "webinar", "presentation", "fact sheet", "case study"]
RESEARCH = ["abstract", "literature review", "electrochemical", "coulombic efficiency", "cycle life", "half-cell", "coin cell", "electrode slurry", "xrd", "sem analysis", "lab-scale", "novel chemistry", "peer reviewed"]
NEWS = ["announced today", "according to", "reported", "news release", "press release", "breaking", "monday", "tuesday", "wednesday", "thursday", "friday", "weekend", "shares rose"]
MARKETING = ["request a quote", "contact us", "learn more", "book a demo", "schedule a demo", "world-class", "best-in-class", "leading provider", "we offer", "our solutions", "our products", "trusted partner", "industry-leading"]
QUERY_HINTS = ["supplier tier network", "facility capacity timeline", "Georgia Southeast", "risk resilience localization"]
# Relationship, logistics, policy and recycling terms of the rubric.
RUBRIC = {
    "policy": [*POLICY, "localization", "site readiness", "workforce", "grant"],
    "logistics": ["logistics", "port", "rail", "freight", "savannah", "brunswick", "hazmat", "corridor", "highway"],
    "relationship": ["supplier", "tier 1", "tier 2", "tier 3", "customer", "offtake", "joint venture", "partner"],
    "recycling": ["recycling", "black mass", "hydrometallurgy", "recovered material", "scrap"],
}
# Relationship, logistics and policy terms of the lexical-entity score.
LEXICAL = {
    "relationship": ["supplier", "tier 1", "tier 2", "tier 3", "customer", "offtake", "joint venture"],
    "logistics": ["logistics", "port", "savannah", "brunswick", "rail", "hazmat", "freight", "intermodal"],
    "policy": [*POLICY, "localization", "site readiness", "workforce", "grant", "incentive"],
}
# HTML elements that are no content, words of a class or id that tell boilerplate and content, and the
# meta tags that hold a publication date, in order.
NO_CONTENT = ["script", "style", "noscript", "nav", "footer", "header", "aside", "form"]
BOILERPLATE = ["nav", "menu", "footer", "header", "aside", "sidebar", "breadcrumb", "social", "share", "cookie", "banner", "subscribe", "newsletter", "pager"]
CONTENT = ["article", "content", "main", "story", "post", "entry", "body", "report", "copy", "text", "rich-text", "rich_text", "rich text", "richtext"]
META_DATES = [("property", "article:published_time"), ("property", "article:modified_time"), ("name", "pubdate"), ("name", "publish-date"), ("name", "date"), ("name", "article:published_time"), ("itemprop", "datePublished")]
# What the score of an HTML block adds for a paragraph, a heading, a mark of punctuation (at most so much in
# all), takes off for a list item and for its share of link text, and adds for a main element and a telling class.
BLOCK = {"paragraph": 120.0, "heading": 60.0, "mark": 4.0, "marks": 200.0, "item": -8.0, "links": -1500.0, "main": 400.0, "hint": 250.0}
BLOCK_LEAST = 250
# Regular expressions over lower-cased text, one specificity signal each.
SPECIFICS = [
    r"\b\d+(?:\.\d+)?\s?(gwh|mwh|kwh|mtpa|tons|tonnes|million|billion|%)\b",
    r"\b20\d{2}\b",
    r"\b(inc|llc|corp|corporation|co\.|ltd|plc|ag)\b",
    r"\b(offtake|joint venture|jv|supplier agreement|customer agreement)\b",
    r"\b(plant|facility|site|county|port|rail)\b",
]
# Query parameters that say where a click came from.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "mkt_tok", "ref", "spm", "trk", "utm_campaign", "utm_content", "utm_id", "utm_medium", "utm_source", "utm_term"]
# Domains by trust.
BLOCKED = ["ainvest.com"]
LOW_TRUST = ["ainvest.com", "benzinga.com", "investing.com", "investorplace.com", "marketbeat.com", "marketscreener.com", "fool.com", "247wallst.com", "seekingalpha.com", "stocktwits.com", "tipranks.com", "thestreet.com", "zacks.com"]
# Words that similarity ignores.
STOPWORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "to", "with"]
# File extensions of documents.
EXTENSIONS = [".pdf", ".html", ".htm", ".txt", ".md"]
# Months as dates spell them.
MONTHS = "Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|Sept|September|Oct|October|Nov|November|Dec|December"
DATES = [rf"\b(?:{MONTHS})\s+\d{{1,2}},\s+20\d{{2}}\b", r"\b20\d{2}-\d{2}-\d{2}\b", r"\b\d{1,2}/\d{1,2}/20\d{2}\b", r"\b20\d{2}\b"]
CAPACITIES = r"\b\d+(?:\.\d+)?\s?(?:gwh|mwh|kwh|mtpa|tons per year|tons|tonnes|million|billion|%)\b"
FACILITIES = r"\b([A-Z][A-Za-z0-9&,\- ]{2,80}?\s(?:plant|facility|site|factory|campus|metaplant|hub|center|centre|port|terminal))\b"
# A card's characters of a first page and of two, summary lengths, and kinds of names with their caps.
FIRST_PAGE, TWO_PAGES = 2500, 5000
NAME_CAPS = {"company": 20, "county": 15, "oem": 15, "port": 10}
VALUE_CHAIN_CAP = 20
# Points of what a card's evidence consists of.
EVIDENCE = {"metadata_summary": 5.0, "first_page_summary": 18.0, "two_page_summary": 15.0, "sampled_summary": 15.0, "headings_text": 10.0, "relevant_chunks": 20.0, "evidence_pages_text": 15.0}
# Weights of the grounded-entity score; dates count up to four.
GROUNDED = {"companies": 18.0, "counties": 12.0, "oems": 14.0, "facilities": 10.0, "capacities": 18.0, "dates": 5.0}
# The words of a question that route it.
ROUTES = {
    "web_needed": ["international import", "international imports", "imports", "growing fastest", "growing", "demand", "regionally", "workforce capacity", "shifting from ice", "ice components"],
    "analytic": ["highest", "lowest", "versus", " vs ", "compare", "comparison", "concentration", "risk", "bottleneck", "dependencies", "cluster", "clusters", "outside of major metros", "combine", "counties"],
}
INTENTS = {
    "definition": ["define", "definition", "meaning", "methodology"],
    "comparison": ["compare", "difference", "versus", "vs"],
    "aggregation": ["count", "how many", "list", "show all", "group"],
}
ANALYTIC = ["count", "how many", "total", "average", "median", "highest", "lowest", "top", "bottom", "range", "represented", "missing", "compute", "calculate", "compare", "summarize"]
ABSTENTION = "Not found in provided context."
