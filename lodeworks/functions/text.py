"""Text as column expressions. Each takes and gives columns; null is taken for the empty string unless said."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from . import vocab

CITATION = r"(?i)\[(DOC|WEB|ANALYTIC|GEO):([^\]]+)\]"
BULLET = r"^\s*(?:[-*•]|\d+[.)])\s+"
NUMBER = r"-?\d[\d,]*(?:\.\d+)?%?"


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once a row."""
    return F.transform(F.array(value), use)[0]


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def squeeze(c: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def cell(c: Column) -> Column:
    """A number's text without a needless fraction; not-a-number is empty."""
    whole = c.cast("double")
    return F.when(c.isNull() | F.isnan(whole), "").when(whole == F.floor(whole), F.format_string("%d", whole.cast("bigint"))).otherwise(c.cast("string"))


def match_key(c: Column) -> Column:
    """Lower case; whatever is no ASCII letter or digit is one space."""
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def nth_word(c: Column, n: int) -> Column:
    """The n-th word, from 1, of a text's `match_key`; empty if it has fewer. Only so much of the text is looked at."""
    return F.regexp_extract(F.lower(text(c)), "^[^a-z0-9]*+(?:[a-z0-9]++[^a-z0-9]++){" + str(n - 1) + "}([a-z0-9]++)", 1)


def category_key(c: Column) -> Column:
    return F.lower(squeeze(c))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit(r"[a-z0-9][a-z0-9\-\+\.]*"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]+"), F.lit(0)))


def term_counts(c: Column) -> Column:
    """Map from token to its count: runs of the sorted tokens, each begun at the first of its kind."""
    runs = lambda t: F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | (F.get(t, i - 1) != F.get(t, i - 2)))

    def count(t: Column) -> Column:
        whole = lambda at: F.zip_with(at, F.slice(F.concat(at, F.array(F.size(t) + 1)), 2, F.size(at)), lambda i, j: j - i)
        return F.when(F.size(t) == 0, F.create_map().cast("map<string,int>")).otherwise(let(runs(t), lambda at: F.map_from_arrays(F.transform(at, lambda i: F.get(t, i - 1)), whole(at))))

    return let(F.array_sort(tokens(c)), count)


def bigrams(t: Column) -> Column:
    """Neighbouring items of an array of tokens, joined by two underscores."""
    return F.transform(F.arrays_zip(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("a"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))).alias("b")), lambda x: F.concat_ws("__", x["a"], x["b"]))


def grams(c: Column) -> Column:
    return let(tokens(c), lambda t: F.concat(t, bigrams(t)))


def safe_filename(c: Column, limit: int = 180) -> Column:
    plain = F.regexp_replace(squeeze(c), r'[<>:"/\\|?*]', "_")
    return F.left(F.regexp_replace(F.regexp_replace(plain, r"\s+", "_"), "_+", "_"), F.lit(limit))


def filename_words(c: Column) -> Column:
    """A file name as words: no percent codes, extension or document number."""
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(text(c), F.lit("+"), F.lit("%2B"))), text(c)), r"(?i)\.[a-z0-9]{2,5}$", "")
    return squeeze(F.regexp_replace(F.regexp_replace(plain, r"(?i)_DOC_\d+(?:_\d+)?$", ""), r"[_\-]+", " "))


def domain(url: Column) -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("")))


def source_label(url: Column) -> Column:
    """A domain as a name."""
    bare = F.regexp_replace(F.regexp_replace(domain(url), r"^www\.", ""), r"\.(com|org|gov|edu|net)$", "")
    return F.when(domain(url) == "", "Unknown").otherwise(F.initcap(F.replace(bare, F.lit("."), F.lit(" "))))


def canonical_url(url: Column, tracking: list[str] = vocab.TRACKING) -> Column:
    """Lower-case scheme and host, no tracking or blank parameters, no fragment, no slash at the end of the path."""
    raw = squeeze(url)
    part = lambda k: F.coalesce(F.try_parse_url(raw, F.lit(k)), F.lit(""))
    path = F.when(part("PATH") == "", "/").when(part("PATH") == "/", "/").otherwise(F.regexp_replace(part("PATH"), "/+$", ""))
    name = lambda kv: F.lower(F.split_part(kv, F.lit("="), F.lit(1)))
    keeps = F.filter(F.split(part("QUERY"), "&"), lambda kv: F.contains(kv, F.lit("=")) & ~F.endswith(kv, F.lit("=")) & ~name(kv).isin(*tracking) & ~F.startswith(name(kv), F.lit("utm_")))
    query = F.array_join(keeps, "&")
    scheme = F.when(part("PROTOCOL") == "", "https").otherwise(F.lower(part("PROTOCOL")))
    return F.when(raw == "", "").otherwise(F.concat(scheme, F.lit("://"), F.lower(part("AUTHORITY")), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def url_file_type(url: Column) -> Column:
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    kinds = (("PDF", r"\.pdf$"), ("HTML", r"\.html?$"), ("DOC", r"\.docx?$"), ("PPT", r"\.pptx?$"), ("Excel", r"\.xlsx?$"), ("CSV", r"\.csv$"), ("TXT", r"\.txt$"))
    out = F.lit("HTML")
    for kind, pattern in reversed(kinds):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def content_file_type(content_type: Column) -> Column:
    """File type of an HTTP content type."""
    ct = F.lower(F.trim(F.split_part(text(content_type), F.lit(";"), F.lit(1))))
    return F.when(ct == "application/pdf", "PDF").when(ct.isin("text/html", "application/xhtml+xml"), "HTML").when(F.startswith(ct, F.lit("text/plain")), "TXT").when(F.startswith(ct, F.lit("image/")), "Image").when(F.startswith(ct, F.lit("audio/")), "Audio").when(F.startswith(ct, F.lit("video/")), "Video").otherwise(F.upper(ct))


def disposition_name(cd: Column) -> Column:
    """The file name of a content-disposition header; null without one."""
    found = lambda p: F.nullif(F.regexp_extract(text(cd), p, 1), F.lit(""))
    return safe_filename(F.coalesce(F.try_url_decode(found(r"(?i)filename\*=UTF-8''([^;]+)")), found(r'(?i)filename="([^"]+)"'), F.trim(found(r'(?i)filename=([^;"]+)'))))


def with_suffix(filename: Column, doc_id: Column) -> Column:
    """A file name with the document's id before its extension, once."""
    name = safe_filename(filename)
    ext = F.regexp_extract(name, r"(?<=[^.])(\.[^.]*)$", 1)
    stem = F.left(name, F.length(name) - F.length(ext))
    return F.when(F.endswith(stem, F.concat(F.lit("_"), doc_id)), name).otherwise(F.concat(stem, F.lit("_"), doc_id, ext))


def stable_id(url: Column) -> Column:
    u = canonical_url(url)
    return F.when(u == "", "CAND_UNKNOWN").otherwise(F.concat(F.lit("CAND_"), F.upper(F.left(F.sha1(u), F.lit(10)))))


def split_values(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), r"[;/,|•]|\sand\s"), lambda x: squeeze(x)), lambda x: x != "")


def distinct_texts(values: Column, limit: int) -> Column:
    """The first of items that differ in no more than case and spacing, `limit` at most."""
    empty = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        def add(k: Column) -> Column:
            new = (k != "") & ~F.array_contains(acc["keys"], k)
            return F.struct(F.when(new, F.array_append(acc["keys"], k)).otherwise(acc["keys"]).alias("keys"), F.when(new, F.array_append(acc["out"], squeeze(x))).otherwise(acc["out"]).alias("out"))

        return let(F.lower(squeeze(x)), add)

    return F.slice(F.aggregate(values, empty, step, lambda acc: acc["out"]), 1, limit)


def sentences(c: Column) -> Column:
    return F.split(squeeze(c), r"(?<=[\.\!\?])\s+")


def keyword_count(c: Column, keywords: list[str]) -> Column:
    """How many keywords a text contains, as substrings and in any case."""
    low = F.lower(text(c))
    return let(low, lambda t: F.size(F.filter(F.array(*map(F.lit, keywords)), lambda k: F.contains(t, k))))


def specificity(c: Column, patterns: list[str] = vocab.SPECIFICS) -> Column:
    return let(F.lower(text(c)), lambda t: sum((t.rlike(p).cast("int") for p in patterns), F.lit(0)))


def extractive_summary(c: Column, pool: list[str], regions: list[str] = ["georgia", "southeast"], count: int = 4, limit: int = 750, specifics: list[str] = vocab.SPECIFICS) -> Column:  # noqa: B006
    """The first sentence and the best others, in their order: keywords, numbers and specifics score."""
    score = lambda s: keyword_count(s, pool) + 0.6 * F.size(F.regexp_extract_all(F.lower(s), F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))) + 0.6 * specificity(s, specifics) + F.when(keyword_count(s, regions) > 0, 1.0).otherwise(0.0)

    def pick(s: Column) -> Column:
        ranked = F.array_sort(F.transform(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), lambda x, i: F.struct((-score(x)).alias("k"), (i + 1).alias("i"))))
        chosen = F.array_sort(F.concat(F.array(F.lit(0)), F.transform(F.slice(ranked, 1, count - 1), lambda r: r["i"])))
        joined = F.array_join(F.transform(chosen, lambda i: F.get(s, i)), " ")
        return F.when(F.size(s) <= count, squeeze(c)).otherwise(joined)

    return F.left(let(sentences(c), pick), F.lit(limit))


def headings(c: Column) -> Column:
    """Lines that look like headings: upper case, numbered, in title case or with a colon; twenty at most."""
    line_ok = lambda x: (F.length(x) >= 4) & (F.length(x) <= 120) & ~(F.endswith(x, F.lit(".")) & (F.size(F.split(x, " ")) > 10))
    title = lambda x: ((x == F.upper(x)) & (x != F.lower(x))) | x.rlike(r"^(\d+(\.\d+)*|[IVX]+\.?)\s+") | ((x == F.initcap(x)) & (x != F.lower(x))) | F.contains(x, F.lit(":"))
    lines = F.transform(F.split(text(c), r"[\r\n]+"), lambda x: squeeze(x))
    return distinct_texts(F.filter(lines, lambda x: line_ok(x) & title(x)), 20)


def document_text(c: Column) -> Column:
    """Entities decoded, lines squeezed, blank lines dropped."""
    plain = text(c)
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.array_join(F.filter(F.transform(F.split(plain, r"\r\n|\r|\n"), lambda x: squeeze(x)), lambda x: x != ""), "\n")


def place(c: Column) -> Column:
    """Struct of city and county."""
    p = F.trim(text(c))
    comma = F.instr(p, ",") > 0
    county = F.contains(F.lower(p), F.lit("county"))
    city = F.when(comma, F.trim(F.split_part(p, F.lit(","), F.lit(1)))).when((F.lower(p) == "georgia") | county, "").otherwise(p)
    own = F.when(comma, F.trim(F.regexp_replace(p, "^[^,]*,", ""))).when(county, p).otherwise("")
    return F.struct(city.alias("city"), own.alias("county"))


def county(c: Column) -> Column:
    """The last county that a location names, or the whole of it."""
    found = F.regexp_extract_all(text(c), F.lit(r"([A-Za-z .'-]+ County)"), F.lit(1))
    whole = F.trim(text(c))
    states = F.lower(whole).isin("georgia", "alabama", "tennessee", "south carolina", "north carolina")
    return F.when(text(c) == "", "Unknown").when(F.size(found) > 0, F.trim(F.element_at(found, -1))).when(states, "Statewide / Unspecified").otherwise(whole)


def digits(c: Column) -> Column:
    """All digits of a text as one number; null without any."""
    return F.regexp_replace(text(c), "[^0-9]", "").try_cast("bigint")


def without_pdf_hint(q: Column) -> Column:
    return squeeze(F.regexp_replace(text(q), r"(?i)\bfiletype\s*:\s*pdf\b", " "))


def enhanced_query(q: Column, pdf: bool = False, hints: list[str] = vocab.QUERY_HINTS, limit: int = 420) -> Column:
    base = without_pdf_hint(q)
    extra = [F.when(~F.contains(F.lower(base), F.lit(h.lower())), h) for h in ((["filetype:pdf"] if pdf else []) + hints)]
    return F.left(squeeze(F.concat_ws(" ", base, *extra)), F.lit(limit))


def query_variants(q: Column, mode: str = "hybrid", enhance: bool = True) -> Column:
    """Array of (label, query), distinct but for case."""
    pdf = enhanced_query(q, True) if enhance else squeeze(F.concat(without_pdf_hint(q), F.lit(" filetype:pdf")))
    web = enhanced_query(q) if enhance else without_pdf_hint(q)
    pairs = {"pdf_only": [("pdf_only", pdf)], "web_only": [("web_only", web)], "hybrid": [("pdf_only", pdf), ("web_only", web)]}.get(mode, [("as_is", squeeze(q))])
    every = F.array(*(F.struct(F.lit(k).alias("label"), v.alias("query")) for k, v in pairs))
    every = F.filter(every, lambda x: x["query"] != "")
    return let(every, lambda a: F.filter(a, lambda x, i: (i == 0) | (F.lower(x["query"]) != F.lower(F.get(a, F.lit(0))["query"]))))


def json_object(c: Column) -> Column:
    """The text of the JSON object that a text is or holds between its outermost braces; null without one."""
    fits = lambda x: F.when(F.startswith(F.trim(x), F.lit("{")) & F.try_parse_json(x).isNotNull(), x)
    return F.coalesce(fits(text(c)), fits(F.nullif(F.regexp_extract(text(c), r"(?s)\{.*\}", 0), F.lit(""))))


def preview(c: Column, limit: int = 240) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(limit - 3))), F.lit("...")))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text(c)) / 4)).cast("int")


def citations(c: Column) -> Column:
    """KIND:id of each citation in order."""
    return F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(CITATION), F.lit(0)), lambda m: F.concat(F.upper(F.regexp_extract(m, CITATION, 1)), F.lit(":"), F.trim(F.regexp_extract(m, CITATION, 2)))), lambda t: ~F.endswith(t, F.lit(":")))


def without_citations(c: Column) -> Column:
    return F.trim(F.regexp_replace(text(c), CITATION, ""))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(text(c), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def semantic_text(c: Column) -> Column:
    """An answer without its evidence line, what it says is missing, bullets and citations."""
    start = F.struct(F.lit(False).alias("missing"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        evidence, opens = F.startswith(low, F.lit("evidence:")), F.startswith(low, F.lit("missing info"))
        drop = evidence | opens | (acc["missing"] & (x.rlike(BULLET) | F.endswith(x, F.lit(":"))))
        kept = without_citations(F.regexp_replace(x, BULLET, ""))
        return F.struct((acc["missing"] | (~evidence & opens)).alias("missing"), F.when(drop | (kept == ""), acc["out"]).otherwise(F.array_append(acc["out"], kept)).alias("out"))

    body = F.array_join(F.aggregate(_lines(c), start, step, lambda acc: acc["out"]), "\n")
    return F.when(F.trim(text(c)) == vocab.ABSTENTION, vocab.ABSTENTION).otherwise(body)


def answer_parts(c: Column) -> Column:
    """Struct of abstained, bullets, missing (arrays) and evidence (the last evidence line)."""
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("in_missing"), none.alias("bullets"), none.alias("missing"), none.alias("prose"), F.lit("").alias("evidence"))

    def step(acc: Column, x: Column) -> Column:
        low = F.lower(x)
        evidence = F.startswith(low, F.lit("evidence:"))
        opens = ~evidence & F.startswith(low, F.lit("missing info"))
        bullet = ~evidence & ~opens & x.rlike(BULLET)
        item = F.trim(F.regexp_replace(x, BULLET, ""))
        payload = F.when(F.instr(x, ":") > 0, F.trim(F.regexp_replace(x, "^[^:]*:", ""))).otherwise("")
        add = lambda a, on, v: F.when(on, F.array_append(a, v)).otherwise(a)
        return F.struct(
            (acc["in_missing"] | opens).alias("in_missing"),
            add(acc["bullets"], bullet & ~acc["in_missing"], item).alias("bullets"),
            add(add(acc["missing"], bullet & acc["in_missing"], item), opens & (payload != ""), payload).alias("missing"),
            add(acc["prose"], ~evidence & ~opens & ~bullet, x).alias("prose"),
            F.when(evidence, x).otherwise(acc["evidence"]).alias("evidence"),
        )

    def finish(acc: Column) -> Column:
        alone = (F.size(acc["bullets"]) == 0) & (F.size(acc["missing"]) == 0)
        return F.struct(
            F.lit(False).alias("abstained"),
            F.when(alone, acc["prose"]).otherwise(acc["bullets"]).alias("bullets"),
            F.when(~alone & acc["in_missing"], F.concat(acc["missing"], acc["prose"])).otherwise(acc["missing"]).alias("missing"),
            acc["evidence"].alias("evidence"),
        )

    whole = F.struct(F.lit(True).alias("abstained"), none.alias("bullets"), none.alias("missing"), F.lit("").alias("evidence"))
    return F.when(F.trim(text(c)) == vocab.ABSTENTION, whole).otherwise(F.aggregate(_lines(c), start, step, finish))


@F.pandas_udf(ArrayType(StringType()))
def sentence_units(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Answer units: list lines and short lines as they stand, else sentences. Sentences end at . ! ? ; unless an
    abbreviation or a lower-case letter forbids it."""
    import re

    short = frozenset("co corp inc llc ltd mr mrs ms dr st vs etc".split())
    listed, end = re.compile(r"\s*(?:[-*•]|\d)"), re.compile(r"[.!?;](?=\s*(\S)?)")

    def split(block: str) -> list[str]:
        out, start = [], 0
        for m in end.finditer(block):
            part = block[start : m.end()].strip()
            last = part.rstrip(".").split()[-1:] if m.group()[0] == "." else []
            if part and not (last and last[0].lower() in short) and not (m.group(1) or "").islower():
                out.append(part)
                start = m.end()
        tail = block[start:].strip()
        return [*out, tail] if tail else out

    def units(answer: str | None) -> list[str]:
        out: list[str] = []
        for block in re.split(r"\n\s*\n", (answer or "").replace("\r\n", "\n").strip()):
            lines = [x.strip() for x in block.split("\n") if x.strip()]
            as_lines = len(lines) > 1 and (sum(bool(listed.match(x)) for x in lines) >= max(1, len(lines) // 2) or all(len(x) <= 140 for x in lines))
            out += lines if as_lines else split(" ".join(lines))
        return out

    for batch in batches:
        yield batch.map(units)


def list_items(c: Column) -> Column:
    """The items that an answer lists: bullets, else lines and parts between semicolons, a single one cut at commas."""
    parts = F.filter(F.transform(F.split(semantic_text(c), r"[\n;]+"), lambda x: F.trim(x)), lambda x: x != "")
    own = let(answer_parts(c), lambda p: F.when(p["abstained"], F.array().cast("array<string>")).when(F.size(p["bullets"]) > 0, p["bullets"]).otherwise(parts))
    clean = lambda a: F.transform(a, without_citations)
    single = let(own, lambda a: F.when(F.size(a) == 1, F.split(F.get(clean(a), F.lit(0)), ",")).otherwise(clean(a)))
    return F.array_distinct(F.filter(F.transform(single, match_key), lambda x: x != ""))


def numbers(c: Column) -> Column:
    """Numbers of a text; percentages as fractions."""
    value = lambda m: F.regexp_replace(m, "[,%]", "").try_cast("double")
    return F.filter(F.transform(F.regexp_extract_all(text(c), F.lit(NUMBER), F.lit(0)), lambda m: F.when(F.endswith(m, F.lit("%")), value(m) / 100).otherwise(value(m))), lambda v: v.isNotNull())


def judge_score(c: Column) -> Column:
    """The first number from 0 to 1 in a judge's reply."""
    return F.round(F.nullif(F.regexp_extract(text(c), r"(?<![\d.])(0(?:\.\d+)?|1(?:\.0+)?)\b", 1), F.lit("")).try_cast("double"), 4)


def abstained(c: Column, pattern: str = r"(?i)\b(not found in|not available in|cannot be determined|insufficient (context|information)|no information)\b") -> Column:
    t = F.trim(text(c))
    return (t == "") | (t == vocab.ABSTENTION) | t.rlike(pattern)


def snake_case(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text(c))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def logged_list(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(text(c), r"[\n,;]+"), lambda x: F.trim(x)), lambda x: x != ""))


def word_count(c: Column) -> Column:
    return F.regexp_count(text(c), F.lit(r"\S+"))


def publication_date(c: Column, fields: list[Column] = (), fallback: Column | None = None) -> Column:
    """The first field that isn't blank, else the fallback, else the first date in the text by kind, not by place."""
    given = [F.nullif(squeeze(f), F.lit("")) for f in [*fields, *([fallback] if fallback is not None else [])]]
    head = F.left(text(c), F.lit(2500))
    found = [F.nullif(F.regexp_extract(head, f"(?i){p}", 0), F.lit("")) for p in vocab.DATES]
    return F.coalesce(*given, *found, F.lit(""))


def clamp(v: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def text_hash(c: Column) -> Column:
    s = squeeze(c)
    return F.when(s == "", "").otherwise(F.sha2(s, 256))


def json_fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns' JSON; name them in sorted order for one fingerprint whatever the order of a table."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def first_matches(c: Column, patterns: list[str], limit: int = 15) -> Column:
    """All matches of the patterns, pattern by pattern, distinct but for case and spacing."""
    found = F.flatten(F.array(*(F.regexp_extract_all(text(c), F.lit(p), F.lit(0)) for p in patterns)))
    return distinct_texts(found, limit)


def dates(c: Column) -> Column:
    """Dates of a text. Each has a year of this century, which is looked for first: most texts have none."""
    return F.when(text(c).rlike("20[0-9]{2}"), first_matches(c, [f"(?i){p}" for p in vocab.DATES])).otherwise(F.array().cast("array<string>"))


def capacities(c: Column) -> Column:
    return first_matches(c, [f"(?i){vocab.CAPACITIES}"])


def facilities(c: Column) -> Column:
    return first_matches(c, [vocab.FACILITIES])


def truthy(c: Column) -> Column:
    """1 for a number above 0 or a true word, else 0."""
    return F.when(F.coalesce(c.cast("string").try_cast("double") >= 1, F.lower(c.cast("string")) == "true", F.lit(False)), 1).otherwise(0)


def safe_float(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def plain_id(c: Column) -> Column:
    return F.regexp_replace(F.trim(text(c)), r"\.0$", "")
