"""Questions as a table: what each names and asks for, and the rows of an entity table that answer it.

Questions are (question, text). What a question says of itself is a column expression; what it names is a join with
the values that the entity table has, so neither questions nor values pass through the driver, and any number of
questions is answered in one job. Rows of entities: row_key, company, category, role, location, primary_oems,
product_service, employment.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import vocab
from ..functions.text import category_key, let, match_key, squeeze, text
from ..operators.joins import name_matches
from ..operators.matching import term_hits
from ..operators.shared import if_small, shared_table

#: What of a question names the column that it groups by; the first that fits.
GROUPS = (
    ("industry group", "industry_group"), ("primary facility type", "primary_facility_type"), ("supplier or affiliation type", "supplier_or_affiliation_type"), ("classification method", "classification_method"),
    ("primary oem", "primary_oems"), ("ev battery relevant", "ev_battery_relevant"), ("ev supply chain role", "role"), ("category", "category"), ("categories", "category"), ("county", "county"), ("counties", "county"), ("city", "city"), ("cities", "city"),
)
#: Words of a question that asks for everything.
EXHAUSTIVE = ("list all", "show all", "provide the matching companies", "include their", "summarize their", "for each category")
#: Words of a question about figures or patterns, beside those of vocab.ANALYTIC.
PATTERNS = ("missing primary oems", "ev battery relevant", "containing both", "only one", "classified as", "classification method", "appear multiple times", "most concentrated in a single county", "supply to more than one oem")
#: The patterns after which locations are left out, and those that give a category.
EXCLUDED = (r"(?i)excluding rows with location\s*=\s*([A-Za-z0-9 ,()/-]+?)(?:\.|\?|,|$)", r"(?i)excluding location\s*=\s*([A-Za-z0-9 ,()/-]+?)(?:\.|\?|,|$)")
EXACT = (r"(?i)category\s*=\s*([A-Za-z0-9 ()/-]+?)(?:\s+and\b|\?|$)", r"(?i)category\s+is\s+([A-Za-z0-9 ()/-]+?)(?:\s+and\b|\?|$)")
#: Words with which "oem" is no category, is one, or is one at a question's beginning.
NO_OEM = ("primary oem", "oem contract", "oem customer")
AN_OEM = ("category oem", "category is oem", "oem footprint", "oem company", "oem companies", "original equipment manufacturer")
OEM_FIRST = r"^(show|list|find|identify|map)\s+oem\b"
#: Words that make a company the one that is supplied.
LINKED = ("linked to", "supply to")
QUOTED = r"\"([^\"]+)\"|'([^']+)'"


def _has(q: Column, words) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(q, w))


def group_field(c: Column) -> Column:
    """The column that a question groups by; null without one."""
    q = match_key(c)
    return F.coalesce(*(F.when(F.contains(q, F.lit(words)), column) for words, column in GROUPS))


def exhaustive(c: Column) -> Column:
    return _has(match_key(c), EXHAUSTIVE)


def analytic(c: Column) -> Column:
    """Whether a question asks for figures or patterns."""
    q = match_key(c)
    product = F.contains(q, F.lit("mentions")) & F.contains(q, F.lit("product service"))
    return _has(q, (*vocab.ANALYTIC, *PATTERNS)) | R.employment_limit(c).isNotNull() | product


def excluded_locations(c: Column) -> Column:
    found = F.concat(*(F.regexp_extract_all(text(c), F.lit(p), F.lit(1)) for p in EXCLUDED))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != ""))


def exact_category(c: Column) -> Column:
    """The category that a question gives outright, as a key; null without one."""
    found = [F.regexp_extract(text(c), p, 1) for p in EXACT]
    return F.coalesce(*(F.when(f != "", category_key(f)) for f in found))


def means_oems(c: Column) -> Column:
    """Whether "OEM" in a question is the category."""
    q = category_key(c)
    return ~_has(q, NO_OEM) & (_has(q, AN_OEM) | q.rlike(OEM_FIRST))


def quoted_terms(c: Column) -> Column:
    """What stands in single or double quotes, in order."""
    found = F.regexp_extract_all(text(c), F.lit(QUOTED), F.lit(0))
    return F.filter(F.transform(found, lambda m: F.trim(F.substring(m, F.lit(2), F.length(m) - 2))), lambda m: m != "")


def top_n(c: Column) -> Column:
    """How many rows a question wants: a number after top or bottom, five where it wants extremes, else null."""
    q = match_key(c)
    n = F.nullif(F.regexp_extract(q, r"(?:top|bottom)\s+(\d+)", 1), F.lit("")).try_cast("int")
    return F.coalesce(n, F.when(_has(q, ("top", "highest", "largest", "bottom", "fewest")), 5))


def understood(questions: DataFrame) -> DataFrame:
    """questions with intent, route, group, limit, threshold (op, value), excluded, quoted, analytic, exhaustive."""
    c = F.col("text")
    return questions.withColumns({
        "intent": R.intent(match_key(c)), "route": R.route(c), "group": group_field(c), "limit": top_n(c), "threshold": R.employment_limit(c), "excluded": excluded_locations(c), "quoted": quoted_terms(c), "analytic": analytic(c), "exhaustive": exhaustive(c),
    })


def known_values(rows: DataFrame, column: str) -> DataFrame:
    """(value, ord): a column's values that aren't blank, each once, longest first."""
    own = rows.select(F.trim(F.col(column).cast("string")).alias("value")).where("value <> ''").distinct()
    return own.withColumn("ord", -F.length("value"))


#: The columns by which questions choose rows.
FIELDS = ("company", "category", "location", "primary_oems", "role")


def role_terms(rows: DataFrame) -> DataFrame:
    """(term): roles in normal form, and their parts between "and" that have two words or more."""
    role = rows.select(match_key(F.col("role")).alias("role")).where("role <> ''").distinct()
    parts = F.filter(F.transform(F.split("role", r"\band\b"), lambda x: F.trim(x)), lambda x: F.size(F.split(x, " ")) >= 2)
    return role.select(F.explode(F.array_distinct(F.concat(F.array("role"), parts))).alias("term")).distinct()


def _keyed(rows: DataFrame, column: str, key) -> DataFrame:
    """(value, key) of a column, one value a key: the longest, then the first."""
    own = known_values(rows, column).select("value", key(F.col("value")).alias("key")).where("key <> ''")
    return own.groupBy("key").agg(F.min_by("value", F.struct(-F.length("value"), F.col("value"))).alias("value"))


def mentioned(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(question, field, key, value): what stands in the questions: companies, OEMs and locations as whole words (a
    location also by what follows its first comma), categories and role terms as parts of the text."""
    spelled = lambda field, df: df.select(F.to_json(F.struct(F.lit(field).alias("f"), F.col("key").alias("k"), F.col("value").alias("v"))).alias("name"), "alias", F.lit(0).alias("ord"))
    names = None
    for field in ("company", "location", "primary_oems"):
        own = _keyed(rows, field, match_key).withColumn("alias", F.col("key"))
        if field == "location":
            after = own.where(F.contains("value", F.lit(","))).withColumn("alias", match_key(F.regexp_replace("value", "^[^,]*,", "")))
            own = own.unionByName(after.where("alias <> ''"))
        names = spelled(field, own) if names is None else names.unionByName(spelled(field, own))
    hits = name_matches(questions, names, "question", "text").select(F.col("id").alias("question"), F.from_json("name", "f string, k string, v string").alias("n"))
    whole = hits.select("question", F.col("n.f").alias("field"), F.col("n.k").alias("key"), F.col("n.v").alias("value"))
    categories = _keyed(rows, "category", category_key)
    by_category = term_hits(questions.select("question", category_key(F.col("text")).alias("t")), categories.select(F.col("key").alias("term")), "question", "t")
    by_category = by_category.join(categories, F.col("term") == F.col("key")).select(F.col("id").alias("question"), F.lit("category").alias("field"), "key", "value")
    by_role = term_hits(questions.select("question", match_key(F.col("text")).alias("t")), role_terms(rows), "question", "t")
    return whole.unionByName(by_category).unionByName(by_role.select(F.col("id").alias("question"), F.lit("role").alias("field"), F.col("term").alias("key"), F.col("term").alias("value")))


def named(questions: DataFrame, rows: DataFrame) -> DataFrame:
    """(question, field, key, value): what questions choose rows by, of what they mention. The rules, in order: a
    category that is given outright is the only one; a question about classification has none; "OEM" is a category
    only where the question means it; a location that is excluded isn't wanted; where a question asks who is linked to
    or supplies someone, its companies are OEMs, unless it names OEMs, and none of its own."""
    c, q = F.col("text"), match_key(F.col("text"))
    facts = questions.select("question", exact_category(c).alias("exact"), _has(q, ("classified as", "classification method")).alias("about"), means_oems(c).alias("oems"), F.contains(q, F.lit("primary oem")).alias("primary"), F.transform(excluded_locations(c), match_key).alias("outside"), _has(q, LINKED).alias("linked"))
    hits = mentioned(questions, rows).join(facts, "question")
    key, is_oem = F.col("key"), F.col("key") == "oem"
    category = F.when(F.col("exact").isNotNull(), key == F.col("exact")).otherwise(~F.col("about") & (~is_oem | F.col("oems"))) & ~(is_oem & F.col("primary"))
    kept = hits.where(F.when(F.col("field") == "category", category).when(F.col("field") == "location", ~F.array_contains("outside", key)).otherwise(True))
    has_oem = F.bool_or(F.col("field") == "primary_oems").over(Window.partitionBy("question"))  # what one question names
    moved = kept.withColumn("has_oem", has_oem)
    field = F.when(~F.col("linked") | (F.col("field") != "company"), F.col("field")).when(~F.col("has_oem"), "primary_oems")
    # Read by whatever answers the questions, so written once.
    return shared_table(moved.select("question", field.alias("field"), "key", "value").where("field is not null").distinct(), "names")


def cells(rows: DataFrame) -> DataFrame:
    """(row_key, field, key): what rows can be chosen by; of roles and products (field product) the role terms in them."""
    key = {"company": match_key, "category": category_key, "location": match_key, "primary_oems": match_key}
    own = F.array(*(F.struct(F.lit(c).alias("field"), k(F.col(c)).alias("key")) for c, k in key.items()))
    out = rows.select("row_key", F.explode(own).alias("c")).select("row_key", "c.field", "c.key").where("key <> ''")
    terms = role_terms(rows)
    for field, column in (("role", "role"), ("product", "product_service")):
        if column in rows.columns:
            keyed = rows.select("row_key", match_key(F.col(column)).alias("t"))
            hits = term_hits(keyed.select("t").distinct().where("t <> ''").select(F.col("t").alias("id"), "t"), terms, "id", "t")
            out = out.unionByName(keyed.join(hits, F.col("t") == F.col("id")).select("row_key", F.lit(field).alias("field"), F.col("term").alias("key")))
    return out


#: Rows that a question which names nothing may match, unless it asks for everything.
EXHAUSTIVE_ROWS = 150


def matched(questions: DataFrame, names: DataFrame, rows: DataFrame, most: int | None = EXHAUSTIVE_ROWS) -> DataFrame:
    """(question, row_key): the rows that have, in each field in which a question names values, one of them, and that
    lie at no location it leaves out. names: of `named`.

    Only questions about figures, and others than definitions that name something, choose rows. A role term is met by a
    role that has it, or by a product where the question speaks of products or mentions. A question that names nothing
    takes all rows if it asks for everything, if there are no more than `most`, or if that is None. Rows are long by field
    and value, so that named values meet them in an equi-join; questions without names are a stated set that goes through
    all rows.
    """
    c, q = F.col("text"), match_key(F.col("text"))
    facts = questions.select("question", analytic(c).alias("analytic"), (R.intent(q) != "definition").alias("plain"), _has(q, ("product service", "mentions")).alias("products"), exhaustive(c).alias("everything"), F.transform(excluded_locations(c), match_key).alias("outside"))
    wanted = names.groupBy("question").agg(F.count_distinct("field").alias("fields"))
    asked = facts.join(wanted, "question", "left").where(F.col("analytic") | (F.col("fields").isNotNull() & F.col("plain")))
    own = shared_table(cells(rows), "cells")
    alike = own.withColumn("of", F.when(F.col("field") == "product", "role").otherwise(F.col("field")))
    met = names.join(alike.select("row_key", F.col("field").alias("by"), F.col("of").alias("field"), "key"), ["field", "key"])
    met = met.join(asked.where("fields is not null"), "question").where((F.col("by") != "product") | F.col("products"))
    hits = met.groupBy("question", "row_key", "fields").agg(F.count_distinct("field").alias("n")).where("n = fields").select("question", "row_key")
    free = asked.where("fields is null")
    free = free if most is None or rows.limit(most + 1).count() <= most else free.where("everything")
    every = if_small(free.select("question")).withColumn("one", F.lit(1)).join(rows.select("row_key").withColumn("one", F.lit(1)), "one").select("question", "row_key")
    found = hits.unionByName(every).join(facts.select("question", "outside"), "question").join(rows.select("row_key", match_key(F.col("location")).alias("at")), "row_key")
    return found.where(~F.array_contains("outside", F.col("at"))).select("question", "row_key")


def summaries(hits: DataFrame, rows: DataFrame, preview: int = 5) -> DataFrame:
    """(question, rows, employment, categories, companies, more, summary): of each question's rows their number, total
    employment, numbers by category, the first companies by name and how many more there are, and all as a text."""
    own = hits.join(rows.select("row_key", "company", "category", "employment"), "row_key")
    counts = own.where(F.trim("category") != "").groupBy("question", "category").agg(F.count("*").alias("n"))
    by_category = counts.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "category", "n"))), lambda x: F.concat_ws(": ", x["category"], x["n"].cast("string"))), "; ").alias("categories"))
    order = Window.partitionBy("question").orderBy("company")
    first = own.select("question", "company").where(F.trim("company") != "").distinct().withColumn("k", F.row_number().over(order))
    named_ = first.groupBy("question").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= preview, F.struct("k", "company")))), lambda x: x["company"]), "; ").alias("companies"), F.greatest(F.lit(0), F.count("*") - preview).alias("more"))
    totals = own.groupBy("question").agg(F.count("*").alias("rows"), F.sum("employment").alias("employment"))
    out = totals.join(by_category, "question", "left").join(named_, "question", "left")
    parts = [F.concat(F.lit("Matched rows: "), F.col("rows").cast("string")), F.concat(F.lit("By category: "), F.col("categories")), F.concat(F.lit("Companies: "), F.col("companies"), F.when(F.col("more") > 0, F.concat(F.lit(" (+"), F.col("more").cast("string"), F.lit(" more)"))).otherwise(""))]
    return out.withColumn("summary", F.concat_ws("\n", *parts))


def contains_all(c: Column, terms: Column) -> Column:
    """Whether a text holds each of an array of terms, but for case; false without terms."""
    return (F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(F.lower(text(c)), F.lower(t)))


def mentions_quoted(c: Column, question: Column) -> Column:
    """Whether a text holds what a question quotes, one term at least."""
    return F.exists(quoted_terms(question), lambda t: F.contains(F.lower(text(c)), F.lower(t)))


def several_values(c: Column) -> Column:
    """Whether a cell names more than one value: parts between commas, semicolons, slashes or "and"."""
    parts = F.filter(F.transform(F.split(text(c), r"[;/,|]|\sand\s|\sor\s"), lambda x: squeeze(x)), lambda x: x != "")
    return let(parts, lambda p: F.size(F.array_distinct(p)) > 1)


def missing(c: Column) -> Column:
    """Whether a cell has no value: null, blank, or a word that says so."""
    return F.lower(F.trim(text(c))).isin("", "nan", "none", "n/a", "unknown")


def labelled(columns: dict[str, Column]) -> Column:
    """The cells that aren't missing, with their labels, in order: a row in words."""
    return F.concat_ws(" | ", *(F.when(~missing(c), F.concat(F.lit(f"{label}: "), text(c))) for label, c in columns.items()))


def typed(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of maps (values) as columns: name -> key of the map; missing ones are empty. With county, city and the
    employment as a number, of location and employment."""
    from ..functions.text import county, digits, place

    own = rows.select("*", *(F.trim(F.coalesce(F.try_element_at("values", F.lit(k)), F.lit(""))).alias(name) for name, k in columns.items()))
    if "location" in columns:
        own = own.withColumns({"county": county(F.col("location")), "city": place(F.col("location"))["city"]})
    return own.withColumn("employment", digits(F.col("employment"))) if "employment" in columns else own


def company_aliases(name: Column, least: int = 4) -> Column:
    """A company's name as a key, and without its legal form where enough is left; longest first."""
    base = match_key(name)
    bare = squeeze(F.regexp_replace(base, r"\b(inc|llc|corp|corporation|company|co|ltd|plc|ag)\b", ""))
    return F.array_distinct(F.array_compact(F.array(base, F.when(F.length(bare) >= least, bare))))


def county_aliases(name: Column, stop: list[str] = (), least: int = 6) -> Column:
    """A county's name as a key, and without the word where that is long enough and in no stop list."""
    base = match_key(name)
    bare = match_key(F.regexp_replace(text(name), r"(?i)\bcounty\b", ""))
    return F.array_distinct(F.array_compact(F.array(base, F.when((F.length(bare) >= least) & ~bare.isin(*stop), bare))))


def vocabulary(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(kind, name, alias, ord): distinct values of columns by kind, in order, with their aliases. columns: kind ->
    column; counties get a county's aliases, the others a company's."""
    out = None
    for kind, column in columns.items():
        own = rows.select(squeeze(F.col(column)).alias("name")).where("name <> ''").distinct()
        forms = county_aliases(F.col("name")) if kind == "county" else company_aliases(F.col("name"))
        own = own.select(F.lit(kind).alias("kind"), "name", F.explode(forms).alias("alias"), F.xxhash64(F.lower("name")).alias("ord"))
        out = own if out is None else out.unionByName(own)
    return out


def vocabulary_summary(names: DataFrame, examples: int = 5) -> DataFrame:
    """(kind, names, aliases, examples): how many there are of each kind, and the first by name."""
    w = Window.partitionBy("kind").orderBy("name")
    first = names.select("kind", "name").distinct().withColumn("k", F.row_number().over(w)).where(F.col("k") <= examples)
    shown = first.groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("name")), "; ").alias("examples"))
    return names.groupBy("kind").agg(F.count_distinct("name").alias("names"), F.count("*").alias("aliases")).join(shown, "kind", "left")


def seed_term(c: Column, words: int = 10, limit: int = 80) -> Column:
    """A term for queries: no markup signs, its first words, no signs at the ends."""
    clean = squeeze(F.regexp_replace(text(c), r"[*\[\]{}|<>]+", " "))
    cut = F.array_join(F.slice(F.split(clean, " "), 1, words), " ")
    return F.regexp_replace(F.left(cut, F.lit(limit)), r"^[ ,;:-]+|[ ,;:-]+$", "")


def attribution_labels(raw: Column, units: Column, allowed: tuple[str, ...] = ("knowledge", "pretrained")) -> Column:
    """The labels (unit, source) that a judge's reply in JSON gives; null unless there is one for each unit, in a fixed
    form, and each of an allowed kind."""
    parsed = F.from_json(F.regexp_extract(text(raw), r"(?s)\[.*\]", 0), "array<struct<unit:int,source:string>>")
    fine = lambda a: (F.size(a) == units) & F.forall(a, lambda x: x["unit"].isNotNull() & F.coalesce(F.lower(x["source"]).isin(*allowed), F.lit(False))) & (F.size(F.array_distinct(F.transform(a, lambda x: x["unit"]))) == F.size(a))
    return F.when(parsed.isNotNull() & fine(parsed), F.transform(parsed, lambda x: F.struct(x["unit"].alias("unit"), F.lower(x["source"]).alias("source"))))


def response_metrics(success: Column, reference: Column, retrieved: Column, accuracy: Column, grounding: Column) -> Column:
    """Struct of accuracy (only of successful answers with a reference) and grounding (only with retrieved context)."""
    return F.struct(F.when(success & (squeeze(reference) != ""), accuracy).alias("accuracy"), F.when(success & (squeeze(retrieved) != ""), grounding).alias("grounding"))


def local_names(filename: Column, url: Column, title: Column) -> Column:
    """The names under which a candidate's file may be stored, in order, distinct but for case."""
    tail = F.trim(F.regexp_extract(F.coalesce(F.try_parse_url(text(url), F.lit("PATH")), F.lit("")), r"([^/]*)$", 1))
    base = F.regexp_replace(text(title), r'[<>:"/\\|?*]', "_")
    every = F.array(text(filename), tail, base, *(F.when(base != "", F.concat(base, F.lit(e))) for e in (".pdf", ".html", ".txt")))
    filled = F.filter(every, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.filter(filled, lambda x, i: F.array_position(F.transform(filled, F.lower), F.lower(x)) == i + 1)


def path_candidates(acquired: Column, resolved: Column, existing: Column, folder: Column, filename: Column) -> Column:
    """The paths at which a row's file may lie, in order."""
    joined = F.when((text(folder) != "") & (text(filename) != ""), F.concat(F.regexp_replace(folder, "/+$", ""), F.lit("/"), filename))
    return F.filter(F.array(text(acquired), text(resolved), text(existing), joined), lambda p: F.coalesce(p, F.lit("")) != "")


def resolved_paths(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path): where each row's file is: the first of its path candidates that is there, else the first of its local
    names that some file has, files by path. rows: id, paths, names (arrays); files: path."""
    index = files.select("path", F.lower(F.regexp_extract("path", r"([^/]*)$", 1)).alias("name"))
    by_path = rows.select("id", F.posexplode("paths").alias("k", "path")).join(files.select("path").distinct(), "path").groupBy("id").agg(F.min(F.struct("k", "path"))["path"].alias("direct"))
    by_name = rows.select("id", F.posexplode("names").alias("k", "name")).withColumn("name", F.lower("name")).join(index, "name").groupBy("id").agg(F.min(F.struct("k", "path"))["path"].alias("named"))
    return rows.select("id").join(by_path, "id", "left").join(by_name, "id", "left").select("id", F.coalesce("direct", "named").alias("path"))


def page_budget(pages: DataFrame, budget: int) -> DataFrame:
    """Pages (id, page, text) in order while characters are left, the one that overflows cut; blank ones take nothing."""
    used = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = pages.where(F.trim("text") != "").withColumn("_left", F.lit(budget) - used).where("_left > 0")
    return own.withColumn("text", F.left("text", F.col("_left").cast("int"))).drop("_left")


#: Words that say nothing of what a question is about.
STOPWORDS = ("a", "all", "an", "and", "are", "as", "by", "for", "from", "group", "how", "in", "is", "list", "me", "of", "show", "the", "them", "what", "which", "with")


def variants(questions: DataFrame, names: DataFrame, words: int = 12) -> DataFrame:
    """(question, variant, text): what is searched for a question: itself, its first words that say something, and what
    it names, by field and longest first; each different text once. names: of `named`."""
    order = F.create_map(*(x for k, f in enumerate(("company", "category", "location", "primary_oems", "role")) for x in (F.lit(f), F.lit(k))))
    filters = names.groupBy("question").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.element_at(order, F.col("field")).alias("o"), (-F.length("value")).alias("n"), "value"))), lambda x: x["value"])), " | ").alias("filters"))
    focus = F.array_join(F.slice(F.filter(F.split(match_key(F.col("text")), " "), lambda w: (w != "") & ~w.isin(*STOPWORDS)), 1, words), " ")
    every = F.filter(F.array(text(F.col("text")), focus, F.coalesce("filters", F.lit(""))), lambda t: F.trim(t) != "")
    return questions.join(filters, "question", "left").select("question", F.posexplode(F.array_distinct(every)).alias("variant", "text"))
