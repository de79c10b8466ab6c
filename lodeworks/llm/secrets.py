"""Secrets in texts: three known forms, and random-looking strings found by a battery of tests.

A string of 20 or more characters of an encoding (hexadecimal, base 32, 36, 62 or 64) is a candidate. Under the
inferred encoding, chi-squared uniformity over the alphabet, runs about the alphabet's middle and serial correlation
are tested; the least p-value, times three, says whether it can be random. Whether a natural word, identifier or
number could look so is a second p-value: the likelihood of the string under a natural model (letters by frequency,
lower case, upper case, digits and signs in runs) over that under the uniform one. The mean of the inverse ratio is 1
under the model, so a ratio of p or less has a probability of p at most, at any length; of two models, one with the
cases exchanged, the larger ratio counts. These p-values, in classes of length, go through
the Benjamini-Hochberg procedure on a grid, so that of what is reported in each class a share `rate` at most is
expected to be natural. All of it is DataFrame expressions; positions are code points, ends exclusive.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import carried, let, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encoding -> its alphabet in order; the first that has all characters of a candidate is inferred.
ENCODINGS = {
    "hex": _DIGITS + _LOWER[:6],
    "HEX": _DIGITS + _UPPER[:6],
    "base32": _UPPER + _DIGITS[2:8],
    "base36": _DIGITS + _LOWER,
    "BASE36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
}
#: Letters of English text in per mille, a to z.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: In natural strings, how often a class follows another (rows: lower case, upper case, digits, signs), in per mille;
#: scaled to the classes that an alphabet has. Hexadecimal ones are mostly plain numbers or letters in long runs.
FOLLOWS = ((890, 45, 25, 40), (600, 330, 30, 40), (60, 40, 850, 50), (600, 200, 150, 50))
HEX_FOLLOWS = ((880, 0, 120, 0), (0, 880, 120, 0), (40, 40, 920, 0), (0, 0, 0, 0))
#: Lengths at which a class of candidates begins.
CLASSES = (20, 24, 32, 48, 80)
#: Steps of the grid of p-values: a quarter of a power of ten each, 80 of them.
STEP, STEPS = 0.25, 80


def _natural(alphabet: str, swapped: bool) -> tuple[list[int], list[float], list[float]]:
    """A natural model of an alphabet's strings: its characters' classes (0 to 3), the logarithms of their
    probabilities within the class, and those of class b after a at place 4 a + b. swapped: cases exchanged."""
    classes = [0 if c in _LOWER else 1 if c in _UPPER else 2 if c in _DIGITS else 3 for c in alphabet]
    weight = [LETTERS[_LOWER.index(c.lower())] if c.lower() in _LOWER else 1 for c in alphabet]
    sums = [sum(w for w, k in zip(weight, classes, strict=True) if k == of) for of in range(4)]
    place = (1, 0, 2, 3) if swapped else (0, 1, 2, 3)
    rows = HEX_FOLLOWS if len(alphabet) == 16 else FOLLOWS
    logs = []
    for a in range(4):
        row = [rows[place[a]][place[b]] if sums[b] else 0 for b in range(4)]
        logs += [math.log(x / sum(row)) if x else -99.0 for x in row]
    return classes, [math.log(w / sums[k]) for w, k in zip(weight, classes, strict=True)], logs


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, by Hastings' polynomial."""
    a = F.least(F.abs(z), F.lit(37.0))
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    p = F.exp(-a * a / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, p).otherwise(1 - p)


def _found(text: Column, pattern: str, kind: int, some: Column, fits=None) -> Column:
    """Spans of a pattern's leftmost matches that don't overlap: array of (start, kind, end, value), if `some`."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")

    def placed(hits: Column, gaps: Column) -> Column:
        step = lambda acc, x: let(acc["at"] + F.length(x["gap"]), lambda start: F.struct((start + F.length(x["hit"])).alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("value")))).alias("spans")))
        pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = let(hits, lambda h: F.when(F.size(h) > 0, placed(h, F.split(text, pattern, -1))).otherwise(none))
    spans = F.filter(spans, fits) if fits else spans
    return F.when(some, spans).otherwise(none)


def _judged(span: Column) -> Column:
    """A candidate's (start, kind, end, class, step, p_random)."""
    value = span["value"]
    encoding = F.lit(None).cast("string")
    for name, alphabet in reversed(ENCODINGS.items()):
        signs = alphabet.replace("-", "").replace("+/", "+/") + ("-" if "-" in alphabet else "")
        encoding = F.when(value.rlike(f"^[{signs}]+$"), name).otherwise(encoding)
    alphabets = F.create_map(*(F.lit(x) for pair in ENCODINGS.items() for x in pair))
    models = {name: [_natural(alphabet, swapped) for swapped in (False, True)] for name, alphabet in ENCODINGS.items()}
    by_name = lambda f: F.create_map(*(x for name in ENCODINGS for x in (F.lit(name), F.array(*(F.lit(y) for y in f(models[name]))))))
    classes, within = by_name(lambda m: m[0][0]), by_name(lambda m: m[0][1])
    follows = [by_name(lambda m, i=i: m[i][2]) for i in range(2)]

    def tested(e: Column) -> Column:
        return let(alphabets[e], lambda alphabet: let(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: F.instr(alphabet, c).cast("double") - 1), lambda v: figures(v, F.length(alphabet).cast("double"), e)))

    def figures(v: Column, k: Column, e: Column) -> Column:
        n = F.size(v).cast("double")
        total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
        same = total(F.array_distinct(v), lambda c: F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0)))
        pairs = F.arrays_zip(F.slice(v, 1, F.size(v) - 1).alias("x"), F.slice(v, 2, F.size(v) - 1).alias("y"))
        high = lambda x: x > (k - 1) / 2
        return let(
            F.struct(
                n.alias("n"), k.alias("k"), (k / n * same - n).alias("chi"), (total(v, lambda x: x) / n).alias("mean"),
                total(v, lambda x: high(x).cast("double")).alias("n1"), (1 + total(pairs, lambda p: (high(p["x"]) != high(p["y"])).cast("double"))).alias("runs"),
                likelihood(v, e).alias("natural"),
            ),
            lambda s: let(
                F.struct(
                    s.alias("s"), (s["n"] - s["n1"]).alias("n2"),
                    total(v, lambda x: F.pow(x - s["mean"], F.lit(2.0))).alias("spread"), total(pairs, lambda p: (p["x"] - s["mean"]) * (p["y"] - s["mean"])).alias("joint"),
                ),
                p_values,
            ),
        )

    def likelihood(v: Column, e: Column) -> Column:
        """Logarithm of a candidate's probability under the likelier natural model; the first class is any of those
        that the alphabet has, four at most."""

        def of(x: Column) -> Column:
            pairs = F.zip_with(F.slice(x["c"], 1, F.size(x["c"]) - 1), F.slice(x["c"], 2, F.size(x["c"]) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            kinds = F.size(F.array_distinct(x["all"])).cast("double")
            own = F.aggregate(v, -F.log(kinds), lambda acc, i: acc + F.get(x["logs"], i.cast("int")))
            return let(F.struct(pairs.alias("pairs"), own.alias("own")), lambda y: y["own"] + F.greatest(*(let(f[e], lambda k: F.aggregate(y["pairs"], F.lit(0.0), lambda acc, c: acc + F.get(k, c["a"] * 4 + c["b"]))) for f in follows)))

        return let(F.struct(classes[e].alias("all"), within[e].alias("logs")), lambda t: let(F.struct(F.transform(v, lambda i: F.get(t["all"], i.cast("int"))).alias("c"), t["all"].alias("all"), t["logs"].alias("logs")), of))

    def p_values(t: Column) -> Column:
        s, n, k = t["s"], t["s"]["n"], t["s"]["k"]
        df = k - 1
        even = _tail((F.cbrt(s["chi"] / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df)))
        m = 2 * s["n1"] * t["n2"] / n
        run = F.when(m < 1, 0.0).otherwise(2 * _tail(F.abs(s["runs"] - m - 1) / F.sqrt(F.greatest(m * (m - 1) / (n - 1), F.lit(1e-9)))))
        serial = F.when(t["spread"] <= 0, 0.0).otherwise(2 * _tail(F.abs(t["joint"] / F.greatest(t["spread"], F.lit(1e-9)) + 1 / n) * F.sqrt(n)))
        ratio = (s["natural"] + n * F.log(k)) / math.log(10.0)
        step = F.greatest(F.lit(0), F.least(F.floor(-ratio / STEP), F.lit(STEPS))).cast("int")
        group = sum((n >= low).cast("int") for low in CLASSES) - 1
        return F.struct(group.alias("group"), step.alias("step"), F.least(F.lit(1.0), 3 * F.least(even, run, serial)).alias("p_random"))

    return let(encoding, lambda e: F.struct(span["start"], span["kind"], span["end"], F.when(e.isNotNull(), tested(e)).alias("test")))


def scan_secrets(docs: DataFrame, rate: float = 0.01, level: float = 0.01, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: id, base and extra, arrays of (start, kind, end) by start, then kind (an index in KINDS);
    the columns in `carry` under names that begin with carried_.

    rate: of the extra spans of each class of length, the share that may be natural. level: below this p-value a
    candidate is not random. Null texts count as empty; ids are only passed on; other columns are not read. An
    empty table gives an empty table. Candidates that touch a base span are left to it. Texts are read whole, however
    long, by expressions over the text; repeated rows have the same spans each, and their candidates count each.
    """
    text = F.col("text")
    low = F.lower(text)
    named = low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("api_key") | low.contains("apikey")
    base = F.concat(
        _found(text, ASSIGN, 0, named, lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6),
        _found(text, ACCESS, 1, text.contains("AKIA")),
        _found(text, HEX, 2, text.rlike(HEX)),
    )
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *carried(carry))
    kept = [f"carried_{c}" for c in carry]
    spans = F.transform(base, lambda s: F.struct(s["start"], s["kind"], s["end"]))
    free = lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"]))
    first = source.select("id", "text", F.array_sort(spans).alias("base"), *kept)
    second = first.select("id", "base", F.transform(F.filter(_found(text, CANDIDATE, 3, text.rlike(CANDIDATE)), free), _judged).alias("candidates"), *kept)
    seen = written(second, "secrets")

    tested = seen.select(F.explode("candidates").alias("c")).where("c.test is not null").groupBy("c.test.group", "c.test.step").count()
    by_step = Window.partitionBy("group").orderBy(F.desc("step"))
    ranked = tested.select("group", "step", F.sum("count").over(by_step).alias("upto"), F.sum("count").over(Window.partitionBy("group")).alias("all"))
    cuts = ranked.where(F.pow(F.lit(10.0), -F.col("step") * STEP) <= rate * F.col("upto") / F.col("all")).groupBy("group").agg(F.min("step").alias("cut"))
    cut = cuts.agg(F.map_from_entries(F.collect_list(F.struct("group", "cut")))).scalar()  # a row for each class at most
    passes = lambda c: c["test"].isNotNull() & (c["test"]["p_random"] >= level) & (c["test"]["step"] >= F.coalesce(F.try_element_at(F.col("cut"), c["test"]["group"]), F.lit(STEPS + 1)))
    extra = F.transform(F.filter("candidates", passes), lambda c: F.struct(c["start"], c["kind"], c["end"]))
    return seen.select("id", "base", "candidates", cut.alias("cut"), *kept).select(F.col("id").alias(id_col), "base", extra.alias("extra"), *kept)


def spelled(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by a mark. spans: sorted by start."""

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        grown = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(new, grown).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, rest))
