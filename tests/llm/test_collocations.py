import re
from collections import Counter

import pytest

from lodeworks.llm.collocations import collocations

COLUMNS = ("lang", "rank", "phrase", "a", "cut", "l", "r", "n", "score")


def plain(rows, max_words=3, least=10, share=50, top=2000):
    """The definition, word by word."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    frequent = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    found = []
    for (lang, w), a in frequent.items():
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
        longer = (b for (other, v), b in frequent.items() if other == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))))
        if not any(100 * b >= share * a for b in longer):
            found.append((lang, a, " ".join(w), *min(cuts)))
    found.sort(key=lambda x: (x[0].encode(), -x[3], -x[1], x[2].encode()))
    out, place = [], Counter()
    for lang, a, phrase, score, cut, left, right in found:
        place[lang] += 1
        if place[lang] <= top:
            out.append((lang, place[lang], phrase, a, cut, left, right, n[lang], score))
    return out


def run(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, score int, phrase string")
    return sorted((tuple(r[c] for c in COLUMNS) for r in collocations(docs, **options).collect()), key=lambda x: (x[0].encode(), x[1]))


HOT = "New York, new york! NEW YORK is big; the new york is Big\tTHE  big is.\x0bnew york the the the the"
ROWS = [(HOT, "en")] * 7 + [(HOT.replace(" ", "  "), None)] * 4 + [(None, "en"), ("", "de"), (" .,!", "de"), ("é É é É é É. ÉÉ", "und"), ("a b c d " * 3000, "fr"), ("one", "en")]


@pytest.mark.parametrize("options", [{}, {"max_words": 4, "least": 3}, {"least": 2, "top": 3, "share": 100}, {"max_words": 2, "least": 4, "share": 1}])
def test_collocations_against_the_definition(spark, options):
    assert run(spark, ROWS, **options) == plain(ROWS, **options)


def test_collocations_of_nothing(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), ("a b", "en")]) == []


def test_blocks_of_a_task_add_up(spark, monkeypatch):
    monkeypatch.setattr("lodeworks.llm.collocations.BLOCK_CHARS", 1)
    assert run(spark, ROWS, least=3) == plain(ROWS, least=3)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from lodeworks.llm.collocations import _exact

    big = spark.createDataFrame([(9 * 10**15, 9 * 10**15 + 7, 10**16 - 1)], "a long, l long, r long")
    got = big.select(F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (_exact("a") * _exact("a")), _exact("l") * _exact("r"))).first()[0]
    assert got == 10**6 * (9 * 10**15) ** 2 // ((9 * 10**15 + 7) * (10**16 - 1))
