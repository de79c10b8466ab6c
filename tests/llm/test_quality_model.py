import math
import random
import zlib

import numpy as np
import pytest

from lodeworks.llm import quality_model as qm
from lodeworks.llm.queries import op13_quality_model


def text_of(rng, good):
    words = ["".join(rng.choice("aeiourstln") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 120))]
    if good:
        return ". ".join(" ".join(words[i : i + 9]).capitalize() for i in range(0, len(words), 9)) + "."
    kind = rng.randrange(3)
    return " ".join(w + "###" for w in words) if kind == 0 else " ".join(w.upper() + "!!" for w in words) if kind == 1 else " ".join(w for w in words[:6] for _ in range(14))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows = [(i, text_of(rng, y), y) for i, y in enumerate(rng.random() < 0.8 for _ in range(600))]
    return [(i, t, int(y)) for i, t, y in rows]


def auc(scores, y):
    pairs = [(a, b) for a, p in zip(scores, y) if p for b, q in zip(scores, y) if not q]
    return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_rows_are_told_apart(spark, corpus, tmp_path):
    docs = [(i, t, "en", "s", 1, 0.5) for i, t, _ in corpus]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in corpus], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = op13_quality_model(spark, str(tmp_path)).collect()
    label = {i: y for i, _, y in corpus}
    out = [r for r in rows if r.held_out]
    assert len(rows) == len(corpus) and {r.doc_id for r in out} == {i for i in label if held(i)}
    assert auc([r.score for r in out], [label[r.doc_id] for r in out]) > 0.98
    assert sum(r.predicted == label[r.doc_id] for r in out) > 0.95 * len(out)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark, corpus, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    docs.write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in corpus], "doc_id long, quality int").write.parquet(f"{tmp_path}/a/labels.parquet")
    spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in corpus], "doc_id long, quality int").write.parquet(f"{tmp_path}/b/labels.parquet")
    a, b = (sorted(op13_quality_model(spark, f"{tmp_path}/{d}").collect()) for d in "ab")
    assert a == b


def test_edges(spark, corpus):
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 1), (None, 0), (7, None)], "doc_id long, quality int")
    rows = [(0, None), (1, ""), (1, "one two"), (None, "x y"), (7, " \n\t"), (8, "long text. " * 50_000), (8, "long text. " * 50_000), (9, "lone ퟿ \U0001f642 é")]
    docs = spark.createDataFrame([(i, t, "p", 3.0) for i, t in rows], "doc_id long, text string, predicted string, x double")
    found = qm.classify(docs, qm.fit(docs, labels), carry=("predicted",)).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found) and {r.carried_predicted for r in found} == {"p"}
    assert len({r.score for r in found if r.doc_id == 8}) == 1
    assert qm.classify(docs.limit(0), qm.fit(docs.limit(0), labels)).collect() == []
    none = qm.fit(docs, labels.limit(0))
    assert {r.score for r in qm.classify(docs, none).collect()} == {0.5}


def test_sample_is_bounded(spark, corpus):
    docs = spark.createDataFrame([(i % 5, t) for i, t, _ in corpus], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, quality int")
    seen = []
    original = qm.fit_tables
    qm.fit_tables = lambda x, y, **k: seen.append(len(y)) or original(x, y, **k)
    try:
        qm.fit(docs, labels, sample=4)
    finally:
        qm.fit_tables = original
    assert seen == [4]


def brute_line(g, h):
    """Gain of the best first cut."""
    score = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + qm.RIDGE)
    cuts = [c for c in range(1, len(g)) if h[:c].sum() >= qm.LEAST and h[c:].sum() >= qm.LEAST]
    return max((score(0, c) + score(c, len(g)) - score(0, len(g)) for c in cuts), default=0.0)


def test_trees_against_plain_search():
    rng = np.random.default_rng(5)
    for _ in range(20):
        g, h = rng.normal(size=9), rng.random(9) * 3
        gain, at = qm._split(g, h)
        assert math.isclose(gain, max(0.0, brute_line(g, h)), abs_tol=1e-9)
        values = qm.line_tree(g, h)
        assert len(set(values)) <= 3
        cells, weights = rng.normal(size=(5, 6)), rng.random((5, 6)) * 2
        best = max(brute_line(cells.sum(1), weights.sum(1)), 0)
        assert qm.grid_tree(cells, weights)[0] >= best - 1e-9


def test_pairs_find_what_no_single_measure_shows():
    rng = np.random.default_rng(7)
    x = rng.random((3000, len(qm.MEASURES)))
    y = ((x[:, 1] > 0.5) ^ (x[:, 4] > 0.5)).astype(float)
    model = qm.fit_tables(x[:2000], y[:2000])
    assert any((j, k) == (1, 4) for j, k, *_ in model.pairs)
    assert ((model.scores(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.95
