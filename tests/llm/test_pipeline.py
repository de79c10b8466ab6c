"""The pipeline, stage by stage, against what the stages promise."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from lodeworks.llm import quality, secrets
from lodeworks.llm.common import table
from lodeworks.llm.queries import QUERIES

from .test_operators import base_spans, sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Small tables with copies, junk, secrets, nulls, repeated rows and ids, and a column with an operator's name."""
    rng, rows = random.Random(17), []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(70)]
        for k in range(4):
            text = " ".join(w if rng.random() > 0.01 * k else "changed" for w in base)
            rows.append((len(rows), text + (" password = hunter22secret end" if f % 3 == 0 else ""), "en", f"s{f % 3}" if f else None))
    rows += [(500, " ".join(["again and"] * 40), "en", "s0"), (501, "too short", "de", "s1"), (502, None, None, None), (503, "", "en", "s1")]
    rows += [(600, " ".join(f"p{i}" for i in range(80)), "de", "s2"), (600, " ".join(f"q{i}" for i in range(80)), "de", "s2"), (600, " ".join(f"p{i}" for i in range(80)), "de", "s2"), (None, " ".join(f"r{i}" for i in range(80)), "de", "s2"), (None, " ".join(f"t{i}" for i in range(80)), "de", "s2")]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(*r, len(r[1] or ""), 1) for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    """Each stage's rows, as whoever runs the stages gets them."""
    docs, out = table(spark, corpus, "documents"), []
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage")) + "/" + name
        stage(spark, docs, corpus).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [table(spark, corpus, "documents"), *out]


def test_quality_stage(spark, stages, corpus):
    before, after = stages[:2]
    judged = quality.judge(before, table(spark, corpus, "labels")).where("kept").count()
    assert after.columns == list(P.DOCUMENT) and after.count() == judged
    ids = {r.doc_id for r in after.collect()}
    assert not ids & {500, 501, 502, 503} and {600, None, 0} <= ids


def test_near_dedup_stage(stages):
    before, after = ([(r.doc_id, r.text) for r in s.collect()] for s in stages[1:3])
    s = {t: sets(t) for _, t in before}
    linked = lambda a, b: 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])
    left, groups = set(s), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if linked(x, y)}
            left -= near
            todo += near
        groups.append(group)
    assert len(after) == len(groups)
    for group in groups:
        kept, ids = [d for d, t in after if t in group], [d for d, t in before if t in group]
        assert kept == [min((d for d in ids if d is not None), default=None)]
    assert collections.Counter(d for d, _ in after)[600] == 2 and collections.Counter(d for d, _ in after)[None] == 2


def test_secrets_stage(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    for i, text in before.items():
        if i in (600, None):
            continue
        spans, want = base_spans(text), text
        for start, _, end in reversed(spans):
            want = want[:start] + "[secret]" + want[end:]
        assert after[i] == want
    assert any("[secret]" in t for t in after.values()) and not any(base_spans(t) for t in after.values())


def test_mixing_stage(stages):
    before, after = stages[3].collect(), stages[4].collect()
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    assert stages[4].columns == list(P.DOCUMENT) and words(after) == pytest.approx(1.5 * words(before), abs=5)
    texts = {(r.doc_id, r.text) for r in before}
    cut = [r for r in after if (r.doc_id, r.text) not in texts]
    assert len(cut) <= len({r.source for r in before}) and all(any(t.startswith(r.text) for _, t in texts) for r in cut)
    assert max(collections.Counter((r.doc_id, r.text) for r in after).values()) <= 2 and all(r.n_chars == len(r.text) for r in after)


def test_packing_stage(stages):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter(t for r in stages[4].collect() for t in [*library.encode(r.text, add_special_tokens=False).ids, 1])
    assert collections.Counter(t for r in stages[5].collect() for t in np.frombuffer(r.ids, "<u4").tolist()) == want


def test_run_does_what_the_stages_do(spark, corpus, stages):
    of = lambda df: sorted((r.doc_id or -1, r.start, r.length, bytes(r.ids)) for r in df.collect())
    assert of(P.run(spark, corpus)) == of(stages[5])


def test_a_stage_leaves_other_results_alone(spark, corpus, docs):
    held = secrets.scan_secrets(docs)
    query = QUERIES["op2_secrets"](spark, corpus)
    rows = P.quality(spark, table(spark, corpus, "documents"), corpus)
    rows.collect()
    P.near_dedup(spark, table(spark, corpus, "documents"), corpus).collect()
    assert held.count() == docs.count() and query.count() == table(spark, corpus, "documents").count()


def test_stages_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    assert all(s(spark, table(spark, str(tmp_path), "documents"), str(tmp_path)).select(F.count("*")).first()[0] == 0 for _, s in P.STAGES)
