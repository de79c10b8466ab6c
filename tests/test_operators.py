import itertools
import random

from pyspark.sql import functions as F

from lodeworks.functions.text import let  # noqa: F401
from lodeworks.operators import analytics, dedup, joins, ranking
from lodeworks.operators.evaluation import validated
from lodeworks.queries.evaluation import _evidence
from lodeworks.streaming.ingest import append_once, file_stream, windowed_counts


def test_grouped_listing_keeps_all_names(spark):
    rows = spark.createDataFrame([("Battery Pack", c) for c in "CAB"], "role string, company string")
    assert analytics.listing(rows, "role", "company").first().names == "A; B; C"
    short = analytics.listing(rows, "role", "company", 2).first()
    assert (short.names, short.more) == ("A; B", 1)


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    parent = list(range(60))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = {r.id: r.component for r in dedup.connected(spark.createDataFrame(edges, "a long, b long").where("a <> b")).collect()}
    assert all(found[i] == find(i) for i in found) and len(found) == len({x for e in edges if e[0] != e[1] for x in e})


def test_near_pairs_against_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    texts = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(60)]
        texts += [base, [rng.choice(words) if rng.random() < 0.05 else w for w in base], [rng.choice(words) if rng.random() < 0.3 else w for w in base]]
    df = spark.createDataFrame([(i, " ".join(t[:6]), " ".join(t)) for i, t in enumerate(texts)], "id long, title string, body string")
    signed = df.join(dedup.simhash_table(df, "id", "body"), "id")
    got = {(r.a, r.b) for r in dedup.near_pairs(signed).collect()}

    def cosine(a, b):
        dot = sum(a.count(w) * b.count(w) for w in set(a))
        return dot / (sum(a.count(w) ** 2 for w in set(a)) * sum(b.count(w) ** 2 for w in set(b))) ** 0.5

    sig = {r.id: r.signature & (2**64 - 1) for r in signed.collect()}
    want = set()
    for a, b in itertools.combinations(range(len(texts)), 2):
        d, t = (sig[a] ^ sig[b]).bit_count(), cosine(texts[a][:6], texts[b][:6])
        if d <= 4 or t >= 0.6:
            x = cosine(texts[a], texts[b])
            if x >= 0.88 or (d <= 2 and t >= 0.6) or (x >= 0.84 and t >= 0.8) or (d <= 12 and x >= 0.82):
                want.add((a, b))
    assert got == want and want


def test_budget_and_caps(spark):
    df = spark.createDataFrame([(1, 4), (2, 5), (3, 9)], "id long, t long").withColumn("q", F.lit(1))
    assert [r.given for r in ranking.packed(df, ["q"], [F.asc("id")], "t", 10).orderBy("id").collect()] == [4, 5, 1]
    rows = spark.createDataFrame([(1, i, f"r{i}", "A" if i < 4 else "") for i in range(8)], "q int, id long, row string, company string")
    held = ranking.capped_by_group(rows, ["q"], "row", "company", [F.asc("id")], 2, 5)
    assert [r.id for r in held.orderBy("rank").collect()] == [0, 1, 4, 5, 6]


def test_upsert_and_names(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, joins.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]
    texts = spark.createDataFrame([(1, "The Acme Co. of Rome"), (2, "acmes")], "id long, text string")
    names = spark.createDataFrame([("Acme", "acme co", 0)], "name string, alias string, ord int")
    assert [(r.id, r.name) for r in joins.name_matches(texts, names, "id", "text").collect()] == [(1, "Acme")]


def test_streaming(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", "a" if i % 2 else "b", 1.5) for i in range(20)], "event_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    for _ in range(2):  # a second run adds nothing
        append_once(file_stream(spark, f"{tmp_path}/in", events.schema), f"{tmp_path}/out", f"{tmp_path}/ck", "event_id").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 20
    assert windowed_counts(events, "10 minutes").agg(F.sum("n")).first()[0] == 20


def test_evidence_is_every_document(spark, tmp_path):
    docs = [(7, "seven red lamps glow"), (60, "sixty blue boats sail"), (4000, "four thousand green birds sing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    answers = spark.createDataFrame([("a", "- sixty blue boats sail [DOC:d60]\n- red lamps glow [DOC:d7]\n- green birds sing [DOC:d4000]\n- lost [DOC:d8]\n- none")], "id string, text string")
    out = {r.ord: r for r in validated(answers, _evidence(spark, str(tmp_path))).collect()}
    assert [(out[k].missing, out[k].invalid, out[k].label) for k in range(5)] == [*[(False, False, "supported")] * 3, (False, True, "unsupported"), (True, False, "unsupported")]


def test_ranks_within_a_frequent_key(spark):
    rows = spark.range(2000).select((F.col("id") % 3 == 0).cast("string").alias("k"), (F.col("id") * 7919 % 2003).alias("v"), "id")
    got = {r.id: r.place for r in ranking.ranked_within(rows, ["k"], [F.desc("v"), F.asc("id")], "place", "places").collect()}
    for k in (True, False):
        own = sorted((i for i in range(2000) if (i % 3 == 0) == k), key=lambda i: (-(i * 7919 % 2003), i))
        assert [got[i] for i in own] == list(range(1, len(own) + 1))


def test_topics_over_their_share(spark):
    rows = [(i, "a" if i < 12 else "b" if i < 16 else "", "keep" if i != 3 else "discard", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, topic string, decision string, score double")
    out = {r.id: (r.decision, r.moved) for r in ranking.diversified(df, "topic", "decision", [F.desc("score"), F.asc("id")], 0.3).collect()}
    assert {i for i, (_, m) in out.items() if m} == {0, 1, 2, 4, 5} and out[3] == ("discard", False) and all(d == "review" for d, m in out.values() if m)
    few = ranking.diversified(df.where("id < 12"), "topic", "decision", [F.desc("score")], 0.2)
    assert few.where("moved").count() == 0 and few.count() == 12


def test_near_links_leave_no_pair_out(spark):
    """Pairs of very different lengths, of short bodies and of bodies that are alike at the beginning only."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, head = text(70), text(5000)
    bodies = [base, " ".join([base] * 4), "a b c d e f g", "a b c d e f g h", head + " other" * 8000, head + " thing" * 8000, f"{head} x", f"x {head}", text(50), text(50)]
    df = spark.createDataFrame([(i, " ".join(b.split()[:8]), b) for i, b in enumerate(bodies)], "id long, title string, body string")
    signed = df.join(dedup.simhash_table(df, "id", "body"), "id")
    pairs = {(r.a, r.b) for r in dedup.near_pairs(signed).collect()}
    assert pairs == {(0, 1), (2, 3), (6, 7)} and len(head) > 20_000
    assert {r.id: (r.component, r.links) for r in dedup.near_links(signed).collect()} == {i: (i - i % 2, 1) for i in (0, 1, 2, 3, 6, 7)}


def test_near_pairs_against_all_pairs_of_odd_titles(spark, monkeypatch):
    """Titles of few, many and repeated words, equal ones and none; in blocks of five documents, too."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(150):
        title = rng.choice([None, "", "w1", "w1 w1 w2", "w2 w1", *(" ".join(rng.choice(words[:9]) for _ in range(rng.randrange(1, 12))) for _ in range(8))])
        base = random.Random(i // 5).choices(words, k=40)
        rows.append((i, title, " ".join(rng.choice(words) if rng.random() < 0.1 else w for w in base) * rng.choice([1, 1, 3])))
    df = spark.createDataFrame(rows, "id long, title string, body string")
    signed = df.join(dedup.simhash_table(df, "id", "body"), "id")
    sig = {r.id: r.signature & (2**64 - 1) for r in signed.collect()}

    def cosine(a, b):
        a, b = (a or "").split(), (b or "").split()
        dot = sum(a.count(w) * b.count(w) for w in set(a))
        return dot / ((sum(a.count(w) ** 2 for w in set(a)) * sum(b.count(w) ** 2 for w in set(b))) ** 0.5 or 1)

    want = set()
    for (i, t1, b1), (j, t2, b2) in itertools.combinations(rows, 2):
        d, t, x = (sig[i] ^ sig[j]).bit_count(), cosine(t1, t2), cosine(b1, b2)
        if (d <= 4 or t >= 0.6) and (x >= 0.88 or (d <= 2 and t >= 0.6) or (x >= 0.84 and t >= 0.8) or (d <= 12 and x >= 0.82)):
            want.add((i, j))
    assert {(r.a, r.b) for r in dedup.near_pairs(signed).collect()} == want and len(want) > 40
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 5)
    assert {(r.a, r.b) for r in dedup.near_pairs(signed).collect()} == want
    links = dedup.near_links(signed).collect()
    assert sum(r.links for r in links) == 2 * len(want) and {r.id for r in links} == {i for p in want for i in p}
